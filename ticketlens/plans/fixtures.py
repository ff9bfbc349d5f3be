"""Rendered tickets and the tables derived from the driver data (Spark side).

The driver tables carry no support vocabulary, so tickets are *rendered*: one
ticket per ``events`` row, its message chosen from our templates by
``event_id % T`` and its slots filled from keys derived from the row.  The
template lookup is a literal array indexed per row (a projection, not a join)
and the order count is a scalar subquery, so the whole view is one narrow
stage over ``events`` and scales with it.  ``plans/oracle.py`` writes the same
view in DuckDB SQL.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import query_type_for
from ..session import read_table

T = len(V.TICKET_TEMPLATES)
SLOTS = ("order", "tracking", "txn", "digits", "amount", "card", "phone", "email", "date")


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pick(values, idx: Column) -> Column:
    """values[idx] for a 0-based index column."""
    return F.element_at(_lit_array(values), (idx + F.lit(1)).cast("int"))


def slot_values(event_id: Column, user_id: Column, order_key: Column) -> dict[str, Column]:
    return {
        "order": F.format_string("ORD-%06d", order_key),
        "tracking": F.format_string("TRK-%06d", order_key),
        "txn": F.format_string("TXN-%06d", order_key),
        "digits": F.format_string("%06d", order_key),
        "amount": F.format_string("$%d.%02d", event_id % 500, event_id % 100),
        "card": F.format_string("%04d", (event_id * 7) % 10000),
        "phone": F.format_string("+1 415 %03d %04d", (event_id * 13) % 1000, (event_id * 17) % 10000),
        "email": F.format_string("buyer.%d@example.com", user_id),
        "date": F.format_string("%02d/%02d/2024", (event_id % 28) + 1, (event_id % 12) + 1),
    }


def render(template: Column, slots: dict[str, Column]) -> Column:
    out = template
    for name in SLOTS:
        out = F.replace(out, F.lit("{" + name + "}"), slots[name])
    return out


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered tickets: ticket_id, created_at, customer_id, template_id, order_key,
    message, true_intent, pred_intent, confidence, query_confidence, status."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    n_orders = read_table(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return render_tickets(events, n_orders)


def render_tickets(events: DataFrame, n_orders) -> DataFrame:
    """Row-wise rendering of ``events`` (batch or streaming); ``n_orders`` is a
    Column (scalar subquery) or a plain number for a stream."""
    n = n_orders if isinstance(n_orders, Column) else F.lit(int(n_orders))
    eid = F.col("event_id")
    tid = eid % F.lit(T)
    order_key = (eid * F.lit(31)) % F.floor(n * F.lit(11) / F.lit(10))
    intents = [i for i, _ in V.TICKET_TEMPLATES]
    texts = [t for _, t in V.TICKET_TEMPLATES]
    next_intents = intents[1:] + intents[:1]
    base = events.select(
        eid.alias("ticket_id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("customer_id"),
        tid.alias("template_id"),
        order_key.alias("order_key"),
        F.col("event_type"),
    )
    tcol, ok = F.col("template_id"), F.col("order_key")
    true_intent = pick(intents, tcol)
    return base.select(
        "ticket_id", "created_at", "customer_id", "template_id", "order_key",
        render(pick(texts, tcol), slot_values(F.col("ticket_id"), F.col("customer_id"), ok)).alias("message"),
        true_intent.alias("true_intent"),
        F.when(F.col("ticket_id") % 7 == 0, pick(next_intents, tcol)).otherwise(true_intent).alias("pred_intent"),
        (((F.col("ticket_id") * 37) % 101) / F.lit(100.0)).alias("confidence"),
        F.when(F.col("ticket_id") % 5 == 0, F.lit(None).cast("double"))
        .otherwise(((F.col("ticket_id") * 53) % 101) / F.lit(100.0)).alias("query_confidence"),
        F.coalesce(F.try_element_at(F.create_map(*[x for k, v in V.EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))]),
                                    F.col("event_type")), F.lit("open")).alias("status"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational records derived from ``orders``: one row per order with its
    order, tracking (null where o_orderkey % 3 = 2) and transaction reference."""
    return records_from_orders(read_table(spark, sf_dir, "orders"))


def records_from_orders(orders: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")

    def status(d):
        return F.coalesce(F.try_element_at(F.create_map(*[x for a, b in d.items() for x in (F.lit(a), F.lit(b))]),
                                           F.col("o_orderstatus")), F.lit("unknown"))

    return o.select(
        k.alias("order_key"),
        F.format_string("ORD-%06d", k).alias("reference"),
        F.when(k % 3 != 2, F.format_string("TRK-%06d", k)).alias("tracking_reference"),
        F.format_string("TXN-%06d", k).alias("transaction_reference"),
        status(V.ORDER_STATUS_NAMES).alias("order_status"),
        status(V.TRANSACTION_STATUS_NAMES).alias("transaction_status"),
        F.format_string("%.2f", F.col("o_totalprice")).alias("amount"),
        F.format_string("%04d", F.col("o_custkey") % 10000).alias("card_last_four"),
        F.format_string("CUST-%d", F.col("o_custkey")).alias("customer_ref"),
    )


def updates(spark: SparkSession, sf_dir: str, tix: DataFrame | None = None) -> DataFrame:
    """Agent updates: tickets with id % 3 = 0 get one, id % 6 = 0 a second one
    (reopening or resolving); some carry null outcome or null labels.  Both come
    from one pass over the tickets."""
    t = tix if tix is not None else tickets(spark, sf_dir)
    tid = F.col("ticket_id")
    first = F.struct(
        (tid * 2).alias("update_id"), tid.alias("ticket_id"),
        F.timestamp_add("MINUTE", (tid % 47) + 1, F.col("created_at")).alias("updated_at"),
        pick(["in_progress", "resolved", "open"], (tid / 3).cast("long") % 3).alias("status"),
        F.when(tid % 4 != 0, F.col("true_intent")).alias("final_intent"),
        F.when(tid % 9 != 0, F.format_string("Outcome noted for ticket %d", tid)).alias("outcome"),
        F.format_string("agent%d", tid % 5).alias("reviewer"),
        F.when(tid % 2 != 0, F.format_string("We looked into ticket %d.", tid)).alias("reply"),
    )
    second = F.when(tid % 6 == 0, F.struct(
        (tid * 2 + 1).alias("update_id"), tid.alias("ticket_id"),
        F.timestamp_add("MINUTE", F.lit(180), F.col("created_at")).alias("updated_at"),
        F.when((tid / 6).cast("long") % 2 == 0, F.lit("open")).otherwise(F.lit("resolved")).alias("status"),
        F.when(tid % 12 != 0, F.col("pred_intent")).alias("final_intent"),
        F.when(tid % 4 != 0, F.format_string("Follow-up for ticket %d", tid)).alias("outcome"),
        F.format_string("agent%d", (tid + 1) % 5).alias("reviewer"),
        F.when(tid % 18 != 0, F.format_string("Your case %d was reviewed again.", tid)).alias("reply"),
    ))
    u = t.where(tid % 3 == 0).select(F.inline(F.array_compact(F.array(first, second))))
    return u.withColumn("final_query_type", F.when(F.col("final_intent").isNotNull(),
                                                   query_type_for(F.col("final_intent"))))
