"""Operational analytics (A1-A6) and the ticket lifecycle fold.

Updates and events are append-only logs; state is a fold over them:
``max_by`` over a (time, id) key for "last wins", ``min`` for "first time
kept".  Each fold groups on ``ticket_id`` (a handful of rows per ticket) with
partial aggregation before the shuffle, so a busy ticket never lands whole in
one task.  Dashboard counts use one scan with ``count_if`` and one
``GROUPING SETS`` aggregate instead of three counters.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V


def _status_message(status) -> F.Column:
    m = F.create_map(*[x for k, v in V.STATUS_EVENT_MESSAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, status)


# L1 ---------------------------------------------------------------------------
def apply_updates(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Last update per ticket sets status, outcome and reply; omitted fields
    become null (no transition check).  Updates without a reply column have no reply."""
    reply = F.col("reply") if "reply" in updates.columns else F.lit(None).cast("string")
    last = updates.groupBy("ticket_id").agg(F.max_by(
        F.struct(F.col("status").alias("u_status"), F.col("outcome").alias("u_outcome"), reply.alias("u_reply")),
        F.struct("updated_at", "update_id")).alias("u"), F.count(F.lit(1)).alias("n_updates"))
    j = tickets.join(last, on="ticket_id", how="left")
    has = F.col("u").isNotNull()
    return (j.withColumn("status", F.when(has, F.col("u.u_status")).otherwise(F.col("status")))
            .withColumn("agent_outcome", F.when(has, F.col("u.u_outcome")))
            .withColumn("agent_reply", F.when(has, F.col("u.u_reply")))
            .withColumn("n_updates", F.coalesce(F.col("n_updates"), F.lit(0)))
            .drop("u"))


# L2 ---------------------------------------------------------------------------
def upsert_reviews(updates: DataFrame) -> DataFrame:
    """One review per ticket, only from updates carrying a label or outcome;
    fields from the last such update, reviewed_at from the first."""
    nonblank = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    q = updates.where(nonblank("final_query_type") | nonblank("final_intent") | nonblank("outcome"))
    r = q.groupBy("ticket_id").agg(
        F.max_by(F.struct(F.col("reviewer"), F.col("final_query_type"), F.col("final_intent"),
                          F.col("outcome").alias("notes")), F.struct("updated_at", "update_id")).alias("last"),
        F.min("updated_at").alias("reviewed_at"))
    return r.select("ticket_id", "last.reviewer", "last.final_query_type", "last.final_intent", "last.notes",
                    "reviewed_at")


# L3 ---------------------------------------------------------------------------
def ticket_events(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Event log: one 'received' event per ticket plus one per update."""
    received = tickets.select((F.col("ticket_id") * 4).alias("event_id"), "ticket_id",
                              F.lit(V.RECEIVED_STATUS).alias("status"),
                              F.lit(V.STATUS_EVENT_MESSAGES[V.RECEIVED_STATUS]).alias("message"), "created_at")
    upd = updates.select((F.col("update_id") * 2 + 1).alias("event_id"), "ticket_id", "status",
                         _status_message(F.col("status")).alias("message"),
                         F.col("updated_at").alias("created_at"))
    return received.unionByName(upd)


# L4 ---------------------------------------------------------------------------
def current_status(events: DataFrame) -> DataFrame:
    return events.groupBy("ticket_id").agg(
        F.max_by(F.col("status"), F.struct("created_at", "event_id")).alias("current_status"),
        F.count(F.lit(1)).alias("n_events"))


# L5 ---------------------------------------------------------------------------
def status_durations(events: DataFrame) -> DataFrame:
    """Seconds spent in each status until the next event (last one open-ended)."""
    w = Window.partitionBy("ticket_id").orderBy("created_at", "event_id")
    nxt = F.lead("created_at").over(w)
    secs = F.timestamp_diff("MICROSECOND", F.col("created_at"), nxt)  # wall-clock times: no session zone involved
    return events.select("ticket_id", "event_id", "status", "created_at", (secs / F.lit(1e6)).alias("seconds_in_status"))


# A1 ---------------------------------------------------------------------------
def kpis(tickets: DataFrame, reviews: DataFrame) -> DataFrame:
    t = tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("status") == "resolved").alias("resolved_tickets"),
        F.count_if(F.col("escalate_to_human")).alias("escalated_tickets"))
    # Review count as a scalar subquery (no join).
    j = t.withColumn("reviewed_tickets", reviews.agg(F.count(F.lit(1))).scalar())
    return j.select(
        "total_tickets",
        (F.col("total_tickets") - F.col("resolved_tickets")).alias("open_tickets"),
        "resolved_tickets", "escalated_tickets", "reviewed_tickets",
        F.when(F.col("total_tickets") > 0, F.round(F.col("reviewed_tickets") / F.col("total_tickets"), 4))
        .otherwise(F.lit(0.0)).alias("feedback_coverage"))


# A2, A3 -----------------------------------------------------------------------
def breakdown(tickets: DataFrame) -> DataFrame:
    """Counts by query type, priority and status in one GROUPING SETS pass, with
    each bucket's share of its dimension's largest bucket (bar width, A3)."""
    qt, pr, st = F.col("query_type"), F.col("priority"), F.col("status")
    g = tickets.groupingSets([[qt], [pr], [st]], qt, pr, st).agg(F.grouping_id(qt, pr, st).alias("_g"), F.count(F.lit(1)).alias("n"))
    is_qt, is_pr = F.col("_g") == 3, F.col("_g") == 5   # a null bucket keeps its row
    g = g.select(F.when(is_qt, F.lit("query_type")).when(is_pr, F.lit("priority")).otherwise(F.lit("status")).alias("dimension"),
                 F.when(is_qt, qt).when(is_pr, pr).otherwise(st).alias("bucket"), "n")
    w = Window.partitionBy("dimension")
    return g.withColumn("bar_share", F.round(F.col("n") / F.greatest(F.lit(1), F.max("n").over(w)), 6))


# A4 ---------------------------------------------------------------------------
def queue(tickets: DataFrame, limit: int = V.QUEUE_LIMIT_DEFAULT) -> DataFrame:
    """Newest first, limit clamped to 1..200 (a top-k: TakeOrderedAndProject)."""
    k = min(max(int(limit), V.QUEUE_LIMIT_MIN), V.QUEUE_LIMIT_MAX)
    return tickets.orderBy(F.col("created_at").desc(), F.col("ticket_id")).limit(k)


# A5 ---------------------------------------------------------------------------
def queue_label(status, escalated) -> F.Column:
    return (F.when(status == "resolved", F.lit("resolved"))
            .when(escalated, F.lit("manual_review")).otherwise(F.lit("specialist")))


def queue_counts(tickets: DataFrame) -> DataFrame:
    active = F.col("status") != "resolved"
    return tickets.agg(
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("priority") == "critical")).alias("active_critical"),
        F.count_if(active & F.col("escalate_to_human")).alias("active_escalated"),
        F.count_if(active & ~F.col("escalate_to_human")).alias("specialist"),
        F.count_if(F.col("priority") == "critical").alias("critical_all"),
        F.count_if(F.col("escalate_to_human")).alias("escalated_all"),
        F.count_if(F.col("status") == "open").alias("open_status"))


# A6 ---------------------------------------------------------------------------
def queue_heads(tickets: DataFrame, n: int = 5) -> DataFrame:
    """First n per queue, newest first (row_number per queue, a top-k per group)."""
    q = tickets.withColumn("queue", queue_label(F.col("status"), F.col("escalate_to_human")))
    w = Window.partitionBy("queue").orderBy(F.col("created_at").desc(), F.col("ticket_id"))
    return q.where(F.col("queue") != "resolved").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# R11 --------------------------------------------------------------------------
def public_view(analysed: DataFrame, column: str = "duplicate_candidates", ticket: str = "ticket") -> DataFrame:
    """What a customer may see: internal duplicate matches are emptied, in the
    result and in the ticket nested in it (where there is one)."""
    out = analysed.withColumn(column, F.array().cast(analysed.schema[column].dataType))
    if ticket in analysed.columns and column in analysed.schema[ticket].dataType.fieldNames():
        empty = F.array().cast(analysed.schema[ticket].dataType[column].dataType)
        out = out.withColumn(ticket, F.when(F.col(ticket).isNotNull(), F.col(ticket).withField(column, empty)))
    return out
