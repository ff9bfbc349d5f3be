"""Reference verification and ticket/review/event joins.

Design for scale: the record side is derived from ``orders`` and grows with
it, so nothing here is force-broadcast.  Spark broadcasts a side only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks
at run time), otherwise it sort-merges; a hot reference (one order named by a
third of all tickets) is split by AQE's skew-join handling on the ticket side.
Per-ticket roll-ups group on ``ticket_id`` which is unique per ticket, so no
group is larger than the references one message holds.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.text import canon_ref

KIND_FIELDS = (("order", "order_ids"), ("tracking", "tracking_ids"), ("transaction", "transaction_ids"))


# S4 ---------------------------------------------------------------------------
def record_index(records: DataFrame) -> DataFrame:
    """Three lookups (order, tracking, transaction) as one keyed table:
    (ref_type, ref_key, record_status).  Tracking skips null references."""
    order = records.select(F.lit("order").alias("ref_type"), canon_ref(F.col("reference")).alias("ref_key"),
                           F.col("order_status").alias("record_status"))
    tracking = (records.where(F.col("tracking_reference").isNotNull())
                .select(F.lit("tracking").alias("ref_type"), canon_ref(F.col("tracking_reference")).alias("ref_key"),
                        F.col("order_status").alias("record_status")))
    txn = records.select(F.lit("transaction").alias("ref_type"),
                         canon_ref(F.col("transaction_reference")).alias("ref_key"),
                         F.col("transaction_status").alias("record_status"))
    return order.unionByName(tracking).unionByName(txn)


# D1 ---------------------------------------------------------------------------
def reference_rows(df: DataFrame, id_col: str = "ticket_id", entities: str = "entities") -> DataFrame:
    """One row per extracted reference: (id, ref_seq, ref_type, ref_key), in the
    order orders, tracking, transactions, each in extraction order."""
    e = F.col(entities)

    def tagger(kind):
        return lambda x: F.struct(F.lit(kind).alias("ref_type"), x.alias("raw"))

    tagged = F.concat(*[F.transform(e[field], tagger(kind)) for kind, field in KIND_FIELDS])
    rows = df.select(F.col(id_col), F.posexplode(tagged).alias("ref_seq", "ref"))
    return rows.select(id_col, "ref_seq", F.col("ref.ref_type").alias("ref_type"),
                       canon_ref(F.col("ref.raw")).alias("ref_key"))


def verify_refs(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Left outer equi-join of every reference to the record index."""
    idx = index.select("ref_type", "ref_key", "record_status", F.lit(True).alias("found"))
    out = refs.join(idx, on=["ref_type", "ref_key"], how="left")
    return out.withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


# D2 ---------------------------------------------------------------------------
def verification_rollup(checked: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Per ticket with references: counts and the ordered checked list."""
    return checked.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_checked"),
        F.count_if(~F.col("found")).alias("n_missing"),
        F.array_sort(F.collect_list(F.struct("ref_seq", "ref_type", "ref_key", "found", "record_status")))
        .alias("checked_references"),
    )


def verification_status(tickets: DataFrame, rollup: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Attach status / label / summary / manual flag; tickets without references
    get the 'none supplied' outcome (left join keeps them)."""
    j = tickets.join(rollup, on=id_col, how="left")
    n, miss = F.coalesce(F.col("n_checked"), F.lit(0)), F.coalesce(F.col("n_missing"), F.lit(0))

    def pick(i):
        none, missing, found = V.VERIFY_NONE[i], V.VERIFY_MISSING[i], V.VERIFY_FOUND[i]
        return F.when(n == 0, F.lit(none)).when(miss > 0, F.lit(missing)).otherwise(F.lit(found))

    return j.select(
        "*",
        pick(0).alias("verification_status"),
        pick(1).alias("verification_label"),
        pick(2).alias("verification_summary"),
        pick(3).alias("requires_manual_verification"),
    ).withColumn("n_checked", n).withColumn("n_missing", miss).withColumn(
        "checked_references", F.coalesce(F.col("checked_references"), F.array().cast(
            "array<struct<ref_seq:int,ref_type:string,ref_key:string,found:boolean,record_status:string>>")))


def verify_tickets(scored: DataFrame, records: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    refs = reference_rows(scored, id_col)
    rollup = verification_rollup(verify_refs(refs, record_index(records)), id_col)
    return verification_status(scored, rollup, id_col)


# D3, D4 -----------------------------------------------------------------------
def unmatched_refs(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.join(index.select("ref_type", "ref_key"), on=["ref_type", "ref_key"], how="left_anti")


def matched_refs(refs: DataFrame, index: DataFrame) -> DataFrame:
    return refs.join(index.select("ref_type", "ref_key"), on=["ref_type", "ref_key"], how="left_semi")


# D5 ---------------------------------------------------------------------------
def tickets_with_review(tickets: DataFrame, reviews: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """One left join instead of one lookup per listed ticket."""
    r = reviews.select(id_col, F.struct(*[c for c in reviews.columns if c != id_col]).alias("review"))
    return tickets.join(r, on=id_col, how="left")


# D6 ---------------------------------------------------------------------------
def status_view(tickets: DataFrame, events: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Each ticket with its events in time order (event id breaks ties)."""
    tl = events.groupBy(id_col).agg(F.array_sort(F.collect_list(
        F.struct("created_at", "event_id", "status", "message"))).alias("timeline"))
    return tickets.join(tl, on=id_col, how="left")


# D8 ---------------------------------------------------------------------------
def review_export(reviews: DataFrame, tickets: DataFrame, id_col: str = "ticket_id") -> DataFrame:
    """Reviews joined to their tickets; orphan reviews are skipped (inner join)."""
    return reviews.join(tickets, on=id_col, how="inner")


# D11 --------------------------------------------------------------------------
def exclude_heldout(train: DataFrame, heldout: DataFrame, text: str = "text") -> DataFrame:
    """Training rows whose text is in the held-out set are removed (anti-join)."""
    return train.join(heldout.select(text).distinct(), on=text, how="left_anti")
