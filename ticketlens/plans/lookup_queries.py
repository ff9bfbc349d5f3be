"""Registered verification, lifecycle and queue-analytics queries (D, L, A, R7-R11)."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import rules as R
from ..operators import lookup, ops, triage
from . import fixtures as fx
from . import jobs
from . import oracle as O
from .registry import SQL, register

FULL = O.full_ctes()


def _refs(spark, sf_dir):
    return lookup.reference_rows(jobs.scored(spark, sf_dir))


def _checked_text(col):
    return F.array_join(F.transform(col, lambda x: F.concat_ws(
        ":", x["ref_type"], x["ref_key"], x["found"].cast("string"), F.coalesce(x["record_status"], F.lit("-")))), "|")


# D1 ---------------------------------------------------------------------------
@register("verified_references", FULL + """
SELECT ticket_id, CAST(ref_seq AS BIGINT) AS ref_seq, ref_type, ref_key, found, record_status FROM checked""")
def verified_references(spark, sf_dir):
    c = lookup.verify_refs(_refs(spark, sf_dir), lookup.record_index(fx.records(spark, sf_dir)))
    return c.select("ticket_id", F.col("ref_seq").cast("bigint").alias("ref_seq"), "ref_type", "ref_key", "found",
                    "record_status")


# D2 ---------------------------------------------------------------------------
@register("verification_status", FULL + """
SELECT ticket_id, verification_status, verification_label, requires_manual_verification, n_checked, n_missing,
       checked_references FROM verified""")
def verification_status(spark, sf_dir):
    v = lookup.verify_tickets(jobs.scored(spark, sf_dir), fx.records(spark, sf_dir))
    return v.select("ticket_id", "verification_status", "verification_label", "requires_manual_verification",
                    F.col("n_checked").cast("bigint").alias("n_checked"),
                    F.col("n_missing").cast("bigint").alias("n_missing"),
                    _checked_text(F.col("checked_references")).alias("checked_references"))


# D3, D4 -----------------------------------------------------------------------
@register("unmatched_references", FULL + """
SELECT r.ticket_id, CAST(r.ref_seq AS BIGINT) AS ref_seq, r.ref_type, r.ref_key FROM refs r
WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.ref_type = r.ref_type AND i.ref_key = r.ref_key)""")
def unmatched_references(spark, sf_dir):
    u = lookup.unmatched_refs(_refs(spark, sf_dir), lookup.record_index(fx.records(spark, sf_dir)))
    return u.select("ticket_id", F.col("ref_seq").cast("bigint").alias("ref_seq"), "ref_type", "ref_key")


@register("matched_references", FULL + """
SELECT r.ref_type, CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT r.ticket_id) AS BIGINT) AS n_tickets
FROM refs r WHERE EXISTS (SELECT 1 FROM idx i WHERE i.ref_type = r.ref_type AND i.ref_key = r.ref_key)
GROUP BY r.ref_type""")
def matched_references(spark, sf_dir):
    m = lookup.matched_refs(_refs(spark, sf_dir), lookup.record_index(fx.records(spark, sf_dir)))
    return m.groupBy("ref_type").agg(F.count(F.lit(1)).alias("n_refs"),
                                     F.countDistinct("ticket_id").alias("n_tickets"))


# J1 core with R7, R8, R9 ------------------------------------------------------
@register("triage_final", FULL + """
SELECT ticket_id, priority, department, escalate_to_human, escalation_reasons, explanation, language_code,
       language_name, verification_status FROM final""")
def triage_final(spark, sf_dir):
    t = triage.flatten_decision(jobs.triaged(spark, sf_dir))
    return t.select("ticket_id", "priority", "department", "escalate_to_human", "escalation_reasons", "explanation",
                    "language_code", "language_name", "verification_status")


def _clarify_sql():
    no_del = "(len(order_ids) = 0 AND len(tracking_ids) = 0)"
    no_pay = "(len(transaction_ids) = 0 AND len(card_references) = 0)"
    words = " OR ".join(f"contains(lower(message), {O.q(w)})" for w in V.TECHNICAL_CONTEXT_WORDS)
    dl = ", ".join(O.q(x) for x in V.DELIVERY_INTENTS_NEEDING_REF)
    pl = ", ".join(O.q(x) for x in V.PAYMENT_INTENTS_NEEDING_REF)
    return (f"(CASE WHEN pred_intent IN ({dl}) AND {no_del} THEN {O.q(V.ASK_DELIVERY_REF)} "
            f"WHEN pred_intent IN ({pl}) AND {no_pay} THEN {O.q(V.ASK_PAYMENT_REF)} "
            f"WHEN starts_with(pred_intent, 'technical_') AND NOT ({words}) THEN {O.q(V.ASK_TECHNICAL)} END)")


# R9, R10 ----------------------------------------------------------------------
@register("clarification_gate", FULL + f"""
SELECT ticket_id, {_clarify_sql()} IS NULL AS ready, {_clarify_sql()} AS question, query_type, language_code
FROM scored""")
def clarification_gate(spark, sf_dir):
    s = jobs.scored(spark, sf_dir)
    qn = R.clarification(F.col("pred_intent"), F.col("entities"), F.col("message"))
    return s.select("ticket_id", qn.isNull().alias("ready"), qn.alias("question"), "query_type", "language_code")


# L1 ---------------------------------------------------------------------------
@register("ticket_store", FULL + """
SELECT ticket_id, status, agent_outcome, agent_reply, n_updates, priority, department, escalate_to_human FROM store""")
def ticket_store(spark, sf_dir):
    return jobs.store(spark, sf_dir).select("ticket_id", "status", "agent_outcome", "agent_reply",
                                            F.col("n_updates").cast("bigint").alias("n_updates"),
                                            "priority", "department", "escalate_to_human")


# L2 ---------------------------------------------------------------------------
@register("ticket_reviews", FULL + f"""
SELECT ticket_id, reviewer, final_query_type, final_intent, notes, {O.ts_text('reviewed_at')} AS reviewed_at
FROM reviews""")
def ticket_reviews(spark, sf_dir):
    r = jobs.reviews(spark, sf_dir)
    return r.select("ticket_id", "reviewer", "final_query_type", "final_intent", "notes",
                    F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("reviewed_at"))


# L3, D6 -----------------------------------------------------------------------
@register("status_timeline", FULL + f"""
SELECT ticket_id, CAST(count(*) AS BIGINT) AS n_events,
       string_agg(status || '@' || {O.ts_text('created_at')} || ':' || message, ' > ' ORDER BY created_at, event_id)
         AS timeline
FROM events_log GROUP BY ticket_id""")
def status_timeline(spark, sf_dir):
    tl = lookup.status_view(fx.tickets(spark, sf_dir).select("ticket_id"), jobs.events(spark, sf_dir))
    text = F.array_join(F.transform(F.col("timeline"), lambda e: F.concat(
        e["status"], F.lit("@"), F.date_format(e["created_at"], "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(":"),
        e["message"])), " > ")
    return tl.select("ticket_id", F.size("timeline").cast("bigint").alias("n_events"), text.alias("timeline"))


# L4 ---------------------------------------------------------------------------
@register("current_status", FULL + """
SELECT ticket_id, arg_max(status, (created_at, event_id)) AS current_status, CAST(count(*) AS BIGINT) AS n_events
FROM events_log GROUP BY ticket_id""")
def current_status(spark, sf_dir):
    return ops.current_status(jobs.events(spark, sf_dir))


@register("stream_current_status", SQL["current_status"])
def stream_current_status(spark, sf_dir):
    """The events as files, fed to the stream in three batches: as the batch fold."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming import status
    folder = f"{ensure_checkpoint_dir(spark)}/status-{uuid.uuid4().hex}"
    jobs.events(spark, sf_dir).repartition(6, "event_id").write.parquet(f"{folder}/events")
    return status.run_status(spark, f"{folder}/events", f"{folder}/states", checkpoint=f"{folder}/stream", max_files_per_trigger=2)


# L5 ---------------------------------------------------------------------------
@register("status_durations", FULL + """
SELECT status, CAST(count(*) AS BIGINT) AS n_events, CAST(count(seconds_in_status) AS BIGINT) AS n_closed,
       round(sum(seconds_in_status), 6) AS total_seconds
FROM (SELECT status, (epoch_us(lead(created_at) OVER (PARTITION BY ticket_id ORDER BY created_at, event_id))
                      - epoch_us(created_at)) / 1e6 AS seconds_in_status FROM events_log) d
GROUP BY status""")
def status_durations(spark, sf_dir):
    d = ops.status_durations(jobs.events(spark, sf_dir))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n_events"),
                                   F.count("seconds_in_status").alias("n_closed"),
                                   F.round(F.sum("seconds_in_status"), 6).alias("total_seconds"))


# D5 ---------------------------------------------------------------------------
@register("tickets_with_review", FULL + """
SELECT s.ticket_id, s.status, r.ticket_id IS NOT NULL AS has_review, r.reviewer, r.final_intent
FROM store s LEFT JOIN reviews r ON s.ticket_id = r.ticket_id""")
def tickets_with_review(spark, sf_dir):
    upd = jobs.updates_once(spark, sf_dir)
    j = lookup.tickets_with_review(jobs.store(spark, sf_dir, upd).select("ticket_id", "status"),
                                   jobs.reviews(spark, sf_dir, upd))
    return j.select("ticket_id", "status", F.col("review").isNotNull().alias("has_review"),
                    F.col("review.reviewer").alias("reviewer"), F.col("review.final_intent").alias("final_intent"))


# D8, S10 ----------------------------------------------------------------------
@register("feedback_export", FULL + f"""
SELECT s.ticket_id, s.message AS customer_message, s.query_type AS predicted_query_type,
       s.pred_intent AS predicted_intent, coalesce(r.final_query_type, '') AS final_query_type,
       coalesce(r.final_intent, '') AS final_intent, r.reviewer, coalesce(r.notes, '') AS notes, s.status,
       {O.ts_text('r.reviewed_at')} AS reviewed_at
FROM reviews r JOIN store s ON r.ticket_id = s.ticket_id""")
def feedback_export(spark, sf_dir):
    from ..sources import io
    upd = jobs.updates_once(spark, sf_dir)
    return io.feedback_export_frame(jobs.reviews(spark, sf_dir, upd), jobs.store(spark, sf_dir, upd))


# A1 ---------------------------------------------------------------------------
@register("kpis", FULL + """
SELECT CAST(count(*) AS BIGINT) AS total_tickets,
       CAST(count(*) - count_if(status = 'resolved') AS BIGINT) AS open_tickets,
       CAST(count_if(status = 'resolved') AS BIGINT) AS resolved_tickets,
       CAST(count_if(escalate_to_human) AS BIGINT) AS escalated_tickets,
       (SELECT CAST(count(*) AS BIGINT) FROM reviews) AS reviewed_tickets,
       CASE WHEN count(*) > 0 THEN round((SELECT count(*) FROM reviews) / count(*), 4) ELSE 0.0 END AS feedback_coverage
FROM store""")
def kpis(spark, sf_dir):
    upd = jobs.updates_once(spark, sf_dir)
    return ops.kpis(jobs.store(spark, sf_dir, upd), jobs.reviews(spark, sf_dir, upd))


# A2, A3 -----------------------------------------------------------------------
@register("breakdown", FULL + """
SELECT dimension, bucket, CAST(n AS BIGINT) AS n, round(n / greatest(1, max(n) OVER (PARTITION BY dimension)), 6) AS bar_share
FROM (SELECT 'query_type' AS dimension, query_type AS bucket, count(*) AS n FROM store GROUP BY query_type
      UNION ALL SELECT 'priority', priority, count(*) FROM store GROUP BY priority
      UNION ALL SELECT 'status', status, count(*) FROM store GROUP BY status) g""")
def breakdown(spark, sf_dir):
    return ops.breakdown(jobs.store(spark, sf_dir).select("query_type", "priority", "status"))


# A4 ---------------------------------------------------------------------------
@register("queue_top", FULL + f"""
SELECT ticket_id, {O.ts_text('created_at')} AS created_at, priority, department, status
FROM store ORDER BY created_at DESC, ticket_id LIMIT 50""")
def queue_top(spark, sf_dir):
    q = ops.queue(jobs.store(spark, sf_dir), 50)
    return q.select("ticket_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
                    "priority", "department", "status")


# A5 ---------------------------------------------------------------------------
@register("queue_counts", FULL + """
SELECT CAST(count_if(status <> 'resolved') AS BIGINT) AS active,
       CAST(count_if(status <> 'resolved' AND priority = 'critical') AS BIGINT) AS active_critical,
       CAST(count_if(status <> 'resolved' AND escalate_to_human) AS BIGINT) AS active_escalated,
       CAST(count_if(status <> 'resolved' AND NOT escalate_to_human) AS BIGINT) AS specialist,
       CAST(count_if(priority = 'critical') AS BIGINT) AS critical_all,
       CAST(count_if(escalate_to_human) AS BIGINT) AS escalated_all,
       CAST(count_if(status = 'open') AS BIGINT) AS open_status
FROM store""")
def queue_counts(spark, sf_dir):
    return ops.queue_counts(jobs.store(spark, sf_dir))


# A6 ---------------------------------------------------------------------------
@register("queue_heads", FULL + f"""
SELECT queue, CAST(rank AS BIGINT) AS rank, ticket_id, {O.ts_text('created_at')} AS created_at, priority FROM (
  SELECT *, CASE WHEN escalate_to_human THEN 'manual_review' ELSE 'specialist' END AS queue,
         row_number() OVER (PARTITION BY CASE WHEN escalate_to_human THEN 'manual_review' ELSE 'specialist' END
                            ORDER BY created_at DESC, ticket_id) AS rank
  FROM store WHERE status <> 'resolved') x
WHERE rank <= 5""")
def queue_heads(spark, sf_dir):
    h = ops.queue_heads(jobs.store(spark, sf_dir), 5)
    return h.select("queue", F.col("rank").cast("bigint").alias("rank"), "ticket_id",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "priority")
