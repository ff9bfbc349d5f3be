"""Composite jobs (J family) built from the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import rules as R
from ..operators import lookup, ops, triage
from . import fixtures as fx


def scored(spark: SparkSession, sf_dir: str, intent_model=None, query_model=None) -> DataFrame:
    return triage.score(triage.model_scored(fx.tickets(spark, sf_dir), intent_model, query_model))


def triaged(spark: SparkSession, sf_dir: str, intent_model=None, query_model=None) -> DataFrame:
    """J1 without retrieval and duplicates: score (M5, M6 where models are given) -> decide ->
    verify (D1/D2) -> post-rules (R7, R8) -> clarification (R9)."""
    s = triage.decide(scored(spark, sf_dir, intent_model, query_model))
    v = lookup.verify_tickets(s, fx.records(spark, sf_dir))
    out = triage.apply_post_rules(v)
    return out.withColumn("clarification_question",
                          R.clarification(F.col("pred_intent"), F.col("entities"), F.col("message")))


def updates_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The updates, written once, for queries that read them more than once."""
    from ..operators.similar import materialise
    return materialise(fx.updates(spark, sf_dir))


def store(spark: SparkSession, sf_dir: str, upd: DataFrame | None = None) -> DataFrame:
    """The ticket store after agent updates (L1), decision flattened."""
    t = triage.flatten_decision(triaged(spark, sf_dir))
    return ops.apply_updates(t, fx.updates(spark, sf_dir) if upd is None else upd)


def reviews(spark: SparkSession, sf_dir: str, upd: DataFrame | None = None) -> DataFrame:
    return ops.upsert_reviews(fx.updates(spark, sf_dir) if upd is None else upd)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.tickets(spark, sf_dir)
    return ops.ticket_events(t, fx.updates(spark, sf_dir, t))


# J2 ---------------------------------------------------------------------------
def labelled_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three labelled sources derived from the rendered tickets: fine-labelled
    base rows, legacy rows carrying only a broad label, and training-only
    paraphrases (lower-cased messages)."""
    from ..functions.text import query_type_for
    from ..operators.similar import materialise
    # Three sources read the rendered tickets: render them once.
    t = materialise(fx.tickets(spark, sf_dir).select("ticket_id", "message", "true_intent"))
    tid = F.col("ticket_id")
    base = t.where(tid % 4 != 3).select(F.col("message").alias("text"), query_type_for(F.col("true_intent"))
                                        .alias("query_type"), F.col("true_intent").alias("intent"),
                                        F.lit(1).alias("source_rank"), tid.alias("row_id"))
    legacy = t.where(tid % 4 == 3).select(F.col("message").alias("text"),
                                          query_type_for(F.col("true_intent")).alias("intent"),
                                          F.lit(2).alias("source_rank"), tid.alias("row_id"))
    para = t.where(tid % 10 == 1).select(F.lower(F.col("message")).alias("text"),
                                         query_type_for(F.col("true_intent")).alias("query_type"),
                                         F.col("true_intent").alias("intent"),
                                         F.lit(3).alias("source_rank"), tid.alias("row_id"))
    return base, legacy, para


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 -> P1 -> P2 -> P4 -> P5 -> D11 -> union -> P7; rows tagged train / test."""
    from ..operators import prep
    from ..operators.similar import materialise
    base, legacy, para = labelled_sources(spark, sf_dir)
    merged = materialise(prep.dedupe(prep.harmonise(base).unionByName(prep.harmonise(legacy)), "text",
                                     ["source_rank", "row_id"], keep="first"))
    prep.check_coverage(merged)
    split = prep.stratified_split(merged)
    test = split.where(F.col("split") == "test")
    train = split.where(F.col("split") == "train").drop("split")
    train = prep.dedupe(train.unionByName(prep.harmonise(para).select(*train.columns)), "text",
                        ["source_rank", "row_id"], keep="first")
    train = lookup.exclude_heldout(train, test).withColumn("split", F.lit("train"))
    return prep.seeded_shuffle(train.unionByName(test))


# J3 ---------------------------------------------------------------------------
def feedback_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The S10 export with agent-entry noise injected by rule: upper-case types,
    an unknown type, disagreeing labels and blank intents (P8 must catch them)."""
    from ..sources import io
    upd = updates_once(spark, sf_dir)
    e = io.feedback_export_frame(reviews(spark, sf_dir, upd), store(spark, sf_dir, upd))
    tid = F.col("ticket_id")
    qt = (F.when(tid % 5 == 1, F.upper(F.col("final_query_type")))
          .when(tid % 7 == 2, F.lit("billing"))
          .when(tid % 11 == 3, F.when(F.col("final_query_type") == "delivery", F.lit("payment"))
                .otherwise(F.lit("delivery")))
          .otherwise(F.col("final_query_type")))
    it = F.when(tid % 13 == 4, F.lit("")).when(tid % 17 == 5, F.initcap(F.replace(F.col("final_intent"), F.lit("_"), F.lit(" ")))) \
        .otherwise(F.col("final_intent"))
    return e.withColumn("final_query_type", qt).withColumn("final_intent", it)


def retraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import prep
    base = training_set(spark, sf_dir).where(F.col("split") == "train").select("text", "query_type", "intent")
    fb = prep.validate_feedback(feedback_export(spark, sf_dir))
    return prep.retraining_set(base, fb)


# J4 ---------------------------------------------------------------------------
def safety_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader expects of each ticket's message (by template, written by
    hand) and of a reference that no record has, next to the decision made."""
    t = triaged(spark, sf_dir)
    priority, person = zip(*V.EXPECTED_TRIAGE)
    unknown = F.col("verification_status") == F.lit(V.VERIFY_MISSING[0])
    return t.select("ticket_id", fx.pick(priority, F.col("template_id")).alias("expected_priority"),
                    (fx.pick(person, F.col("template_id")) | unknown).alias("expected_escalation"),
                    F.col("decision.priority").alias("priority"),
                    F.col("decision.escalate_to_human").alias("escalate_to_human"))


# J1 ---------------------------------------------------------------------------
def with_duplicates(triaged_tickets: DataFrame) -> DataFrame:
    """Adds ``duplicate_candidates`` (V3): for every ticket the open ones its masked message is close to, itself left out."""
    from ..functions.text import mask_sensitive
    from ..operators import similar as S
    t = triaged_tickets.select("ticket_id", "created_at", mask_sensitive(F.col("message")).alias("text"), "status",
                               F.col("decision.department").alias("department"))
    unresolved = F.col("status") != "resolved"
    hits = S.duplicate_candidates(t.select(F.col("ticket_id").alias("message_id"), "text", unresolved.alias("own")), t.where(unresolved), own="own")
    lists = hits.groupBy("message_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "ticket_id", "similarity", "status", "department"))).alias("duplicate_candidates"))  # three at most
    none = F.array().cast(dict(lists.dtypes)["duplicate_candidates"])
    return (triaged_tickets.join(lists.withColumnRenamed("message_id", "ticket_id"), "ticket_id", "left")
            .withColumn("duplicate_candidates", F.coalesce("duplicate_candidates", none)))


def triage_full(spark: SparkSession, sf_dir: str, policies: DataFrame | None = None, k: int = 3, intent_model=None, query_model=None) -> DataFrame:
    """Full triage of every ticket: model scores where models are given (M5, M6),
    decision, verification, post-rules, clarification, duplicate candidates (V3),
    top-k policies (V5), grounded suggestion (V8), draft reply (V9) and agent
    handoff summary (V10).  Default knowledge base: ``benchmark``."""
    from ..operators import similar as S
    from ..session import read_table
    t = with_duplicates(S.materialise(triaged(spark, sf_dir, intent_model, query_model)))  # read by retrieval, V3 and the result
    if policies is None:
        b = read_table(spark, sf_dir, "benchmark")
        policies = b.select(F.col("item_id").alias("policy_idx"), F.format_string("B-%d", "item_id").alias("policy_id"),
                            F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    hits = S.search_policies(t.select(F.col("ticket_id").alias("query_id"), F.col("message").alias("text")),
                             policies, k=k)
    per = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "policy_id", "score", "content"))).alias("sources"))
    j = t.join(per.withColumnRenamed("query_id", "ticket_id"), on="ticket_id", how="left")
    d = F.col("decision")
    top = F.element_at(F.col("sources"), 1)
    sugg = S.suggest(d["escalate_to_human"], top["score"], top["content"], top["policy_id"])
    pids = F.transform(F.coalesce(F.col("sources"), F.array()), lambda s: s["policy_id"])
    handoff = S.handoff_summary(F.col("query_type"), F.col("pred_intent"), F.col("confidence"), d["priority"],
                                F.col("sentiment"), d["department"], F.col("entities"), F.col("verification_label"),
                                d["escalation_reasons"], pids)
    return j.select("*", sugg.alias("suggestion"), pids.alias("policy_ids"), handoff.alias("handoff")) \
        .withColumn("draft", S.draft_reply(F.col("suggestion"), F.col("policy_ids")))
