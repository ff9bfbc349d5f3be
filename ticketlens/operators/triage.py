"""Ticket scoring and decision stages (the narrow part of the triage job).

All stages are projections: a table of any size is decided in one pass with
no shuffle.  Only verification (lookup.py) and retrieval (similar.py) join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import rules as R
from ..functions import text as X


def score(tickets: DataFrame, text: str = "message", intent: str = "pred_intent") -> DataFrame:
    """Adds query_type (derived from the intent unless a second model has given it),
    lexicon sentiment, entities (extracted once, Q18) and script language."""
    # Normalise once per row; entities and sentiment both read it.
    t = tickets.withColumn("_norm", X.normalize_text(F.col(text)))
    return t.select(
        *tickets.columns,
        *([] if "query_type" in tickets.columns else [X.query_type_for(F.col(intent)).alias("query_type")]),
        X.lexicon_score(F.col("_norm"), normalized=True).alias("sentiment_score"),
        X.extract_entities(F.col("_norm"), normalized=True).alias("entities"),
        X.script_language(F.col(text)).alias("language_code"),
    ).withColumn("sentiment", X.polarity(F.col("sentiment_score")))


def model_scored(tickets: DataFrame, intent_model=None, query_model=None, text: str = "message") -> DataFrame:
    """M5 and M6 on the messages: with an intent model its label, confidence and ranking replace ``pred_intent`` and
    ``confidence``; with a second model its label and confidence are ``query_type`` and ``query_confidence`` (without
    one the type follows the intent and the confidence is null)."""
    from . import model as ML
    if intent_model is None:
        return tickets
    own = tickets.drop("pred_intent", "confidence", "query_confidence").withColumn("text", X.normalize_text(F.col(text)))
    out = ML.score(intent_model, own).withColumnRenamed("predicted", "pred_intent")
    typed = ML.score_query_type(out.withColumnRenamed("confidence", "_c"), query_model).withColumnRenamed("_c", "confidence")
    return typed.withColumnRenamed("query_type_confidence", "query_confidence").drop("text")


def decide(scored: DataFrame, text: str = "message", intent: str = "pred_intent",
           confidence: str = "confidence", query_confidence: str = "query_confidence") -> DataFrame:
    """Adds the ``decision`` struct (R2-R6).  Rule flags are computed once per row
    as columns first, so every decision field reads them instead of re-running
    the pattern groups."""
    qc = F.col(query_confidence) if query_confidence in scored.columns else F.lit(None).cast("double")
    flags = R.rule_flags(F.col("query_type"), F.col(intent), F.col(confidence), F.col("sentiment"),
                         F.col(text), qc)
    with_flags = scored.select("*", *[c.alias(f"_f_{k}") for k, c in flags.items()])
    decision = R.decide_from_flags({k: F.col(f"_f_{k}") for k in flags}, F.col("query_type"), F.col(intent),
                                   F.col(confidence))
    return with_flags.withColumn("decision", decision).drop(*[f"_f_{k}" for k in flags])


def apply_post_rules(df: DataFrame) -> DataFrame:
    """R7 (unverified reference) then R8 (untranslated language)."""
    out = df
    if "verification_status" in df.columns:
        out = out.withColumn("decision", R.escalate_unverified(F.col("decision"), F.col("verification_status")))
    return (out.withColumn("language_name", X.language_name(F.col("language_code")))
            .withColumn("decision", R.escalate_language(F.col("decision"), F.col("language_code"),
                                                        F.col("language_name"))))


def flatten_decision(df: DataFrame, sep: str = " | ") -> DataFrame:
    d = F.col("decision")
    return df.select(
        "*",
        d["priority"].alias("priority"),
        d["department"].alias("department"),
        d["escalate_to_human"].alias("escalate_to_human"),
        F.array_join(d["escalation_reasons"], sep).alias("escalation_reasons"),
        F.array_join(d["explanation"], sep).alias("explanation"),
    ).drop("decision")


def entity_strings(df: DataFrame, col: str = "entities", sep: str = ",") -> list:
    return [F.array_join(F.col(col)[f], sep).alias(f) for f in V.ENTITY_FIELDS]
