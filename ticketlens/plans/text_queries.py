"""Registered text, rule and flagship queries (B, R families) with DuckDB oracles.  Columns are aliased alike on both
sides; doubles are rounded to 6 dp, arrays are returned as joined strings."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as X
from ..functions import rules as R
from ..operators import triage
from ..session import read_table
from . import fixtures as fx
from . import oracle as O
from .registry import register

def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.decide(triage.score(fx.tickets(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Flagship: B1, B8, R1-R6, A2 -> counts per priority / department / escalation.
# ---------------------------------------------------------------------------
@register("triage_summary", O.with_ctes(O.tickets_cte(), O.scored_cte(), O.decided_cte()) + """
SELECT priority, department, escalate_to_human, CAST(count(*) AS BIGINT) AS n_tickets
FROM decided GROUP BY priority, department, escalate_to_human""")
def triage_summary(spark, sf_dir):
    d = triage.flatten_decision(decided(spark, sf_dir))
    return d.groupBy("priority", "department", "escalate_to_human").agg(F.count(F.lit(1)).alias("n_tickets"))


@register("ticket_decisions", O.with_ctes(O.tickets_cte(), O.scored_cte(), O.decided_cte()) + """
SELECT ticket_id, query_type, sentiment, round(sentiment_score, 6) AS sentiment_score, priority, department,
       escalate_to_human, escalation_reasons, explanation
FROM decided""")
def ticket_decisions(spark, sf_dir):
    d = triage.flatten_decision(decided(spark, sf_dir))
    return d.select("ticket_id", "query_type", "sentiment", F.round("sentiment_score", 6).alias("sentiment_score"),
                    "priority", "department", "escalate_to_human", "escalation_reasons", "explanation")


# B2-B8 ------------------------------------------------------------------------
def _entities_sql(src: str, id_col: str, text: str) -> str:
    e = O.entity_exprs(O.normalize(text))
    cols = ", ".join(f"array_to_string({e[f]}, ',') AS {f}" for f in V.ENTITY_FIELDS)
    return f"SELECT {id_col}, {cols} FROM {src}"


@register("ticket_entities", O.with_ctes(O.tickets_cte()) + _entities_sql("tickets", "ticket_id", "message"))
def ticket_entities(spark, sf_dir):
    t = fx.tickets(spark, sf_dir).select("ticket_id", X.extract_entities(F.col("message")).alias("entities"))
    return t.select("ticket_id", *triage.entity_strings(t))


# B9, B10 ----------------------------------------------------------------------
def _masked_entities_sql() -> str:
    e = O.entity_exprs(O.normalize("message"))
    parts = []
    for f in V.ENTITY_FIELDS:
        if f in V.MASKED_ENTITY_FIELDS:
            expr = (f"list_transform({e[f]}, lambda z: CASE WHEN length(z) > 4 THEN '***' || right(z, 4) "
                    f"ELSE {O.q(V.REDACTED)} END)")
        else:
            expr = e[f]
        parts.append(f"array_to_string({expr}, ',') AS masked_{f}")
    return ", ".join(parts)


@register("ticket_masking", O.with_ctes(O.tickets_cte()) +
          f"SELECT ticket_id, {O.mask_sensitive('message')} AS masked_message, {_masked_entities_sql()} FROM tickets")
def ticket_masking(spark, sf_dir):
    t = fx.tickets(spark, sf_dir)
    m = X.mask_entities(X.extract_entities(F.col("message")))
    t = t.select("ticket_id", X.mask_sensitive(F.col("message")).alias("masked_message"), m.alias("m"))
    return t.select("ticket_id", "masked_message",
                    *[F.array_join(F.col("m")[f], ",").alias(f"masked_{f}") for f in V.ENTITY_FIELDS])


@register("document_masking", f"SELECT doc_id, {O.mask_sensitive('text')} AS masked_text FROM documents")
def document_masking(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.mask_sensitive(F.col("text")).alias("masked_text"))


def _mask_report_sql() -> str:
    steps = O.mask_steps("text")
    prev = O.normalize("text")
    counts = []
    marks = {"email": V.EMAIL_MARK, "account": V.ACCOUNT_MARK, "long_number": V.LONG_NUMBER_MARK,
             "phone": V.PHONE_MARK}
    for name, after in steps:
        # hits = markers added by the rule (marker counts before vs after; markers contain no digits/@).
        mark = marks[name]
        cnt_after = f"(length({after}) - length(replace({after}, {O.q(mark)}, ''))) // {len(mark)}"
        cnt_before = f"(length({prev}) - length(replace({prev}, {O.q(mark)}, ''))) // {len(mark)}"
        counts.append((name, f"({cnt_after} - {cnt_before})"))
        prev = after
    sel = ", ".join(f"{c} AS {n}_hits" for n, c in counts)
    agg = ", ".join(f"CAST(sum(CASE WHEN {n}_hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS {n}_rows, "
                    f"CAST(sum({n}_hits) AS BIGINT) AS {n}_hits" for n, _ in counts)
    return f"SELECT CAST(count(*) AS BIGINT) AS n_docs, {agg} FROM (SELECT {sel} FROM documents) h"


@register("mask_report", _mask_report_sql())
def mask_report(spark, sf_dir):
    """Rows and hits per masking rule over the whole documents table."""
    d = read_table(spark, sf_dir, "documents").select(*X.mask_rule_hits(F.col("text")))
    aggs = [F.count(F.lit(1)).alias("n_docs")]
    for name, *_ in X.MASK_RULES:
        h = F.col(f"{name}_hits")
        aggs += [F.count_if(h > 0).alias(f"{name}_rows"), F.sum(h).cast("bigint").alias(f"{name}_hits")]
    return d.agg(*aggs)


# B1 ---------------------------------------------------------------------------
@register("normalized_documents", f"""
SELECT doc_id, md5({O.normalize('text')}) AS norm_md5, CAST(length({O.normalize('text')}) AS BIGINT) AS norm_chars
FROM documents""")
def normalized_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    n = X.normalize_text(F.col("text"))
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("norm_chars"))


# B13, B15 ---------------------------------------------------------------------
@register("language_by_script", f"""
SELECT 'documents' AS source, doc_id AS row_id, {O.script_language('text')} AS language_code,
       {O.language_name(O.script_language('text'))} AS language_name FROM documents
UNION ALL
SELECT 'conversations', conv_id * 1000 + turn, {O.script_language('text')},
       {O.language_name(O.script_language('text'))} FROM conversations""")
def language_by_script(spark, sf_dir):
    def one(df, src, rid):
        code = X.script_language(F.col("text"))
        return df.select(F.lit(src).alias("source"), rid.alias("row_id"), code.alias("language_code"),
                         X.language_name(code).alias("language_name"))
    d = read_table(spark, sf_dir, "documents")
    c = read_table(spark, sf_dir, "conversations")
    return one(d, "documents", F.col("doc_id")).unionByName(
        one(c, "conversations", F.col("conv_id") * 1000 + F.col("turn")))


# B19, B21 ---------------------------------------------------------------------
@register("lexicon_sentiment", O.with_ctes(O.tickets_cte()) + f"""
SELECT conv_id, turn, round({O.lexicon_score('text')}, 6) AS sentiment_score,
       {O.polarity(O.lexicon_score('text'))} AS sentiment FROM conversations
UNION ALL
SELECT -1 - ticket_id, 0, round({O.lexicon_score('message')}, 6), {O.polarity(O.lexicon_score('message'))}
FROM tickets""")
def lexicon_sentiment(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text"))
    t = fx.tickets(spark, sf_dir).select((F.lit(-1) - F.col("ticket_id")).alias("conv_id"),
                                         F.lit(0).cast("long").alias("turn"), F.col("message").alias("text"))
    s = c.unionByName(t).withColumn("score", X.lexicon_score(F.col("text")))
    return s.select("conv_id", "turn", F.round("score", 6).alias("sentiment_score"),
                    X.polarity(F.col("score")).alias("sentiment"))


# B16-B18, D7 ------------------------------------------------------------------
@register("intent_dimensions", O.with_ctes(O.tickets_cte()) + f"""
SELECT pred_intent AS intent, {O.query_type_for('pred_intent')} AS query_type,
       list_reduce(list_transform(string_split(replace(pred_intent, '_', ' '), ' '),
                   lambda w: upper(left(w, 1)) || lower(substr(w, 2))), lambda a, b: a || ' ' || b) AS intent_label,
       {O.department_for(O.query_type_for('pred_intent'))} AS department,
       CAST(count(*) AS BIGINT) AS n_tickets
FROM tickets GROUP BY pred_intent""")
def intent_dimensions(spark, sf_dir):
    t = fx.tickets(spark, sf_dir)
    g = t.groupBy(F.col("pred_intent").alias("intent")).agg(F.count(F.lit(1)).alias("n_tickets"))
    qt = X.query_type_for(F.col("intent"))
    return g.select("intent", qt.alias("query_type"), X.display_label(F.col("intent")).alias("intent_label"),
                    X.department_for(qt).alias("department"), "n_tickets")


# B22 --------------------------------------------------------------------------
@register("confidence_percent", O.with_ctes(O.tickets_cte()) + f"""
SELECT ticket_id, {O.pct('confidence')} AS confidence_pct,
       CASE WHEN query_confidence IS NULL THEN NULL ELSE {O.pct('query_confidence')} END AS query_confidence_pct
FROM tickets""")
def confidence_percent(spark, sf_dir):
    t = fx.tickets(spark, sf_dir)
    return t.select("ticket_id", X.pct(F.col("confidence")).alias("confidence_pct"),
                    X.pct(F.col("query_confidence")).alias("query_confidence_pct"))


# R1 ---------------------------------------------------------------------------
@register("rule_group_flags", O.with_ctes(O.tickets_cte()) + f"""
SELECT template_id,
       CAST(count(*) AS BIGINT) AS n_tickets,
       CAST(count_if(regexp_matches(lower({O.normalize('message')}), {O.q(O.group_regex(V.CRITICAL_PATTERNS))})) AS BIGINT) AS critical,
       CAST(count_if(regexp_matches(lower({O.normalize('message')}), {O.q(O.group_regex(V.HIGH_PATTERNS))})) AS BIGINT) AS high,
       CAST(count_if(regexp_matches(lower({O.normalize('message')}), {O.q(O.group_regex(V.HUMAN_PATTERNS))})) AS BIGINT) AS human,
       CAST(count_if(regexp_matches(lower({O.normalize('message')}), {O.q(O.group_regex(V.VAGUE_PATTERNS))})) AS BIGINT) AS vague
FROM tickets GROUP BY template_id""")
def rule_group_flags(spark, sf_dir):
    t = fx.tickets(spark, sf_dir).select("template_id", R.rule_text(F.col("message")).alias("t"))
    return t.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n_tickets"),
        *[F.count_if(R.match_group(F.col("t"), g)).alias(g) for g in ("critical", "high", "human", "vague")])


# R12 --------------------------------------------------------------------------
@register("rule_report", O.with_ctes(O.tickets_cte(), O.scored_cte(), O.decided_cte()) + """
SELECT reason, CAST(count(*) AS BIGINT) AS n_tickets
FROM (SELECT unnest(string_split(escalation_reasons, ' | ')) AS reason FROM decided WHERE escalation_reasons <> '') r
GROUP BY reason
UNION ALL
SELECT 'priority:' || priority, CAST(count(*) AS BIGINT) FROM decided GROUP BY priority""")
def rule_report(spark, sf_dir):
    d = decided(spark, sf_dir).select("decision")
    reasons = d.select(F.explode(F.col("decision.escalation_reasons")).alias("reason"))
    pri = d.select(F.concat(F.lit("priority:"), F.col("decision.priority")).alias("reason"))
    return reasons.unionByName(pri).groupBy("reason").agg(F.count(F.lit(1)).alias("n_tickets"))
