"""Priority, escalation, routing and clarification rules as column expressions.

Every rule is a ``when`` chain or boolean over native functions, so a whole
table of tickets is decided inside one whole-stage-codegen projection.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from .text import _c, department_for, normalize_text, pct

GROUPS = {
    "critical": V.CRITICAL_PATTERNS,
    "high": V.HIGH_PATTERNS,
    "human": V.HUMAN_PATTERNS,
    "vague": V.VAGUE_PATTERNS,
}


def group_regex(group: str, flags: str = "iU") -> str:
    """One alternation per group; each pattern keeps its own anchors."""
    return f"(?{flags})" + "|".join(f"(?:{p})" for p in GROUPS[group])


# R1 ---------------------------------------------------------------------------
def match_group(lower_text, group: str) -> Column:
    return _c(lower_text).rlike(group_regex(group))


def rule_text(text) -> Column:
    return F.lower(normalize_text(text))


# R4 ---------------------------------------------------------------------------
def low_confidence(confidence, query_confidence) -> Column:
    thr = F.lit(V.LOW_CONFIDENCE_THRESHOLD)
    q = _c(query_confidence)
    return (_c(confidence) < thr) & (q.isNull() | (q < thr))


# R2, R3, R5, R6 ---------------------------------------------------------------
FLAG_NAMES = ("crit", "high", "vague", "human", "low", "specialist", "negative")


def rule_flags(query_type, intent, confidence, sentiment, text, query_confidence) -> dict[str, Column]:
    """The seven boolean rule outcomes each decision field is built from."""
    t = rule_text(text)
    qt, it = _c(query_type), F.coalesce(_c(intent).cast("string"), F.lit(""))
    return {
        "crit": match_group(t, "critical"),
        "high": match_group(t, "high"),
        "vague": match_group(t, "vague"),
        "human": match_group(t, "human"),
        "low": low_confidence(confidence, query_confidence),
        "specialist": F.coalesce(qt.isin(*V.SPECIALIST_QUERY_TYPES), F.lit(False)) & ~it.isin(*V.ROUTINE_INTENTS),
        "negative": F.coalesce(_c(sentiment) == F.lit("negative"), F.lit(False)),
    }


def decide_from_flags(flags: dict[str, Column], query_type, intent, confidence) -> Column:
    """Triage decision struct from rule flags: priority, department,
    escalate_to_human, escalation_reasons (rule order), explanation (rule order)."""
    crit, high, vague, human = flags["crit"], flags["high"], flags["vague"], flags["human"]
    low, specialist, negative = flags["low"], flags["specialist"], flags["negative"]
    qt, it, conf = _c(query_type), F.coalesce(_c(intent).cast("string"), F.lit("")), _c(confidence)
    priority = (F.when(crit, "critical").when(high, "high").when(specialist, "medium")
                .when(negative, "medium").otherwise("low"))
    step = (F.when(crit, V.EXPLAIN_CRITICAL).when(high, V.EXPLAIN_HIGH).when(specialist, V.EXPLAIN_SPECIALIST)
            .when(negative, V.EXPLAIN_NEGATIVE).otherwise(V.EXPLAIN_LOW))
    head, tail = V.EXPLAIN_SELECTED.split("{intent}")
    mid, end = tail.split("{pct}")
    selected = F.concat(F.lit(head), it, F.lit(mid), pct(conf), F.lit(end))
    low_head, low_tail = V.REASON_LOW_CONF.split("{pct}")
    low_reason = F.concat(F.lit(low_head), pct(conf), F.lit(low_tail))
    reasons = F.array_compact(F.array(
        F.when(crit, F.lit(V.REASON_CRITICAL)),
        F.when(low, low_reason),
        F.when(vague, F.lit(V.REASON_VAGUE)),
        F.when(human, F.lit(V.REASON_HUMAN)),
    ))
    explanation = F.array_compact(F.array(
        selected, step,
        F.when(low, F.lit(V.EXPLAIN_LOW_CONF)),
        F.when(vague, F.lit(V.EXPLAIN_VAGUE)),
        F.when(human, F.lit(V.EXPLAIN_HUMAN)),
    ))
    escalate = crit | low | vague | human
    department = F.when(escalate, F.lit(V.HUMAN_QUEUE)).otherwise(department_for(qt))
    return F.struct(
        priority.alias("priority"),
        department.alias("department"),
        escalate.alias("escalate_to_human"),
        reasons.alias("escalation_reasons"),
        explanation.alias("explanation"),
    )


def decide(query_type, intent, confidence, sentiment, text, query_confidence) -> Column:
    """Single-expression form of the decision (use ``decide_from_flags`` on
    precomputed flag columns in table jobs)."""
    flags = rule_flags(query_type, intent, confidence, sentiment, text, query_confidence)
    return decide_from_flags(flags, query_type, intent, confidence)


# R7, R8 -----------------------------------------------------------------------
def escalate_if(decision, condition, reason: Column, explanation: str) -> Column:
    """Post-rule: when ``condition`` holds, escalate, reroute, append reason and explanation."""
    d, cond = _c(decision), F.coalesce(condition, F.lit(False))
    return F.struct(
        d["priority"].alias("priority"),
        F.when(cond, F.lit(V.HUMAN_QUEUE)).otherwise(d["department"]).alias("department"),
        (d["escalate_to_human"] | cond).alias("escalate_to_human"),
        F.when(cond, F.concat(d["escalation_reasons"], F.array(reason))).otherwise(d["escalation_reasons"])
        .alias("escalation_reasons"),
        F.when(cond, F.concat(d["explanation"], F.array(F.lit(explanation)))).otherwise(d["explanation"])
        .alias("explanation"),
    )


def escalate_unverified(decision, verification_status) -> Column:
    return escalate_if(decision, _c(verification_status) == F.lit(V.VERIFY_MISSING[0]),
                       F.lit(V.REASON_NOT_FOUND), V.EXPLAIN_NOT_FOUND)


def escalate_language(decision, language_code, language_name) -> Column:
    head, tail = V.REASON_LANGUAGE.split("{language}")
    reason = F.concat(F.lit(head), _c(language_name), F.lit(tail))
    # Never translated, so every non-English code escalates (unknown too).
    return escalate_if(decision, _c(language_code) != F.lit("en"), reason, V.EXPLAIN_LANGUAGE)


# R9 ---------------------------------------------------------------------------
def clarification(intent, entities, customer_text) -> Column:
    """First matching follow-up question, else null."""
    it, e = F.coalesce(_c(intent).cast("string"), F.lit("")), _c(entities)
    low = F.lower(F.coalesce(_c(customer_text), F.lit("")))
    no_delivery_ref = (F.size(e["order_ids"]) == 0) & (F.size(e["tracking_ids"]) == 0)
    no_payment_ref = (F.size(e["transaction_ids"]) == 0) & (F.size(e["card_references"]) == 0)
    any_context = F.lit(False)
    for w in V.TECHNICAL_CONTEXT_WORDS:
        any_context = any_context | low.contains(w)
    no_context = ~any_context
    return (F.when(it.isin(*V.DELIVERY_INTENTS_NEEDING_REF) & no_delivery_ref, F.lit(V.ASK_DELIVERY_REF))
            .when(it.isin(*V.PAYMENT_INTENTS_NEEDING_REF) & no_payment_ref, F.lit(V.ASK_PAYMENT_REF))
            .when(it.startswith("technical_") & no_context, F.lit(V.ASK_TECHNICAL)))
