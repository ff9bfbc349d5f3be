"""DuckDB SQL mirrors of the fixtures and column operators (the correctness oracle).

Built from the same fixed values as the Spark side.  RE2 has no look-around
and ASCII-only ``\\b \\w \\d``; where a pattern needs them the SQL emulates
them (context captured and put back, Unicode classes spelled out).
"""
from __future__ import annotations

from .. import vocab as V
from ..functions.text import WS_CLASS

T = len(V.TICKET_TEMPLATES)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def sql_map_case(expr: str, mapping: dict, default: str | None) -> str:
    whens = " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {whens} ELSE {q(default) if default is not None else 'NULL'} END)"


def normalize(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), {q(WS_CLASS + '+')}, ' ', 'g'))"


def pct(x: str) -> str:
    return f"(CAST(CAST(round_even(({x}) * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || '%')"


def query_type_for(intent: str) -> str:
    key = f"lower(trim(coalesce(CAST({intent} AS VARCHAR), 'None')))"
    return sql_map_case(key, V.INTENT_TO_QUERY_TYPE, "other")


def department_for(qt: str) -> str:
    return sql_map_case(qt, V.DEPARTMENTS, V.DEFAULT_DEPARTMENT)


def language_name(code: str) -> str:
    return sql_map_case(code, V.LANGUAGE_NAMES, V.UNKNOWN_LANGUAGE)


def group_regex(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def extract_all(x: str, pattern: str, group: int, flags: str = "") -> str:
    return f"regexp_extract_all({x}, {q(('(?' + flags + ')' if flags else '') + pattern)}, {group})"


def order_ids(x: str) -> str:
    """Order ids without the look-ahead: extract, then drop the excluded prefixes."""
    pat = V.ORDER_ID_PATTERN.replace("(?!(?:TXN|REF|TRACK)-?)", "")
    return f"list_filter({extract_all(x, pat, 1, 'i')}, lambda z: NOT regexp_matches(z, '^(?i)(TXN|REF|TRACK)'))"


def entity_exprs(x: str) -> dict[str, str]:
    return {
        "order_ids": order_ids(x),
        "tracking_ids": extract_all(x, V.TRACKING_ID_PATTERN, 1, "i"),
        "transaction_ids": extract_all(x, V.TRANSACTION_ID_PATTERN, 1, "i"),
        "card_references": extract_all(x, V.CARD_REF_PATTERN, 1, "i"),
        "amounts": extract_all(x, V.AMOUNT_PATTERN, 0),
        "dates": extract_all(x, V.DATE_PATTERN, 0, "i"),
    }


W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def mask_steps(x: str) -> list[tuple[str, str]]:
    """(rule name, expression after the rule) for the four masking rules."""
    email = V.EMAIL_PATTERN.replace(r"\w", r"\p{L}\p{N}_")
    s1 = f"regexp_replace({normalize(x)}, {q(email)}, {q(V.EMAIL_MARK)}, 'g')"
    acct = V.ACCOUNT_PATTERN
    s2 = f"regexp_replace({s1}, {q('(?i)' + acct)}, {q(V.ACCOUNT_MARK)}, 'g')"
    longnum = r"(^|[^0-9])((?:[0-9][ -]?){11,18}[0-9])([^0-9]|$)"
    r3 = f"'\\1{V.LONG_NUMBER_MARK}\\3'"
    s3 = f"regexp_replace(regexp_replace({s2}, {q(longnum)}, {r3}, 'g'), {q(longnum)}, {r3}, 'g')"
    phone = rf"(^|{NW})((?:\+?[0-9]{{1,3}}[ .-]?)?(?:\(?[0-9]{{2,4}}\)?[ .-]?){{2,4}}[0-9]{{3,4}})({NW}|$)"
    r4 = f"'\\1{V.PHONE_MARK}\\3'"
    s4 = f"regexp_replace(regexp_replace({s3}, {q(phone)}, {r4}, 'g'), {q(phone)}, {r4}, 'g')"
    return [("email", s1), ("account", s2), ("long_number", s3), ("phone", s4)]


def mask_sensitive(x: str) -> str:
    return mask_steps(x)[-1][1]


def script_language(x: str) -> str:
    t = f"coalesce({x}, '')"
    lo, hi, code = V.DEVANAGARI
    parts = [f"WHEN regexp_matches({t}, '[\\x{{{lo:X}}}-\\x{{{hi:X}}}]') THEN {q(code)}"]
    for lo, hi, code in V.SCRIPT_RANGES:
        parts.append(f"WHEN regexp_matches({t}, '[\\x{{{lo:X}}}-\\x{{{hi:X}}}]') THEN {q(code)}")
    parts.append(f"WHEN NOT regexp_matches({t}, '[^\\x{{0}}-\\x{{7F}}]') THEN 'en'")
    return "(CASE " + " ".join(parts) + " ELSE 'unknown' END)"


def lexicon_score(x: str) -> str:
    toks = f"list_distinct(list_filter(string_split(lower({normalize(x)}), ' '), lambda z: z <> ''))"
    pos = f"len(list_intersect({toks}, {sql_list(V.POSITIVE_WORDS)}))"
    neg = f"len(list_intersect({toks}, {sql_list(V.NEGATIVE_WORDS)}))"
    raw = f"(0.2::DOUBLE * CAST({pos} AS DOUBLE) - 0.2::DOUBLE * CAST({neg} AS DOUBLE))"
    return f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {raw}))"


def polarity(s: str) -> str:
    return f"(CASE WHEN {s} >= 0.2::DOUBLE THEN 'positive' WHEN {s} <= -0.2::DOUBLE THEN 'negative' ELSE 'neutral' END)"


# ---------------------------------------------------------------------------
# Rendered tickets and derived tables as CTEs.
# ---------------------------------------------------------------------------
def tickets_cte() -> str:
    intents = [i for i, _ in V.TICKET_TEMPLATES]
    texts = [t for _, t in V.TICKET_TEMPLATES]
    nxt = intents[1:] + intents[:1]
    slots = {
        "order": "printf('ORD-%06d', order_key)",
        "tracking": "printf('TRK-%06d', order_key)",
        "txn": "printf('TXN-%06d', order_key)",
        "digits": "printf('%06d', order_key)",
        "amount": "printf('$%d.%02d', ticket_id % 500, ticket_id % 100)",
        "card": "printf('%04d', (ticket_id * 7) % 10000)",
        "phone": "printf('+1 415 %03d %04d', (ticket_id * 13) % 1000, (ticket_id * 17) % 10000)",
        "email": "printf('buyer.%d@example.com', customer_id)",
        "date": "printf('%02d/%02d/2024', (ticket_id % 28) + 1, (ticket_id % 12) + 1)",
    }
    msg = f"list_extract({sql_list(texts)}, CAST(template_id + 1 AS INTEGER))"
    for name in ("order", "tracking", "txn", "digits", "amount", "card", "phone", "email", "date"):
        msg = f"replace({msg}, {q('{' + name + '}')}, {slots[name]})"
    true_intent = f"list_extract({sql_list(intents)}, CAST(template_id + 1 AS INTEGER))"
    next_intent = f"list_extract({sql_list(nxt)}, CAST(template_id + 1 AS INTEGER))"
    return f"""tickets AS (
  SELECT ticket_id, created_at, customer_id, template_id, order_key,
         {msg} AS message,
         {true_intent} AS true_intent,
         CASE WHEN ticket_id % 7 = 0 THEN {next_intent} ELSE {true_intent} END AS pred_intent,
         CAST((ticket_id * 37) % 101 AS DOUBLE) / 100.0::DOUBLE AS confidence,
         CASE WHEN ticket_id % 5 = 0 THEN NULL ELSE CAST((ticket_id * 53) % 101 AS DOUBLE) / 100.0::DOUBLE END AS query_confidence,
         {sql_map_case('event_type', V.EVENT_STATUS, 'open')} AS status
  FROM (SELECT event_id AS ticket_id, ts AS created_at, user_id AS customer_id, event_id % {T} AS template_id,
               (event_id * 31) % ((SELECT count(*) FROM orders) * 11 // 10) AS order_key, event_type
        FROM events) b
)"""


def records_cte() -> str:
    return f"""records AS (
  SELECT o_orderkey AS order_key,
         printf('ORD-%06d', o_orderkey) AS reference,
         CASE WHEN o_orderkey % 3 <> 2 THEN printf('TRK-%06d', o_orderkey) END AS tracking_reference,
         printf('TXN-%06d', o_orderkey) AS transaction_reference,
         {sql_map_case('o_orderstatus', V.ORDER_STATUS_NAMES, 'unknown')} AS order_status,
         {sql_map_case('o_orderstatus', V.TRANSACTION_STATUS_NAMES, 'unknown')} AS transaction_status
  FROM orders
)"""


def updates_cte() -> str:
    return f"""updates_raw AS (
  SELECT ticket_id * 2 AS update_id, ticket_id,
         created_at + to_minutes(CAST((ticket_id % 47) + 1 AS BIGINT)) AS updated_at,
         list_extract(['in_progress', 'resolved', 'open'], CAST(((ticket_id // 3) % 3) + 1 AS INTEGER)) AS status,
         CASE WHEN ticket_id % 4 <> 0 THEN true_intent END AS final_intent,
         CASE WHEN ticket_id % 9 <> 0 THEN printf('Outcome noted for ticket %d', ticket_id) END AS outcome,
         printf('agent%d', ticket_id % 5) AS reviewer,
         CASE WHEN ticket_id % 2 <> 0 THEN printf('We looked into ticket %d.', ticket_id) END AS reply
  FROM tickets WHERE ticket_id % 3 = 0
  UNION ALL
  SELECT ticket_id * 2 + 1, ticket_id,
         created_at + to_minutes(180),
         CASE WHEN (ticket_id // 6) % 2 = 0 THEN 'open' ELSE 'resolved' END,
         CASE WHEN ticket_id % 12 <> 0 THEN pred_intent END,
         CASE WHEN ticket_id % 4 <> 0 THEN printf('Follow-up for ticket %d', ticket_id) END,
         printf('agent%d', (ticket_id + 1) % 5),
         CASE WHEN ticket_id % 18 <> 0 THEN printf('Your case %d was reviewed again.', ticket_id) END
  FROM tickets WHERE ticket_id % 6 = 0
),
updates AS (
  SELECT *, CASE WHEN final_intent IS NOT NULL THEN {query_type_for('final_intent')} END AS final_query_type
  FROM updates_raw
)"""


def decide_sql(qt: str, intent: str, conf: str, sent: str, text: str, qconf: str) -> dict[str, str]:
    """SQL for the decision fields; reasons / explanation as ' | '-joined strings."""
    t = f"lower({normalize(text)})"
    crit = f"regexp_matches({t}, {q(group_regex(V.CRITICAL_PATTERNS))})"
    high = f"regexp_matches({t}, {q(group_regex(V.HIGH_PATTERNS))})"
    vague = f"regexp_matches({t}, {q(group_regex(V.VAGUE_PATTERNS))})"
    human = f"regexp_matches({t}, {q(group_regex(V.HUMAN_PATTERNS))})"
    it = f"coalesce(CAST({intent} AS VARCHAR), '')"
    spec = (f"(coalesce({qt} IN ({', '.join(q(x) for x in V.SPECIALIST_QUERY_TYPES)}), false) "
            f"AND {it} NOT IN ({', '.join(q(x) for x in V.ROUTINE_INTENTS)}))")
    neg = f"coalesce({sent} = 'negative', false)"
    low = f"({conf} < 0.45::DOUBLE AND ({qconf} IS NULL OR {qconf} < 0.45::DOUBLE))"
    head, tail = V.EXPLAIN_SELECTED.split("{intent}")
    mid, end = tail.split("{pct}")
    lh, lt = V.REASON_LOW_CONF.split("{pct}")
    escalate = f"({crit} OR {low} OR {vague} OR {human})"
    return {
        "crit": crit, "high": high, "vague": vague, "human": human, "low": low, "escalate": escalate,
        "priority": (f"(CASE WHEN {crit} THEN 'critical' WHEN {high} THEN 'high' WHEN {spec} THEN 'medium' "
                     f"WHEN {neg} THEN 'medium' ELSE 'low' END)"),
        "department": f"(CASE WHEN {escalate} THEN {q(V.HUMAN_QUEUE)} ELSE {department_for(qt)} END)",
        "reasons": (f"concat_ws(' | ', CASE WHEN {crit} THEN {q(V.REASON_CRITICAL)} END, "
                    f"CASE WHEN {low} THEN {q(lh)} || {pct(conf)} || {q(lt)} END, "
                    f"CASE WHEN {vague} THEN {q(V.REASON_VAGUE)} END, "
                    f"CASE WHEN {human} THEN {q(V.REASON_HUMAN)} END)"),
        "explanation": (f"concat_ws(' | ', {q(head)} || {it} || {q(mid)} || {pct(conf)} || {q(end)}, "
                        f"CASE WHEN {crit} THEN {q(V.EXPLAIN_CRITICAL)} WHEN {high} THEN {q(V.EXPLAIN_HIGH)} "
                        f"WHEN {spec} THEN {q(V.EXPLAIN_SPECIALIST)} WHEN {neg} THEN {q(V.EXPLAIN_NEGATIVE)} "
                        f"ELSE {q(V.EXPLAIN_LOW)} END, "
                        f"CASE WHEN {low} THEN {q(V.EXPLAIN_LOW_CONF)} END, "
                        f"CASE WHEN {vague} THEN {q(V.EXPLAIN_VAGUE)} END, "
                        f"CASE WHEN {human} THEN {q(V.EXPLAIN_HUMAN)} END)"),
    }


def scored_cte() -> str:
    """Tickets with intent, query type, sentiment and entities (the first half of J1)."""
    ents = entity_exprs("norm")
    return f"""scored AS (
  SELECT t.*, {query_type_for('pred_intent')} AS query_type,
         {lexicon_score('message')} AS sentiment_score,
         {polarity(lexicon_score('message'))} AS sentiment,
         {ents['order_ids']} AS order_ids, {ents['tracking_ids']} AS tracking_ids,
         {ents['transaction_ids']} AS transaction_ids, {ents['card_references']} AS card_references,
         {ents['amounts']} AS amounts, {ents['dates']} AS dates,
         {script_language('message')} AS language_code
  FROM (SELECT *, {normalize('message')} AS norm FROM tickets) t
)"""


def decided_cte() -> str:
    d = decide_sql("query_type", "pred_intent", "confidence", "sentiment", "message", "query_confidence")
    return f"""decided AS (
  SELECT s.*, {d['priority']} AS priority, {d['department']} AS department, {d['escalate']} AS escalate_to_human,
         {d['reasons']} AS escalation_reasons, {d['explanation']} AS explanation
  FROM scored s
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def refs_cte() -> str:
    """One row per extracted reference, orders then tracking then transactions."""
    def tag(kind, field):
        return f"list_transform({field}, lambda z: {{'ref_type': {q(kind)}, 'raw': z}})"
    arr = f"list_concat(list_concat({tag('order', 'order_ids')}, {tag('tracking', 'tracking_ids')}), " \
          f"{tag('transaction', 'transaction_ids')})"
    return f"""refs AS (
  SELECT ticket_id, ref_seq, r.ref_type AS ref_type, upper(replace(coalesce(r.raw, ''), ' ', '')) AS ref_key
  FROM (SELECT ticket_id, unnest(l) AS r, generate_subscripts(l, 1) - 1 AS ref_seq
        FROM (SELECT ticket_id, {arr} AS l FROM scored) a) b
),
idx AS (
  SELECT 'order' AS ref_type, upper(replace(reference, ' ', '')) AS ref_key, order_status AS record_status FROM records
  UNION ALL
  SELECT 'tracking', upper(replace(tracking_reference, ' ', '')), order_status FROM records WHERE tracking_reference IS NOT NULL
  UNION ALL
  SELECT 'transaction', upper(replace(transaction_reference, ' ', '')), transaction_status FROM records
),
checked AS (
  SELECT r.*, i.record_status, i.ref_key IS NOT NULL AS found
  FROM refs r LEFT JOIN idx i ON r.ref_type = i.ref_type AND r.ref_key = i.ref_key
),
rollup AS (
  SELECT ticket_id, count(*) AS n_checked, count_if(NOT found) AS n_missing,
         string_agg(ref_type || ':' || ref_key || ':' || CAST(found AS VARCHAR) || ':' || coalesce(record_status, '-'),
                    '|' ORDER BY ref_seq) AS checked_references
  FROM checked GROUP BY ticket_id
)"""


def verified_cte() -> str:
    """decided + verification (D2) + post-rules R7, R8 -> final decision fields."""
    st = lambda i: (f"(CASE WHEN coalesce(v.n_checked, 0) = 0 THEN {q(V.VERIFY_NONE[i]) if isinstance(V.VERIFY_NONE[i], str) else str(V.VERIFY_NONE[i]).lower()} "  # noqa: E731
                    f"WHEN coalesce(v.n_missing, 0) > 0 THEN {q(V.VERIFY_MISSING[i]) if isinstance(V.VERIFY_MISSING[i], str) else str(V.VERIFY_MISSING[i]).lower()} "
                    f"ELSE {q(V.VERIFY_FOUND[i]) if isinstance(V.VERIFY_FOUND[i], str) else str(V.VERIFY_FOUND[i]).lower()} END)")
    lh, lt = V.REASON_LANGUAGE.split("{language}")
    return f"""verified AS (
  SELECT d.*, {st(0)} AS verification_status, {st(1)} AS verification_label, {st(2)} AS verification_summary,
         {st(3)} AS requires_manual_verification,
         CAST(coalesce(v.n_checked, 0) AS BIGINT) AS n_checked, CAST(coalesce(v.n_missing, 0) AS BIGINT) AS n_missing,
         coalesce(v.checked_references, '') AS checked_references,
         {language_name('d.language_code')} AS language_name
  FROM decided d LEFT JOIN rollup v ON d.ticket_id = v.ticket_id
),
final AS (
  SELECT * REPLACE (
           (escalate_to_human OR verification_status = 'reference_not_found' OR language_code <> 'en') AS escalate_to_human,
           CASE WHEN escalate_to_human OR verification_status = 'reference_not_found' OR language_code <> 'en'
                THEN {q(V.HUMAN_QUEUE)} ELSE department END AS department,
           concat_ws(' | ', nullif(escalation_reasons, ''),
                     CASE WHEN verification_status = 'reference_not_found' THEN {q(V.REASON_NOT_FOUND)} END,
                     CASE WHEN language_code <> 'en' THEN {q(lh)} || language_name || {q(lt)} END) AS escalation_reasons,
           concat_ws(' | ', explanation,
                     CASE WHEN verification_status = 'reference_not_found' THEN {q(V.EXPLAIN_NOT_FOUND)} END,
                     CASE WHEN language_code <> 'en' THEN {q(V.EXPLAIN_LANGUAGE)} END) AS explanation)
  FROM verified
)"""


def lifecycle_ctes() -> str:
    msg = sql_map_case("status", V.STATUS_EVENT_MESSAGES, None)
    return f"""last_update AS (
  SELECT ticket_id, status AS u_status, outcome AS u_outcome, reply AS u_reply, n_updates
  FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY updated_at DESC, update_id DESC) AS rn,
               count(*) OVER (PARTITION BY ticket_id) AS n_updates FROM updates) u
  WHERE rn = 1
),
store AS (
  SELECT f.* REPLACE (coalesce(l.u_status, f.status) AS status),
         CASE WHEN l.ticket_id IS NOT NULL THEN l.u_outcome END AS agent_outcome,
         l.u_reply AS agent_reply,
         CAST(coalesce(l.n_updates, 0) AS BIGINT) AS n_updates
  FROM final f LEFT JOIN last_update l ON f.ticket_id = l.ticket_id
),
qualifying AS (
  SELECT * FROM updates
  WHERE coalesce(length(final_query_type) > 0, false) OR coalesce(length(final_intent) > 0, false)
        OR coalesce(length(outcome) > 0, false)
),
reviews AS (
  SELECT ticket_id, reviewer, final_query_type, final_intent, outcome AS notes, first_at AS reviewed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY updated_at DESC, update_id DESC) AS rn,
               min(updated_at) OVER (PARTITION BY ticket_id) AS first_at FROM qualifying) q
  WHERE rn = 1
),
events_log AS (
  SELECT ticket_id * 4 AS event_id, ticket_id, {q(V.RECEIVED_STATUS)} AS status,
         {q(V.STATUS_EVENT_MESSAGES[V.RECEIVED_STATUS])} AS message, created_at
  FROM tickets
  UNION ALL
  SELECT update_id * 2 + 1, ticket_id, status, {msg}, updated_at FROM updates
)"""


def full_ctes() -> str:
    return with_ctes(tickets_cte(), records_cte(), scored_cte(), decided_cte(), refs_cte(), verified_cte(),
                     updates_cte(), lifecycle_ctes())


def ts_text(x: str) -> str:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss.SSSSSS' text (same on both sides)."""
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


# ---------------------------------------------------------------------------
# TF-IDF in SQL (brute-force oracle: plain inverted join, no prefix filter).
# ---------------------------------------------------------------------------
def terms_sql(text: str) -> str:
    """List of 1- and 2-gram terms, same tokens and stop list as the Spark side."""
    stop = sql_list(V.default_stop_words())
    toks = (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), "
            f"lambda z: NOT list_contains({stop}, z))")
    return (f"(SELECT list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) "
            f"FROM (SELECT {toks} AS tk))")


def term_counts_cte(name: str, src: str, id_col: str, text: str) -> str:
    return f"""{name} AS (
  SELECT {id_col}, term, count(*) AS tf FROM (
    SELECT {id_col}, unnest(trm) AS term FROM (SELECT {id_col}, {terms_sql(text)} AS trm FROM {src}) a) b
  GROUP BY {id_col}, term
)"""
