"""Registered queries on language, valence sentiment, the public corpus and the public view."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import language, ops, sentiment
from ..session import read_table
from ..sources import io
from . import fixtures as fx
from . import oracle as O
from . import similar_queries
from .registry import register

# Toy valences for the check; a caller brings a real lexicon table.
TOY_LEXICON = {**{w: 1.9 for w in V.POSITIVE_WORDS}, **{w: -1.7 for w in V.NEGATIVE_WORDS}}


# B14 --------------------------------------------------------------------------
@register("language_identification", f"""
WITH t AS (SELECT doc_id, lang, text, doc_id % 5 = 0 AS held_out FROM documents),
w AS (SELECT doc_id, lang, held_out, ' ' || unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}]+')) || ' ' AS w FROM t),
g AS (SELECT doc_id, lang, held_out, unnest([substr(w, i, 3) for i in range(1, length(w) - 1)]) AS gram FROM w WHERE length(w) > 2),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, gram),
z AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM c) AS d FROM c GROUP BY lang),
p AS (SELECT lang, gram, CAST(round(ln((n + 1.0::DOUBLE) / (total + d)) * {language.UNIT}) AS BIGINT) AS w FROM c JOIN z USING (lang)),
u AS (SELECT lang, CAST(round(ln(1.0::DOUBLE / (total + d)) * {language.UNIT}) AS BIGINT) AS u FROM z),
q AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY doc_id, gram),
s AS (SELECT q.doc_id, u.lang, sum(q.k * coalesce(p.w, u.u)) AS score, sum(q.k) AS n
      FROM q CROSS JOIN u LEFT JOIN p ON p.gram = q.gram AND p.lang = u.lang GROUP BY q.doc_id, u.lang),
r AS (SELECT doc_id, lang, CAST(floor((score - lead(score) OVER o) / n) AS BIGINT) AS lead, row_number() OVER o AS r
      FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, lang))
SELECT t.doc_id, t.lang, t.held_out, CASE WHEN coalesce(lead >= {language.MARGIN}, r.lang IS NOT NULL) THEN r.lang ELSE {O.script_language('t.text')} END AS language_code,
       lead AS language_lead
FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND r.r = 1""")
def language_identification(spark, sf_dir):
    """Learned from four fifths of the documents; the rest is held out."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    found = language.detect(d, language.fit(d.where("not held_out")), "doc_id")
    return d.select("doc_id", "lang", "held_out").join(found, on="doc_id")


# B20, B21 ---------------------------------------------------------------------
def _lexicon(spark):
    return spark.createDataFrame(list(TOY_LEXICON.items()), "term string, valence double")


def _valence_sql() -> str:
    m = sentiment
    dbl = lambda x: f"CAST({x} AS DOUBLE)"
    toward = lambda by: f"(CASE WHEN v > 0 THEN {dbl(by)} ELSE {dbl(-by)} END)"
    among = lambda w, words: f"coalesce({w} IN ({', '.join(map(O.q, words))}), false)"
    lex = ", ".join(f"({O.q(t)}, {dbl(v)})" for t, v in TOY_LEXICON.items())
    steps, last = [], "caps1"
    for k in (1, 2, 3):
        w = f"t{k}"
        boost = (f"v + ((CASE WHEN v < 0 THEN -1 ELSE 1 END) * (CASE WHEN {among(w, m.RAISING)} THEN {dbl(m.BOOST)} ELSE {dbl(-m.BOOST)} END)"
                 f" + CASE WHEN c{k} THEN {toward(m.CAPITALS)} ELSE 0 END) * {dbl(m.DISTANCE[k - 1])}")
        negated = f"({among(w, m.NEGATIONS)} OR contains({w}, 'n''t'))"
        two = f" OR {among('t2', ('so', 'this'))}" if k == 3 else ""
        sure = f" OR {among('t2', ('doubt',))}" if k == 3 else ""
        special = (f"WHEN {w} = 'never' AND ({among('t1', ('so', 'this'))}{two}) THEN v * {m.NEVER_SO} "
                   f"WHEN {w} = 'without' AND ({among('t1', ('doubt',))}{sure}) THEN v " if k > 1 else "")
        steps.append(f"b{k} AS (SELECT * REPLACE (CASE WHEN {w} IS NOT NULL AND NOT k{k} AND {among(w, m.RAISING + m.LOWERING)} THEN {boost} ELSE v END AS v) FROM {last})")
        steps.append(f"n{k} AS (SELECT * REPLACE (CASE WHEN {w} IS NULL OR k{k} THEN v {special}WHEN {negated} THEN v * {m.NEGATION_FACTOR} ELSE v END AS v) FROM b{k})")
        last = f"n{k}"
    lag = lambda e, k: f"lag({e}, {k}) OVER o"
    return O.with_ctes(O.tickets_cte()) + f""",
lex AS (SELECT * FROM (VALUES {lex}) AS l(term, valence)),
tx AS (SELECT ticket_id AS id, {O.normalize('message')} AS t FROM tickets),
tk AS (SELECT id, t, [CASE WHEN length(regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) <= 2 THEN x
                           ELSE regexp_replace(x, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') END for x in string_split(t, ' ') if x <> ''] AS w FROM tx),
cp AS (SELECT *, len([x for x in w if x = upper(x) AND x <> lower(x)]) < len(w) AS mixed FROM tk),
ps AS (SELECT id, mixed, unnest(range(len(w))) AS pos, unnest(w) AS word FROM cp),
kn AS (SELECT ps.*, lower(word) AS term, mixed AND word = upper(word) AND word <> lower(word) AS caps, valence
       FROM ps LEFT JOIN lex ON lower(word) = lex.term),
ct AS (SELECT *, {', '.join(f"{lag('term', k)} AS t{k}, coalesce({lag('valence IS NOT NULL', k)}, false) AS k{k}, coalesce({lag('caps', k)}, false) AS c{k}" for k in (1, 2, 3))},
              lead(term) OVER o AS next, coalesce(lead(valence IS NOT NULL) OVER o, false) AS next_known,
              min(CASE WHEN term = 'but' THEN pos END) OVER (PARTITION BY id) AS but
       FROM kn WINDOW o AS (PARTITION BY id ORDER BY pos)),
no1 AS (SELECT *, CASE WHEN {among('t1', ('no',))} OR {among('t2', ('no',))} OR ({among('t3', ('no',))} AND {among('t1', ('or', 'nor'))}) THEN valence * {m.NEGATION_FACTOR}
                       WHEN term = 'no' AND next_known THEN 0 ELSE valence END AS v
        FROM ct WHERE valence IS NOT NULL AND NOT ({among('term', m.RAISING + m.LOWERING)} OR coalesce(term = 'kind' AND next = 'of', false))),
caps1 AS (SELECT * REPLACE (CASE WHEN caps THEN v + {toward(m.CAPITALS)} ELSE v END AS v) FROM no1),
{', '.join(steps)},
lst AS (SELECT * REPLACE (CASE WHEN {among('t1', ('least',))} AND NOT k1 AND NOT {among('t2', ('at', 'very'))} THEN v * {m.NEGATION_FACTOR} ELSE v END AS v) FROM {last}),
tot AS (SELECT id, sum(v * CASE WHEN pos < but THEN {m.BEFORE_BUT} WHEN pos > but THEN {m.AFTER_BUT} ELSE 1 END) AS s FROM lst GROUP BY id),
mk AS (SELECT id, length(t) - length(replace(t, '!', '')) AS e, length(t) - length(replace(t, '?', '')) AS q FROM tx),
sm AS (SELECT mk.id, coalesce(s, 0.0) AS s, least(e, {m.EXCLAMATIONS}) * {dbl(m.EXCLAMATION)}
              + CASE WHEN q > 3 THEN {dbl(m.QUESTIONS)} WHEN q > 1 THEN q * {dbl(m.QUESTION)} ELSE 0 END AS more FROM mk LEFT JOIN tot USING (id)),
fin AS (SELECT id, CASE WHEN s > 0 THEN s + more WHEN s < 0 THEN s - more ELSE 0 END AS s FROM sm),
sc AS (SELECT id AS ticket_id, round(s / sqrt(s * s + {dbl(m.SQUASH)}), 4) AS sentiment_score FROM fin)
SELECT ticket_id, sentiment_score, CASE WHEN sentiment_score >= 0.2 THEN 'positive' WHEN sentiment_score <= -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment,
       {O.q(m.VALENCE_SOURCE)} AS sentiment_source FROM sc"""


@register("valence_sentiment", _valence_sql())
def valence_sentiment(spark, sf_dir):
    t = fx.tickets(spark, sf_dir).select("ticket_id", "message")
    return sentiment.analyse(t, "ticket_id", "message", _lexicon(spark))


@register("lexical_sentiment_source", O.with_ctes(O.tickets_cte()) + f"""
SELECT ticket_id, round({O.lexicon_score('message')}, 6) AS sentiment_score, {O.polarity(O.lexicon_score('message'))} AS sentiment,
       {O.q(V.LEXICON_SOURCE)} AS sentiment_source FROM tickets""")
def lexical_sentiment_source(spark, sf_dir):
    t = fx.tickets(spark, sf_dir).select("ticket_id", "message")
    s = sentiment.analyse(t, "ticket_id", "message")
    return s.select("ticket_id", F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment", "sentiment_source")


# S5 ---------------------------------------------------------------------------
PUBLIC_MAP = {f"src_{i}": i for i in V.INTENT_TO_QUERY_TYPE if i != "general_complaint"}


@register("public_corpus", O.with_ctes(O.tickets_cte()) + f""",
m AS (SELECT * FROM (VALUES {', '.join(f"({O.q(s)}, {O.q(V.INTENT_TO_QUERY_TYPE[i])}, {O.q(i)})" for s, i in PUBLIC_MAP.items())}) AS l(source_label, query_type, intent)),
c AS (SELECT ticket_id, message, 'src_' || CASE WHEN ticket_id % 5 = 0 THEN pred_intent ELSE true_intent END AS source_label FROM tickets)
SELECT message AS text, query_type, intent FROM (
  SELECT c.message, m.query_type, m.intent, row_number() OVER (PARTITION BY c.message ORDER BY c.ticket_id) AS r FROM c JOIN m USING (source_label)) x
WHERE r = 1""")
def public_corpus(spark, sf_dir):
    """A public corpus rendered from the tickets: other column names, source labels, texts with several labels."""
    tid = F.col("ticket_id")
    corpus = fx.tickets(spark, sf_dir).select(tid.alias("ROW"), F.col("message").alias("Instruction"), F.concat(
        F.lit("src_"), F.when(tid % 5 == 0, F.col("pred_intent")).otherwise(F.col("true_intent"))).alias("Intent"))
    labels = spark.createDataFrame([(s, V.INTENT_TO_QUERY_TYPE[i], i) for s, i in PUBLIC_MAP.items()], "source_label string, query_type string, intent string")
    return io.ingest_public(corpus, labels, rank=["row"])


# R11 --------------------------------------------------------------------------
@register("public_view", f"""
SELECT t.event_id AS ticket_id, coalesce(d.n, 0) AS found, d.best, CAST(0 AS BIGINT) AS shown, CAST(0 AS BIGINT) AS shown_in_ticket
FROM events t LEFT JOIN (SELECT message_id, CAST(count(*) AS BIGINT) AS n, arg_min(ticket_id, rank) AS best
                         FROM ({similar_queries.V3_SQL}) c GROUP BY message_id) d ON t.event_id = d.message_id""")
def public_view(spark, sf_dir):
    """What agents have found (V3) and what is left of it for a customer."""
    hits = similar_queries.duplicate_candidates(spark, sf_dir).groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ticket_id", "similarity", "status", "department"))).alias("hits"))  # three of them
    t = fx.tickets(spark, sf_dir).select("ticket_id", "status").join(hits, F.col("ticket_id") == F.col("message_id"), "left")
    found = F.coalesce("hits", F.array().cast(dict(hits.dtypes)["hits"]))
    analysed = t.select("ticket_id", found.alias("agent_view"), found.alias("duplicate_candidates"),
                        F.struct("status", found.alias("duplicate_candidates")).alias("ticket"))
    v = ops.public_view(analysed)
    return v.select("ticket_id", F.size("agent_view").cast("bigint").alias("found"), F.get("agent_view", F.lit(0))["ticket_id"].alias("best"),
                    F.size("duplicate_candidates").cast("bigint").alias("shown"),
                    F.size("ticket.duplicate_candidates").cast("bigint").alias("shown_in_ticket"))


# M3, M2: the parts of the classifier that SQL can express ------------------------
@register("class_weights", O.with_ctes(O.tickets_cte()) + """
SELECT true_intent AS intent, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight, CAST(count(*) AS BIGINT) AS n_rows
FROM tickets GROUP BY true_intent""")
def class_weights(spark, sf_dir):
    from ..operators import model as ML
    t = fx.tickets(spark, sf_dir).select(F.col("true_intent").alias("intent"))
    w, _ = ML.with_class_weights(t, "intent")
    return w.groupBy("intent").agg(F.round(F.first("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n_rows"))


@register("char_gram_counts", O.with_ctes(O.tickets_cte()) + """,
w AS (SELECT ' ' || unnest(string_split_regex(lower(message), '\\s+')) || ' ' AS w FROM tickets),
g AS (SELECT unnest([substr(w, i, 3) for i in range(1, length(w) - 1)] || [substr(w, i, 4) for i in range(1, length(w) - 2)]
             || [substr(w, i, 5) for i in range(1, length(w) - 3)]) AS gram FROM w WHERE length(w) > 2)
SELECT gram, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY gram""")
def char_gram_counts(spark, sf_dir):
    from pyspark.ml.feature import SQLTransformer

    from ..operators import model as ML
    t = fx.tickets(spark, sf_dir).select(F.col("message").alias("text"))
    grams = SQLTransformer(statement=ML.CHAR_GRAMS_SQL).transform(t)
    return grams.select(F.explode("char_grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
