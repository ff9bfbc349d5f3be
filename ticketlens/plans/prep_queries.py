"""Registered training-data (P, J2, J3) and evaluation (E, J4, J6) queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import metrics as M
from ..operators import prep
from ..session import ensure_checkpoint_dir
from . import fixtures as fx
from . import jobs
from . import oracle as O
from .registry import register

QT = O.query_type_for
LEGACY = lambda x: f"coalesce({O.sql_map_case(x, V.LEGACY_LABEL_TO_INTENT, None)}, {x})"

J2_BODY = f"""src AS (
  SELECT message AS text, {QT('true_intent')} AS query_type, true_intent AS intent, 1 AS source_rank, ticket_id AS row_id
  FROM tickets WHERE ticket_id % 4 <> 3
  UNION ALL
  SELECT message, CASE WHEN {QT(QT('true_intent'))} = 'other' THEN {QT('true_intent')} ELSE {QT(QT('true_intent'))} END,
         {LEGACY(QT('true_intent'))}, 2, ticket_id
  FROM tickets WHERE ticket_id % 4 = 3
),
merged AS (
  SELECT text, query_type, intent, source_rank, row_id FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) AS rn FROM src) s WHERE rn = 1
),
split AS (
  SELECT *, CASE WHEN r <= round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY intent ORDER BY md5(text || '42')) AS r,
           count(*) OVER (PARTITION BY intent) AS n FROM merged) m
),
para AS (
  SELECT lower(message) AS text, {QT('true_intent')} AS query_type, {LEGACY('true_intent')} AS intent,
         3 AS source_rank, ticket_id AS row_id
  FROM tickets WHERE ticket_id % 10 = 1
),
train AS (
  SELECT text, query_type, intent FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_rank, row_id) AS rn FROM (
      SELECT text, query_type, intent, source_rank, row_id FROM split WHERE split = 'train'
      UNION ALL SELECT * FROM para) u) d
  WHERE rn = 1 AND text NOT IN (SELECT text FROM split WHERE split = 'test')
),
training_set AS (
  SELECT text, query_type, intent, 'train' AS split FROM train
  UNION ALL SELECT text, query_type, intent, split FROM split WHERE split = 'test'
)"""
J2_CTES = O.with_ctes(O.tickets_cte()) + ", " + J2_BODY + "\n"


# S2 -> P1 -> P2 -> P4 -> P5 -> D11 -> P7 ----------------------------------
@register("training_set", J2_CTES + "SELECT text, query_type, intent, split FROM training_set")
def training_set(spark, sf_dir):
    return jobs.training_set(spark, sf_dir).select("text", "query_type", "intent", "split")


@register("split_counts", J2_CTES + """
SELECT intent, split, CAST(count(*) AS BIGINT) AS n_rows FROM training_set GROUP BY intent, split""")
def split_counts(spark, sf_dir):
    return jobs.training_set(spark, sf_dir).groupBy("intent", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("type_coverage", J2_CTES + f"""
SELECT d.query_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n_rows
FROM (SELECT unnest({O.sql_list(V.QUERY_TYPES)}) AS query_type) d
LEFT JOIN (SELECT query_type, count(*) AS n FROM merged GROUP BY query_type) c ON d.query_type = c.query_type""")
def type_coverage(spark, sf_dir):
    base, legacy, _ = jobs.labelled_sources(spark, sf_dir)
    merged = prep.dedupe(prep.harmonise(base).unionByName(prep.harmonise(legacy)), "text",
                         ["source_rank", "row_id"], keep="first")
    return prep.coverage(merged).select("query_type", F.col("n_rows").cast("bigint").alias("n_rows"))


@register("balanced_sample", J2_CTES + """
SELECT intent, CAST(count(*) AS BIGINT) AS n_rows, min(md5(text || '42')) AS first_key,
       max(md5(text || '42')) AS last_key
FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY md5(text || '42')) AS r FROM merged) m
WHERE r <= 40 GROUP BY intent""")
def balanced_sample(spark, sf_dir):
    base, legacy, _ = jobs.labelled_sources(spark, sf_dir)
    merged = prep.dedupe(prep.harmonise(base).unionByName(prep.harmonise(legacy)), "text",
                         ["source_rank", "row_id"], keep="first")
    s = prep.balanced_sample(merged, 40).withColumn("k", prep.order_key(F.col("text")))
    return s.groupBy("intent").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_key"),
                                   F.max("k").alias("last_key"))


# D8 -> S10 -> P8 -> P9 -> P10 ---------------------------------------------
def _noisy_export_sql() -> str:
    return f"""noisy AS (
  SELECT ticket_id, customer_message, reviewed_at,
         CASE WHEN ticket_id % 5 = 1 THEN upper(final_query_type) WHEN ticket_id % 7 = 2 THEN 'billing'
              WHEN ticket_id % 11 = 3 THEN CASE WHEN final_query_type = 'delivery' THEN 'payment' ELSE 'delivery' END
              ELSE final_query_type END AS final_query_type,
         CASE WHEN ticket_id % 13 = 4 THEN ''
              WHEN ticket_id % 17 = 5 THEN list_reduce(list_transform(string_split(replace(final_intent, '_', ' '), ' '),
                   lambda w: upper(left(w, 1)) || lower(substr(w, 2))), lambda a, b: a || ' ' || b)
              ELSE final_intent END AS final_intent
  FROM (SELECT s.ticket_id, s.message AS customer_message, coalesce(r.final_query_type, '') AS final_query_type,
               coalesce(r.final_intent, '') AS final_intent, r.reviewed_at
        FROM reviews r JOIN store s ON r.ticket_id = s.ticket_id) e
),
checks AS (
  SELECT ticket_id, reviewed_at, {O.normalize('customer_message')} AS text, lower(trim(final_query_type)) AS query_type,
         replace(lower(trim(final_intent)), ' ', '_') AS intent,
         CASE WHEN customer_message IS NULL OR customer_message IN ({', '.join(O.q(x) for x in V.PANDAS_NA_TOKENS)})
                OR final_query_type IS NULL OR final_query_type IN ({', '.join(O.q(x) for x in V.PANDAS_NA_TOKENS)})
                OR final_intent IS NULL OR final_intent IN ({', '.join(O.q(x) for x in V.PANDAS_NA_TOKENS)})
              THEN 'missing_field'
              WHEN length({O.normalize('customer_message')}) < 3 THEN 'too_short'
              WHEN lower(trim(final_query_type)) NOT IN ({', '.join(O.q(x) for x in V.QUERY_TYPES)}) THEN 'unknown_query_type'
              WHEN {QT("replace(lower(trim(final_intent)), ' ', '_')")} <> lower(trim(final_query_type)) THEN 'inconsistent_labels'
         END AS reject_reason
  FROM noisy
),
validated AS (
  SELECT text, query_type, intent, 'human_review' AS source FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY reviewed_at DESC, ticket_id) AS rn
    FROM checks WHERE reject_reason IS NULL) c WHERE rn = 1
)"""


J3_CTES = O.full_ctes() + ", " + J2_BODY + ",\n" + _noisy_export_sql() + "\n"


@register("validated_feedback", J3_CTES + "SELECT text, query_type, intent, source FROM validated")
def validated_feedback(spark, sf_dir):
    return prep.validate_feedback(jobs.feedback_export(spark, sf_dir))


@register("rejected_feedback", J3_CTES + """
SELECT reject_reason, CAST(count(*) AS BIGINT) AS n_rows FROM checks WHERE reject_reason IS NOT NULL
GROUP BY reject_reason""")
def rejected_feedback(spark, sf_dir):
    return prep.rejected_feedback(jobs.feedback_export(spark, sf_dir)).select(
        "reject_reason", F.col("n_rows").cast("bigint").alias("n_rows"))


@register("retraining_set", J3_CTES + """
SELECT text, query_type, intent, source FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY part DESC) AS rn FROM (
    SELECT text, query_type, intent, 'original_training' AS source, 0 AS part FROM train
    UNION ALL SELECT text, query_type, intent, source, 1 FROM validated) u) d
WHERE rn = 1""")
def retraining_set(spark, sf_dir):
    return jobs.retraining(spark, sf_dir)


@register("label_counts", J3_CTES + """
SELECT intent, CAST(count(*) AS BIGINT) AS n_rows FROM train GROUP BY intent""")
def label_counts(spark, sf_dir):
    tr = jobs.training_set(spark, sf_dir).where(F.col("split") == "train")
    return prep.label_counts(tr, "intent").select("intent", F.col("n_rows").cast("bigint").alias("n_rows"))


# E family on rendered tickets (truth = template intent) -----------------------
EVAL_BASE = O.with_ctes(O.tickets_cte()) + ", ev AS (SELECT true_intent AS truth, pred_intent AS pred, confidence FROM tickets)\n"
CLASS_COUNTS = """cc AS (
  SELECT label, sum(s) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
    SELECT truth AS label, 1 AS s, 0 AS p, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp FROM ev
    UNION ALL SELECT pred, 0, 1, 0 FROM ev) x GROUP BY label
),
rep AS (
  SELECT label, coalesce(try_divide_tp_pred, 0.0) AS precision, coalesce(try_divide_tp_sup, 0.0) AS recall, support
  FROM (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted END AS try_divide_tp_pred,
               CASE WHEN support > 0 THEN tp / support END AS try_divide_tp_sup FROM cc) y
),
rep2 AS (
  SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall)
         ELSE 0.0 END AS f1, support FROM rep
)
"""


def _ev_spark(spark, sf_dir):
    return fx.tickets(spark, sf_dir).select(F.col("true_intent").alias("truth"), F.col("pred_intent").alias("pred"),
                                            "confidence")


@register("intent_accuracy", EVAL_BASE + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ev""")
def intent_accuracy(spark, sf_dir):
    a = M.accuracy(_ev_spark(spark, sf_dir))
    return a.select(F.col("n").cast("bigint").alias("n"), F.round("accuracy", 6).alias("accuracy"))


def _round_report(r):
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("bigint").alias("support"))


@register("intent_class_report", EVAL_BASE + "," + CLASS_COUNTS + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep2""")
def intent_class_report(spark, sf_dir):
    return _round_report(M.class_report(_ev_spark(spark, sf_dir)))


@register("intent_f1_summary", EVAL_BASE + "," + CLASS_COUNTS + """
SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       CAST(count(*) AS BIGINT) AS n_labels FROM rep2""")
def intent_f1_summary(spark, sf_dir):
    s = M.f1_summary(M.class_report(_ev_spark(spark, sf_dir)))
    return s.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("weighted_f1", 6).alias("weighted_f1"),
                    F.col("n_labels").cast("bigint").alias("n_labels"))


@register("intent_confusion", EVAL_BASE + """
SELECT truth, pred, CAST(count(*) AS BIGINT) AS n FROM ev WHERE pred IN (SELECT truth FROM ev) GROUP BY truth, pred""")
def intent_confusion(spark, sf_dir):
    return M.confusion(_ev_spark(spark, sf_dir))


@register("intent_report_all_labels", EVAL_BASE + "," + CLASS_COUNTS.replace(
    "GROUP BY label\n)", f"GROUP BY label\n), alll AS (SELECT unnest({O.sql_list(list(V.INTENT_TO_QUERY_TYPE))}) AS lbl)")
    .replace("FROM cc) y", "FROM (SELECT alll.lbl AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, "
             "coalesce(tp, 0) AS tp FROM alll LEFT JOIN cc ON alll.lbl = cc.label) z) y") + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep2""")
def intent_report_all_labels(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in V.INTENT_TO_QUERY_TYPE], "label string")
    return _round_report(M.class_report(_ev_spark(spark, sf_dir), labels=F.broadcast(labels)))


@register("calibration", EVAL_BASE + """
SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS expected_calibration_error,
       round(sum(n * conf) / sum(n), 6) AS mean_top_label_confidence, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT least(floor(confidence * 10.0::DOUBLE), 9) AS bin, count(*) AS n,
             avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS acc, avg(confidence) AS conf
      FROM ev GROUP BY bin) b""")
def calibration(spark, sf_dir):
    e = _ev_spark(spark, sf_dir).withColumn("correct", F.col("truth") == F.col("pred"))
    c = M.calibration(e)
    return c.select(F.round("expected_calibration_error", 6).alias("expected_calibration_error"),
                    F.round("mean_top_label_confidence", 6).alias("mean_top_label_confidence"),
                    F.col("n").cast("bigint").alias("n"))


_PRIORITY, _PERSON = zip(*V.EXPECTED_TRIAGE)
SAFETY = O.full_ctes() + f""", safety AS (
  SELECT f.ticket_id, list_extract({O.sql_list(_PRIORITY)}, CAST(f.template_id + 1 AS INTEGER)) AS expected_priority,
         (list_extract([{', '.join(str(x).lower() for x in _PERSON)}], CAST(f.template_id + 1 AS INTEGER))
          OR verification_status = 'reference_not_found') AS expected_escalation,
         priority, escalate_to_human
  FROM final f
)
"""


@register("escalation_prf", SAFETY + """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(expected_escalation AND escalate_to_human) AS BIGINT) AS tp,
       CAST(count_if(NOT expected_escalation AND escalate_to_human) AS BIGINT) AS fp,
       CAST(count_if(expected_escalation AND NOT escalate_to_human) AS BIGINT) AS fn,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(CASE WHEN coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0) > 0 THEN
         2 * coalesce(tp / nullif(tp + fp, 0), 0.0) * coalesce(tp / nullif(tp + fn, 0), 0.0)
         / (coalesce(tp / nullif(tp + fp, 0), 0.0) + coalesce(tp / nullif(tp + fn, 0), 0.0)) ELSE 0.0 END, 6) AS f1
FROM safety""")
def escalation_prf(spark, sf_dir):
    s = jobs.safety_eval(spark, sf_dir)
    b = M.binary_prf(s, "expected_escalation", "escalate_to_human")
    return b.select(*[F.col(c).cast("bigint").alias(c) for c in ("n", "tp", "fp", "fn")],
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("priority_report", SAFETY + ", ev AS (SELECT expected_priority AS truth, priority AS pred FROM safety),\n"
          + CLASS_COUNTS + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support, round(avg(f1) OVER (), 6) AS macro_f1 FROM rep2""")
def priority_report(spark, sf_dir):
    from pyspark.sql import Window
    s = jobs.safety_eval(spark, sf_dir).select(F.col("expected_priority").alias("truth"),
                                               F.col("priority").alias("pred"))
    r = M.class_report(s).withColumn("macro_f1", F.round(F.avg("f1").over(Window.partitionBy()), 6))
    return _round_report(r).join(r.select("label", "macro_f1"), on="label")  # a row for each of four priorities


@register("model_comparison", EVAL_BASE + """, maj AS (
  SELECT truth AS m FROM ev GROUP BY truth ORDER BY count(*) DESC, truth LIMIT 1
), preds AS (
  SELECT 'classifier' AS model, truth, pred FROM ev
  UNION ALL SELECT 'majority', truth, (SELECT m FROM maj) FROM ev
), mc AS (
  SELECT model, label, sum(s) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
    SELECT model, truth AS label, 1 AS s, 0 AS p, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp FROM preds
    UNION ALL SELECT model, pred, 0, 1, 0 FROM preds) x GROUP BY model, label
), mf AS (
  SELECT *, CASE WHEN pr + rc > 0 THEN 2.0 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM (
    SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM mc) y
), ms AS (
  SELECT model, sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1
  FROM mf GROUP BY model
)
SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
       model = (SELECT model FROM ms ORDER BY macro_f1 DESC, model DESC LIMIT 1) AS chosen FROM ms""")
def model_comparison(spark, sf_dir):
    ev = _ev_spark(spark, sf_dir)
    counts = ev.groupBy("truth").agg(F.count(F.lit(1)).alias("n"))
    majority = counts.agg(F.min_by("truth", F.struct((-F.col("n")).alias("n"), F.col("truth")))).scalar()
    preds = ev.select(F.lit("classifier").alias("model"), "truth", "pred").unionByName(
        ev.select(F.lit("majority").alias("model"), "truth", majority.alias("pred")))
    c = M.compare_models(preds)
    return c.select("model", *[F.round(x, 6).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1")], "chosen")


# S14 on whole documents as intake messages --------------------------------------
@register("intake_validation", f"""
SELECT coalesce(CASE WHEN text IS NULL OR length(text) < 3 THEN 'message_too_short'
                     WHEN length(text) > 5000 THEN 'message_too_long' END, 'valid') AS outcome,
       CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY outcome""")
def intake_validation(spark, sf_dir):
    from ..session import read_table
    from ..sources import io
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    ok, bad = io.split_valid(d)
    both = ok.withColumn("outcome", F.lit("valid")).unionByName(bad.withColumnRenamed("reject_reason", "outcome"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum(F.length("message")).cast("bigint").alias("n_chars"))


# S6 on the embeddings labels -----------------------------------------------------
@register("decoded_labels", """
SELECT CASE WHEN label BETWEEN 0 AND 9 THEN 'class_' || CAST(label AS VARCHAR) END AS label_name,
       CAST(count(*) AS BIGINT) AS n_rows FROM embeddings GROUP BY label_name""")
def decoded_labels(spark, sf_dir):
    from ..session import read_table
    from ..sources import io
    e = read_table(spark, sf_dir, "embeddings").select("label")
    d = io.decode_labels(e, [f"class_{i}" for i in range(10)])
    return d.groupBy("label_name").agg(F.count(F.lit(1)).alias("n_rows"))


# M1, M2: the fitted vocabulary of the train split ---------------------------------
@register("model_vocabulary", J2_CTES + """,
r AS (SELECT row_number() OVER () AS id, lower(text) AS text FROM training_set WHERE split = 'train'),
wt AS (SELECT id, regexp_extract_all(text, '[\\p{L}\\p{N}_]{2,}') AS tk FROM r),
wg AS (SELECT id, unnest(list_concat(tk, [tk[i] || ' ' || tk[i + 1] for i in range(1, len(tk))])) AS term FROM wt),
cw AS (SELECT id, ' ' || unnest(string_split_regex(text, '\\s+')) || ' ' AS w FROM r),
cg AS (SELECT id, unnest([substr(w, i, 3) for i in range(1, length(w) - 1)] || [substr(w, i, 4) for i in range(1, length(w) - 2)]
                         || [substr(w, i, 5) for i in range(1, length(w) - 3)]) AS term FROM cw WHERE length(w) > 2),
terms AS (SELECT 'word' AS block, id, term FROM wg UNION ALL SELECT 'char', id, term FROM cg),
dfs AS (SELECT block, term, count(DISTINCT id) AS df FROM terms GROUP BY block, term)
SELECT block, term, df, round(ln((1.0 + (SELECT count(*) FROM r)) / (1.0 + df)) + 1, 6) AS idf,
       row_number() OVER (ORDER BY block, term) - 1 AS idx FROM dfs""")
def model_vocabulary(spark, sf_dir):
    from ..operators import features as X
    from ..operators.similar import materialise
    train = materialise(jobs.training_set(spark, sf_dir).where(F.col("split") == "train").select("text"))
    v = X.fit_vocabulary(X.document_terms(train, "text"), train.agg(F.count(F.lit(1))).first()[0])  # one number
    return v.select("block", "term", "df", F.round("idf", 6).alias("idf"), "idx")


# Train on the train split, evaluate on the held-out split -------
@register("intent_model_eval")
def intent_model_eval(spark, sf_dir):
    """Rows-only check (model training is iterative): accuracy, macro F1 and
    mean confidence of the intent and query-type models on the test split."""
    from ..operators import model as ML
    # The split is read by several fits (IDF, label index, class weights, LR):
    # materialise it once in the shared checkpoint folder instead of replaying it.
    ensure_checkpoint_dir(spark)
    ts = jobs.training_set(spark, sf_dir).select("text", "intent", "query_type", "split").checkpoint(eager=True)
    train, test = ts.where(F.col("split") == "train"), ts.where(F.col("split") == "test")
    rows = []
    for label in ("intent", "query_type"):
        m = ML.fit(train, label)
        s = ML.score(m, test.select("text", label)).select(F.col(label).alias("truth"),
                                                            F.col("predicted").alias("pred"), "confidence")
        rep = M.f1_summary(M.class_report(s))
        acc = M.accuracy(s)
        rows.append(acc.select(F.lit(label).alias("model"), F.round("accuracy", 6).alias("accuracy"), "n")
                    .withColumn("macro_f1", F.round(rep.select("macro_f1").scalar(), 6)))
    return rows[0].unionByName(rows[1])


# M4: the calibrated query-type model on the held-out split ------------------------
@register("calibrated_model_eval")
def calibrated_model_eval(spark, sf_dir):
    """Rows-only check: accuracy and calibration error of the three-fold calibrated
    query-type model on the test split."""
    from ..operators import model as ML
    from ..operators.similar import materialise
    ts = materialise(jobs.training_set(spark, sf_dir).select("text", "query_type", "split"))
    m = ML.fit_calibrated(ts.where(F.col("split") == "train"), "query_type")
    s = ML.score_calibrated(m, ts.where(F.col("split") == "test").select("text", "query_type"))
    s = materialise(s.select("confidence", (F.col("query_type") == F.col("predicted")).alias("correct")))
    acc = s.agg(F.avg(F.col("correct").cast("double"))).scalar()
    c = M.calibration(s)
    return c.select(F.round(acc, 6).alias("accuracy"), F.round("expected_calibration_error", 6).alias("expected_calibration_error"),
                    F.round("mean_top_label_confidence", 6).alias("mean_top_label_confidence"), F.col("n").cast("bigint").alias("n"))
