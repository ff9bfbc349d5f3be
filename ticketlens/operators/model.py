"""Intent and query-type classifiers (M1-M7; M6 with the intent fallback).

Features come from a fitted vocabulary (``features``): word 1- and 2-grams and
character 3- to 5-grams inside padded words, sublinear tf, smoothed idf + 1, of
length one in each block.  The classifier is a weighted multinomial logistic
regression (``softmax``) with balanced class weights n / (k * n_c), solved to the
tolerance on the compacted problem.  ``fit_calibrated`` (M4) trains one model per
fold, fits a sigmoid per class to the scores of the rows left out, and averages
the folds' normalised probabilities.

A model is a table of terms with their idf and a weight by class, so scoring is a
join on terms and an aggregate; nothing of the size of the vocabulary is broadcast
unless Spark finds it small.  Rows with a null label are not learned from; null
texts are empty, and a text without a known term gets the intercepts' scores.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features as X
from . import softmax
from .similar import materialise

#: Character n-grams as a statement for SQLTransformer.
CHAR_GRAMS_SQL = f"SELECT *, {X.CHAR_GRAMS.format(text='text')} AS char_grams FROM __THIS__"


@dataclass
class TextModel:
    """terms: (block, term, idf, w) with a weight for each class; the classes and their intercepts."""
    terms: DataFrame
    names: list[str]
    bias: list[float]


def with_class_weights(df: DataFrame, label: str = "intent") -> tuple[DataFrame, int]:
    """Balanced weights n / (k * n_c); one aggregate per class, joined back.
    Returns the weighted frame and n (= the sum of the weights)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    # One small action: k rows (one per class) reduced to (n, k) on the driver.
    n, k = counts.agg(F.sum("n_c"), F.count(F.lit(1))).first()
    # counts holds one row per class (bounded by the label set), so it is broadcast.
    return df.join(F.broadcast(counts), on=label).withColumn("weight", n / (k * F.col("n_c"))).drop("n_c"), n


def fit(train: DataFrame, label: str = "intent", c: float = 1.0, tolerance: float = softmax.TOLERANCE,
        max_iter: int = softmax.MAX_ITER, driver_bytes: int = softmax.DRIVER_BYTES) -> TextModel:
    """M3: minimises c * sum(weight * loss) + |w|^2 / 2."""
    rows = train.where(F.col(label).isNotNull()).select("text", F.col(label).cast("string").alias("label"))
    rows = materialise(rows).withColumn("row", F.monotonically_increasing_id())
    weighted, n = with_class_weights(rows, "label")
    labelled = weighted.select("row", "label", (F.col("weight") * c).alias("weight"))
    terms = materialise(X.term_rows(rows, "row", "text"))
    vocabulary = materialise(X.fit_vocabulary(terms, n or 0))
    cells, labels, columns = X.compact(X.feature_rows(terms, vocabulary), labelled)
    names = sorted(r["label"] for r in labels.select("label").distinct().collect())  # the labels
    if not names:
        raise ValueError("no labelled row")
    number = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    labels = labels.select("r", F.element_at(number, F.col("label")).alias("k"), "weight")
    width = (columns.agg(F.max("c").alias("c")).first()["c"] or 0) + 1
    w, bias = softmax.fit(materialise(cells), materialise(labels), width, len(names), tolerance, max_iter, driver_bytes)
    own = vocabulary.join(columns, "idx").join(w, "c").select("block", "term", "idf", F.transform("w", lambda v: v / F.sqrt("m")).alias("w"))
    return TextModel(materialise(own), names, [float(v) for v in bias])


def classes(model: TextModel) -> list[str]:
    """Class names in probability order (bounded by the number of labels)."""
    return list(model.names)


def with_margins(model: TextModel, df: DataFrame, column: str) -> DataFrame:
    """``df`` (with a text) and the classes' raw scores as an array; equal texts are scored once."""
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = df.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct().withColumn("_key", key)
    known = X.term_rows(texts, "_key", "text").join(model.terms, ["block", "term"]).withColumn("_x", (1 + F.log("tf")) * F.col("idf"))
    k = range(len(model.names))
    sums = known.groupBy("row", "block").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_n"),
                                             *[F.sum(F.col("_x") * F.col("w")[i]).alias(f"_s{i}") for i in k])
    both = sums.groupBy("row").agg(F.array(*[F.sum(F.col(f"_s{i}") / F.col("_n")) for i in k]).alias("_s"))
    bias = F.array(*[F.lit(v) for v in model.bias])
    added = F.coalesce(F.zip_with("_s", bias, lambda s, b: s + b), bias)
    return df.withColumn("_key", key).join(both.withColumnRenamed("row", "_key"), "_key", "left").withColumn(column, added).drop("_key", "_s")


def _ranked(p: Column, names: list[str]) -> Column:
    """(confidence, name) by falling confidence; ties keep class order."""
    pairs = F.arrays_zip(p.alias("confidence"), F.array(*[F.lit(c) for c in names]).alias("name"))
    return F.array_sort(pairs, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))


def _decided(df: DataFrame, keep: list[str], p: Column, names: list[str], top_k: int) -> DataFrame:
    out = df.withColumn("_r", _ranked(p, names))
    return out.select(*keep, F.col("_r")[0]["name"].alias("predicted"), F.col("_r")[0]["confidence"].alias("confidence"),
                      F.transform(F.slice("_r", 1, top_k), lambda x: F.struct(x["name"].alias("intent"), F.round(x["confidence"], 4).alias("confidence"))).alias("top_intents"))


def score(model: TextModel, df: DataFrame, top_k: int = 3) -> DataFrame:
    """M5: predicted label, its confidence and the top-k ranking (4 dp); ties
    keep class order."""
    e = F.transform("_z", lambda z: F.exp(z - F.array_max("_z")))
    scored = with_margins(model, df, "_z").withColumn("_e", e).withColumn("_t", F.aggregate("_e", F.lit(0.0), lambda a, v: a + v))
    return _decided(scored, df.columns, F.transform("_e", lambda v: v / F.col("_t")), model.names, top_k)


def score_query_type(df: DataFrame, model: TextModel | None = None, intent: str = "pred_intent") -> DataFrame:
    """M6: query type from the six-class model when one is given (its label and
    confidence, source "model"); otherwise derived from the intent, with a null
    confidence and source "intent"."""
    from ..functions.text import query_type_for
    if model is None:
        return df.withColumn("query_type", query_type_for(F.col(intent))) \
            .withColumn("query_type_confidence", F.lit(None).cast("double")) \
            .withColumn("query_type_source", F.lit("intent"))
    ranking = [c for c in df.columns if c == "top_intents"]  # of the intent model
    held = df.withColumnsRenamed({c: "_ranking" for c in ranking})
    scored = score(model, held, top_k=1).drop("top_intents").withColumnsRenamed({"_ranking": c for c in ranking})
    return scored.withColumnRenamed("predicted", "query_type") \
        .withColumnRenamed("confidence", "query_type_confidence") \
        .withColumn("query_type_source", F.lit("model"))


def save(model: TextModel, path: str) -> None:
    """M7: the terms and, beside them, the classes."""
    spark = model.terms.sparkSession
    model.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(model.names, model.bias)], "names array<string>, bias array<double>").write.mode("overwrite").parquet(f"{path}/classes")


def load(path: str, spark: SparkSession | None = None) -> TextModel:
    spark = spark or SparkSession.active()
    row = spark.read.parquet(f"{path}/classes").first()
    return TextModel(spark.read.parquet(f"{path}/terms"), list(row["names"]), list(row["bias"]))


# M4 ---------------------------------------------------------------------------
@dataclass
class CalibratedModel:
    """A model and a sigmoid (slope, offset) per class for every fold."""
    folds: list[tuple[TextModel, dict[str, tuple[float, float]]]]


def fit_sigmoids(scored: DataFrame, iterations: int = 25) -> dict[str, tuple[float, float]]:
    """class -> (a, b) of p = 1 / (1 + exp(a * score + b)), by Newton steps.

    ``scored``: (name, value, hit) rows, one per text and class.  Targets are
    smoothed by the counts of both sides.  A step is one aggregate over the rows;
    the driver holds two numbers per class."""
    totals = {r["name"]: (r["pos"], r["n"] - r["pos"]) for r in scored.groupBy("name").agg(
        F.sum(F.col("hit").cast("int")).alias("pos"), F.count(F.lit(1)).alias("n")).collect()}
    params = {k: (0.0, math.log((neg + 1.0) / (pos + 1.0))) for k, (pos, neg) in totals.items()}
    if not params:
        return {}

    def per_class(values):
        return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("name"))
    target = F.when(F.col("hit"), per_class({k: (p + 1.0) / (p + 2.0) for k, (p, _) in totals.items()})) \
        .otherwise(per_class({k: 1.0 / (n + 2.0) for k, (_, n) in totals.items()}))
    rows = scored.select("name", "value", target.alias("t"))
    for _ in range(iterations):
        z = per_class({k: a for k, (a, _) in params.items()}) * F.col("value") + per_class({k: b for k, (_, b) in params.items()})
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
        d, w, v = F.col("t") - F.col("p"), F.col("p") * (F.lit(1.0) - F.col("p")), F.col("value")
        sums = rows.withColumn("p", p).groupBy("name").agg(
            F.sum(d * v).alias("ga"), F.sum(d).alias("gb"), F.sum(w * v * v).alias("haa"), F.sum(w * v).alias("hab"), F.sum(w).alias("hbb")).collect()
        moved = 0.0
        for r in sums:
            haa, hbb = r["haa"] + 1e-12, r["hbb"] + 1e-12
            det = haa * hbb - r["hab"] ** 2
            if det <= 1e-18:
                continue
            da, db = -(hbb * r["ga"] - r["hab"] * r["gb"]) / det, -(haa * r["gb"] - r["hab"] * r["ga"]) / det
            a, b = params[r["name"]]
            step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
            params[r["name"]] = (a + step * da, b + step * db)
            moved = max(moved, abs(da), abs(db))
        if moved < 1e-8:
            break
    return params


def fit_calibrated(train: DataFrame, label: str = "intent", folds: int = 3, **kw) -> CalibratedModel:
    """M4: a text's fold depends on the text alone, so copies share a fold."""
    rows = materialise(train.select("text", label)).withColumn("_fold", F.pmod(F.xxhash64("text"), F.lit(folds)))
    out = []
    for k in range(folds):
        model = fit(rows.where(F.col("_fold") != k).drop("_fold"), label, **kw)
        names = F.array(*[F.lit(c) for c in classes(model)])
        held = with_margins(model, rows.where(F.col("_fold") == k), "_z").select(
            F.col(label).alias("_truth"), F.explode(F.arrays_zip(names.alias("name"), F.col("_z").alias("value"))).alias("s"))
        held = materialise(held.select(F.col("s.name").alias("name"), F.col("s.value").alias("value"), (F.col("s.name") == F.col("_truth")).alias("hit")))
        out.append((model, fit_sigmoids(held)))
    return CalibratedModel(out)


def score_calibrated(model: CalibratedModel, df: DataFrame, top_k: int = 3) -> DataFrame:
    """As ``score``, with the mean of the folds' calibrated, normalised probabilities."""
    names = sorted({c for _, sig in model.folds for c in sig})
    cols, out = df.columns, df
    for k, (m, sig) in enumerate(model.folds):
        own = classes(m)
        p = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(sig[c][0]) * F.col(f"_z{k}")[own.index(c)] + F.lit(sig[c][1])))
             if c in own and c in sig else F.lit(0.0) for c in names]
        out = with_margins(m, out, f"_z{k}").withColumn(f"_p{k}", F.array(*p)).drop(f"_z{k}")
        out = out.withColumn(f"_t{k}", F.aggregate(f"_p{k}", F.lit(0.0), lambda a, v: a + v))
    share = [[F.coalesce(F.try_divide(F.col(f"_p{k}")[i], F.col(f"_t{k}")), F.lit(0.0)) for k in range(len(model.folds))] for i in range(len(names))]
    mean = F.array(*[sum(s) / len(model.folds) for s in share])
    return _decided(out, cols, mean, names, top_k)
