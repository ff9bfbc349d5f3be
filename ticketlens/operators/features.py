"""TF-IDF features from a fitted vocabulary (M1, M2).

Two blocks of terms: word 1- and 2-grams without a stop list, and character
3- to 5-grams inside words padded by a space.  ``fit_vocabulary`` makes the
dictionary as a table: every term of a block with its document frequency, its
smoothed idf ``ln((1 + n) / (1 + df)) + 1`` and a number of its own, given by
sorting the terms over all partitions by range and adding each partition's
offset.  A text's features are ``(1 + ln tf) * idf``, of length one in each
block; terms outside the vocabulary are left out before that.

``compact`` shrinks a training problem without changing its optimum: texts with
equal features become one row with weights by label, and features that occur
alike in all rows become one column.  With a penalty on squared weights the
optimum gives m equal columns x equal weights, so one column x * sqrt(m) with
weight w * sqrt(m) stands for them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similar import TOKEN_RX, idf, materialise, text_parts

WORD, CHAR = "word", "char"

#: Character 3- to 5-grams of every word; a padded word shorter than n gives none, so a short word counts once.
CHAR_GRAMS = """flatten(transform(filter(split(lower({text}), '\\\\s+'), w -> w != ''), w ->
         flatten(transform(sequence(3, 5), n ->
           CASE WHEN length(concat(' ', w, ' ')) < n THEN array()
                ELSE transform(sequence(1, length(concat(' ', w, ' ')) - n + 1),
                               i -> substring(concat(' ', w, ' '), i, n)) END))))"""


def word_grams(text: str) -> Column:
    """Lower-cased words of two characters or more and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN_RX), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.lit(1 << 30)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.concat(words, F.array_compact(pairs))


def numbered(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """``df`` with rows numbered from 0 in the order of ``keys``: ranged over the partitions, whose offsets are added."""
    ranged = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    start, offsets = 0, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(start)]
        start += n
    base = F.try_element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return ranged.withColumn(name, (base + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def _grams(text: str, distinct: bool = False) -> Column:
    """(block, term) of every gram of a text, or of its different ones alone."""
    def of(block: str, grams: Column) -> Column:
        return F.transform(F.array_distinct(grams) if distinct else grams, lambda t: F.struct(F.lit(block).alias("block"), t.alias("term")))
    return F.concat(of(WORD, word_grams(text)), of(CHAR, F.expr(CHAR_GRAMS.format(text=text))))


def term_rows(df: DataFrame, row: str, text: str) -> DataFrame:
    """row, block, term, tf of every text; null texts have none.  Only texts are shuffled, not their terms."""
    source = df.select(F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("_text")).repartition("row")
    terms = source.select("row", F.explode(_grams("_text")).alias("t"))
    return terms.groupBy("row", F.col("t.block").alias("block"), F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def document_terms(df: DataFrame, text: str) -> DataFrame:
    """block, term: a row for each text and different term, all that ``fit_vocabulary`` reads.

    Texts are dealt evenly to tasks of bounded size; nothing is counted by row."""
    source = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).repartition(text_parts(df, text))
    return source.select(F.explode(_grams("_text", distinct=True)).alias("t")).select("t.block", "t.term")


def fit_vocabulary(terms: DataFrame, n_texts) -> DataFrame:
    """block, term, df, idf, idx from ``term_rows`` or ``document_terms``; n_texts (a number or scalar) counts all texts, empty ones too."""
    n = n_texts if isinstance(n_texts, Column) else F.lit(n_texts)
    df = terms.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df"))
    return numbered(df.withColumn("idf", idf(n, F.col("df"))), "block", "term", name="idx")


def feature_rows(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, block, idx, tf, x: the features of length one in each block."""
    w = terms.join(vocabulary.select("block", "term", "idf", "idx"), ["block", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row", "block")))
    return w.select("row", "block", "idx", "tf", (F.col("w") / norm).alias("x"))


def _sums(*of: str) -> list[Column]:
    """A 128-bit name of a set of rows: two sums of hashes."""
    return [F.sum(F.xxhash64(F.lit(k), *of).cast("decimal(20,0)")).alias(f"s{k}") for k in (0, 1)]


def compact(features: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, labels, columns) of a training problem; see the module text.

    ``features``: see ``feature_rows``.  ``labelled``: (row, label, weight), one of each
    row.  cells: (r, c, x) with rows and columns numbered from 0; labels: (r, label, weight);
    columns: (idx, c, m), each feature's column and how many share it.
    """
    features = materialise(features)
    rows = labelled.join(features.groupBy("row").agg(*_sums("idx", "tf")), "row", "left")
    key = [F.coalesce(c, F.lit(0)).alias(c) for c in ("s0", "s1")]  # rows without a feature are equal
    rows = materialise(rows.select("row", "label", "weight", *key))
    heads = numbered(rows.groupBy("s0", "s1").agg(F.min("row").alias("row")), "row", name="r")
    labels = rows.groupBy("s0", "s1", "label").agg(F.sum("weight").alias("weight")).join(heads.select("s0", "s1", "r"), ["s0", "s1"])
    kept = materialise(features.join(heads.select("row", "r"), "row").drop("row"))
    alike = kept.groupBy("block", "idx").agg(*_sums("r", "tf"))
    groups = alike.groupBy("block", "s0", "s1").agg(F.min("idx").alias("head"), F.count(F.lit(1)).alias("m"))
    groups = numbered(groups, "head", name="c")
    columns = materialise(alike.join(groups, ["block", "s0", "s1"]).select("idx", "head", "c", "m"))
    cells = kept.join(columns.where(F.col("idx") == F.col("head")), "idx").select("r", "c", (F.col("x") * F.sqrt("m")).alias("x"))
    return cells, labels.select("r", "label", "weight"), columns.select("idx", "c", "m")
