"""Language identification by smoothed trigram probabilities.

``fit`` counts letter trigrams of all labelled text by language and gives every
trigram the logarithm of its add-one probability ``(n + 1) / (total + distinct)``,
with ``distinct`` over all languages; a trigram that a language has not seen gets
that of n = 0.  ``detect`` adds them up over a text's trigrams and takes the best
language.  A text whose best two languages differ by less than ``MARGIN`` for each
trigram, and one without a trigram, falls back to its script (B13).

Logarithms are kept as whole millionths, so sums do not depend on their order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_language
from .similar import materialise

#: One unit of a logarithm, and the least lead for each trigram.
UNIT, MARGIN = 1_000_000, 50_000


def words(text: Column) -> Column:
    """Every lower-cased run of letters."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), "")


def trigrams(word: Column) -> Column:
    """Trigrams of a word with a space at either end.

    Words are short, so cutting them is linear in the text (cutting the text
    itself by position would count characters from its start each time)."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, gain and unseen: what a trigram adds over an unseen one, and what an unseen one weighs.
    Equal words of a language are cut once."""
    held = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(words(F.col(text))).alias("word"))
    held = held.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("k"))
    grams = held.select("lang", "k", F.explode(trigrams(F.col("word"))).alias("gram"))
    counts = materialise(grams.groupBy("lang", "gram").agg(F.sum("k").alias("n")))
    distinct = counts.agg(F.count_distinct("gram").alias("distinct"))
    size = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("_d", distinct.scalar())

    def weight(n):
        return F.round(F.log((n + 1.0) / (F.col("total") + F.col("_d"))) * UNIT).cast("long")
    sized = counts.join(F.broadcast(size), "lang")  # a row a language
    return sized.select("lang", "gram", (weight(F.col("n")) - weight(F.lit(0))).alias("gain"), weight(F.lit(0)).alias("unseen"))


def detect(df: DataFrame, profiles: DataFrame, id_col: str, text: str = "text", margin: int = MARGIN) -> DataFrame:
    """id, language_code, language_lead (millionths for each trigram, null without a second language);
    ties go to the first code in the alphabet."""
    # A word's gains are added up once, in the order of the languages (a row a language).
    names = sorted(r["lang"] for r in profiles.select("lang").distinct().collect())
    held = df.select(id_col, F.explode(words(F.col(text))).alias("word"))
    known = held.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    gained = known.join(profiles.select("lang", "gram", "gain"), "gram").groupBy("word").agg(
        *[F.coalesce(F.sum(F.when(F.col("lang") == n, F.col("gain"))), F.lit(0)).alias(f"_g{i}") for i, n in enumerate(names)])
    sums = held.join(gained, "word").groupBy(id_col).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(len(names))])
    each = F.array(*[F.struct(F.lit(n).alias("lang"), F.col(f"_g{i}").alias("gain")) for i, n in enumerate(names)]).cast("array<struct<lang:string,gain:bigint>>")
    gains = sums.select(id_col, F.inline(each))
    letters = F.aggregate(words(F.col(text)), F.lit(0).cast("long"), lambda n, w: n + F.length(w))  # a trigram each
    total = df.groupBy(id_col).agg(F.sum(letters).alias("_n")).where("_n > 0")
    unseen = profiles.groupBy("lang").agg(F.first("unseen").alias("unseen")).agg(F.collect_list(F.struct("lang", "unseen")).alias("_u"))  # a row a language
    every = total.withColumn("_u", unseen.scalar()).select(id_col, "_n", F.inline("_u"))
    score = F.coalesce(F.col("gain"), F.lit(0)) + F.col("_n") * F.col("unseen")
    ranked = every.join(gains, [id_col, "lang"], "left").groupBy(id_col, "_n").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("s"), "lang"))), 1, 2).alias("_b"))  # a row a language
    best, second = F.get("_b", F.lit(0)), F.get("_b", F.lit(1))
    lead = ranked.select(id_col, best["lang"].alias("_lang"), F.floor((second["s"] - best["s"]) / F.col("_n")).alias("language_lead"))
    sure = F.when(F.coalesce(F.col("language_lead") >= margin, F.lit(True)), F.col("_lang"))
    return df.select(id_col, text).join(lead, id_col, "left").select(
        id_col, F.coalesce(sure, script_language(F.col(text))).alias("language_code"), "language_lead")
