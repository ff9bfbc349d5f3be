"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model runs over characters as they are: every code point is a symbol of its
own, so its tables grow with the different n-grams of the trusted text.  Counts
come from all trusted text:

1. tasks count n-grams and Spark adds the shards up (``counts``);
2. continuation counts, count-of-counts, discounts and context masses are Spark
   aggregations, and joins of the count tables by language and context give each
   seen n-gram its discounted mass and each context its back-off (``tables``);
3. every document is scored by per-character perplexity with its language's
   tables; a row per position is not shuffled, the tables of seen n-grams are broadcast;
4. a language's threshold is a quantile of its trusted documents' perplexities,
   each drawn to the language's median as far as the text is short.

A language without trusted text, or a null one, uses the model and threshold of
all languages together.  An empty or null text has no perplexity and is not
kept.  Without any trusted text every perplexity is that of a uniform model and
nothing with a character is rejected.  A document is trusted when all of its label
rows say so; repeated rows are scored alike; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, materialise, runs

#: Symbols: a code point is itself + 2, and PAD stands before a text.
A, ORDER = 0x110000 + 2, 4
PAD, BITS = 1, 21
MASK = (1 << BITS) - 1
QUANTILE = 0.999
#: A text counts as this many characters longer, at its language's usual perplexity: a few odd words are no evidence.
PRIOR_CHARS = 64
ALL = "*"

def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    return np.arange(2, A, dtype=np.uint32)


def ngram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of the n-gram that ends at every character, text after text, and characters of each.

    A context is the symbols before it, BITS each, the last one lowest."""
    pad = "\n" * (ORDER - 1)
    s = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 2
    lens = np.array([len(t) for t in texts], np.int64)
    real = np.ones(len(s), bool)
    starts = np.cumsum(lens + ORDER - 1) - lens
    for k in range(1, ORDER):
        real[starts - k] = False
    s[~real] = PAD
    context = np.zeros(len(s), np.int64)
    for k in range(1, ORDER):
        context[k:] |= s[:-k] << BITS * (k - 1)
    return context[real], s[real], lens


def distinct(context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams, and which of them each one is."""
    heads, at = np.unique(context, return_inverse=True)
    keys, where = np.unique(at.astype(np.int64) << BITS | symbol, return_inverse=True)
    return heads[keys >> BITS], keys & MASK, where


def _by_language(batch, most=BLOCK):
    """(language, rows of the batch) in blocks of bounded text."""
    langs = batch.column(1).to_pylist()
    texts = batch.column(2).to_pylist()
    order = sorted(range(len(langs)), key=lambda i: langs[i])
    for a, b in runs(np.array([len(texts[i]) for i in order], np.int64), most):
        at = a
        while at < b:
            stop = at
            while stop < b and langs[order[stop]] == langs[order[at]]:
                stop += 1
            yield langs[order[at]], order[at:stop], [texts[i] for i in order[at:stop]]
            at = stop


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(ALL)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def counts(trusted: DataFrame) -> DataFrame:
    """lang, ctx, s, c: n-grams of the highest order, by language and for all languages together."""
    def flush(held):
        for lang, parts in held.items():
            ctx, s, where = distinct(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            n = np.bincount(where, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
            for name in {lang, ALL}:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s), pa.string()), pa.array(ctx), pa.array(s), pa.array(n)], names=["lang", "ctx", "s", "c"])

    def work(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, _, texts in _by_language(batch):
                ctx, s, _ = ngram_codes(texts)
                ctx, s, where = distinct(ctx, s)
                held.setdefault(lang, []).append((ctx, s, np.bincount(where, minlength=len(s))))
                size += len(s)
                if size > 2_000_000:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)
    return _documents(trusted).mapInArrow(work, "lang string, ctx long, s long, c long").groupBy("lang", "ctx", "s").agg(F.sum("c").alias("c"))


def tables(ngrams: DataFrame) -> DataFrame:
    """lang, k, ctx, s, mass, back: the discounted mass of each seen n-gram of order k and its context's back-off."""
    level, out = ngrams, None
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # how many different symbols stand before it
            level = level.groupBy("lang", F.col("ctx").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("ctx"), "s").agg(F.count("*").alias("c"))
        level = materialise(level)
        n = [F.count(F.when(F.col("c") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
        coc = level.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

        def discount(i):
            usual = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            sound = (F.col("n1") > 0) & (F.col(f"n{i}") > 0) & (usual > 0)
            return F.when(sound, usual).otherwise(0.5 * i)
        discounts = coc.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        rows = level.join(F.broadcast(discounts), "lang").select(  # a row for each language
            "lang", "ctx", "s", "c",
            F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        context = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("taken"))
        level_out = rows.join(context, ["lang", "ctx"]).select(
            "lang", F.lit(k).alias("k"), "ctx", "s", ((F.col("c") - F.col("d")) / F.col("total")).alias("mass"), (F.col("taken") / F.col("total")).alias("back"))
        out = level_out if out is None else out.unionByName(level_out)
    return out


def lookup(ctx: np.ndarray, s: np.ndarray, mass: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
    """The n-grams of one order to search in: contexts and their back-off, n-grams by context and symbol and their mass."""
    heads, first, at = np.unique(ctx, return_index=True, return_inverse=True)
    keys = at.astype(np.int64) << BITS | s
    order = np.argsort(keys)
    return heads, back[first], keys[order], mass[order]


def _place(among: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in a sorted array that is not empty, and whether it is there."""
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return at, among[at] == of


def interpolate(orders: dict[int, tuple[np.ndarray, ...]], context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """-log2 of the n-grams' probabilities, from ``lookup`` of each order."""
    p = np.full(len(symbol), 1.0 / A)
    for k in range(1, ORDER + 1):
        if k in orders:
            heads, back, keys, mass = orders[k]
            at, known = _place(heads, context & ((1 << BITS * (k - 1)) - 1))
            j, seen = _place(keys, at.astype(np.int64) << BITS | symbol)
            p = np.where(known, back[at], 1.0) * p + np.where(known & seen, mass[j], 0.0)
    return -np.log2(p)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of every document."""
    found = model.toArrow()
    langs, k = found["lang"].combine_chunks().dictionary_encode(), found["k"].to_numpy()
    which, columns = langs.indices.to_numpy(), [found[c].to_numpy() for c in ("ctx", "s", "mass", "back")]
    given = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        own = [(n, np.flatnonzero((which == i) & (k == n))) for n in range(1, ORDER + 1)]
        given[lang] = {n: lookup(*(c[rows] for c in columns)) for n, rows in own if len(rows)}
    shared = docs.sparkSession.sparkContext.broadcast(given)

    def work(batches):
        given = shared.value
        for batch in batches:
            cost = np.zeros(batch.num_rows)
            size = np.zeros(batch.num_rows, np.int64)
            for lang, rows, texts in _by_language(batch):
                ctx, s, lens = ngram_codes(texts)
                ctx, s, where = distinct(ctx, s)
                bits = interpolate(given.get(lang if lang in given else ALL, {}), ctx, s)
                upto = np.concatenate([[0.0], np.cumsum(bits[where])])
                stops = np.concatenate([[0], np.cumsum(lens)])
                cost[rows] = np.diff(upto[stops])
                size[rows] = lens
            with np.errstate(invalid="ignore", divide="ignore"):
                ppl = 2 ** (cost / size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(ppl, mask=size == 0)],
                                             names=["doc_id", "lang", "n_chars", "perplexity"])
    return _documents(docs).mapInArrow(work, "doc_id long, lang string, n_chars long, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.coalesce(F.col("quality").cast("int"), F.lit(0))).alias("q")).where("q = 1").select("doc_id"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold and kept of every document."""
    good = materialise(trusted_ids(labels))
    # the trusted ids grow with the corpus: the same shuffle join at every size
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(good.hint("merge"), "doc_id", "left_semi")
    scored = materialise(score(docs, tables(counts(text))))
    bits = F.log2("perplexity")
    ours = scored.join(good, "doc_id", "left_semi").where("perplexity is not null")
    ours = ours.select(F.explode(F.array("lang", F.lit(ALL))).alias("of"), "n_chars", bits.alias("bits"))
    usual = ours.groupBy("of").agg(F.percentile_approx("bits", 0.5, 10_000).alias("usual"))

    def judged(rows):  # bits a character, drawn to the usual ones where the text is short
        return rows.withColumn("judged", (F.col("bits") * F.col("n_chars") + PRIOR_CHARS * F.col("usual")) / (F.col("n_chars") + PRIOR_CHARS))
    bounds = judged(ours.join(F.broadcast(usual), "of")).groupBy("of").agg(
        F.percentile_approx("judged", quantile, 10_000).alias("bound"), F.first("usual").alias("usual"))
    bounds = materialise(bounds)                                          # a row for each language
    common = bounds.where(F.col("of") == ALL).select("bound", "usual").collect() or [(None, None)]
    joined = scored.join(F.broadcast(bounds), F.col("lang") == F.col("of"), "left").withColumn("bits", bits)
    joined = judged(joined.withColumn("bound", F.coalesce("bound", F.lit(common[0][0]).cast("double")))
                    .withColumn("usual", F.coalesce("usual", F.lit(common[0][1]).cast("double"))))
    kept = F.col("perplexity").isNotNull() & (F.col("bound").isNull() | (F.col("judged") <= F.col("bound")))
    return joined.select("doc_id", F.when(F.col("lang") != ALL, F.col("lang")).alias("lang"), "n_chars", "perplexity",
                         F.pow(F.lit(2.0), "judged").alias("judged_perplexity"), F.pow(F.lit(2.0), "bound").alias("threshold"), kept.alias("kept"))
