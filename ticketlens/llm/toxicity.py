"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is lower-cased and cut into words; each word gives its character n-grams
(with its edges) and each n-gram a vector.  The vectors of a bag, a word and its
neighbours, are averaged into a linear softmax, so an unseen misspelling scores
by the n-grams it shares with words seen.  A document scores as its worst bag:
the whole text counts, and length does not wash a passage out.

Vectors and softmax are trained jointly in numpy on a bounded sample of labelled
rows (``TRAIN_DOCS`` documents and ``TRAIN_CHARS`` characters of each class); a
text too long for what is left is passed over, and the drawing goes on.
Training weighs the bags of a document by a softmax of their own logits that
sharpens, from all bags alike to the worst one.  For scoring, the vectors fold
into one number per n-gram, so a score needs a lookup per n-gram and no more.

Null and empty texts and texts without a word score as a bag of nothing, far
below any threshold.  Labels, lang, source and doc_id are never inputs.  Without
labelled rows of both classes every score is 0.  Repeated label rows count as
one vote each, 1 if most say so.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_names, materialise, released, runs, seeds, text_runs

#: The bound of the training sample, for each class.
TRAIN_DOCS, TRAIN_CHARS = 1500, 2_000_000
BUCKET_BITS, DIM, NGRAMS = 18, 8, (3, 4, 5)
#: Training steps with bags of a word and so many neighbours on each side; scores use the last reach.
SCHEDULE = ((2, 50), (1, 40), (0, 40))
RATE, DECAY = 1.0, 1e-3
THRESHOLD = 0.7
_P, _K = int(seeds(1, 21)[0]), seeds(2, 22)


@dataclass
class Bags:
    """N-grams of a run of texts: buckets by n-gram, their word, and each word's text."""
    buckets: np.ndarray    # of every n-gram, by position
    word: np.ndarray       # the word that each n-gram belongs to
    text: np.ndarray       # the text of each word


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower case of each letter and digit below 0x10000; 32 for all else."""
    if not _letters:
        table = np.full(0x10000, 32, np.uint32)
        for c in range(0x10000):
            s = chr(c)
            if s.isalnum():
                low = s.lower()
                table[c] = ord(low[0])
        _letters.append(table)
    return _letters[0]


def bags(texts: list[str]) -> Bags:
    joined = " " + " ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(chars < 0x10000, _letter_table()[np.minimum(chars, 0xFFFF)], chars)
    gap = c == 32
    n = len(c)
    before = np.concatenate([[0], np.cumsum(gap)])
    v = (c.astype(np.uint64) + _K[0]) * _K[1]
    v ^= v >> np.uint64(33)
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])          # the gap before each word
    word_at = np.cumsum(np.concatenate([[False], gap[:-1] & ~gap[1:]])) - 1
    text_start = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    buckets, words = [], []
    h, power = v.copy(), 1
    for k in range(2, max(NGRAMS) + 1):
        power = power * _P % (1 << 64)
        if n < k:
            break
        h = h[:n - k + 1] + v[k - 1:] * np.uint64(power)
        if k not in NGRAMS:
            continue
        inner = before[k - 1:n] - before[1:n - k + 2]      # gaps strictly inside
        at = np.flatnonzero(inner == 0)
        x = (h[at] ^ (h[at] >> np.uint64(29))) * (_K[0] | np.uint64(k << 1))
        buckets.append((x >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        words.append(np.where(gap[at], word_at[np.minimum(at + 1, n - 1)], word_at[at]))
    text = np.searchsorted(text_start, starts + 1, side="right") - 1
    if not buckets:
        return Bags(np.zeros(0, np.int32), np.zeros(0, np.int64), text)
    return Bags(np.concatenate(buckets), np.concatenate(words), text)


def _bags_in_blocks(texts: list[str]) -> Bags:
    """``bags`` of many texts, cut a block at a time."""
    parts, n_words = [], 0
    for a, b in runs(np.array([len(t) for t in texts], np.int64), 1 << 18):
        p = bags(texts[a:b])
        parts.append((p.buckets, (p.word + n_words).astype(np.int32), p.text + a))
        n_words += len(p.text)
    return Bags(*(np.concatenate(c) for c in zip(*parts)))


def _total(index: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values[of] by index, a slice at a time."""
    out = np.zeros(n)
    for a in range(0, len(index), 1 << 20):
        out += np.bincount(index[a:a + (1 << 20)], weights=values[of[a:a + (1 << 20)]], minlength=n)
    return out


def _neighbours(values: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """Sum of each word's value and those of its neighbours in the same text."""
    out = values.copy()
    for d in range(1, reach + 1):
        same = text[d:] == text[:-d]
        out[d:] += np.where(same, values[:-d], 0)
        out[:-d] += np.where(same, values[d:], 0)
    return out


def bag_logits(b: Bags, s: np.ndarray, bias: float, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Logit and n-gram count of the bag around every word."""
    n = len(b.text)
    count = _neighbours(np.bincount(b.word, minlength=n).astype(np.float64), b.text, reach)
    total = _neighbours(_total(b.word, b.buckets, s, n), b.text, reach)
    return total / np.maximum(count, 1) + bias, count


@dataclass
class Model:
    vectors: np.ndarray    # n-gram buckets x DIM
    softmax: np.ndarray    # DIM x 2
    bias: np.ndarray       # 2

    def folded(self) -> tuple[np.ndarray, float]:
        u = self.softmax[:, 1] - self.softmax[:, 0]
        return (self.vectors @ u).astype(np.float32), float(self.bias[1] - self.bias[0])

    def scores(self, texts: list[str]) -> np.ndarray:
        return score_texts(texts, *self.folded())


def score_texts(texts: list[str], s: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), -30.0)
    b = bags(texts)
    if len(b.text):
        z, _ = bag_logits(b, s, bias, SCHEDULE[-1][0])
        np.maximum.at(out, b.text, z)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax, jointly, by normalised gradient steps over the whole sample."""
    rng = np.random.default_rng(seed)
    b = _bags_in_blocks(texts)
    n_docs, y = len(texts), labels.astype(np.float64)
    cost = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    has = np.unique(b.text)
    first = np.searchsorted(b.text, has)
    vectors = rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM))
    softmax = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    for epoch, reach in enumerate(r for r, n in SCHEDULE for _ in range(n)):
        u = softmax[:, 1] - softmax[:, 0]
        z, count = bag_logits(b, vectors @ u, bias[1] - bias[0], reach)
        sharp = min(4.0, 4.0 * epoch / SCHEDULE[0][1])
        w = z * sharp
        w = np.exp(w - np.repeat(np.maximum.reduceat(w, first), np.diff(np.append(first, len(w)))))
        w /= np.repeat(np.add.reduceat(w, first), np.diff(np.append(first, len(w))))
        doc = np.zeros(n_docs)
        doc[has] = np.add.reduceat(w * z, first)
        g = (1 / (1 + np.exp(-np.clip(doc, -30, 30))) - y) * cost
        per_bag = g[b.text] * w
        per_word = _neighbours(per_bag / np.maximum(count, 1), b.text, reach)
        grad = _total(b.buckets, b.word, per_word, 1 << BUCKET_BITS)
        g_bias = g.sum()
        g_u = vectors.T @ grad
        step = RATE / max(np.abs(grad).max(), 1e-12)
        vectors *= 1 - DECAY
        vectors -= step * np.outer(grad, u) / max(u @ u, 1e-9)
        softmax[:, 1] -= 0.1 * g_u / max(np.abs(g_u).max(), 1e-12) * 0.1
        softmax[:, 0] += 0.1 * g_u / max(np.abs(g_u).max(), 1e-12) * 0.1
        bias[1] -= 2.0 * g_bias
        bias[0] += 2.0 * g_bias
    return Model(vectors, softmax, bias)


def held_out(doc_id) -> Column:
    """Rows that training never sees: remainder 1 of the id's CRC-32 modulo 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def drawn(sizes: DataFrame, docs: int, chars: int) -> list[int]:
    """doc_ids of one class in draw order: a text that does not fit what is left of ``chars`` is passed over and drawing goes on.

    ``sizes`` has doc_id, draw and n (characters).  Where no text fits, the shortest is drawn all the same.
    """
    ids, left, after = [], chars, None
    while len(ids) < docs:
        rows = sizes.where(F.col("n") <= left)
        if after is not None:  # only texts with a character use up what others left
            rows = rows.where((F.col("n") > 0) & ((F.col("draw") > after[0]) | ((F.col("draw") == after[0]) & (F.col("doc_id") > after[1]))))
        some = rows.orderBy("draw", "doc_id").limit(docs).collect()
        for r in some:
            if r["n"] <= left and len(ids) < docs:
                ids.append(r["doc_id"])
                left -= r["n"]
        if len(some) < docs:
            break
        after = some[-1]["draw"], some[-1]["doc_id"]
    return ids or [r["doc_id"] for r in sizes.orderBy("n", "draw", "doc_id").limit(1).collect()]


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most TRAIN_DOCS rows and TRAIN_CHARS characters of each class (one text at least)."""
    votes = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    length = documents(docs).select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.min("n").alias("n"))
    votes = materialise(votes.where(~held_out(F.col("doc_id"))).join(length, "doc_id").withColumn("draw", F.xxhash64("doc_id")))
    chosen = [i for k in (0, 1) for i in drawn(votes.where(F.col("toxic") == k), TRAIN_DOCS, TRAIN_CHARS)]
    if not chosen:
        return [], np.zeros(0, np.int64)
    picked = votes.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(chosen, pa.int64())}))), "doc_id")  # at most 2 * TRAIN_DOCS rows
    rows = documents(docs).withColumn("n", F.length("text")).join(F.broadcast(picked), ["doc_id", "n"]).dropDuplicates(["doc_id"])
    got = rows.select("text", "toxic").orderBy("draw", "doc_id").collect()
    return [r["text"] for r in got], np.array([r["toxic"] for r in got], np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None where one class has no labelled row."""
    texts, y = training_sample(docs, labels)
    return train(texts, y) if len(set(y.tolist())) == 2 else None


def with_scores(docs: DataFrame, model: Model | None, column: str) -> DataFrame:
    """All columns of ``docs`` and the score of the text."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model.folded())  # 2 ** BUCKET_BITS numbers
    names, at = docs.columns, docs.columns.index("text")

    def work(batches):
        s, bias = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for a, b, texts in text_runs(batch.column(at), 1 << 18):
                out[a:b] = score_texts(texts, s, bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, column])
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(released(work), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_scores(documents(docs), fit(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold; all columns stay, whatever their names."""
    named = docs.withColumn("text", F.col("text").cast("string"))
    score, = free_names(docs.columns, "toxicity")
    return with_scores(named, fit(docs, labels), score).where(F.col(score) < threshold).drop(score)
