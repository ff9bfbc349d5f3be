"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``dims`` signs that its code point alone
decides, so no table of letters is learned or sent.  An n-gram's vector binds
its letters' vectors, each rotated by its place (signs multiply, which is XOR on
bits); a text's vector bundles (adds) those of all its n-grams; a language's
prototype bundles all its texts.  A text gets the language whose prototype has
the largest cosine with it.

Texts are read whole, as lower-cased letters; what stands between two runs of
letters, and either end, is one blank, which is a letter of the n-grams.
Combining marks are passed over.  A long text is bundled piece by piece.
Counts are exact whole numbers, so prototypes do not depend on the order of
addition.

1. ``prototypes``: tasks count n-grams by language, bundle them, and Spark adds
   the bundles of the tasks, a row for each language and slice of dimensions.
2. ``identify``: languages are met in groups of at most ``GROUP``, whose
   prototypes are sent to the tasks (``GROUP * dims`` numbers, whatever the
   data).  With more languages the best so far is written and goes on to the
   next group.

A null text, and one without a letter, is ``und`` with score 0, as is every text
when there was nothing to learn from.  The score is the cosine, at least 0;
equal cosines go to the first language in the alphabet.  An empty string is a
language like any other; rows with a null language are not learned from.
Repeated rows give equal rows, a null doc_id stays null and is not held out, and
an empty table gives an empty result.
"""
from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, seeds, text_runs

DIMS, ORDER = 2048, 3
UNKNOWN = "und"
#: Languages whose prototypes a task holds at once.
GROUP = 512
#: Characters of a block, n-gram vectors a worker keeps, and distinct n-grams it bundles at once.
BLOCK, KEPT = 1 << 19, 12_288
SLICE = 64

_POINTS = 0x110000
_MIX = seeds(2, 41)

_letters: np.ndarray | None = None
_held: dict[int, "GramVectors"] = {}


def letter_table() -> np.ndarray:
    """The lower-case letter of every code point; 0 where it is not a letter."""
    global _letters
    if _letters is None:
        table = np.zeros(_POINTS, np.int32)
        for c in range(_POINTS):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
            elif unicodedata.combining(s):
                table[c] = -1  # belongs to the letter before it: neither a letter nor a break
        _letters = table
    return _letters


def held_out(doc_id) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def letter_bits(codes: np.ndarray, dims: int) -> np.ndarray:
    """dims random bits, packed in bytes, of every code point."""
    with np.errstate(over="ignore"):
        word = np.arange(dims // 64, dtype=np.uint64)[None, :] + codes.astype(np.uint64)[:, None] * np.uint64(dims // 64) + np.uint64(1)
        z = word * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))) * _MIX[1]
    return (z ^ (z >> np.uint64(32))).view(np.uint8)


def _grams(code: np.ndarray) -> np.ndarray:
    """Every ORDER letters in a row as one number, 21 bits each."""
    n = max(len(code) - ORDER + 1, 0)
    gram = np.zeros(n, np.int64)
    for k in range(ORDER):
        gram = gram << 21 | code[k:n + k]
    return gram


def _letters_of(text: str) -> np.ndarray:
    code = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return code[code >= 0]


def _long_text(text: str, size: int) -> Iterator[np.ndarray]:
    """A text's n-grams, ``size`` characters at a time; the last letters go on to the next piece."""
    tail = np.zeros(1, np.int64)
    for a in range(0, len(text) + 1, size):
        code = np.append(_letters_of(text[a:a + size]), [0] if a + size > len(text) else []).astype(np.int64)
        keep = (code > 0) | (np.append(tail[-1:], code[:-1]) > 0) if len(code) else np.zeros(0, bool)
        whole = np.append(tail, code[keep])
        yield _grams(whole)
        tail = whole[-max(ORDER - 1, 1):]


def grams_of(texts: list[str], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row number and n-gram at every position of the texts; one long text comes in pieces."""
    if len(texts) == 1 and len(texts[0]) > size:
        for gram in _long_text(texts[0], size):
            yield np.zeros(len(gram), np.int64), gram
        return
    lens = np.array([len(t) + 2 for t in texts], np.int64)
    code = letter_table()[np.frombuffer(("\0" + "\0\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), lens)
    code, row = code[code >= 0].astype(np.int64), row[code >= 0]
    keep = (code > 0) | np.append(True, row[1:] != row[:-1]) | (np.append(0, code[:-1]) > 0)
    code, row = code[keep], row[keep]
    gram = _grams(code)
    inside = row[:len(gram)] == row[len(row) - len(gram):]
    yield row[:len(gram)][inside], gram[inside]


def _numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and each position's place among them; counting where the letters are few."""
    letters, at = [], []
    for k in range(ORDER):
        c = gram >> 21 * (ORDER - 1 - k) & 0x1FFFFF
        seen = np.zeros(int(c.max(initial=0)) + 1, bool)
        seen[c] = True
        letters.append(np.flatnonzero(seen))
        place = np.cumsum(seen) - 1
        at.append(place[c])
    size = np.prod([len(x) for x in letters])
    if size > 4 * len(gram) + 1_000_000:
        return np.unique(gram, return_inverse=True)
    flat = at[0]
    for k in range(1, ORDER):
        flat = flat * len(letters[k]) + at[k]
    seen = np.zeros(size, bool)
    seen[flat] = True
    there = np.flatnonzero(seen)
    rest, distinct = there, np.zeros(len(there), np.int64)
    for k in reversed(range(ORDER)):
        distinct |= letters[k][rest % len(letters[k])] << 21 * (ORDER - 1 - k)
        rest = rest // len(letters[k])
    return distinct, (np.cumsum(seen) - 1)[flat]


class GramVectors:
    """Vectors of n-grams as signs; the ones met last are kept, up to a bound."""

    def __init__(self, dims: int, kept: int = KEPT):
        self.dims, self.kept = dims, kept
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.signs = np.zeros((kept, dims), np.float32)

    def make(self, grams: np.ndarray) -> np.ndarray:
        """Rows of +1 and -1: the letters' bits, rotated by the letter's place, bound by XOR."""
        bits = np.zeros((len(grams), self.dims // 8), np.uint8)
        for k in range(ORDER):
            letters, at = np.unique(grams >> 21 * (ORDER - 1 - k) & 0x1FFFFF, return_inverse=True)
            turned = np.roll(np.unpackbits(letter_bits(letters, self.dims), axis=1), ORDER - 1 - k, axis=1)
            bits ^= np.packbits(turned, axis=1)[at]
        return 1 - 2 * np.unpackbits(bits, axis=1).astype(np.float32)

    def places(self, grams: np.ndarray) -> np.ndarray | None:
        """Where the vectors of distinct n-grams stand in ``signs``; None if they do not fit."""
        new = np.setdiff1d(grams, self.known, assume_unique=True)
        if len(self.known) + len(new) > self.kept:
            self.known, self.place, new = np.zeros(0, np.int64), np.zeros(0, np.int64), np.sort(grams)
            if len(new) > self.kept:
                return None
        if len(new):
            at = np.arange(len(self.known), len(self.known) + len(new))
            self.signs[at] = self.make(new)
            known, place = np.concatenate([self.known, new]), np.concatenate([self.place, at])
            order = np.argsort(known)
            self.known, self.place = known[order], place[order]
        return self.place[np.searchsorted(self.known, grams)]

    def bundles(self, row: np.ndarray, gram: np.ndarray, rows: int) -> np.ndarray:
        """Sum of the vectors of every row's n-grams (fewer than 2^24, so exact in single precision)."""
        if not len(gram):
            return np.zeros((rows, self.dims), np.float32)
        distinct, at = _numbered(gram)
        place = self.places(distinct)
        if place is not None:
            used = len(self.known)
            count = np.bincount(row * used + place[at], minlength=rows * used).reshape(rows, used)
            return count.astype(np.float32) @ self.signs[:used]
        out = np.zeros((rows, self.dims), np.float32)
        for a in range(0, len(distinct), 2048):
            there, n = (at >= a) & (at < a + 2048), min(2048, len(distinct) - a)
            count = np.bincount(row[there] * n + at[there] - a, minlength=rows * n).reshape(rows, n)
            out += count.astype(np.float32) @ self.make(distinct[a:a + n])
        return out


def vectors_for(dims: int) -> GramVectors:
    """This worker process's n-gram vectors."""
    if dims not in _held:
        _held[dims] = GramVectors(dims)
    return _held[dims]


def prototypes(docs: DataFrame, dims: int = DIMS) -> DataFrame:
    """lang, part and SLICE sums: the bundled n-grams of all rows (text, lang) with a language."""
    cols = [f"s{i}" for i in range(SLICE)]

    def batch_of(sums: dict):
        parts = dims // SLICE
        flat = np.concatenate([v.reshape(parts, SLICE) for v in sums.values()])
        langs = pa.array([k for k in sums for _ in range(parts)], pa.string())
        return pa.RecordBatch.from_arrays([langs, pa.array(np.tile(np.arange(parts, dtype=np.int32), len(sums))),
                                           *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(SLICE)]], names=["lang", "part", *cols])

    def work(batches):
        held, sums = vectors_for(dims), {}
        for batch in batches:
            for a, b, texts in text_runs(batch.column(0), BLOCK):
                names = batch.column(1).slice(a, b - a).to_pylist()
                number = {name: i for i, name in enumerate(dict.fromkeys(names))}
                own = np.array([number[x] for x in names], np.int64)
                for row, gram in grams_of(texts):
                    bundle = held.bundles(own[row], gram, len(number)).astype(np.int64)
                    for name, i in number.items():
                        sums[name] = sums.get(name, 0) + bundle[i]
                if len(sums) > GROUP:
                    yield batch_of(sums)
                    sums = {}
        if sums:
            yield batch_of(sums)
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = known.mapInArrow(work, "lang string, part int, " + ", ".join(f"{c} long" for c in cols))
    return rows.groupBy("lang", "part").agg(*[F.sum(c).alias(c) for c in cols])


def _group(sums: DataFrame, after: str | None, size: int, dims: int) -> tuple[list[str], np.ndarray]:
    """The next languages in the alphabet and their prototypes at unit length: at most ``size`` of them."""
    there = sums if after is None else sums.where(F.col("lang") > after)
    names = sorted(r.lang for r in there.select("lang").distinct().orderBy("lang").limit(size).collect())
    if not names:
        return [], np.zeros((0, dims))
    out = np.zeros((len(names), dims))
    at = {name: i for i, name in enumerate(names)}
    for r in there.where((F.col("lang") <= names[-1])).toLocalIterator():
        out[at[r[0]], r[1] * SLICE:(r[1] + 1) * SLICE] = r[2:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.where(length > 0, length, 1)


def _score(rows: DataFrame, names: list[str], unit: np.ndarray, dims: int) -> DataFrame:
    """rows (doc_id, text, lang_pred, score) with the better of what they have and these languages."""
    def work(batches: Iterator[pa.RecordBatch]):
        held = vectors_for(dims)
        for batch in batches:
            for a, b, texts in text_runs(batch.column(1), BLOCK):
                part = batch.slice(a, b - a)
                old, cos = part.column(2).to_pylist(), part.column(3).to_numpy().copy()
                bundle, some = np.zeros((len(texts), dims)), np.zeros(len(texts), bool)
                for row, gram in grams_of(texts):
                    bundle += held.bundles(row, gram, len(texts))
                    some[row] = True
                length = np.linalg.norm(bundle, axis=1)
                near = bundle @ unit.T / np.where(length > 0, length, 1)[:, None]
                best = near.argmax(axis=1)
                value = np.clip(near[np.arange(len(texts)), best], 0.0, 1.0)
                lang = [names[j] if s and (o is None or v > c) else o for j, s, o, v, c in zip(best.tolist(), some, old, value, cos)]
                cos = np.where(some & (np.array([o is None for o in old]) | (value > cos)), value, cos)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(cos)],
                                                 names=["doc_id", "text", "lang_pred", "score"])
    return rows.mapInArrow(work, "doc_id long, text string, lang_pred string, score double")


def identify(docs: DataFrame, sums: DataFrame, dims: int = DIMS, group: int = GROUP) -> DataFrame:
    """doc_id, lang_pred and score of every row (doc_id, text) from the prototypes' sums."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    names, unit = _group(sums, None, group, dims)
    while names:
        rows = _score(rows, names, unit, dims)
        names, unit = _group(sums, names[-1], group, dims) if len(names) == group else ([], unit)
        if names:
            rows = materialise(rows)
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), "score")


def classify(docs: DataFrame, dims: int = DIMS, group: int = GROUP) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from those that are not held out."""
    sums = materialise(prototypes(docs.where(~held_out(F.col("doc_id"))), dims))
    found = identify(docs, sums, dims, group)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
