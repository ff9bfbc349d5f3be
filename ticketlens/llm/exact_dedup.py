"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks.  Every chunk is hashed by itself as a
polynomial over several primes, and chunk hashes combine by length-shifted
arithmetic, ``H(ab) = H(a) * B**len(b) + H(b)``.  Texts of up to ``ROW_PART``
bytes are combined in the task that reads them; the parts of longer ones go to
many tasks as rows and are combined by a sum (``combine_chunks``).  Texts with
equal fingerprints and lengths are then compared chunk by chunk; only if a chunk
differs does the text itself become the key.

Nulls count as empty texts; empty texts are equal to each other.  A row is known
by its doc_id, which may be null, and its text's SHA-256: rows may share an id
with different texts.  Rows that repeat both are members of the group, and one of
them is kept.  A null doc_id counts as the smallest.  An empty table gives an
empty result.  Other columns may have any name.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, free_names, materialise, parts_for, released, runs, segments, utf8

#: Primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1566083941, 1812433253, 1664525017)
HASH_CHUNK = 4096
#: Bytes of a chunk in the comparison.
COMPARE_CHUNK = 1 << 16
#: Longer texts are hashed in parts of so many bytes, by many tasks.
ROW_PART = 1 << 20

PRINTS = "doc_id long, n_bytes long, fp_hi long, fp_lo long, text_sha256 string"
KEY = ["n_bytes", "fp_hi", "fp_lo"]


def _powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo prime."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, primes=PRIMES, chunk: int = HASH_CHUNK) -> list[np.ndarray]:
    """A residue for each prime of every text data[offsets[i]:offsets[i + 1]]."""
    n = np.diff(offsets)
    out = [np.zeros(len(n), np.uint64) for _ in primes]
    full = np.flatnonzero(n)
    if not len(full):
        return out
    chunks = -(-n[full] // chunk)
    number = segments(np.zeros(len(full), np.int64), chunks)
    start = np.repeat(offsets[:-1][full], chunks) + number * chunk
    stop = np.minimum(start + chunk, np.repeat(offsets[1:][full], chunks))
    behind = np.repeat(offsets[1:][full], chunks) - stop
    owner = np.cumsum(chunks) - chunks
    body = data[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)
    place = np.repeat(stop - 1, stop - start) - segments(start, stop - start)
    for k, prime in enumerate(primes):
        table = _powers(BASES[k], prime, np.arange(chunk))
        hashed = np.add.reduceat(body * table[place], start - offsets[0]) % np.uint64(prime)
        shifted = hashed * _powers(BASES[k], prime, behind) % np.uint64(prime)
        out[k][full] = np.add.reduceat(shifted, owner) % np.uint64(prime)
    return out


def _printed(rows: DataFrame, primes) -> DataFrame:
    """PRINTS of rows (doc_id, text), each hashed in its task."""
    def work(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = batch.column(0)
            for a, b in runs(np.diff(off)):
                hi0, lo0, hi1, lo1 = [*fingerprints(data, off[a:b + 1], primes), *[np.zeros(b - a, np.uint64)] * (4 - len(primes))]
                sha = [hashlib.sha256(data[s:e].tobytes()).hexdigest() for s, e in zip(off[a:b].tolist(), off[a + 1:b + 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(np.diff(off[a:b + 1])), pa.array((hi0 << np.uint64(31) | lo0).astype(np.int64)),
                     pa.array((hi1 << np.uint64(31) | lo1).astype(np.int64)), pa.array(sha, pa.string())],
                    names=["doc_id", "n_bytes", "fp_hi", "fp_lo", "text_sha256"])
    return rows.mapInArrow(released(work), PRINTS)


def fingerprint_table(docs: DataFrame, primes=PRIMES, part: int = ROW_PART) -> DataFrame:
    """doc_id, n_bytes, fingerprint and SHA-256 of every row; the texts stay behind."""
    rows = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = _printed(rows.where(F.col("n_bytes") <= part).select("doc_id", "text"), primes)
    long = rows.where(F.col("n_bytes") > part).select("doc_id", "n_bytes", F.encode("text", "UTF-8").alias("body"), F.sha2("text", 256).alias("text_sha256"))
    cut = F.expr(f"transform(sequence(0, cast((n_bytes - 1) / {part} as int)), i -> substring(body, i * {part} + 1, {part}))")
    parts = long.select("text_sha256", "n_bytes", F.posexplode(cut).alias("chunk_no", "bytes"))
    behind = F.greatest(F.col("n_bytes") - (F.col("chunk_no").cast("long") + 1) * part, F.lit(0))
    dealt = parts.withColumn("behind", behind).drop("n_bytes").repartition("text_sha256", "chunk_no")
    whole = combine_chunks(dealt, primes, "text_sha256")
    r = [F.col(f"r{k}") if k < len(primes) else F.lit(0).cast("long") for k in range(4)]
    prints = whole.select("text_sha256", (F.shiftleft(r[0], 31).bitwiseOR(r[1])).alias("fp_hi"), F.shiftleft(r[2], 31).bitwiseOR(r[3]).alias("fp_lo"))
    joined = long.select("doc_id", "n_bytes", "text_sha256").join(prints, "text_sha256").select("doc_id", "n_bytes", "fp_hi", "fp_lo", "text_sha256")
    return short.unionByName(joined)


def combine_chunks(chunks: DataFrame, primes=PRIMES, key: str = "doc_id") -> DataFrame:
    """Fingerprints of texts that lie in many rows (key, chunk_no, bytes): chunks are hashed in
    parallel and shifted by the bytes behind them; the combination is a plain sum.

    A column ``behind`` with that number saves the pass that finds it.  Rows that repeat key and
    chunk_no are one."""
    kind = dict(chunks.dtypes)[key]
    if "behind" in chunks.columns:
        sized = chunks
    else:
        after = Window.partitionBy(key).orderBy(F.desc("chunk_no")).rowsBetween(Window.unboundedPreceding, -1)
        sized = chunks.withColumn("behind", F.coalesce(F.sum(F.octet_length("bytes")).over(after), F.lit(0)))

    def work(batches):
        for batch in batches:
            data, off = utf8(batch.column(2))
            after = batch.column(3).to_numpy()
            cols = [pa.array((h * _powers(BASES[k], p, after) % np.uint64(p)).astype(np.int64)) for k, (p, h) in
                    enumerate(zip(primes, fingerprints(data, off, primes)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), *cols],
                                             names=[key, "chunk_no", "n", *[f"r{k}" for k in range(len(primes))]])
    residues = [f"r{k}" for k in range(len(primes))]
    rows = sized.select(key, "chunk_no", "bytes", F.col("behind").cast("long")).mapInArrow(
        released(work), f"{key} {kind}, chunk_no int, n long, " + ", ".join(f"{r} long" for r in residues))
    once = rows.groupBy(key, "chunk_no").agg(F.max("n").alias("n"), *[F.max(r).alias(r) for r in residues])
    return once.groupBy(key).agg(F.sum("n").alias("n_bytes"), *[(F.sum(r) % p).alias(r) for r, p in zip(residues, primes)])


def _chunks(rows: DataFrame) -> DataFrame:
    """A row for each chunk of every text (an empty text has none)."""
    body = rows.select(*KEY, F.encode("text", "UTF-8").alias("body"))
    cut = F.expr(f"transform(sequence(0, cast((octet_length(body) - 1) / {COMPARE_CHUNK} as int)), i -> substring(body, i * {COMPARE_CHUNK} + 1, {COMPARE_CHUNK}))")
    return body.where(F.octet_length("body") > 0).select(*KEY, F.posexplode(cut).alias("chunk_no", "chunk"))


def exact_groups(docs: DataFrame, primes=PRIMES, part: int = ROW_PART) -> DataFrame:
    """One row per document: keep_id, group_size, kept and the text's SHA-256.

    Groups are aggregated before the shuffle, so a group that holds a third of all
    rows sends one row per task; the join back is a plain one that Spark can split.
    """
    parts = parts_for(docs)
    prints = materialise(fingerprint_table(docs, primes, part), parts)
    groups = prints.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    suspects = prints.join(groups.where("group_size > 1 and n_bytes > 0").select(*KEY), KEY, "left_semi")
    texts = documents(docs).withColumn("text_sha256", F.sha2("text", 256))

    def of_rows(wanted: DataFrame) -> DataFrame:
        """Every document of the wanted rows, once."""
        w = wanted.select("doc_id", "text_sha256", *KEY).distinct()
        same = texts["doc_id"].eqNullSafe(w["doc_id"]) & (texts["text_sha256"] == w["text_sha256"])
        return texts.join(w, same).select(*KEY, "text", texts["doc_id"])
    compared = _chunks(of_rows(suspects)).groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    clashes = materialise(compared.where("low <> high").select(*KEY).distinct(), parts)
    once = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("n_bytes"))
    rows = prints.withColumn("nth", once)
    if clashes.isEmpty():
        joined = rows.join(groups, KEY)
    else:  # different texts with one fingerprint: their texts are the key
        real = of_rows(suspects.join(clashes, KEY, "left_semi")).groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        real = real.select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
        joined = (rows.join(clashes, KEY, "left_anti").join(groups, KEY)
                  .unionByName(rows.join(clashes, KEY, "left_semi").join(real, "text_sha256"), allowMissingColumns=True))
    return joined.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without all copies but the one with the largest doc_id; all columns stay, whatever their names."""
    row, nth = free_names(docs.columns, "row", "nth")
    name = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"))
    kept = exact_groups(docs).where("kept").select(F.concat(name, "text_sha256").alias(row))
    marked = docs.withColumn(row, F.concat(name, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    number = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    return marked.join(kept, row, "left_semi").withColumn(nth, number).where(F.col(nth) == 1).select(*docs.columns)
