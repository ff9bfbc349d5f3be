"""Token ids in wavelet matrix files, one succinct and compressed file per shard.

Documents are ranged by doc_id and encoded; a task closes a shard when it holds
``shard_tokens`` ids, so a shard's size is bounded.  A shard keeps one plane of
bits per bit of an id, with ranks per block of bits, and answers access, rank,
select, counting and occurrence queries without the ids themselves.  Shards are
written by Spark's own writer, so a lost task leaves nothing half written.

Null texts are empty and have the end id alone.  Rows that repeat a doc_id lie
next to each other, the smaller text first.  A null doc_id comes first.  An
empty table gives no shard and an empty result.
"""
from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import BLOCK, documents, text_runs
from .words import table_for

SHARD_TOKENS = 1 << 22
RANK_BITS = 512
SHARDS = "first_doc long, part int, nth int, n_docs long, n_tokens long, content binary"


class WaveletMatrix:
    """Bit planes from the highest bit of an id down; zeros of a plane go before its ones."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self.planes, self.zeros = n, bits, planes, zeros
        self._ranks: list[np.ndarray | None] = [None] * bits

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            bit = (x >> k) & 1 != 0
            planes.append(np.packbits(bit, bitorder="little"))
            low = x[~bit]
            zeros.append(len(low))
            x = np.concatenate([low, x[bit]])
        return cls(len(ids), bits, planes, zeros)

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position: a stored count per block and a few bytes after it."""
        step = RANK_BITS // 8
        if self._ranks[level] is None:
            ones = np.bitwise_count(self.planes[level]).astype(np.int64)
            ones = np.append(ones, np.zeros(-len(ones) % step + step, np.int64)).reshape(-1, step).sum(axis=1)
            self._ranks[level] = np.cumsum(ones) - ones
        out = self._ranks[level][at // RANK_BITS].copy()
        byte = at // 8
        padded = np.append(self.planes[level], np.zeros(step, np.uint8))
        base = byte - byte % step
        for j in range(step):
            inside = base + j < byte
            if not inside.any():
                break
            out[inside] += np.bitwise_count(padded[(base + j)[inside]])
        mask = ((1 << (at % 8)) - 1).astype(np.uint8)
        return out + np.bitwise_count(padded[byte] & mask)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[level][at // 8] >> (at % 8).astype(np.uint8)) & 1

    def access(self, at) -> np.ndarray:
        """The ids at these positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, symbol: int, stop: int) -> tuple[int, int]:
        ends = np.array([0, stop], np.int64)
        for level in range(self.bits):
            ones = self._rank1(level, ends)
            ends = self.zeros[level] + ones if symbol >> (self.bits - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def rank(self, symbol: int, stop: int) -> int:
        """How often the id occurs before a position."""
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, stop)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of the id."""
        if symbol >> self.bits or k >= self.count(symbol):
            raise IndexError(k)
        at = self._range(symbol, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n                     # the position whose rank is `want` and whose bit fits
            while low < high:
                mid = (low + high) // 2
                ones = int(self._rank1(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) <= want:
                    low = mid + 1
                else:
                    high = mid
            at = low
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def all(self) -> np.ndarray:
        """Every id in order, from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            up = np.empty_like(x)
            up[~bit] = x[:self.zeros[level]]
            up[bit] = x[self.zeros[level]:] | x.dtype.type(1 << (self.bits - 1 - level))
            x = up
        return x.astype(np.uint32)


def to_file(ids: np.ndarray, docs: list[int | None], counts: np.ndarray) -> bytes:
    """Header length, header (JSON), then the compressed sections it lists."""
    m = WaveletMatrix.build(ids)
    pack = zstandard.ZstdCompressor(level=1)
    known = np.array([d is not None for d in docs], np.uint8)
    sections = [known.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), counts.astype("<u4").tobytes(), *(p.tobytes() for p in m.planes)]
    sections = [pack.compress(s) for s in sections]
    head = json.dumps({"format": "wavelet-matrix-1", "n": m.n, "bits": m.bits, "zeros": m.zeros, "sections": [len(s) for s in sections]}).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(sections)


def from_file(content: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    size = int.from_bytes(content[:4], "little")
    head = json.loads(content[4:4 + size])
    unpack, at, got = zstandard.ZstdDecompressor(), 4 + size, []
    for n in head["sections"]:
        got.append(unpack.decompress(content[at:at + n]))
        at += n
    known, docs = np.frombuffer(got[0], np.uint8), np.frombuffer(got[1], "<i8")
    m = WaveletMatrix(head["n"], head["bits"], [np.frombuffer(p, np.uint8) for p in got[3:]], head["zeros"])
    return m, [d if k else None for d, k in zip(docs.tolist(), known.tolist())], np.frombuffer(got[2], "<u4").astype(np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> None:
    """Shards in ascending doc_id order, a row with the file's bytes for each."""
    def work(batches):
        from pyspark import TaskContext

        table, part = table_for(tokenizer), TaskContext.get().partitionId()
        held, ids, lens, total, nth = [], [], [], 0, 0

        def shard():
            flat = np.concatenate(ids)
            body = to_file(flat, held, np.concatenate(lens))
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([len(held)], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([body], pa.binary())],
                names=["first_doc", "part", "nth", "n_docs", "n_tokens", "content"])
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in text_runs(batch.column(1), min(BLOCK, 2 * shard_tokens)):
                got, counts = table.encode(texts)
                ends = np.cumsum(counts)
                held += doc_ids[a:b]
                ids.append(np.insert(got, ends, end_id))
                lens.append(counts + 1)
                total += len(ids[-1])
                if total >= shard_tokens:
                    yield shard()
                    held, ids, lens, total, nth = [], [], [], 0, nth + 1
        if held:
            yield shard()
    ranged = documents(docs).repartitionByRange(F.col("doc_id").asc_nulls_first())
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(work, SHARDS).write.mode("errorifexists").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document."""
    files = spark.read.parquet(path)
    before = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", "nth", "n_tokens", "first_doc").withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def work(batches):
        for batch in batches:
            for part, nth, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                m, docs, counts = from_file(content)
                body = memoryview(m.all().astype("<u4")).cast("B")
                stops = np.cumsum(counts)
                crc = [zlib.crc32(body[(e - n) * 4:e * 4]) for e, n in zip(stops.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([nth] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                     pa.array(stops - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["part", "nth", "doc_id", "local", "n_tokens", "ids_crc32"])
    rows = files.select("part", "nth", "content").mapInArrow(work, "part int, nth int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(offsets.select("part", "nth", "offset"), ["part", "nth"]).select(
        "doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_file_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token_files/{uuid.uuid4().hex}"
