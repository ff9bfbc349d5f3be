"""Best-fit packing of documents into sequences by hierarchical residual packing.

Documents become items (token counts); longer ones are cut from the end, so only
the first piece may be shorter than a sequence.  Items are packed best-fit
decreasing within many groups at once.  Nearly full bins are emitted; the
underfull ones become items themselves and meet in fewer groups of the next
round, until one group is left or a round gains nothing.  A group holds a
bounded number of items in every round; only lengths and ids of pieces move,
never tokens.

A null text is empty and has its end id alone.  Repeated rows are packed as
documents of their own; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, documents, materialise, parts_for, released, text_runs
from .words import table_for

MEMBER = np.dtype([("doc_id", "<i8"), ("known", "i1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
ITEMS = "doc_id long, piece int, start long, length int, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Items of a group, groups that meet in the next round, and tokens that a nearly full bin may lack.
GROUP_ITEMS, FAN_IN, SLACK = 30_000, 8, 8


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every document's pieces with their place, length and checksum."""
    def work(batches):
        table = table_for(tokenizer)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            ids_of = batch.column(0)
            for a, b, texts in text_runs(batch.column(1), BLOCK):
                ids, counts = table.encode(texts)
                stops = np.cumsum(counts)
                row, piece, start, length, crc = [], [], [], [], []
                for i, (stop, n) in enumerate(zip(stops.tolist(), (counts + 1).tolist())):
                    at, k = 0, 0
                    first = stop - n + 1
                    while at < n:
                        step = min(n - at, (n % capacity or capacity) if k == 0 else capacity)
                        c = zlib.crc32(ids[first + at:min(first + at + step, stop)].astype("<u4").tobytes())
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(step)
                        crc.append(zlib.crc32(end, c) if at + step == n else c)
                        at, k = at + step, k + 1
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(a, b - a).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int32()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return documents(docs).mapInArrow(released(work), ITEMS)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still has room."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms = 0                                                       # bit r: a bin with r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def _round(rows: DataFrame, level: int, capacity: int, slack: int, last: bool) -> DataFrame:
    """Pack each group's items; rows: grp, fill, members.  Result: done, sequence_id, fill, members."""
    def emit(group, fills, members):
        done, seq, fill, body = [], [], [], []
        for k, b in enumerate(best_fit(np.array(fills, np.int64), capacity)):
            total = sum(fills[i] for i in b)
            done.append(last or total >= capacity - slack)
            seq.append(level << 56 | group << 32 | k)
            fill.append(total)
            body.append(b"".join(members[i] for i in b))
        return pa.RecordBatch.from_arrays([pa.array(done), pa.array(seq, pa.int64()), pa.array(fill, pa.int32()), pa.array(body, pa.binary())],
                                          names=["done", "sequence_id", "fill", "members"])

    def work(batches):
        group, fills, members = None, [], []
        for batch in batches:
            for g, f, m in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    if fills:
                        yield emit(group, fills, members)
                    group, fills, members = g, [], []
                fills.append(f)
                members.append(m)
        if fills:
            yield emit(group, fills, members)
    return rows.mapInArrow(released(work), "done boolean, sequence_id long, fill int, members binary")


def _as_members(items: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, MEMBER)
            out["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for name, col in zip(("doc_id", "piece", "start", "length", "crc"), batch.columns):
                out[name] = col.fill_null(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array([x.tobytes() for x in out], pa.binary()), batch.column(5)],
                                             names=["fill", "members", "spread"])
    return items.withColumn("spread", F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(released(work), "fill int, members binary, spread long")


def _unpack(bins: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            if not blobs:
                continue
            m = np.frombuffer(b"".join(blobs), MEMBER)
            each = np.array([len(b) // MEMBER.itemsize for b in blobs], np.int64)
            upto = np.cumsum(m["length"].astype(np.int64)) - m["length"]
            first = np.cumsum(each) - each
            yield pa.RecordBatch.from_arrays(
                [pa.array(m["doc_id"].astype(np.int64), mask=m["known"] == 0), pa.array(m["piece"].astype(np.int32)), pa.array(m["start"].astype(np.int64)),
                 pa.array(m["length"].astype(np.int64)), pa.array(m["crc"].astype(np.int64)),
                 pa.array(np.repeat(batch.column(0).to_numpy(), each)), pa.array(upto - np.repeat(upto[first], each))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return bins.select("sequence_id", "members").mapInArrow(released(work), PACKED)


def pack(items: DataFrame, capacity: int = 2048, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN, slack: int = SLACK,
         parts: int | None = None) -> DataFrame:
    """Pieces (see ``pieces``) with their sequence and their offset in it; parts: partitions of their table at most."""
    level, open_bins, finished = 0, materialise(_as_members(items), parts), []
    count = open_bins.count()
    groups = max(1, -(-count // group_items))
    while True:
        last = groups == 1
        dealt = (open_bins.select(F.pmod(F.xxhash64("spread", F.lit(level)), F.lit(groups)).cast("int").alias("grp"), "fill", "members")
                 .repartition("grp").sortWithinPartitions("grp", F.desc("fill")))
        packed = materialise(_round(dealt, level, capacity, slack, last), groups)  # no more have rows
        finished.append(packed.where("done"))
        if last:
            break
        open_bins = packed.where("not done").select("fill", "members", F.col("sequence_id").alias("spread"))
        left = open_bins.count()
        # fewer groups meet; no group may grow beyond its bound however many bins stay open
        groups = max(-(-groups // fan_in), -(-left // group_items))
        if left > 0.98 * count and groups > 1:
            finished.append(packed.where("not done"))
            break
        level, count = level + 1, left
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return _unpack(out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity), capacity, parts=parts_for(docs))
