"""Removal of byte strings that repeat across documents, by distributed prefix doubling.

A position's rank at length L names the L bytes that start there; the rank at 2L
is the pair of ranks at i and i + L.  Ranks are 64-bit names made of such pairs
(two independent ones where they decide), so equal bytes have equal ranks in
every task and the offsets can grow from 1 to the threshold without a global
renumbering.  Spark sorts rank and position pairs only where they matter:

1. ``anchors``: of the windows of ``threshold`` bytes, neighbours share their
   smallest rank at half that length.  Such a run of windows sends one (rank,
   document) pair, not one per position.  Ranks of a single document are unique
   at this offset and drop out with all windows of their runs.
2. Reranked at the next offset, a run is named by the ranks of its first and
   last window.  Runs that equal one of a smaller document are repeats as a whole.
3. Of what is left, one run of each name (its smallest document's) is reranked
   window by window at the full threshold, if its rank has runs of several names.

In 2 and 3 the runs of a rank meet in one task, sorted; the few ranks with more
than ``HOT_RUNS`` runs go by aggregates and joins instead, with the same result.

Windows with a smaller document are removed with all their bytes.  Every byte of
every text takes part; texts are read anew by doc_id in each round, so no
position outlives the round that needs it.

Null texts are empty.  Rows with one doc_id never make each other's bytes
repeats; a null doc_id counts as the smallest.  An empty table gives an empty
result.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_names, materialise, parts_for, released, runs, seeds, segments, utf8

#: Bytes that a task works on at once.
PIECE = 1 << 18
#: Runs of one rank that may meet in a task.
HOT_RUNS = 100_000

_LANES = [(seeds(256, 31 + k), seeds(2, 41 + k)) for k in range(2)]


def _pair(a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The rank of two strings side by side, from their ranks."""
    x = a * m[0]
    x ^= x >> np.uint64(29)
    x += b
    x *= m[1]
    x ^= x >> np.uint64(32)
    return x


def ranks(data: np.ndarray, lengths: list[int], lane: int = 0) -> list[np.ndarray]:
    """The rank of every position at each length (ascending), by doubling."""
    start, m = _LANES[lane]
    r, size, out = start[data], 1, []
    for want in lengths:
        while size * 2 <= want and len(r) > size:
            r, size = _pair(r[:-size], r[size:], m), size * 2
        if len(data) < want:
            out.append(np.zeros(0, np.uint64))
        elif size == want:
            out.append(r)
        else:
            out.append(_pair(r[:len(data) - want + 1], r[want - size:], m))
    return out


def _lowest(r: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every run of ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        r, size = np.minimum(r[:-size], r[size:]), size * 2
    return r if size == width else np.minimum(r[:len(r) - width + size], r[width - size:])


def _gram(threshold: int) -> int:
    return max(1, threshold // 2 - 1)


def _window_runs(data: np.ndarray, offsets: np.ndarray, threshold: int):
    """(text, first window, windows, smallest rank, ranks of all windows' grams) of texts side by side."""
    gram = _gram(threshold)
    none = np.zeros(0, np.int64)
    if len(data) < threshold:
        return none, none, none, np.zeros(0, np.uint64)
    low = _lowest(ranks(data, [gram])[0], threshold - gram + 1)
    stops = offsets[1:]
    lens = np.diff(offsets)
    change = np.zeros(len(low) + 1, np.int32)              # windows lie inside one text
    fits = lens >= threshold
    np.add.at(change, offsets[:-1][fits], 1)
    np.add.at(change, stops[fits] - threshold + 1, -1)
    sound = np.cumsum(change[:-1]) > 0
    edge = np.ones(len(low), bool)
    edge[1:] = (low[1:] != low[:-1]) | (sound[1:] != sound[:-1])
    edge[offsets[:-1][offsets[:-1] < len(low)]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(low))
    first, end = at[sound[at]], end[sound[at]]
    count = end - first
    parts = -(-count // threshold)                          # a run of one repeated gram can be longer
    nth = segments(np.zeros(len(first), np.int64), parts)
    begin = np.repeat(first, parts) + nth * threshold
    size = np.minimum(threshold, np.repeat(end, parts) - begin)
    return np.searchsorted(stops, begin, side="right"), begin, size, low[begin]


def _blocks(col: pa.Array, threshold: int):
    """Whole texts in bounded blocks; of one huge text, pieces that overlap by a window:
    (first row, bytes, offsets, where the piece begins in the text)."""
    data, off = utf8(col)
    for a, b in runs(np.diff(off), PIECE):
        if b == a + 1 and off[b] - off[a] > 2 * PIECE:
            for at in range(off[a], off[b], PIECE):
                stop = min(at + PIECE + threshold - 1, off[b])
                yield a, data[at:stop], np.array([0, stop - at]), at - off[a]
        else:
            yield a, data[off[a]:off[b]], off[a:b + 1] - off[a], 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (null: smallest), rid (tells rows with one doc_id apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.hash(text).alias("rid"), text.alias("text"))


def anchors(docs: DataFrame, threshold: int) -> DataFrame:
    """rank, doc: the smallest rank of every run of windows."""
    def work(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, off, _ in _blocks(batch.column(1), threshold):
                text, _, _, rank = _window_runs(data, off, threshold)
                if len(rank):
                    yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(ids[row + text])], names=["rank", "doc"])
    long_enough = F.octet_length("text") >= threshold
    return docs.where(long_enough).select("doc", "text").mapInArrow(released(work), "rank long, doc long")


def _runs_of(texts: DataFrame, threshold: int) -> DataFrame:
    """rank, s0, s1 (the run's two names), n, doc, at, hot: the runs whose rank is among the document's ``ranks``."""
    names = ["rank", "s0", "s1", "n", "doc", "at", "hot"]

    def work(batches):
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            alive, hot = np.unique(batch.column(3).flatten().to_numpy()), np.unique(batch.column(4).flatten().to_numpy())
            for row, data, off, base in _blocks(batch.column(2), threshold):
                text, begin, size, rank = _window_runs(data, off, threshold)
                rank = rank.view(np.int64)
                near = np.minimum(np.searchsorted(alive, rank), len(alive) - 1)
                keep = alive[near] == rank
                if not keep.any():
                    continue
                text, begin, size, rank = text[keep], begin[keep], size[keep], rank[keep]
                two = [_pair(r[begin], r[begin + size - 1], _LANES[lane][1]).view(np.int64)
                       for lane, r in enumerate(ranks(data, [threshold], k)[0] for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (rank, *two, size.astype(np.int32), ids[row + text], _place(base + begin - off[text], rids[row + text]),
                                           np.isin(rank, hot))], names=names)
    return texts.mapInArrow(released(work), "rank long, s0 long, s1 long, n int, doc long, at long, hot boolean")


def _by_rank(batches):
    """Columns of whole groups of equal ranks (the first column) of rows sorted by it."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def _firsts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _rerank_runs(rows: DataFrame) -> DataFrame:
    """rank, doc, at, n, whole: runs that repeat a smaller document's run as a whole, and one run of
    each name where the rank has several; all runs of a rank in one task."""
    def work(batches):
        for rank, s0, s1, n, doc, at in _by_rank(batches):
            new = _firsts(rank, s0, s1, n)
            head = np.flatnonzero(new)
            least = doc[head]                                        # sorted by document
            group = np.flatnonzero(_firsts(rank[head]))
            many = np.minimum.reduceat(least, group) < np.maximum.reduceat(least, group)
            several = np.repeat(np.repeat(many, np.diff(np.append(group, len(head)))), np.diff(np.append(head, len(rank))))
            whole = doc > least[np.cumsum(new) - 1]
            keep = whole | several
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (rank, doc, at, n, whole)], names=["rank", "doc", "at", "n", "whole"])
    dealt = rows.select("rank", "s0", "s1", "n", "doc", "at").repartition("rank").sortWithinPartitions("rank", "s0", "s1", "n", "doc")
    return dealt.mapInArrow(released(work), "rank long, doc long, at long, n int, whole boolean")


def _contexts_of(texts: DataFrame, threshold: int) -> DataFrame:
    """rank, doc, at, n, body: the bytes under each run asked for (``asked``: start, n, rank)."""
    def work(batches):
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, off = utf8(batch.column(2))
            at, flat = batch.column(3).offsets.to_numpy(), batch.column(3).flatten()
            start, n, rank = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            text = np.repeat(np.arange(batch.num_rows), np.diff(at))
            for a, b in runs(n + threshold - 1):
                t, size = text[a:b], n[a:b] + threshold - 1
                body = data[segments(off[t] + start[a:b], size)]
                stops = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(stops), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[a:b]), pa.array(ids[t]), pa.array(_place(start[a:b], rids[t])), pa.array(n[a:b].astype(np.int32)), bodies],
                    names=["rank", "doc", "at", "n", "body"])
    return texts.mapInArrow(released(work), "rank long, doc long, at long, n int, body binary")


def _rerank_windows(rows: DataFrame, threshold: int) -> DataFrame:
    """doc, at, n: windows (in runs) that also stand in a smaller document; all runs of a rank in one task."""
    def work(batches):
        for rank, doc, at, n, body in _by_rank(batches):
            edges = np.append(np.flatnonzero(_firsts(rank)), len(rank))
            cost = np.add.reduceat(n.astype(np.int64) + threshold, edges[:-1])
            for i, j in runs(cost, PIECE):                            # whole ranks, in blocks
                a, b = edges[i], edges[j]
                data = np.frombuffer(b"".join(body[a:b].tolist()), np.uint8)
                size = n[a:b].astype(np.int64)
                origin = np.cumsum(size + threshold - 1) - (size + threshold - 1)
                place = segments(origin, size)
                owner = np.repeat(np.arange(b - a), size)
                w0, w1 = (ranks(data, [threshold], lane)[0][place] for lane in (0, 1))
                who = doc[a:b][owner]
                order = np.lexsort((who, w1, w0))
                new = _firsts(w0[order], w1[order])
                least = np.empty(len(order), np.int64)
                least[order] = who[order][np.flatnonzero(new)][np.cumsum(new) - 1]
                hit = np.flatnonzero(who > least)
                if not len(hit):
                    continue
                step = place[hit] - origin[owner[hit]]
                begin = np.ones(len(hit), bool)
                begin[1:] = (owner[hit][1:] != owner[hit][:-1]) | (step[1:] != step[:-1] + 1)
                head = np.flatnonzero(begin)
                count = np.diff(np.append(head, len(hit)))
                o = owner[hit][head]
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][o]), pa.array(at[a:b][o] + (step[head] << 32)), pa.array(count.astype(np.int32))],
                                                 names=["doc", "at", "n"])
    dealt = rows.repartition("rank").sortWithinPartitions("rank", "doc")
    return dealt.mapInArrow(released(work), "doc long, at long, n int")


def _place(start: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """A window's start (below 2**31, as texts are) with 32 bits that tell rows of one doc_id apart."""
    return start << 32 | rid.astype(np.int64) & 0xFFFFFFFF


def _windows_of(texts: DataFrame, threshold: int) -> DataFrame:
    """w0, w1, doc, at: every window of the runs asked for (``asked``: start and n)."""
    def work(batches):
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            asked = batch.column(3)
            at = asked.offsets.to_numpy()
            flat = asked.flatten()
            starts, sizes = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
            for row, data, off, base in _blocks(batch.column(2), threshold):
                rows = np.arange(row, row + len(off) - 1)
                n = at[rows + 1] - at[rows]
                pick = segments((at[rows] - at[0]).astype(np.int64), n.astype(np.int64))
                text = np.repeat(np.arange(len(rows)), n)
                s = segments(starts[pick], sizes[pick].astype(np.int64)) - base
                text = np.repeat(text, sizes[pick])
                place = off[text] + s
                inside = (s >= 0) & (place + threshold <= off[text + 1])  # a huge text's piece has its own windows only
                place, text, s = place[inside], text[inside], s[inside]
                if not len(place):
                    continue
                a, b = (ranks(data, [threshold], lane)[0].view(np.int64) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[place], b[place], ids[row + text], _place(s + base, rids[row + text]))],
                                                 names=["w0", "w1", "doc", "at"])
    return texts.mapInArrow(released(work), "w0 long, w1 long, doc long, at long")


def _rerank_hot_runs(rows: DataFrame) -> DataFrame:
    """As ``_rerank_runs``, by aggregates and joins."""
    name = ["rank", "s0", "s1", "n"]
    least = materialise(rows.groupBy(*name).agg(F.min("doc").alias("least")))
    several = least.groupBy("rank").agg((F.min("least") < F.max("least")).alias("several"))
    judged = rows.select(*name, "doc", "at").join(least.join(several, "rank"), name)
    return judged.where((F.col("doc") > F.col("least")) | F.col("several")).select("rank", "doc", "at", "n", (F.col("doc") > F.col("least")).alias("whole"))


def _rerank_hot_windows(texts: DataFrame, threshold: int) -> DataFrame:
    """As ``_rerank_windows``, a row for each window, by aggregates and joins."""
    windows = _windows_of(texts, threshold)
    least = windows.groupBy("w0", "w1").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w0", "w1", "least")
    return windows.join(least, ["w0", "w1"]).where("doc > least").select("doc", "at", F.lit(1).alias("n"))


def repeats(docs: DataFrame, threshold: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc, rid, spans: (start, n) of the windows that also start in a smaller document.  ``docs``: see ``_keyed``."""
    parts = parts_for(docs)
    texts_of = docs.select("doc", "rid", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    same = texts_of.groupBy("sha").agg(F.min("doc").alias("least"))
    copies = materialise(texts_of.where(F.col("size") >= threshold).join(same, "sha")
                         .select("doc", "rid", "size", (F.col("doc") > F.col("least")).alias("copy")).distinct(), parts)
    first_of = copies.where("not copy").select("doc", "rid")     # equal texts: only the smallest document's goes on

    found = anchors(docs, threshold)
    shared = found.groupBy("rank").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("runs")).where("lo < hi")
    shared = materialise(shared.select("rank", (F.col("runs") > hot_runs).alias("hot")), parts)
    any_hot = not shared.where("hot").isEmpty()
    alive = found.join(shared, "rank").groupBy("doc").agg(F.collect_list("rank").alias("ranks"), F.collect_list(F.when(F.col("hot"), F.col("rank"))).alias("hot"))
    alive = materialise(alive.join(first_of, "doc").select("doc", "rid", "ranks", "hot"), parts)

    keyed = docs.select("doc", "rid", "text")
    rows = _runs_of(keyed.join(alive, ["doc", "rid"]).select("doc", "rid", "text", "ranks", "hot"), threshold)
    judged = _rerank_runs(rows.where(~F.col("hot")))
    if any_hot:  # a rank that very many runs share is not met in one task, but aggregated before the shuffle
        judged = judged.withColumn("hot", F.lit(False)).unionByName(_rerank_hot_runs(rows.where("hot")).withColumn("hot", F.lit(True)))
    else:
        judged = judged.withColumn("hot", F.lit(False))
    judged = materialise(judged, parts)

    def placed(rows, *more):
        return rows.select("doc", F.shiftright(F.shiftleft("at", 32), 32).cast("int").alias("rid"),
                           F.struct(F.shiftright("at", 32).cast("int").alias("start"), "n", *more).alias("span"))

    def asked(hot):
        runs_of = placed(judged.where(~F.col("whole") & (F.col("hot") == hot)), "rank")
        return keyed.join(runs_of.groupBy("doc", "rid").agg(F.collect_list("span").alias("asked")), ["doc", "rid"]).select("doc", "rid", "text", "asked")
    single = _rerank_windows(_contexts_of(asked(False), threshold), threshold)
    if any_hot:
        single = single.unionByName(_rerank_hot_windows(asked(True), threshold))
    copied = copies.where("copy").select("doc", "rid", F.struct(F.lit(0).alias("start"), (F.col("size") - threshold + 1).alias("n")).alias("span"))
    spans = placed(single.unionByName(judged.where("whole").select("doc", "at", "n"))).unionByName(copied)
    return materialise(spans.groupBy("doc", "rid").agg(F.collect_list("span").alias("spans")), parts)


def removed_runs(spans: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes under the windows (rows of first window and windows)."""
    if spans is None or not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, end = spans[:, 0], np.maximum.accumulate(spans.sum(axis=1) - 1 + threshold)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _spans_of(batch, column: int):
    col = batch.column(column)
    at, flat = col.offsets.to_numpy(), col.flatten()
    pairs = np.stack([flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
    at = at - at[0]
    return [np.ascontiguousarray(pairs[a:b]) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _cut(text: bytes, spans, threshold: int, whole: bool = False) -> tuple[bytes, int, int]:
    """The bytes left, bytes removed and runs removed; whole: characters are not torn apart."""
    start, end = removed_runs(spans, threshold)
    if whole:
        start = np.array([next(i for i in range(a, b + 1) if i == b or text[i] & 0xC0 != 0x80) for a, b in zip(start.tolist(), end.tolist())], np.int64)
        end = np.array([next(i for i in range(b, a - 1, -1) if i == len(text) or i == a or text[i] & 0xC0 != 0x80)
                        for a, b in zip(start.tolist(), end.tolist())], np.int64)
    if not len(start):
        return text, 0, 0
    keep = [text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)])]
    return b"".join(keep), int((end - start).sum()), len(start)


def _with_spans(docs: DataFrame, threshold: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """The columns of ``docs`` and, as the last one, the runs of windows to remove."""
    doc, rid, found, d, r = free_names(docs.columns, "doc", "rid", "spans", "d", "r")
    spans = repeats(_keyed(docs), threshold, hot_runs).select(F.col("doc").alias(doc), F.col("rid").alias(rid), F.col("spans").alias(found))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    marked = docs.withColumns({d: own, r: F.hash(text)})
    return marked.join(spans, (F.col(d) == F.col(doc)) & (F.col(r) == F.col(rid)), "left").select(*docs.columns, found)


def remove_repeats(docs: DataFrame, threshold: int = 50, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256 of every document."""
    joined = _with_spans(documents(docs), threshold, hot_runs)

    def work(batches):
        for batch in batches:
            for a, b in runs(np.diff(utf8(batch.column(1))[1])):
                part = batch.slice(a, b - a)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                cut = [_cut(t, s, threshold) for t, s in zip(texts, _spans_of(part, 2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[1] for c in cut], pa.int64()),
                     pa.array([c[2] for c in cut], pa.int64()), pa.array([c[0] for c in cut], pa.binary()),
                     pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    return joined.mapInArrow(released(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def cut_repeats(docs: DataFrame, threshold: int) -> DataFrame:
    """The documents with repeats cut out of their texts, in whole characters; all columns stay, whatever their names.

    ``n_chars``, where there is one, follows the text; a null text stays null.
    """
    joined = _with_spans(docs.withColumn("text", F.col("text").cast("string")), threshold)
    names, at = docs.columns, docs.columns.index("text")

    def work(batches):
        for batch in batches:
            texts = [None if t is None else t if s is None else _cut(t.encode(), s, threshold, True)[0].decode()
                     for t, s in zip(batch.column(at).to_pylist(), _spans_of(batch, len(names)))]
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)
    out = joined.mapInArrow(released(work), T.StructType(joined.schema.fields[:-1]))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
