"""Similarity join of word n-gram sets by Jaccard, with a prefix tree.

1. ``signatures``: a set's n-grams lie in hash order and are cut into so many
   segments that two sets similar enough must agree in a whole one (they differ
   in too few n-grams to touch all).  Segments have as many keys for each size
   class a partner may have.  A set with too many empty segments adds the keys of
   the classic prefix filter, so that no pair is missed.
2. Keys held by different sets link them to candidates; components of candidates
   are small and real, and a set is sent once, to its component's task.  A key
   moves once: a task first links the sets that share it there and sends one of
   them, so a key that many sets share moves as one row a task.
3. ``tree_links``: all sets that can be linked are in one task (or in the blocks
   of a split component).  There they are ordered by one order (the task's
   frequent n-grams first) and stored in a path-compressed prefix tree.  A set walks the tree: shared
   paths share the partial overlap, and a subtree is left when the lengths that
   remain cannot reach the overlap needed, or when all its sets are already linked
   to the one that walks.  Exact counts decide; a spanning set of links goes out.
4. Components of these links name each document's component.

Equal sets are one set.  A passage that many documents hold can link them to one
candidate component too large for a task.  Its n-grams are then counted over all
its sets and ordered, the rarest first; two similar sets share an n-gram among
each one's first ``size - least overlap + 1``, so these prefixes link them anew,
and a common passage, which comes last, does not.  What is still too large is
split: sets linked to the component's pivot are told apart first, and only pairs
of blocks that hold another set are joined, each in a task of its own.

Words are named by two 64-bit chains of their bytes, n-grams by 64 bits of both;
a set is named by 128 bits of its n-grams.

Texts are lower-cased in A-Z; words are runs without white space.  With fewer
words than n the whole sequence is the one n-gram; empty and null texts have no
set and are linked with nothing.  Rows that repeat a doc_id are rows of their
own; null doc_ids count for no component's id unless nothing else is there.  An
empty table gives an empty result.  Other columns may have any name.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise, parts_for, released, runs, seeds, segments, utf8
from .components import components

_M = seeds(6, 51)
_LANE = seeds(4, 52)
#: The first 0 to 8 bytes of a lane.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are named one by one.
LONG_WORD = 256
#: Keys that a task looks through for equal ones before it sends them.
HELD_KEYS = 1 << 18
#: n-grams that a task joins at once.
TASK_TOKENS = 2_000_000

def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[k]
    return x ^ (x >> np.uint64(29))


def _lower_table() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return low, blank


_LOW, _BLANK = _lower_table()


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of every word data[start:end], from two chains over its bytes, eight at a time."""
    size = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    chains = [_mix(size.astype(np.uint64) * _LANE[k] + _LANE[k + 2], k) for k in (0, 1)]
    left, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(left):
        lane = lanes[start[left] + k] & _FIRST[np.minimum(size[left] - k, 8)]
        for c, chain in enumerate(chains):
            chain[left] = _mix((chain[left] ^ lane) * _LANE[c] + _LANE[3 - c], 2 + c)
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        two = np.frombuffer(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=16).digest(), "<u8")
        chains[0][i], chains[1][i] = two
    return _mix(chains[0] * _M[5] + chains[1], 0)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram name) of the distinct n-grams of texts side by side, by text and name."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    prev = np.ones(len(data), bool)
    prev[1:] = blank[:-1]
    start = np.flatnonzero(~blank & (prev | edge[:-1]))
    if not len(start):
        return none
    follow = np.ones(len(data), bool)
    follow[:-1] = blank[1:]
    end = np.flatnonzero(~blank & (follow | edge[1:])) + 1
    word = word_names(_LOW[data], start, end)
    text = np.searchsorted(offsets[1:], start, side="right")
    count = np.bincount(text, minlength=len(offsets) - 1)
    gram = word[:max(len(word) - n + 1, 0)].copy()
    for k in range(1, n):
        gram = _mix(gram * _M[1] + word[k:len(word) - n + 1 + k], 1)
    whole = text[:len(gram)] == text[n - 1:] if len(gram) else np.zeros(0, bool)
    texts, grams = [text[:len(gram)][whole]], [gram[whole]]
    first = np.cumsum(count) - count
    for t in np.flatnonzero((count > 0) & (count < n)).tolist():
        g = np.uint64(count[t])
        with np.errstate(over="ignore"):
            for w in word[first[t]:first[t] + count[t]]:
                g = _mix(np.array([g * _M[2] + w]), 2)[0]
        texts.append(np.array([t]))
        grams.append(np.array([g], np.uint64))
    text, gram = np.concatenate(texts), np.concatenate(grams)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    return text[new], gram[new]


def _size_classes(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest size of each class, the n-grams in which two sets may differ, and segments."""
    tops = [1]
    while tops[-1] < most * den // num + 1:
        tops.append(max(tops[-1] + 1, tops[-1] * den // num))
    tops = np.array(tops, np.int64)
    differ = 2 * tops * (den - num) // (den + num)
    empty = (differ + 1) * np.exp(-tops * (num / den) ** 2 / (differ + 1))
    return tops, differ, differ + 1 + np.where(differ > 0, np.ceil(2 * empty), 0).astype(np.int64)


def signature_keys(text: np.ndarray, gram: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): keys of which any two sets with Jaccard >= num / den share one."""
    if not len(text):
        return text, gram
    rows, first, size = np.unique(text, return_index=True, return_counts=True)
    tops, differ, parts = _size_classes(int(size.max()), num, den)
    own = np.searchsorted(tops, size)
    last = np.searchsorted(tops, size * den // num)
    out_text, out_key = [], []
    unlucky = np.zeros(len(rows), bool)
    named = _mix(gram, 3)
    for step in range(int((last - own).max()) + 1):
        use = own + step <= last
        cls = (own + step)[use]
        at = segments(first[use], size[use])
        m = np.repeat(parts[cls], size[use]).astype(np.uint64)
        seg = ((gram[at] >> np.uint64(32)) * m) >> np.uint64(32)
        owner = np.repeat(np.arange(len(cls)), size[use])
        new = np.ones(len(at), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        total = np.add.reduceat(named[at], head)
        out_text.append(rows[use][owner[head]])
        out_key.append(_mix(total * _M[4] + seg[head] * _M[1] + cls[owner[head]].astype(np.uint64), 4))
        filled = np.bincount(owner[head], minlength=len(cls))
        unlucky[np.flatnonzero(use)[filled < differ[cls] + 1]] = True
    if unlucky.any():
        prefix = size[unlucky] - -(-num * size[unlucky] // den) + 1
        at = segments(first[unlucky], prefix)
        out_text.append(np.repeat(rows[unlucky], prefix))
        out_key.append(_mix(gram[at] + _M[2], 5))
    return np.concatenate(out_text), np.concatenate(out_key)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))


def _fingerprints(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two names and the size of each text's set."""
    size = np.bincount(text, minlength=n)
    f0, f1 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(text):
        rows, first = np.unique(text, return_index=True)
        for f, k in ((f0, 1), (f1, 2)):
            f[rows] = np.add.reduceat(_mix(gram, k), first)
    return f0.view(np.int64), f1.view(np.int64), size.astype(np.int64)


def set_names(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, rid, f0, f1, n_shingles of every row; the names are null without a set."""
    def work(batches):
        for batch in batches:
            data, off = utf8(batch.column(2))
            for a, b in runs(np.diff(off), 1 << 18):
                text, gram = ngram_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], n)
                f0, f1, size = _fingerprints(text, gram, b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(f0, mask=size == 0), pa.array(f1, mask=size == 0), pa.array(size)],
                                                 names=["doc_id", "rid", "f0", "f1", "n_shingles"])
    return docs.mapInArrow(released(work), "doc_id long, rid long, f0 long, f1 long, n_shingles long")


def _first_of_key(key: np.ndarray, f0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: where each key begins, and the first set of every row's key."""
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    return head, f0[head][np.cumsum(head) - 1]


def _merged(keys: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each key, with one of its sets, and links between the sets that share a key here."""
    key, f0 = np.concatenate(keys), np.concatenate(sets)
    order = np.argsort(key)
    key, f0 = key[order], f0[order]
    head, first = _first_of_key(key, f0)
    apart = f0 != first
    links = np.unique(np.stack([f0[apart], first[apart]]), axis=1) if apart.any() else np.zeros((2, 0), np.int64)
    columns = np.concatenate([key[head], links[0]]), np.concatenate([f0[head], links[1]])
    linked = np.arange(len(columns[0])) >= int(head.sum())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(linked)], names=["key", "f0", "linked"])


def signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """key, f0, linked: a row for each key a task has seen, with one of its sets; linked rows are links of
    two sets (in key and f0) that share a key in the task."""
    def work(batches):
        keys, sets, held = [], [], 0
        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, b in runs(np.diff(off), 1 << 18):
                text, gram = ngram_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], n)
                f0, _, _ = _fingerprints(text, gram, b - a)
                row, key = signature_keys(text, gram, num, den)
                keys.append(key.view(np.int64))
                sets.append(f0[row])
                held += len(key)
                if held >= HELD_KEYS:
                    yield _merged(keys, sets)
                    keys, sets, held = [], [], 0
        if held:
            yield _merged(keys, sets)
    return docs.select("text").mapInArrow(released(work), "key long, f0 long, linked boolean")


def thinned(keys: DataFrame) -> DataFrame:
    """Rows (key, f0) as ``signatures`` gives them: a key that many sets share leaves a task as one row."""
    def work(batches):
        some, sets, held = [], [], 0
        for batch in batches:
            some.append(batch.column(0).to_numpy())
            sets.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= HELD_KEYS:
                yield _merged(some, sets)
                some, sets, held = [], [], 0
        if held:
            yield _merged(some, sets)
    return keys.mapInArrow(released(work), "key long, f0 long, linked boolean")


def candidate_links(keys: DataFrame) -> DataFrame:
    """a, b: links (as f0) that connect all sets with a common key.  keys: see ``signatures``; each row moves once."""
    def work(batches):
        last, mate = None, 0
        for batch in batches:
            key, f0 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            linked = batch.column(2).to_numpy(zero_copy_only=False)
            a, b = [key[linked]], [f0[linked]]
            key, f0 = key[~linked], f0[~linked]
            if len(key):
                _, first = _first_of_key(key, f0)
                if last is not None:
                    first = np.where(key == last, mate, first)
                last, mate = key[-1], first[-1]
                apart = f0 != first
                a.append(f0[apart])
                b.append(first[apart])
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], names=["a", "b"])
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(released(work), "a long, b long")


class _Node:
    __slots__ = ("path", "children", "ids", "low", "high", "one", "same")

    def __init__(self, path, size, i):
        self.path, self.children, self.ids = path, {}, []
        self.low = self.high = size
        self.one, self.same = i, True


class PrefixTree:
    """Sets as ascending arrays of n-gram ranks; walks link what is similar and not linked yet."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, linked: list[int] | None = None):
        self.sets, self.num, self.den = sets, num, den
        self.root = _Node(np.zeros(0, np.int64), 0, 0)
        self.root.low, self.root.high, self.root.same = 1 << 60, 0, False
        self.parent = list(range(len(sets)))
        for i in (linked or [])[1:]:
            self.parent[self.find(i)] = self.find(linked[0])
        self.links: list[tuple[int, int]] = []
        self.marks = np.zeros(1 + max((int(s[-1]) for s in sets if len(s)), default=0), bool)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _reaches(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def walk(self, i: int) -> None:
        x = self.sets[i]
        a = len(x)
        self.marks[x] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if self.den * node.high < self.num * a or self.num * node.low > self.den * a:
                continue
            if node.same and self.find(node.one) == self.find(i):
                continue
            if len(node.path):
                overlap += int(np.count_nonzero(self.marks[node.path]))
                depth += len(node.path)
                left = a - int(np.searchsorted(x, node.path[-1], side="right"))
                if not self._reaches(overlap + node.high - depth, a, node.high) or not self._reaches(overlap + left, a, node.low):
                    continue
            for j in node.ids:
                if self.find(j) != self.find(i) and self._reaches(overlap, a, depth):
                    self.parent[self.find(j)] = self.find(i)
                    self.links.append((i, j))
            stack.extend((child, overlap, depth) for child in node.children.values())
        self.marks[x] = False

    def insert(self, i: int) -> None:
        x, node, at = self.sets[i], self.root, 0
        n = len(x)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if node is not self.root and node.same:
                node.same = self.find(node.one) == self.find(i)
            if at == n:
                node.ids.append(i)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                leaf = _Node(x[at:], n, i)
                leaf.ids.append(i)
                node.children[int(x[at])] = leaf
                return
            both = min(len(child.path), n - at)
            unlike = np.flatnonzero(child.path[:both] != x[at:at + both])
            common = int(unlike[0]) if len(unlike) else both
            if common < len(child.path):                       # split the edge
                upper = _Node(child.path[:common], child.low, child.one)
                upper.high, upper.same = child.high, child.same
                child.path = child.path[common:]
                upper.children[int(child.path[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            node, at = child, at + common


def tree_links(names, sets: list[np.ndarray], num: int, den: int, linked: list[int] | None = None) -> list[tuple]:
    """A spanning set of links (as names) among sets of n-gram names."""
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    vocab, where, n = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), np.int64)
    rank[np.lexsort((vocab, -n))] = np.arange(len(vocab))      # frequent first: common paths
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(r) for r in np.split(rank[where], cuts)]
    tree = PrefixTree(ordered, num, den, linked)
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i])):
        tree.walk(i)
        tree.insert(i)
    return [(names[i], names[j]) for i, j in tree.links]


def _sets_of(texts: DataFrame, n: int) -> DataFrame:
    """The columns before ``text`` and the set's n-gram names."""
    keep = texts.columns[:-1]

    def work(batches):
        for batch in batches:
            data, off = utf8(batch.column(len(keep)))
            for a, b in runs(np.diff(off), 1 << 18):
                text, gram = ngram_sets(data[off[a]:off[b]], off[a:b + 1] - off[a], n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], lists], names=[*keep, "grams"])
    return texts.mapInArrow(released(work), ", ".join(f"{c} {t}" for c, t in texts.dtypes[:-1]) + ", grams array<long>")


def _tree_tasks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the sets that share a task (root, left, right)."""
    def work(batches):
        task, names, sets, pivoted = None, [], [], []

        def links():
            found = tree_links(names, sets, num, den, pivoted)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            f, flags = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            grams = batch.column(5)
            at, flat = grams.offsets.to_numpy(), grams.flatten().to_numpy()
            for k, key in enumerate(keys):
                if key != task:
                    if len(names) > 1:
                        yield links()
                    task, names, sets, pivoted = key, [], [], []
                if names and names[-1] == f[k]:       # a set whose document row is repeated
                    continue
                if flags[k]:
                    pivoted.append(len(names))
                names.append(f[k])
                sets.append(flat[at[k] - at[0]:at[k + 1] - at[0]])
        if len(names) > 1:
            yield links()
    dealt = rows.select("root", "left", "right", "f", "pivoted", "grams").repartition("root", "left", "right")
    return dealt.sortWithinPartitions("root", "left", "right", "f").mapInArrow(released(work), "a binary, b binary")


def _refined(big: DataFrame, num: int, den: int, parts: int | None = None) -> DataFrame:
    """(f, root, total, pivot, grams) of large components' sets by the components that prefixes of rare n-grams give;
    sets that these link to nothing are left out.  parts: partitions of its tables at most."""
    held = materialise(big.select("f", "grams"), parts).withColumn("sid", F.monotonically_increasing_id())
    cells = held.select("sid", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    shared = cells.withColumn("df", F.count("*").over(Window.partitionBy("gram"))).where("df > 1")  # n-grams move once
    own = Window.partitionBy("sid")
    found = shared.select("sid", "size", "gram", F.row_number().over(own.orderBy("df", "gram")).alias("at"), F.count("*").over(own).alias("n"))
    # n-grams of one set alone come first; size - least overlap + 1 places are the prefix
    prefix = F.col("size") - F.ceil(F.col("size") * num / den) + 1
    keys = found.where(F.col("size") - F.col("n") + F.col("at") <= prefix).select(F.col("gram").alias("key"), F.col("sid").alias("f0"))
    linked = materialise(components(candidate_links(thinned(keys)), parts).select(F.col("node").alias("sid"), F.col("root")))
    sized = linked.join(held.select("sid", "f", F.size("grams").alias("size")), "sid")
    total = sized.groupBy("root").agg(F.sum("size").alias("total"), F.min("f").alias("pivot"))
    return held.join(linked.join(total, "root"), "sid").select("f", "root", "total", "pivot", "grams")


def _set_name() -> Column:
    """The 16 bytes of f0 and f1; null without a set."""
    return F.unhex(F.concat(F.lpad(F.hex("f0"), 16, "0"), F.lpad(F.hex("f1"), 16, "0")))


def similar_sets(docs: DataFrame, named: DataFrame, n: int, num: int, den: int, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """node, root over set names: sets that links connect.  docs: see ``_keyed``; named: ``set_names`` of it."""
    parts = parts_for(docs)
    near = candidate_links(signatures(docs, n, num, den))
    candidates = materialise(components(near, parts).withColumnRenamed("node", "f0"))

    reps = named.where("f0 is not null").groupBy("f0", "f1").agg(F.min(F.struct("doc_id", "rid")).alias("rep"), F.max("n_shingles").alias("size"))
    reps = reps.join(candidates, "f0").select(_set_name().alias("f"), "root", "size", F.col("rep.doc_id").alias("doc_id"), F.col("rep.rid").alias("rid"))
    total = reps.groupBy("root").agg(F.sum("size").alias("total"), F.min(F.struct("f", "size")).alias("first"))
    reps = reps.join(total.select("root", "total", F.col("first.f").alias("pivot")), "root")   # rows without text or n-grams
    same_row = (F.col("d.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("d.rid") == F.col("r.rid"))
    texts = docs.alias("d").join(reps.alias("r"), same_row).select("r.f", "r.root", "r.total", "r.pivot", "d.text")
    sets = _sets_of(texts, n)
    def of_task(rows: DataFrame, kind: int) -> DataFrame:  # kind keeps the two sorts of roots apart
        return rows.select("root", F.lit(kind).alias("left"), F.lit(kind).alias("right"), "f", F.lit(False).alias("pivoted"), "grams")
    if total.where(F.col("total") > task_tokens).isEmpty():
        return components(_tree_tasks(of_task(sets, -1), num, den), parts)

    sets = materialise(sets, parts)
    refined = materialise(_refined(sets.where(F.col("total") > task_tokens), num, den, parts), parts)
    whole = of_task(sets.where(F.col("total") <= task_tokens), -1).unionByName(of_task(refined.where(F.col("total") <= task_tokens), -2))
    big = refined.where(F.col("total") > task_tokens)
    large = big.where("f = pivot").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("size")).first()
    if not large["n"]:
        return components(_tree_tasks(whole, num, den), parts)
    # a large component's pivot goes to all its sets: as a broadcast while all pivots are small enough for a task
    fits = large["n"] + large["size"] <= min(task_tokens, TASK_TOKENS)
    known = F.broadcast if fits else (lambda x: x)
    pivots = big.where("f = pivot").groupBy("root").agg(F.first("grams").alias("pivot_grams"))
    a, b, o = F.size("grams"), F.size("pivot_grams"), F.size(F.array_intersect("grams", "pivot_grams"))
    near = (o * den >= (a + b - o) * num) | (F.col("f") == F.col("pivot"))
    flagged = big.join(known(pivots), "root").withColumn("pivoted", near).drop("pivot_grams")
    rest = flagged.where("not pivoted").groupBy("root").agg(F.sum(F.size("grams")).alias("rest"))
    # blocks of half a task's n-grams; sets off the pivot meet every block, the others only the blocks of those
    cut = (flagged.join(known(rest), "root").withColumn("off", F.ceil(F.col("rest") * 2 / task_tokens).cast("int"))
           .withColumn("on", F.ceil(F.col("total") * 2 / task_tokens).cast("int")))
    mine = F.when(F.col("pivoted"), F.col("off") + F.pmod(F.xxhash64("f"), F.col("on"))).otherwise(F.pmod(F.xxhash64("f"), F.col("off"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("pivoted"), F.col("off") - 1).otherwise(F.col("off") + F.col("on") - 1))
    met = cut.withColumn("mine", mine).withColumn("other", F.explode(other)).select(
        "root", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "f", "pivoted", "grams")
    links = _tree_tasks(whole.unionByName(met), num, den)
    return components(links.unionByName(flagged.where("pivoted").select(F.col("f").alias("a"), F.col("pivot").alias("b"))), parts)


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """doc_id, rid, n_shingles and component_id of every row; links need Jaccard >= num / den."""
    keyed = _keyed(docs)
    named = materialise(set_names(keyed, n), parts_for(docs))
    linked = similar_sets(keyed, named, n, num, den, task_tokens)
    rows = named.withColumn("f", _set_name()).join(linked, F.col("f") == F.col("node"), "left").select(
        "doc_id", "rid", "n_shingles", F.coalesce("root", "f").alias("component"))
    least = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    met = rows.where("component is not null").join(least, "component").select("doc_id", "rid", "n_shingles", "component_id")
    alone = rows.where("component is null").select("doc_id", "rid", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.unionByName(alone)


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all columns stay, whatever their names."""
    row, empty, nth = free_names(docs.columns, "row", "empty", "nth")

    def name(rid):
        return F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(":"), rid.cast("string"))
    found = jaccard_components(docs, n, num, den).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        name(F.col("rid")).alias(row), (F.col("n_shingles") == 0).alias(empty)).distinct()
    marked = docs.withColumn(row, name(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    number = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    return marked.join(found, row).withColumn(nth, number).where((F.col(nth) == 1) | F.col(empty)).select(*docs.columns)
