"""Conversation prefix trie, built in adaptive radix trees.

A turn's id has a fixed width of 20 big-endian bytes: 16 of a SHA-256 of its
role and text, and 4 with its number of words.  A conversation is the string of
its turns' ids, and equal turns have equal ids in every task.

1. ``conversation_keys`` numbers the turns and joins them, a row a conversation.
2. ``distinct_keys`` makes one row of all conversations with one key.  Their ids
   are sorted over all tasks by range, joined in chunks, and hashed chunk by
   chunk in a stream, so no task holds a group.
3. Distinct keys are sorted by range.  Every task holds a stretch of them, of
   bounded size however many conversations share a beginning, in an
   ``AdaptiveRadixTree``: nodes of 4, 16, 48 or 256 children that grow as needed,
   with compressed paths.  Only byte depths at the end of a turn give nodes.
4. Nodes whose members lie in one stretch are done there.  A node that goes on in
   the next stretch (a beginning of a stretch's first or last key) gives a part
   in each; Spark adds the parts up.  Such a node's own saving needs its whole
   count: it is added below its ancestors by a running sum along the border of
   the stretch where it begins.

Null roles and texts are empty, turns are in the order of ``turn`` (null first)
and then of role and text, and rows that repeat all three are turns of their
own.  Rows with a null conv_id belong to no conversation.  A conversation
without turns ends in the root.  An empty table has no node, not even a root.  A
conversation's key must fit a row (2 GiB, over 100 million turns); beyond it the
job ends with an error.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WIDTH, WORDS = 20, 4
#: Distinct conversations, and bytes of their keys, that a task's tree holds by plan.
TREE_KEYS, TREE_BYTES = 50_000, 8 << 20
#: Characters of ids in a chunk.
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0) and id (20 bytes) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.lpad(F.hex(F.regexp_count("text", F.lit(WORD))), 2 * WORDS, "0")
    made = F.unhex(F.concat(F.substring(digest, 1, 2 * (WIDTH - WORDS)), words))
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), made.alias("id"))


def regraft(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, part, pos, id of rebuilt conversations: the first h turns of conversation c - c % every, then c's own
    turns after its first h, with h = crc32(decimal c) % most.  A row of part 0 stands for the conversation itself."""
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")
    own = turns.where(F.col("pos") >= h).select("conv_id", F.lit(2).alias("part"), "pos", "id")
    convs = turns.where("pos = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "id")
    grafted = convs.join(heads, "base").where("pos < h").select("conv_id", F.lit(1).alias("part"), "pos", "id")
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(b"").alias("id"))
    return own.unionByName(grafted).unionByName(marks)


def conversation_keys(turns: DataFrame) -> DataFrame:
    """conv_id, key and the key's 16-byte name from rows (conv_id, part, pos, id)."""
    def rows_of(ids: list[int], keys: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()),
                                           pa.array([hashlib.sha256(k).digest()[:16] for k in keys], pa.binary())], names=["conv_id", "key", "name"])

    def work(batches: Iterator[pa.RecordBatch]):
        conv, parts = None, []
        for batch in batches:
            convs = batch.column(0).to_numpy()
            ids = batch.column(1)
            if not len(convs):
                continue
            off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
            data = memoryview(ids.buffers()[2] or b"")
            edges = [0, *(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)]
            done, keys = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if convs[a] != conv:
                    if conv is not None:
                        done.append(conv)
                        keys.append(b"".join(parts))
                    conv, parts = int(convs[a]), []
                parts.append(bytes(data[off[a]:off[b]]))
            if done:
                yield rows_of(done, keys)
        if conv is not None:
            yield rows_of([conv], [b"".join(parts)])
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "id")
    return rows.mapInArrow(work, "conv_id long, key binary, name binary")


def distinct_keys(keys: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, n, conv_id (smallest) and ends_sha256 of all conversations with one key."""
    def chunks(batches: Iterator[pa.RecordBatch]):
        name, key, first, n, size, parts = None, None, 0, 0, 0, []
        out: list[tuple] = []

        def batch_of():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                                              names=["name", "first", "n", "ids", "key"])
        held = 0
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (w, c) in enumerate(zip(names, ids)):
                if w != name or size >= chunk:
                    if parts:
                        out.append((name, first, n, ",".join(parts), key))
                        held += size + len(key)
                        if held > 1 << 22 or len(out) >= 10_000:
                            yield batch_of()
                            out, held = [], 0
                    if w != name:
                        name, key = w, batch.column(2)[i].as_py()
                    first, n, size, parts = c, 0, 0, []
                s = str(c)
                parts.append(s)
                n, size = n + 1, size + len(s) + 1
        if parts:
            out.append((name, first, n, ",".join(parts), key))
            yield batch_of()

    def hashes(batches: Iterator[pa.RecordBatch]):
        name = state = None
        row: list = []
        for batch in batches:
            cols = [batch.column(j).to_pylist() for j in range(4)]
            out = []
            for i, (w, first, n, ids) in enumerate(zip(*cols)):
                if w != name:
                    if name is not None:
                        out.append((*row, state.hexdigest()))
                    name, state, row = w, hashlib.sha256(ids.encode()), [batch.column(4)[i].as_py(), n, first]
                else:
                    state.update(b"," + ids.encode())
                    row[1] += n
            if out:
                yield rows_of(out)
        if name is not None:
            yield rows_of([(*row, state.hexdigest())])

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                          names=["key", "n", "conv_id", "ends"])
    sorted_ids = keys.select("name", "conv_id", "key").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    cut = sorted_ids.mapInArrow(chunks, "name binary, first long, n long, ids string, key binary")
    return cut.repartition("name").sortWithinPartitions("name", "first").mapInArrow(hashes, "key binary, n long, conv_id long, ends string")


class _Node:
    """A node of an adaptive radix tree: the bytes of its compressed path, an entry that ends here, and children by byte.

    The layouts, by ``room``: 4 and 16 keep sorted bytes beside the children, 48 a
    slot for each byte value, 256 a child for each byte value.
    """

    __slots__ = ("path", "end", "room", "keys", "kids", "n")

    def __init__(self, path: bytes, end: int = -1):
        self.path, self.end = path, end
        self.room, self.keys, self.kids, self.n = 4, bytearray(), [], 0

    def find(self, byte: int):
        if self.room <= 16:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            slot = self.keys[byte]
            return self.kids[slot - 1] if slot else None
        return self.kids[byte]

    def put(self, byte: int, kid: "_Node") -> None:
        """A new child, or another one in the place of a child."""
        if self.room <= 16:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if self.n == self.room:
                self._grow()
                self.put(byte, kid)
                return
            at = sum(k < byte for k in self.keys)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)
        elif self.room == 48:
            if self.keys[byte]:
                self.kids[self.keys[byte] - 1] = kid
                return
            if self.n == 48:
                self._grow()
                self.put(byte, kid)
                return
            self.kids.append(kid)
            self.keys[byte] = len(self.kids)
        else:
            if self.kids[byte] is not None:
                self.kids[byte] = kid
                return
            self.kids[byte] = kid
        self.n += 1

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            slots = bytearray(256)
            for slot, byte in enumerate(self.keys):
                slots[byte] = slot + 1
            self.room, self.keys = 48, slots
        else:
            kids = [self.kids[slot - 1] if slot else None for slot in self.keys]
            self.room, self.keys, self.kids = 256, bytearray(), kids

    def children(self) -> Iterator["_Node"]:
        """In the order of their bytes."""
        if self.room <= 16:
            return iter(list(self.kids))
        if self.room == 48:
            return (self.kids[slot - 1] for slot in self.keys if slot)
        return (kid for kid in self.kids if kid is not None)


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of path agree with key from there on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if path[:mid] == key[at:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class AdaptiveRadixTree:
    """Keys to entry numbers."""

    def __init__(self):
        self.root: _Node | None = None

    def insert(self, key: bytes, entry: int) -> None:
        if self.root is None:
            self.root = _Node(key, entry)
            return
        above, byte, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            m = _common(path, key, at)
            at += m
            if m < len(path):  # the path parts here
                top = _Node(path[:m])
                node.path = path[m + 1:]
                top.put(path[m], node)
                if at == len(key):
                    top.end = entry
                else:
                    top.put(key[at], _Node(key[at + 1:], entry))
                if above is None:
                    self.root = top
                else:
                    above.put(byte, top)
                return
            if at == len(key):
                node.end = entry
                return
            kid = node.find(key[at])
            if kid is None:
                node.put(key[at], _Node(key[at + 1:], entry))
                return
            above, byte, node, at = node, key[at], kid, at + 1


def turn_nodes(keys: list[bytes], n: list[int], conv: list[int], left: int = -1, right: int = -1) -> dict[str, np.ndarray]:
    """The trie of sorted, distinct keys, a node for each turn-aligned depth, children before parents.

    ``left`` and ``right``: up to which depth the first and the last key share
    their nodes with the stretches beside this one (-1: not even the root).
    Columns: first, last (entries below), depth, conv_id, n_convs, n_children,
    n_leaves, saved, end (entry or -1), parent (number of the node above or -1),
    shared, on_right, owned.  A shared node's ``saved`` lacks the shared nodes below
    and itself, its ``n_children`` those that an earlier stretch counts.
    """
    tree = AdaptiveRadixTree()
    for entry, key in enumerate(keys):
        tree.insert(key, entry)
    last_entry = len(keys) - 1
    out: list[tuple] = []
    parent: list[int] = []
    # a frame: node, byte depth behind its path, first byte depth that is its own, children to come,
    # and of what is done below: first entry, last entry, smallest id, members, leaves, saved, counted children, nodes without parent
    frames: list[list] = []

    def enter(node: _Node, start: int) -> None:
        e = node.end
        own = [e, e, conv[e], n[e]] if e >= 0 else [last_entry + 1, -1, None, 0]
        frames.append([node, start + len(node.path), start, node.children(), *own, 0, 0, 0, []])

    if tree.root is not None:
        enter(tree.root, 0)
    while frames:
        frame = frames[-1]
        kid = next(frame[3], None)
        if kid is not None:
            enter(kid, frame[1] + 1)
            continue
        frames.pop()
        node, stop, start, _, first, last, low, members, leaves, saved, counted, waiting = frame
        if not node.n:  # a leaf, but for a last key that the next stretch goes on with
            leaves = 0 if last == last_entry and stop // WIDTH <= right else 1
        key = keys[first]
        for depth in range(stop // WIDTH, -(-start // WIDTH) - 1, -1):
            at = depth * WIDTH
            on_right = last == last_entry and depth <= right
            on_left = first == 0 and depth <= left
            if not (on_right or on_left) and depth:
                saved += (members - 1) * int.from_bytes(key[at - WORDS:at], "big")
            number = len(out)
            out.append((first, last, depth, low, members, counted, leaves, saved, node.end if at == stop else -1, on_right or on_left, on_right, on_right and not on_left))
            parent.append(-1)
            for child in waiting:
                parent[child] = number
            counted, waiting = (0 if on_left else 1), [number]
        if frames:
            up = frames[-1]
            up[4], up[5] = min(up[4], first), max(up[5], last)
            up[6] = low if up[6] is None else min(up[6], low)
            up[7] += members
            up[8] += leaves
            up[9] += saved
            up[10] += counted
            if len(waiting) > len(up[11]):
                waiting, up[11] = up[11], waiting
            up[11].extend(waiting)
    names = ("first", "last", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "end", "shared", "on_right", "owned")
    cols = dict(zip(names, map(np.array, zip(*out)))) if out else {c: np.zeros(0, np.int64) for c in names}
    return cols | {"parent": np.array(parent, np.int64)}


NODES = ("stretch int, shared boolean, node_id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved long, ends string, words long, on_right boolean, owned boolean")


def _names(key: bytes, depth: int) -> list[bytes]:
    """Names of a key's beginnings of 0 to ``depth`` turns."""
    state, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(state.digest()[:16])
        state.update(key[d * WIDTH:(d + 1) * WIDTH])
    return out


def _stretches(keys: DataFrame) -> dict[int, tuple[int, int]]:
    """By partition of sorted keys: turns that its first key shares with the key before, and its last with the one behind."""
    def work(batches: Iterator[pa.RecordBatch]):
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()),
                                              pa.array([last], pa.binary())], names=["stretch", "first", "last"])
    shares: dict[int, list[int]] = {}
    before = None
    for row in keys.select("key").mapInArrow(work, "stretch int, first binary, last binary").orderBy("stretch").toLocalIterator():
        shares[row[0]] = [-1, -1]
        if before is not None:
            depth = _common(bytes(before[2]), bytes(row[1]), 0) // WIDTH
            shares[row[0]][0] = shares[before[0]][1] = depth
        before = row
    return {k: tuple(v) for k, v in shares.items()}


def _trees(keys: DataFrame) -> DataFrame:
    """Nodes of every stretch; of shared ones their part."""
    shares = _stretches(keys)

    def work(batches: Iterator[pa.RecordBatch]):
        stretch = TaskContext.get().partitionId()
        key, n, conv, ends = [], [], [], []
        for batch in batches:
            for col, held in zip(batch.columns, (key, n, conv, ends)):
                held.extend(col.to_pylist())
        if not key:
            return
        left, right = shares[stretch]
        cols = turn_nodes(key, n, conv, left, right)
        by_left, by_right = _names(key[0], left), _names(key[-1], right)

        def name(i: int) -> bytes | None:
            if i < 0 or not cols["shared"][i]:
                return None
            return (by_right if cols["on_right"][i] else by_left)[cols["depth"][i]]
        total = len(cols["depth"])
        for a in range(0, total, 50_000):
            b = min(total, a + 50_000)
            up = cols["parent"][a:b]
            alone = (up >= 0) & ~cols["shared"][up].astype(bool)
            words = [int.from_bytes(key[f][d * WIDTH - WORDS:d * WIDTH], "big") if d else 0 for f, d in zip(cols["first"][a:b].tolist(), cols["depth"][a:b].tolist())]
            longs = {c: pa.array(cols[c][a:b].astype(np.int64)) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b - a, stretch, np.int32)), pa.array(cols["shared"][a:b].astype(bool)), pa.array([name(i) for i in range(a, b)], pa.binary()),
                 pa.array([name(i) for i in up.tolist()], pa.binary()), longs["conv_id"], longs["depth"],
                 pa.array(cols["conv_id"][up].astype(np.int64), mask=~alone), longs["n_convs"], longs["n_children"], longs["n_leaves"], longs["saved"],
                 pa.array([ends[i] if i >= 0 else None for i in cols["end"][a:b].tolist()], pa.string()), pa.array(words, pa.int64()),
                 pa.array(cols["on_right"][a:b].astype(bool)), pa.array(cols["owned"][a:b].astype(bool))],
                names=[c.split()[0] for c in NODES.split(", ")])
    return keys.mapInArrow(work, NODES)


def prefix_trie(keys: DataFrame, tree_keys: int = TREE_KEYS, tree_bytes: int = TREE_BYTES, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    keys: (conv_id, key, name), as ``conversation_keys`` makes them.
    """
    spark = keys.sparkSession
    distinct = materialise(distinct_keys(keys, chunk))
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("b")).first()
    wide = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // 1000))
    parts = max(1, -(-size.n // tree_keys), -(-size.b // tree_bytes), wide if tree_keys == TREE_KEYS else 1)
    ordered = materialise(distinct.repartitionByRange(parts, "key").sortWithinPartitions("key"))
    nodes = materialise(_trees(ordered))

    parted = nodes.where("shared")
    whole = parted.groupBy("node_id").agg(
        F.max("parent_id").alias("parent_id"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.max("ends").alias("ends"))
    whole = materialise(whole)
    counts = whole.select("node_id", F.col("conv_id").alias("all_conv_id"), F.col("n_convs").alias("all_convs"))
    met = parted.select("node_id", "stretch", "depth", "saved", "words", "on_right", "owned").join(counts, "node_id")
    own = F.when(F.col("owned"), (F.col("all_convs") - 1) * F.col("words")).otherwise(0)
    below = F.sum(own).over(Window.partitionBy("stretch", "on_right").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    saved = met.select("node_id", (F.col("saved") + F.when(F.col("on_right"), below).otherwise(0)).alias("saved")).groupBy("node_id").agg(F.sum("saved").alias("saved"))
    above = whole.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    borders = whole.join(saved, "node_id").join(above, "parent_id", "left")

    # nodes of a stretch below a shared one: the key has the stretch, so that a common parent's children stay apart
    parents = met.select("stretch", F.col("node_id").alias("parent_id"), "all_conv_id")
    inner = nodes.where("not shared")
    hung = (inner.where("parent_id is not null").drop("parent_conv_id").join(parents, ["stretch", "parent_id"])
            .withColumnRenamed("all_conv_id", "parent_conv_id"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    return inner.where("parent_id is null").select(*cols).unionByName(hung.select(*cols)).unionByName(borders.select(*cols))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations of a table (conv_id, turn, role, text) after ``regraft``."""
    return prefix_trie(conversation_keys(regraft(materialise(turn_ids(conversations)))))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations of a table (conv_id, turn, role, text) as they are."""
    turns = materialise(turn_ids(conversations))
    marks = turns.where("pos = 0").select("conv_id", F.lit(0).alias("part"), "pos", F.lit(b"").alias("id"))
    return prefix_trie(conversation_keys(turns.select("conv_id", F.lit(1).alias("part"), "pos", "id").unionByName(marks)))
