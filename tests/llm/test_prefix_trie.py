import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from ticketlens.llm import prefix_trie as T
from ticketlens.llm import queries


def brute(rows, every=20):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = seqs
    if every:
        built = {}
        for c, own in seqs.items():
            h = zlib.crc32(str(c).encode()) % 4
            built[c] = seqs.get(c - c % every, [])[:h] + own[h:]
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    total = {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below = kids.get(k, [])
        total[k] = (own + sum(total[x][0] for x in below), sum(total[x][1] for x in below) or 1)
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(built[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(below), total[k][1], total[k][0],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def data(seed=1, convs=400):
    rnd = random.Random(seed)
    texts = ["a", "a b", "  a\tb c ", "", "é x", "hello there  you"]
    rows = []
    for c in range(convs):
        n = rnd.choice([1, 1, 2, 3, 5, 8])
        hot = c % 3 == 0  # a third of all conversations are copies, another third begin alike
        for t in range(4 if hot else n):
            text = "same" if hot or (c % 3 == 1 and t == 0) else rnd.choice(texts)
            rows.append((c, t, "user" if hot else rnd.choice(["user", "assistant"]), text))
    long = [(7000 + c, t, "user", f"turn {t}" if t < 60 + c else f"own {c}") for c in range(6) for t in range(70)]
    odd = [(8000, None, None, None), (8000, 0, "user", "x"), (8001, 1, "user", None), (None, 0, "user", "lost"), (8002, 0, "b", "tie"), (8002, 0, "a", "tie"),
           (8002, 0, "a", "tie"), (-40, 0, "user", "minus"), (-41, 0, "user", "minus"), (8003, 0, "a", "b1"), (8004, 0, "ab", "1")]
    rows += long + odd
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("tree_keys,chunk", [(50_000, 1 << 16), (40, 20), (3, 1)])
def test_equals_brute_force(spark, tree_keys, chunk):
    rows = data()
    keys = T.conversation_keys(T.regraft(T.turn_ids(frame(spark, rows))))
    assert result(T.prefix_trie(keys, tree_keys=tree_keys, chunk=chunk)) == brute(rows)


def test_as_they_are(spark):
    rows = data(2, 60)
    assert result(T.conversation_trie(frame(spark, rows))) == brute(rows, 0)


def test_few_rows(spark):
    for rows in ([], [(None, 0, "a", "b")], [(5, 0, "a", "b")], [(1, 0, "a", "b"), (1, 1, "a", "b")]):
        assert result(T.rebuilt_trie(frame(spark, rows))) == brute(rows)


def test_oracle(spark):
    rows = data(3, 80)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = con.sql(queries.SQL["op13_radix_prefix_trie"])
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(got.fetchall(), key=str) == brute(rows)


def test_nodes_grow_through_all_layouts():
    rnd = random.Random(6)
    keys = sorted({bytes([a]) * T.WIDTH + bytes(rnd.randrange(256) for _ in range(T.WIDTH * rnd.randrange(3))) for a in range(256) for _ in range(3)} | {b""})
    tree = T.AdaptiveRadixTree()
    order = list(range(len(keys)))
    rnd.shuffle(order)
    rooms = set()
    for i in order:
        tree.insert(keys[i], i)
        rooms.add(tree.root.room)
    assert rooms == {4, 16, 48, 256}
    found, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        found += [node.end] if node.end >= 0 else []
        stack.extend(reversed(list(node.children())))
    assert found == list(range(len(keys)))  # in the order of the bytes
    ids, n = list(range(len(keys))), [1] * len(keys)
    cols = T.turn_nodes(keys, n, ids)
    assert set(cols["depth"].tolist()) <= {0, 1, 2, 3} and (cols["depth"] == 0).sum() == 1 and (cols["depth"] == 1).sum() == 256
