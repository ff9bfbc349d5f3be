import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import components as C
from ticketlens.llm import jaccard_join as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(data, n, num, den):
    sets = [grams(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i), d))) for i, ((d, _), s) in enumerate(zip(data, sets)))


def data(seed, n_docs):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["Ärger", "The", "the", "a,b", "x y", "q​"]
    bases = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 8, 20, 40, 90, 200]))] for _ in range(12)]
    passage = [rnd.choice(vocab) for _ in range(25)]
    out = []
    for i in range(n_docs):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
            k = rnd.randrange(len(w) + 1)
            rnd.choice([lambda: w.insert(k, rnd.choice(vocab)), lambda: w.__setitem__(min(k, len(w) - 1), rnd.choice(vocab)),
                        lambda: w.pop(min(k, len(w) - 1)) if len(w) > 1 else None])()
        if rnd.random() < 0.2:
            w = w[:len(w) // 2] + passage + w[len(w) // 2:]
        out.append((i, rnd.choice([" ", "  ", "\n", "\t "]).join(w)))
    return out + [(900, None), (901, ""), (902, " \n "), (903, ""), (5, out[5][1]), (6, "own words with this id"), (None, out[0][1].upper()), (None, "alone here")]


def run(spark, rows, n, num, den, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, f0 int").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in X.jaccard_components(df, n, num, den, **more).collect())


@pytest.mark.parametrize("seed,n,num,den", [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 60, 100)])
def test_equals_brute_force(spark, seed, n, num, den):
    rows = data(seed, 220)
    assert run(spark, rows, n, num, den) == brute(rows, n, num, den)


def test_large_components_in_blocks(spark):
    rows = data(4, 150)
    assert run(spark, rows, 2, 70, 100, task_tokens=300) == brute(rows, 2, 70, 100)


def test_a_common_passage_does_not_join_everything(spark):
    rnd = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for i in range(60):
        body = [f"w{i}x{k}" for k in range(20)]
        rows.append((2 * i, " ".join(body[:10]) + " " + passage + " " + " ".join(body[10:])))
        near = list(body)
        near[rnd.randrange(20)] = f"changed{i}"
        rows.append((2 * i + 1, " ".join(near[:10]) + " " + passage + " " + " ".join(near[10:])))
    want = brute(rows, 2, 80, 100)
    assert len({c for *_, c in want}) == 60
    assert run(spark, rows, 2, 80, 100, task_tokens=500) == want
    sets = X._sets_of(spark.createDataFrame(rows, "id long, text string").select(F.col("id").cast("string").cast("binary").alias("f"), "text"), 2)
    got = X._refined(sets, 80, 100).groupBy("root").count().collect()
    assert max(r["count"] for r in got) == 2


def test_any_similar_pair_shares_a_key():
    rnd = random.Random(8)
    for num in (50, 70, 80, 90, 95):
        for _ in range(400):
            a = {rnd.getrandbits(64) for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 15, 30, 80]))}
            b = set(a)
            for _ in range(rnd.randint(0, max(1, len(a) // 3))):
                rnd.choice([lambda: b.add(rnd.getrandbits(64)), lambda: b.discard(next(iter(b), None))])()
            if not b or 100 * len(a & b) < num * len(a | b):
                continue
            flat = [(k, g) for k, s in enumerate((a, b)) for g in sorted(s)]
            text, key = X.signature_keys(np.array([k for k, _ in flat]), np.array([g for _, g in flat], np.uint64), num, 100)
            assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_tree_links_span_what_is_similar():
    rnd = random.Random(2)
    for num in (60, 80, 90):
        base = rnd.sample(range(10_000), 60)
        sets = [set(base) ^ set(rnd.sample(range(10_000), rnd.randint(0, 12))) - set(rnd.sample(base, rnd.randint(0, 8))) for _ in range(70)]
        names = np.arange(70)
        found = X.tree_links(names, [np.array(sorted(s), np.uint64) for s in sets], num, 100)
        assert all(100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) for i, j in found)
        parent = {i: i for i in range(70)}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for i, j in found:
            parent[find(i)] = find(j)
        assert len(found) == 70 - len({find(i) for i in range(70)})
        assert all(find(i) == find(j) for i in range(70) for j in range(i) if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]))


def test_components(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(80)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {i: find(i) for i in root if any(find(j) == find(i) and j != i for j in root)}
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert C.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_drop_near_copies(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(9, long), (4, long + " more"), (7, "other"), (8, None), (2, ""), (7, "other"), (3, "other words entirely here now")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, root string")
    got = X.drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(3, rows[6][1]), (4, rows[1][1]), (7, "other")]
    assert got.where("doc_id in (2, 8)").count() == 2
    assert X.drop_near_copies(df.limit(0)).collect() == []


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_words_that_polynomials_confuse(spark):
    w = thue_morse(1024)
    rows = [(1, w), (2, w.translate(str.maketrans("ab", "ba"))), (3, w + " x"), (4, "y " + w), (5, w), (6, "z" * 300_000), (7, "z" * 300_001)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)


def test_word_names():
    rnd = random.Random(3)
    words = [bytes(rnd.choice(b"ab") for _ in range(k)) for k in list(range(1, 40)) * 3 + [255, 256, 257, 300]] + [b"a", b"a\0", b"a\0\0", b"\0"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    names = X.word_names(data, end - [len(w) for w in words], end)
    alone = [int(X.word_names(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words]
    assert names.tolist() == alone
    assert len(set(alone)) == len(set(words))


def test_tasks_link_what_shares_a_key_there(spark, monkeypatch):
    rows = data(6, 120)
    for held in (1, 50, 1 << 18):
        monkeypatch.setattr(X, "HELD_KEYS", held)
        keys = X.signatures(X._keyed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), 3, 80, 100)
        got = [tuple(r) for r in keys.collect()]
        keep = [(k, f) for k, f, linked in got if not linked]
        if held == 1 << 18:
            assert len({k for k, _ in keep}) == len(keep)
        roots = {r.node: r.root for r in C.components(X.candidate_links(keys)).collect()}
        if held == 1:
            want = roots
        assert roots == want


def test_drop_near_copies_with_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(100))
    names = ["_nth", "_key", "_h", "nth", "of", "rid", "f0", "root", "component"]
    df = spark.createDataFrame([(i, t, *range(i, i + 9)) for i, t in [(1, long), (2, long + " more"), (3, "other"), (3, "other")]],
                               "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = sorted(X.drop_near_copies(df).collect())
    assert [tuple(r)[2:] for r in got] == [tuple(range(1, 10)), tuple(range(3, 12))]
