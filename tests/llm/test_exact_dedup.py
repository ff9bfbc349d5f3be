import hashlib
import random

import numpy as np

from ticketlens.llm import exact_dedup as X


def rows():
    rnd = random.Random(3)
    base = ["", None, "a", "b", "ab" * 5000, "é" * 70000, "x" * X.COMPARE_CHUNK, "x" * X.COMPARE_CHUNK + "y"]
    out = [(i, base[i % len(base)]) for i in range(60)] + [(100 + i, f"own {i}") for i in range(20)]
    out += [(7, base[7]), (None, "a"), (None, None), (500, "twice"), (500, "twice"), (501, "one id"), (501, "two texts")]
    rnd.shuffle(out)
    return out


def brute(data):
    groups = {}
    for i, t in data:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data), best


def check(spark, data, primes, part=X.ROW_PART):
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, keep_id string")
    got = X.exact_groups(df, primes, part).collect()
    want, best = brute(data)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(best)  # one of each group, repeated rows too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_groups(spark):
    check(spark, rows(), X.PRIMES)


def test_colliding_fingerprints_are_told_apart(spark):
    check(spark, rows() + [(900 + i, c * 3) for i, c in enumerate("abcdefgh")], (3,))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.exact_groups(df).collect() == []
    assert X.drop_copies(df).collect() == []


def test_chunks_compose(spark):
    rnd = random.Random(1)
    texts = [rnd.randbytes(n) for n in (0, 1, 4095, 4096, 4097, 50000)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = X.fingerprints(data, off)
    for k, p in enumerate(X.PRIMES):
        for t, h in zip(texts, whole[k].tolist()):
            want = 0
            for b in t:
                want = (want * X.BASES[k] + b + 1) % p
            assert h == want
    pieces = [(i, n, t[a:a + 700]) for i, t in enumerate(texts) for n, a in enumerate(range(0, len(t), 700))]
    got = {r.doc_id: r for r in X.combine_chunks(spark.createDataFrame(pieces, "doc_id long, chunk_no int, bytes binary")).collect()}
    assert all(got[i][f"r{k}"] == int(whole[k][i]) and got[i].n_bytes == len(texts[i]) for i in range(1, 6) for k in range(4))


def test_drop_copies_keeps_columns(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, kept string")
    got = X.drop_copies(df)
    assert got.columns == df.columns
    _, best = brute(data)
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t) for t, i in best.items())


def test_ids_with_several_grouped_texts(spark):
    check(spark, [(5, "aaa"), (5, "bbb"), (6, "aaa"), (7, "bbb")], X.PRIMES)
    check(spark, [(5, "aaa"), (5, "bb"), (6, "aaa"), (7, "bb"), (5, "aaa")], X.PRIMES)


def test_null_ids_beside_a_clash(spark):
    for primes in (X.PRIMES, (3,)):
        check(spark, [(None, "aaa"), (None, "aaa"), (5, "aaa"), (5, "bb"), (7, "bb")], primes)
        check(spark, [(None, c) for c in "abcdefgh" * 2], primes)


def test_long_texts_are_hashed_in_parts(spark):
    data = [(i, c * n) for i, (c, n) in enumerate([("a", 9), ("a", 10), ("é", 55), ("é", 55), ("ab", 50), ("ab", 50), ("ba", 50), ("x", 100)])]
    data += [(3, "é" * 55), (None, "ab" * 50), (3, "ab" * 50)]
    for part in (1, 7, 10, 64):
        check(spark, data, X.PRIMES, part)
    prints = {p: sorted(map(str, X.fingerprint_table(spark.createDataFrame(data, "doc_id long, text string"), part=p).collect())) for p in (10, X.ROW_PART)}
    assert prints[10] == prints[X.ROW_PART]


def test_drop_copies_with_clashing_columns(spark):
    names = ["_nth", "_sha", "row", "nth", "keep_id", "text_sha256", "kept", "n_bytes"]
    df = spark.createDataFrame([(i, t, *range(i, i + 8)) for i, t in [(1, "a"), (2, "a"), (3, "b"), (3, "b")]],
                               "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = sorted(X.drop_copies(df).collect())
    assert got == [(2, "a", *range(2, 10)), (3, "b", *range(3, 11))]
