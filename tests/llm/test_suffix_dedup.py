import hashlib
import random

import numpy as np
import pytest

from ticketlens.llm import suffix_dedup as X


def brute(data, threshold):
    first, texts = {}, [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in data]
    for i, t in texts:
        for s in range(len(t) - threshold + 1):
            g = t[s:s + threshold]
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, t), (orig, _) in zip(texts, data):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - threshold + 1):
            if first[t[s:s + threshold]] < i:
                gone[s:s + threshold] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((str(orig), len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, data, threshold, **more):
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, rank string").repartition(4)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.remove_repeats(df, threshold, **more).collect())


def data(seed, letters, n, longest):
    rnd = random.Random(seed)
    share = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 90))) for _ in range(6)]
    out = []
    for i in range(n):
        t = "".join(rnd.choice(share) if rnd.random() < 0.4 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(rnd.randint(0, 6)))
        out.append((i, t))
    out += [(n + 1, None), (n + 2, ""), (n + 3, "a" * 300), (n + 4, "a" * 200 + "b" + "a" * 70), (n + 5, "ab" * 150), (3, out[3][1]), (4, "a" * 120 + "q"),
            (None, share[0] * 2), (n + 6, share[0] * 3)]
    return out


@pytest.mark.parametrize("seed,letters,threshold", [(1, "ab", 9), (2, "abcdefgh é", 50), (3, "abc", 16), (4, "ab", 1), (5, "abcdef", 31)])
def test_equals_brute_force(spark, seed, letters, threshold):
    rows = data(seed, letters, 60, 80)
    assert run(spark, rows, threshold) == brute(rows, threshold)


@pytest.mark.parametrize("hot_runs", [0, 12])
def test_hot_ranks_have_the_same_result(spark, hot_runs):
    rows = data(2, "abcdefgh é", 60, 80)
    assert run(spark, rows, 50, hot_runs=hot_runs) == brute(rows, 50)


def test_pieces_of_huge_texts():
    import ticketlens.llm.suffix_dedup as module
    blocks = module._blocks

    def small(col, threshold):  # what workers do with texts above the block size, at a size a test can hold
        module.PIECE = 97
        try:
            yield from blocks(col, threshold)
        finally:
            module.PIECE = 1 << 18
    import pyarrow as pa
    rows = [t for _, t in data(7, "abcd", 20, 200) if t]
    col = pa.array(rows, pa.string())
    whole, parts = set(), set()
    for got, source in ((whole, blocks), (parts, small)):
        for row, body, off, base in source(col, 20):
            text, begin, size, rank = module._window_runs(body, off, 20)
            for t, b, n, r in zip(text.tolist(), begin.tolist(), size.tolist(), rank.tolist()):
                got |= {(row + t, base + b - int(off[t]) + k, r) for k in range(n)}
    assert whole == parts and len(whole) == sum(max(0, len(t) - 19) for t in rows)


def test_cut_keeps_characters_and_columns(spark):
    a = "é" * 40
    df = spark.createDataFrame([(1, "x" + a + "y", "en", 42), (2, "zü" + a + "ü", "en", 43), (3, None, "en", 0)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in X.cut_repeats(df, 51).collect()}
    assert X.cut_repeats(df, 51).columns == df.columns
    assert got[1].text == "x" + a + "y" and got[2].text == "züü" and got[2].n_chars == 3 and got[3].text is None


def test_empty(spark):
    assert run(spark, [], 50) == []


def test_cut_repeats_with_clashing_columns(spark):
    passage = "the same passage stands here in both of these documents, word by word, and is cut once "
    names = ["_d", "_spans", "_doc", "_r", "_rid", "doc", "spans", "rid", "d"]
    df = spark.createDataFrame([(i, t, *range(i, i + 9)) for i, t in [(1, passage), (2, "own " + passage)]],
                               "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = sorted(X.cut_repeats(df, 50).collect())
    assert [tuple(r)[2:] for r in got] == [tuple(range(1, 10)), tuple(range(2, 11))]
    assert got[0].text == passage and got[1].text == "own "
