import math
import random
from collections import Counter, defaultdict

import numpy as np

from ticketlens.llm import quality_lm as Q


def brute(texts):
    """Interpolated modified Kneser-Ney by the book, over symbols."""
    table = Q.symbol_table()
    seqs = [[1] * (Q.ORDER - 1) + [int(table[ord(c)]) for c in t] for t in texts]
    level = Counter(tuple(s[i - Q.ORDER + 1:i + 1]) for s in seqs for i in range(Q.ORDER - 1, len(s)))
    levels = {}
    for k in range(Q.ORDER, 0, -1):
        if k < Q.ORDER:
            level = Counter(g[1:] for g in level)
        levels[k] = level
    disc = {}
    for k, c in levels.items():
        n = Counter(min(v, 9) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        disc[k] = {}
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else 0
            disc[k][i] = d if d > 0 else 0.5 * i
    tot, taken = defaultdict(float), defaultdict(float)
    for k, c in levels.items():
        for g, v in c.items():
            tot[k, g[:-1]] += v
            taken[k, g[:-1]] += disc[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / Q.A
        k, lower = len(g), p(g[1:])
        if (k, g[:-1]) not in tot:
            return lower
        c = levels[k].get(g, 0)
        mass = (c - disc[k][min(c, 3)]) / tot[k, g[:-1]] if c else 0
        return mass + taken[k, g[:-1]] / tot[k, g[:-1]] * lower

    def perplexity(t):
        s = [1] * (Q.ORDER - 1) + [int(table[ord(c)]) for c in t]
        return 2 ** (-sum(math.log2(p(tuple(s[i - Q.ORDER + 1:i + 1]))) for i in range(Q.ORDER - 1, len(s))) / len(t))
    return perplexity


def text(rnd, n=40):
    return " ".join("".join(rnd.choice(["ta", "ri", "no", "mel"]) for _ in range(rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_perplexity_equals_the_book(spark):
    rnd = random.Random(3)
    good = [text(rnd, 12) for _ in range(8)]
    docs = [(i, "en", t) for i, t in enumerate(good)] + [(50, "en", "QX!! %% tari"), (51, "fr", "no mel"), (52, None, good[0]), (53, "en", ""), (54, "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    model = Q.tables(Q.counts(df.where("doc_id < 50")))
    got = {r.doc_id: r.perplexity for r in Q.score(df.repartition(3), model).collect()}
    want = brute(good)
    for i, _, t in docs:
        if t:
            assert abs(got[i] / want(t) - 1) < 1e-3, i
        else:
            assert got[i] is None


def test_keeps_clean_and_rejects_junk(spark):
    rnd = random.Random(5)
    clean = [(i, "en" if i % 2 else "de", text(rnd, rnd.randint(1, 60)), 1 if i % 3 else None) for i in range(900)]
    junk = [(10000 + i, "en", text(rnd).upper().replace(" ", "!! "), 0) for i in range(30)] + [(20000 + i, "xx", "@@ ## " * 50, None) for i in range(5)]
    rows = clean + junk + [(3000, "en", None, 1), (3001, "en", "", None), (None, None, text(rnd), None), clean[4]]
    docs = spark.createDataFrame([(a, b, c, "k") for a, b, c, _ in rows], "doc_id long, lang string, text string, kept string")
    labels = spark.createDataFrame([(a, q, 0) for a, _, _, q in rows if q is not None and a is not None] + [(None, 1, 1), (10000, 1, 0), (1, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.kept for r in got}
    assert np.mean([by[r[0]] for r in clean]) > 0.98
    assert not any(by[r[0]] for r in junk) and not by[3000] and not by[3001]


def test_no_trusted_text_and_empty(spark):
    docs = spark.createDataFrame([(1, "en", "abc"), (2, None, None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    assert abs(got[1].perplexity - Q.A) < 0.01 and got[1].kept and got[1].threshold is None and not got[2].kept
    assert Q.classify(docs.limit(0), labels).collect() == []


def test_every_character_is_a_symbol_of_its_own(spark):
    rnd = random.Random(7)
    words = ["как", "они", "юла", "für", "über", "\U0001d400\U0001d401\U0001d402"]
    good = [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(6)]
    swaps = [str.maketrans("ак", "ка"), str.maketrans("ü", "è"), str.maketrans("\U0001d400\U0001d402", "\U0001d402\U0001d400")]
    docs = [(i, "x", t) for i, t in enumerate(good)] + [(100 + k, "x", good[0].translate(swap)) for k, swap in enumerate(swaps)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r.doc_id: r.perplexity for r in Q.score(df, Q.tables(Q.counts(df.where("doc_id < 100")))).collect()}
    assert all(got[100 + k] > 1.2 * got[0] for k in range(len(swaps)))
    ctx, s, lens = Q.ngram_codes(["a\U0001d400", "", "\n"])
    assert lens.tolist() == [2, 0, 1] and s.tolist() == [99, 0x1d402, 12]
    assert ctx.tolist() == [(Q.PAD << 42) + (Q.PAD << 21) + Q.PAD, (Q.PAD << 42) + (Q.PAD << 21) + 99, (Q.PAD << 42) + (Q.PAD << 21) + Q.PAD]
