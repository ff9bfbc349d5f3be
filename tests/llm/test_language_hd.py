import zlib

import numpy as np
import pytest

from ticketlens.llm import language_hd as L

WORDS = {"en": "the and of is with this house water morning they have been other people".split(),
         "de": "der und ist nicht mit das haus wasser über schön straße haben werden andere".split(),
         "ru": "это не вода дом утро люди другой быть они очень хорошо когда город".split()}


def texts(n=240):
    rnd = np.random.default_rng(5)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rnd.choice(WORDS[lang], 12)) + ". 42!", lang))
    return out


ODD = [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 -- !", "ru"), (1003, "the water is here", None), (None, "der und das ist", "de"),
       (1004, "the house, the morning", "en"), (1004, "the house, the morning", "en"), (1005, "́", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x") for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string")


def brute(rows, dims):
    """By the definition: sequences of letters, vectors letter by letter, cosines."""
    signs = {}

    def letter(c):
        if c not in signs:
            signs[c] = 1 - 2 * np.unpackbits(L.letter_bits(np.array([c]), dims)[0]).astype(np.int64)
        return signs[c]

    def bundle(text):
        seq = [0]
        for c in (text or "").lower():
            if c.isalpha():
                seq.append(ord(c))
            elif seq[-1] and c != "́":
                seq.append(0)
        seq += [0] if seq[-1] else []
        out = np.zeros(dims, np.int64)
        for a, b, c in zip(seq, seq[1:], seq[2:]):
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return out, any(seq)
    protos = {}
    for i, t, g in rows:
        if g is not None and t is not None and not (i is not None and zlib.crc32(str(i).encode()) % 3 == 1):
            protos[g] = protos.get(g, 0) + bundle(t)[0]
    want = []
    for i, t, _ in rows:
        v, some = bundle(t)
        if not some:
            want.append((i, "und", 0.0))
            continue
        cos = {g: v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-300) for g, p in protos.items()}
        best = min(cos, key=lambda g: (-round(cos[g], 12), g))
        want.append((i, best, max(0.0, cos[best])))
    return want


def key(r):
    return (str(r[0]), r[1], round(r[2], 6))


@pytest.mark.parametrize("group", [1, 2, 512])
def test_equals_the_definition(spark, group):
    rows = texts(90) + ODD
    got = L.classify(frame(spark, rows), dims=256, group=group).collect()
    assert sorted(key((r.doc_id, r.lang_pred, r.score)) for r in got) == sorted(map(key, brute(rows, 256)))
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    rows = texts()
    truth = {i: g for i, _, g in rows}
    held = [r for r in L.classify(frame(spark, rows)).collect() if r.held_out]
    assert len(held) > 50 and all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in held)


def test_long_texts_come_in_pieces(spark):
    text = "Straße 12, " + "the  water...́ 是 " * 50 + "дом"
    whole = [np.sort(g) for _, g in L.grams_of([text])][0]
    for size in (1, 2, 7, 100):
        parts = np.concatenate([g for _, g in L.grams_of([text], size)])
        assert (np.sort(parts) == whole).all()
    rows = texts(60) + [(2000, " ".join(WORDS["ru"]) * 20_000, "ru"), (2001, "x" * 700_000, "en"), (2002, "12 " * 300_000, "en")]
    got = {r.doc_id: r for r in L.classify(frame(spark, rows), dims=256).collect()}
    assert got[2000].lang_pred == "ru" and got[2002].lang_pred == "und"


def test_many_distinct_grams_do_not_fit_the_table():
    rnd = np.random.default_rng(1)
    text = "".join(chr(c) for c in rnd.integers(0x4E00, 0x9FA0, 5000))
    (row, gram), = L.grams_of([text, "the water"])
    small, large = L.GramVectors(128, kept=1000), L.GramVectors(128, kept=9000)
    assert np.array_equal(small.bundles(row, gram, 2), large.bundles(row, gram, 2))
    for t in ("the water", "other people", text, "the water"):
        (row, gram), = L.grams_of([t])
        assert np.array_equal(small.bundles(row, gram, 1), large.bundles(row, gram, 1))


def test_nothing_to_learn_from(spark):
    got = L.classify(frame(spark, [(1, "the water", None), (2, None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    empty = L.classify(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "lang_pred", "score"]
