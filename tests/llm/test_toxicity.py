import random
import zlib

import numpy as np
import pytest

from ticketlens.llm import toxicity as X

BAD = ["dreckbold", "snarfling", "wuzzock"]


def corpus(n, seed):
    rnd = random.Random(seed)
    parts = ["ta", "ri", "no", "mel", "ko", "su", "lan", "ép", "ung"]
    out = []
    for i in range(n):
        w = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 400))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(BAD))
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def fast():
    old = X.SCHEDULE
    X.SCHEDULE = ((1, 40), (0, 20))
    yield
    X.SCHEDULE = old


def frames(spark, data):
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t, _ in data], "doc_id long, text string, lang string, score string, predicted int")
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in data], "doc_id long, quality int, toxic int, text string")
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark, fast):
    data = corpus(900, 1) + [(5000, None, None), (5001, "", None), (5002, "!!! ...", None), (None, "ta ri", None), (5003, "riko " * 30000 + "snarfling", 1)]
    docs, labels = frames(spark, data + [data[7]])
    got = X.classify(docs, labels).collect()
    assert len(got) == len(data) + 1
    truth = {i: y for i, _, y in data}
    tested = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id in (None, 5000, 5001, 5002, 5003)}
    assert odd[5003].predicted == 1 and all(odd[k].predicted == 0 for k in (None, 5000, 5001, 5002))
    assert all(0 <= r.score <= 1 for r in got)


def test_misspelling_shares_vectors(fast):
    data = corpus(900, 2)
    m = X.train([t for _, t, _ in data], np.array([y for _, _, y in data]))
    seen, new, clean = m.scores(["ta snarfling ri", "ta snarfflingg ri", "ta mellan ri"])
    assert seen > 0.7 and new > 0.5 and clean < 0.1


def test_score_ignores_labels_of_held_out_rows(spark, fast):
    data = corpus(400, 3)
    docs, labels = frames(spark, data)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, t, y in data]
    assert X.training_sample(docs, labels)[0] == X.training_sample(docs, frames(spark, flipped)[1])[0]


def test_a_long_text_does_not_end_the_sample(spark):
    data = corpus(400, 6)
    order = spark.createDataFrame([(i,) for i, _, _ in data], "doc_id long").where(~X.held_out(X.F.col("doc_id"))).orderBy(X.F.xxhash64("doc_id"))
    order = [r.doc_id for r in order.collect()]
    label = {i: y for i, _, y in data}
    first = {k: next(i for i in order if label[i] == k) for k in (0, 1)}
    long = [(i, "ri tano " * 375_000 if i in first.values() else t, y) for i, t, y in data]
    docs, labels = frames(spark, long)
    texts, y = X.training_sample(docs, labels)
    rest = [i for i in order if i not in first.values()]
    assert texts == [data[i][1] for i in rest] and y.tolist() == [label[i] for i in rest]
    # a class with nothing that fits still has its shortest text
    only = [r for r in long if r[2] == 0 or r[0] == first[1]]
    assert X.training_sample(*frames(spark, only))[1].sum() == 1


def test_drawing_goes_on_in_what_is_left(spark):
    sizes = spark.createDataFrame([(k, k, n) for k, n in enumerate([4, 9, 3, 0, 8, 2, 0, 1, 1])], "doc_id long, draw long, n int")
    assert X.drawn(sizes, 3, 10) == [0, 2, 5]
    assert X.drawn(sizes.where("doc_id <> 3"), 4, 10) == [0, 2, 5, 7]
    assert X.drawn(sizes.where("n > 0"), 5, 10) == [0, 2, 5, 7]


def test_without_labels_and_empty(spark):
    docs, labels = frames(spark, corpus(10, 4))
    assert {r.score for r in X.classify(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert X.classify(docs.limit(0), labels.limit(0)).collect() == []
    kept = X.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 10


def test_bags_by_hand():
    b = X.bags(["Ab c", "", "ab"])
    assert b.text.tolist() == [0, 0, 2]
    by_word = [sorted(b.buckets[b.word == k].tolist()) for k in range(3)]
    assert by_word[0] == by_word[2] and len(by_word[0]) == 3 and len(by_word[1]) == 1  # " ab", "ab ", " ab "; " c "


def test_drop_toxic_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a text", 7, 8), (2, None, 9, 10)], "doc_id long, text string, _toxicity int, toxicity int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(X.drop_toxic(df, labels).collect()) == [(1, "a text", 7, 8), (2, None, 9, 10)]
