import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import features as X
from ticketlens.operators import model as ML
from ticketlens.operators import softmax


def small_train(spark):
    rows = []
    for i in range(12):
        rows += [(f"where is my order {i} it has not arrived", "track_order"),
                 (f"please refund my payment {i} for the broken item", "get_refund"),
                 (f"i want to cancel order {i} right now", "cancel_order")]
    return spark.createDataFrame(rows, "text string, intent string")


def test_class_weights_are_balanced(spark):
    df = spark.createDataFrame([("a", "x")] * 6 + [("b", "y")] * 2, "text string, intent string")
    w, n = ML.with_class_weights(df, "intent")
    got = {r.intent: r.weight for r in w.select("intent", "weight").distinct().collect()}
    assert n == 8
    assert got == {"x": 8 / (2 * 6), "y": 8 / (2 * 2)}


def test_fit_score_save_load(spark, tmp_path):
    m = ML.fit(small_train(spark), "intent")
    assert ML.classes(m) == ["cancel_order", "get_refund", "track_order"]
    probe = spark.createDataFrame([(1, "my refund payment please"), (2, "cancel my order now")],
                                  "id int, text string")
    s = ML.score(m, probe).orderBy("id").collect()
    assert [r.predicted for r in s] == ["get_refund", "cancel_order"]
    for r in s:
        confs = [t.confidence for t in r.top_intents]
        assert len(confs) == 3 and confs == sorted(confs, reverse=True)
        assert 0.0 <= r.confidence <= 1.0 and r.top_intents[0].intent == r.predicted
    path = os.path.join(str(tmp_path), "intent_model")
    ML.save(m, path)
    again = ML.score(ML.load(path), probe).orderBy("id")
    assert [(r.predicted, round(r.confidence, 9)) for r in again.collect()] == \
        [(r.predicted, round(r.confidence, 9)) for r in s]


def test_char_grams_pad_words(spark):
    df = spark.createDataFrame([("Hi there",)], "text string")
    from pyspark.ml.feature import SQLTransformer
    got = SQLTransformer(statement=ML.CHAR_GRAMS_SQL).transform(df).select(F.col("char_grams")).first()[0]
    # " hi " is 4 chars: its two 3-grams and itself once; " there " (7) has no 7-gram
    assert got[:3] == [" hi", "hi ", " hi "]
    assert got[3:8] == [" th", "the", "her", "ere", "re "]
    assert "ere " in got and " ther" in got and " there " not in got
    assert len(got) == 3 + 5 + 4 + 3


def test_query_type_model_or_fallback(spark):
    rows = []
    for i in range(10):
        rows += [(f"where is my parcel {i}", "delivery"), (f"refund my card payment {i}", "payment")]
    m = ML.fit(spark.createDataFrame(rows, "text string, query_type string"), "query_type")
    probe = spark.createDataFrame([(1, "my parcel is late", "track_order")], "id int, text string, pred_intent string")
    r = ML.score_query_type(probe, m).first()
    assert (r.query_type, r.query_type_source) == ("delivery", "model") and 0.5 < r.query_type_confidence <= 1
    d = ML.score_query_type(probe).first()
    assert d.query_type_confidence is None and d.query_type_source == "intent"
    from ticketlens.functions.text import query_type_for
    assert d.query_type == probe.select(query_type_for("pred_intent")).first()[0]


def test_sigmoids_equal_a_plain_newton_fit(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=300)
    hit = rng.random(300) < 1 / (1 + np.exp(-2 * f + 0.5))
    got = ML.fit_sigmoids(spark.createDataFrame([("x", float(a), bool(h)) for a, h in zip(f, hit)] + [("y", float(a), not bool(h)) for a, h in zip(f, hit)],
                                                "name string, value double, hit boolean"))
    pos, neg = hit.sum(), (~hit).sum()
    t = np.where(hit, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, np.log((neg + 1) / (pos + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(a * f + b))
        g = np.array([((t - p) * f).sum(), (t - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * f * f).sum(), (w * f).sum()], [(w * f).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert abs(got["x"][0] - a) < 1e-6 and abs(got["x"][1] - b) < 1e-6 and got["y"][0] > 0 > got["x"][0]


def test_calibrated_folds(spark):
    m = ML.fit_calibrated(small_train(spark), "intent")
    assert len(m.folds) == 3
    probe = spark.createDataFrame([(1, "my refund payment please"), (2, "cancel my order now")], "id int, text string")
    s = ML.score_calibrated(m, probe).orderBy("id").collect()
    assert [r.predicted for r in s] == ["get_refund", "cancel_order"]
    assert all(abs(sum(t.confidence for t in r.top_intents) - 1) < 1e-3 and r.top_intents[0].intent == r.predicted for r in s)


def test_registered_evaluations_train_the_operators_own_model(spark, monkeypatch):
    from ticketlens.plans import jobs
    from ticketlens.plans import prep_queries as Q
    seen = []

    class Stop(Exception):
        pass

    def solved(cells, labels, columns, classes, *limits):
        seen.append(limits)
        raise Stop
    train = small_train(spark).select("text", "intent", F.col("intent").alias("query_type"), F.lit("train").alias("split"))
    monkeypatch.setattr(jobs, "training_set", lambda spark, sf_dir: train)
    monkeypatch.setattr(softmax, "fit", solved)
    for query in (Q.intent_model_eval, Q.calibrated_model_eval):
        with pytest.raises(Stop):
            query(spark, "")
    assert seen == [(softmax.TOLERANCE, softmax.MAX_ITER, softmax.DRIVER_BYTES)] * 2


# M1-M3 against plain Python ------------------------------------------------------
TEXTS = [("where is my parcel", "delivery"), ("Where is my parcel", "delivery"), ("my parcel 17 is late", "delivery"), ("refund my payment", "payment"),
         ("refund my payment 23", "payment"), ("a refund a refund", "payment"), ("cancel the order", "order"), ("cancel the order now", "order"),
         ("where is my parcel", "order"), ("", "order"), (None, "payment"), ("é x", "delivery"), ("no label here", None)]


def py_grams(text):
    low = (text or "").lower()
    w = re.findall(r"\b\w\w+\b", low)
    out = Counter(("word", t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for x in low.split():
        x = f" {x} "
        out.update(("char", x[i:i + n]) for n in (3, 4, 5) for i in range(len(x) - n + 1))
    return out


def py_features(texts):
    rows = [py_grams(t) for t in texts]
    df = Counter(t for r in rows for t in r)
    idf = {t: math.log((1 + len(rows)) / (1 + d)) + 1 for t, d in df.items()}
    names = sorted(df)
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for b in ("word", "char"):
            v = {t: (1 + math.log(c)) * idf[t] for t, c in r.items() if t[0] == b}
            norm = math.sqrt(sum(a * a for a in v.values()))
            for t, a in v.items():
                x[i, names.index(t)] = a / norm
    return names, df, idf, x


def newton(x, y, weight, k):
    """The optimum of the penalised problem, by dense Newton steps."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    penalty = np.tile(np.append(np.ones(d), 0.0), k)
    p = np.zeros((k, d + 1))
    for _ in range(60):
        z = a @ p.T
        e = np.exp(z - z.max(axis=1, keepdims=True))
        q = e / e.sum(axis=1, keepdims=True)
        g = ((q - np.eye(k)[y]) * weight[:, None]).T @ a + penalty.reshape(k, -1) * p
        h = np.zeros((k * (d + 1),) * 2)
        for i in range(k):
            for j in range(k):
                s = weight * q[:, i] * ((i == j) - q[:, j])
                h[i * (d + 1):(i + 1) * (d + 1), j * (d + 1):(j + 1) * (d + 1)] = (a * s[:, None]).T @ a
        step = np.linalg.lstsq(h + np.diag(penalty), g.ravel(), rcond=None)[0]
        p = p - step.reshape(k, -1)
        if np.abs(g).max() < 1e-10:
            break
    return p


def test_vocabulary_and_features(spark):
    texts = [t for t, _ in TEXTS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    terms = X.term_rows(df, "row", "text")
    v = X.fit_vocabulary(terms, len(texts))
    names, count, idf, x = py_features(texts)
    got = v.collect()
    assert {(r.block, r.term): r.df for r in got} == dict(count)
    assert all(abs(r.idf - idf[r.block, r.term]) < 1e-12 for r in got)
    assert [(r.block, r.term) for r in sorted(got, key=lambda r: r.idx)] == names and sorted(r.idx for r in got) == list(range(len(names)))
    cells = {(r.row, r.idx): r.x for r in X.feature_rows(terms, v).collect()}
    assert len(cells) == int((x != 0).sum()) and all(abs(x[i, j] - c) < 1e-12 for (i, j), c in cells.items())


def test_vocabulary_of_texts_without_a_count_by_row(spark):
    texts = [t for t, _ in TEXTS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    terms = X.document_terms(df, "text")
    assert terms.columns == ["block", "term"]
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan  # nothing is counted by row
    names, count, _, _ = py_features(texts)
    got = X.fit_vocabulary(terms, len(texts)).orderBy("idx").collect()
    assert [(r.block, r.term) for r in got] == names and {(r.block, r.term): r.df for r in got} == dict(count)
    assert got == X.fit_vocabulary(X.term_rows(df, "row", "text"), len(texts)).orderBy("idx").collect()


@pytest.mark.parametrize("driver_bytes", [1 << 28, 20_000])
def test_fit_equals_the_dense_optimum(spark, driver_bytes):
    df = spark.createDataFrame(TEXTS, "text string, query_type string")
    m = ML.fit(df, "query_type", tolerance=1e-7, driver_bytes=driver_bytes)
    used = [(t, g) for t, g in TEXTS if g is not None]
    names, _, _, x = py_features([t for t, _ in used])
    kinds = sorted({g for _, g in used})
    y = np.array([kinds.index(g) for _, g in used])
    want = newton(x, y, len(used) / (len(kinds) * np.bincount(y)[y]), len(kinds))
    assert ML.classes(m) == kinds
    got = {(r.block, r.term): r.w for r in m.terms.collect()}
    assert set(got) == set(names)
    assert max(abs(a - b) for j, t in enumerate(names) for a, b in zip(got[t], want[:, j])) < 1e-4
    gap = np.array(m.bias) - want[:, -1]
    assert np.abs(gap - gap.mean()).max() < 1e-4
    z = x @ want[:, :-1].T + want[:, -1]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(used)] + [(90, "unknown ζζζ")], "id int, text string")
    for r in ML.score(m, rows).collect():
        if r.id < 90:
            assert abs(r.confidence - p[r.id].max()) < 1e-4 and len(r.top_intents) == 3


def test_compact_merges_equal_rows_and_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab cd", "ab cd", "cd ab", "", None, "ef"])], "row long, text string")
    terms = X.term_rows(df, "row", "text")
    labelled = spark.createDataFrame([(i, "xyxxyx"[i], 1.0) for i in range(6)], "row long, label string, weight double")
    cells, labels, columns = X.compact(X.feature_rows(terms, X.fit_vocabulary(terms, 6)), labelled)
    by = {}
    for r in labels.collect():
        by.setdefault(r.r, {})[r.label] = r.weight
    assert sorted(map(str, by.values())) == sorted(map(str, [{"x": 1.0, "y": 1.0}, {"x": 1.0}, {"x": 1.0, "y": 1.0}, {"x": 1.0}])) or len(by) == 4
    cols = columns.collect()
    assert len({r.idx for r in cols}) == len(cols) and sum({r.c: r.m for r in cols}.values()) == len(cols)
    assert len({r.c for r in cols}) < len(cols)
    norms = {}
    for r in cells.collect():
        norms[r.r] = norms.get(r.r, 0) + r.x ** 2
    assert all(abs(v - 2) < 1e-9 for v in norms.values())  # one from each block


def test_plan_keeps_the_driver_bounded():
    for cols in (1, 1000, 10 ** 6, 10 ** 9):
        history, width, groups = softmax.plan(cols, 24, 1 << 24)
        assert width * groups >= cols and history >= softmax.LEAST_HISTORY
        assert width * 24 * 8 * (2 * history + 6) <= 1 << 24


def test_full_triage_with_models_and_duplicates(spark):
    from ticketlens.plans import jobs
    intents = ML.fit(small_train(spark), "intent")
    types = ML.fit(small_train(spark).select("text", F.when(F.col("intent") == "get_refund", "payment").otherwise("order").alias("query_type")), "query_type")
    rows = jobs.triage_full(spark, "/root/testdata/sf0.001", intent_model=intents, query_model=types).select(
        "ticket_id", "pred_intent", "confidence", "top_intents", "query_type", "query_confidence", "query_type_source", "duplicate_candidates", "handoff").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert all(r.pred_intent in intents.names and r.top_intents[0].intent == r.pred_intent and len(r.top_intents) == 3 for r in rows)
    assert all(r.query_type in types.names and 0 < r.query_confidence <= 1 and r.query_type_source == "model" for r in rows)
    assert all(0 < r.confidence <= 1 and len(r.duplicate_candidates) <= 3 and r.handoff.startswith("Query type: ") for r in rows)
    assert any(r.duplicate_candidates for r in rows) and all(d.ticket_id != r.ticket_id for r in rows for d in r.duplicate_candidates)


@pytest.mark.parametrize("kind, most", [((), 14), ((np.float32,), 10)])
def test_solver_holds_few_arrays_beside_its_history(kind, most):
    import tracemalloc
    n, scale = 400_000, np.linspace(1, 50, 400_000).reshape(-1, 4)

    def value(p):
        g = scale * p
        g -= 1
        return float(np.vdot(p, g) - p.sum()) / 2, g
    tracemalloc.start()
    try:
        p, first = softmax.minimise(value, np.zeros((n // 4, 4)), 1e-6, 200, softmax.LEAST_HISTORY, *kind)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first == 1 and np.abs(p - 1 / scale).max() < 1e-5
    assert peak < most * n * 8  # 16 arrays before


def test_columns_are_cut_into_groups_late():
    history, width, groups = softmax.plan(103_883, 24, softmax.DRIVER_BYTES)  # sf0.1's intents: two groups before
    assert groups == 1 and softmax.LEAST_HISTORY <= history < softmax.HISTORY and width == 103_883
    assert softmax.plan(1000, 24, softmax.DRIVER_BYTES) == (softmax.HISTORY, 1000, 1)
