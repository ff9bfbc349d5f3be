"""Prefix-filtered similarity against brute force computed in plain Python."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketlens import vocab as V
from ticketlens.operators import similar as S

STOP = set(V.default_stop_words())


def py_terms(text):
    toks = [t for t in re.findall(r"[^\W]{2,}", text.lower()) if t not in STOP]
    return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def py_tfidf(corpus):
    tfs = [Counter(py_terms(t)) for t in corpus]
    n = len(corpus)
    df = Counter(term for tf in tfs for term in tf)
    vecs = []
    for tf in tfs:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items()}
        nrm = math.sqrt(sum(x * x for x in v.values()))
        vecs.append({t: x / nrm for t, x in v.items()} if nrm else {})
    return vecs


def cos(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


OPEN = [
    (1, "My parcel for order ORD-000123 is late and has not arrived"),
    (2, "My parcel for order ORD-000124 is late and has not arrived"),
    (3, "Please cancel order ORD-000555 before it ships out"),
    (4, "Please cancel order ORD-000555 before it ships out"),
    (5, "Please cancel order ORD-000555 before it ships out"),
    (6, "Please cancel order ORD-000555 before it ships out"),
    (7, "The website will not load in my browser"),
    (8, "Refund for transaction TXN-000321 still pending"),
]
MSGS = [
    (100, "My parcel for order ORD-000123 is late and has not arrived yet"),
    (101, "Please cancel order ORD-000555 before it ships out"),
    (102, "The website will not load in my browser today"),
    (103, "completely unrelated words about gardening"),
]


def brute_duplicates(threshold=0.62, limit=3):
    out = {}
    for mid, m in MSGS:
        vecs = py_tfidf([m] + [t for _, t in OPEN])          # refit per message, n = N + 1
        scored = [(round(cos(vecs[0], vecs[i + 1]), 4), i, OPEN[i][0], cos(vecs[0], vecs[i + 1]))
                  for i in range(len(OPEN))]
        keep = [s for s in scored if s[3] >= threshold]
        keep.sort(key=lambda s: (-s[0], s[1]))                 # stable: store order breaks ties
        out[mid] = [(tid, r) for r, _, tid, _ in keep[:limit]]
    return out


def test_duplicate_candidates_equal_naive_refit(spark):
    opn = spark.createDataFrame([(i, t, "open", "Q") for i, t in OPEN],
                                "ticket_id long, text string, status string, department string") \
        .withColumn("created_at", F.col("ticket_id").cast("timestamp"))
    msgs = spark.createDataFrame(MSGS, "message_id long, text string")
    got = {}
    for r in S.duplicate_candidates(msgs, opn).orderBy("message_id", "rank").collect():
        got.setdefault(r.message_id, []).append((r.ticket_id, r.similarity))
    want = brute_duplicates()
    assert {k: v for k, v in want.items() if v} == got
    assert [t for t, _ in got[101]] == [3, 4, 5]                  # copy group: first three in store order


def test_duplicate_pairs_equal_brute_force(spark):
    rows = OPEN + [(9, "The website will not load in my browser"), (10, "website browser load fails")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id_a, r.id_b): r.similarity for r in S.duplicate_pairs(df, "id", "text").collect()}
    vecs = py_tfidf([t for _, t in rows])
    reps = {}
    for (i, t) in rows:
        reps.setdefault(t, i)
    distinct = sorted(reps.items(), key=lambda x: x[1])
    idx = {i: k for k, (i, _) in enumerate(rows)}
    want = {}
    for a in range(len(distinct)):
        for b in range(a + 1, len(distinct)):
            ia, ib = distinct[a][1], distinct[b][1]
            s = cos(vecs[idx[ia]], vecs[idx[ib]])
            if s >= 0.62:
                want[(ia, ib)] = s
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k] - want[k]) < 1e-9


def test_policy_search_always_k_and_ties(spark):
    pol = spark.createDataFrame([(0, "P0", "Refunds", "refund money back"), (1, "P1", "Delivery", "parcel courier"),
                                 (2, "P2", "Login", "password reset"), (3, "P3", "Other", "misc")],
                                "policy_idx long, policy_id string, title string, content string")
    q = spark.createDataFrame([(1, "I want my refund money"), (2, "zzz qqq")], "query_id long, text string")
    r = S.search_policies(q, pol, k=3).orderBy("query_id", "rank").collect()
    by = {}
    for x in r:
        by.setdefault(x.query_id, []).append((x.policy_id, x.score))
    assert by[1][0][0] == "P0" and by[1][0][1] > 0.5
    assert [p for p, _ in by[2]] == ["P3", "P2", "P1"]           # zero scores, later policy first
    assert all(s == 0.0 for _, s in by[2])


def test_search_vectors_exact_topk(spark):
    idx = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])],
                                "index_id long, index_vector array<double>")
    q = spark.createDataFrame([(7, [0.8, 0.6])], "query_id long, vector array<double>")
    r = S.search_vectors(q, idx, k=2).orderBy("rank").collect()
    assert [x.index_id for x in r] == [2, 0]
    assert abs(r[0].score - 0.96) < 1e-12


def test_handoff_and_suggestion(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.05), (False, 0.5)], "esc boolean, s double")
    sug = [r.x for r in df.select(S.suggest(F.col("esc"), F.col("s"), F.lit("Policy text"), F.lit("P1"))
                                  .alias("x")).collect()]
    assert sug[0].answer.startswith("Your ticket has been escalated") and not sug[0].grounded
    assert sug[1].answer.startswith("I could not find") and sug[1].source_id is None
    assert sug[2].answer == "Based on the knowledge base: Policy text" and sug[2].source_id == "P1"


# V3 for messages that are tickets themselves, and classes of texts --------------
def brute_all(tickets, messages, threshold=0.62, limit=3):
    """A refit for every message, its own row left out."""
    out = {}
    for mid, m, own in messages:
        others = [(i, t) for i, t in tickets if not (own and i == mid)]
        vecs = py_tfidf([m or ""] + [t or "" for _, t in others])
        scored = [(-round(s, 4), k, i, s) for k, (i, _) in enumerate(others) if (s := cos(vecs[0], vecs[k + 1])) >= threshold]
        out[mid] = [(i, -r) for r, _, i, _ in sorted(scored)[:limit]]
    return {k: v for k, v in out.items() if v}


def all_candidates(spark, tickets, messages):
    opn = spark.createDataFrame([(i, t, "open", "Q") for i, t in tickets], "ticket_id long, text string, status string, department string") \
        .withColumn("created_at", F.col("ticket_id").cast("timestamp"))
    msgs = spark.createDataFrame(messages, "message_id long, text string, mine boolean")
    got = {}
    for r in S.duplicate_candidates(msgs, opn, own="mine").orderBy("message_id", "rank").collect():
        got.setdefault(r.message_id, []).append((r.ticket_id, r.similarity))
    return got


@pytest.mark.parametrize("rare_df", [0, 2, 32])
def test_every_message_equals_naive_refit(spark, monkeypatch, rare_df):
    monkeypatch.setattr(S, "RARE_DF", rare_df)
    rnd = random.Random(5)
    forms = ["parcel {} late courier not arrived since {}", "please cancel subscription {} before renewal", "refund {} pending transaction {} {}",
             "website browser loading error", "gift voucher {} rejected checkout page {}"]
    tickets = [(i, rnd.choice(forms).format(*(f"id{rnd.randrange(40)}" for _ in range(3)))) for i in range(1, 61)] + [(61, None), (62, "")]
    messages = [(i, t, True) for i, t in tickets]
    messages += [(1000 + i, rnd.choice(forms).format(*(f"id{rnd.randrange(60)}" for _ in range(3))), False) for i in range(25)]
    messages += [(2000, "unrelated words entirely", False), (2001, None, False), (2002, tickets[0][1], False)]
    assert all_candidates(spark, tickets, messages) == brute_all(tickets, messages)


def test_no_open_tickets(spark):
    assert all_candidates(spark, [], [(1, "a message here", False)]) == {}
    assert all_candidates(spark, [(1, "lone ticket here")], [(1, "lone ticket here", True), (2, "lone ticket here", None)]) == {2: [(1, 1.0)]}


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    idx = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [0.5]), (6, []), (7, [inf, 0.0])],
                                "index_id long, index_vector array<double>")
    q = spark.createDataFrame([(7, [0.8, 0.6]), (8, None), (9, [0.0, 0.0]), (10, [inf, 0.0])], "query_id long, vector array<double>")
    got = {}
    for r in S.search_vectors(q, idx, k=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.index_id, r.score))
    assert got == {7: [(0, 0.8), (5, 0.4), (3, 0.0), (6, 0.0)], 9: [(0, 0.0), (3, 0.0), (5, 0.0), (6, 0.0)]}
    units = {r.index_id: r.u for r in idx.select("index_id", S.unit(F.col("index_vector")).alias("u")).collect()}
    assert units[0] == [1.0, 0.0] and units[5] == [1.0] and all(units[i] is None for i in (1, 2, 3, 4, 6, 7))


def test_terms_are_counted_in_parts_of_bounded_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i} gamma") for i in range(20)] + [(3, "alpha"), (None, "alpha")], "id long, text string")
    monkeypatch.setattr(S, "PART_BYTES", 8)
    counted = S.term_counts(docs, "id", "text")
    assert counted.rdd.getNumPartitions() == -(-sum(len(r.text) for r in docs.collect()) // 8)
    assert {(r.id, r.tf) for r in counted.where("term = 'alpha' and (id = 3 or id is null)").collect()} == {(3, 2), (None, 1)}


def test_policy_search_in_parts(spark, monkeypatch):
    pol = spark.createDataFrame([(i, f"P{i}", None, f"word{i % 3} refund") for i in range(6)] + [(5, "P5", None, "zzz")],
                                "policy_idx long, policy_id string, title string, content string").where("policy_idx < 5 or content = 'zzz'")
    q = spark.createDataFrame([(i, f"word{i % 4} money") for i in range(12)] + [(12, None)], "query_id long, text string")

    def found():
        r = S.search_policies(q, pol, k=3).collect()
        return sorted((x.query_id, x.rank, x.policy_idx, x.score) for x in r)
    whole = found()
    monkeypatch.setattr(S, "PART_PAIRS", 5)
    assert found() == whole and len(whole) == 13 * 3
    assert [x[2] for x in whole if x[0] == 1] == [4, 1, 5] and [x[2] for x in whole if x[0] == 12] == [5, 4, 3]


def test_vectors_carry_the_idf(spark):
    texts = ["alpha beta", "alpha gamma gamma", "delta", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vec, _ = S.tfidf_fit(docs, "id", "text")
    want = py_tfidf(texts)
    rows = vec.collect()
    assert len(rows) == sum(len(v) for v in want)
    for r in rows:
        df = sum(r.term in v for v in want)
        assert abs(r.idf - math.log(5 / (1 + df)) - 1) < 1e-12 and abs(r.weight - want[r.id][r.term]) < 1e-12


def test_classes_and_their_terms_are_numbers(spark, monkeypatch):
    opn = spark.createDataFrame([(i, i, f"my card {i % 3} was charged twice for order {i}", "open", "payments") for i in range(60)],
                                "ticket_id long, created_at long, text string, status string, department string")
    kept, plain = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df: kept.append(dict(df.dtypes)) or plain(df))
    S.duplicate_candidates(opn.select(F.col("ticket_id").alias("message_id"), "text"), opn)
    pairs = [k for k in kept if "mc" in k or "oc" in k]
    assert pairs and all(k[c] == "bigint" for k in pairs for c in ("mc", "oc", "term") if c in k)


def test_only_indexed_rows_of_near_duplicates_carry_bounds(spark, monkeypatch):
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 3:i % 3 + 30] + [f"own{i}"])) for i in range(12)], "id long, text string")
    kept, plain = [], S.materialise
    monkeypatch.setattr(S, "materialise", lambda df: kept.append(plain(df)) or kept[-1])
    pairs = S.duplicate_pairs(docs, "id", "text").count()
    assert pairs > 0 and len(kept) == 1 and kept[0].columns == ["rep_id", "term", "weight", "index"]
    n = kept[0].count()
    assert 0 < kept[0].where("index is null").count() < n


def test_shuffle_files_behind_a_checkpoint_are_removed(spark):
    before = spark.conf.get(S.CLEAN, None)
    seen = []
    df = spark.range(100).repartition(4, "id")
    select = type(df).select

    class Watched:
        """The setting under which the checkpoint's plan is made."""
        sparkSession = spark

        def select(self, *cols):
            seen.append(spark.conf.get(S.CLEAN))
            return select(df, *cols)
    assert S.materialise(Watched()).count() == 100
    assert seen == ["true"] and spark.conf.get(S.CLEAN, None) == before


def test_vectors_stay_in_the_partitions_of_their_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 16)
    texts = ["alpha beta", "alpha gamma gamma", "delta", "", None, "beta beta alpha", "alpha"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "alpha beta")], "id long, text string")
    vec, _ = S.tfidf_fit(docs, "id", "text")
    plan = vec._jdf.queryExecution().executedPlan().toString()
    # texts by block, terms of a block by term, answers by block: no (id, term) row is shuffled to its term or back
    assert "Join" not in plan and plan.count("hashpartitioning(term") == 1 and "hashpartitioning(id" not in plan
    want = py_tfidf([t or "" for t in texts] + ["alpha beta"])
    rows = vec.collect()
    assert len(rows) == sum(len(v) for v in want)
    for r in rows:
        assert abs(r.weight - want[len(texts) if r.id is None else r.id][r.term]) < 1e-12


def test_a_block_is_a_partition(spark):
    ids = spark.range(4000).unionByName(spark.createDataFrame([(None,)], "id long"))
    blocks = S.in_blocks(ids, "id", 13).select(S.BLOCK, F.spark_partition_id().alias("p")).distinct().collect()
    assert len(blocks) == len({b.p for b in blocks}) == len({b[S.BLOCK] for b in blocks}) == 13


def test_candidate_pairs_are_added_up_in_hash_tables(spark):
    pre = spark.createDataFrame([(i, f"t{k}", k + 2, 0.5, 0.8 - k / 10, 0.9) for i in range(4) for k in range(2)],
                                "rep_id long, term string, df long, weight double, norm_after double, reach_after double")
    pairs = S.candidate_pairs(pre, 0.62)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[a_rep_id" not in plan and "HashAggregate(keys=[a_rep_id" in plan
    assert sorted((r.id_a, r.id_b, r.partial) for r in pairs.collect()) == [(a, b, 0.5) for a in range(4) for b in range(a + 1, 4)]
