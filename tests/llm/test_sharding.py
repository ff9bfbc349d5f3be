import zlib
from collections import Counter

import numpy as np

from ticketlens.llm import sharding as S


def test_matrix_adds_up():
    m = S.communication_matrix(np.array([5, 0, 7, 11]), np.array([8, 8, 7]), 1)
    assert m.sum(1).tolist() == [5, 0, 7, 11] and m.sum(0).tolist() == [8, 8, 7] and (m >= 0).all()


def test_exact_sizes_and_slots(spark):
    data = [(i, None if i % 7 == 0 else "é" * (i % 5), "x") for i in range(1003)] + [(3, "", "x")] * 2 + [(None, "n", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, shard string")
    got = S.shard_rows(df, 8, block_rows=50).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in data)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_uniform(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'t' text")
    got = S.shard_rows(df, 4, block_rows=100).collect()
    low = Counter(r.shard for r in got if r.doc_id < 1000)
    assert all(170 < low[s] < 330 for s in range(4))
    places = [r.shard * 1000 + r.slot for r in sorted(got, key=lambda r: r.doc_id)]
    assert abs(np.corrcoef(places, range(4000))[0, 1]) < 0.06
    again = S.shard_rows(df.repartition(3), 4, block_rows=100).collect()
    assert sorted(again) == sorted(got)


def test_empty_and_fewer_rows_than_shards(spark):
    assert S.shard_rows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [r.slot for r in S.shard_rows(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")).collect()] == [0, 0]
