import math
import random

from ticketlens.llm import topk


def brute(data, k, step):
    best = {}
    for i, v in data:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        z = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, z), z)
    out = []
    for q, a in best.items():
        if q % step == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in best.items() if j != q)[:k]
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, data, k, step, block_rows):
    df = spark.createDataFrame([(i, v, "l") for i, v in data], "vec_id long, embedding array<float>, v string")
    vectors = topk.quantised(df)
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where(f"vec_id % {step} = 0"), k, block_rows).collect())


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    data = [(i, [rnd.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) for _ in range(6)]) for i in range(400)]  # many ties
    data += [(1000 + i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(100)]
    data += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [1.0] * 6), (20, data[20][1]),
             (40, [9.0] * 6), (2020, []), (2040, [1.0, 2.0])]
    assert run(spark, data, 7, 20, 90) == brute(data, 7, 20)
    assert run(spark, data, 1000, 100, 10_000) == brute(data, 1000, 100)


def test_large_components_stay_exact(spark):
    data = [(i, [1e7 + i * 3, -7e6, 5.0]) for i in range(30)]
    got = run(spark, data, 3, 10, 100)
    import numpy as np
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in data], 3, 10)
    assert got == want


def test_few_rows(spark):
    assert run(spark, [(0, [1.0])], 5, 20, 10) == []
    assert run(spark, [], 5, 20, 10) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])], 5, 20, 10) == [(0, 1, 1, 64 * 128)]


def test_stops_early():
    import numpy as np
    rnd = np.random.default_rng(1)
    v = np.floor(rnd.normal(size=(4000, 3)) * 64)
    v[:50] *= 20
    block = topk.ThresholdBlock(np.arange(4000), v)
    block.top(np.arange(50), v[:50], 5)
    assert block.visited < 50 * 4000 / 4
