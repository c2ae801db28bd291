import math

import numpy as np

from seamline.llm.topk import Best, search, top_k
from tests.llm.helpers import read


def brute(rows, every=100, k=10):
    ok = [(i, [math.floor(1024 * float(np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_against_brute_force(spark):
    table = read(spark, "embeddings")
    got = sorted(map(tuple, top_k(table, every=20).collect()))
    assert got == brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 20) and got


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (100, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, [1.0]), (None, [9.0, 9.0]), (200, [0.0, 0.0]), (9, [1e-9, -1e-9]), (300, []), (10, [1e5, 2e5]), (1, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(table).collect())) == brute([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows])
    assert top_k(table.limit(0)).count() == 0
    assert sorted(map(tuple, top_k(table, block_bytes=1).collect())) == sorted(map(tuple, top_k(table).collect()))


def test_pruning_keeps_every_result():
    rng = np.random.default_rng(5)
    v = np.floor(1024 * rng.normal(size=(6000, 8)) * rng.lognormal(0, 1.5, (6000, 1)))
    ids = np.arange(6000)
    q_ids, q = ids[::200], v[::200]
    best = Best(len(q), 5)
    search(best, q_ids, q, np.sqrt((q**2).sum(1)), ids, v, bucket=128)
    for i, query in zip(q_ids, q):
        scores = v @ query
        want = sorted((-int(s), int(j)) for j, s in enumerate(scores) if j != i)[:5]
        assert best.rows[int(np.flatnonzero(q_ids == i)[0])] == want
