"""Exact search against all scores."""

import numpy as np
from pyspark.sql import functions as F

from headwater.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, score int, mark string, dim int"


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 24).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(0, rows[0][1]), (50, rng.normal(0, 0.2, 24).tolist())]
    rows += [(400, None), (401, []), (450, []), (402, [1.0, None]), (403, [float("nan")] * 24), (404, [float("inf")] * 24),
             (None, rows[5][1]), (500, [0.1] * 7), (501, [-0.1] * 7)]
    df = spark.createDataFrame([(i, v, 1, "m", 2) for i, v in rows], SCHEMA)
    got = {tuple(r) for r in topk.top_k(df, F.pmod("vec_id", F.lit(50)) == 0, block=64, query_block=4).collect()}
    sound = [(i, tuple(np.floor(256 * np.array(v, dtype=np.float32).astype(float)).tolist())) for i, v in rows
             if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in set(sound):
        if i % 50 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(q, x))), j) for j, x in sound if j != i and len(x) == len(q))
            want |= {(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:5])}
    assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0.05, 0.2, (200, 50)))
    for segments in (1, 2, 4, 8):
        s = topk._statistics(x, segments)
        assert (s @ s.T >= x @ x.T - 1e-6).all()


def test_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
