import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        best = set()
        for v in {tuple(x) for i, x in ok if i == q}:
            best |= {(float(np.sqrt(((np.array(v) - x) ** 2).sum())), i, n) for n, (i, x) in enumerate(ok) if i != q and len(x) == len(v)}
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i, _) in enumerate(sorted(best)[:k])]
    return out


@pytest.mark.parametrize(("query_block", "item_block"), [(1024, 4096), (3, 25)])
def test_matches_brute_force(spark, query_block, item_block):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(16)]) for i in range(200)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (510, [1.0, 2.0]), (511, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, id string, dim int, q int")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=10, query_block=query_block, item_block=item_block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(brute(rows, 10))


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for scale in (1e-6, 1.0, 1e6):
        q, x = rng.normal(size=(20, 8)) * scale, rng.normal(size=(500, 8)) * scale
        got = {i: (left, low, high) for i, left, low, high in ann.tile(ann.codes(q), np.arange(20), ann.codes(x), np.arange(1000, 1500), 5)}
        for i in range(20):
            d = ((x - q[i]) ** 2).sum(1)
            left, low, high = got[i]
            assert set(np.argsort(d, kind="stable")[:5]) <= set(left.tolist()) and len(left) < 250
            assert (low <= d[left]).all() and (d[left] <= high).all()


@pytest.mark.parametrize("rows", [
    [(0, [1e200, 1.0]), (1, [1e200, 2.0]), (2, [1.0, 1.0]), (3, [-1e200, 5.0])], [(0, [5e-324, 0.0]), (1, [1e-320, 5e-324]), (2, [1e-310, 1e-310])], [(0, [1e-200, 1.0]), (1, [2e-200, 1.0]), (2, [1.7e308, 1.0]), (3, [1.0, 1.0])],
])
def test_vectors_of_any_finite_size(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=2).collect()
    want = sorted((math.dist(rows[0][1], v), i) for i, v in rows[1:])[:2]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in want]
    assert all(math.isclose(r.score, d, rel_tol=1e-12, abs_tol=5e-324) for r, (d, _) in zip(sorted(got, key=lambda r: r["rank"]), want, strict=True))


def test_an_id_of_many_rows(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 == 0 else i, [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, k=10, query_block=7, item_block=11).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(brute(rows, 10))


def test_many_equal_vectors(spark):
    rng = random.Random(5)
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.5]]
    rows = [(rng.choice([0, 10, 11, 12, *range(20, 90)]), base[rng.random() < 0.3] if rng.random() < 0.8 else [rng.gauss(0, 1) for _ in range(3)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.withColumn("v", F.lit(1)).withColumn("row", F.lit("x"))
    nearest = ann.nearest(df, F.col("vec_id") % 10 == 0, k=5, query_block=7, item_block=50)
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.collect())
    assert got == sorted(brute(rows, 5))
