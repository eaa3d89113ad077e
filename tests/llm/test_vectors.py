import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import hard_negatives, topk
from docsift.llm.whole import whole


def table(seed=9, n=600, dims=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (6, dims))
    rows = [(i, int(i * 7 % 6), (centre[i * 7 % 6] + rng.normal(0, 0.2, dims)).round(3).tolist()) for i in range(n)]
    rows += [(1000 + i, i % 2, rows[5][2]) for i in range(60)]
    rows += [(1100, 1, None), (1120, 1, [None] * dims), (1140, 1, [float("nan")] * dims), (1141, 1, [float("inf")] * dims), (None, 1, [0.0] * dims), (1200, None, [0.1] * dims)]
    rows += [(1160, 1, [1.0] * 3), (1161, 2, [2.0] * 3), (1162, 1, [1.5] * 3), (1180, 3, []), (1181, 2, []), (1182, 3, []), (40, 4, rows[40][2])]
    return rows


def scored(rows, scale):
    """Rows that take part, as whole numbers, and the exact product of two."""
    sound = [(i, c, [whole(x, scale) for x in v]) for i, c, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    return sound, lambda v, w: sum(a * b for a, b in zip(v, w))


def best_of(rows, is_query, k, scale=64):
    sound, dot = scored(rows, scale)
    out = []
    for q, v in {i: v for i, _, v in sound if is_query(i)}.items():
        best = sorted((-dot(v, w), i) for i, _, w in sound if i != q and len(v) == len(w))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def negatives_of(rows, is_anchor, k=5, n=5, percent=80, scale=256):
    sound, dot = scored([r for r in rows if r[1] is not None], scale)
    out = []
    for a in sorted({i for i, _, _ in sound if is_anchor(i)}):
        c, v = min((c, v) for i, c, v in sound if i == a)
        others = [(-dot(v, w), i, d) for i, d, w in sound if i != a and len(v) == len(w)]
        for p, i, _ in sorted(x for x in others if x[2] == c)[:k]:
            best = sorted(x for x in others if x[2] != c and percent * -p <= 100 * -x[0] <= 100 * -p)[:n]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(best)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>"


def test_top_k_equals_brute_force(spark):
    frame = spark.createDataFrame(table(), SCHEMA).repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=20, wave_size=30)
    assert sorted(tuple(r) for r in got.collect()) == best_of(table(), lambda i: i % 20 == 0, 20)
    assert topk.top_k(frame.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


LARGE = [(i, i % 2, [float(2**20 * (i % 5) - 2**21), 2.0**20 * (i % 3 - 1), float(i)]) for i in range(50)]


def test_large_components_are_exact(spark):
    frame = spark.createDataFrame(LARGE, SCHEMA).repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=7)
    assert sorted(tuple(r) for r in got.collect()) == best_of(LARGE, lambda i: i % 10 == 0, 7)
    mixed = table() + [(3000 + i, v[1], v[2] * 8) for i, v in enumerate(LARGE)]
    frame = spark.createDataFrame(mixed, SCHEMA).repartition(3)
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=9)
    assert sorted(tuple(r) for r in got.collect()) == best_of(mixed, lambda i: i % 20 == 0, 9)


def test_scores_beyond_64_bits_fail_only_where_they_are_a_result(spark):
    rows = [(0, 0, [1.0, 0.0]), *[(i, 0, [float(i), 0.0]) for i in range(1, 30)]]
    least = spark.createDataFrame([*rows, (100, 0, [-1e300, 1.0])], SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in topk.top_k(least, F.col("vec_id") == 0, k=3).collect()) == best_of(rows, lambda i: i == 0, 3)
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(spark.createDataFrame([*rows, (100, 0, [1e300, 1.0])], SCHEMA), F.col("vec_id") == 0, k=3).collect()
    with pytest.raises(Exception, match="does not fit"):
        hard_negatives.mine(spark.createDataFrame([*rows, (100, 0, [1e300, 1.0])], SCHEMA), F.col("vec_id") == 0).collect()
    assert whole(1e308, 256) == int(1e308) * 256


@pytest.mark.parametrize("wave", [1000, 7])
def test_hard_negatives_equal_brute_force(spark, wave):
    frame = spark.createDataFrame([(*r, "x", 1) for r in table()], SCHEMA + ", anchor string, score int").repartition(3)
    got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, wave_size=wave)
    want = negatives_of(table(), lambda i: i % 20 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hard_negatives_of_large_and_few_rows(spark):
    mixed = table(n=200) + [(3000 + i, v[1], v[2] * 8) for i, v in enumerate(LARGE)]
    frame = spark.createDataFrame(mixed, SCHEMA).repartition(2)
    got = hard_negatives.mine(frame, F.col("vec_id") % 20 == 0, n_positives=3, n_negatives=2, percent=50)
    want = negatives_of(mixed, lambda i: i % 20 == 0, 3, 2, 50)
    assert sorted(tuple(r) for r in got.collect()) == want and any(abs(r[4]) > 2**53 for r in want)
    assert hard_negatives.mine(frame.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.mine(frame, F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(frame.withColumn("label", F.lit(1)), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_drop_candidates():
    rng = np.random.default_rng(3)
    x, y = (np.floor(256 * (rng.normal(0, 0.05, (n, 64)) + np.repeat(rng.normal(0, 1, (n, 4)), 16, axis=1))) for n in (40, 500))
    exact = x @ y.T
    for segments in (4, 16):
        a, b = hard_negatives.Summary(x, segments), hard_negatives.Summary(y, segments)
        assert (a.both @ b.both.T >= exact - 1e-3).all() and (a.both @ b.lower.T <= exact + 1e-3).all()
    best = np.sort(exact, axis=1)[:, -5:-4]
    a, b = hard_negatives.Summary(x, 4), hard_negatives.Summary(y, 4)
    assert (a.both @ b.both.T >= best).mean() < 0.2
