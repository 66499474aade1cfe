"""Operator 12 against brute force, with ties, copies, other lengths and unsound rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailflow.llm import hard_negatives


def brute(rows, is_anchor, positives=5, negatives=3):
    q = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        q.append((i, label, [int(np.floor(256 * float(x))) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(q):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for n, (j, m, w) in enumerate(q) if n != k and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(t, o) for t, o, m in scored if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, o, -s, -t) for r, (t, o) in enumerate(inside[:negatives])]
    return sorted(out)


def rows(seed, n=700, dims=9, spread=0.6):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(6, dims))
    x = centre[g.integers(0, 6, n)] + spread * g.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(g.integers(0, 4)), v) for i, v in enumerate(x.tolist())]


SHAPE = "vec_id long, label int, embedding array<double>, node string, low int, anchor string, block long"


def mined(spark, data, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in data], SHAPE).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect())


@pytest.mark.parametrize("block", [(hard_negatives.ROW_BLOCK, hard_negatives.ANCHOR_BLOCK), (90, 7)])
def test_hard_negatives(spark, block):
    data = rows(1)
    data += [(700 + k, k % 3, data[5][2]) for k in range(60)]  # copies in several labels
    data += [(800 + k, k % 2, [float(k % 5), -1.0, 0.0]) for k in range(60)]  # another length
    data += [(900, None, data[0][2]), (None, 1, data[1][2]), (910, 1, None), (920, 1, []), (930, 1, [float("nan"), *data[0][2][1:]]), (940, 2, [None, *data[0][2][1:]]), (950, 2, [float("inf"), *data[0][2][1:]]), (960, 1, [0.0] * 9), (970, 3, [-x for x in data[3][2]]), (980, 0, [1.0, 2.0])]
    assert mined(spark, data, block=block) == brute(data, lambda i: i % 10 == 0)


def test_large_numbers_repeated_ids_and_few_rows(spark):
    data = rows(2, 40, 5, 0.3)
    large = [(i, m, [x * 3e6 for x in v]) for i, m, v in data]
    assert mined(spark, large) == brute(large, lambda i: i % 10 == 0)
    twice = [*data, *data[:5]]
    assert mined(spark, twice) == brute(twice, lambda i: i % 10 == 0)
    for few in ([], data[:1], data[:3], [(0, 1, [1.0]), (1, 1, [1.0])]):
        assert mined(spark, few) == brute(few, lambda i: i % 10 == 0)
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_bounds_hold():
    g = np.random.default_rng(3)
    x = np.floor(256 * g.normal(size=(500, 7))).astype(np.int64)
    codes = hard_negatives._codes(x.astype(float), hard_negatives._cut(x[:100].astype(float)))
    row = dict(node=range(500), vec_id=range(500), label=[0] * 500, low=[], high=[], dims=7, codes=codes.tobytes(), numbers=x.astype("i4").tobytes(), width=4)
    block = hard_negatives.Block(row)
    low, high = hard_negatives.Bounds(block, block).of(x[:20])
    score = x @ x[:20].T
    assert (low <= score).all() and (score <= high).all()
    assert (high - low).mean() < 0.5 * (score.max() - score.min())
