"""Packed products are exact; what is mined equals comparing every anchor with every row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import negatives
from postlake.llm.negatives import mine, products

MOST = (1 << 63) - 1


def _score(a, b):
    return max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b, strict=True))))


@pytest.mark.parametrize("size", [1, 200, 1 << 14, 1 << 24, 1 << 40, 1 << 70])
def test_products_are_exact(size):
    rng = random.Random(size)
    for dims, low in ((1, -size), (7, 0), (64, -size), (3, size // 2)):
        a, c = ([[float(rng.randint(low, size)) for _ in range(dims)] for _ in range(n)] for n in (5, 37))
        want = [[_score([int(x) for x in p], [int(x) for x in q]) for q in c] for p in a]
        assert products(np.array(a), np.array(c)).tolist() == want
    assert products(np.zeros((2, 0)), np.zeros((3, 0))).tolist() == [[0] * 3] * 2


def _brute(rows):
    used = [(i, v, [math.floor(256 * x) for x in e], label) for i, (v, e, label) in enumerate(rows)
            if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, a, x, label in used:
        if a is None or a % 5:
            continue
        scored = sorted((-_score(x, y), v is None, v or 0, j, other) for j, v, y, other in used if len(y) == len(x) and j != i)
        for p in [s for s in scored if s[4] == label][:5]:
            fits = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(a, None if p[1] else p[2], k + 1, None if n[1] else n[2], -p[0], -n[0]) for k, n in enumerate(fits[:3])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(negatives, "BLOCK_ROWS", 40)  # several blocks; tasks see the tile sizes of the module
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    vectors = [[float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=8) * 0.7] for _ in range(150)]
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[0], i % 4) for i in range(40)]  # equal vectors: ties by key
    rows += [(300, None, 1), (305, [1.0, None], 1), (310, vectors[1], None), (315, [float("nan")] * 8, 1), (320, [float("inf")] * 8, 1), (325, [], 1), (330, [], 2),
             (335, [3.0], 1), (336, [2.0], 1), (337, [1.5], 2), (340, [0.0] * 8, 1), (None, vectors[2], 1), (None, vectors[3], 2),
             rows[5], rows[5], (345, [1e5] * 8, 1), (346, [9e4] * 8, 1), (347, [8e4] * 8, 2), (348, [-1e300] * 8, 0), (350, [1e300] * 8, 2), (351, [1e300] * 8, 1)]
    frame = spark.createDataFrame([(v, e, label, 1, "z") for v, e, label in rows], "vec_id long, embedding array<double>, label int, row int, `a.b` string")
    got = mine(frame.repartition(3), F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor", "positive", "rank", "negative", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows)
    if seed == 1:
        assert mine(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0
