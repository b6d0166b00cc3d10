"""Lattice points are the nearest ones; links equal brute force; the index finds most links by itself."""

import numpy as np
import pytest

from postlake.llm import lattice
from postlake.llm.lattice import cells, decode, near_duplicates, neighbours


def test_decodes_to_the_nearest_point():
    y = np.random.default_rng(0).normal(size=(300, 8)) * 2
    points = decode(y) / 2
    far = ((y - points) ** 2).sum(1)
    assert len(np.unique(neighbours(), axis=0)) == 240 and far.max() <= 1 + 1e-9
    assert (points.sum(1) % 2 == 0).all() and ((points % 1 == 0).all(1) | (points % 1 == 0.5).all(1)).all()
    for step in neighbours() / 2:
        assert (((y - points - step) ** 2).sum(1) >= far - 1e-9).all()


@pytest.mark.parametrize("cosine", [0.93, 0.96, 0.99])
def test_recall_of_single_pairs(cosine):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, 2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine ** 2) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = cells(x), cells(y)
    found = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert found.mean() > 0.98
    other = np.roll(b, 1, 0)
    assert ((a == other[:, :, :1]) | (other == a[:, :, :1])).mean() < 1e-3


def _brute(rows):
    units = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(units):
        for j in range(i):
            y = units[j]
            if x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= 0.93:
                n[i], n[j], root[find(i)] = n[i] + 1, n[j] + 1, find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], n[i], least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 20)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), int(i % 3)) for i in range(60)]
    for base in range(4):
        x = rng.normal(size=16)
        rows += [(100 + 40 * base + i, (x + rng.normal(size=16) * 0.12 * (base + 0.3)).tolist(), 1) for i in range(40)]
    x = rows[100][1]
    rows += [(500, x, 1), (501, x, 1), (502, x, 2), (503, x, None), (504, None, 1), (505, [], 1), (506, [0.0] * 16, 1),
             (507, [float("nan")] + x[1:], 1), (508, [None] + x[1:], 1), (509, [float("inf")] + x[1:], 1), (510, [v * 1e300 for v in x], 1),
             (511, [v * 1e-300 for v in x], 1), (512, x[:5], 1), (None, x, 1), (500, x, 1)]
    vectors = spark.createDataFrame([(*r, b"u") for r in rows], "vec_id long, embedding array<double>, label int, unit binary").repartition(3)
    got = sorted(((r.vec, r.n_links, r.component) for r in near_duplicates(vectors).collect()), key=repr)
    assert got == _brute([(a, (np.array(b) / 1e300).tolist() if a == 510 else (np.array(b) * 1e300).tolist() if a == 511 else b, c) for a, b, c in rows])
    assert near_duplicates(vectors.limit(0)).count() == 0
