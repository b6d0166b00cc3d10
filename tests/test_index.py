"""The stored vector index: exact where it looks, few cells read, every usable row in it."""

import numpy as np
import pytest

from postlake.operators import vector_index
from postlake.operators.vector_index import add, build, centres, search


def _frame(spark, vectors, first=0, name="id"):
    return spark.createDataFrame([(first + i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)],
                                 f"{name} long, vector array<double>").repartition(3)


def _exact(corpus, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in corpus}
    out = []
    for q, v in queries:
        scores = sorted((-round(float(unit[i] @ (np.array(v) / np.linalg.norm(v))), 9) + 0.0, i) for i in unit)
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 24)) * 3
    return [list(middle[i % 20] + rng.normal(size=24)) for i in range(600)]


def test_all_cells_give_the_exact_rows(spark, tmp_path, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL_ROWS", 20)  # hot cells are split on both sides
    monkeypatch.setattr(vector_index, "CELL_QUERIES", 7)
    root = str(tmp_path / "index")
    odd = [None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    assert build(_frame(spark, [*vectors[:500], *odd]), root, 12) == {"rows": 500, "skipped": 6}
    assert add(_frame(spark, vectors[500:], 600), root) == {"rows": 100, "skipped": 0}
    corpus = [(i if i < 500 else i + 100, v) for i, v in enumerate(vectors)]
    queries = _frame(spark, [*vectors[::9], *odd], 0, "query_id")
    got = search(spark, root, queries, 5, 12)
    assert got.columns == ["query_id", "id", "score", "rank"]
    want = _exact(corpus, list(enumerate(vectors[::9])), 5)
    rows = sorted(map(tuple, got.collect()), key=lambda r: (r[0], r[3]))
    assert [(q, i, r) for q, i, _, r in rows] == [(q, i, r) for q, i, _, r in want]
    assert np.allclose([r[2] for r in rows], [r[2] for r in want], atol=1e-8)


def test_few_cells_are_read_and_find_most(spark, tmp_path, vectors):
    root = str(tmp_path / "index")
    build(_frame(spark, vectors), root, 16)
    queries = _frame(spark, vectors[::7], 0, "query_id")
    found = {(r.query_id, r.id) for r in search(spark, root, queries, 5, 2).collect()}
    want = {(q, i) for q, i, *_ in _exact(list(enumerate(vectors)), list(enumerate(vectors[::7])), 5)}
    assert len(found & want) >= 0.9 * len(want)
    one = search(spark, root, queries.filter("query_id = 0"), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    cells = spark.read.parquet(f"{root}/rows").join(one.select("id"), "id").select("cell").distinct().count()
    assert 1 <= cells <= 2


def test_empty_sides_and_small_samples(spark, tmp_path, vectors):
    root = str(tmp_path / "none")
    nothing = _frame(spark, vectors[:3]).limit(0)
    assert build(nothing, root, 4) == {"rows": 0, "skipped": 0}
    assert search(spark, root, _frame(spark, vectors[:3], 0, "query_id"), 5, 2).count() == 0
    root = str(tmp_path / "few")
    assert build(_frame(spark, [vectors[0]] * 4), root, 8) == {"rows": 4, "skipped": 0}
    got = search(spark, root, _frame(spark, vectors[:1], 0, "query_id"), 3, 2).collect()
    assert sorted((r.id, r["rank"]) for r in got) == [(0, 1), (1, 2), (2, 3)]
    assert search(spark, root, _frame(spark, [None], 0, "query_id"), 3, 2).count() == 0
    assert len(centres(_frame(spark, vectors), 10, sample=50)) == 10
