"""Components of similar documents equal those of comparing all pairs."""

import random
import re

import pytest

from postlake.llm import jaccard
from postlake.llm.components import components
from postlake.llm.jaccard import similar


def _shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i:i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def _brute(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def _table(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]

    def some(n):
        return [rng.choice(pool) for _ in range(n)]
    passage, rows = some(30), []
    base = some(120)
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = rng.choice(pool)
        rows.append((i, " ".join(own)))
    for i in range(150, 300):
        rows.append((i, " ".join(some(rng.randrange(40)) + passage + some(rng.randrange(20)))))
    rows += [(300 + i, " ".join(some(n))) for i, n in enumerate([0, 1, 2, 4, 5, 6, 7, 8, 9] * 3)]
    rows += [(400, "A b\tC\n d"), (401, "a  B c D"), (402, "a b c d e"), (403, "A B C D E f"), (404, None), (405, None), (406, " "),
             (407, "É b c d e"), (408, "é b c d e"), (None, "a b c d e"), (402, "a b c d e"), (403, " ".join(base)), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("seed", "small", "block"), [(1, 64, 1000), (2, 4, 25)])
def test_equals_brute_force(spark, seed, small, block, monkeypatch):
    rows = _table(seed)
    docs = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, key int, sketch binary").repartition(3)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "CROSSED", block)
    got = sorted(((r.doc, r.n_shingles, r.component) for r in similar(docs).collect()), key=repr)
    assert got == _brute(rows)
    if block == 1000:
        assert similar(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(200, 201), (201, 200), (200, 200), (None, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    assert set(got) == linked
    assert len({(root[n], c) for n, c in got.items()}) == len({root[n] for n in got}) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_few_rounds(spark, monkeypatch):
    """Each round is several jobs, and the driver keeps a record of all their tasks."""
    import importlib

    module = importlib.import_module("postlake.llm.components")
    rounds = []
    monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: (rounds.append(name), f(df, name))[1])
    star = [(0, i) for i in range(1, 1500)] + [(0, 5000 + i) for i in range(1500)]
    path = [(10_000 + i, 10_001 + i) for i in range(400)]
    tree = [(20_000 + i // 2, 20_000 + i) for i in range(1, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(star + path + tree, "a long, b long")).collect()}
    assert len(got) == 3000 + 401 + 1000
    for edges in (star, path, tree):
        assert len({got[x] for e in edges for x in e}) == 1
    assert len(set(got.values())) == 3
    assert rounds.count("links") - 1 <= 5


def test_late_links_unite_components(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, component long")
    more = spark.createDataFrame([(2, 4), (8, 9), (8, 3), (20, 21)], "a long, b long")
    got = {r.node: r.component for r in jaccard._united(labels, more).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 8, 9, 20, 21]
    assert len({got[n] for n in (1, 2, 3, 4, 8, 9)}) == 1 and got[5] == got[6] == 5 and got[20] == got[21]
    assert len(set(got.values())) == 3
