"""Every shared window is found, nothing else is, whether the items go in one block or in many."""

import random
import re

import numpy as np
import pytest

from postlake.llm.winnowing import find_items, without_items
from postlake.llm.words import words

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items):
    out = []
    for doc, text in docs:
        own, hit, names = _words(text), set(), set()
        for item, other in items:
            theirs = _words(other)
            n = min(10, len(theirs))
            wanted = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
            for i in range(len(own) - n + 1):
                if tuple(own[i:i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    names.add("null" if item is None else str(item))
        out.append((doc, len(own), tuple(sorted(hit)), tuple(sorted(names))))
    return sorted(out, key=repr)


def _tables(seed):
    rng = random.Random(seed)
    pool = ["Ab", "cd", "é", "x1", "über", "ZZ", "日本", "q"]

    def some(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(12)] + [(None, some(30)), (3, None), (4, "")]
    docs = [(i, some(rng.randrange(0, 80)) + (rng.choice(items)[1] or "").upper() + some(rng.randrange(20)))
            for i in range(60)]
    long_items = [t for _, t in items if t and len(_words(t)) > 12]
    docs += [(100 + i, " ".join(_words(t)[2:])) for i, t in enumerate(long_items)]
    return docs + [(7, None), (7, None), (8, ""), (None, "Ab cd"), docs[0], docs[0]], items


@pytest.mark.parametrize("block", [1 << 20, 30])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, block, monkeypatch):
    docs, items = _tables(seed)
    left = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item string")
    right = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr("postlake.llm.winnowing.BLOCK", block)
    got = [(r.doc, r.n_words, tuple(i for s in r.spans for i in range(s["from"], s.to)), tuple(r["items"]))
           for r in find_items(left, right).collect()]
    want = _brute(docs, items)
    assert sorted(got, key=repr) == want
    clean = without_items(left, right)
    assert clean.columns == left.columns
    assert sorted((str(r.doc_id) for r in clean.collect())) == sorted(str(d) for d, _, hit, _ in want if not hit)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert find_items(none, items).count() == 0
    one = find_items(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first()
    assert (one.n_words, one.spans, one["items"]) == (2, [], [])


def test_repeated_words_take_little_memory(spark):
    """One word, and two in turn, thousands of times on both sides: places that match the same count once."""
    import tracemalloc

    from postlake.llm.winnowing import Index

    texts = [b"la " * 20_000, b"la di " * 10_000]
    index = Index(["a", "b"], texts, 10, 5)
    assert len(index.at) < 60
    tracemalloc.start()
    first, end, item = index.hits(words([b"x " + b"la " * 20_000 + b"la di " * 10_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    hit = np.zeros(40_001, bool)
    for a, b in zip(first, end, strict=True):
        hit[a:b] = True
    assert not hit[0] and hit[1:].all() and set(item) == {0, 1} and peak < 400 << 20
