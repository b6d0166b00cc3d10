"""What is removed equals comparing every stretch of words with every other."""

import random
import re

import pytest

from postlake.llm.suffixes import _beside, remove_repeats

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return list(WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def _brute(rows, least):
    texts = {(d, t) for d, t in rows if t is not None}
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0]))
    found, copies, seen = {}, set(), {}
    for d, t in order:
        if t in seen:
            copies.add((d, t))
        else:
            seen[t] = d
    first = {}
    for d, t in order:
        own = [m[0] for m in _words(t)]
        hit = [False] * len(own)
        if (d, t) in copies:
            hit = [len(own) >= least] * len(own)
        else:
            for s in range(len(own) - least + 1):
                run = tuple(own[s:s + least])
                if first.setdefault(run, (d, t, s)) != (d, t, s):
                    hit[s:s + least] = [True] * least
        found[d, t] = hit
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        hit, spans = found[d, t], _words(t)
        if (d, t) in copies and hit and hit[0]:
            out.append((d, "", len(hit), len(hit)))
            continue
        text, end = "", 0
        i = 0
        while i < len(hit):
            if hit[i]:
                j = i
                while j + 1 < len(hit) and hit[j + 1]:
                    j += 1
                text += t[end:spans[i].start()]
                end = spans[j].end()
                i = j
            i += 1
        out.append((d, text + t[end:], len(hit), sum(hit)))
    return sorted(out, key=repr)


def _rows(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)] + ["é", "ÜB", "日本"]

    def some(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    passages = [some(n) for n in (15, 19, 20, 21, 40, 70)]
    rows = [(i, some(rng.randrange(60)) + rng.choice(passages).upper() + some(rng.randrange(40)) + rng.choice([*passages, ""])) for i in range(60)]
    few = random.Random(seed)
    rows += [(100 + i, " ".join(few.choice("ab") for _ in range(60))) for i in range(12)]  # few words: many ties
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:8])]  # equal texts
    rows += [(300, "short one"), (301, "short one"), (302, None), (303, None), (304, ""), (305, ". "), rows[3], rows[3], (None, rows[5][1]), (7, rows[9][1]),
             (306, "x y z " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = _rows(seed)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, digest int, `a.b` string").repartition(3)
    got = remove_repeats(docs, least_words=20)
    assert got.columns == ["doc_id", "text", "digest", "a.b", "_text", "_words", "_cut"]
    assert sorted(((r.doc_id, r._text, r._words, r._cut) for r in got.collect()), key=repr) == _brute(rows, 20)
    if seed == 1:
        assert remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_neighbours_across_ranges(spark, ranges):
    """A hot key, repeated rows and ranges of one row: each different row is told once at least, rightly."""
    rng = random.Random(ranges)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, rng.randrange(5, 40)]), rng.choice([None, *range(30)]), bytes([rng.randrange(3)])) for _ in range(300)]
    rows += [(1, 7, b"x")] * 200 + [(100, 1, b"a")] * 50
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        frame = spark.createDataFrame(rows, "key long, doc long, id binary").repartition(5)
        got = [(r.key, r.doc, bytes(r.id), r.after) for r in _beside(frame, "key", "trial").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    sizes = {k: sum(r[0] == k for r in order) for k in {r[0] for r in order}}
    assert {r[:3] for r in got} == {r for r in order if sizes[r[0]] > 1}
    assert {r[:3] for r in got if r[3]} == {r for before, r in zip(order, order[1:], strict=False) if before[0] == r[0]}


def test_condition_on_the_cut_runs_texts_through_python_once(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, passage), (2, f"x y {passage}"), (3, None), (4, passage)], "doc_id long, text string")
    kept = remove_repeats(docs, least_words=50).where("_cut = 0 or _cut < _words")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r.doc_id, r._text, r._words, r._cut) for r in kept.collect()} == {(1, passage, 50, 0), (2, "x y ", 52, 50), (3, None, 0, 0)}
