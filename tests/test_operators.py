"""Operators against brute force and against their invariants."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.operators import analytics, evals, filters, keys, quality, retention, sampling, similar, upsert, vectors
from postlake.operators.ranking import first_n
from postlake.schemas import RAW, ROW

AS_OF = "2026-08-10"


def batch(spark, rows):
    """Rows of (source, id, text, day); the month follows the day."""
    data = [(s, i, t, f"2026-08-{d:02d}" if d else None, n) for n, (s, i, t, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "source string, external_id string, raw_text string, day string, arrival long")
    return df.select("source", "external_id", "raw_text", F.trunc(F.to_date("day"), "MM").alias("thread_month"),
                     F.col("day").cast("timestamp").alias("posted_at"), "arrival")


def one_by_one(stored, rows):
    """What a loop over the rows would do."""
    table, stats = dict(stored), {"inserted": 0, "updated": 0, "unchanged": 0, "failed": 0}
    for s, i, t, d in rows:
        if t is None or not t.strip(" ") or not d or s == "adzuna":
            stats["failed"] += 1
        elif (s, i) not in table:
            table[s, i] = (t, d)
            stats["inserted"] += 1
        elif table[s, i][0] != t:
            table[s, i] = (t, d)
            stats["updated"] += 1
        else:
            stats["unchanged"] += 1
    return table, stats


@pytest.mark.parametrize("chunk", [None, "arrival div 5", "arrival div 1"], ids=["whole", "fives", "ones"])
def test_upsert_like_a_loop(spark, chunk):
    chunk = chunk and F.expr(chunk)
    rnd = random.Random(5)
    first = [(rnd.choice(["hn", "habr"]), str(rnd.randint(1, 6)), rnd.choice("ab "), rnd.randint(1, 9)) for _ in range(20)]
    # One posting holds most of the second batch.
    second = [("hn", "1" if rnd.random() < .6 else str(rnd.randint(1, 9)), rnd.choice(["a", "b", None]),
               rnd.choice([0, 1, 2, 3])) for _ in range(40)] + [("adzuna", "1", "x", 1)]
    empty = spark.createDataFrame([], RAW)
    t1, s1 = upsert.upsert(empty, batch(spark, first), AS_OF, ["arrival"], chunk)
    want1, stats1 = one_by_one({}, first)
    t1 = spark.createDataFrame(t1.collect(), RAW)
    t2, s2 = upsert.upsert(t1, batch(spark, second), "2026-08-11", ["arrival"], chunk)
    want2, stats2 = one_by_one(want1, second)

    def shown(df):
        return {(r["source"], r["external_id"]): (r["raw_text"], r["posted_at"].day) for r in df.collect()}

    def total(df):
        return {k: v for k, v in df.filter("source = 'total'").first().asDict().items() if k != "source"}

    assert shown(t1) == want1 and total(s1) == stats1
    assert shown(t2) == want2 and total(s2) == stats2
    # The same texts again change nothing, even when their time moved.
    same = t2.select(*ROW.fieldNames()).withColumn("posted_at", F.col("posted_at") + F.expr("INTERVAL 1 DAY"))
    again = same.withColumn("arrival", F.xxhash64("source", "external_id"))
    t3, s3 = upsert.upsert(t2, again, "2026-08-12", ["arrival"], chunk)
    assert sorted(map(tuple, t3.collect()), key=str) == sorted(map(tuple, t2.collect()), key=str)
    assert total(s3) == {"inserted": 0, "updated": 0, "unchanged": len(want2), "failed": 0}


def test_upsert_keeps_first_times(spark):
    old = spark.createDataFrame([("hn", "1", "a", None, None, None, None)], RAW).withColumns({
        "thread_month": F.lit("2026-07-01").cast("date"),
        **{c: F.lit("2026-07-05").cast("timestamp") for c in ("posted_at", "ingested_at", "updated_at")}})
    after, _ = upsert.upsert(old, batch(spark, [("hn", "1", "b", 3)]), AS_OF, ["arrival"])
    r = after.first()
    assert (str(r["thread_month"]), r["ingested_at"].day, r["updated_at"].day, r["posted_at"].day) == ("2026-07-01", 5, 10, 3)


def test_window_and_purge_are_complements(spark):
    df = batch(spark, [("hn", str(d), "x", d) for d in range(1, 20)] + [("hn", "n", "x", 0)])
    kept = filters.within_window(df, "2026-08-19", 9)
    assert {r["external_id"] for r in kept.collect()} == {str(d) for d in range(10, 20)}
    rest, preview = retention.purge(df, "2026-08-19", [], 9, apply=True, dataset_role="live")
    assert {r["external_id"] for r in rest.collect()} == {str(d) for d in range(10, 20)} | {"n"}
    p = preview.first()
    assert (p["total"], p["going"], p["keeping"]) == (20, 9, 11)
    dry, _ = retention.purge(df, "2026-08-19", ["hn"], 9, dataset_role="live")
    assert dry.count() == 20
    with pytest.raises(PermissionError):
        retention.purge(df, "2026-08-19", dataset_role="eval")


def test_mark_cards(spark):
    cards = batch(spark, [("habr", "1", "x", 1), ("habr", "1", "x", 9), ("habr", "1", "x", 1), ("habr", "2", "x", 9),
                          ("habr", "2", "x", 9), ("habr", "3", "x", 9), ("habr", "4", "x", 0)])
    known = spark.createDataFrame([("habr", "3")], "source string, external_id string")
    marked = filters.mark_cards(cards, known, AS_OF, ["arrival"], 5)
    assert [r["state"] for r in marked.orderBy("arrival").collect()] == [
        "stored_or_aged", "fresh", "duplicate", "fresh", "duplicate", "stored_or_aged", "stored_or_aged"]
    f = filters.funnel(marked).first()
    assert (f["cards"], f["fresh"], f["stored_or_aged"], f["duplicates"]) == (7, 2, 3, 2)


def test_first_n_beyond_the_threshold(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(1))
    got = first_n(df, ["g"], ["-id"], 1500)
    assert got.groupBy("g").count().orderBy("g").collect() == [(0, 1500), (1, 1000)]
    assert got.filter("g = 0").agg(F.min("id"), F.max("rank")).first() == (2500, 1500)


def test_salary_distribution(spark):
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), rnd.choice(["USD", None]), rnd.randint(1, 5000)) for _ in range(400)]
    df = spark.createDataFrame(data, "g string, salary_currency string, salary_min long")
    got = {(r["g"], r["salary_currency"]): r for r in analytics.salary_distribution(df, ["g"], bucket=100).collect()}
    for key in itertools.product("ab", ["USD", None]):
        values = sorted(v for *k, v in data if tuple(k) == key)
        q = np.quantile(values, [0, .25, .5, .75, 1])
        r = got[key]
        assert [r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"]] == pytest.approx([len(values), *q])
        assert r["median"] == statistics.median(values)


def test_rollup_keeps_eaten_months(spark):
    existing = spark.createDataFrame([("2026-05-01", "go", 50), ("2026-04-01", "go", 40)], "month string, skill string, postings long"
                                     ).withColumn("month", F.to_date("month"))
    roles = spark.createDataFrame([(1, ["go"]), (2, ["go"]), (3, ["go", "c"])], "raw_posting_id long, stack array<string>")
    raw = spark.createDataFrame([(1, "2026-05-30"), (2, "2026-06-02"), (3, "2026-06-03")], "raw_posting_id long, d string"
                                ).withColumn("posted_at", F.col("d").cast("timestamp"))
    out = analytics.monthly_rollup(roles, raw, existing, "2026-08-20")
    assert {(str(r["month"]), r["skill"]): r["postings"] for r in out.collect()} == {
        ("2026-04-01", "go"): 40, ("2026-05-01", "go"): 50, ("2026-06-01", "go"): 2, ("2026-06-01", "c"): 1}


def test_sampling(spark):
    df = batch(spark, [("hn", str(i), f"Co{i % 7} | dev", 1) for i in range(40)]
               + [(s, str(i), "x", 1) for s in ("habr", "web3") for i in range(20)])
    quotas = {"hn": 4, "habr": 5, "web3": 3}
    gold = sampling.build_gold(df, quotas, always=["1", "2"], excluded=["3"], dataset_role="eval")
    assert {r["source"]: r["rows"] for r in analytics.gold_counts(gold).collect()} == quotas
    hn = [r["raw_text"] for r in gold.filter("source = 'hn'").collect()]
    assert len(set(hn)) == 4 and "Co1 | dev" in hn and "Co2 | dev" in hn
    other = sampling.build_gold(df.repartition(7), quotas, always=["1", "2"], excluded=["3"], dataset_role="eval")
    assert sorted(map(str, gold.collect())) == sorted(map(str, other.collect()))
    with pytest.raises(ValueError, match="not met"):
        sampling.build_gold(df, {**quotas, "hn": 12}, always=["1", "2"], dataset_role="eval")
    with pytest.raises(LookupError):
        sampling.build_gold(df, quotas, always=["1", "zz"], dataset_role="eval")
    with pytest.raises(PermissionError):
        sampling.build_gold(df, quotas, dataset_role="live")


def test_keys(spark):
    raw = batch(spark, [("hn", "1", "a", 1), ("habr", "2", "a", 1)])
    runs = spark.createDataFrame([("1", "error")], "external_id string, status string")
    work = keys.pending(raw, runs, key="external_id", order=["external_id"])
    assert [r["external_id"] for r in work.collect()] == ["2"]
    again = keys.pending(raw, runs, limit=1, key="external_id", order=["external_id"], retry_statuses=["error"])
    assert [r["external_id"] for r in again.collect()] == ["1"]
    assert quality.check_sources(raw, ["hn"]).collect() == [("habr", 1)]


def exact_topk(q, c, ids, k):
    q, c = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, c))
    s = np.round(q @ c.T, 9)
    return {(i, ids[j], r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[i, j], ids[j]))[:k])}


@pytest.mark.parametrize("max_sent", [1000, 3], ids=["sent", "cells"])
def test_vector_topk(spark, max_sent, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    c = rng.normal(size=(200, 8))
    c[50:120] = c[50]  # a third of the corpus are copies of one vector
    ids = [f"r{i:03d}" for i in rng.permutation(200)]
    q = np.vstack([rng.normal(size=(10, 8)), c[50:51]])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, c)] + [("zero", [0.0] * 8), ("none", None)],
                                   "id string, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    got = vectors.vector_topk(queries, corpus, 6, max_sent=max_sent, pivots=6)
    assert {(r["query_id"], r["id"], r["rank"]) for r in got.collect()} == exact_topk(q, c, ids, 6)
    few = vectors.vector_topk(queries, corpus, 500, where=F.col("id") < "r010", max_sent=max_sent, pivots=6)
    assert few.count() == 11 * 10
    near = vectors.vector_topk_approx(queries, corpus, 6, probes=3, pivots=6)
    assert 0.3 < vectors.recall(near, got).first()["recall"] <= 1.0


def grams(s):
    return {s[i:i + 3] for i in range(max(len(s) - 2, 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(similar, "_PART", 10)
    rnd = random.Random(2)
    words = ["data", "engineer", "senior", "backend", "go", "ml", "ops", "lead", "qa", "a"]
    names = sorted({" ".join(rnd.sample(words, rnd.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "id string").withColumn("tokens", similar.trigrams("id"))
    for t in (0.5, 0.6, 0.9):
        got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similar.similar_sets(df, t).collect()}
        want = {(a, b): jaccard(grams(a), grams(b)) for a, b in itertools.combinations(names, 2)}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= t})


def test_fuzzy_pairs_counts_copies(spark):
    rows = [("hn", str(i), "Acme", "Go Dev") for i in range(50)] + [("habr", "h", "ACME ", "Go  dev"), ("web3", "w", "Acme", "Go Devs"),
                                                                  ("web3", "z", "Zeta", "Nurse")]
    df = spark.createDataFrame(rows, "source string, external_id string, company string, title string")
    got = {(r["source_a"], r["copies_a"], r["source_b"], r["posting_b"]) for r in similar.fuzzy_pairs(df, 0.7).collect()}
    assert got == {("habr", 1, "hn", "0"), ("habr", 1, "web3", "w"), ("hn", 50, "web3", "w")}


def test_align_roles(spark):
    pred = spark.createDataFrame([(1, 0, "Go Dev"), (1, 1, "Go Dev"), (1, 2, "Data Engineer"), (1, 3, None), (2, 0, "QA")],
                                 "raw_posting_id long, role_index int, title string")
    truth = spark.createDataFrame([(1, 5, "Go Dev"), (1, 6, "Data Engineers"), (1, 7, "Data Engineering Lead"), (2, 1, "Chef")],
                                  "raw_posting_id long, role_index int, title string")
    got = {(r["raw_posting_id"], r["pred_index"], r["truth_index"]) for r in evals.align_roles(pred, truth).collect()}
    assert got == {(1, 0, 5), (1, 2, 6)}


def test_align_roles_equals_a_greedy_loop(spark):
    import random

    rng = random.Random(6)
    words = ["data", "engineer", "senior", "go", "lead", "qa", "analyst", "engineering"]

    def roles(n):
        return [(k, i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for k in range(n) for i in range(rng.randrange(7))]

    def grams(t):
        return {t[i:i + 3] for i in range(max(1, len(t) - 2))}

    pred, truth, want = roles(40), roles(40), set()
    for k in range(40):
        p, t = [(i, x) for q, i, x in pred if q == k], [(i, x) for q, i, x in truth if q == k]
        for title in {x for _, x in p}:
            for a, b in zip([i for i, x in p if x == title], [i for i, x in t if x == title], strict=False):
                want.add((k, a, b))
        p = [(i, x) for i, x in p if not any((k, i) == w[:2] for w in want)]
        t = [(i, x) for i, x in t if not any((k, i) == (w[0], w[2]) for w in want)]
        while True:
            left = [(-len(grams(x) & grams(y)) / len(grams(x) | grams(y)), a, b) for a, x in p for b, y in t]
            left = [c for c in left if -c[0] >= 0.3]
            if not left:
                break
            _, a, b = min(left)
            want.add((k, a, b))
            p, t = [c for c in p if c[0] != a], [c for c in t if c[0] != b]
    schema = "raw_posting_id long, role_index int, title string"
    found = evals.align_roles(spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema)).collect()
    assert {(r["raw_posting_id"], r["pred_index"], r["truth_index"]) for r in found} == want
    assert len(found) == len(want) > 30
