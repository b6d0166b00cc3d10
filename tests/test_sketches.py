"""Merged sketches say what one sketch of all rows would, within their stated errors."""

from pyspark.sql import functions as F

from postlake.operators.sketches import COUNT_ERROR, RANK_ERROR, distinct_counts, merge_sketches, quartiles, rollup_sketches


def test_months_merge(spark, tmp_path):
    rows = spark.range(60_000).select(
        (F.col("id") % 12).alias("month"), F.when(F.col("id") % 3 == 0, "go").when(F.col("id") % 3 == 1, "sql").alias("skill"),
        F.pmod(F.xxhash64("id"), F.lit(9000)).alias("posting"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).cast("int").alias("amount"))
    rows = rows.withColumns({"amount": F.when(F.col("skill").isNotNull(), F.col("amount")), "posting": F.when(F.col("posting") % 7 != 0, F.col("posting"))})
    by = ["month", "skill"]
    for n, part in enumerate((F.coalesce(F.col("posting") % 2 == 0, F.lit(True)), F.col("posting") % 2 == 1)):
        rollup_sketches(rows.filter(part), by, "posting", "amount").write.parquet(str(tmp_path / f"load{n}"))
    loads = [spark.read.parquet(str(tmp_path / f"load{n}")) for n in (0, 1)]
    stored = merge_sketches(loads[0], by, loads[1])
    exact = {r.skill: (r.n, r.all) for r in rows.groupBy("skill").agg(F.count_distinct("posting").alias("n"), F.count("amount").alias("all")).collect()}
    got = {r.skill: r.postings for r in distinct_counts(merge_sketches(stored, ["skill"], loads[0])).collect()}
    assert got.keys() == exact.keys()
    for skill, (n, _) in exact.items():
        assert abs(got[skill] - n) <= n * COUNT_ERROR
    found = {r.skill: r for r in quartiles(merge_sketches(stored, ["skill"])).collect()}
    assert set(found) == {"go", "sql"}  # the others state no amount
    for skill, r in found.items():
        assert r.n == exact[skill][1]
        amounts = sorted(x.amount for x in rows.filter((F.col("skill") == skill) & F.col("amount").isNotNull()).collect())
        for point, q in ((0.25, r.q1), (0.5, r.median), (0.75, r.q3)):
            assert sum(a < q for a in amounts) / len(amounts) <= point + RANK_ERROR
            assert sum(a <= q for a in amounts) / len(amounts) >= point - RANK_ERROR
    assert merge_sketches(loads[0].limit(0), by).count() == 0
