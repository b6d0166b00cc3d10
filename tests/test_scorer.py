"""Models in place of the reply table, and totals gathered by writes."""

import time
from functools import partial

from pyspark.sql import functions as F

from postlake.operators import scorer
from postlake.operators.replies import validate_replies
from postlake.operators.scorer import Reply, ask, runs, score
from postlake.operators.totals import RunningTotals, Totals, change_totals


def test_runs_are_bounded_by_bytes():
    assert list(runs(["aa", "é", "x" * 9, "", "b"], 4)) == [[0, 1], [2], [3, 4]] and list(runs([], 4)) == []


def test_one_failure_costs_no_other_reply():
    calls = []

    def model(texts):
        calls.append(list(texts))
        if "bad" in texts:
            raise ValueError("no")
        return [KeyError("x") if t == "odd" else Reply(t.upper(), 1, 2) if t == "full" else t.upper() for t in texts]

    got = ask(model, ["a", "bad", "odd", "full"], 2)
    assert got == [(Reply("A"), None, 2), (None, "ValueError: no", 3), (None, "KeyError: 'x'", 3), (Reply("FULL", 1, 2), None, 2)]
    assert calls[0] == ["a", "bad", "odd", "full"] and calls.count(["bad"]) == 2
    assert ask(model, ["a"], 2) == [(Reply("A"), None, 1)]
    assert ask(lambda texts: [], ["a"], 1)[0][1] == "ValueError: 0 replies to 1 texts"


def test_scores_postings(spark, tmp_path):
    rows = [(i, "broken" if i == 5 else None if i == 6 else f"text {i}") for i in range(40)]
    postings = spark.createDataFrame(rows, "raw_posting_id long, text string").repartition(6)
    told = tmp_path / "told"

    def load(path):
        with open(path, "a") as lines:
            lines.write("loaded\n")

        def model(texts):
            if any("broken" in t for t in texts):
                raise RuntimeError("cannot")
            return ['{"doc_type": "other"}' for _ in texts]
        return model

    scored = score(postings, partial(load, str(told)), "mine", batch_bytes=20)
    assert scored.schema == scorer.SCORED
    checked = validate_replies(scored).collect()
    assert len(checked) == 40
    assert {r.raw_posting_id: r.error for r in checked if r.error} == {5: "RuntimeError: cannot"}
    assert all(r.doc_type == "other" for r in checked if r.raw_posting_id != 5)
    assert len(told.read_text().split()) <= 8  # once a worker at most, not once a task or batch
    assert score(postings.limit(0), partial(load, str(told)), "mine").count() == 0


def test_totals_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3), (4, 5, None)], "inserted long, updated long, unchanged long")
    totals = Totals(change_totals())
    totals.on(rows).write.parquet(str(tmp_path / "rows"))
    assert totals.get() == {"inserted": 5, "updated": 7, "unchanged": 3}
    totals = Totals(change_totals())
    totals.on(rows.limit(0)).write.parquet(str(tmp_path / "none"))
    assert totals.get() == {"inserted": 0, "updated": 0, "unchanged": 0}


def test_running_totals_of_a_stream(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "in"))
    seen = []
    told = RunningTotals("seen", lambda batch, sums: seen.append((batch, dict(sums))))
    spark.streams.addListener(told)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = stream.observe("seen", F.count("*").alias("rows"), F.sum("id").alias("ids")).writeStream.format("noop").option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        until = time.time() + 30
        while len(seen) < 4 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    assert told.sums == {"rows": 100, "ids": 4950} and [s["rows"] for _, s in seen] == sorted(s["rows"] for _, s in seen) and len(seen) == 4
    told.add("run", 1, {"rows": 1})
    told.add("run", 1, {"rows": 1})
    assert told.sums["rows"] == 101
