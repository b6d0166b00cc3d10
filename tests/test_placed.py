"""Joins with placed tables give the same rows and leave the placed side where it is."""

import re

import pytest
from pyspark.sql import functions as F

from postlake.operators import keys
from postlake.schemas import KEY
from postlake.sources.placed import place_rows, placed


@pytest.fixture
def no_broadcast(spark):
    """Sides as they are at scale: none is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def _postings(spark, ids):
    return ids.select(F.when(F.col("id") % 2 == 0, "hn").otherwise("habr").alias("source"), F.col("id").cast("string").alias("external_id"),
                      F.lit("t").alias("raw_text"), F.col("id").alias("raw_posting_id"))


def test_only_the_batch_is_exchanged(spark, tmp_path, no_broadcast):
    stored = _postings(spark, spark.range(0, 3000))
    cards = _postings(spark, spark.range(2900, 3100))
    known = place_rows(stored, str(tmp_path / "postings"), KEY)
    fresh = keys.new_only(cards, known)
    assert _exchanges(fresh) == 1 and _exchanges(keys.new_only(cards, stored)) == 2
    assert sorted(r.raw_posting_id for r in fresh.collect()) == list(range(3000, 3100))
    parts = [f for f in (tmp_path / "postings").rglob("*.parquet")]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_placed_tables_meet_without_an_exchange(spark, tmp_path, no_broadcast):
    raw = place_rows(_postings(spark, spark.range(0, 2000)), str(tmp_path / "raw"), "raw_posting_id")
    runs = place_rows(spark.range(0, 1500).select(F.col("id").alias("raw_posting_id"), F.lit("ok").alias("status")), str(tmp_path / "runs"), "raw_posting_id")
    work = keys.pending(raw, runs)
    assert _exchanges(work) == 0
    assert sorted(r.raw_posting_id for r in work.collect()) == list(range(1500, 2000))
    # A purge: what is kept has its roles and runs, again without an exchange.
    kept = raw.filter("raw_posting_id % 3 = 0")
    left = keys.cascade(runs, kept, "raw_posting_id")
    assert _exchanges(left) == 0 and left.count() == 500


def test_any_session_attaches_the_table(spark, tmp_path):
    root = str(tmp_path / "t")
    place_rows(spark.range(10).withColumn("a.b", F.lit(1.5)), root, "id", 3)
    place_rows(spark.range(20), root, "id", 3)  # written anew
    assert placed(spark, root).count() == 20
    other = placed(spark.newSession(), root)
    assert other.columns == ["id"] and other.count() == 20
