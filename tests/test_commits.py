"""A write that is stopped before it is committed leaves the table as it was; loads touch few buckets of bounded size."""

import pytest
from pyspark.sql import functions as F

from postlake.plans import all_queries
from postlake.schemas import RAW, ROW
from postlake.sources import buckets, files, load
from postlake.sources.buckets import ConflictError, forget, grow, merge, read_table, replace_rows, version
from postlake.sources.snapshots import read_together, write_role, write_together

AS_OF = "2026-08-20"


def _rows(spark, items):
    data = [("hn", str(i), t, None, None) for i, t in items]
    return spark.createDataFrame(data, ROW).withColumns({
        "posted_at": F.lit("2026-08-10T00:00:00Z").cast("timestamp"), "thread_month": F.lit("2026-08-01").cast("date")})


def _merge(spark, root, items, name, **options):
    return merge(spark, root, _rows(spark, items), name, AS_OF, ["external_id"], **options)


def _texts(spark, root):
    return {r.external_id: r.raw_text for r in read_table(spark, root).collect()}


class Stopped(Exception):
    pass


@pytest.fixture
def stop(monkeypatch):
    """Stops the driver before the version of a table appears."""
    def at(part):
        real = files.write_json

        def stopping(spark, path, value):
            if part in path:
                raise Stopped(path)
            real(spark, path, value)
        monkeypatch.setattr(files, "write_json", stopping)
        return lambda: monkeypatch.setattr(files, "write_json", real)
    return at


@pytest.mark.parametrize("part", ["/versions/", "/totals/"])
def test_a_stopped_load_loses_nothing(spark, tmp_path, stop, part):
    root = str(tmp_path / "t")
    _merge(spark, root, [(i, "a") for i in range(50)], "1")
    before = _texts(spark, root)
    batch = [(7, "b"), (8, "a"), (99, "n")]
    go_on = stop(part)
    with pytest.raises(Stopped):
        _merge(spark, root, batch, "2")
    assert _texts(spark, root) == before
    go_on()
    for _ in range(2):  # tried again, and once more after it is done
        *_, totals = _merge(spark, root, batch, "2")
        assert totals == {"inserted": 1, "updated": 1, "unchanged": 1, "failed": 0}
        assert _texts(spark, root) == before | {"7": "b", "99": "n"}
    assert version(spark, root)["number"] == 2


def test_a_load_that_another_overtook_is_decided_anew(spark, tmp_path, stop):
    root = str(tmp_path / "t")
    _merge(spark, root, [(1, "a")], "1")
    go_on = stop("/versions/")
    with pytest.raises(Stopped):
        _merge(spark, root, [(1, "b"), (2, "b")], "2")
    go_on()
    _merge(spark, root, [(2, "c")], "3")
    with pytest.raises(ConflictError):
        _merge(spark, root, [(1, "b"), (2, "b")], "2")
    *_, totals = _merge(spark, root, [(1, "b"), (2, "b")], "2")
    assert (totals["inserted"], totals["updated"]) == (0, 2) and _texts(spark, root) == {"1": "b", "2": "b"}
    with pytest.raises(FileExistsError):
        files.write_json(spark, f"{root}/versions/0000000001.json", {})


def test_a_stopped_purge_loses_nothing(spark, tmp_path, stop):
    root = str(tmp_path / "db")
    rows = _rows(spark, [(i, "a") for i in range(20)]).withColumns({c: F.lit("2026-08-11").cast("timestamp") for c in ("ingested_at", "updated_at")})
    replace_rows(rows.withColumn("posted_at", F.when(F.col("external_id") < "15", F.lit("2026-01-01").cast("timestamp")).otherwise(F.col("posted_at"))),
                 f"{root}/raw/hn")
    write_role(spark, root, "live")
    go_on = stop("/versions/")
    with pytest.raises(Stopped):
        load.purge_dataset(spark, root, AS_OF, apply=True)
    assert load.read_raw(spark, root).count() == 20
    go_on()
    load.purge_dataset(spark, root, AS_OF, apply=True)
    kept = {r.external_id for r in load.read_raw(spark, root).collect()}
    assert kept == {str(i) for i in range(20) if str(i) >= "15"}


def test_a_small_load_rewrites_few_bounded_buckets(spark, tmp_path):
    target = 16_000
    for n in (400, 3000):
        root = str(tmp_path / f"t{n}")
        _merge(spark, root, [(i, f"text {i} " + "x" * (i % 50)) for i in range(n)], "1", target=target)
        grow(spark, root, target)
        first = version(spark, root)
        _merge(spark, root, [(i * 7, "new") for i in range(10)], "2", target=target)
        second = version(spark, root)
        folder = next(f for f, _ in second["at"].values() if f not in {g for g, _ in first["at"].values()})
        assert files.size(spark, f"{root}/rows/{folder}") <= 10 * 2 * target
        assert _texts(spark, root)["7"] == "new" and read_table(spark, root).count() == n
    assert second["buckets"] > 1
    assert not grow(spark, root, target) and grow(spark, root, target // 16)
    assert version(spark, root)["buckets"] > second["buckets"] and read_table(spark, root).count() == 3000
    assert forget(spark, root, 1) and read_table(spark, root).count() == 3000
    assert len(files.names(spark, f"{root}/rows")) == 1 and forget(spark, root, 1) == []
    assert _merge(spark, root, [(1, "later")], "3")[2]["updated"] == 1


def test_tables_written_together_appear_together(spark, tmp_path, stop):
    root = str(tmp_path / "t")
    assert read_together(spark, root) is None
    assert write_together(spark, root, {"roles": spark.range(3), "runs": spark.range(1)}) == 1
    go_on = stop("/together/")
    with pytest.raises(Stopped):
        write_together(spark, root, {"roles": spark.range(30), "runs": spark.range(10)})
    go_on()
    assert {n: t.count() for n, t in read_together(spark, root).items()} == {"roles": 3, "runs": 1}
    assert write_together(spark, root, {"roles": spark.range(30), "runs": spark.range(10)}) == 2
    assert {n: t.count() for n, t in read_together(spark, root).items()} == {"roles": 30, "runs": 10}
    assert read_together(spark, root, 1)["roles"].count() == 3
    with pytest.raises(LookupError):
        read_together(spark, root, 9)


def test_nothing_to_load(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_table(spark, root) is None
    *_, totals = merge(spark, root, spark.createDataFrame([], ROW), "1", AS_OF, ["external_id"])
    assert totals == {"inserted": 0, "updated": 0, "unchanged": 0, "failed": 0}
    assert read_table(spark, root).schema == RAW and read_table(spark, root).count() == 0


def test_a_bucket_is_a_few_files(spark, tmp_path):
    replace_rows(_rows(spark, [(i, "a") for i in range(500)]).withColumns({c: F.lit(None).cast("timestamp") for c in ("ingested_at", "updated_at")}),
                 str(tmp_path / "t"))
    assert buckets.version(spark, str(tmp_path / "t"))["buckets"] == 1
    assert len(list((tmp_path / "t" / "rows").rglob("*.parquet"))) == 1


def test_settings_are_applied_in_every_session(spark):
    """A session whose workers have the package already is configured as well."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "America/New_York")
    rows = all_queries()["publish_times"](other, "/root/testdata/sf0.001")
    assert other.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, all_queries()["publish_times"](spark, "/root/testdata/sf0.001").collect()))


def test_a_load_that_only_adds_rows_leaves_the_stored_ones_where_they_are(spark, tmp_path):
    root = str(tmp_path / "t")
    _merge(spark, root, [(i, "a") for i in range(20)], "1")
    stored = {f for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    changes, *_ = _merge(spark, root, [(i, "b") for i in (30, 30, 31)], "2")
    assert "raw_text" not in changes.columns and changes.columns.count("digest") == 1  # decisions name texts, and hold none
    added = {f for f in (tmp_path / "t" / "rows").rglob("*.parquet")} - stored
    assert [spark.read.parquet(*map(str, added)).count(), read_table(spark, root).count(), version(spark, root)["buckets"]] == [2, 22, 1]
    for n in range(buckets.PARTS):
        _merge(spark, root, [(100 + n, "c")], f"more {n}")
    assert max(len(buckets._folders(version(spark, root), b)) for b in version(spark, root)["at"]) <= buckets.PARTS
    assert read_table(spark, root).count() == 22 + buckets.PARTS and forget(spark, root, 1)
    assert read_table(spark, root).count() == 22 + buckets.PARTS and not grow(spark, root)
    assert _merge(spark, root, [(30, "d"), (5, "a")], "last")[2] == {"inserted": 0, "updated": 1, "unchanged": 1, "failed": 0}
    assert _texts(spark, root)["30"] == "d" and read_table(spark, root).count() == 22 + buckets.PARTS


def test_rows_that_were_forgotten_before_a_version_named_them_are_written_again(spark, tmp_path, stop):
    root = str(tmp_path / "t")
    _merge(spark, root, [(1, "a")], "1")
    go_on = stop("/versions/")
    with pytest.raises(Stopped):
        _merge(spark, root, [(1, "b"), (2, "b")], "2")
    go_on()
    assert len(forget(spark, root)) == 1
    _merge(spark, root, [(1, "b"), (2, "b")], "2")
    assert _texts(spark, root) == {"1": "b", "2": "b"}


def test_rows_before_the_window_are_counted_by_the_load(spark, tmp_path):
    rows = _rows(spark, [(1, "a"), (2, "b"), (3, " "), (4, "d")])
    rows = rows.withColumn("posted_at", F.when(F.col("external_id") == "2", F.lit("2026-08-01").cast("timestamp")).when(F.col("external_id") < "4", F.col("posted_at")))
    got = merge(spark, str(tmp_path / "t"), rows, "1", AS_OF, ["external_id"], since=F.lit("2026-08-09").cast("timestamp"))
    assert got[2] == {"inserted": 1, "updated": 0, "unchanged": 0, "failed": 2, "late": 1}
    assert sorted((r.external_id, r.reason) for r in got[1].collect()) == [("3", ["text_not_blank"]), ("4", ["posted_at_set"])]
    assert _texts(spark, str(tmp_path / "t")) == {"1": "a"}
