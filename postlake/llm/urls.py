"""Which rule of hosts and paths holds for a URL: a sort-merge range join by a sorted sweep. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.shared import parts, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z as a-z; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column) -> Column:
    """Labels of a host from the last to the first, each with a dot behind it: a host and its subdomains, and
    nothing else, have keys that begin with that of the host."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def _interval(prefix: Column, inside: Column, outside: Column) -> Column:
    """The two events of a prefix: what holds from its first key on, and what after its last one.

    0xff is in no text, so the end sorts behind all that begins with the prefix and before the end of any prefix
    of the prefix.
    """
    return F.inline(F.array(F.struct(prefix.alias("key"), inside.alias("value")),
                            F.struct(F.concat(prefix, F.lit(b"\xff")).alias("key"), outside.alias("value"))))


def sweep(points: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """``points`` (``key`` and other columns) with the ``value`` of the last of ``events`` (``key``, ``value``, never null) at
    or before their key; null before the first event.

    Points and events are sorted together into ranges, equal keys being split as well. What holds at the beginning of a range is
    what the last event before it left there; of that there is one row a range.
    """
    rows = points.withColumns({"_is_point": F.lit(True), "_spread": F.monotonically_increasing_id()}).unionByName(
        events.withColumns({"_is_point": F.lit(False), "_spread": F.lit(0).cast("long")}), allowMissingColumns=True)
    ranges = parts(points)
    order = ["key", "_is_point", "_spread"]
    # Bounds are drawn anew whenever the plan runs, so the ranges are written down.
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), name)
    last = dealt.where("not _is_point").groupBy("_range").agg(F.max_by("value", "key").alias("last"))
    spine = points.sparkSession.range(ranges).select(F.col("id").cast("int").alias("_range")).join(last, "_range", "left")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = spine.select("_range", F.last("last", True).over(before).alias("_start"))
    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.join(starts, "_range").withColumn("value", F.coalesce(F.last("value", True).over(so_far), "_start"))
    return swept.where("_is_point").select(*points.columns, "value")


def _host_events(rules: DataFrame) -> DataFrame:
    """For every host that has rules its two events, with the stack of such hosts that hold, outermost first."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(
        F.slice(labels, F.size(labels) - n + 1, n), "."))).alias("outer"))
    nested = above.join(hosts.select(F.col("host").alias("outer")), "outer").groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct(F.length("outer").alias("n"), "outer"))).alias("stack"))
    stack = F.col("stack.outer")
    return nested.select(_interval(canonical(F.col("host")), stack, F.slice(stack, 1, F.size(stack) - 1)))


def _path_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\0"), path).cast("binary")


def _path_events(rules: DataFrame) -> DataFrame:
    """For every rule its two events among those of its host: itself, and the longest rule around it."""
    rule = F.struct("host", "path", "verdict")
    above = rules.select("host", "path", "verdict", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substr("path", F.lit(1), n))).alias("outer"))
    around = rules.select("host", F.col("path").alias("outer"), F.col("verdict").alias("outer_verdict"))
    outer = F.when(F.col("outer") != F.col("path"), F.struct(F.col("host"), F.col("outer").alias("path"), F.col("outer_verdict").alias("verdict")))
    nested = above.join(around, ["host", "outer"]).groupBy("host", "path", "verdict").agg(
        F.max_by(outer, F.when(outer.isNotNull(), F.length("outer"))).alias("around"))
    return nested.select(_interval(_path_key(F.col("host"), F.col("path")), F.struct(rule.alias("rule")), F.struct(F.col("around").alias("rule"))))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its host and path as one text) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains of it where the path begins with
    its path; hosts count in lower case, paths as they are. Of the rules that fit, the longest wins, and of
    equally long ones that with the longer host; where none fits, ``otherwise`` holds and ``rule`` is null.

    Distinct hosts, as reversed keys, are swept together with the hosts of rules, whose subdomains are intervals of
    keys; the stack of intervals around a host names the hosts that have rules for it. Then
    the paths are swept together with the paths of each such host's rules. No row meets a rule that does not hold for it but for
    the outer ones on these stacks, whose depth is that of the host's labels or of nested rules.

    A null URL and one without ``://`` have an empty host and path. Rules with a null count for nothing; of equal rules
    with different verdicts the greatest holds (``block`` before ``allow``). Repeated rows stay as they are; all columns stay, and
    the four named are replaced. No rules or no pages are no error.
    """
    given = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    known = stored(given.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    new = ("host", "path", "rule", "verdict")
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in new], F.lit(1).alias("_")).alias("row")
    split = pages.select(own, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    hosts = sweep(split.select("host").distinct().withColumn("key", canonical(F.col("host"))), _host_events(known), "url-hosts")
    ruled = stored(hosts.where(F.size("value") > 0).select("host", F.col("value").alias("hosts")), "ruled-hosts")
    placed = stored(split.join(ruled, "host", "left").withColumn("id", F.monotonically_increasing_id()), "url-pages")

    tried = placed.where("hosts is not null").select("id", "path", F.explode("hosts").alias("outer"))
    points = tried.select("id", _path_key(F.col("outer"), F.col("path")).alias("key"))
    fits = sweep(points, _path_events(known), "url-paths").select("id", "value.rule.*").where("host is not null")
    text = F.concat("host", "path")
    best = fits.groupBy("id").agg(F.max_by(F.struct(text.alias("rule"), "verdict"), F.struct(F.length(text), F.length("host"))).alias("best"))
    names = [F.col(f"row.`{c}`") for c in pages.columns if c.lower() not in new]
    return placed.join(best, "id", "left").select(
        *names, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
