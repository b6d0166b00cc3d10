"""Key-based joins: what is new, pending, orphaned, duplicated or missing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.schemas import KEY
from postlake.session import cut_lineage

PENDING_ORDER = ("ingested_at", "source", "external_id")


def posting_id(source="source", external_id="external_id") -> Column:
    """One-column id of a posting, the same on every run."""
    return F.xxhash64(source, external_id)


def new_only(cards: DataFrame, known: DataFrame, key=tuple(KEY)) -> DataFrame:
    """Cards not stored yet; keep this ahead of any per-posting work."""
    return cards.join(known.select(*key), list(key), "left_anti")


def pending(raw: DataFrame, runs: DataFrame, sources=None, limit=None, key="raw_posting_id",
            order=PENDING_ORDER, retry_statuses=()) -> DataFrame:
    """Postings without a run; with a ``limit`` the first ones in ``order``, oldest first. Empty ``sources`` means all, limit 0 none.

    ``retry_statuses`` lets runs that ended that way be tried again.
    """
    if sources:
        raw = raw.filter(F.col("source").isin(list(sources)))
    if retry_statuses:
        runs = runs.filter(~F.col("status").isin(list(retry_statuses)))
    work = raw.join(runs.select(key), key, "left_anti")
    return work.orderBy(*order).limit(limit) if limit else work


def cascade(children: DataFrame, kept: DataFrame, on) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(kept.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def check_keys(df: DataFrame, key, parent: DataFrame | None = None, parent_key=None) -> DataFrame:
    """Key violations with counts: 'duplicate' key values and 'orphan' references."""
    key = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*key).agg(F.count("*").alias("rows"))
    found = counts.filter("rows > 1").withColumn("problem", F.lit("duplicate"))
    if parent is not None:
        ref = parent_key if isinstance(parent_key, str) else key[0]
        # Counted per reference first, so a hot parent reaches the join as one row.
        refs = df.filter(F.col(key[0]).isNotNull()).groupBy(key[0]).agg(F.count("*").alias("rows"))
        orphans = refs.join(parent.select(F.col(ref).alias(key[0])), key[0], "left_anti")
        found = found.unionByName(orphans.withColumn("problem", F.lit("orphan")),
                                  allowMissingColumns=True)
    return found


def missing_ids(df: DataFrame, ids: DataFrame, col="external_id") -> DataFrame:
    """Wanted ids that the table does not hold."""
    return ids.toDF(col).distinct().join(df.select(col), col, "left_anti")


def fetch_rows(df: DataFrame, ids: DataFrame, col="external_id") -> DataFrame:
    """Rows of the wanted ids, ordered by id; raises if any id is missing."""
    # One reading of the table finds the rows and the ids without one.
    wanted = ids.toDF(col).distinct().withColumn("_wanted", F.lit(True))
    found = cut_lineage(df.withColumn("_found", F.lit(True)).join(wanted, col, "right"), "rows")
    some = [r[0] for r in found.filter("_found IS NULL").orderBy(col).limit(20).select(col).collect()]
    if some:
        raise LookupError(f"ids not in the table, the first are {some}")
    return found.select(*df.columns).orderBy(col)
