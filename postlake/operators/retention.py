"""Age-out of postings: preview, purge, cascade and time back-fill."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.times import cutoff, iso_instant


def _goes(cut, as_of, days):
    cut_source = F.col("source").isin(list(cut)) if cut else F.lit(False)
    return F.coalesce(cut_source | (F.col("posted_at") < cutoff(as_of, days)), cut_source, F.lit(False))


def purge_preview(df: DataFrame, as_of, cut=vocab.CUT_SOURCES, days=vocab.WINDOW_DAYS) -> DataFrame:
    """Counts per source before a purge; a cut and expired row goes once."""
    cut_source = F.col("source").isin(list(cut)) if cut else F.lit(False)
    return df.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(cut_source).alias("cut_source"),
        F.count_if(F.col("posted_at") < cutoff(as_of, days)).alias("expired"),
        F.count_if(_goes(cut, as_of, days)).alias("going"),
        F.count_if(~_goes(cut, as_of, days)).alias("keeping"))


def survivors(df: DataFrame, as_of, cut=vocab.CUT_SOURCES, days=vocab.WINDOW_DAYS) -> DataFrame:
    """Rows a purge leaves; a row without a time stays."""
    return df.filter(~_goes(cut, as_of, days))


def purge(df: DataFrame, as_of, cut=vocab.CUT_SOURCES, days=vocab.WINDOW_DAYS, apply=False,
          dataset_role=None):
    """(rows after the purge, preview). A dry run, the default, keeps every row.

    Refuses unless the data set says it is live.
    """
    if dataset_role != "live":
        raise PermissionError(f"data set role is {dataset_role!r}, purge needs 'live'")
    preview = purge_preview(df, as_of, cut, days)
    return (survivors(df, as_of, cut, days) if apply else df), preview


def backfill_posted_at(df: DataFrame) -> DataFrame:
    """Fill missing publish times from the stored JSON; forum rows stay as they are.

    One board writes local clock text that means UTC, so an offset in it is ignored.
    """
    created = iso_instant(F.get_json_object("raw_text", "$.created"))
    published = iso_instant(F.regexp_replace(
        F.get_json_object("raw_text", "$.publication_date"), r"(?:Z|[+-]\d{2}(?::?\d{2})?)\z", ""))
    found = F.when(F.col("source") == "adzuna", created).when(F.col("source") == "remotive", published)
    return df.withColumn("posted_at", F.coalesce("posted_at", found))
