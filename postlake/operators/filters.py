"""Freshness, paging duplicates, routing and exclusion."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.times import cutoff
from postlake.operators.ranking import first_n


def within_window(df: DataFrame, as_of, days=vocab.WINDOW_DAYS, col="posted_at") -> DataFrame:
    """Rows no older than the window; the bound itself is in. Pushed to the scan."""
    return df.filter(F.col(col) >= cutoff(as_of, days))


def dedupe_cards(df: DataFrame, order, key=("source", "external_id")) -> DataFrame:
    """First card per id in reading order."""
    return first_n(df, list(key), list(order), 1).drop("rank")


def mark_cards(cards: DataFrame, known: DataFrame, as_of, order, days=vocab.WINDOW_DAYS,
               key=("source", "external_id")) -> DataFrame:
    """Label each card 'fresh', 'duplicate' or 'stored_or_aged' as a reader in order would.

    A card is a duplicate once a fresh card of the same id has come before it.
    """
    key, order = list(key), list(order)
    stored = known.select(*key).distinct().withColumn("_stored", F.lit(True))
    marked = (cards.join(stored, key, "left")
              .withColumn("_at", F.struct(*order))
              .withColumn("_new", F.col("_stored").isNull()
                          & F.coalesce(F.col("posted_at") >= cutoff(as_of, days), F.lit(False))))
    firsts = marked.filter("_new").groupBy(*key).agg(F.min("_at").alias("_first"))
    state = (F.when(F.col("_at") == F.col("_first"), "fresh")
             .when(F.col("_at") > F.col("_first"), "duplicate")
             .otherwise("stored_or_aged"))
    return (marked.join(firsts, key, "left").withColumn("state", state)
            .drop("_stored", "_at", "_new", "_first"))


def funnel(marked: DataFrame) -> DataFrame:
    """Card counts per source: read, new in window, stored or aged out, paging duplicates."""
    def n(state):
        return F.count_if(F.col("state") == state)

    return marked.groupBy("source").agg(
        F.count("*").alias("cards"), n("fresh").alias("fresh"),
        n("stored_or_aged").alias("stored_or_aged"), n("duplicate").alias("duplicates"))


def route(df: DataFrame, text="text", min_chars=vocab.PREFILTER_MIN_CHARS) -> DataFrame:
    """Decide what needs no extraction: ``prefilter`` is 'other' there and null elsewhere.

    Forum comments are dropped when flagged, dead or short; empty text always is.
    """
    c = F.col(text)
    forum = (F.col("source") == "hn") & (
        c.rlike(r"(?i)\A\s*\[(flagged|dead)\]") | (F.length(c) < min_chars))
    return df.withColumn("prefilter", F.when(forum | (F.trim(c) == "") | c.isNull(), "other"))


def exclude(df: DataFrame, ids: DataFrame | None = None, companies: DataFrame | None = None,
            id_col="external_id", company_col="company") -> DataFrame:
    """Drop listed ids and listed companies. Lists are one-column tables of any size."""
    for col, drop in ((id_col, ids), (company_col, companies)):
        if drop is not None:
            df = df.join(drop.toDF(col).distinct(), col, "left_anti")
    return df


def search_filter(roles: DataFrame, seniority=None, remote_policy=None) -> DataFrame:
    """Metadata filter placed before a top-k search."""
    for col, allowed in (("seniority", seniority), ("remote_policy", remote_policy)):
        if allowed:
            roles = roles.filter(F.col(col).isin(list(allowed)))
    return roles
