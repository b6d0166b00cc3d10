"""Seeded samples that do not depend on how the data is partitioned."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.text import lookup
from postlake.operators.keys import fetch_rows
from postlake.operators.ranking import first_n
from postlake.session import cut_lineage


def header_company(c="raw_text") -> Column:
    """Company of a forum posting: what stands before the first bar of its first line."""
    return F.trim(F.split_part(F.split_part(c, F.lit("<p>"), F.lit(1)), F.lit("|"), F.lit(1)))


def first_per_company(df: DataFrame, order=("external_id",)) -> DataFrame:
    """One posting per company, the first by ``order``."""
    return first_n(df.withColumn("company", header_company()), ["company"], list(order), 1).drop("rank")


def stratified_sample(pool: DataFrame, quotas: dict, seed=vocab.GOLD_SEED, strict=True) -> DataFrame:
    """The ``quotas[source]`` rows of each source with the smallest seeded hash.

    Raises when a source has fewer rows than its quota.
    """
    wanted = lookup({k: int(n) for k, n in quotas.items()}, F.col("source"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), "external_id"))
    ranked = first_n(pool.filter(wanted > 0).withColumn("_draw", drawn), ["source"],
                     ["_draw", "external_id"], max(quotas.values()))
    # As many rows as the quotas say: written down, the pool is read once for the check and the result.
    sample = cut_lineage(ranked.filter(F.col("rank") <= wanted).drop("_draw", "rank"), "sample")
    if strict:
        found = dict(sample.groupBy("source").count().collect())  # one row per quota
        short = {s: found.get(s, 0) for s, n in quotas.items() if found.get(s, 0) < n}
        if short:
            raise ValueError(f"quotas {quotas} not met, rows found {short}")
    return sample


def gold_pool(df: DataFrame, always=(), excluded=(), source="hn") -> DataFrame:
    """Rows to draw from: one per company on the forum, without the listed ids and
    without the companies of the hand-picked ones; all rows of the other sources."""
    forum = df.filter(F.col("source") == source).withColumn("company", header_company())
    picked = forum.filter(F.col("external_id").isin(list(always))).select("company").distinct()
    rest = (forum.filter(~F.col("external_id").isin(list(excluded)))
            .join(picked, "company", "left_anti"))
    return (first_per_company(rest).drop("company")
            .unionByName(df.filter(F.col("source") != source)))


def build_gold(df: DataFrame, quotas=vocab.GOLD_QUOTAS, seed=vocab.GOLD_SEED, always=(),
               excluded=(), dataset_role=None, source="hn", strict=True) -> DataFrame:
    """Gold candidates: the hand-picked forum rows plus a seeded draw up to the quotas.

    ``always`` and ``excluded`` are short hand-made lists of forum ids. Refuses
    unless the data set is a frozen 'eval' copy.
    """
    if dataset_role != "eval":
        raise PermissionError(f"data set role is {dataset_role!r}, sampling needs 'eval'")
    columns = ["source", "external_id", "raw_text", "posted_at"]
    draw = {**quotas, source: quotas[source] - len(always)}
    sample = stratified_sample(gold_pool(df, always, excluded, source), draw, seed, strict)
    if not always:
        return sample.select(*columns)
    ids = df.sparkSession.createDataFrame([(i,) for i in always], "external_id string")
    return sample.select(*columns).unionByName(
        fetch_rows(df.filter(F.col("source") == source), ids).select(*columns))
