"""Counts, distributions, roll-ups and trends over stored roles and runs."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.times import cutoff, utc_month
from postlake.operators.ranking import first_n
from postlake.operators.steps import once
from postlake.operators.totals import run_totals
from postlake.session import cut_lineage


def coverage(runs: DataFrame) -> DataFrame:
    """Runs per status and kind of document."""
    return runs.groupBy("status", "doc_type").agg(F.count("*").alias("runs"))


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row of totals over a set of outcomes."""
    return outcomes.agg(*[c.alias(n) for n, c in run_totals().items()])


def corpus_profile(df: DataFrame, salary="salary_raw") -> DataFrame:
    """Postings per source and the share that states a salary."""
    return df.groupBy("source").agg(
        F.count("*").alias("postings"),
        F.avg(F.col(salary).isNotNull().cast("double")).alias("salary_share"))


def skill_frequency(roles: DataFrame, by=(), posting="raw_posting_id", approx=False) -> DataFrame:
    """Postings that ask for each skill. Exact counts shuffle on skill and posting
    together, so a skill most postings name is spread over all tasks."""
    # The outer form keeps Catalyst from testing the array below, which would build it twice.
    rows = roles.select(*by, F.explode_outer("stack").alias("skill"), posting).filter("skill IS NOT NULL")
    count = F.approx_count_distinct(posting) if approx else F.count_distinct(posting)
    return rows.groupBy(*by, "skill").agg(count.alias("postings"))


def salary_distribution(roles: DataFrame, by=(), amount="salary_min", currency="salary_currency",
                        bucket=1000) -> DataFrame:
    """n, min, quartiles and max of monthly amounts, per group and currency.

    Quartiles are exact and interpolated. Amounts are counted by value, the
    counts are summed per bucket of values, and the running totals run over
    buckets first and over the values of one bucket then; no task holds a group.
    """
    keys = [*by, currency]
    stated = once(roles.select(*keys, amount), {"value": F.col(amount)}).filter("value IS NOT NULL")
    counts = cut_lineage(stated.groupBy(*keys, "value").agg(F.count("*").alias("rows"))
                         .withColumn("_bucket", F.floor(F.col("value") / bucket)), "values")
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("rows").alias("_rows"))
    w = Window.partitionBy(*keys)
    up_to = w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (buckets.withColumn("_before", F.sum("_rows").over(up_to) - F.col("_rows"))
               .withColumn("_n", F.sum("_rows").over(w)).drop("_rows"))
    # Null keys (an unstated currency) are a group like any other.
    b = buckets.select(*[F.col(c).alias(f"_b_{c}") for c in keys], F.col("_bucket").alias("_b_bucket"),
                       "_before", "_n")
    same = F.col("_bucket") == F.col("_b_bucket")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = (counts.join(b, same)
              .withColumn("_end", F.col("_before") + F.sum("rows").over(inside))
              .withColumn("_start", F.col("_end") - F.col("rows")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("value")))

    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    aggs = [F.max("_n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")]
    for name, p in points.items():
        place = (F.col("_n") - 1) * F.lit(p)
        aggs += [at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi")]
    out = ranked.groupBy(*keys).agg(*aggs)

    def between(name, p):
        place = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (place - F.floor(place))).alias(name)

    return out.select(*keys, "n", "min", *[between(k, p) for k, p in points.items()], "max")


def salary_distribution_approx(roles: DataFrame, by=(), amount="salary_min",
                               currency="salary_currency", accuracy=10000) -> DataFrame:
    """The same from bounded sketches: one shuffle, quartiles are stated values."""
    q = F.percentile_approx(amount, [0.25, 0.5, 0.75], accuracy)
    out = roles.filter(F.col(amount).isNotNull()).groupBy(*by, currency).agg(
        F.count("*").alias("n"), F.min(amount).alias("min"), q.alias("_q"), F.max(amount).alias("max"))
    return out.select(*by, currency, "n", "min", F.col("_q")[0].alias("q1"),
                      F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max")


def month_counts(roles: DataFrame, raw: DataFrame, posting="raw_posting_id") -> DataFrame:
    """Postings per month of publishing and skill. ``raw`` gives ``posted_at`` by posting."""
    dated = roles.select(posting, "stack").join(
        raw.select(posting, utc_month("posted_at").alias("month")), posting)
    return skill_frequency(dated, ["month"], posting)


def monthly_rollup(roles: DataFrame, raw: DataFrame, existing: DataFrame, as_of=None,
                   days=vocab.WINDOW_DAYS, posting="raw_posting_id") -> DataFrame:
    """Roll-up with the months at hand counted anew and all others kept.

    With ``as_of``, a stored month that the purge has begun to eat (it started
    before the window) keeps its old counts.
    """
    fresh = month_counts(roles, raw, posting) if as_of is None else cut_lineage(month_counts(roles, raw, posting), "counts")
    if as_of is not None:
        partial = F.col("month").cast("timestamp") < cutoff(as_of, days)
        stored = existing.select("month").distinct()
        fresh = fresh.filter(~partial).unionByName(
            fresh.filter(partial).join(stored, "month", "left_anti"))
    fresh = cut_lineage(fresh, "months")  # the months and their counts come from one reading of the roles
    months = fresh.select("month").distinct()
    return existing.select(*fresh.columns).join(months, "month", "left_anti").unionByName(fresh)


def skill_trend(rollup: DataFrame) -> DataFrame:
    """Month-over-month change per skill, and the dense rank of each skill within its month.

    The rank is taken over the distinct counts of a month, which are few however
    many skills there are, and joined back.
    """
    rollup = cut_lineage(rollup, "rollup")
    w = Window.partitionBy("skill").orderBy("month")
    before = F.when(F.lag("month").over(w) == F.add_months("month", -1), F.lag("postings").over(w))
    ranks = (rollup.select("month", "postings").distinct()
             .withColumn("rank", F.dense_rank().over(
                 Window.partitionBy("month").orderBy(F.desc("postings")))))
    return (rollup.withColumn("previous", before)
            .withColumn("change", F.col("postings") - F.col("previous"))
            .join(ranks, ["month", "postings"])
            .select("month", "skill", "postings", "previous", "change", "rank"))


def top_skills(freq: DataFrame, by=(), n=10) -> DataFrame:
    """First n skills per group by postings, ties by name."""
    if not by:
        return (freq.orderBy(F.desc("postings"), "skill").limit(n)
                .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("postings"), "skill"))))
    return first_n(freq, list(by), ["-postings", "skill"], n)


def gold_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("rows"))


def gap_report(df: DataFrame, raw: str, mapped: str) -> DataFrame:
    """Stated values that the vocabulary does not know, with counts."""
    gap = F.col(raw).isNotNull() & (F.col(mapped).isNull() | (F.col(mapped) == "unknown"))
    return df.filter(gap).groupBy(F.col(raw).alias("value")).agg(F.count("*").alias("rows"))


def error_summary(runs: DataFrame) -> DataFrame:
    """Failed runs per model and error text."""
    return (runs.filter(F.col("status") != "ok")
            .groupBy("model", F.substring("error", 1, vocab.ERROR_CHARS).alias("error"))
            .agg(F.count("*").alias("runs")))
