"""Table constraints as jobs: each row gets the list of rules it breaks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.operators.steps import once


def _broken(**rules: Column) -> Column:
    """Names of the rules that a row breaks; a rule that cannot be decided holds."""
    return F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]),
                    lambda x: x.isNotNull())


def check_raw(df: DataFrame, sources=vocab.SOURCES) -> DataFrame:
    """Rules of the raw table, as an array column ``reason`` (empty when all hold)."""
    text, month = F.col("raw_text"), F.col("thread_month")
    return df.withColumn("reason", _broken(
        source_set=F.col("source").isNotNull(),
        source_allowed=F.col("source").isin(list(sources)),
        external_id_set=F.col("external_id").isNotNull(),
        text_set=text.isNotNull(),
        text_not_blank=F.trim(text) != "",
        text_without_nul=~F.contains(text, F.lit("\0")),
        month_is_first_day=F.dayofmonth(month) == 1,
        forum_has_month=(F.col("source") != "hn") | month.isNotNull(),
        posted_at_set=F.col("posted_at").isNotNull(),
    ))


def check_roles(df: DataFrame) -> DataFrame:
    """Rules of the roles table, as an array column ``reason``."""
    def amount(c):
        return F.col(c).between(-2**31, 2**31 - 1)

    return once(df, {"reason": _broken(
        posting_set=F.col("raw_posting_id").isNotNull(),
        index_set=F.col("role_index").isNotNull(),
        seniority_known=F.coalesce(F.col("seniority").isin(list(vocab.SENIORITIES)), F.lit(False)),
        remote_known=F.coalesce(F.col("remote_policy").isin(list(vocab.REMOTE_POLICIES)), F.lit(False)),
        employment_known=F.coalesce(F.col("employment_type").isin(list(vocab.EMPLOYMENTS)), F.lit(False)),
        stack_set=F.col("stack").isNotNull(),
        quotes_set=F.col("source_quotes").isNotNull(),
        min_fits=amount("salary_min"),
        max_fits=amount("salary_max"),
        band_ordered=F.col("salary_max") >= F.col("salary_min"),
    )})


def check_sources(df: DataFrame, allowed) -> DataFrame:
    """Stored rows that a new list of sources would refuse, counted per source."""
    return (df.filter(~F.col("source").isin(list(allowed)))
            .groupBy("source").agg(F.count("*").alias("rows")))


def role_count_mismatch(runs: DataFrame, roles: DataFrame) -> DataFrame:
    """Runs whose role count is not the number of stored roles (left by failed re-runs)."""
    stored = roles.groupBy("raw_posting_id").agg(F.count("*").alias("stored"))
    return (runs.join(stored, "raw_posting_id", "left")
            .withColumn("stored", F.coalesce("stored", F.lit(0)))
            .filter(F.col("stored") != F.col("role_count"))
            .select("raw_posting_id", "status", "role_count", "stored"))


def health(df: DataFrame, text="raw_text") -> DataFrame:
    """Rows and missing texts per source; ``alarm`` when more than a tenth are missing."""
    return (df.groupBy("source")
            .agg(F.count("*").alias("rows"), F.count_if(F.col(text).isNull()).alias("missing"))
            .withColumn("alarm", F.col("missing") > F.floor(F.col("rows") / 10)))
