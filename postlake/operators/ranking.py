"""First rows per group, without gathering a group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(order) -> list[Column]:
    """Sort columns from names; a leading '-' means descending."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def first_n(df: DataFrame, keys, order, n: int, rank="rank", salts=64) -> DataFrame:
    """Rows ranked 1..n within ``keys``; ``order`` must be total.

    For small n Spark ranks inside each map task first and shuffles at most n
    rows per group and task (WindowGroupLimit). It stops doing so above a
    threshold, so larger n is ranked within salted parts of each group first.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        names = [c.lstrip("-") for c in order]
        part = df.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*ordering(order))
        df = (part.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
              .drop("_salt", rank))
    w = Window.partitionBy(*keys).orderBy(*ordering(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
