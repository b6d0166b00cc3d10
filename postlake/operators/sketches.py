"""Distinct counts and quartiles that are written down per month and merged later, without the rows behind them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a count, as a power of two, and the size of a quantile sketch.
LG_K, KLL_K = 12, 400
#: Three standard errors of a count, as a share of it, and the error of a rank that a quartile keeps within.
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.02

COUNTED, AMOUNTS = "counted", "amounts"


def rollup_sketches(rows: DataFrame, by, counted=None, amount=None) -> DataFrame:
    """Per group of ``by`` a sketch of the distinct values of ``counted`` and one of the ``amount``, a whole number.

    A null counts in neither. Groups are summed up before they are exchanged, so a hot group costs a sketch per task. Sketches are
    plain binary columns: they can be stored.
    """
    made = []
    if counted is not None:
        made.append(F.hll_sketch_agg(counted, LG_K).alias(COUNTED))
    if amount is not None:
        made.append(F.kll_sketch_agg_bigint(F.col(amount).cast("bigint"), KLL_K).alias(AMOUNTS))
    return rows.groupBy(*by).agg(*made)


def merge_sketches(stored: DataFrame, by, more: DataFrame | None = None) -> DataFrame:
    """Sketches of ``stored`` and ``more`` as one per group of ``by``: months into years, or a load into what is there.

    What both sides have counted counts once in ``counted``, so a load may be merged again; ``amounts`` add up, so a
    group that is loaded anew must replace its row.
    """
    rows = stored if more is None else stored.unionByName(more.select(*stored.columns))
    made = []
    if COUNTED in stored.columns:
        made.append(F.hll_union_agg(COUNTED).alias(COUNTED))
    if AMOUNTS in stored.columns:
        made.append(F.kll_merge_agg_bigint(AMOUNTS, KLL_K).alias(AMOUNTS))
    return rows.groupBy(*by).agg(*made)


def distinct_counts(sketches: DataFrame, out="postings") -> DataFrame:
    """The estimated counts in place of the sketches, within COUNT_ERROR of the exact ones but for about one in 400."""
    return sketches.withColumn(out, F.hll_sketch_estimate(COUNTED)).drop(COUNTED, AMOUNTS)


def quartiles(sketches: DataFrame) -> DataFrame:
    """n and quartiles in place of the sketches; a quartile is a stated amount whose rank is within RANK_ERROR of
    its place. Groups without amounts are left out."""
    known = sketches.filter(F.col(AMOUNTS).isNotNull()).withColumn("n", F.kll_sketch_get_n_bigint(AMOUNTS)).filter("n > 0")
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return known.withColumns({n: F.kll_sketch_get_quantile_bigint(AMOUNTS, F.lit(p)) for n, p in points.items()}).drop(COUNTED, AMOUNTS)
