"""Scores of extracted records against held-out or labelled ones."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.similar import similar_within, trigrams
from postlake.schemas import KEY, TRUTH_FIELDS
from postlake.session import cut_lineage


def field_accuracy(pred: DataFrame, truth: DataFrame, fields=None, key=tuple(KEY)) -> DataFrame:
    """Share of equal values per field, over the fields each posting's board states.

    Amounts count only where the board's salary period is known; skills are
    compared as sets.
    """
    fields = fields or [name for name, _ in TRUTH_FIELDS]

    def shown(side, name):
        c = F.col(f"{side}.{name}")
        return F.array_join(F.array_sort(c), "\x01") if name == "stack" else c.cast("string")

    rows = pred.alias("p").join(truth.alias("t"), list(key)).select(
        "t.held_out", "t.salary_period_known",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), shown("p", f).alias("pred"),
                                     shown("t", f).alias("truth")) for f in fields])).alias("x"))
    scored = F.array_contains("held_out", F.col("x.field")) & (
        ~F.col("x.field").startswith("salary_") | F.col("salary_period_known"))
    return (rows.filter(scored).groupBy("x.field")
            .agg(F.count("*").alias("scored"),
                 F.avg(F.col("x.pred").eqNullSafe(F.col("x.truth")).cast("double")).alias("accuracy")))


def doc_type_confusion(pred: DataFrame, truth: DataFrame, key=tuple(KEY)) -> DataFrame:
    """Postings per pair of predicted and true kind of document."""
    return (pred.select(*key, F.col("doc_type").alias("predicted"))
            .join(truth.select(*key, F.col("doc_type").alias("actual")), list(key))
            .groupBy("predicted", "actual").agg(F.count("*").alias("postings")))


def doc_type_accuracy(pred: DataFrame, truth: DataFrame, key=tuple(KEY)) -> DataFrame:
    return doc_type_confusion(pred, truth, key).agg(
        F.sum("postings").alias("postings"),
        (F.sum(F.when(F.col("predicted").eqNullSafe(F.col("actual")), F.col("postings")).otherwise(0))
         / F.sum("postings")).alias("accuracy"))


def role_count_error(pred: DataFrame, truth: DataFrame, key="raw_posting_id") -> DataFrame:
    """Predicted minus labelled number of roles, for every posting on either side."""
    def counts(df, name):
        return df.groupBy(key).agg(F.count("*").alias(name))

    zero = F.lit(0)
    return (counts(pred, "predicted").join(counts(truth, "labelled"), key, "full")
            .select(key, F.coalesce("predicted", zero).alias("predicted"),
                    F.coalesce("labelled", zero).alias("labelled"))
            .withColumn("difference", F.col("predicted") - F.col("labelled")))


def align_roles(pred: DataFrame, truth: DataFrame, threshold=0.3, key="raw_posting_id") -> DataFrame:
    """Pair predicted with labelled roles of one posting by title.

    Equal titles pair in order of their index. Of the others the most similar pair by trigrams is taken, then the
    most similar of what is left, as long as they reach the threshold; ties go to the smaller indices.
    """
    def numbered(df, name):
        nth = F.row_number().over(Window.partitionBy(key, "title").orderBy("role_index"))
        return df.filter(F.col("title").isNotNull()).select(
            key, "title", nth.alias("nth"), F.col("role_index").alias(name))

    both = cut_lineage(numbered(pred, "pred_index").join(numbered(truth, "truth_index"), [key, "title", "nth"], "full"))
    equal = both.filter("pred_index IS NOT NULL AND truth_index IS NOT NULL").select(
        key, "pred_index", "truth_index", F.lit(1.0).alias("similarity"))

    def rest(index, other):
        return both.filter(F.col(other).isNull()).select(
            F.struct(F.col(key).alias("k"), F.col(index).alias("i")).alias("id"), F.col(key).alias("k"),
            trigrams(F.lower("title")).alias("tokens"))

    pairs = similar_within(rest("pred_index", "truth_index"), rest("truth_index", "pred_index"), threshold, "k")
    pairs = pairs.select(F.col("id_a.k").alias(key), F.col("id_a.i").alias("pred_index"),
                         F.col("id_b.i").alias("truth_index"), "similarity")
    # One array per posting, as long as the pairs that one reply can make.
    ordered = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("similarity")).alias("order"), "pred_index", "truth_index"))).alias("pairs"))

    def taken(chosen, pair):
        return F.exists(chosen, lambda c: (c["pred_index"] == pair["pred_index"]) | (c["truth_index"] == pair["truth_index"]))

    best = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda chosen, pair: F.when(taken(chosen, pair), chosen).otherwise(
        F.array_append(chosen, pair)))
    greedy = ordered.select(key, F.inline(best)).select(key, "pred_index", "truth_index", (-F.col("order")).alias("similarity"))
    return equal.unionByName(greedy)


def skill_prf(pred: DataFrame, truth: DataFrame, key=tuple(KEY)) -> DataFrame:
    """Precision, recall and F1 of skill sets, over all postings together."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce("p.stack", none), F.coalesce("t.stack", none)
    sizes = pred.alias("p").join(truth.alias("t"), list(key)).select(
        F.size(F.array_intersect(a, b)).alias("hit"), F.size(F.array_distinct(a)).alias("pred"),
        F.size(F.array_distinct(b)).alias("truth"))
    total = sizes.agg(*[F.sum(c).alias(c) for c in ("hit", "pred", "truth")])
    precision, recall = F.try_divide("hit", "pred"), F.try_divide("hit", "truth")
    return total.select(precision.alias("precision"), recall.alias("recall"),
                        F.try_divide(2 * F.col("hit"), F.col("pred") + F.col("truth")).alias("f1"))
