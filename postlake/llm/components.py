"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """Every node of ``links`` (``a``, ``b``) with a ``component`` that its component's nodes share.

    Each round every node joins the node of the least priority within two links of it, two steps at once, and the graph
    shrinks to the nodes joined: a star in one round, a path to less than a fifth. Priorities are hashes that change from
    round to round. All steps are aggregates and joins over links; what a round leaves is written down, its least neighbours
    too, so that a node with many links can be split where they are joined. Few rounds keep the jobs few, of which the
    driver holds a record each. Null ends and loops are no links; repeated links count once.
    """
    rest = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    round_ = 0
    while not rest.isEmpty():
        def rank(column, seed=round_):
            return F.struct(F.xxhash64(F.lit(seed), F.col(column)).alias("order"), F.col(column).alias("node"))

        both = rest.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(rest.select("b", "a"))
        least = stored(both.groupBy("node").agg(F.min(rank("near")).alias("least"))
                       .select(F.col("node").alias("near"), F.least(rank("node"), "least").alias("least")), "least")
        # A neighbour's least is the node itself where none within two links comes before it.
        joins = stored(both.join(least, "near").groupBy("node").agg(F.min("least").alias("least"))
                       .select("node", F.col("least.node").alias("to")), "joins")
        step = joins.select(F.col("node").alias("to"), F.col("to").alias("label"))
        moved = joins.join(step, "to").select("node", "label")
        if labels is None:
            new = stored(moved, "labels")
            moves = new
        else:
            moves = stored(moved, "moves")
            step = moves.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = stored(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        ends = {c: moves.select(F.col("node").alias(c), F.col("label").alias(f"{c}2")) for c in ("a", "b")}
        left = stored(rest.join(ends["a"], "a").join(ends["b"], "b").where("a2 <> b2")
                      .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        for done in {id(x): x for x in (rest, least, joins, moves, labels) if x is not None and x is not new}.values():
            discard(done)
        rest, labels, round_ = left, new, round_ + 1
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("label").alias("component"))
