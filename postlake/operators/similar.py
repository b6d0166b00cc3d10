"""Near-duplicate names by character trigrams, exactly and without comparing all pairs.

Two sets with Jaccard similarity t or more must share a token among the first
few tokens of each, when tokens are sorted from rare to common. Only those
prefixes are joined, so a trigram that most names contain is hardly ever a join
key; prefixes that stay hot are split over salted parts.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import collapse, strip

_PART = 1000  # rows of one token per salted part


def trigrams(c) -> Column:
    """Distinct runs of three characters; a shorter text is its own only token."""
    c = F.col(c) if isinstance(c, str) else c
    last = F.greatest(F.length(c) - 2, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, F.lit(3))))


def _rare_first(df: DataFrame) -> DataFrame:
    """Replace ``tokens`` by the same tokens from rare to common."""
    items = df.select("id", F.explode("tokens").alias("token"))
    counts = items.groupBy("token").agg(F.count("*").alias("n"))
    ranked = (items.join(counts, "token").groupBy("id")
              .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t")))
    return df.drop("tokens").join(ranked, "id").withColumn("tokens", F.col("t.token")).drop("t")


def _prefixes(df: DataFrame, threshold: float) -> DataFrame:
    size = F.size("tokens")
    keep = size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1
    return (df.withColumn("prefix", F.slice("tokens", F.lit(1), keep))
            .withColumn("token", F.explode("prefix")))


def _salted(rows: DataFrame):
    """Both sides of a join on ``token``, with tokens of many rows split into parts."""
    hot = (rows.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > _PART)
           .select("token", F.ceil(F.col("n") / _PART).cast("int").alias("parts")))
    rows = rows.join(hot, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return (rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")),
            rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))


def _matches(a: DataFrame, b: DataFrame, key, threshold: float, where) -> DataFrame:
    a, b = a.alias("a"), b.alias("b")
    match = where
    for c in key:
        match = match & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    na, nb = F.size("a.tokens"), F.size("b.tokens")
    match = match & (na >= nb * F.lit(threshold) - 1e-9) & (nb >= na * F.lit(threshold) - 1e-9)
    # A pair shows up once per shared prefix token; only the first of them counts.
    first = F.try_element_at(F.array_intersect("a.prefix", "b.prefix"), F.lit(1)) == F.col("a.token")
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    return (a.join(b, match).filter(first)
            .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"),
                    (shared / (na + nb - shared)).alias("similarity"))
            .filter(F.col("similarity") >= threshold - 1e-9))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs id_a < id_b of rows ``(id, tokens)`` with Jaccard similarity of at least ``threshold``."""
    a, b = _salted(_prefixes(_rare_first(sets), threshold))
    return _matches(a, b, ["token", "part"], threshold, F.col("a.id") < F.col("b.id"))


def similar_within(left: DataFrame, right: DataFrame, threshold: float, group: str) -> DataFrame:
    """Pairs of left and right rows ``(id, group, tokens)`` of one group.

    The group is part of the join key, so how common a token is overall does not
    matter and any fixed order of tokens will do.
    """
    a, b = (_prefixes(df.withColumn("tokens", F.array_sort("tokens")), threshold) for df in (left, right))
    return _matches(a, b, [group, "token"], threshold, F.lit(True))


def name_keys(df: DataFrame, company="company", title="title", posting="external_id") -> DataFrame:
    """Distinct lower-case 'company title' names per source: first posting and number of copies."""
    name = F.lower(strip(collapse(F.concat_ws(" ", company, title))))
    return (df.withColumn("name", name).filter(F.col("name") != "")
            .groupBy("source", "name")
            .agg(F.min(posting).alias("posting"), F.count("*").alias("copies")))


def fuzzy_pairs(df: DataFrame, threshold=0.6, company="company", title="title",
                posting="external_id") -> DataFrame:
    """Names alike in two sources.

    Names are compared once each, whatever number of sources and postings use
    them. Copies of a name within a source are one row with a count, so a
    posting repeated a million times makes one pair, not a million.
    """
    names = name_keys(df, company, title, posting)
    words = names.select("name").distinct()
    pairs = similar_sets(words.select(F.col("name").alias("id"), trigrams("name").alias("tokens")), threshold)
    same = words.select(F.col("name").alias("id_a"), F.col("name").alias("id_b"), F.lit(1.0).alias("similarity"))
    alike = pairs.unionByName(same).unionByName(
        pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "similarity"))

    def side(x):
        return names.select(F.col("name").alias(f"id_{x}"), *[
            F.col(c).alias(f"{c}_{x}") for c in ("source", "name", "posting", "copies")])

    return (alike.join(side("a"), "id_a").join(side("b"), "id_b").filter("source_a < source_b")
            .select("source_a", "name_a", "posting_a", "copies_a",
                    "source_b", "name_b", "posting_b", "copies_b", "similarity"))
