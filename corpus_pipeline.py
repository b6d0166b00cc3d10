"""From documents to packed token sequences, in stages that are each written down.

Every stage takes (spark, documents that its predecessor kept, folder of the tables). All but the last return the
columns of documents, with whatever other columns these have, by any name. Rows with nulls, empty texts and repeated
rows go through as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import jaccard, packing, suffixes, toxicity, winnowing
from postlake.llm.shared import stored, table

#: Score from which a document counts as toxic.
TOXIC = 0.5
#: Words of a passage from which its repetitions go.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the scores are learned from the labelled ones of this input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(_apart(docs), model).where(F.col("score") < TOXIC).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates one row: that with the smallest id, null being the largest, and of
    rows that share it one with the smallest hash of its text. Documents without a word stay."""
    found = stored(jaccard.similar(docs).where("group is not null").select("group", "doc", "text_hash"), "groups")
    rank = F.struct(F.col("doc").isNull().alias("null"), "doc", "text_hash")
    several = found.groupBy("group").agg(F.min(rank).alias("best"), F.count("*").alias("n")).where("n > 1").select("group", "best")
    # Written down, so that a group with many rows can be split where it is joined.
    several = stored(several, "several")
    marks = stored(found.join(several, "group").select("doc", "text_hash", rank.eqNullSafe(F.col("best")).alias("best")).distinct(), "marks")
    known = _apart(docs).withColumn("hash", F.xxhash64("text"))
    marked = known.join(marks, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    best = marked.where("best").dropDuplicates(["doc_id", "hash"])
    return marked.where("best is null").select("row.*").unionByName(best.select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE words or more that an earlier document has, or the same one has before;
    a document of which no word is left goes. ``n_chars``, where there is one, is that of the new text."""
    cut = suffixes.remove_repeats(_apart(docs), least_words=PASSAGE).where("_cut = 0 or _cut < _words")
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_cut") > 0, F.length("_text").cast("long")).otherwise(
        F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    return winnowing.without_items(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 1024 ids at most, as pieces of documents."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added).withColumnRenamed("doc", "doc_id")


def _apart(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` beside the whole ``row``, whose columns then clash with none that a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


STAGES = [("toxicity", drop_toxic), ("near duplicates", keep_one_of_each), ("repeated passages", cut_repeats),
          ("decontamination", drop_contaminated), ("packing", pack)]

#: No stage but the last is out of reach of SQL alone; scores, components and encodings are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
