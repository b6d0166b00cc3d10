"""The streaming jobs run over the given tables until they have caught up."""

import uuid

from pyspark.sql import functions as F

from postlake.plans.registry import query
from postlake.plans.standins import (
    AS_OF, DAYS, POSTINGS_SQL, STORED_SQL, plain, postings, stored, table,
)
from postlake.session import shared_folder
from postlake.sources.buckets import read_table, replace_rows
from postlake.streaming import jobs

RP = f"WITH {POSTINGS_SQL}"


def scratch(spark) -> str:
    """New folder below the one all executors share."""
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def land(spark, sf, df, name):
    """Land rows as the files a stream reads."""
    folder = f"{scratch(spark)}/{name}"
    df.write.parquet(folder)
    return jobs.read_rows(spark, folder, df.schema)


def caught_up(spark, stream):
    """Everything a stream has written once no input is left."""
    folder = scratch(spark)
    run = (stream.writeStream.format("parquet").option("path", f"{folder}/out")
           .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_upsert", f"""{RP},{STORED_SQL},
inc AS (SELECT *, CASE WHEN lang = 'en' THEN raw_text || '!' ELSE raw_text END AS new_text FROM rp
        WHERE posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY)
SELECT coalesce(i.source, c.source) AS source, coalesce(i.external_id, c.external_id) AS external_id,
       coalesce(i.new_text, c.raw_text) AS raw_text,
       CASE WHEN i.new_text IS DISTINCT FROM c.raw_text AND i.source IS NOT NULL THEN TIMESTAMP '{AS_OF}'
            ELSE c.updated_at END AS updated_at
FROM inc i FULL JOIN cur c USING (source, external_id)""")
def stream_upsert(spark, sf):
    rows = postings(spark, sf).withColumn("raw_text", F.when(
        F.col("lang") == "en", F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text")))
    dest = scratch(spark)
    replace_rows(stored(spark, sf), f"{dest}/table")
    jobs.stream_upsert(land(spark, sf, rows, "postings"), dest, f"{dest}/state", ["id"], AS_OF, DAYS,
                       chunk=F.expr("id div 100000")).awaitTermination()
    return read_table(spark, f"{dest}/table").select(
        "source", "external_id", "raw_text", plain("updated_at").alias("updated_at"))


@query("stream_dedupe", """
SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS source, CAST(l_orderkey AS VARCHAR) AS external_id FROM lineitem""")
def stream_dedupe(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("string").alias("source"), F.col("l_orderkey").cast("string").alias("external_id"),
        F.col("l_shipdate").cast("timestamp").alias("posted_at"))
    return caught_up(spark, jobs.stream_dedupe(land(spark, sf, lines, "lines"))).select("source", "external_id")


@query("stream_counts", f"""{RP}
SELECT date_trunc('day', posted_at) AS start, source, count(*) AS postings FROM rp WHERE posted_at IS NOT NULL
GROUP BY 1, 2 HAVING start + INTERVAL 1 DAY <= (SELECT max(posted_at) - INTERVAL 1 DAY FROM rp)""")
def stream_counts(spark, sf):
    rows = postings(spark, sf).select("source", "posted_at")
    out = caught_up(spark, jobs.stream_counts(land(spark, sf, rows, "postings")))
    return out.select(plain(F.col("start").cast("timestamp")).alias("start"), "source", "postings")


@query("stream_counts_sliding", f"""{RP},
w AS (SELECT source, unnest([date_trunc('day', posted_at), date_trunc('day', posted_at) - INTERVAL 1 DAY]) AS start FROM rp WHERE posted_at IS NOT NULL)
SELECT start, source, count(*) AS postings FROM w
GROUP BY 1, 2 HAVING start + INTERVAL 2 DAY <= (SELECT max(posted_at) - INTERVAL 1 DAY FROM rp)""")
def stream_counts_sliding(spark, sf):
    """Windows of two days that begin every day."""
    rows = postings(spark, sf).select("source", "posted_at")
    out = caught_up(spark, jobs.stream_counts(land(spark, sf, rows, "postings"), "2 days", "1 day"))
    return out.select(plain(F.col("start").cast("timestamp")).alias("start"), "source", "postings")


_EDITS = f"""{RP}
SELECT source, external_id, 1 AS inserted, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS updated,
       CASE WHEN quality = 0 THEN 1 ELSE 0 END AS unchanged
FROM rp LEFT JOIN labels ON doc_id = id WHERE posted_at IS NOT NULL"""


def _edited(spark, sf):
    """Postings, labelled ones twice, with another text if their quality is good."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    waves = F.when(F.col("quality").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    return (postings(spark, sf).filter(F.col("posted_at").isNotNull()).join(labels, "id", "left")
            .withColumn("wave", F.explode(waves))
            .withColumn("raw_text", F.when((F.col("wave") == 2) & (F.col("quality") == 1),
                                           F.concat("raw_text", F.lit("?"))).otherwise(F.col("raw_text"))))


@query("stream_edits", _EDITS)
def stream_edits(spark, sf):
    return caught_up(spark, jobs.stream_edits(land(spark, sf, _edited(spark, sf), "postings"), "wave"))


@query("stream_edits_stored", f"SELECT source, external_id, inserted, updated, unchanged FROM ({_EDITS})")
def stream_edits_stored(spark, sf):
    """The same with the state in a table and a micro-batch summed up first."""
    dest = scratch(spark)
    jobs.stream_edits_stored(land(spark, sf, _edited(spark, sf), "postings"), dest, f"{dest}/check", ["wave"], chunk=F.col("wave")).awaitTermination()
    return spark.read.parquet(f"{dest}/edits/*").select("source", "external_id", "inserted", "updated", "unchanged")
