"""Queries over raw postings: reading, filtering, keys, upsert, retention, quality."""

import uuid

from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions.times import instant
from postlake.operators import filters, keys, quality, retention, sampling, upsert
from postlake.plans.registry import SQL, query
from postlake.plans.standins import (
    AS_OF, DAYS, INCOMING_SQL, POSTINGS_SQL, STORED_SQL, incoming, plain, postings, stored, table,
)
from postlake.session import shared_folder
from postlake.sources import buckets, landed
from postlake.sources.placed import place_rows

RP = f"WITH {POSTINGS_SQL}"
ALL = f"WITH {POSTINGS_SQL},{STORED_SQL},{INCOMING_SQL}"
CUT = f"TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY"


@query("latest_thread", f"""{RP}
SELECT id, lang, posted_at FROM rp WHERE contains(lower(raw_text), 'who') AND posted_at IS NOT NULL
ORDER BY posted_at DESC, id DESC LIMIT 1""")
def latest_thread(spark, sf):
    threads = postings(spark, sf).filter(F.col("posted_at").isNotNull())
    newest = landed.latest_thread(threads, "raw_text", "posted_at", "id", phrase="who")
    return newest.select("id", "lang", plain("posted_at").alias("posted_at"))


@query("publish_times", """
SELECT o_orderkey, o_orderdate + INTERVAL 30 MINUTE
         - (CASE WHEN o_orderstatus = 'F' THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END) AS posted_at,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS thread_month
FROM orders""")
def publish_times(spark, sf):
    zone = F.when(F.col("o_orderstatus") == "F", "+03:00").when(F.col("o_orderstatus") == "O", "").otherwise("Z")
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:30:00"), zone)
    df = landed.with_posted_at(table(spark, sf, "orders").withColumn("written", written), "written")
    return df.select("o_orderkey", plain("posted_at").alias("posted_at"), "thread_month")


def _cards(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.lit("habr").alias("source"), F.col("doc_id").cast("string").alias("external_id"),
                       F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("title")))
                       .alias("raw_text"))


def _enriched(spark, sf):
    pages = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("external_id"),
        F.concat(F.lit("<p>q\""), "quality", F.lit("</p>")).alias("description_html"))
    return landed.enrich_details(_cards(spark, sf), pages)


@query("enrich_details", """
SELECT CAST(d.doc_id AS VARCHAR) AS external_id,
       '{"id":' || d.doc_id || ',"title":"' || d.lang || '","description_html":'
         || CASE WHEN l.doc_id IS NULL THEN 'null' ELSE '"<p>q\\"' || l.quality || '</p>"' END || '}' AS raw_text
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def enrich_details(spark, sf):
    return _enriched(spark, sf).select("external_id", "raw_text")


@query("missing_details", """
SELECT count(*) AS cards, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing,
       count(*) FILTER (WHERE l.doc_id IS NULL) > count(*) // 10 AS alarm
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_details(spark, sf):
    return landed.missing_details(_enriched(spark, sf))


@query("extract_block", r"""
SELECT page_id,
       NULLIF(trim(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)), '') AS article,
       NULLIF(trim(regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1)), '') AS advert
FROM pages""")
def extract_block(spark, sf):
    pages = landed.extract_block(table(spark, sf, "pages", busy=True), "html", "article", out="article")
    pages = landed.extract_block(pages, "html", "div", "ad", out="advert")
    return pages.select("page_id", "article", "advert")


@query("union_sources", f"{RP} SELECT source, external_id, thread_month FROM rp")
def union_sources(spark, sf):
    rp = postings(spark, sf).select("source", "external_id", "thread_month")
    return landed.union_sources(rp.filter(F.col("source") == s) for s in ("hn", "remotive", "web3", "habr"))


@query("fresh_postings", f"{RP} SELECT id, source, posted_at FROM rp WHERE posted_at >= {CUT}")
def fresh_postings(spark, sf):
    fresh = filters.within_window(postings(spark, sf), AS_OF, DAYS)
    return fresh.select("id", "source", plain("posted_at").alias("posted_at"))


@query("first_cards", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                        ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1""")
def first_cards(spark, sf):
    first = filters.dedupe_cards(table(spark, sf, "lineitem"),
                                 ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"],
                                 ["l_orderkey", "l_linenumber"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("card_funnel", f"""{ALL},
m AS (
  SELECT i.*, c.external_id IS NULL AND i.posted_at >= {CUT} AS fresh
  FROM inc i LEFT JOIN cur c USING (source, external_id)),
f AS (SELECT *, min(CASE WHEN fresh THEN wave END) OVER (PARTITION BY source, external_id) AS first_wave FROM m)
SELECT source, count(*) AS cards, count(*) FILTER (WHERE wave = first_wave) AS fresh,
       count(*) FILTER (WHERE first_wave IS NULL OR wave < first_wave) AS stored_or_aged,
       count(*) FILTER (WHERE wave > first_wave) AS duplicates
FROM f GROUP BY source""")
def card_funnel(spark, sf):
    marked = filters.mark_cards(incoming(spark, sf), stored(spark, sf), AS_OF, ["wave", "id"], DAYS)
    return filters.funnel(marked)


@query("prefilter_routing", f"""{RP}
SELECT id, CASE WHEN trim(raw_text) = '' THEN 'other'
                WHEN source = 'hn' AND (regexp_matches(raw_text, '(?i)^\\s*\\[(flagged|dead)\\]')
                                        OR length(raw_text) < 120) THEN 'other' END AS prefilter
FROM rp""")
def prefilter_routing(spark, sf):
    return filters.route(postings(spark, sf), "raw_text").select("id", "prefilter")


def _work(spark, sf, **options):
    raw = postings(spark, sf).withColumnRenamed("id", "raw_posting_id")
    runs = table(spark, sf, "labels").select(F.col("doc_id").alias("raw_posting_id"),
                                             F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))
    return keys.pending(raw, runs, order=["raw_posting_id"], **options).select("raw_posting_id", "source")


@query("pending_work", f"""{RP}
SELECT id AS raw_posting_id, source FROM rp
WHERE id NOT IN (SELECT doc_id FROM labels) AND source IN ('hn', 'habr')""")
def pending_work(spark, sf):
    return _work(spark, sf, sources=["hn", "habr"])


@query("pending_first", f"""{RP}
SELECT id AS raw_posting_id, source FROM rp
WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY id LIMIT 50""")
def pending_first(spark, sf):
    return _work(spark, sf, sources=[], limit=50, retry_statuses=["error"])


@query("excluded_removed", f"""{RP},
x AS (SELECT rp.*, trim(split_part(split_part(raw_text, '<p>', 1), '|', 1)) AS company FROM rp)
SELECT id FROM x
WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  AND company NOT IN (SELECT company FROM x JOIN labels ON doc_id = id WHERE quality = 0)""")
def excluded_removed(spark, sf):
    rows = postings(spark, sf).withColumn("company", sampling.header_company())
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    bad = rows.join(labels.filter("quality = 0").select("id"), "id").select("company")
    return filters.exclude(rows, labels.filter("toxic = 1").select("id"), bad, "id").select("id")


@query("changed_texts", f"""{ALL}
SELECT i.source, i.external_id, i.wave FROM inc i LEFT JOIN cur c USING (source, external_id)
WHERE i.raw_text IS DISTINCT FROM c.raw_text""")
def changed_texts(spark, sf):
    old = stored(spark, sf).select("source", "external_id", F.col("raw_text").alias("old"))
    rows = incoming(spark, sf).join(old, ["source", "external_id"], "left")
    return rows.filter(upsert.text_changed("old", "raw_text")).select("source", "external_id", "wave")


@query("new_only", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_only(spark, sf):
    return keys.new_only(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]
                         ).select("doc_id", "lang")


@query("missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf):
    return keys.missing_ids(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("fetch_rows", """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def fetch_rows(spark, sf):
    wanted = table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return keys.fetch_rows(table(spark, sf, "documents"), wanted, "doc_id").select("doc_id", "lang", "n_chars")


@query("cascade", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')""")
def cascade(spark, sf):
    kept = table(spark, sf, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return keys.cascade(table(spark, sf, "lineitem"), kept, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _placed(spark, df, key):
    return place_rows(df, f"{shared_folder(spark)}/placed-{uuid.uuid4().hex}", key)


@query("placed_new_only", SQL["new_only"])
def placed_new_only(spark, sf):
    """The same with the stored side lying by its key."""
    known = _placed(spark, table(spark, sf, "labels"), "doc_id")
    return keys.new_only(table(spark, sf, "documents"), known, ["doc_id"]).select("doc_id", "lang")


@query("placed_pending", SQL["pending_work"])
def placed_pending(spark, sf):
    """Postings and runs both lie by the posting."""
    raw = _placed(spark, postings(spark, sf).withColumnRenamed("id", "raw_posting_id"), "raw_posting_id")
    runs = _placed(spark, table(spark, sf, "labels").select(F.col("doc_id").alias("raw_posting_id"), F.lit("ok").alias("status")), "raw_posting_id")
    return keys.pending(raw, runs, ["hn", "habr"]).select("raw_posting_id", "source")


@query("placed_cascade", SQL["cascade"])
def placed_cascade(spark, sf):
    """Roles and postings both lie by the posting, so a purge finds the roles that lost theirs without dealing them anew."""
    lines = _placed(spark, table(spark, sf, "lineitem"), "l_orderkey")
    orders = _placed(spark, table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return keys.cascade(lines, orders.filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'"), "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("key_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS rows, 'duplicate' AS problem
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL
SELECT l_orderkey, NULL, count(*), 'orphan' FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1""")
def key_violations(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return keys.check_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], parents, "o_orderkey")


_SEQ = f"""{ALL},
seq AS (
  SELECT i.*, c.raw_text AS old_text, c.posted_at AS old_at, c.thread_month AS old_month,
         c.external_id IS NOT NULL AS stored,
         coalesce(lag(i.raw_text) OVER (PARTITION BY i.source, i.external_id ORDER BY i.wave), c.raw_text) AS before
  FROM inc i LEFT JOIN cur c USING (source, external_id)
  WHERE i.posted_at IS NOT NULL),
per AS (
  SELECT source, external_id, any_value(stored) AS stored, count(*) AS n,
         count(*) FILTER (WHERE before IS DISTINCT FROM raw_text) AS changed,
         arg_max(raw_text, wave) FILTER (WHERE before IS DISTINCT FROM raw_text) AS raw_text,
         arg_max(posted_at, wave) FILTER (WHERE before IS DISTINCT FROM raw_text) AS posted_at,
         arg_min(thread_month, wave) AS new_month, any_value(old_month) AS old_month
  FROM seq GROUP BY 1, 2)"""


@query("upsert_next", f"""{_SEQ}
SELECT c.* FROM cur c LEFT JOIN per p USING (source, external_id) WHERE coalesce(p.changed, 0) = 0
UNION ALL
SELECT p.source, p.external_id, p.raw_text, CASE WHEN p.stored THEN p.old_month ELSE p.new_month END, p.posted_at,
       CASE WHEN p.stored THEN TIMESTAMP '2024-01-20 12:00:00' ELSE TIMESTAMP '{AS_OF}' END, TIMESTAMP '{AS_OF}'
FROM per p WHERE p.changed > 0""")
def upsert_next(spark, sf):
    """The batch merged into a table in buckets, as a load does it."""
    root = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    buckets.replace_rows(stored(spark, sf), root)
    buckets.merge(spark, root, incoming(spark, sf), "batch", AS_OF, ["wave", "id"], F.col("wave"))
    after = buckets.read_table(spark, root)
    return after.withColumns({c: plain(c) for c in ("posted_at", "ingested_at", "updated_at")})


_STATS_SQL = f"""{_SEQ},
s AS (
  SELECT source, CASE WHEN stored THEN 0 ELSE 1 END AS inserted,
         changed - CASE WHEN stored THEN 0 ELSE 1 END AS updated, n - changed AS unchanged, 0 AS failed FROM per
  UNION ALL
  SELECT source, 0, 0, 0, 1 FROM inc WHERE posted_at IS NULL)
SELECT coalesce(source, 'total') AS source, CAST(sum(inserted) AS BIGINT) AS inserted,
       CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(unchanged) AS BIGINT) AS unchanged,
       CAST(sum(failed) AS BIGINT) AS failed
FROM s GROUP BY ROLLUP (source)"""


@query("load_stats", _STATS_SQL)
def load_stats(spark, sf):
    _, stats = upsert.upsert(stored(spark, sf), incoming(spark, sf), AS_OF, ["wave", "id"], F.col("wave"))
    return stats


@query("batch_versions", """
WITH v AS (
  SELECT l_orderkey, l_returnflag || l_linestatus AS txt, l_shipdate,
         row_number() OVER w AS n,
         lag(l_returnflag || l_linestatus) OVER w AS before
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))
SELECT CAST(l_orderkey AS VARCHAR) AS external_id, count(*) AS rows,
       count(*) FILTER (WHERE before IS NOT NULL AND before <> txt) AS changes,
       arg_min(txt, n) AS first_text, arg_max(txt, n) FILTER (WHERE before IS DISTINCT FROM txt) AS raw_text,
       arg_max(l_shipdate, n) FILTER (WHERE before IS DISTINCT FROM txt) AS posted_at
FROM v GROUP BY l_orderkey""")
def batch_versions(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.lit("hn").alias("source"), F.col("l_orderkey").cast("string").alias("external_id"),
        F.concat("l_returnflag", "l_linestatus").alias("raw_text"), F.lit(None).cast("date").alias("thread_month"),
        F.col("l_shipdate").alias("posted_at"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "posted_at"]
    batch = upsert.collapse_batch(rows, order, F.expr("l_linenumber div 2"))
    return batch.select("external_id", "rows", "changes", "first_text", "raw_text", "posted_at")


@query("purge_preview", f"""{RP}
SELECT source, count(*) AS total, count(*) FILTER (WHERE source = 'web3') AS cut_source,
       count(*) FILTER (WHERE posted_at < {CUT}) AS expired,
       count(*) FILTER (WHERE source = 'web3' OR coalesce(posted_at < {CUT}, FALSE)) AS going,
       count(*) FILTER (WHERE NOT (source = 'web3' OR coalesce(posted_at < {CUT}, FALSE))) AS keeping
FROM rp GROUP BY source""")
def purge_preview(spark, sf):
    return retention.purge_preview(postings(spark, sf), AS_OF, ["web3"], DAYS)


@query("purge_survivors", f"""{RP}
SELECT id, source FROM rp WHERE source <> 'web3' AND coalesce(posted_at >= {CUT}, TRUE)""")
def purge_survivors(spark, sf):
    kept, _ = retention.purge(postings(spark, sf), AS_OF, ["web3"], DAYS, apply=True, dataset_role="live")
    return kept.select("id", "source")


@query("backfill_times", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN ts END AS posted_at FROM events""")
def backfill_times(spark, sf):
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events = table(spark, sf, "events")
    source = F.when(F.col("event_type") == "view", "adzuna").when(F.col("event_type") == "click", "remotive"
                                                                  ).otherwise("hn")
    body = F.to_json(F.struct(F.col("props"), F.concat(written, F.lit("Z")).alias("created"),
                              F.concat(written, F.lit("+05:00")).alias("publication_date")))
    rows = events.select("event_id", source.alias("source"), body.alias("raw_text"),
                         F.lit(None).cast("timestamp").alias("posted_at"))
    return retention.backfill_posted_at(rows).select("event_id", plain("posted_at").alias("posted_at"))


def _suspect(spark, sf):
    month = (F.when(F.col("lang") == "de", F.lit(None)).when(F.col("lang") == "fr", F.to_date("posted_at"))
             .otherwise(F.col("thread_month")))
    return postings(spark, sf).withColumn("thread_month", month)


@query("check_raw", f"""{RP},
x AS (SELECT *, CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN CAST(posted_at AS DATE) ELSE thread_month END AS month
      FROM rp)
SELECT id, concat_ws(',', CASE WHEN source = 'habr' THEN 'source_allowed' END,
         CASE WHEN trim(raw_text, ' ') = '' THEN 'text_not_blank' END,
         CASE WHEN day(month) <> 1 THEN 'month_is_first_day' END,
         CASE WHEN source = 'hn' AND month IS NULL THEN 'forum_has_month' END,
         CASE WHEN posted_at IS NULL THEN 'posted_at_set' END) AS reason
FROM x""")
def check_raw(spark, sf):
    checked = quality.check_raw(_suspect(spark, sf), ["hn", "remotive", "web3"])
    return checked.select("id", F.array_join("reason", ",").alias("reason"))


@query("check_sources", f"{RP} SELECT source, count(*) AS rows FROM rp WHERE source NOT IN ('hn', 'habr') GROUP BY 1")
def check_sources(spark, sf):
    return quality.check_sources(postings(spark, sf), ["hn", "habr"])


@query("source_health", f"""{RP}
SELECT source, count(*) AS rows, count(*) FILTER (WHERE lang IN ('de', 'fr')) AS missing,
       count(*) FILTER (WHERE lang IN ('de', 'fr')) > count(*) // 10 AS alarm
FROM rp GROUP BY source""")
def source_health(spark, sf):
    rows = postings(spark, sf).withColumn(
        "description", F.when(~F.col("lang").isin("de", "fr"), F.col("raw_text")))
    return quality.health(rows, "description")


@query("first_per_company", f"""{RP}
SELECT trim(split_part(split_part(raw_text, '<p>', 1), '|', 1), ' ') AS company, external_id, source
FROM rp QUALIFY row_number() OVER (PARTITION BY company ORDER BY external_id) = 1""")
def first_per_company(spark, sf):
    return sampling.first_per_company(postings(spark, sf)).select("company", "external_id", "source")


QUOTAS = vocab.GOLD_QUOTAS


@query("stratified_sample", f"""{RP}
SELECT source, external_id FROM rp
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('20260813:' || external_id), external_id)
        <= CASE source WHEN 'hn' THEN 16 WHEN 'habr' THEN 10 WHEN 'web3' THEN 8 ELSE 6 END""")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(postings(spark, sf), QUOTAS).select("source", "external_id")


@query("gold_candidates", f"""{RP},
hn AS (SELECT *, trim(split_part(split_part(raw_text, '<p>', 1), '|', 1), ' ') AS company FROM rp WHERE source = 'hn'),
pool AS (
  SELECT source, external_id FROM hn
  WHERE external_id <> '12' AND company NOT IN (SELECT company FROM hn WHERE external_id IN ('4', '8'))
  QUALIFY row_number() OVER (PARTITION BY company ORDER BY external_id) = 1
  UNION ALL SELECT source, external_id FROM rp WHERE source <> 'hn'),
drawn AS (
  SELECT source, external_id FROM pool
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('20260813:' || external_id), external_id)
          <= CASE source WHEN 'hn' THEN 14 WHEN 'habr' THEN 10 WHEN 'web3' THEN 8 ELSE 6 END
  UNION ALL SELECT source, external_id FROM hn WHERE external_id IN ('4', '8'))
SELECT source, external_id, raw_text, posted_at FROM drawn JOIN rp USING (source, external_id)""")
def gold_candidates(spark, sf):
    gold = sampling.build_gold(postings(spark, sf), QUOTAS, always=["4", "8"], excluded=["12"],
                               dataset_role="eval")
    return gold.withColumn("posted_at", plain("posted_at"))
