"""Queries over replies, roles and runs."""

import uuid
from functools import partial

from pyspark.sql import functions as F

from postlake.operators import analytics, extraction, quality, replies, roles
from postlake.operators.adapt import adapt_boards
from postlake.operators.scorer import score
from postlake.operators.totals import RunningTotals, Totals, run_totals
from postlake.plans.cleaning import board_rows
from postlake.plans.registry import query
from postlake.plans.standins import (
    AS_OF, POSTINGS_SQL, REPLIES_SQL, ROLES_SQL, VOCABULARIES, plain, postings, role_rows, stand_in_model, table,
)
from postlake.plans.standins import replies as stand_in_replies
from postlake.schemas import ROLES, RUNS
from postlake.session import cut_lineage, shared_folder
from postlake.streaming import jobs

REP = f"WITH {REPLIES_SQL}"
VX = f"WITH {ROLES_SQL}"
# Per reply, after all checks: what the two levels hold.
_LEVELS = f"""{REP},
lv AS (
  SELECT *, readable AND doc_type = 'posting' AS posting, 1000.0::DOUBLE * floor(price / 1000) AS amount FROM chk)"""


def checked(spark, sf, postings=None):
    """Replies, all or those to some postings, after the checks."""
    given = stand_in_replies(spark, sf)
    return replies.validate_replies(given if postings is None else extraction.replies_to(postings, given))


@query("validated_replies", f"""{_LEVELS}
SELECT raw_posting_id, reasons, CASE WHEN readable THEN doc_type END AS doc_type,
       CASE WHEN posting THEN company END AS company,
       CASE WHEN posting AND segment <> 'HOUSEHOLD' THEN segment END AS location,
       CASE WHEN posting THEN '$' || CAST(floor(price / 1000) AS BIGINT) || 'k' END AS salary_min,
       CASE WHEN posting THEN 'yearly' END AS salary_period, CASE WHEN posting THEN 'PostgreSQL,remote' END AS stack,
       CASE WHEN posting THEN CASE status WHEN 'O' THEN 2 WHEN 'F' THEN 1 ELSE 0 END ELSE 0 END AS roles,
       CASE WHEN posting AND status = 'O' THEN 'Role ' || priority END AS first_title,
       CASE WHEN NOT readable THEN 0 ELSE CAST(quoted_company AS INT) + CAST(quoted_salary AS INT)
            + CAST(odd_quote AS INT) END AS quotes
FROM lv""")
def validated_replies(spark, sf):
    first = F.try_element_at("roles", F.lit(1))
    return checked(spark, sf).select(
        "raw_posting_id", F.array_join("reasons", "; ").alias("reasons"), "doc_type", "company", "location",
        "salary_min", "salary_period", F.array_join("stack", ",").alias("stack"), F.size("roles").alias("roles"),
        first["title"].alias("first_title"), F.size(F.map_keys("source_quotes")).alias("quotes"))


@query("problem_keys", f"""{REP}
SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM chk WHERE reasons <> '')
GROUP BY reason""")
def problem_keys(spark, sf):
    from postlake.operators.normalise import quarantine, reason_counts

    _, bad = quarantine(checked(spark, sf).withColumnRenamed("reasons", "reason"))
    return reason_counts(bad)


@query("fan_out", f"""{_LEVELS},
r AS (
  SELECT *, unnest(CASE WHEN NOT posting THEN [] WHEN status = 'O' THEN [0, 1] ELSE [0] END) AS role_index,
         status = 'O' AND role_index = 0 AS lead FROM lv WHERE reasons = '')
SELECT raw_posting_id, role_index, company, CASE WHEN lead THEN 'Role ' || priority END AS title,
       CASE WHEN segment <> 'HOUSEHOLD' THEN segment END AS location,
       CASE WHEN lead THEN 'senior' WHEN status <> 'P' THEN 'junior' ELSE 'unknown' END AS seniority,
       CASE WHEN lead THEN 'remote' ELSE 'unknown' END AS remote_policy, 'unknown' AS employment_type,
       CASE WHEN lead THEN 'postgres,go' ELSE 'postgres,kubernetes,go' END AS stack,
       CAST(round_even(amount / 12, 0) AS BIGINT) AS salary_min,
       CASE WHEN lead THEN 75000 END AS salary_max, 'USD' AS salary_currency,
       CASE WHEN lead THEN 'company,salary,title' ELSE 'company,salary' END AS quotes,
       CASE WHEN lead THEN '900k' ELSE '$ k' END AS salary_quote
FROM r""")
def fan_out(spark, sf):
    good = checked(spark, sf).filter(F.size("reasons") == 0)
    return roles.fan_out(good).select(
        "raw_posting_id", "role_index", "company", "title", "location", "seniority", "remote_policy",
        "employment_type", F.array_join("stack", ",").alias("stack"), "salary_min", "salary_max",
        "salary_currency", F.array_join(F.array_sort(F.map_keys("source_quotes")), ",").alias("quotes"),
        F.try_element_at("source_quotes", F.lit("salary")).alias("salary_quote"))


def stored_roles(spark, sf, with_index=False):
    return roles.fill_down(role_rows(spark, sf, with_index), VOCABULARIES)


@query("fill_down", f"""{VX}
SELECT raw_posting_id, role_index, company, title, location, seniority, remote_policy, 'full-time' AS employment_type,
       array_to_string(stack, ',') AS stack, salary_min, salary_currency, company || '|' || title AS quotes
FROM vx""")
def fill_down(spark, sf):
    return stored_roles(spark, sf, True).select(
        "raw_posting_id", "role_index", "company", "title", "location", "seniority", "remote_policy",
        "employment_type", F.array_join("stack", ",").alias("stack"), "salary_min", "salary_currency",
        F.concat_ws("|", F.try_element_at("source_quotes", F.lit("company")),
                    F.try_element_at("source_quotes", F.lit("title"))).alias("quotes"))


@query("check_roles", f"""{_LEVELS},
r AS (SELECT raw_posting_id, CAST(round_even(amount / 12, 0) AS BIGINT) AS low FROM lv
      WHERE reasons = '' AND posting AND status = 'O')
SELECT raw_posting_id, CASE WHEN 75000 < low + 60000 THEN 'band_ordered' ELSE '' END AS reason FROM r""")
def check_roles(spark, sf):
    rows = roles.fan_out(checked(spark, sf).filter(F.size("reasons") == 0)).filter("salary_max IS NOT NULL")
    return quality.check_roles(rows.withColumn("salary_min", F.col("salary_min") + 60000)).select(
        "raw_posting_id", F.array_join("reason", ",").alias("reason"))


@query("embed_text", f"""{VX}
SELECT raw_posting_id, role_index, concat_ws(chr(10), title, company, location, NULLIF(seniority, 'unknown'),
         NULLIF(remote_policy, 'unknown'), 'full-time', NULLIF(array_to_string(stack, ', '), '')) AS embed_text
FROM vx""")
def embed_text(spark, sf):
    return roles.embed_text(stored_roles(spark, sf, True)).select("raw_posting_id", "role_index", "embed_text")


_ATTEMPTS = f"""
WITH {POSTINGS_SQL},{REPLIES_SQL},
att AS (
  SELECT p.id AS raw_posting_id, r.raw_posting_id IS NOT NULL AS answered,
         CASE WHEN p.source = 'web3' AND p.lang = 'fr' THEN 'text is not JSON'
              WHEN p.source = 'habr' AND p.n_chars < 60 THEN 'salary is not a number' END AS adapter_error,
         p.source = 'hn' AND length(regexp_replace(p.raw_text, '^\\s+|\\s+$', '', 'g')) < 120 AS skipped,
         r.reasons, r.doc_type, r.status
  FROM rp p LEFT JOIN chk r ON r.raw_posting_id = p.id),
att2 AS (
  SELECT raw_posting_id,
         CASE WHEN adapter_error IS NOT NULL THEN 'error' WHEN skipped THEN 'ok' WHEN reasons <> '' THEN 'invalid'
              ELSE 'ok' END AS status,
         CASE WHEN adapter_error IS NOT NULL THEN 'adapter' WHEN skipped THEN 'prefilter' ELSE 'stand-in' END AS model,
         CASE WHEN adapter_error IS NOT NULL THEN adapter_error WHEN skipped THEN NULL
              WHEN reasons <> '' THEN left(reasons, 500) END AS error,
         CASE WHEN adapter_error IS NOT NULL THEN NULL WHEN skipped THEN 'other' WHEN reasons = '' THEN doc_type END AS doc_type,
         CASE WHEN adapter_error IS NULL AND NOT skipped AND reasons = '' AND doc_type = 'posting'
              THEN CASE WHEN status = 'O' THEN 2 ELSE 1 END ELSE 0 END AS role_count
  FROM att WHERE answered OR skipped OR adapter_error IS NOT NULL)"""


def outcomes(spark, sf):
    raw = board_rows(spark, sf).withColumnRenamed("id", "raw_posting_id")
    return extraction.outcomes_of(adapt_boards(raw), checked(spark, sf, raw))


@query("outcomes", f"{_ATTEMPTS} SELECT raw_posting_id, status, model, error, doc_type, role_count FROM att2")
def classified(spark, sf):
    return outcomes(spark, sf).select("raw_posting_id", "status", "model", "error", "doc_type", "role_count")


def _old_runs(spark, sf):
    """Runs of an earlier pass, one per labelled document."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("raw_posting_id"), F.when(F.col("toxic") == 1, "invalid").otherwise("ok").alias("status"),
        F.lit("posting").alias("doc_type"), F.lit(1).alias("role_count"), F.lit("old").alias("model"),
        F.lit(None).cast("string").alias("error"), F.lit("2024-01-01").cast("timestamp").alias("extracted_at"))


def _old_roles(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("string")
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("raw_posting_id"), F.lit(0).alias("role_index"), F.lit("old").alias("company"),
        none.alias("title"), none.alias("location"), F.lit("unknown").alias("seniority"),
        F.lit("unknown").alias("remote_policy"), F.lit("unknown").alias("employment_type"),
        F.array().cast("array<string>").alias("stack"), F.lit(None).cast("int").alias("salary_min"),
        F.lit(None).cast("int").alias("salary_max"), none.alias("salary_currency"),
        F.create_map().cast("map<string,string>").alias("source_quotes"), at.alias("created_at"), at.alias("updated_at"))


def _persisted(spark, sf, broken=False):
    """(roles, runs, rejected roles) after the replies; with ``broken`` some salary bands are upside down."""
    raw = board_rows(spark, sf).withColumnRenamed("id", "raw_posting_id")
    read = checked(spark, sf, raw)
    if broken:
        read = read.withColumn("salary_min", F.when(F.col("company").endswith("7"), "$9999k").otherwise(F.col("salary_min")))
    outcomes, good, bad = extraction.settle(adapt_boards(raw), read)
    return *roles.persist(_old_roles(spark, sf), _old_runs(spark, sf), good, outcomes, AS_OF), bad


@query("persisted_roles", f"""{_ATTEMPTS}
SELECT doc_id AS raw_posting_id, 0 AS role_index, 'old' AS company, TIMESTAMP '2024-01-01' AS created_at FROM labels
WHERE doc_id NOT IN (SELECT raw_posting_id FROM att2 WHERE status = 'ok')
UNION ALL
SELECT raw_posting_id, unnest(range(role_count)), company, TIMESTAMP '{AS_OF}'
FROM att2 JOIN (SELECT raw_posting_id, company FROM rep) USING (raw_posting_id) WHERE role_count > 0""")
def persisted_roles(spark, sf):
    after, _, _ = _persisted(spark, sf)
    return after.select("raw_posting_id", "role_index", "company", plain("created_at").alias("created_at"))


@query("persisted_runs", f"""{_ATTEMPTS}
SELECT doc_id AS raw_posting_id, CASE WHEN toxic = 1 THEN 'invalid' ELSE 'ok' END AS status, 'posting' AS doc_type,
       1 AS role_count, 'old' AS model, TIMESTAMP '2024-01-01' AS extracted_at
FROM labels WHERE doc_id NOT IN (SELECT raw_posting_id FROM att2)
UNION ALL
SELECT raw_posting_id, status, doc_type, role_count, model, TIMESTAMP '{AS_OF}' FROM att2""")
def persisted_runs(spark, sf):
    _, after, _ = _persisted(spark, sf)
    return after.select("raw_posting_id", "status", "doc_type", "role_count", "model",
                        plain("extracted_at").alias("extracted_at"))


@query("role_count_mismatch", f"""{_ATTEMPTS}
SELECT raw_posting_id, status, role_count, 1 AS stored FROM att2
WHERE status <> 'ok' AND raw_posting_id IN (SELECT doc_id FROM labels)""")
def role_count_mismatch(spark, sf):
    after_roles, after_runs, _ = _persisted(spark, sf)
    return quality.role_count_mismatch(after_runs, after_roles)


_BROKEN = f"""{_ATTEMPTS},
broken AS (SELECT raw_posting_id FROM att2 JOIN (SELECT raw_posting_id, company, status AS order_status FROM rep) USING (raw_posting_id)
           WHERE role_count > 0 AND order_status = 'O' AND company LIKE '%7')"""


@query("persisted_with_bad_roles", f"""{_BROKEN}
SELECT raw_posting_id, CASE WHEN b THEN 'invalid' ELSE status END AS status, CASE WHEN b THEN NULL ELSE doc_type END AS doc_type,
       CASE WHEN b THEN 0 ELSE role_count END AS role_count, CASE WHEN b THEN 'role 0: band_ordered' ELSE error END AS error,
       CAST(CASE WHEN b OR status <> 'ok' THEN old ELSE role_count END AS BIGINT) AS stored
FROM (SELECT *, raw_posting_id IN (SELECT raw_posting_id FROM broken) AS b,
             CAST(raw_posting_id IN (SELECT doc_id FROM labels) AS INT) AS old FROM att2)
UNION ALL
SELECT doc_id, CASE WHEN toxic = 1 THEN 'invalid' ELSE 'ok' END, 'posting', 1, NULL, 1
FROM labels WHERE doc_id NOT IN (SELECT raw_posting_id FROM att2)""")
def persisted_with_bad_roles(spark, sf):
    after, runs, _ = _persisted(spark, sf, broken=True)
    stored = after.groupBy("raw_posting_id").agg(F.count("*").alias("stored"))
    return runs.join(stored, "raw_posting_id", "left").select(
        "raw_posting_id", "status", "doc_type", "role_count", "error", F.coalesce("stored", F.lit(0)).alias("stored"))


@query("rejected_roles", f"""{_BROKEN}
SELECT raw_posting_id, unnest([0, 1]) AS role_index, unnest(['band_ordered', '']) AS reason FROM broken""")
def rejected_roles(spark, sf):
    return _persisted(spark, sf, broken=True)[2].select(
        "raw_posting_id", "role_index", F.array_join("reason", ",").alias("reason"))


@query("coverage", f"{_ATTEMPTS} SELECT status, doc_type, count(*) AS runs FROM att2 GROUP BY ALL")
def coverage(spark, sf):
    return analytics.coverage(outcomes(spark, sf))


@query("error_summary", f"{_ATTEMPTS} SELECT model, error, count(*) AS runs FROM att2 WHERE status <> 'ok' GROUP BY ALL")
def error_summary(spark, sf):
    return analytics.error_summary(outcomes(spark, sf))


@query("run_stats", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS ok, count(*) FILTER (WHERE o_orderstatus = 'O') AS invalid,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS error, CAST(sum(length(o_orderpriority)) AS BIGINT) AS roles,
       CAST(sum(floor(o_totalprice)) AS BIGINT) AS tokens_in, CAST(sum(o_custkey) AS BIGINT) AS tokens_out,
       count(*) AS requests
FROM orders""")
def run_stats(spark, sf):
    status = F.col("o_orderstatus")
    runs = table(spark, sf, "orders").select(
        F.when(status == "F", "ok").when(status == "O", "invalid").otherwise("error").alias("status"),
        F.length("o_orderpriority").alias("role_count"), F.floor("o_totalprice").alias("tokens_in"),
        F.col("o_custkey").alias("tokens_out"), F.lit(1).alias("requests"))
    return analytics.run_stats(runs)


@query("scored_replies", f"""
WITH {POSTINGS_SQL}
SELECT id AS raw_posting_id, 'stand-in' AS model, CASE WHEN n % 11 = 0 THEN 'ValueError: cannot read this' END AS error,
       CASE WHEN n % 11 <> 0 AND n % 5 = 0 THEN 'reply is not a JSON object' ELSE '' END AS reasons,
       CASE WHEN n % 11 <> 0 AND n % 5 <> 0 THEN CASE WHEN n % 3 = 0 THEN 'other' ELSE 'posting' END END AS doc_type,
       CASE WHEN n % 11 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 THEN 'Company ' || n END AS company,
       CASE WHEN n % 11 <> 0 THEN n ELSE 0 END AS tokens_in, CASE WHEN n % 11 <> 0 THEN n % 13 ELSE 0 END AS tokens_out
FROM (SELECT id, length(coalesce(raw_text, '')) AS n FROM rp)""")
def scored_replies(spark, sf):
    """Every posting put to a model, whose calls some of the texts break, and what it says checked."""
    asked = postings(spark, sf).withColumnRenamed("id", "raw_posting_id")
    scored = cut_lineage(score(asked, partial(stand_in_model, raises=True), "stand-in", text="raw_text", batch_bytes=1 << 16))
    return replies.validate_replies(scored).select(
        "raw_posting_id", "model", "error", F.array_join("reasons", "; ").alias("reasons"), "doc_type", "company", "tokens_in", "tokens_out")


_TOTALS = f"""{_ATTEMPTS},
told AS (SELECT *, length('posting ' || raw_posting_id) AS n, adapter_error IS NULL AND NOT skipped AS asked FROM att)
SELECT count(*) FILTER (WHERE adapter_error IS NULL AND (skipped OR n % 11 <> 0 AND n % 5 <> 0)) AS ok,
       count(*) FILTER (WHERE asked AND n % 11 <> 0 AND n % 5 = 0) AS invalid,
       count(*) FILTER (WHERE adapter_error IS NOT NULL OR asked AND n % 11 = 0) AS error,
       count(*) FILTER (WHERE asked AND n % 11 <> 0 AND n % 5 <> 0 AND n % 3 <> 0) AS roles,
       CAST(coalesce(sum(n) FILTER (WHERE asked AND n % 11 <> 0), 0) AS BIGINT) AS tokens_in,
       CAST(coalesce(sum(n % 13) FILTER (WHERE asked AND n % 11 <> 0), 0) AS BIGINT) AS tokens_out,
       CAST(coalesce(sum(CASE WHEN n % 11 = 0 THEN 3 ELSE 1 END) FILTER (WHERE asked), 0) AS BIGINT) AS requests
FROM told"""
_TOTALS_SCHEMA = "ok long, invalid long, error long, roles long, tokens_in long, tokens_out long, requests long"


def _ask(adapted):
    named = adapted.withColumn("text", F.concat(F.lit("posting "), "raw_posting_id"))
    return cut_lineage(score(named, stand_in_model, "stand-in"))


@query("observed_totals", _TOTALS)
def observed_totals(spark, sf):
    """Totals of a run in which a model is asked, gathered by the write of its outcomes."""
    raw = board_rows(spark, sf).withColumnRenamed("id", "raw_posting_id")
    old = spark.createDataFrame([], RUNS)
    totals = Totals(run_totals())
    extraction.process(raw, old, spark.createDataFrame([], ROLES), _ask, AS_OF, totals=totals, order=["raw_posting_id"])
    return spark.createDataFrame([totals.get()], _TOTALS_SCHEMA)


@query("running_totals", _TOTALS)
def running_totals(spark, sf):
    """The same of a stream in several batches, summed up while it runs."""
    folder = f"{shared_folder(spark)}/asked-{uuid.uuid4().hex}"
    raw = board_rows(spark, sf).withColumnRenamed("id", "raw_posting_id").select("raw_posting_id", "source", "external_id", "raw_text")
    raw.repartition(3).write.parquet(f"{folder}/postings")
    told = RunningTotals("run")
    stream = jobs.read_rows(spark, f"{folder}/postings", raw.schema, 1)
    jobs.stream_outcomes(stream, _ask, folder, f"{folder}/state", told).awaitTermination()
    return spark.createDataFrame([told.sums], _TOTALS_SCHEMA)


@query("grounding", """
WITH q AS (
  SELECT d.text, unnest([{'field': 'passage', 'quote': b.text}, {'field': 'language', 'quote': lang},
                         {'field': 'source', 'quote': source}]) AS u
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT u.field AS field, count(*) AS quotes, count(*) FILTER (WHERE contains(text, u.quote)) AS found,
       count(*) FILTER (WHERE contains(text, u.quote)) / count(*) AS rate
FROM q GROUP BY u.field""")
def grounding(spark, sf):
    """Every document quotes its language, its source and a passage of the benchmark, which a few hold."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    n = table(spark, sf, "benchmark").agg(F.count("*")).scalar()
    docs = (table(spark, sf, "documents").withColumn("item_id", F.col("doc_id") % n).join(items, "item_id")
            .withColumn("source_quotes", F.create_map(
                F.lit("passage"), F.col("passage"), F.lit("language"), F.col("lang"), F.lit("source"), F.col("source"))))
    return replies.grounding(docs)
