"""Postings, batches, roles and replies derived from the given tables.

Every stand-in covers whole tables. ``*_SQL`` are the same derivations as common
table expressions for the SQL side.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from postlake.functions.times import instant, utc_month
from postlake.operators.scorer import Reply
from postlake.session import configure

AS_OF = "2024-01-31"
DAYS = 14
STORED_UNTIL = "2024-01-20"


def table(spark: SparkSession, sf: str, name: str, busy=False) -> DataFrame:
    """A given table; ``busy`` ones are spread over the cores when they are one small file."""
    df = configure(spark).read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if busy else df


def spread(df: DataFrame) -> DataFrame:
    """One partition per core for a stand-in whose small file is one partition, so that its costly rows use all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def plain(c) -> Column:
    """Zone-free form of an instant, to compare with engines without one."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


# --- raw postings: a document is a posting, its latest event the time it was posted ---

def postings(spark, sf, busy=False) -> DataFrame:
    docs = table(spark, sf, "documents", busy)
    seen = (table(spark, sf, "events").groupBy(F.expr("event_id div 10").alias("doc_id"))
            .agg(F.max("ts").cast("timestamp").alias("posted_at")))
    source = (F.when(F.col("doc_id") % 4 == 0, "hn").when(F.col("doc_id") % 4 == 1, "remotive")
              .when(F.col("doc_id") % 4 == 2, "web3").otherwise("habr"))
    return docs.join(seen, "doc_id", "left").select(
        F.col("doc_id").alias("id"), source.alias("source"),
        F.col("doc_id").cast("string").alias("external_id"), F.col("text").alias("raw_text"),
        utc_month("posted_at").alias("thread_month"), "posted_at", "lang", "n_chars")


POSTINGS_SQL = """
rp AS (
  SELECT d.doc_id AS id,
         CASE d.doc_id % 4 WHEN 0 THEN 'hn' WHEN 1 THEN 'remotive' WHEN 2 THEN 'web3' ELSE 'habr' END AS source,
         CAST(d.doc_id AS VARCHAR) AS external_id, d.text AS raw_text,
         CAST(date_trunc('month', e.ts) AS DATE) AS thread_month, e.ts AS posted_at, d.lang, d.n_chars
  FROM documents d
  LEFT JOIN (SELECT event_id // 10 AS doc_id, max(ts) AS ts FROM events GROUP BY 1) e USING (doc_id))"""


# --- stored table and incoming batch ---

def stored(spark, sf) -> DataFrame:
    """Postings of an earlier load."""
    at = instant("2024-01-20T12:00:00")
    return postings(spark, sf).filter(F.col("posted_at") < instant(STORED_UNTIL)).select(
        "source", "external_id", "raw_text", "thread_month", "posted_at",
        at.alias("ingested_at"), at.alias("updated_at"))


STORED_SQL = f"""
cur AS (
  SELECT source, external_id, raw_text, thread_month, posted_at,
         TIMESTAMP '2024-01-20 12:00:00' AS ingested_at, TIMESTAMP '2024-01-20 12:00:00' AS updated_at
  FROM rp WHERE posted_at < TIMESTAMP '{STORED_UNTIL}')"""


def incoming(spark, sf) -> DataFrame:
    """All postings, English ones edited; then labelled ones once more, good ones edited again."""
    edited = F.when(F.col("lang") == "en", F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text"))
    first = postings(spark, sf).withColumn("raw_text", edited).withColumn("wave", F.lit(1))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    again = (first.join(labels, "id")
             .withColumn("raw_text", F.when(F.col("quality") == 1, F.concat("raw_text", F.lit("?")))
                         .otherwise(F.col("raw_text")))
             .withColumn("posted_at", F.col("posted_at") + F.expr("INTERVAL 1 HOUR"))
             .withColumn("wave", F.lit(2)).drop("quality"))
    return first.unionByName(again)


INCOMING_SQL = """
inc AS (
  SELECT id, source, external_id, CASE WHEN lang = 'en' THEN raw_text || '!' ELSE raw_text END AS raw_text,
         thread_month, posted_at, lang, 1 AS wave FROM rp
  UNION ALL
  SELECT id, source, external_id,
         (CASE WHEN lang = 'en' THEN raw_text || '!' ELSE raw_text END) || (CASE WHEN quality = 1 THEN '?' ELSE '' END),
         thread_month, posted_at + INTERVAL 1 HOUR, lang, 2
  FROM rp JOIN labels ON labels.doc_id = rp.id)"""


# --- roles: an order is a posting, its lines are the roles ---

VOCABULARIES = {
    "seniority": {"1-urgent": "senior", "2-high": "mid", "3-medium": "junior"},
    "remote": {"r": "remote", "a": "onsite", "hybrid": "hybrid"},
    "aliases": {"economy": "eco", "5-low": "low"},
    "stoplist": ("3-medium", "small"),
}


def role_rows(spark, sf, with_index=False) -> DataFrame:
    """Posting-level columns plus a struct ``role``, the input of ``fill_down``."""
    lines = table(spark, sf, "lineitem", busy=not with_index)
    if with_index:
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
        lines = lines.withColumn("role_index", F.row_number().over(w) - 1)
    orders, part, customer = (table(spark, sf, t) for t in ("orders", "part", "customer"))

    def dollars(c):
        return F.concat(F.lit("$"), F.floor(c).cast("string"), F.lit("k"))

    period = (F.when(F.col("l_returnflag") == "R", "yearly").when(F.col("l_returnflag") == "A", "hr")
              .otherwise("week"))
    role = F.struct(
        F.col("p_name").alias("title"), F.col("o_orderpriority").alias("seniority"),
        F.array(F.lower("p_type")).alias("stack"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("remote_policy"),
        F.lit(None).cast("string").alias("employment_type"),
        F.when(F.col("l_linenumber") % 3 == 0, dollars(F.col("l_extendedprice") / 100)).alias("salary_min"),
        F.lit(None).cast("string").alias("salary_max"), period.alias("salary_period"),
        F.lit(None).cast("string").alias("salary_currency"),
        F.create_map(F.lit("title"), F.col("p_name")).alias("source_quotes"))
    index = ["role_index"] if with_index else []
    # Customers meet the orders before these meet their lines, so that lines are exchanged for their parts only.
    bought = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    return (lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("p_partkey") == F.col("l_partkey"))
            .select(F.col("o_orderkey").alias("raw_posting_id"), *index, F.col("c_name").alias("company"),
                    F.col("c_mktsegment").alias("location"), F.lit("Hybrid").alias("remote_policy"),
                    F.lit("full_time").alias("employment_type"), F.array("o_orderpriority").alias("stack"),
                    dollars(F.col("o_totalprice") / 1000).alias("salary_min"),
                    F.lit(None).cast("string").alias("salary_max"),
                    F.lit(None).cast("string").alias("salary_period"), F.lit("$").alias("salary_currency"),
                    F.create_map(F.lit("company"), F.col("c_name"), F.lit("title"), F.lit("?"))
                    .alias("source_quotes"),
                    role.alias("role"), "o_orderdate"))


def stand_in_model(raises=False):
    """A model that goes by the length of a text, and some texts it cannot read: with ``raises`` they break its whole call."""
    def one(text):
        n = len(text)
        if n % 11 == 0:
            if raises:
                raise ValueError("cannot read this")
            return ValueError("cannot read this")
        posting = {"doc_type": "posting", "company": f"Company {n}", "source_quotes": {"company": f"Company {n}"}}
        said = "no JSON" if n % 5 == 0 else json.dumps({"doc_type": "other"} if n % 3 == 0 else posting)
        return Reply(said, n, n % 13)

    return lambda texts: [one(t) for t in texts]


ROLES_SQL = """
vx AS (
  SELECT o.o_orderkey AS raw_posting_id, l.rn - 1 AS role_index, c.c_name AS company, p.p_name AS title,
         c.c_mktsegment AS location, o.o_orderdate AS posted_at,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid'
              WHEN '3-MEDIUM' THEN 'junior' ELSE 'unknown' END AS seniority,
         CASE WHEN l.l_linestatus <> 'O' THEN 'hybrid' WHEN l.l_returnflag = 'R' THEN 'remote'
              WHEN l.l_returnflag = 'A' THEN 'onsite' ELSE 'unknown' END AS remote_policy,
         list_filter([CASE o.o_orderpriority WHEN '3-MEDIUM' THEN NULL WHEN '5-LOW' THEN 'low'
                           ELSE lower(o.o_orderpriority) END,
                      CASE p.p_type WHEN 'SMALL' THEN NULL WHEN 'ECONOMY' THEN 'eco'
                           ELSE lower(p.p_type) END], lambda x: x IS NOT NULL) AS stack,
         CAST(round_even(CASE l.l_returnflag WHEN 'R' THEN amount / 12 WHEN 'A' THEN amount * 173.33::DOUBLE END, 0)
              AS BIGINT) AS salary_min,
         CASE WHEN l.l_returnflag IN ('R', 'A') THEN 'USD' END AS salary_currency
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN customer c ON c.c_custkey = o.o_custkey,
  LATERAL (SELECT 1000.0::DOUBLE * CAST(CASE WHEN l.l_linenumber % 3 = 0 THEN floor(l.l_extendedprice / 100)
                                     ELSE floor(o.o_totalprice / 1000) END AS DOUBLE) AS amount))"""


# --- replies: an order is a posting that was read, with the flaws replies have ---

def replies(spark, sf) -> DataFrame:
    orders, customer = table(spark, sf, "orders", busy=True), table(spark, sf, "customer")
    x = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    segment, status, price = F.col("c_mktsegment"), F.col("o_orderstatus"), F.col("o_totalprice")
    quotes = F.map_filter(F.create_map(
        F.lit("company"), F.when(F.col("c_acctbal") > 0, F.col("c_name")),
        F.lit("salary"), F.when(price > 50000, F.lit("$ k")),
        F.lit("wage"), F.when((segment == "MACHINERY") & (price > 400000), F.lit("$"))),
        lambda _, v: v.isNotNull())
    amount = F.concat(F.lit("$"), F.floor(price / 1000).cast("string"), F.lit("k"))
    title = F.concat(F.lit(" Role "), F.col("o_orderpriority"))
    lead = F.struct(
        title.alias("title"), F.lit("Senior").alias("seniority"), F.array(F.lit("Golang")).alias("stack"),
        F.lit("Worldwide").alias("remote_policy"), F.lit("900k").alias("salary_max"),
        F.lit(None).cast("string").alias("salary_period"),
        F.create_map(F.lit("title"), title, F.lit("salary"), F.lit("900k")).alias("source_quotes"))
    second = F.struct(
        F.lit("n/a").alias("title"), F.lit("jr").alias("seniority"),
        F.array(F.lit("K8s"), F.lit("go")).alias("stack"), F.lit(None).cast("string").alias("remote_policy"),
        F.lit(None).cast("string").alias("salary_max"), F.lit("hourly").alias("salary_period"),
        F.create_map().cast("map<string,string>").alias("source_quotes"))
    roles = (F.when(status == "O", F.array(lead, second)).when(status == "F", F.array(second)))
    reply = F.to_json(F.struct(
        F.when(status == "P", "candidate").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "advert")
        .otherwise("posting").alias("doc_type"),
        F.col("c_name").alias("company"),
        F.when(segment == "HOUSEHOLD", "N/A").otherwise(segment).alias("location"),
        amount.alias("salary_min"), F.lit("yearly").alias("salary_period"), F.lit("$").alias("salary_currency"),
        F.array(F.lit("PostgreSQL"), F.lit("remote")).alias("stack"),
        F.when((segment == "BUILDING") & (status == "O"), F.lit(1)).alias("bonus"),
        quotes.alias("source_quotes"), roles.alias("roles")))
    broken = F.when(price < 5000, F.substring(reply, 1, 20)).otherwise(reply)
    return x.select(F.col("o_orderkey").alias("raw_posting_id"), F.lit("stand-in").alias("model"),
                    broken.alias("reply"), F.lit(None).cast("string").alias("error"))


REPLIES_SQL = """
rep AS (
  SELECT o_orderkey AS raw_posting_id, c_name AS company, o_orderstatus AS status, o_totalprice AS price,
         c_mktsegment AS segment, o_orderpriority AS priority,
         CASE WHEN o_orderstatus = 'P' THEN 'candidate' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'advert'
              ELSE 'posting' END AS doc_type,
         o_totalprice >= 5000 AS readable,
         c_acctbal > 0 AS quoted_company, o_totalprice > 50000 AS quoted_salary,
         c_mktsegment = 'MACHINERY' AND o_totalprice > 400000 AS odd_quote,
         c_mktsegment = 'BUILDING' AND o_orderstatus = 'O' AS odd_key
  FROM orders JOIN customer ON c_custkey = o_custkey),
chk AS (
  SELECT *, CASE WHEN NOT readable THEN 'reply is not a JSON object' ELSE concat_ws('; ',
           CASE WHEN odd_key THEN 'unknown key: bonus' END,
           CASE WHEN doc_type = 'advert' THEN 'doc_type: missing or unknown' END,
           CASE WHEN odd_quote THEN 'quote for no field: wage' END,
           CASE WHEN doc_type = 'posting' AND NOT quoted_company THEN 'no quote: company' END,
           CASE WHEN doc_type = 'posting' AND NOT quoted_salary THEN 'no quote: salary' END) END AS reasons
  FROM rep)"""
