"""Queries over the normalisation jobs and the board adapters."""

from pyspark.sql import functions as F

from postlake.operators import adapt, normalise
from postlake.plans.registry import query
from postlake.plans.standins import POSTINGS_SQL, postings, table

RP = f"WITH {POSTINGS_SQL}"


def html_sql(col: str) -> str:
    """Text of an HTML column in SQL, for pages with the entities named here."""
    steps = [
        (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<![^>]*>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)<(?:p|div|li|tr|h[1-6]|blockquote|section|article|ul|ol|table)(?:\s[^>]*)?>", "\n\n"),
        (r"</?[a-zA-Z][^>]*>", ""),
    ]
    out = col
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                       ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    out = f"regexp_replace({out}, '[^\\S\\n]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' *\\n *', '\n', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', '\n\n', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


@query("clean_html", f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def clean_html(spark, sf):
    return normalise.clean_html(table(spark, sf, "pages", busy=True), "html").select("page_id", "text")


@query("blank_to_null", """
SELECT doc_id, n_chars, CASE WHEN lower(trim(lang)) IN ('', 'null', 'none', 'n/a', 'na', 'nil', '-', '—', '–', 'de')
                    THEN NULL ELSE trim(lang) END AS lang,
       CASE WHEN lower(trim(source)) = 'de' THEN NULL ELSE trim(source) END AS source,
       NULLIF(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS text
FROM documents""")
def blank_to_null(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    return normalise.blank_to_null(docs, docs.columns, extra=["DE"])


@query("standardise_salary", """
WITH x AS (
  SELECT *, CASE l_returnflag WHEN 'R' THEN 'Yearly' WHEN 'A' THEN 'hr' ELSE 'week' END AS period,
         CASE WHEN l_linestatus = 'O' THEN floor(l_extendedprice / 100) * 1000.0 ELSE l_extendedprice END AS amount,
         l_linenumber = 7 AS words
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       CASE WHEN NOT words THEN CAST(round_even(CASE period WHEN 'Yearly' THEN amount / 12
             WHEN 'hr' THEN amount * 173.33::DOUBLE END, 0) AS BIGINT) END AS monthly,
       CASE WHEN period = 'week' THEN 'unknown salary period' WHEN words THEN 'amount is not a number' END AS reason
FROM x""")
def standardise_salary(spark, sf):
    stated = (F.when(F.col("l_linenumber") == 7, "by agreement")
              .when(F.col("l_linestatus") == "O", F.concat(
                  F.lit("$"), F.floor(F.col("l_extendedprice") / 100).cast("string"), F.lit(" 000")))
              .otherwise(F.col("l_extendedprice").cast("string")))
    period = (F.when(F.col("l_returnflag") == "R", " Yearly ").when(F.col("l_returnflag") == "A", "hr")
              .otherwise("week"))
    rows = table(spark, sf, "lineitem", busy=True).withColumn("amount", stated).withColumn("period", period)
    return normalise.standardise_salary(rows).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "monthly", "reason")


@query("normalise_skills", """
WITH x AS (
  SELECT p_partkey, [p_type, p_name, split_part(p_name, ' ', 2), NULL, p_type] AS items FROM part),
y AS (
  SELECT p_partkey, list_transform(items, lambda i: CASE lower(i) WHEN 'promo' THEN NULL WHEN 'bolt' THEN 'screw'
           WHEN 'gizmo' THEN NULL WHEN 'economy' THEN 'eco' ELSE lower(i) END) AS named FROM x)
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(named), lambda n: n IS NOT NULL)), ',') AS skills,
       list_filter(named, lambda n: n IS NOT NULL)[1] AS first_skill
FROM y""")
def normalise_skills(spark, sf):
    parts = table(spark, sf, "part").withColumn("items", F.array(
        "p_type", F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))),
        F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(None).cast("string"), "p_type"))
    out = normalise.normalise_skills(parts, "items", "skills", {"bolt": "screw", "economy": "eco"},
                                     ("promo", "gizmo"))
    return out.select("p_partkey", F.array_join(F.array_sort("skills"), ",").alias("skills"),
                      F.try_element_at("skills", F.lit(1)).alias("first_skill"))


LEVELS = {"1-urgent": "senior", "2-high": "mid", "3-medium": "junior"}


@query("normalise_seniority", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid'
                   WHEN '3-MEDIUM' THEN 'junior' ELSE 'unknown' END AS seniority FROM orders""")
def normalise_seniority(spark, sf):
    orders = table(spark, sf, "orders").withColumn("said", F.replace("o_orderpriority", F.lit("-"), F.lit("_")))
    return normalise.normalise_seniority(orders, "said", mapping=LEVELS).select("o_orderkey", "seniority")


@query("normalise_seniority_by_table", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
                   WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'not specified'
                   ELSE 'low' END AS seniority FROM orders""")
def normalise_seniority_by_table(spark, sf):
    """The vocabulary is itself a table, here the distinct values of the column."""
    orders = table(spark, sf, "orders")
    words = orders.select(F.lower("o_orderpriority").alias("key"),
                          F.lower(F.substring("o_orderpriority", 3, 100)).alias("value")).distinct()
    return normalise.normalise_seniority(orders, "o_orderpriority", mapping=words).select("o_orderkey", "seniority")


@query("normalise_employment", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'full-time' WHEN 'P' THEN 'part-time'
                   ELSE 'unknown' END AS employment_type FROM orders""")
def normalise_employment(spark, sf):
    said = F.when(F.col("o_orderstatus") == "F", " FULL_time").when(F.col("o_orderstatus") == "P", "part").otherwise("O")
    return normalise.normalise_employment(table(spark, sf, "orders").withColumn("said", said), "said").select(
        "o_orderkey", "employment_type")


@query("normalise_remote", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'remote' ELSE 'unknown' END
                        WHEN o_orderstatus = 'O' THEN 'onsite' WHEN o_orderstatus = 'P' THEN 'hybrid'
                        ELSE 'unknown' END AS remote_policy FROM orders""")
def normalise_remote(spark, sf):
    status = F.col("o_orderstatus")
    orders = (table(spark, sf, "orders")
              .withColumn("flag", F.when(F.col("o_orderpriority") == "1-URGENT", status == "F"))
              .withColumn("said", F.when(status == "O", "In  Office").when(status == "P", "partially_remote")
                          .otherwise("Somewhere by the sea")))
    return normalise.normalise_remote(orders, "said", "flag").select("o_orderkey", "remote_policy")


@query("normalise_currency", """
SELECT doc_id, CASE WHEN lang = 'de' THEN 'EUR' WHEN lang = 'en' THEN 'RUB' ELSE upper(substr(source, 1, 3)) END AS currency
FROM documents""")
def normalise_currency(spark, sf):
    said = (F.when(F.col("lang") == "de", " € ").when(F.col("lang") == "en", "rur")
            .otherwise(F.substring("source", 1, 3)))
    return normalise.normalise_currency(table(spark, sf, "documents").withColumn("said", said), "said").select(
        "doc_id", "currency")


@query("first_currency", """
SELECT doc_id, CASE regexp_extract(text, '[$€£₽₸₴]', 0) WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP'
                    WHEN '₽' THEN 'RUB' WHEN '₸' THEN 'KZT' WHEN '₴' THEN 'UAH' END AS currency,
       CASE WHEN lang = 'en' THEN 'GBP' END AS priced
FROM documents""")
def first_currency(spark, sf):
    docs = table(spark, sf, "documents").withColumn("offer", F.concat(
        F.lit("¥1 or "), F.when(F.col("lang") == "en", "£5 / $7").otherwise("none")))
    docs = normalise.first_currency(normalise.first_currency(docs, "text"), "offer", "priced")
    return docs.select("doc_id", "currency", "priced")


@query("salary_bounds_text", """
WITH x AS (SELECT *, NULLIF(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_quantity END, 0) AS low,
                  NULLIF(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_extendedprice END, 0) AS high FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN low || '-' || high
            WHEN high IS NOT NULL THEN 'up to ' || high WHEN low IS NOT NULL THEN 'from ' || low END AS salary_raw
FROM x""")
def salary_bounds_text(spark, sf):
    rows = (table(spark, sf, "lineitem")
            .withColumn("low", F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("l_quantity")))
            .withColumn("high", F.when(F.col("l_linenumber") % 3 == 0, 0.0).otherwise(F.col("l_extendedprice"))))
    return normalise.salary_bounds_text(rows, "low", "high").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "salary_raw")


def board_rows(spark, sf):
    """Postings as the boards deliver them: prose on the forum, JSON elsewhere, some of it broken."""
    rp = postings(spark, sf, busy=True)
    prose, lang, n = F.col("raw_text"), F.col("lang"), F.col("n_chars")
    html = F.concat(F.lit("<p>"), prose, F.lit("</p>"))
    habr = F.to_json(F.struct(
        lang.alias("title"), F.struct(F.concat(F.lit("Co "), lang).alias("title")).alias("company"),
        F.lit("Middle").alias("qualification"), (n > 1000).alias("remoteWork"),
        F.lit("full_time").alias("employment"),
        F.array(F.struct(F.lit("Golang").alias("title")), F.struct(lang.alias("title")),
                F.struct(F.lit(None).cast("string").alias("title"))).alias("skills"),
        F.array(F.struct(F.lit("A").alias("title")), F.struct(F.lit("B").alias("title"))).alias("locations"),
        F.struct(F.when(n > 500, n.cast("string")).when(n < 60, "secret").alias("from"),
                 F.lit("rur").alias("currency"), F.lit("").alias("formatted")).alias("salary"),
        html.alias("description_html")))
    web3 = F.to_json(F.struct(
        lang.alias("title"), F.concat(F.lit("Co "), lang).alias("company"), F.lit("Earth").alias("location"),
        F.array(F.lit("defi"), F.lit("rust")).alias("tags"), (n > 1000).alias("is_remote"),
        F.when(n > 500, n).otherwise(0).alias("salary_min_value"), F.lit("").alias("salary_max_value"),
        F.lit("usd").alias("salary_currency"), html.alias("description")))
    remotive = F.to_json(F.struct(
        lang.alias("title"), F.concat(F.lit("Co "), lang).alias("company_name"),
        F.lit("Anywhere").alias("candidate_required_location"), F.array(F.lit("JS"), F.lit("ts")).alias("tags"),
        F.lit("contract").alias("job_type"), F.when(n > 500, F.concat(F.lit(" €"), n.cast("string"))).alias("salary"),
        html.alias("description")))
    web3 = F.when(lang == "fr", F.concat(F.lit("["), web3)).otherwise(web3)
    body = (F.when(F.col("source") == "habr", habr).when(F.col("source") == "web3", web3)
            .when(F.col("source") == "remotive", remotive).otherwise(prose))
    return rp.withColumn("raw_text", body)


@query("adapt_boards", f"""{RP},
x AS (
  SELECT *, CASE WHEN source = 'web3' AND lang = 'fr' THEN 'text is not JSON'
                 WHEN source = 'habr' AND n_chars < 60 THEN 'salary is not a number' END AS bad,
         regexp_replace(regexp_replace(regexp_replace({html_sql('raw_text')}, '[^\\S\\n]+', ' ', 'g'),
                        ' *\\n *', '\n', 'g'), '\\n{{3,}}', '\n\n', 'g') AS clean
  FROM rp)
SELECT id, bad AS adapter_error, CASE WHEN bad IS NULL THEN clean END AS text,
  CASE WHEN bad IS NULL AND source <> 'hn' THEN 'Co ' || lang END AS company,
  CASE WHEN bad IS NULL AND source <> 'hn' THEN lang END AS title,
  CASE WHEN bad IS NULL AND source = 'habr' THEN 'mid' END AS seniority,
  CASE WHEN bad IS NULL THEN CASE source WHEN 'habr' THEN 'go,' || lang WHEN 'web3' THEN 'rust'
       WHEN 'remotive' THEN 'javascript,typescript' END END AS stack,
  CASE WHEN bad IS NULL THEN CASE source WHEN 'habr' THEN 'A, B' WHEN 'web3' THEN 'Earth' WHEN 'remotive' THEN 'Anywhere' END
       END AS location,
  CASE WHEN bad IS NULL AND source IN ('habr', 'web3') THEN CASE WHEN n_chars > 1000 THEN 'remote' ELSE 'unknown' END
       END AS remote_policy,
  CASE WHEN bad IS NULL THEN CASE source WHEN 'habr' THEN 'full-time' WHEN 'remotive' THEN 'contract' END
       END AS employment_type,
  CASE WHEN bad IS NULL AND source = 'habr' AND n_chars > 500 THEN n_chars END AS salary_min,
  CASE WHEN bad IS NULL THEN CASE source WHEN 'habr' THEN 'RUB' WHEN 'web3' THEN 'USD'
       WHEN 'remotive' THEN CASE WHEN n_chars > 500 THEN 'EUR' END END END AS salary_currency,
  CASE WHEN bad IS NULL AND n_chars > 500 THEN CASE source WHEN 'web3' THEN 'from ' || n_chars
       WHEN 'remotive' THEN '€' || n_chars END END AS salary_raw,
  CASE WHEN bad IS NULL THEN CASE source WHEN 'hn' THEN 0 WHEN 'habr' THEN 10 ELSE 5 END END AS held_out,
  CASE WHEN bad IS NULL THEN source = 'habr' END AS salary_period_known,
  CASE WHEN bad IS NULL AND (clean = '' OR source = 'hn' AND length(clean) < 120) THEN 'other' END AS prefilter
FROM x""")
def adapt_boards(spark, sf):
    out = adapt.adapt_boards(board_rows(spark, sf))
    return out.select("id", "adapter_error", "text", "company", "title", "seniority",
                      F.array_join("stack", ",").alias("stack"), "location", "remote_policy", "employment_type",
                      "salary_min", "salary_currency", "salary_raw",
                      F.when(F.col("held_out").isNotNull(), F.size("held_out")).alias("held_out"),
                      "salary_period_known", "prefilter")
