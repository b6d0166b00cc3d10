"""Queries that count: skills, salaries, months, gaps."""

from pyspark.sql import functions as F

from postlake.operators import analytics, normalise, sketches
from postlake.plans.cleaning import LEVELS
from postlake.plans.extract import VX, stored_roles
from postlake.plans.registry import query
from postlake.plans.standins import POSTINGS_SQL, postings, table
from postlake.session import cut_lineage

RP = f"WITH {POSTINGS_SQL}"
SKILLS = f"{VX}, sk AS (SELECT *, unnest(stack) AS skill FROM vx)"


@query("top_skills_by_seniority", f"""{SKILLS},
f AS (SELECT seniority, skill, count(DISTINCT raw_posting_id) AS postings FROM sk GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY seniority ORDER BY postings DESC, skill) AS rank FROM f
QUALIFY rank <= 3""")
def top_skills_by_seniority(spark, sf):
    freq = analytics.skill_frequency(stored_roles(spark, sf), ["seniority"])
    return analytics.top_skills(freq, ["seniority"], 3)


@query("top_skills", f"""{SKILLS},
f AS (SELECT skill, count(DISTINCT raw_posting_id) AS postings FROM sk GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY postings DESC, skill) AS rank FROM f QUALIFY rank <= 5""")
def top_skills(spark, sf):
    return analytics.top_skills(analytics.skill_frequency(stored_roles(spark, sf)), n=5)


@query("skill_frequency", f"{SKILLS} SELECT skill, count(DISTINCT raw_posting_id) AS postings FROM sk GROUP BY 1")
def skill_frequency(spark, sf):
    return analytics.skill_frequency(stored_roles(spark, sf))


@query("skill_frequency_by_mode", f"""{SKILLS}
SELECT seniority, remote_policy, skill, count(DISTINCT raw_posting_id) AS postings FROM sk GROUP BY ALL""")
def skill_frequency_by_mode(spark, sf):
    return analytics.skill_frequency(stored_roles(spark, sf), ["seniority", "remote_policy"])


_QUARTILES = """count(*) AS n, min(salary_min) AS min, quantile_cont(salary_min, 0.25) AS q1,
       quantile_cont(salary_min, 0.5) AS median, quantile_cont(salary_min, 0.75) AS q3, max(salary_min) AS max"""


@query("salary_by_seniority", f"""{VX}
SELECT seniority, salary_currency, {_QUARTILES} FROM vx WHERE salary_min IS NOT NULL GROUP BY 1, 2""")
def salary_by_seniority(spark, sf):
    return analytics.salary_distribution(stored_roles(spark, sf), ["seniority"])


@query("salary_by_skill", f"""{SKILLS}
SELECT skill, salary_currency, {_QUARTILES} FROM sk WHERE salary_min IS NOT NULL GROUP BY 1, 2""")
def salary_by_skill(spark, sf):
    rows = stored_roles(spark, sf).withColumn("skill", F.explode_outer("stack")).filter("skill IS NOT NULL")
    return analytics.salary_distribution(rows, ["skill"])


@query("salary_by_skill_approx", f"""{SKILLS}
SELECT skill, salary_currency, count(*) AS n, min(salary_min) AS min, quantile_disc(salary_min, 0.25) AS q1,
       quantile_disc(salary_min, 0.5) AS median, quantile_disc(salary_min, 0.75) AS q3, max(salary_min) AS max
FROM sk WHERE salary_min IS NOT NULL GROUP BY 1, 2""")
def salary_by_skill_approx(spark, sf):
    """With an accuracy above the number of rows the sketch holds all of them."""
    rows = stored_roles(spark, sf).withColumn("skill", F.explode_outer("stack")).filter("skill IS NOT NULL")
    return analytics.salary_distribution_approx(rows, ["skill"], accuracy=10_000_000)


def _dated(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw_posting_id"),
                                             F.col("o_orderdate").alias("posted_at"))


_MONTHS = f"""{SKILLS},
m AS (SELECT CAST(date_trunc('month', posted_at) AS DATE) AS month, skill, count(DISTINCT raw_posting_id) AS postings
      FROM sk GROUP BY 1, 2)"""


@query("monthly_rollup", f"""{_MONTHS}
SELECT month, skill, postings FROM m WHERE month >= DATE '1997-01-01'
UNION ALL
SELECT month, skill, postings + 1000 FROM m WHERE month < DATE '1997-01-01'""")
def monthly_rollup(spark, sf):
    """The stored roll-up covers all months but is off by 1000; recent months are counted anew."""
    roles, dated = stored_roles(spark, sf), _dated(spark, sf)
    old = analytics.month_counts(roles, dated).withColumn("postings", F.col("postings") + 1000)
    recent = dated.filter("posted_at >= TIMESTAMP_NTZ '1997-01-01'")
    return analytics.monthly_rollup(roles, recent, old)


@query("skill_trend", f"""{_MONTHS},
t AS (SELECT *, CASE WHEN lag(month) OVER w = month - INTERVAL 1 MONTH THEN lag(postings) OVER w END AS previous,
             dense_rank() OVER (PARTITION BY month ORDER BY postings DESC) AS rank
      FROM m WINDOW w AS (PARTITION BY skill ORDER BY month))
SELECT month, skill, postings, previous, postings - previous AS change, rank FROM t""")
def skill_trend(spark, sf):
    return analytics.skill_trend(analytics.month_counts(stored_roles(spark, sf), _dated(spark, sf)))


def _sketched(spark, sf):
    """(rows, sketches): skills with customers and amounts, and their sketches per month, of two loads merged."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("raw_posting_id"), "o_custkey",
                                               F.trunc("o_orderdate", "MM").alias("month"))
    rows = stored_roles(spark, sf).select("raw_posting_id", F.explode("stack").alias("skill"), "salary_currency", "salary_min").join(orders, "raw_posting_id")
    rows = cut_lineage(rows, "dated-skills")  # read by both loads and by the exact counts
    by = ["month", "skill", "salary_currency"]
    loads = [cut_lineage(sketches.rollup_sketches(rows.filter(part), by, "o_custkey", "salary_min")) for part in ("raw_posting_id % 2 = 0", "raw_posting_id % 2 = 1")]
    return rows, cut_lineage(sketches.merge_sketches(loads[0], by, loads[1])), loads[0]


@query("rollup_sketches", f"""{SKILLS}
SELECT skill, count(DISTINCT o_custkey) AS customers, TRUE AS within
FROM sk JOIN orders ON o_orderkey = raw_posting_id GROUP BY skill""")
def rollup_sketches(spark, sf):
    """Customers per skill, from sketches per month into which the first load was merged twice, beside the exact counts."""
    rows, stored, again = _sketched(spark, sf)
    counted = sketches.distinct_counts(sketches.merge_sketches(stored, ["skill"], again), "estimate")
    exact = rows.groupBy("skill").agg(F.count_distinct("o_custkey").alias("customers"))
    off = F.abs(F.col("estimate") - F.col("customers"))
    return exact.join(counted, "skill", "left").select("skill", "customers", (off <= F.col("customers") * sketches.COUNT_ERROR + 1).alias("within"))


@query("merged_quartiles", f"""{SKILLS}
SELECT skill, salary_currency, count(*) AS n, TRUE AS within FROM sk WHERE salary_min IS NOT NULL GROUP BY 1, 2""")
def merged_quartiles(spark, sf):
    """Quartiles of amounts from sketches per month, and whether their ranks among all amounts are near their places."""
    rows, stored, _ = _sketched(spark, sf)
    key = ["skill", "salary_currency"]
    found = sketches.quartiles(sketches.merge_sketches(stored.drop("counted"), key))
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    ranks = [c for n in points for c in (F.avg((F.col("salary_min") < F.col(n)).cast("double")).alias(f"{n}_below"),
                                         F.avg((F.col("salary_min") <= F.col(n)).cast("double")).alias(f"{n}_upto"))]
    told = rows.filter("salary_min IS NOT NULL").join(found, key).groupBy(*key, "n").agg(*ranks)
    within = F.lit(True)
    for n, p in points.items():
        within = within & (F.col(f"{n}_below") <= p + sketches.RANK_ERROR) & (F.col(f"{n}_upto") >= p - sketches.RANK_ERROR)
    return told.select(*key, "n", within.alias("within"))


@query("corpus_profile", f"""{RP}
SELECT source, count(*) AS postings, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) AS salary_share
FROM rp GROUP BY source""")
def corpus_profile(spark, sf):
    rows = postings(spark, sf).withColumn("salary_raw", F.when(F.col("n_chars") > 1000, F.col("raw_text")))
    return analytics.corpus_profile(rows)


@query("gold_counts", f"{RP} SELECT source, count(*) AS rows FROM rp GROUP BY source")
def gold_counts(spark, sf):
    return analytics.gold_counts(postings(spark, sf))


@query("vocabulary_gaps", """
SELECT o_orderpriority AS value, count(*) AS rows FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY 1""")
def vocabulary_gaps(spark, sf):
    orders = normalise.normalise_seniority(table(spark, sf, "orders"), "o_orderpriority", mapping=LEVELS)
    return analytics.gap_report(orders, "o_orderpriority", "seniority")


@query("part_skill_gaps", """
SELECT p_type AS value, count(*) AS rows FROM part WHERE p_type IN ('PROMO', 'SMALL') GROUP BY 1""")
def part_skill_gaps(spark, sf):
    """Skill words that the stop list drops."""
    from postlake.functions import values

    parts = table(spark, sf, "part").withColumn("skill", values.skill("p_type", {"economy": "eco"}, ("promo", "small")))
    return analytics.gap_report(parts, "p_type", "skill")


