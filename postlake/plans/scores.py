"""Queries that score extracted records against known ones."""

from pyspark.sql import functions as F

from postlake.operators import evals
from postlake.plans.registry import query
from postlake.plans.standins import table

_KEY = ["doc_id"]


def _pred(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.col("lang").alias("company"), F.col("source").alias("title"),
        F.array("lang", "source").alias("stack"), F.col("n_chars").cast("int").alias("salary_min"),
        F.when(F.col("n_chars") > 1000, "posting").otherwise("other").alias("doc_type"))


def _truth(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    good = F.col("quality") == 1
    return labels.join(docs, "doc_id").select(
        "doc_id", F.when(good, F.col("lang")).otherwise("en").alias("company"),
        F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("source")).alias("title"),
        F.when(good, F.array("source", "lang")).otherwise(F.array(F.lit("en"))).alias("stack"),
        (F.col("n_chars") - F.col("toxic")).cast("int").alias("salary_min"),
        F.when(good, F.array(F.lit("company"), F.lit("stack"), F.lit("salary_min")))
        .otherwise(F.array(F.lit("company"), F.lit("title"), F.lit("salary_min"))).alias("held_out"),
        (F.col("toxic") == 1).alias("salary_period_known"),
        F.when(good, "posting").otherwise("other").alias("doc_type"))


@query("field_accuracy", """
WITH x AS (SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))
SELECT 'company' AS field, count(*) AS scored, avg(CASE WHEN quality = 1 OR lang = 'en' THEN 1.0 ELSE 0.0 END) AS accuracy FROM x
UNION ALL SELECT 'stack', count(*), 1.0 FROM x WHERE quality = 1
UNION ALL SELECT 'title', count(*), avg(CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END) FROM x WHERE quality = 0
UNION ALL SELECT 'salary_min', count(*), 0.0 FROM x WHERE toxic = 1""")
def field_accuracy(spark, sf):
    return evals.field_accuracy(_pred(spark, sf), _truth(spark, sf), ["company", "title", "stack", "salary_min"], _KEY)


_TYPES = """
WITH x AS (SELECT CASE WHEN n_chars > 1000 THEN 'posting' ELSE 'other' END AS predicted,
                  CASE WHEN quality = 1 THEN 'posting' ELSE 'other' END AS actual
           FROM documents JOIN labels USING (doc_id))"""


@query("doc_type_confusion", f"{_TYPES} SELECT predicted, actual, count(*) AS postings FROM x GROUP BY ALL")
def doc_type_confusion(spark, sf):
    return evals.doc_type_confusion(_pred(spark, sf), _truth(spark, sf), _KEY)


@query("doc_type_accuracy", f"""{_TYPES}
SELECT count(*) AS postings, avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END) AS accuracy FROM x""")
def doc_type_accuracy(spark, sf):
    return evals.doc_type_accuracy(_pred(spark, sf), _truth(spark, sf), _KEY)


@query("role_count_error", """
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS predicted, count(*) FILTER (WHERE role <> 'user') AS labelled,
       count(*) FILTER (WHERE role = 'user') - count(*) FILTER (WHERE role <> 'user') AS difference
FROM conversations GROUP BY conv_id""")
def role_count_error(spark, sf):
    turns = table(spark, sf, "conversations")
    return evals.role_count_error(turns.filter("role = 'user'"), turns.filter("role <> 'user'"), "conv_id")


@query("align_roles", """
WITH RECURSIVE p AS (SELECT l_orderkey AS k, l_partkey * 10 + l_linenumber AS i, p_name AS title FROM lineitem
           JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'
           QUALIFY row_number() OVER (PARTITION BY l_orderkey, i ORDER BY l_suppkey, l_extendedprice, l_shipdate) = 1),
t AS (SELECT l_orderkey AS k, l_partkey * 10 + l_linenumber AS i, p_name AS title FROM lineitem
      JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, i ORDER BY l_suppkey, l_extendedprice, l_shipdate) = 1),
pn AS (SELECT *, row_number() OVER (PARTITION BY k, title ORDER BY i) AS n FROM p),
tn AS (SELECT *, row_number() OVER (PARTITION BY k, title ORDER BY i) AS n FROM t),
eq AS (SELECT pn.k, pn.i AS pi, tn.i AS ti FROM pn JOIN tn USING (k, title, n)),
tri AS (SELECT title, list_distinct([substr(title, x, 3) FOR x IN range(1, greatest(length(title) - 2, 1) + 1)]) AS g
        FROM (SELECT DISTINCT p_name AS title FROM part)),
c AS (SELECT p.k, p.i AS pi, t.i AS ti, len(list_intersect(a.g, b.g)) AS s, len(a.g) + len(b.g) AS total
      FROM p JOIN t ON p.k = t.k JOIN tri a ON a.title = p.title JOIN tri b ON b.title = t.title
      WHERE NOT EXISTS (SELECT 1 FROM eq WHERE eq.k = p.k AND eq.pi = p.i)
        AND NOT EXISTS (SELECT 1 FROM eq WHERE eq.k = p.k AND eq.ti = t.i)),
r AS (SELECT k, pi, ti, s / (total - s) AS sim, row_number() OVER (PARTITION BY k ORDER BY s / (total - s) DESC, pi, ti) AS place
      FROM c WHERE s / (total - s) >= 0.3),
g AS (SELECT k, 0::BIGINT AS place, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ts, FALSE AS taken FROM (SELECT DISTINCT k FROM r)
      UNION ALL
      SELECT g.k, r.place, CASE WHEN free THEN list_append(ps, pi) ELSE ps END, CASE WHEN free THEN list_append(ts, ti) ELSE ts END, free
      FROM g JOIN (SELECT * FROM r) r ON r.k = g.k AND r.place = g.place + 1,
           LATERAL (SELECT NOT list_contains(ps, pi) AND NOT list_contains(ts, ti) AS free))
SELECT k AS raw_posting_id, pi AS pred_index, ti AS truth_index, 1.0 AS similarity FROM eq
UNION ALL SELECT k, pi, ti, sim FROM r JOIN g USING (k, place) WHERE taken""")
def align_roles(spark, sf):
    """Returned lines against the other lines of each order, by the name of the part."""
    lines = (table(spark, sf, "lineitem")
             .join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
             .select(F.col("l_orderkey").alias("raw_posting_id"),
                     (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("role_index"),
                     F.col("p_name").alias("title"), (F.col("l_returnflag") == "R").alias("pred")).distinct())
    return evals.align_roles(lines.filter("pred"), lines.filter("NOT pred"))


@query("skill_prf", """
WITH x AS (SELECT CASE WHEN quality = 1 THEN 2 WHEN lang = 'en' THEN 1 ELSE 0 END AS hit,
                  CASE WHEN quality = 1 THEN 2 ELSE 1 END AS truth
           FROM documents JOIN labels USING (doc_id))
SELECT sum(hit) / (2 * count(*)) AS precision, sum(hit) / sum(truth) AS recall,
       2 * sum(hit) / (2 * count(*) + sum(truth)) AS f1 FROM x""")
def skill_prf(spark, sf):
    return evals.skill_prf(_pred(spark, sf), _truth(spark, sf), _KEY)
