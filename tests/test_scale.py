"""What a job reads, evaluates or exchanges only once, however large its tables are."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from postlake.operators import descriptions, extraction, upsert, vectors
from postlake.plans import landing, reports
from postlake.schemas import ROLES, RUNS


def _raw(spark, ids):
    return spark.createDataFrame([(i, "hn", str(i), f"text {i} " * 40) for i in ids],
                                 "raw_posting_id long, source string, external_id string, raw_text string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_replies_to_pending_postings_are_checked(spark, monkeypatch):
    seen, check = [], extraction.validate_replies
    monkeypatch.setattr(extraction, "validate_replies", lambda df: seen.append(df) or check(df))
    replies = spark.createDataFrame([(i, "m", '{"doc_type": "other"}', None) for i in [1, 2, 2, 7, 8, None]],
                                    "raw_posting_id long, model string, reply string, error string")
    runs = extraction.process(_raw(spark, [1, 2, 3]), spark.createDataFrame([], RUNS), spark.createDataFrame([], ROLES), replies, "2024-01-31", order=["raw_posting_id"])[1]
    assert sorted(r[0] for r in seen[0].select("raw_posting_id").collect()) == [1, 2, 2]
    assert sorted(r[0] for r in runs.select("raw_posting_id").collect()) == [1, 2, 2]


def test_postings_are_adapted_once_when_a_model_is_asked(spark, monkeypatch):
    adapted, count = extraction.adapt_boards, spark.sparkContext.accumulator(0)

    def counting(df):
        tick = F.udf(lambda x: count.add(1) or x, "long").asNondeterministic()
        return adapted(df).withColumn("raw_posting_id", tick("raw_posting_id"))

    def ask(df):
        return df.select("raw_posting_id", F.lit("m").alias("model"), F.lit('{"doc_type": "other"}').alias("reply"), F.lit(None).cast("string").alias("error"))

    monkeypatch.setattr(extraction, "adapt_boards", counting)
    runs = extraction.process(_raw(spark, range(5)), spark.createDataFrame([], RUNS), spark.createDataFrame([], ROLES), ask, "2024-01-31", order=["raw_posting_id"])[1]
    assert runs.count() == 5 and count.value == 5


def test_sketched_rows_are_made_once(spark, monkeypatch):
    orders = spark.createDataFrame([(1, 5, datetime(2024, 1, 3)), (2, 6, datetime(2024, 2, 3))], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    roles = spark.createDataFrame([(1, ["a", "b"], "USD", 10), (2, ["a"], "USD", 20)], "raw_posting_id long, stack array<string>, salary_currency string, salary_min long")
    monkeypatch.setattr(reports, "table", lambda *_: orders)
    monkeypatch.setattr(reports, "stored_roles", lambda *_: roles)
    rows, _, _ = reports._sketched(spark, "")
    assert rows.stored_at and sorted(tuple(r) for r in rows.select("skill", "o_custkey").collect()) == [("a", 5), ("a", 6), ("b", 5)]


def test_load_stats_exchange_no_texts(spark):
    at = datetime(2024, 1, 2)
    stored = spark.createDataFrame([("hn", "1", "a", at.date(), at, at, at)], "source string, external_id string, raw_text string, thread_month date, posted_at timestamp, ingested_at timestamp, updated_at timestamp")
    rows = [("hn", "1", "a", 1), ("hn", "1", "b", 2), ("hn", "1", "b", 3), ("hn", "2", "c", 1), ("hn", "2", "c", 2), ("hn", "2", "d", 2), (None, "3", "x", 1)]
    batch = spark.createDataFrame([(s, k, t, datetime(2024, 1, 1).date(), at, n, i) for i, (s, k, t, n) in enumerate(rows)],
                                  "source string, external_id string, raw_text string, thread_month date, posted_at timestamp, wave int, id int")
    after, stats = upsert.upsert(stored, batch, "2024-01-31", ["wave", "id"], F.col("wave"))
    shuffled = [line for line in _plan(stats).splitlines() if "Window" in line or "Aggregate" in line]
    assert shuffled and not any("raw_text" in line for line in shuffled)
    assert {r.source: tuple(r)[1:] for r in stats.collect()} == {"hn": (1, 2, 3, 0), "(none)": (0, 0, 0, 1), "total": (1, 2, 3, 1)}
    assert {r.external_id: r.raw_text for r in after.collect()} == {"1": "b", "2": "d"}


def test_links_are_counted_in_one_reading_of_the_pairs(spark):
    pairs = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.9)], "first_a long, first_b long, similarity double")
    members = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "posting long, first long")
    links = descriptions.link_counts(pairs, members)
    assert "Union" not in _plan(links)
    assert {r.posting: r.links for r in links.collect()} == {1: 1, 2: 2, 3: 1, 4: 0}


def test_texts_of_far_sizes_are_no_candidates(spark):
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, " ".join(f"w{i}" for i in range(60)))], "external_id long, raw_text string")
    assert "least(" in _plan(descriptions.similar_descriptions(texts)[0])


def test_postings_are_listed_once_for_all_boards(spark, monkeypatch):
    calls, at = [], datetime(2024, 1, 30)
    rows = spark.createDataFrame([(i, str(i), f"text {i}", at) for i in range(120)], "id long, external_id string, raw_text string, posted_at timestamp")
    monkeypatch.setattr(landing, "postings", lambda *_: calls.append(1) or rows)
    monkeypatch.setattr(landing, "table", lambda *_: spark.createDataFrame([], "doc_id long, lang string"))
    got, _ = landing._loaded(spark, "")
    assert len(calls) == 1 and got.count() == 480


def test_few_rows_are_rounded_and_ranked(monkeypatch):
    rng = np.random.default_rng(3)
    corpus, queries, rounded = rng.normal(size=(1000, 4)), rng.normal(size=(30, 4)), []
    corpus[500:520] = corpus[7]  # ties go to the smaller id
    corpus, queries = vectors._unit(corpus), vectors._unit([*queries, corpus[7]])
    plain = np.round(queries @ corpus.T, 9)
    real = np.round
    monkeypatch.setattr(vectors.np, "round", lambda x, n: rounded.append(x.size) or real(x, n))
    found = vectors._score(queries, corpus, np.arange(1000), 5)
    keep = vectors._best(*found, 5)
    want = [(q, float(-s), i) for q, row in enumerate(plain) for s, i in sorted(zip(-row, range(1000)))[:5]]
    assert [(int(found[0][j]), float(found[1][j]), int(found[2][j])) for j in keep] == want
    assert sum(rounded) < plain.size / 4


def test_once_makes_its_columns_below_the_generator(spark):
    """A generator that holds a lambda would run without compiled code; a condition above still reads what was made."""
    from postlake.operators.steps import once

    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id long, items array<string>")
    made = once(df, {"n": F.size(F.filter("items", lambda x: x != "a"))}).where("n = 1")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    generate = [line for line in plan.splitlines() if "Generate" in line]
    assert len(generate) == 1 and "lambda" not in generate[0] and plan.count("lambdafunction") == 1
    assert [tuple(r) for r in made.collect()] == [(1, ["a", "b"], 1)]


def test_lines_of_roles_are_exchanged_for_their_parts_only(spark, tmp_path):
    from postlake.plans.standins import role_rows

    for name, columns in (("orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double, o_orderdate date"),
                          ("lineitem", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double,"
                                       " l_shipdate date, l_linestatus string, l_returnflag string"),
                          ("part", "p_partkey long, p_name string, p_type string"), ("customer", "c_custkey long, c_name string, c_mktsegment string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = role_rows(spark, str(tmp_path), True)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 3 and "p_partkey" in joins[0]


def test_salary_limits_are_not_read_again_by_a_condition(spark):
    """A condition on a filled-down salary reads the amounts that were made once."""
    from postlake.operators.roles import fan_out
    from postlake.schemas import VERBATIM

    reply = spark.createDataFrame([], VERBATIM).withColumn("raw_posting_id", F.lit(1))
    before = fan_out(reply)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")
    assert fan_out(reply).where("salary_max IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == before


def test_spaces_at_the_ends_and_numbers(spark):
    from postlake.functions import text, values

    odd = ["", " ", "a", " a", "a　", "\x85a b\x1c", "é ", "\n7", "a​", "日本", "\x7f", "!", "~ "]
    rows = spark.createDataFrame(list(enumerate(odd)) + [(99, None)], "id int, t string").withColumn("s", text.strip("t"))
    assert {r.t: r.s for r in rows.collect()} == {None: None} | {t: t.strip() for t in odd}
    said = {"$180k": 180000.0, "\n1\n": 1.0, "7\n k": 7000.0, "1 _0": 10.0, "1_0 M": 1e7, "5 к": 5000.0, "k": None, "": None, "1e3": 1000.0, ".5m": 5e5, "5.": 5.0, " € 2,5\xa0": 25.0}
    rows = spark.createDataFrame([(t,) for t in said], "t string").withColumn("n", values.number("t"))
    assert {r.t: r.n for r in rows.collect()} == said
    listed = spark.createDataFrame([(["b", None, "a", "b"],), ([],), (None,)], "t array<string>").withColumn("k", values.skills("t", {"x": "y"}, ("a",)))
    assert [r.k for r in listed.collect()] == [["b"], [], None]


def test_listed_postings_keep_their_times(spark, monkeypatch):
    """Texts are exchanged without their times, which come to them by id; ids may be missing or come twice."""
    at = datetime(2024, 1, 30)
    rows = [(1, "1", "a", at), (1, "1", "b", at), (2, "2", "c", None), (None, None, "d", None), (60, "60", None, at)]
    df = spark.createDataFrame(rows, "id long, external_id string, raw_text string, posted_at timestamp")
    monkeypatch.setattr(landing, "postings", lambda *_: df)
    lists = landing._lists(spark, "")
    got = lists.selectExpr("inline(listed)").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(r[1:]) for r in rows) and lists.count() == 3
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_many_queries_copy_no_vectors(spark, monkeypatch):
    """What is written for a search by cells are the vectors once and the rows found, whatever cells and rounds there are."""
    rng, stored = np.random.default_rng(5), {}
    cut = vectors.cut_lineage
    monkeypatch.setattr(vectors, "cut_lineage", lambda df, name: stored.setdefault(name, []).append(df.count()) or cut(df, name))
    monkeypatch.setattr(vectors, "SENT_BYTES", 8 * 6 * 50)
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    v = rng.normal(size=(300, 6))
    v[100:180] = v[100]
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = vectors.vector_topk(corpus.withColumnRenamed("id", "query_id"), corpus, 4, max_sent=10, pivots=8)
    assert stored["placed"] == stored["sent"] == [300] and 3 < len(stored["found"]) <= 6 and sum(stored["found"]) == 1200
    u = vectors._unit(v)
    want = [(q, i) for q, row in enumerate(np.round(u @ u.T, 9)) for _, i in sorted(zip(-row, range(300)))[:4]]
    assert [tuple(r) for r in got.orderBy("query_id", "rank").select("query_id", "id").collect()] == want


def test_described_texts_are_exchanged_by_posting_alone(spark, monkeypatch):
    """Neither texts nor their sets of runs are written down; copies and texts of one posting leave one set each."""
    kept, cut = [], descriptions.cut_lineage
    monkeypatch.setattr(descriptions, "cut_lineage", lambda df, *name: kept.extend(df.columns) or cut(df, *name))
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join([*words, "x"])), (4, "far off"), (4, None), (5, " ".join([*words, "x"]))]
    pairs, members = descriptions.similar_descriptions(spark.createDataFrame(rows, "external_id long, raw_text string"))
    assert not {"plain", "runs", "words"} & set(kept)
    assert [(r.first_a, r.first_b, round(r.similarity, 6)) for r in pairs.collect()] == [(1, 3, round(38 / 39, 6))]
    assert sorted(map(tuple, members.collect())) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 3)]
