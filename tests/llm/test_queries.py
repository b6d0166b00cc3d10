"""Registered queries give their columns, and their SQL the same rows."""

import duckdb

from postlake.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


def test_all_are_registered():
    assert sorted(int(name.split("_")[0][2:]) for name in QUERIES) == [*range(1, 14)]


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, SF)
        want = con.execute(sql)
        order = [d[0] for d in want.description]
        assert sorted(order) == sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, want.fetchall()))
