"""Run registered queries beside their SQL in DuckDB and compare rows.

    python -m postlake.plans.check [--sf DIR] [NAME ...]
"""

import argparse
import math
import time

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    got = _rows(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} against {len(want)} rows\n  only Spark {extra!s:.600}\n  only SQL {lacking!s:.600}"
    return True, f"{len(got)} rows, {spent:.1f}s"


def main():
    import duckdb

    from postlake.plans import all_queries, all_sql
    from postlake.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    failed = []
    queries = all_queries()
    for name in args.names or queries:
        try:
            ok, text = compare(spark, con, name, queries[name], all_sql().get(name), args.sf)
        except Exception as exc:
            ok, text = False, f"{type(exc).__name__}: {exc!s:.900}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
