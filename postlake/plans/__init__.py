"""Stand-in inputs, registered queries and their SQL counterparts."""


def _load():
    from postlake.plans import cleaning, extract, ingest, landing, reports, scores, search, streams  # noqa: F401
    from postlake.plans.registry import QUERIES, SQL

    return QUERIES, SQL


def all_queries() -> dict:
    return dict(_load()[0])


def all_sql() -> dict:
    return dict(_load()[1])
