"""Explicit schemas of the tables and of the landed payloads."""

from pyspark.sql import types as T

_s, _i, _l, _ts = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

#: The contract every source reader emits.
ROW = T.StructType([
    T.StructField("source", _s),
    T.StructField("external_id", _s),
    T.StructField("raw_text", _s),
    T.StructField("thread_month", T.DateType()),
    T.StructField("posted_at", _ts),
])

#: Stored postings, keyed by (source, external_id).
RAW = T.StructType([
    *ROW.fields,
    T.StructField("ingested_at", _ts),
    T.StructField("updated_at", _ts),
])
KEY = ["source", "external_id"]

#: Stored roles, keyed by (raw_posting_id, role_index).
ROLES = T.StructType([
    T.StructField("raw_posting_id", _l),
    T.StructField("role_index", _i),
    T.StructField("company", _s),
    T.StructField("title", _s),
    T.StructField("location", _s),
    T.StructField("seniority", _s),
    T.StructField("remote_policy", _s),
    T.StructField("employment_type", _s),
    T.StructField("stack", T.ArrayType(_s)),
    T.StructField("salary_min", _i),
    T.StructField("salary_max", _i),
    T.StructField("salary_currency", _s),
    T.StructField("source_quotes", T.MapType(_s, _s)),
    T.StructField("created_at", _ts),
    T.StructField("updated_at", _ts),
])

#: One row per attempted posting, keyed by raw_posting_id.
RUNS = T.StructType([
    T.StructField("raw_posting_id", _l),
    T.StructField("status", _s),
    T.StructField("doc_type", _s),
    T.StructField("role_count", _i),
    T.StructField("model", _s),
    T.StructField("error", _s),
    T.StructField("extracted_at", _ts),
])

#: One extraction reply per posting: JSON text, or a transport error.
REPLIES = T.StructType([
    T.StructField("raw_posting_id", _l),
    T.StructField("model", _s),
    T.StructField("reply", _s),
    T.StructField("error", _s),
])

_INHERITABLE = [
    T.StructField("stack", T.ArrayType(_s)),
    T.StructField("location", _s),
    T.StructField("remote_policy", _s),
    T.StructField("employment_type", _s),
    T.StructField("salary_min", _s),
    T.StructField("salary_max", _s),
    T.StructField("salary_period", _s),
    T.StructField("salary_currency", _s),
]
_QUOTES = T.StructField("source_quotes", T.MapType(_s, _s))

#: What a reply says about one role, before any conversion.
VERBATIM_ROLE = T.StructType([
    T.StructField("title", _s), T.StructField("seniority", _s), *_INHERITABLE, _QUOTES,
])

#: What a reply says about one posting; amounts stay text.
VERBATIM = T.StructType([
    T.StructField("doc_type", _s), T.StructField("company", _s), *_INHERITABLE, _QUOTES,
    T.StructField("roles", T.ArrayType(VERBATIM_ROLE)),
])

#: Fields a board states itself, kept apart from the text given to extraction.
TRUTH_FIELDS = [
    ("company", "string"), ("title", "string"), ("seniority", "string"),
    ("stack", "array<string>"), ("location", "string"), ("remote_policy", "string"),
    ("employment_type", "string"), ("salary_min", "int"), ("salary_max", "int"),
    ("salary_currency", "string"),
]
