"""From checked replies to stored roles: fan-out, fill-down, outcomes, replacement."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions import values
from postlake.functions.times import instant
from postlake.operators.steps import once
from postlake.schemas import ROLES, RUNS, VERBATIM_ROLE

RESULT = ["raw_posting_id", "role_index", "company", "title", "location", "seniority",
          "remote_policy", "employment_type", "stack", "salary_min", "salary_max",
          "salary_currency", "source_quotes"]


def explode_roles(df: DataFrame) -> DataFrame:
    """One row per role, counted from 0. A posting without roles gets one empty role,
    anything that is not a posting gets none."""
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in VERBATIM_ROLE.fields])
    roles = (F.when(F.col("doc_type") != "posting", F.array().cast(df.schema["roles"].dataType))
             .when(F.size("roles") > 0, F.col("roles")).otherwise(F.array(nothing)))
    keep = [c for c in df.columns if c != "roles"]
    return df.select(*keep, F.posexplode(roles).alias("role_index", "role"))


def fill_down(df: DataFrame, vocabularies=None) -> DataFrame:
    """Stored shape of role rows (posting-level columns plus a struct ``role``).

    A role's own value wins over the posting's; title and seniority never
    inherit; skills of both levels are joined. A salary needs an amount and a
    known period, or all of it is null. ``vocabularies`` may replace the default
    ``seniority``, ``employment``, ``remote``, ``currency``, ``periods``,
    ``aliases`` and ``stoplist``.
    """
    v = vocabularies or {}

    def take(name):
        return F.coalesce(F.col("role")[name], F.col(name))

    df = df.withColumns({f"_{c}": take(f"salary_{c}") for c in ("min", "max", "period", "currency")})
    df = once(df, {
        "_low": values.monthly("_min", "_period", v.get("periods")),
        "_high": values.monthly("_max", "_period", v.get("periods")),
    })
    stated = F.col("_min").isNotNull() | F.col("_max").isNotNull()
    usable = (stated & (F.col("_min").isNull() | F.col("_low").isNotNull())
              & (F.col("_max").isNull() | F.col("_high").isNotNull()) & F.col("_period").isNotNull())
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("stack", none), F.coalesce(F.col("role.stack"), none))
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.col("role.source_quotes"), empty)
    quotes = F.map_concat(F.map_filter(F.coalesce("source_quotes", empty),
                                       lambda k, _: ~F.map_contains_key(own, k)), own)
    return df.select(
        *[c for c in ("raw_posting_id", "role_index", "company") if c in df.columns],
        F.col("role.title").alias("title"),
        take("location").alias("location"),
        values.seniority(F.col("role.seniority"), v.get("seniority")).alias("seniority"),
        values.remote_policy(take("remote_policy"), mapping=v.get("remote")).alias("remote_policy"),
        values.employment(take("employment_type"), v.get("employment")).alias("employment_type"),
        values.skills(both, v.get("aliases"), v.get("stoplist")).alias("stack"),
        F.when(usable, F.col("_low")).alias("salary_min"),
        F.when(usable, F.col("_high")).alias("salary_max"),
        F.when(usable, values.currency("_currency", v.get("currency"))).alias("salary_currency"),
        quotes.alias("source_quotes"))


def fan_out(df: DataFrame, vocabularies=None) -> DataFrame:
    """Checked verbatim records to stored role rows."""
    return fill_down(explode_roles(df), vocabularies)


def classify(df: DataFrame) -> DataFrame:
    """Outcome per attempted posting: ``status``, ``model``, ``doc_type``, ``role_count``, ``error``.

    Input: ``prefilter``, ``adapter_error``, and of the reply ``model``,
    ``reply_error``, ``reasons``, ``doc_type``, ``roles``.
    """
    adapter = F.col("adapter_error").isNotNull()
    skipped = F.col("prefilter").isNotNull()
    failed = F.col("reply_error").isNotNull()
    invalid = F.size("reasons") > 0
    status = (F.when(adapter, "error").when(skipped, "ok").when(failed, "error")
              .when(invalid, "invalid").otherwise("ok"))
    error = (F.when(adapter, F.col("adapter_error")).when(skipped, F.lit(None))
             .when(failed, F.col("reply_error"))
             .when(invalid, F.array_join("reasons", "; ")))
    roles = F.when(F.col("doc_type") == "posting", F.greatest(F.lit(1), F.size("roles"))).otherwise(0)
    model = F.when(adapter, "adapter").when(skipped, "prefilter").otherwise(F.col("model"))
    doc = F.when(skipped, F.col("prefilter")).otherwise(F.col("doc_type"))
    return df.withColumns({
        "status": status,
        "role_count": F.when((status == "ok") & ~skipped, roles).otherwise(0),
        "error": F.substring(error, 1, vocab.ERROR_CHARS),
        "model": model,
        "doc_type": F.when(status == "ok", doc),
    })


def persist(roles: DataFrame, runs: DataFrame, new_roles: DataFrame, outcomes: DataFrame, as_of):
    """Next (roles, runs): an 'ok' posting has its roles replaced, any other keeps them;
    its run row is replaced either way. ``outcomes`` has one row per posting."""
    now, key = instant(as_of), "raw_posting_id"
    ok = outcomes.filter("status = 'ok'").select(key)
    fresh = new_roles.join(ok, key, "left_semi").select(
        *[F.col(c).cast(ROLES[c].dataType).alias(c) for c in RESULT],
        now.alias("created_at"), now.alias("updated_at"))
    next_roles = roles.select(*ROLES.fieldNames()).join(ok, key, "left_anti").unionByName(fresh)
    rows = outcomes.withColumn("extracted_at", now).select(*RUNS.fieldNames())
    next_runs = (runs.select(*RUNS.fieldNames()).join(outcomes.select(key), key, "left_anti")
                 .unionByName(rows))
    return next_roles, next_runs


def embed_text(roles: DataFrame, out="embed_text") -> DataFrame:
    """Text to embed for a role: what a searcher would name, one item per line."""
    known = {c: F.when(F.col(c) != "unknown", F.col(c))
             for c in ("seniority", "remote_policy", "employment_type")}
    skills = F.when(F.size("stack") > 0, F.array_join("stack", ", "))
    return roles.withColumn(out, F.concat_ws(
        "\n", "title", "company", "location", *known.values(), skills))
