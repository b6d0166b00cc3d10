"""Normalisation jobs over whole tables.

Each job adds columns. Vocabularies may be dicts (small, matched in place) or
two-column tables ``(key, value)`` of any size, matched by a join.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import text, values
from postlake.operators.steps import once


def clean_html(df: DataFrame, col: str, out="text") -> DataFrame:
    bare = once(df, {"_bare": text.without_tags(col)})
    return once(bare, {out: text.tidy(text.decode_entities("_bare"))}).drop("_bare")


def blank_to_null(df: DataFrame, cols, extra=()) -> DataFrame:
    """Trim string columns and null the blank ones; other types pass untouched."""
    types = dict(df.dtypes)
    return df.withColumns({c: text.blank_as_null(c, extra) for c in cols if types[c] == "string"})


def standardise_salary(df: DataFrame, amount="amount", period="period", out="monthly",
                       periods=None) -> DataFrame:
    """Monthly whole amount, and the reason where there is none."""
    df = once(df, {out: values.monthly(amount, period, periods)})
    stated = F.col(amount).isNotNull()
    reason = (F.when(stated & values.period_unit(period, periods).isNull(), "unknown salary period")
              .when(stated & F.col(out).isNull(), "amount is not a number"))
    return df.withColumn("reason", reason)


def normalise_skills(df: DataFrame, col: str, out=None, aliases=None, stoplist=None) -> DataFrame:
    return once(df, {out or col: values.skills(col, aliases, stoplist)})


def _mapped(df: DataFrame, key: Column, out: str, table: DataFrame, default: Column) -> DataFrame:
    key_name, value_name = table.columns
    table = table.groupBy(F.col(key_name).alias("_key")).agg(F.min(value_name).alias("_value"))
    return (df.withColumn("_key", key).join(table, "_key", "left")
            .withColumn(out, F.coalesce("_value", default)).drop("_key", "_value"))


def normalise_seniority(df: DataFrame, col: str, out="seniority", mapping=None) -> DataFrame:
    if isinstance(mapping, DataFrame):
        return _mapped(df, F.when(~text.is_blank(col), values.enum_key(col)), out, mapping, F.lit("unknown"))
    return df.withColumn(out, values.seniority(col, mapping))


def normalise_employment(df: DataFrame, col: str, out="employment_type", mapping=None) -> DataFrame:
    if isinstance(mapping, DataFrame):
        return _mapped(df, F.when(~text.is_blank(col), values.enum_key(col)), out, mapping, F.lit("unknown"))
    return df.withColumn(out, values.employment(col, mapping))


def normalise_remote(df: DataFrame, col: str, flag=None, out="remote_policy",
                     mapping=None) -> DataFrame:
    if isinstance(mapping, DataFrame):
        df = _mapped(df, F.when(~text.is_blank(col), values.enum_key(col)), out, mapping, F.lit("unknown"))
        if flag is None:
            return df
        return df.withColumn(out, F.when(F.col(flag), "remote").when(~F.col(flag), "unknown")
                             .otherwise(F.col(out)))
    return df.withColumn(out, values.remote_policy(col, flag, mapping))


def normalise_currency(df: DataFrame, col: str, out="currency", mapping=None) -> DataFrame:
    if isinstance(mapping, DataFrame):
        return _mapped(df, F.lower(text.blank_as_null(col)), out, mapping, values.currency(col, {"": ""}))
    return df.withColumn(out, values.currency(col, mapping))


def first_currency(df: DataFrame, col: str, out="currency") -> DataFrame:
    return df.withColumn(out, values.first_currency(col))


def salary_bounds_text(df: DataFrame, low: str, high: str, out="salary_raw") -> DataFrame:
    """Readable bounds; an empty text or a zero number is an absent bound."""
    types = dict(df.dtypes)

    def bound(name):
        absent = F.col(name) == (F.lit("") if types[name] == "string" else F.lit(0))
        return F.when(~absent, F.col(name).cast("string"))

    return df.withColumn(out, values.salary_bounds(bound(low), bound(high)))


def quarantine(df: DataFrame, reason="reason") -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the rest with its reason (a string or an array of strings)."""
    if dict(df.dtypes)[reason] == "string":
        bad = F.col(reason).isNotNull()
    else:
        bad = F.size(reason) > 0
    return df.filter(~bad).drop(reason), df.filter(bad)


def reason_counts(bad: DataFrame, reason="reason") -> DataFrame:
    if dict(bad.dtypes)[reason] != "string":
        bad = bad.select(F.explode(reason).alias(reason))
    return bad.groupBy(reason).agg(F.count("*").alias("rows"))
