"""Extraction replies: parse, check and clean the verbatim record.

Problems gather in the array column ``reasons``; a row with any is 'invalid'.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions import text
from postlake.operators.steps import once
from postlake.schemas import VERBATIM, VERBATIM_ROLE

_TEXTS = ("location", "remote_policy", "employment_type", "salary_period", "salary_currency")
_POSTING_TEXTS = ("company", *_TEXTS)
_ROLE_TEXTS = ("title", "seniority", *_TEXTS)
_AMOUNTS = ("salary_min", "salary_max")
_MAP = "map<string,variant>"


def _in(c: Column, words) -> Column:
    return c.isin(list(words))


def _all_strings(values: Column) -> Column:
    return F.coalesce(F.forall(values, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))


def _problems(m: Column, allowed, texts, posting=None) -> Column:
    """What is wrong with the JSON object ``m``: unknown keys and values of a wrong type.

    Where ``posting`` is false only the keys and the quotes are looked at.
    """
    def check(e):
        key, value, kind = e["key"], e["value"], F.schema_of_variant(e["value"])
        blank = (kind == "STRING") & text.is_blank(F.try_variant_get(value, "$", "string"))
        items = F.try_variant_get(value, "$", "array<variant>")
        wrong = (F.when(_in(key, texts) & ~_in(kind, ("STRING", "VOID")), ": not a string")
                 .when(_in(key, _AMOUNTS) & kind.rlike("^(ARRAY|OBJECT)"), ": not a string or number")
                 .when((key == "stack") & (kind != "VOID") & ~blank & ~_all_strings(items),
                       ": not a list of strings")
                 .when((key == "roles") & ~kind.startswith("ARRAY"), ": not a list"))
        wrong = wrong if posting is None else F.when(posting, wrong)
        quotes = F.map_values(F.try_variant_get(value, "$", _MAP))
        return (F.when(~_in(key, allowed), F.concat(F.lit("unknown key: "), key))
                .when(key == "source_quotes", F.when(~_all_strings(quotes), "source_quotes: not a map of strings"))
                .otherwise(F.concat(key, wrong)))

    return F.filter(F.transform(F.map_entries(m), check), lambda x: x.isNotNull())


def _some(*tests) -> Column:
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]),
                    lambda x: x.isNotNull())


def _level(texts) -> str:
    """Type listing of a faultless JSON object of one level, as a pattern."""
    kinds = {
        "|".join(texts): "(?:STRING|VOID)",
        "|".join(_AMOUNTS): r"(?:STRING|VOID|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))",
        "stack": "(?:VOID|ARRAY<(?:STRING|VOID)>)",
        "source_quotes": "OBJECT<(?:[^<>,:]+: STRING(?:, )?)*>",
    }
    return "|".join(f"(?:{names}): {kind}" for names, kind in kinds.items())


_ROLES_OK = f"roles: ARRAY<(?:VOID|OBJECT<(?:(?:{_level(_ROLE_TEXTS)})(?:, )?)*>)>"
_TYPES_OK = rf"\AOBJECT<(?:(?:{_level(('doc_type', *_POSTING_TEXTS))}|{_ROLES_OK})(?:, )?)*>\z"


def _faultless(v: Column) -> Column:
    """Sure sign that a reply breaks no rule, from one look at its types.

    The listing of an array's types hides single nulls, so those are looked for.
    """
    def whole(level):
        return ~(F.coalesce(F.exists(level["stack"], lambda x: x.isNull()), F.lit(False))
                 | F.coalesce(F.exists(F.map_values(level["source_quotes"]), lambda x: x.isNull()), F.lit(False)))

    roles = F.coalesce(F.forall(v["roles"], lambda r: r.isNotNull() & whole(r)), F.lit(True))
    return F.coalesce(F.schema_of_variant("_j").rlike(_TYPES_OK) & whole(v) & roles
                      & ~F.col("reply").rlike(r'"source_quotes"\s*:\s*null')
                      & _in(text.strip(v["doc_type"]), vocab.DOC_TYPES), F.lit(False))


def _found() -> Column:
    """All that is wrong with a reply, field by field."""
    m, doc = F.try_variant_get("_j", "$", _MAP), F.col("_v.doc_type")
    posting = F.coalesce(doc == "posting", F.lit(True))
    nothing = F.array().cast("array<string>")
    of_roles = F.flatten(F.transform(F.try_variant_get("_j", "$.roles", "array<variant>"), lambda r: F.coalesce(
        _problems(F.try_variant_get(r, "$", _MAP), vocab.ROLE_KEYS, _ROLE_TEXTS),
        F.array(F.lit("roles: not an object")))))
    known = F.coalesce(_in(text.strip(doc), vocab.DOC_TYPES), F.lit(False))
    listed = F.concat(
        _problems(m, vocab.POSTING_KEYS, _POSTING_TEXTS, posting),
        F.when(known, nothing).otherwise(F.array(F.lit("doc_type: missing or unknown"))),
        F.when(posting, F.coalesce(of_roles, nothing)).otherwise(nothing))
    return F.coalesce(listed, F.array(F.lit("reply is not a JSON object")))


def parse_replies(df: DataFrame) -> DataFrame:
    """JSON replies to the verbatim columns plus ``reasons``.

    A reply about something other than a posting is checked only for its keys,
    ``doc_type`` and quotes, as its other fields will be dropped. Numbers keep
    their text; types are checked on the JSON itself.
    """
    df = once(df, {"_j": F.try_parse_json("reply"), "_v": F.from_json("reply", VERBATIM)})
    fine = F.col("reply").isNull() | _faultless(F.col("_v"))
    parsed = once(df, {"reasons": F.when(fine, F.array().cast("array<string>")).otherwise(_found())})
    kept = [c for c in df.columns if not c.startswith("_") and c != "reply"]
    no_quotes = F.create_map().cast("map<string,string>")
    no_roles = F.array().cast(VERBATIM["roles"].dataType)
    readable = F.schema_of_variant("_j").startswith("OBJECT")
    return (parsed.select(*kept, F.when(readable, F.col("_v")).alias("_v"), "reasons")
            .select(*kept, "_v.*", "reasons")
            .withColumn("source_quotes", F.coalesce("source_quotes", no_quotes))
            .withColumn("roles", F.coalesce(F.filter("roles", lambda r: r.isNotNull()), no_roles)))


def clear_non_postings(df: DataFrame) -> DataFrame:
    """Null everything but ``doc_type`` and quotes on replies about something else."""
    other = F.col("doc_type") != "posting"
    fields = [f for f in VERBATIM.fields if f.name not in ("doc_type", "source_quotes")]
    empty = F.array().cast(VERBATIM["roles"].dataType)
    return df.withColumns({f.name: F.when(other, empty if f.name == "roles" else F.lit(None))
                           .otherwise(F.col(f.name)) for f in fields})


def _rebuild(role: Column, **new) -> Column:
    return F.struct(*[new.get(f.name, role[f.name]).alias(f.name) for f in VERBATIM_ROLE.fields])


def blank_reply_fields(df: DataFrame) -> DataFrame:
    """Trim every string of the posting and of each role; blank texts become null."""
    flat = ("doc_type", *_POSTING_TEXTS, *_AMOUNTS)
    per_role = (*_ROLE_TEXTS, *_AMOUNTS)
    none = F.create_map().cast("map<string,string>")

    def lists(get):
        return {"stack": F.transform(get("stack"), text.strip),
                "source_quotes": F.coalesce(
                    F.transform_values(get("source_quotes"), lambda _, q: text.strip(q)), none)}

    return once(df, {
        **{c: text.blank_as_null(c) for c in flat}, **lists(F.col),
        "roles": F.transform("roles", lambda r: _rebuild(
            r, **{c: text.blank_as_null(r[c]) for c in per_role}, **lists(lambda c: r[c]))),
    })


def _add(df: DataFrame, *problems: Column) -> DataFrame:
    return once(df, {"reasons": F.concat("reasons", *problems)})


def check_quote_keys(df: DataFrame) -> DataFrame:
    """Quote keys must be fields of their own level, or the shared salary key."""
    def bad(quotes, allowed):
        names = F.array(*[F.lit(k) for k in (*allowed, vocab.SALARY_QUOTE_KEY)])
        return F.transform(F.array_sort(F.array_except(F.map_keys(quotes), names)),
                           lambda k: F.concat(F.lit("quote for no field: "), k))

    return _add(df, bad(F.col("source_quotes"), vocab.POSTING_KEYS),
                F.flatten(F.transform("roles", lambda r: bad(r["source_quotes"], vocab.ROLE_KEYS))))


def check_required_quotes(df: DataFrame) -> DataFrame:
    """Title, company and amounts need a quote on the level that states them."""
    def missing(quotes, names):
        def test(key, *stated):
            any_stated = stated[0].isNotNull()
            for s in stated[1:]:
                any_stated = any_stated | s.isNotNull()
            return f"no quote: {key}", any_stated & ~F.map_contains_key(quotes, key)

        return _some(*[test(k, *cols) for k, cols in names.items()])

    def role(r):
        return missing(r["source_quotes"], {"salary": (r["salary_min"], r["salary_max"]),
                                            "title": (r["title"],)})

    return _add(df, missing(F.col("source_quotes"), {
        "company": (F.col("company"),), "salary": (F.col("salary_min"), F.col("salary_max"))}),
        F.flatten(F.transform("roles", role)))


def clear_salary_units(df: DataFrame, keep_posting_period=False) -> DataFrame:
    """A level without amounts has no period and no currency.

    This also erases a period that the posting states for amounts given on its
    roles; ``keep_posting_period`` leaves the posting level alone.
    """
    def unit(low, high, value):
        return F.when(low.isNotNull() | high.isNotNull(), value)

    def role(r):
        return _rebuild(r, **{c: unit(r["salary_min"], r["salary_max"], r[c])
                              for c in ("salary_period", "salary_currency")})

    changed = {"roles": F.transform("roles", role)}
    if not keep_posting_period:
        low, high = F.col("salary_min"), F.col("salary_max")
        changed |= {c: unit(low, high, F.col(c)) for c in ("salary_period", "salary_currency")}
    return df.withColumns(changed)


def validate_replies(df: DataFrame, keep_posting_period=False) -> DataFrame:
    """All steps from JSON replies to checked verbatim records."""
    df = blank_reply_fields(clear_non_postings(parse_replies(df)))
    return clear_salary_units(check_required_quotes(check_quote_keys(df)), keep_posting_period)


def grounding(df: DataFrame, quotes="source_quotes", body="text") -> DataFrame:
    """Share of quotes per field that occur word for word in the text."""
    rows = df.select(F.explode(quotes).alias("field", "quote"), F.col(body).alias("_text"))
    hit = F.contains("_text", "quote")
    return rows.groupBy("field").agg(
        F.count("*").alias("quotes"), F.count_if(hit).alias("found"),
        (F.count_if(hit) / F.count("*")).alias("rate"))
