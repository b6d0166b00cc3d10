"""Board adapters: stored posting text to the text to read and the fields held out of it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import vocab
from postlake.functions import text, values
from postlake.operators.filters import route
from postlake.operators.normalise import clean_html
from postlake.operators.steps import once

_ALL = ["company", "title", "seniority", "stack", "location", "remote_policy", "employment_type",
        "salary_min", "salary_max", "salary_currency"]
#: Fields each board states itself; a null in one of these is a real "not stated".
HELD_OUT = {
    "hn": [],
    "habr": _ALL,
    "web3": ["company", "title", "stack", "location", "remote_policy"],
    "remotive": ["company", "title", "stack", "location", "employment_type"],
}


def _get(path, kind="string") -> Column:
    return F.try_variant_get("_json", f"$.{path}", kind)


def _kind(path) -> Column:
    return F.schema_of_variant(_get(path, "variant"))


def _titles(path) -> Column:
    titles = F.transform(_get(path, "array<variant>"), lambda x: F.try_variant_get(x, "$.title", "string"))
    return F.filter(titles, lambda t: t.isNotNull() & (t != ""))


def _by_source(**exprs) -> Column:
    out = F.lit(None)
    for source, expr in exprs.items():
        out = F.when(F.col("source") == source, expr).otherwise(out)
    return out


def _bound(path) -> Column:
    # The number as written; a zero or an empty text is no bound.
    shown = F.get_json_object("raw_text", f"$.{path}")
    absent = (F.when(_kind(path) == "STRING", shown == "").when(_kind(path) == "BOOLEAN", shown == "false")
              .otherwise(shown.try_cast("double") == 0))
    return F.when(~F.coalesce(absent, F.lit(False)), shown)


def _other_than(path, *kinds) -> Column:
    """Whether a value is stated and of another kind; nothing, zero and false state nothing."""
    kind, shown = _kind(path), F.get_json_object("raw_text", f"$.{path}")
    fits = F.lit(False)
    for k in kinds:
        fits = fits | kind.startswith(k)
    empty = shown.isin("", "false", "[]", "{}") | (shown.try_cast("double") == 0)
    return F.coalesce(~fits & (kind != "VOID") & ~F.coalesce(empty, F.lit(False)), F.lit(False))


def adapt_boards(df: DataFrame) -> DataFrame:
    """Add ``text``, the stated fields, ``held_out``, ``prefilter`` and ``adapter_error``.

    A row that cannot be read carries an error and nothing else; it never stops the job.
    """
    df = once(df, {"_json": F.when(F.col("source") != "hn", F.try_parse_json("raw_text"))})
    low, high = _get("salary.from"), _get("salary.to")
    unreadable = ((low.isNotNull() & values.number(low).isNull())
                  | (high.isNotNull() & values.number(high).isNull()))
    error = (F.when(F.col("source").isNull() | ~F.col("source").isin(list(vocab.SOURCES)),
                    F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))
             .when(F.col("source") == "hn", F.lit(None))
             .when(F.col("_json").isNull(), "text is not JSON")
             .when(~F.schema_of_variant("_json").startswith("OBJECT"), "text is not a JSON object")
             .when((F.col("source") == "habr") & _other_than("salary", "OBJECT"), "salary is not an object")
             .when((F.col("source") == "habr") & unreadable, "salary is not a number")
             .when((F.col("source") == "remotive") & _other_than("salary", "STRING"), "salary is not a text")
             .when((F.col("source") == "habr") & _other_than("remoteWork", "BOOLEAN", "STRING"), "remote work is neither a truth value nor a text")
             .when((F.col("source") == "web3") & _other_than("is_remote", "BOOLEAN", "STRING"), "remote work is neither a truth value nor a text"))
    df = once(df, {"adapter_error": error})

    flag = _by_source(habr=F.when(_kind("remoteWork") == "BOOLEAN", _get("remoteWork", "boolean")),
                      web3=F.when(_kind("is_remote") == "BOOLEAN", _get("is_remote", "boolean")))
    remote = values.remote_policy(_by_source(habr=_get("remoteWork"), web3=_get("is_remote")), flag)
    salary_text = text.strip(_get("salary"))
    listed = F.coalesce(F.when(F.col("source") == "habr", _titles("skills")).otherwise(
        _get("tags", "array<string>")), F.array().cast("array<string>"))
    place = F.array_join(_titles("locations"), ", ")
    held = F.create_map(*[x for s, names in HELD_OUT.items() for x in (
        F.lit(s), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])
    fields = {
        "_html": _by_source(hn=F.col("raw_text"), habr=_get("description_html"),
                           web3=_get("description"), remotive=_get("description")),
        "company": _by_source(habr=_get("company.title"), web3=_get("company"),
                              remotive=_get("company_name")),
        "title": _by_source(habr=_get("title"), web3=_get("title"), remotive=_get("title")),
        "seniority": F.when(F.col("source") == "habr", values.seniority(_get("qualification"))),
        "stack": F.when(F.col("source") != "hn", values.skills(listed)),
        "location": _by_source(habr=F.when(place != "", place), web3=_get("location"),
                               remotive=_get("candidate_required_location")),
        "remote_policy": F.when(F.col("source").isin("habr", "web3"), remote),
        "employment_type": F.when(F.col("source").isin("habr", "remotive"), values.employment(
            _by_source(habr=_get("employment"), remotive=_get("job_type")))),
        # Only this board's amounts are monthly by convention.
        "salary_min": F.when(F.col("source") == "habr", values.monthly(low, F.lit("month"))),
        "salary_max": F.when(F.col("source") == "habr", values.monthly(high, F.lit("month"))),
        "salary_currency": _by_source(
            habr=values.currency(_get("salary.currency")), web3=values.currency(_get("salary_currency")),
            remotive=values.first_currency(salary_text)),
        "salary_raw": _by_source(
            habr=F.when(_get("salary.formatted") != "", _get("salary.formatted")),
            web3=values.salary_bounds(_bound("salary_min_value"), _bound("salary_max_value")),
            remotive=F.when(salary_text != "", salary_text)),
    }
    usable = F.col("adapter_error").isNull()
    df = once(df, {name: F.when(usable, expr) for name, expr in fields.items()})
    df = clean_html(df, "_html").withColumns({
        "text": F.when(usable, F.col("text")),
        "held_out": F.when(usable, F.try_element_at(held, F.col("source"))),
        "salary_period_known": F.when(usable, F.col("source") == "habr"),
    }).drop("_json", "_html")
    return route(df).withColumn("prefilter", F.when(usable, F.col("prefilter")))
