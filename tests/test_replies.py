"""Replies: rules of the contract, fill-down, outcomes and replacement."""

import json

import pytest
from pyspark.sql import functions as F

from postlake.operators import extraction
from postlake.operators.quality import check_roles
from postlake.operators.replies import grounding, validate_replies
from postlake.operators.roles import embed_text, fan_out, persist
from postlake.schemas import REPLIES, ROLES, RUNS

OK = {"doc_type": "posting"}
Q = {"company": "c", "salary": "s", "title": "t"}


def checked(spark, *replies, **options):
    data = [(i, "m", r if isinstance(r, str) or r is None else json.dumps(r), None) for i, r in enumerate(replies)]
    return validate_replies(spark.createDataFrame(data, REPLIES), **options)


@pytest.mark.parametrize("reply, reasons", [
    (OK, []),
    ({**OK, "roles": []}, []),
    ("not json", ["reply is not a JSON object"]),
    ("[1]", ["reply is not a JSON object"]),
    ({}, ["doc_type: missing or unknown"]),
    ({"doc_type": None}, ["doc_type: missing or unknown"]),
    ({"doc_type": "advert"}, ["doc_type: missing or unknown"]),
    ({"doc_type": 5}, ["doc_type: missing or unknown"]),
    ({**OK, "bonus": 1}, ["unknown key: bonus"]),
    ({"doc_type": "candidate", "bonus": 1}, ["unknown key: bonus"]),
    ({"doc_type": "candidate", "company": 5, "roles": 7, "stack": "x", "title": None}, ["unknown key: title"]),
    ({"doc_type": "candidate", "company": 5, "roles": [{"zz": 1}], "stack": "x"}, []),
    ({"doc_type": "other", "source_quotes": {"wage": "x"}}, ["quote for no field: wage"]),
    ({**OK, "location": 5}, ["location: not a string"]),
    ({**OK, "location": None, "stack": None}, []),
    ({**OK, "stack": "java"}, ["stack: not a list of strings"]),
    ({**OK, "stack": " n/a "}, []),
    ({**OK, "stack": ["a", None]}, ["stack: not a list of strings"]),
    ({**OK, "stack": ["a", 1]}, ["stack: not a list of strings"]),
    ({**OK, "stack": []}, []),
    ({**OK, "roles": None}, ["roles: not a list"]),
    ({**OK, "roles": {}}, ["roles: not a list"]),
    ({**OK, "roles": [5]}, ["roles: not an object"]),
    ({**OK, "roles": [None]}, ["roles: not an object"]),
    ({**OK, "roles": [{"company": "x"}]}, ["unknown key: company"]),
    ({**OK, "roles": [{"seniority": 3}]}, ["seniority: not a string"]),
    ({**OK, "roles": [{"stack": ["a"]}, {"stack": [None]}]}, ["stack: not a list of strings"]),
    ({**OK, "source_quotes": None}, ["source_quotes: not a map of strings"]),
    ({**OK, "source_quotes": {"company": None}}, ["source_quotes: not a map of strings"]),
    ({**OK, "roles": [{"source_quotes": {"title": "a"}}, {"source_quotes": None}]},
     ["source_quotes: not a map of strings"]),
    ({**OK, "roles": [{"source_quotes": {"title": "a"}}, {"source_quotes": {"title": None}}]},
     ["source_quotes: not a map of strings"]),
    ({**OK, "salary_min": [1], "source_quotes": Q | {}}, ["salary_min: not a string or number", "quote for no field: title"]),
    ({**OK, "company": "A"}, ["no quote: company"]),
    ({**OK, "company": " N/A "}, []),
    ({**OK, "salary_max": 0}, ["no quote: salary"]),
    ({**OK, "salary_max": 5.5, "source_quotes": {"salary_max": "x"}}, ["no quote: salary"]),
    ({**OK, "salary_max": "9", "salary_min": 5, "source_quotes": {"salary": "x"}}, []),
    ({**OK, "roles": [{"title": "T"}]}, ["no quote: title"]),
    ({**OK, "roles": [{"title": "T", "source_quotes": {"title": "T", "company": "x"}}]}, ["quote for no field: company"]),
    ({**OK, "source_quotes": {"roles": "x", "doc_type": "y"}}, []),
])
def test_reasons(spark, reply, reasons):
    assert checked(spark, reply).first()["reasons"] == reasons


def test_non_postings_are_cleared(spark):
    r = checked(spark, {"doc_type": "candidate", "company": "A", "stack": ["x"], "roles": [{"title": "T"}],
                        "source_quotes": {"company": "q"}}).first()
    assert (r["company"], r["stack"], r["roles"], r["source_quotes"]) == (None, None, [], {"company": "q"})


def test_blank_and_units(spark):
    r = checked(spark, {**OK, "company": "none", "location": " Berlin\xa0", "salary_period": "year", "salary_currency": "$",
                        "roles": [{"seniority": "-", "salary_min": 7, "salary_period": "year",
                                   "source_quotes": {"salary": " 7 "}}, {"salary_currency": "$"}]}).first()
    assert (r["company"], r["location"], r["salary_period"], r["salary_currency"]) == (None, "Berlin", None, None)
    assert r["roles"][0]["salary_period"] == "year" and r["roles"][0]["source_quotes"] == {"salary": "7"}
    assert r["roles"][0]["seniority"] is None and r["roles"][1]["salary_currency"] is None


POSTING = {**OK, "company": "A", "stack": ["Golang"], "location": "X", "remote_policy": "hybrid", "salary_min": "$120k",
           "salary_period": "year", "salary_currency": "$", "source_quotes": {"company": "A", "salary": "p", "location": "X"}}


def fan(spark, reply, **options):
    return fan_out(checked(spark, reply, **options)).orderBy("role_index").collect()


def test_fill_down(spark):
    a, b, c = fan(spark, {**POSTING, "roles": [
        {"title": "T", "seniority": "Senior", "stack": ["K8s", "go"], "location": "Y",
         "source_quotes": {"title": "T", "location": "Y"}},
        {"salary_min": "50", "salary_max": 60, "salary_period": "hour", "source_quotes": {"salary": "r"}},
        {"salary_max": "lots", "source_quotes": {"salary": "r"}}]})
    assert (a["role_index"], a["company"], a["title"], a["seniority"], a["stack"]) == (
        0, "A", "T", "senior", ["go", "kubernetes"])
    assert (a["location"], a["remote_policy"], a["salary_min"], a["salary_max"], a["salary_currency"]) == (
        "Y", "hybrid", 10000, None, "USD")
    assert a["source_quotes"] == {"company": "A", "salary": "p", "location": "Y", "title": "T"}
    assert (b["title"], b["seniority"], b["salary_min"], b["salary_max"], b["salary_currency"]) == (
        None, "unknown", 8666, 10400, "USD")
    assert b["source_quotes"]["salary"] == "r"
    assert (c["salary_min"], c["salary_max"], c["salary_currency"]) == (None, None, None)


def test_fan_out_edges(spark):
    only = fan(spark, POSTING)
    assert len(only) == 1 and only[0]["salary_min"] == 10000 and only[0]["role_index"] == 0
    assert fan(spark, {"doc_type": "other"}) == []
    lost = {**OK, "salary_period": "year", "roles": [{"salary_min": 12, "source_quotes": {"salary": "x"}}]}
    assert fan(spark, lost)[0]["salary_min"] is None
    assert fan(spark, lost, keep_posting_period=True)[0]["salary_min"] == 1


def test_check_roles(spark):
    reply = {**POSTING, "roles": [{"salary_max": "$60k", "source_quotes": {"salary": "r"}},
                                  {"salary_max": "9999999M", "source_quotes": {"salary": "r"}}, {}]}
    got = check_roles(fan_out(checked(spark, reply))).orderBy("role_index").collect()
    assert [r["reason"] for r in got] == [["band_ordered"], ["max_fits"], []]


def test_grounding(spark):
    df = spark.createDataFrame([("we pay 5", {"salary": "pay 5", "title": "boss"}), ("boss", {"title": "boss"})],
                               "text string, source_quotes map<string,string>")
    assert {r["field"]: (r["quotes"], r["found"]) for r in grounding(df).collect()} == {
        "salary": (1, 1), "title": (2, 1)}


def test_process_and_persist(spark):
    long = "text " * 40
    raw = spark.createDataFrame(
        [(1, "hn", "1", long), (2, "hn", "2", "short"), (3, "web3", "3", "{bad"), (4, "hn", "4", long),
         (5, "hn", "5", long), (6, "hn", "6", long), (7, "hn", "7", long)],
        "raw_posting_id long, source string, external_id string, raw_text string").withColumn(
        "ingested_at", F.lit("2026-01-01").cast("timestamp"))
    runs = spark.createDataFrame([(7, "error", None, 0, "m", "x", None)], RUNS)
    replies = spark.createDataFrame([
        (1, "m", json.dumps({**POSTING, "roles": [{}, {"salary_max": "$6k", "source_quotes": {"salary": "z"}}]}), None),
        (6, "m", json.dumps({**POSTING, "roles": [{}, {}]}), None),
        (2, "m", json.dumps(POSTING), None), (4, "m", "{", None), (5, "m", None, "t" * 600)], REPLIES)
    old = {f.name: None for f in ROLES} | {"raw_posting_id": 1, "role_index": 5, "stack": [], "source_quotes": {}}
    roles = spark.createDataFrame([tuple(old.values())], ROLES)
    new_roles, new_runs, bad = extraction.process(raw, runs, roles, replies, "2026-01-02")
    got = {r["raw_posting_id"]: (r["status"], r["model"], r["doc_type"], r["role_count"]) for r in new_runs.collect()}
    assert got == {1: ("invalid", "m", None, 0), 6: ("ok", "m", "posting", 2), 2: ("ok", "prefilter", "other", 0), 3: ("error", "adapter", None, 0),
                   4: ("invalid", "m", None, 0), 5: ("error", "m", None, 0), 7: ("error", "m", None, 0)}
    assert len(new_runs.filter("raw_posting_id = 5").first()["error"]) == 500
    # One bad role fails its posting as a whole: old roles stay, all its new ones are rejected.
    assert sorted((r["raw_posting_id"], r["role_index"]) for r in new_roles.collect()) == [(1, 5), (6, 0), (6, 1)]
    assert sorted((r["role_index"], len(r["reason"])) for r in bad.collect()) == [(0, 0), (1, 1)]
    assert new_runs.filter("raw_posting_id = 1").first()["error"] == "role 1: band_ordered"
    # An invalid second attempt keeps the roles, a good one replaces them.
    out = spark.createDataFrame([(1, "invalid", None, 0, "m", "e", None)], RUNS).drop("extracted_at")
    kept, after = persist(new_roles, new_runs, new_roles.limit(0), out, "2026-01-03")
    assert kept.count() == 3 and after.filter("raw_posting_id = 1").first()["status"] == "invalid"
    out = out.withColumn("status", F.lit("ok"))
    kept, _ = persist(new_roles, new_runs, new_roles.limit(0), out, "2026-01-03")
    assert kept.count() == 2


def test_embed_text(spark):
    text = embed_text(fan_out(checked(spark, POSTING))).first()["embed_text"]
    assert text == "A\nX\nhybrid\ngo"
