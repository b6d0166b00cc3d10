"""Landed payloads of the four boards, and the load from end to end."""

import json

import pytest
from pyspark.sql import functions as F

from postlake.operators.adapt import adapt_boards
from postlake.operators.normalise import quarantine
from postlake.operators.quality import check_raw
from postlake.sources import landed, load
from postlake.sources.snapshots import read_role, read_snapshot, write_role, write_snapshot

HN = {"title": "Ask HN: Who is hiring?", "created_at": "2026-08-01T00:30:00+03:00", "children": [
    {"id": 1, "text": " <p>Acme | Dev\xa0", "created_at": "2026-08-02T10:00:00Z", "extra": [1]},
    {"id": 2, "text": None, "created_at": "2026-08-02T10:00:00Z"},
    {"id": 3, "text": " \n", "created_at": "2026-08-02T10:00:00Z"},
    {"id": 4, "text": "no time", "created_at": ""}]}
REMOTIVE = {"jobs": [{"id": 11, "title": "T", "company_name": "C", "tags": ["JS"], "job_type": "full_time",
                      "publication_date": "2026-07-31T23:30:00", "salary": " $5k ", "description": "<p>x</p>",
                      "candidate_required_location": "EU"}]}
WEB3 = ["banner", {"tos": 1}, [{"id": 21, "title": "W", "company": "C", "tags": ["defi", "Rust"], "location": "X",
                                "is_remote": True, "date_epoch": 1785542400, "salary_min_value": "1000",
                                "salary_max_value": None, "salary_currency": "usd", "description": "d"}]]
CARD = {"id": 31, "title": "H", "publishedDate": {"date": "2026-08-01T00:30:00+03:00"}, "company": {"title": "Co"},
        "qualification": "Middle", "skills": [{"title": "Golang"}, {"title": ""}, {}, "x"],
        "locations": [{"title": "A"}, {"title": "B"}], "remoteWork": False, "employment": "full_time",
        "salary": {"from": 0, "to": 75000.4, "currency": "rur", "formatted": ""}}
HABR = {"list": [CARD, {**CARD, "id": 32}, CARD], "meta": {"totalPages": 1}}


def write(folder, name, *docs):
    folder = folder / name
    folder.mkdir()
    for i, doc in enumerate(docs):
        text = doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False)
        (folder / f"{i}.json").write_text(text, encoding="utf-8")
    return str(folder)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*[F.col(c).cast("string") for c in cols]).collect())


def read(spark, tmp_path, source, *docs):
    return landed.read_landed(spark, write(tmp_path, source, *docs), source)


def test_hn(spark, tmp_path):
    df = landed.flatten_hn(read(spark, tmp_path, "hn", HN))
    assert rows(df, "external_id", "raw_text", "thread_month", "posted_at") == [
        ("1", "<p>Acme | Dev", "2026-08-01", "2026-08-02 10:00:00"), ("4", "no time", "2026-08-01", None)]
    good, bad = quarantine(check_raw(df))
    assert good.count() == 1 and bad.first()["reason"] == ["posted_at_set"]


def test_remotive(spark, tmp_path):
    df = landed.flatten_remotive(read(spark, tmp_path, "remotive", REMOTIVE, {"other": 1}))
    assert rows(df, "external_id", "thread_month", "posted_at") == [("11", "2026-07-01", "2026-07-31 23:30:00")]
    assert json.loads(df.first()["raw_text"]) == REMOTIVE["jobs"][0]


def test_web3(spark, tmp_path):
    df = read(spark, tmp_path, "web3", WEB3, ["a", []], {"no": 1}, ["a", "b", {}], "{bad")
    assert rows(landed.flatten_web3(df), "external_id", "thread_month", "posted_at") == [
        ("21", "2026-08-01", "2026-08-01 00:00:00")]
    assert landed.shape_errors(df).count() == 4


def test_habr(spark, tmp_path):
    df = read(spark, tmp_path, "habr", HABR, {"list": {}, "meta": {}}, {"list": []}, [])
    assert rows(landed.flatten_habr(df), "external_id", "thread_month", "posted_at", "position") == [
        ("31", "2026-08-01", "2026-07-31 21:30:00", "0"), ("31", "2026-08-01", "2026-07-31 21:30:00", "2"),
        ("32", "2026-08-01", "2026-07-31 21:30:00", "1")]
    assert landed.shape_errors(df).count() == 3


def test_latest_thread(spark):
    df = spark.createDataFrame([("1", "Ask HN: Who is HIRING?", "2026-07"), ("2", "who is hiring (Aug)", "2026-08"),
                                ("3", "Freelancer?", "2026-09")], "id string, title string, created_at string")
    assert landed.latest_thread(df).first()["id"] == "2"
    with pytest.raises(Exception, match="no hiring thread"):
        landed.latest_thread(df.filter("id = '3'")).collect()


@pytest.mark.parametrize("html, expected", [
    ('<div class="a b"> x<div>y</div>z </div><div class="b">no</div>', "x<div>y</div>z"),
    ("<div class='b'><!-- </div> --><p>k</p></div>t", "<!-- </div> --><p>k</p>"),
    ('<script>"<div class=b>"</script><div class=b>v</div>', "v"),
    ('<div class="bb">no</div>', None), ("plain", None), (None, None),
    ('<div class="b">open <div>end</div>', "open <div>end</div>"),
    ('<DIV id="1" class="x b">up</DIV>', "up"), ('<div class="b"></div>', ""),
    ("<div>" * 3 + '<div class="b">' + "<div>d</div>" * 500 + "</div></div>", "<div>d</div>" * 500),
])
def test_extract_block(spark, html, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert landed.extract_block(df, "html", "div", "b").first()["block"] == expected


def test_adapt_boards(spark, tmp_path):
    cards = landed.flatten_habr(read(spark, tmp_path, "habr", HABR)).filter("position < 2")
    details = spark.createDataFrame([("31", '<p>say "hi"</p>')], "external_id string, description_html string")
    enriched = landed.enrich_details(cards, details)
    assert landed.missing_details(enriched).first().asDict() == {"cards": 2, "missing": 1, "alarm": True}
    raw = [("web3", "21", json.dumps(WEB3[2][0])), ("remotive", "11", json.dumps(REMOTIVE["jobs"][0])),
           ("hn", "1", "<p>" + "long text " * 20), ("hn", "2", "short"), ("hn", "3", " [DEAD] " + "x" * 200),
           ("web3", "b", "{bad"), ("web3", "l", "[1]"), ("adzuna", "c", "{}"),
           ("habr", "s", json.dumps({**CARD, "salary": {"from": "много"}})), ("habr", "so", json.dumps({**CARD, "salary": [7]})),
           ("habr", "sn", json.dumps({**CARD, "salary": None, "remoteWork": False})), ("habr", "rw", json.dumps({**CARD, "remoteWork": {"a": 1}})),
           ("remotive", "rs", json.dumps({**REMOTIVE["jobs"][0], "salary": 5000})), ("remotive", "rz", json.dumps({**REMOTIVE["jobs"][0], "salary": 0})),
           ("web3", "wr", json.dumps({**WEB3[2][0], "is_remote": 2})), ("web3", "wb", json.dumps({**WEB3[2][0], "salary_min_value": False}))]
    df = spark.createDataFrame(raw, "source string, external_id string, raw_text string").unionByName(
        enriched.select("source", "external_id", "raw_text"))
    out = {r["external_id"]: r for r in adapt_boards(df).collect()}
    h = out["31"]
    assert (h["text"], h["company"], h["title"], h["seniority"], h["stack"]) == (
        'say "hi"', "Co", "H", "mid", ["go"])
    assert (h["location"], h["remote_policy"], h["employment_type"], h["salary_min"], h["salary_max"]) == (
        "A, B", "unknown", "full-time", 0, 75000)
    assert (h["salary_currency"], h["salary_raw"], len(h["held_out"]), h["salary_period_known"]) == (
        "RUB", None, 10, True)
    assert out["32"]["prefilter"] == "other" and out["32"]["text"] == ""
    w = out["21"]
    assert (w["stack"], w["remote_policy"], w["salary_raw"], w["salary_min"]) == (["rust"], "remote", "from 1000", None)
    r = out["11"]
    assert (r["stack"], r["salary_raw"], r["salary_currency"], r["remote_policy"], r["prefilter"]) == (
        ["javascript"], "$5k", "USD", None, None)
    assert [out[i]["prefilter"] for i in "123"] == [None, "other", "other"]
    assert out["1"]["held_out"] == [] and out["1"]["stack"] is None
    assert {k: out[k]["adapter_error"] for k in ("b", "l", "c", "s", "1")} == {
        "b": "text is not JSON", "l": "text is not a JSON object", "c": "unknown source: adzuna",
        "s": "salary is not a number", "1": None}
    told = {k: out[k]["adapter_error"] for k in ("so", "sn", "rw", "rs", "rz", "wr", "wb")}
    neither = "remote work is neither a truth value nor a text"
    assert told == {"so": "salary is not an object", "sn": None, "rw": neither, "rs": "salary is not a text", "rz": None, "wr": neither, "wb": None}
    assert out["wb"]["salary_raw"] is None and out["rz"]["salary_raw"] in (None, "0")


def test_load_all(spark, tmp_path):
    root = str(tmp_path / "db")
    paths = {"hn": write(tmp_path, "hn", HN), "remotive": write(tmp_path, "remotive", REMOTIVE),
             "web3": write(tmp_path, "web3", {"broken": 1}),
             "habr": write(tmp_path, "habr", {**HABR, "list": [*HABR["list"], {"id": 33, "publishedDate": {"date": "soon"}}]})}
    pages = spark.createDataFrame([("31", '<div class="vacancy-description__text">D</div>')],
                                  "external_id string, html string")
    as_of = "2026-08-10"

    def run():
        return {r["source"]: r for r in load.load_all(spark, paths, root, as_of, pages=pages).collect()}

    first = run()
    assert {s: (r["inserted"], r["failed"], r["error"] is None) for s, r in first.items()} == {
        "hn": (1, 1, True), "remotive": (1, 0, True), "web3": (0, 0, False), "habr": (2, 1, True)}
    assert (first["habr"]["cards"], first["habr"]["missing"], first["habr"]["alarm"]) == (3, 2, True)
    assert [r["reason"] for r in spark.read.parquet(f"{root}/raw/habr/rejects/*").collect()] == [["posted_at_set"]]
    again = run()
    assert all(r["inserted"] == r["updated"] == 0 for r in again.values())
    assert again["remotive"]["unchanged"] == 1 and again["habr"]["unchanged"] == 0
    stored = {r["external_id"]: r for r in load.read_raw(spark, root).collect()}
    assert set(stored) == {"1", "11", "31", "32"}
    assert json.loads(stored["31"]["raw_text"])["description_html"] == "D"
    assert json.loads(stored["32"]["raw_text"])["description_html"] is None
    with pytest.raises(RuntimeError):
        load.load_all(spark, {"web3": paths["web3"]}, root, as_of)

    with pytest.raises(PermissionError):
        load.purge_dataset(spark, root, as_of, apply=True)
    write_role(spark, root, "eval")
    with pytest.raises(PermissionError):
        load.purge_dataset(spark, root, as_of, apply=True)
    write_role(spark, root, "live")
    ids = load.read_raw(spark, root).selectExpr("xxhash64(source, external_id) AS raw_posting_id", "external_id")
    write_snapshot(ids, f"{root}/roles")
    later = "2026-10-31"  # ninety days after 2 August
    preview = {r["source"]: r["going"] for r in load.purge_dataset(spark, root, later).collect()}
    assert preview == {"hn": 0, "remotive": 1, "habr": 2}
    assert load.read_raw(spark, root).count() == 4
    load.purge_dataset(spark, root, later, apply=True)
    assert [r["external_id"] for r in load.read_raw(spark, root).collect()] == ["1"]
    assert [r["external_id"] for r in read_snapshot(spark, f"{root}/roles").collect()] == ["1"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert read_snapshot(spark, root) is None
    assert [write_snapshot(spark.range(n), root) for n in (1, 2)] == [1, 2]
    (tmp_path / "t" / "v=0000000003").mkdir()  # a write that was lost half way
    assert read_snapshot(spark, root).count() == 2 and read_snapshot(spark, root, 1).count() == 1
    with pytest.raises(LookupError):
        read_snapshot(spark, root, 3)
    assert write_snapshot(spark.range(3), root) == 4
    with pytest.raises(PermissionError):
        read_role(spark, root)


def test_write_gold(spark, tmp_path):
    df = spark.createDataFrame([("hn", "1", "é")], "source string, external_id string, raw_text string").withColumn(
        "posted_at", F.lit("2026-08-01T00:00:00Z").cast("timestamp"))
    load.write_gold(df, str(tmp_path / "g"), 7, {"hn": 1}, ["1"], ["9", "8"])
    assert spark.read.json(str(tmp_path / "g/rows")).first().asDict() == {
        "source": "hn", "external_id": "1", "raw_text": "é", "posted_at": "2026-08-01T00:00:00.000000Z"}
    meta = spark.read.json(str(tmp_path / "g/meta")).first()
    assert (meta["seed"], meta["counts"]["hn"], meta["excluded"]) == (7, 1, ["8", "9"])


def test_a_board_that_fails_is_no_result(spark, tmp_path, monkeypatch):
    """One board may fail and cost only its rows; the queries that show what the loads told do not show its zeros."""
    from postlake.plans import landing

    at = spark.sql("SELECT timestamp '2024-01-30'").first()[0]
    rows = spark.createDataFrame([(i, str(i), f"text {i}", at) for i in range(4)], "id long, external_id string, raw_text string, posted_at timestamp")
    real = load.load_source

    def broken(spark, source, *args):
        if source == "web3":
            raise ValueError("no such board")
        return real(spark, source, *args)

    monkeypatch.setattr(landing, "postings", lambda *_: rows)
    monkeypatch.setattr(landing, "table", lambda *_: spark.createDataFrame([], "doc_id long, lang string"))
    monkeypatch.setattr(load, "load_source", broken)
    with pytest.raises(RuntimeError, match="web3 failed: no such board"):
        landing.load_counts(spark, "")
    told = load.load_all(spark, {"hn": write(tmp_path, "hn", HN), "web3": "nowhere"}, str(tmp_path / "db"), "2026-08-10")
    web3 = told.filter("source = 'web3'").first()
    assert (web3["inserted"], web3["unchanged"], web3["cards"], web3["alarm"], web3["error"]) == (0, None, None, None, "no such board")
    assert load.complete(told.filter("source = 'hn'")).columns == ["source", *load.COUNTS]
