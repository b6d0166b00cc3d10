"""Verdicts equal those of trying every rule on every URL."""

import random

from postlake.llm import urls

FIELDS = "id long, url string, row int, _range int, `a.b` string"


def _brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[:min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
        path = rest[len(host):]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


def _check(spark, found, rules):
    pages = spark.createDataFrame([(i, u, i, 7, "z") for i, u in enumerate(found)], FIELDS).repartition(3)
    got = urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["id", "url", "row", "_range", "a.b", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(found)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == _brute(r.url, rules), r
        assert (r["row"], r._range, r["a.b"]) == (r.id, 7, "z")


def test_random_rules_equal_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "a-b", "ab", "", "é", "com", "x"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))

    def path():
        return "".join(rng.choice(["/", "a", "b", "/a", "é"]) for _ in range(rng.randrange(5)))
    rules = {(host(), "/" * rng.randrange(2) + path()): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    found = [f"http://{host()}{rng.choice(['/', '/', '?', '#', ''])}{path()}{rng.choice(['', '?a/b', '#x'])}" for _ in range(400)]
    _check(spark, found + ["http://a.com/" + "ab" * 3] * 200, rules)


def test_edges(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block"), ("a", None, "block"), ("NET", "/", "allow")]
    found = [None, "", "example.net/en/", "http://example.net", "http://example.net?/en/", "http://example.net/en/x", "http://EXAMPLE.net/EN/", "http://xexample.net/en/",
             "http://net/", "http://network/", "http://net-a/", "http://a.org/fr/" + "y" * 100_000, "http://é.net/é", "ftp://u@net:80/", "x\ny://net/a\nb?c", "http://net/://org/fr/", "://net/"]
    _check(spark, found + found, rules[:-1])
    _check(spark, found, [])
    assert urls.judge(spark.createDataFrame([], FIELDS), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    twice = urls.judge(spark.createDataFrame([(1, "http://net/", 1, 1, "")], FIELDS), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert twice.first().verdict == "block"  # equal rules: the greatest verdict
