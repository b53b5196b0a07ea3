"""URL parsing, rules and reputations."""

import pytest
from pyspark.sql import functions as F

from floorloom.llm import urlfilter

URLS = [
    (None, "", ""), ("no scheme", "", ""), ("http://A.Example.NET", "a.example.net", ""), ("x://h?q=/p", "h", ""), ("http://h#f", "h", ""), ("http://h/p?q#f", "h", "/p"),
    ("http://É.com/A", "É.com", "/A"), ("http:///p", "", "/p"), ("a://b://c/d", "b:", "//c/d"), ("h\n://x.org/fr/1", "x.org", "/fr/1"),
]


def test_parsing(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string").select(urlfilter.host_of(F.col("url")).alias("h"), urlfilter.path_of(F.col("url")).alias("p"))
    assert [(r["h"], r["p"]) for r in df.collect()] == [(h, p) for _, h, p in URLS]


@pytest.mark.parametrize("host, path, rule", [
    ("net", "/", "net/"), ("a.net", "/x", "net/"), ("a.net", "", None), ("internet", "/", None), ("example.net", "/en/1", "example.net/en/"), ("m.example.net", "/en", "net/"),
    ("example.com", "/de/", "example.com/de/"), ("xexample.com", "/de/", None), ("a.b.org", "/fr/9", "org/fr/"), ("a.org", "/en/", None),
])
def test_rules(spark, host, path, rule):
    got, verdict = urlfilter.rule_for(F.lit(host), F.lit(path))
    row = spark.range(1).select(got.alias("r"), verdict.alias("v")).first()
    assert row["r"] == rule and (row["v"] is None) == (rule is None)


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.example.com", "example.com", "com"), ("shop.firm.co.uk", "firm.co.uk", "co.uk"), ("firm.co.uk", "firm.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"),
    ("x.co.com", "co.com", "com"), ("localhost", "localhost", "localhost"), ("uk", "uk", "uk"), ("", "", ""), ("a.de", "a.de", "de"),
])
def test_registered_domains(spark, host, domain, suffix):
    got = urlfilter.registered(F.lit(host))
    assert tuple(spark.range(1).select(got[0].alias("d"), got[1].alias("s")).first()) == (domain, suffix)


def outcomes(spark, spec):
    return spark.createDataFrame([(f"http://{h}/p", b) for h, good, bad in spec for b in [0] * good + [1] * bad], "url string, bad int")


def test_shrinkage(spark):
    seen = outcomes(spark, [("good.a.com", 200, 2), ("also.a.com", 150, 1), ("bad.b.com", 5, 95), ("worse.b.com", 2, 60), ("one.c.org", 0, 1), ("fine.c.org", 90, 0)])
    pages = spark.createDataFrame([(k, f"http://{h}/x", "e") for k, h in enumerate(["good.a.com", "bad.b.com", "new.b.com", "one.c.org", "else.where", "new.a.com"])] + [(9, None, "e")], "page_id long, url string, mean string")
    rows = {r["host"]: r for r in urlfilter.judge(pages, seen).collect()}
    assert rows["bad.b.com"]["verdict"] == "block" and rows["good.a.com"]["verdict"] == "allow"
    assert rows["new.b.com"]["bad_rate"] > rows["new.a.com"]["bad_rate"]  # an unknown host inherits its domain
    assert rows["one.c.org"]["bad_rate"] < 0.9  # one outcome is shrunk
    assert rows["bad.b.com"]["bound"] < rows["bad.b.com"]["bad_rate"]
    assert len(rows) == 7 and rows[""]["verdict"] == "allow" and rows["bad.b.com"]["mean"] == "e"


def test_no_labels_and_no_pages(spark):
    none = spark.createDataFrame([], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    row = urlfilter.judge(pages, none).first()
    assert row["bad_rate"] == 0.5 and row["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, "http://a.com/", "h", "n")], "page_id long, url string, _host string, _host_name string")
    row = urlfilter.judge(odd, none).first()
    assert row["_host"] == "h" and row["_host_name"] == "n" and row["host"] == "a.com"
