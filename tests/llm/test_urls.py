import pytest
from pyspark.sql import functions as F

from grantrisk.llm import urls
from grantrisk.llm.queries import URL_RULES

CASES = [
    ("http://Example.ORG/es/x?y#z", "example.org", "/es/x", "example.org/es/", "block"),
    ("https://a.example.org/en/12", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"),
    ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"), ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    ("http://x.org", "x.org", "", None, "allow"), ("http://x.org?q=/es/", "x.org", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http://com/de/\nx", "com", "/de/\nx", "com/de/", "block")]


def test_host_path_and_rule(spark):
    df = spark.createDataFrame([(i, c[0], "x", "x") for i, c in enumerate(CASES)], "page_id long, url string, host string, upper string")
    none = spark.createDataFrame([], "host string, good boolean")
    got = {r.page_id: r for r in urls.filter_urls(df, none, URL_RULES).collect()}
    assert [(c[0], *[got[i][k] for k in ("host", "path", "rule", "verdict")]) for i, c in enumerate(CASES)] == CASES


def test_reputation_shrinks_and_blocks(spark):
    rows = [("bad.spam.com", False)] * 60 + [("bad.spam.com", True)] * 2 + [("few.spam.com", False)] + [("mail.example.co.uk", True)] * 3
    rows += [(f"h{i}.good.net", True) for i in range(50)] * 3 + [("h1.good.net", None), (None, True)]
    df = spark.createDataFrame(rows, "host string, good boolean")
    got = {r.host: r for r in urls.host_reputation(df).collect()}
    assert (got["mail.example.co.uk"].domain, got["mail.example.co.uk"].suffix) == ("example.co.uk", "co.uk")
    assert got["h1.good.net"].n == 3 and got[""].n == 1
    assert got["bad.spam.com"].upper < 0.5 < got["h1.good.net"].lower
    bad, few = got["bad.spam.com"], got["few.spam.com"]
    assert few.mean < 0.5 < got["h1.good.net"].mean and few.upper - few.lower > bad.upper - bad.lower
    pages = df.where("host is not null").select(F.concat(F.lit("http://"), "host", F.lit("/p")).alias("url"))
    verdicts = {r.host: r.verdict for r in urls.filter_urls(pages, df, ()).collect()}
    assert verdicts["bad.spam.com"] == "block" and verdicts["h1.good.net"] == "allow"


def test_strength_of_equal_and_of_spread_rates(spark):
    even = spark.createDataFrame([(100.0, 50.0)] * 20, "n double, k double")
    spread = spark.createDataFrame([(100.0, 5.0), (100.0, 95.0)] * 10, "n double, k double")
    assert urls.prior_strength(even, 2.0, 1000.0) == 1000.0
    assert urls.prior_strength(spread, 0.1, 1000.0) == pytest.approx(0.2, abs=0.2)


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "host string, good boolean")
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(pages, none, URL_RULES).count() == 0
    twice = spark.createDataFrame([(1, "http://a.de/")] * 2, "page_id long, url string")
    assert urls.filter_urls(twice, none, URL_RULES).count() == 2


def test_pages_take_the_labels_of_the_documents_they_show(spark):
    good, bad, shared = "a clean sentence of some length\nand another  one, 5 < 6 & so on", "xx ## broken text of some length", "Released under one and the same licence"
    docs = [(1, f"{good}\n{shared}"), (2, f"{bad}\n{shared}"), (3, "no label here but long enough"), (4, None), (None, bad), (2, f"{bad}\n{shared}")]
    labels = [(1, 1), (2, 0), (9, 1), (5, None), (None, 1)]
    show = lambda text: "<b>" + text.replace("&", "&amp;").replace("<", "&lt;").replace("\n", "<br><p>") + "</b>"
    pages = [("http://g.com/", show(good)), ("http://b.com/", show(bad)), ("http://n.com/", show("no label here but long enough")),
             ("http://few.com/", show(bad + "\n" + "a text of its own that is " * 5)), ("http://s.com/", show(shared)), ("http://nul.com/", None), (None, show(good))]
    out = urls.outcomes_of(spark.createDataFrame([(*p, "x", "x") for p in pages], "url string, html string, page string, p string"),
                           spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.host: r.good for r in out.collect()}
    # the shared line is good in one of the three labelled rows that hold it
    assert got == {"g.com": True, "b.com": False, "n.com": None, "few.com": None, "s.com": False, "nul.com": None, "": True}


def test_a_planted_bad_host_is_blocked_and_a_clean_one_of_its_domain_is_not(spark):
    rows = [(f"h{i % 40}.clean{i % 9}.net", i % 8 != 0) for i in range(800)] + [("bad.shop.com", i % 20 == 0) for i in range(60)]
    rows += [("fine.shop.com", True)] * 60 + [("once.shop.com", False)] + [("10.0.0.1", False)] * 30 + [("10.0.0.2", True)] * 30
    outcomes = spark.createDataFrame(rows, "host string, good boolean")
    wanted = {"bad.shop.com": "block", "user:pw@bad.shop.com:8080": "block", "bad.shop.com.": "block", "fine.shop.com": "allow",
              "once.shop.com": "allow", "h1.clean1.net": "allow", "10.0.0.1:80": "block", "10.0.0.2": "allow", "new.shop.com": "allow"}
    pages = spark.createDataFrame([(f"http://{h}/x",) for h in wanted], "url string")
    assert {r.host: r.verdict for r in urls.filter_urls(pages, outcomes, ()).collect()} == wanted


def test_bounds_are_near_those_of_the_beta_posterior(spark):
    import numpy as np
    rows = [("a.x.com", i < 45) for i in range(50)] + [("b.y.com", i < 4) for i in range(12)] + [("c.z.com", i < 300) for i in range(310)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, good boolean"), least_strength=5.0, most_strength=5.0).collect()}
    rng = np.random.default_rng(0)
    for r in got.values():
        a = r.mean * (r.n + 5)
        low, high = np.quantile(rng.beta(a, r.n + 5 - a, 200000), [0.05, 0.95])
        assert abs(r.lower - low) < 0.03 and abs(r.upper - high) < 0.03
