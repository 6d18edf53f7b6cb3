"""Hosts without labelled pages are judged by the levels above."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from hourgrid.llm import catalogue, url_reputation  # noqa: E402


def test_unseen_hosts_back_off(spark):
    outcomes = [(f"a{i}.bad.org", 1) for i in range(5) for _ in range(60)]
    outcomes += [(f"b{i}.good{j}.org", 0) for i in range(4) for j in range(4) for _ in range(40)]
    table = spark.createDataFrame(outcomes, "host string, bad int")
    unseen = ["new.bad.org", "new.good1.org", "new.other.org", "more.other.org", "q.zz", "", None]
    hosts = spark.createDataFrame([(h,) for h in [*unseen, "a1.bad.org", "q.zz"]], "host string")
    found = url_reputation.host_reputation(table, hosts=hosts)
    by_host = {r["host"]: r for r in found.collect()}
    assert found.count() == len(by_host) == 21 + 5
    assert by_host["new.bad.org"]["blocked"] and not by_host["new.good1.org"]["blocked"]
    assert by_host["new.other.org"]["posterior_mean"] == by_host["more.other.org"]["posterior_mean"]
    assert by_host["q.zz"]["posterior_mean"] == round(300 / len(outcomes), 6)
    assert {by_host[h]["n"] for h in unseen[:5]} == {0}
    labelled = {r["host"]: r for r in url_reputation.host_reputation(table).collect()}
    assert all(by_host[h] == r for h, r in labelled.items())
    none = url_reputation.host_reputation(table.limit(0), hosts=hosts).collect()
    assert {r["blocked"] for r in none} == {None}


def test_every_page_with_a_host_has_a_posterior(spark):
    sf = "/root/testdata/sf0.001"
    pages = catalogue.table(spark, sf, "pages")
    labelled = url_reputation.host_reputation(catalogue._page_outcomes(spark, sf, pages))
    before = url_reputation.judge_urls(pages, catalogue.RULES, labelled)
    after = catalogue.op1_url_reputation(spark, sf)
    assert before.where("posterior_mean IS NULL AND host <> ''").count() > 0
    assert after.where("posterior_mean IS NULL AND host <> ''").count() == 0
    assert before.where("labelled > 0").exceptAll(after).count() == 0 and after.count() == before.count()


def test_awkward_pages(spark):
    """Null and repeated ids, no url, a column whose name the operator uses, and no pages at all."""
    rows = [(1, "http://a.com/x", 1), (1, "http://a.com/x", 2), (None, None, 3), (2, "no scheme", 4), (3, "HTTP://New.Bad.org?q", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    known = url_reputation.host_reputation(spark.createDataFrame([("bad.org", 1)] * 300 + [("good.net", 0)] * 300, "host string, bad int"), hosts=pages.select(url_reputation.host_of(F.col("url")).alias("host")))
    found = url_reputation.judge_urls(pages, catalogue.RULES, known)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()), key=str) == [
        (1, "a.com", "/x", "com/", "allow"),
        (1, "a.com", "/x", "com/", "allow"),
        (2, "", "", None, "allow"),
        (3, "new.bad.org", "", None, "block"),
        (None, "", "", None, "allow"),
    ]
    assert url_reputation.judge_urls(pages.limit(0), catalogue.RULES, known).count() == 0
