import itertools
import re

import pytest
from pyspark.sql import functions as F

from voicelane.llm import catalog, url_rules

URLS = [
    ("https://A.Example.NET/en/x?q=1#t", "a.example.net", "/en/x"),
    ("http://example.com?x=/de/", "example.com", ""),
    ("http://example.com#/de/", "example.com", ""),
    ("http://example.com/de/a?b://c", "example.com", "/de/a"),
    ("no scheme here/en/", "", ""),
    ("x://y://z/p", "y:", "//z/p"),
    ("://host/path", "host", "/path"),
    ("http://", "", ""),
    ("http://ÄB.org/fr/é", "Äb.org", "/fr/é"),
    ("http://net/", "net", "/"),
    ("http://internet/", "internet", "/"),
    ("http://a\nb.net/p\nq", "a\nb.net", "/p\nq"),
    ("", "", ""),
    (None, "", ""),
]


def expected_rule(host, path):
    best = None
    for kind, own_host, own_path in catalog.PAGE_RULES:
        if (host == own_host or host.endswith("." + own_host)) and path.startswith(own_path):
            if best is None or len(own_host + own_path) > len(best[1]):
                best = (kind, own_host + own_path)
    return best


def test_parts_and_explicit_rules(spark):
    pages = [(i, u, "x") for i, (u, *_) in enumerate(URLS)]
    pages += [(100 + i, f"http://{h}{p}", "x") for i, (h, p) in enumerate(itertools.product(
        ["net", "a.net", "example.net", "a.example.net", "example.com", "b.example.com", "x.org", "xorg"],
        ["", "/", "/en", "/en/", "/de/1", "/fr/"],
    ))]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "1 AS `row`", "2 AS host", "3 AS rule")
    labels = spark.createDataFrame([], "id bigint, bad boolean")
    found = {r["page_id"]: r for r in url_rules.judged(frame, labels, catalog.PAGE_RULES).collect()}
    assert len(found) == len(pages)
    for i, (_, host, path) in enumerate(URLS):
        assert (found[i]["host"], found[i]["path"]) == (host, path)
    for page, *_ in pages:
        row = found[page]
        rule = expected_rule(row["host"], row["path"])
        assert (row["rule"], row["verdict"]) == ((rule[1], rule[0]) if rule else (None, "allow"))


def tokens(url):
    """Written anew, to check against."""
    scheme, _, rest = url.partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = rest.partition("?")[2].partition("#")[0]
    found = {f"scheme:{scheme.lower()}"} | {f"host:{h}" for h in host.lower().split(".") if h}
    return found | {f"path:{p}" for p in path.split("/") if p} | {f"key:{k.split('=')[0]}" for k in query.split("&") if k}


def labelled_pages(count):
    hosts = ["spam.shop.test", "news.test", "blog.news.test", "shop.test"]
    sections = ["win", "en", "de"]
    rows = []
    for i in range(count):
        host, section = hosts[i % 4], sections[i // 4 % 3]
        bad = (section == "win" and "shop" in host) or i % 17 == 0
        rows.append((i, f"https://{host}/{section}/{i}?ref={i % 2}", bad))
    return rows


def test_mined_rules_match_brute_force(spark):
    rows = labelled_pages(240)
    frame = spark.createDataFrame(rows, "id bigint, url string, bad boolean")
    taught = frame.select(url_rules.tokens(F.col("url")).alias("tokens"), "bad")
    assert [set(r["tokens"]) for r in taught.collect()] == [tokens(u) for _, u, _ in rows]
    found = {frozenset(r["antecedent"]): r["confidence"] for r in url_rules.mined(taught, 0.02, 5, 0.7).collect()}
    sets = [(tokens(u), b) for _, u, b in rows]
    expected = {}
    least = max(0.02, 5 / len(rows)) * len(rows)
    for size in range(1, 7):
        for combo in {c for own, b in sets if b for c in itertools.combinations(sorted(own), size)}:
            have = [b for own, b in sets if own >= set(combo)]
            if sum(have) >= least and sum(have) / len(have) >= 0.7:
                expected[frozenset(combo)] = sum(have) / len(have)
    assert expected and found == pytest.approx(expected)


def test_rules_reach_pages_without_label(spark):
    rows = labelled_pages(240)
    pages = [(i, u) for i, u, _ in rows] + [(1_000, "http://spam.shop.test/win/new"), (1_001, "http://news.test/en/new")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "id bigint, bad boolean")
    result = url_rules.judged(frame, labels, [])
    found = {r["page_id"]: r["verdict"] for r in result.collect()}
    assert found[1_000] == "block" and found[1_001] == "allow"
    assert "Python" not in result._jdf.queryExecution().toString()


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, True)], "id bigint, bad boolean")
    assert url_rules.judged(pages, labels, catalog.PAGE_RULES).collect() == []
