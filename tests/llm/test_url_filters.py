from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siembra.llm.queries import URL_RULES
from siembra.llm.url_filters import filter_urls, parse_rules


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])] if rest.startswith("/") else ""
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (h or not host):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


URLS = ["http://www.example.com/en/1", "https://a.www.example.com/en/x?y#z", "http://example.com/fr/", "HTTP://Example.COM/en/", "http://x.net/es/1", "http://net/fr/1", "http://xnet/es/", "http://com/", "http://com", "no scheme", "", None, "http://", "ftp://a.b.net/fr/?q", "http://example.org/en/", "http://x.com?a=/en/", "http://é.net/es/ñ", "a://b://c.com/"]


@pytest.mark.parametrize("slots", [1, 7, 1024])
def test_contract_rules(spark, slots):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[4]), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    rules = parse_rules(spark.createDataFrame(URL_RULES, "rule string, verdict string"))
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, rules, slots=slots).collect()), key=str)
    assert got == sorted(((i, *judge(u, URL_RULES)) for i, u in rows), key=str)


def test_random_nested_rules(spark):
    rng = random.Random(3)
    host = lambda n: ".".join(rng.choice("abc") for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "a", "b"]) for _ in range(rng.randint(0, 4)))
    rules = list({f"{host(3)}/{path()}": None for _ in range(60)})
    rules = [(r, rng.choice(["allow", "block"])) for r in rules]
    rows = [(k, f"http://{host(5)}/{path()}") for k in range(500)] + [(k, "http://a.b.c/ab/a") for k in range(500, 800)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = filter_urls(df, parse_rules(spark.createDataFrame(rules, "rule string, verdict string")), slots=16).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got if r["rule"]) == sorted((i, *judge(u, rules)) for i, u in rows if judge(u, rules)[2])
    assert len(got) == len(rows)


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = parse_rules(spark.createDataFrame([], "rule string, verdict string"))
    assert filter_urls(pages, rules).collect() == []
    (row,) = filter_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules, default="block").collect()
    assert (row["rule"], row["verdict"]) == (None, "block")
