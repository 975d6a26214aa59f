import itertools
import math
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from shellac.llm import queries, url_rules


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://A.Example.NET/En/1?x=/y#z", ("a.example.net", "/En/1")), ("http://x.net", ("x.net", "")), ("http://x.net?q", ("x.net", "")), ("x.net/a", ("", "")), (None, ("", "")), ("", ("", "")),
    ("a://b://c/d", ("b:", "//c/d")), ("http://É.net/É", ("É.net", "/É")), ("://", ("", "")),
])
def test_split(url, want):
    assert url_rules.split_url(url) == want


def brute_rule(host, path, rules):
    fits = [r for r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=len, default=None)


def test_rules_by_host_and_longest():
    m = url_rules.Matcher(url_rules.DEFAULT_RULES, [])
    for host in ("net", "a.net", "example.net", "b.example.net", "notexample.net", "example.com", "x.example.com", "org", "q.org", "xorg", "", ".", "a..net", "net.", "anet"):
        for path in ("", "/", "/en/", "/en/1", "/en", "/de/x", "/fr/", "/fr/9"):
            assert m.rule(host, path)[0] == brute_rule(host, path, url_rules.DEFAULT_RULES), (host, path)


def frame(spark, rows):
    return spark.createDataFrame(rows, "tokens array<string>, blocked boolean")


def test_mining_finds_a_planted_rule_and_the_index_equals_brute_force(spark):
    urls = [(f"https://{'spam' if i % 3 == 0 else 'good'}.site{i % 5}.org/{'buy' if i % 2 else 'read'}/{i}", i % 3 == 0 and i % 7 > 0) for i in range(300)]
    df = spark.createDataFrame(urls, "url string, blocked boolean")
    rules = url_rules.mine(url_rules.tokenise(df, "blocked"))
    assert {g: round(r.confidence, 1) for r in rules for g in r.groups}[frozenset({"host=spam"})] == 0.8
    assert all(len(r.groups) == 1 and "spam" in t for r in rules for g in r.groups for t in g)  # the host, and its sites one by one
    rules.append(url_rules.MinedRule((frozenset({"path=buy"}), frozenset({"host=site1", "site=good.site1"})), 0.7, 0.1))
    got = {r["url"]: r for r in url_rules.judge(df, rules, {}).collect()}
    for url, _ in urls:
        own = set(url_rules.url_tokens(url))
        assert (got[url]["verdict"] == "block") == any(all(g & own for g in r.groups) for r in rules)
    assert {r["verdict"] for r in got.values()} == {"allow", "block"}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (1, None, "c"), (None, "", "c"), (2, "https://a.net/" + "x" * 100_000, "c")], "page_id long, url string, host string")
    got = url_rules.judge(df, [])
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "mined_rule"]
    assert sorted((r["host"], r["verdict"]) for r in got.collect()) == [("", "allow"), ("", "allow"), ("", "allow"), ("a.net", "block")]
    assert url_rules.judge(df.limit(0), []).count() == 0
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, blocked boolean")) == []
    assert url_rules.mine(spark.createDataFrame([(None, True), (["a"], None), ([], True)], "tokens array<string>, blocked boolean")) == []


def test_query_has_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = queries.op3_url_filter(spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path = url_rules.split_url(urls[r["page_id"]])
        rule = brute_rule(host, path, url_rules.DEFAULT_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == url_rules.DEFAULT_RULES[rule] if rule else r["verdict"] in ("allow", "block")
    assert pages.where(F.col("url").isNull()).count() == 0


def test_no_rule_is_lost_behind_a_long_shape(spark):
    """One shape of fourteen constant tokens holds 2**14 sets of confidence 1, a host blocked in 80 % has less."""
    long = [f"shape{i}" for i in range(14)]
    rows = [(long, True)] * 400 + [(["host=spam"], i % 5 > 0) for i in range(200)] + [(["host=good"], False)] * 600
    assert {(r.groups, r.confidence) for r in url_rules.mine(frame(spark, rows))} == {((frozenset(long),), 1.0), ((frozenset(["host=spam"]),), 0.8)}


def test_every_token_of_a_shape_blocks_alone_and_long_urls_are_quick(spark):
    few = "https://a.net/x?" + "&".join(f"k{x}=1" for x in "abcdefgh")
    many = "https://b.net/y?" + "&".join(f"m{i}z=1" for i in range(60))
    urls = [(few, True)] * 5 + [(many, True)] * 500 + [(f"https://ok{i}.com/p{i}", False) for i in range(2000)]
    rules = url_rules.mine(url_rules.tokenise(spark.createDataFrame(urls, "url string, blocked boolean"), "blocked"))
    seen = spark.createDataFrame([("https://q.org/z?kbb=1",), ("https://q.org/z?kb=1",), ("https://q.org/z?m7z=1",), ("https://q.org/z?other=1",)], "url string")
    assert [r["verdict"] for r in url_rules.judge(seen, rules, {}).collect()] == ["allow", "block", "block", "allow"]


def test_chance_makes_no_rules(spark):
    """Labels that have nothing to do with the tokens."""
    r = random.Random(4)
    rows = [([f"t{r.randrange(60)}" for _ in range(6)], r.random() < 0.25) for _ in range(1500)]
    assert url_rules.mine(frame(spark, rows)) == []


def test_precision_on_pages_that_were_not_mined(spark):
    r = random.Random(5)
    rows = [([f"t{r.randrange(60)}" for _ in range(6)], r.random() < 0.1) for _ in range(1500)]
    rows = [(t, b or {"t1", "t2"} <= set(t) and r.random() < 0.95 or "t9" in t and r.random() < 0.85) for t, b in rows]
    rules = url_rules.mine(frame(spark, rows[:1000]))
    hits = [b for t, b in rows[1000:] if any(m.fits(set(t)) for m in rules)]
    assert rules and len(hits) > 20 and sum(hits) / len(hits) > 0.7


def brute_rules(rows, least, min_confidence, z, false_rules):
    """Minimal passing token sets, each with the sets that stand on the same pages."""
    pages, base = len(rows), sum(b for _, b in rows) / len(rows)
    tokens = sorted({t for own, _ in rows for t in own})
    at = {t: frozenset(i for i, (own, _) in enumerate(rows) if t in own) for t in tokens}
    counted = {}
    for k in range(1, len(tokens) + 1):
        for own in itertools.combinations(tokens, k):
            hit = frozenset.intersection(*[at[t] for t in own])
            b = sum(rows[i][1] for i in hit)
            if b >= least:
                counted[frozenset(own)] = (len(hit), b)
    tests = url_tests(counted, at, min_confidence)
    passed = set()
    for own, (n, b) in counted.items():
        p = b / n
        lower = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        bound = b * math.log(p / base) + ((n - b) * math.log((1 - p) / (1 - base)) if b < n else 0)
        if lower >= min_confidence and p > base and bound >= math.log(tests / false_rules):
            passed.add(own)
    assert pages
    return {own for own in passed if not any(x < own for x in passed)}


def url_tests(counted, at, min_confidence):
    """Items, and sets of mixed items that FP-growth hands out."""
    items = {at[t]: t for own in counted if len(own) == 1 for t in own}
    mixed = {t for t in items.values() if counted[frozenset([t])][1] < counted[frozenset([t])][0]}
    return len(items) + (sum(own <= mixed and b / n >= min_confidence for own, (n, b) in counted.items()) if len(mixed) > 1 else 0)


@pytest.mark.parametrize("seed", range(3))
def test_mining_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [([t for t in "abcdef" if r.random() < 0.5], r.random() < 0.2) for _ in range(200)]
    rows = [(t + ["twin"] * ("a" in t), b or {"a", "b", "c"} <= set(t) and r.random() < 0.9 or {"d", "e"} <= set(t) and r.random() < 0.7) for t, b in rows]
    want = brute_rules(rows, 5, 0.5, 1.0, 5.0)
    got = url_rules.mine(frame(spark, rows), min_confidence=0.5, z=1.0, false_rules=5.0)
    assert {frozenset(x) for m in got for x in itertools.product(*m.groups)} == want and any(len(x) > 1 for x in want)
