from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import url_filter as uf


def judged(spark, urls, listed=()):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    return {r.page_id: r for r in uf.judge(df, uf.RULES, keys).collect()}


def test_rules(spark):
    urls = ["https://A.Example.COM/en/8", "http://example.com/en/7x?y", "http://x.net/de/", "http://b.example.net/de/81#z", "http://org/es/", "http://badexample.com/fr/", "nothing", None, "http://com", "x://y://z/en/", "http://?/en/", "ftp://Ünï.com/EN/"]
    got = judged(spark, urls)
    want = [("a.example.com", "/en/8", "com/en/", "block"), ("example.com", "/en/7x", "example.com/en/7", "allow"), ("x.net", "/de/", "net/de/", "allow"), ("b.example.net", "/de/81", "example.net/de/8", "block"), ("org", "/es/", "org/es/", "block"), ("badexample.com", "/fr/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"), ("y:", "//z/en/", None, "allow"), ("", "", None, "allow"), ("Ünï.com".replace("U", "u"), "/EN/", None, "allow")]
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == want


def test_lists_hold_domains_and_what_is_below(spark):
    got = judged(spark, ["http://spam.org/", "http://a.b.spam.org/x", "http://notspam.org/", "http://org/", "http://spam.org.de/", "http://" + "a." * 400 + "spam.org/", "http://spam.org/es/"], ["spam.org", "spam.org", None, "x.y.z.w"])
    assert [got[k].verdict for k in range(7)] == ["block", "block", "allow", "allow", "allow", "block", "block"]


@pytest.mark.parametrize(("n", "m"), [(1, 2000), (300, 3000), (1500, 500), (40, 0)])
def test_cascades_are_exact(spark, n, m):
    keys = spark.range(n + m).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < n).alias("listed"))
    cascade = uf.Cascade.build(keys)
    assert keys.where(cascade.has(F.col("key")) != F.col("listed")).count() == 0
    assert len(cascade.levels) >= 1 if n else not cascade.levels


def test_long_lists_are_dealt_into_shares(spark, monkeypatch):
    monkeypatch.setattr(uf, "LITERAL_BITS", 1000)
    rows = spark.range(500).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"))
    listed = spark.range(0, 600, 3).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("key"))
    got = {r.host for r in uf.on_list(rows, listed).where("listed").collect()}
    assert got == {f"h{k}.com" for k in range(0, 500, 3)}
    monkeypatch.setattr(uf, "PASS_SHARES", 2)
    assert {r.host for r in uf.on_list(rows, listed).where("listed").collect()} == got


def test_empty_tables_and_clashing_columns(spark):
    assert judged(spark, []) == {} and judged(spark, ["http://a/"])[0].verdict == "allow"
    df = spark.createDataFrame([(1, "http://spam.org/", "x", "y"), (1, "http://spam.org/", "x", "y"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    rows = uf.judge(df, uf.RULES, spark.createDataFrame([("spam.org",)], "key string")).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in rows) == [(0, "allow"), (1, "block"), (1, "block")]
    rows = uf.judge(df, uf.RULES, spark.createDataFrame([("spam.org",)], "key string"))
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().toString())


def test_many_rules_say_the_same(spark, monkeypatch):
    """On both sides of what one expression holds, a table of rules gives what the expression does."""
    rng = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "a.x.net", "org"]
    rules = [uf.Rule(rng.choice(("allow", "block")), rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(250)]
    urls = [f"http://{rng.choice(('', 'q.', 'a.'))}{rng.choice(hosts)}/{''.join(rng.choice('ab/') for _ in range(5))}" for _ in range(200)] + ["nothing", None, "http://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "key string")
    monkeypatch.setattr(uf, "FEW_RULES", 1000)
    want = sorted(tuple(r) for r in uf.judge(df, rules, none).collect())
    monkeypatch.setattr(uf, "FEW_RULES", 249)
    assert sorted(tuple(r) for r in uf.judge(df, rules, none).collect()) == want and len({r[3] for r in want}) > 20
