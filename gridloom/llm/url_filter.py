"""URL rules, and exact domain lists held in a cascade of Bloom filters.

The first filter holds the listed domains; the second those other domains of the corpus
that the first one takes for listed; the third the listed ones that the second holds
by mistake; and so on until no mistake is left. Over the keys of the corpus and the
list, the parity of the first filter that lacks a key tells whether it is listed,
without error and without a join: filters are literals of the expression. A list that
needs more than ``LITERAL_BITS`` in its first filter is dealt into shares by a hash of
the key, each with a cascade of its own; the cascades of ``PASS_SHARES`` shares, 32 MB in
their first filters, are applied in one pass over the rows.

Everything runs on built-in functions.

Rows: a null URL, or one without ``://``, has an empty host and path, fits no rule and
is on no list. Urls of any length are read whole. Repeated rows and null ids make no
difference; further columns, of any name, are not read. Null keys of the list are left
out. Of two rules of equal length that fit, allow yields to block, then the host and path
that sort last win. An empty table of pages gives an empty one; an empty list lists nothing.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.llm.bloom import Bloom
from gridloom.llm.common import near

#: Bits of a first filter, at most; shares whose cascades are applied together; rules that are one expression.
LITERAL_BITS, PASS_SHARES, FEW_RULES = 1 << 23, 32, 200


class Rule(NamedTuple):
    """Allow or block a host with its subdomains, where the path starts so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as (name, verdict); null without one. Of equal length, the last by verdict, host and path."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def with_ruling(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) and the rule that each fits.

    A few rules are one expression. More are a table: each distinct host gets the rules of
    its domains, best first, and a row takes the first of its host's whose path it begins with.
    """
    if len(rules) <= FEW_RULES:
        return rows.withColumn("ruled", ruling(rules, F.col("host"), F.col("path")))
    spark = rows.sparkSession
    ranked = [(k, r.host, r.path, r.name, r.verdict) for k, r in enumerate(sorted(set(rules), key=lambda r: (len(r.name), r), reverse=True))]
    table = spark.createDataFrame(ranked, "rank int, domain string, start string, name string, verdict string")
    labels = max(r.host.count(".") + 1 for r in rules)
    hosts = rows.select("host").distinct().select("host", F.explode(domains(F.col("host"), labels)).alias("domain"))
    mine = hosts.join(near(table), "domain").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "start", "name", "verdict"))).alias("mine"))
    rows = rows.join(mine, "host", "left")
    first = F.get(F.filter("mine", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    return rows.withColumn("ruled", F.when(first.isNotNull(), F.struct(first["name"].alias("name"), first["verdict"].alias("verdict")))).drop("mine")


def domains(host: Column, labels: int) -> Column:
    """A host and the domains above it that have at most ``labels`` labels; a longer host alone is left out."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.greatest(n - (labels - 1), F.lit(1)), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


class Cascade:
    """Exact membership for the keys that it was built over."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, keys: DataFrame, seed: int = 0) -> Cascade:
        """From (key, listed), each key once. A level leaves about half of the mistakes, so that few levels follow."""
        mine, others = cut(keys.where("listed").select("key")), cut(keys.where(~F.col("listed")).select("key"))
        n, rest = mine.count(), others.count()
        levels: list[Bloom] = []
        error = min(0.5, max(1e-4, n / max(rest, 1) / math.sqrt(2)))
        while n:
            levels.append(Bloom.of(mine, n, error, seed + len(levels)))
            mine, others = cut(others.where(levels[-1].has(F.col("key")))), mine
            n, error = mine.count(), 0.5
        return cls(levels)

    def has(self, key: Column) -> Column:
        """Whether a key is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def on_list(rows: DataFrame, listed: DataFrame, host_col: str = "host", out: str = "listed") -> DataFrame:
    """``rows`` with a flag: whether their host, or a domain above it, is a key of ``listed`` (column ``key``)."""
    listed = cut(listed.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct())
    facts = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("key", r"\.", -1))).alias("labels")).first()
    if not facts["n"]:
        return rows.withColumn(out, F.lit(False))
    labels = facts["labels"]
    corpus = rows.select(F.col(host_col).alias("host")).distinct().select(F.explode(domains(F.col("host"), labels)).alias("key"))
    keys = cut(corpus.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")))
    shares = -(-facts["n"] * 20 // LITERAL_BITS)
    share = F.pmod(F.xxhash64("key", F.lit("share")), F.lit(shares))
    rows = rows.withColumn(out, F.lit(False))
    for first in range(0, shares, PASS_SHARES):
        cascades = {k: Cascade.build(keys.where(share == k), seed=1000 * k) for k in range(first, min(first + PASS_SHARES, shares))}

        def hit(key: Column, cascades: dict[int, Cascade] = cascades) -> Column:
            of = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(shares))
            found = F.lit(False)
            for k, cascade in cascades.items():
                found = F.when(of == k, cascade.has(key)).otherwise(found)
            return found

        rows = rows.withColumn(out, F.col(out) | F.exists(domains(F.col(host_col), labels), lambda d: hit(d)))
        if first + PASS_SHARES < shares:
            rows = cut(rows)
    return rows


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest fitting rule's verdict, else block if a domain is listed, else allow."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = with_ruling(on_list(rows, listed, "host", "listed"), rules)
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.name").alias("rule"), verdict.alias("verdict"))


# Fixed values of the query: its rules, and the domains of its list.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def listed_domains(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_CASES = " ".join(f"WHEN {_FITS.format(r.host, r.path)} THEN '{{{k}}}'" for k, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].name)))
ORACLE = f"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {_CASES.format(*(r.name for r in RULES))} END AS rule,
  CASE {_CASES.format(*(r.verdict for r in RULES))}
    WHEN regexp_matches(host, '(^|\\.)({'|'.join(d.replace('.', '[.]') for d in LISTED)})$') THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""
