"""Personal data by patterns of form and by bootstrapped patterns of context.

Form: e-mail addresses, IPv4 addresses, payment cards and international phone numbers
are matched leftmost and without overlap for each kind. The expressions below match
what the contract's do, but in linear time and without recursion: a match begins where
a run of its first characters begins, or right after the match before it, and repeats
take what they can and do not go back. (The form of cards fits a lone digit as well,
which is no card.)

Context: numbers parted by blanks alone ("+1 (555) 123-4567", cards in groups of four)
are one word here. Words that begin with a whole match are the seeds, and the match is
the instance. The patterns of an identifier-like word (one with a digit or an @) are the
one and two words in front of it, the one and two behind it, and the words on both
sides; a pattern is known by a 64-bit hash of its words. Patterns and instances form a
graph that is scored in rounds:

* a pattern's confidence for a kind is the score of the instances that stand in it over
  all words of the corpus that do, whatever they are; it counts only with ``support``
  distinct instances that score at least ``accept``;
* an instance's score for a kind is 1 for a seed, else one minus the product of one
  minus the confidences of its confident patterns.

Instances that score ``accept`` at the end are identifiers of that kind wherever they
stand in a confident pattern; of two kinds the more confident one counts, then the last
by name. Everything runs on built-in functions; graph tables are keyed by pattern or
instance and summed before they are shuffled, and no text or list of words is.

Rows: a null or empty text has no spans; texts of any length are read whole. A document
is known by its id and a hash of its text, so that repeated rows and rows with equal or
null ids get their own results. No rows give no rows. Further columns may have any names.
Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.llm.bloom import Bloom
from gridloom.llm.common import near, small

#: Fixed values of the contract: kinds in order.
KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"

#: Bits of the filter that keys of patterns pass before they are shuffled, at most.
FILTER_BITS = 1 << 23


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:  # i counts from the right, from 0
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """Whether a match of a kind's form counts."""
    if kind == "ip":
        return s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(s)).between(14, 19), _luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, rank, end) of a kind's valid matches."""
    form = F.lit(FORMS[kind])
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    found = F.arrays_zip(F.split(text, FORMS[kind], -1).alias("gap"), F.regexp_extract_all(text, form, F.lit(0)).alias("hit"))

    def add(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        keep = x["hit"].isNotNull() & valid(kind, x["hit"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    worth = text.rlike(FORMS[kind])
    return F.when(F.contains(text, F.lit(sign)) & worth if sign else worth, F.aggregate(found, zero, add)["out"]).otherwise(empty)


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base): spans by form, ordered by start and kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.coalesce(text_col, F.lit("")).alias("t"))
    return rows.select("id", "h", F.array_sort(F.concat(*(_spans(F.col("t"), k) for k in KINDS))).alias("base"))


#: Where words begin: behind blanks, but not inside a run of numbers (the word in front has no letter and ends in a digit or bracket).
_BEGIN = r"(?<=\s)(?=\S)(?!(?=(?:- )?\(?[0-9])(?<=[0-9)](?: -)? {1,3})(?<![\p{L}@]\S{0,40} {1,3}))"


def _words(text: Column) -> Column:
    """A text's words, each with the blanks behind it; leading blanks are a word of their own, runs of numbers are one."""
    return F.split(text, _BEGIN)


def _core(word: Column) -> Column:
    """A word without blanks and the punctuation around it."""
    return F.regexp_replace(word, r"^[^\p{L}0-9+]++|(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")


def _plain(word: Column) -> Column:
    """A word as part of a pattern, without blanks."""
    return F.replace(F.lower(F.trim(word)), F.lit(" "), F.lit("_"))


def _seed(core: Column) -> Column:
    """(kind, span) of the first kind whose form a word begins with, if the match counts; else null."""
    hits = [(k, F.regexp_extract(core, f"^(?:{FORMS[k]})", 0)) for k in KINDS]
    return F.coalesce(*(F.when((hit != "") & valid(k, hit), F.struct(F.lit(k).alias("kind"), hit.alias("span"))) for k, hit in hits))


def _context(w: Column, i: Column) -> Column:
    """Keys of the patterns around slot ``i`` (from 0) of the plain words ``w``; null for those that the text's edge cuts off."""
    left, far, right, beyond = (F.get(w, i + d) for d in (-1, -2, 1, 2))
    sides = [("l", left), ("ll", far, left), ("r", right), ("rr", right, beyond), ("lr", left, right)]

    def key(kind: str, *words: Column) -> Column:
        there = words[0].isNotNull()
        for word in words[1:]:
            there = there & word.isNotNull()
        return F.when(there, F.xxhash64(F.lit(kind), *words))

    return F.array(*(key(*side) for side in sides))


def _trimmed(w: Column) -> Column:
    return F.transform(w, lambda x: F.regexp_replace(x, r"\s+$", ""))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, i, core, patterns): identifier-like words and the keys of the patterns around them."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    w = F.col("w")
    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).rlike("[0-9@]"))
    rows = rows.select("id", "h", _trimmed(_words(F.col("t"))).alias("w"))
    rows = rows.select("id", "h", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), _core(F.get(w, i)).alias("core"), F.transform(F.sequence(i - 2, i + 2), lambda j: _plain(F.get(w, j))).alias("near")))).alias("x"))
    rows = rows.select("id", "h", "x.*").where(F.col("core").rlike(r"[\p{L}0-9]"))
    return rows.select("id", "h", "i", "core", F.array_compact(_context(F.col("near"), F.lit(2))).alias("patterns"))


def pattern_counts(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """(pattern, total): how many words of the corpus, of whatever kind, stand in each given pattern.

    Keys are counted before they are shuffled; those that are no given pattern go before
    that, by a broadcast of the patterns or by a Bloom filter where they are too many.
    """
    w = F.col("w")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.transform(_words(F.col(text_col)), lambda x: _plain(F.regexp_replace(x, r"\s+$", ""))).alias("w"))
    keys = rows.select("w", F.posexplode("w").alias("i", "word")).select(F.explode(_context(w, F.col("i"))).alias("pattern"))
    if small(patterns):
        return keys.join(F.broadcast(patterns), "pattern").groupBy("pattern").agg(F.count("*").alias("total"))
    some = Bloom.of(patterns.select(F.col("pattern").alias("key")), patterns.count(), 0.01, 7, FILTER_BITS)
    return keys.where(F.col("pattern").isNotNull() & some.has(F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern")


def bootstrap(docs: DataFrame, rounds: int = 3, confidence: float = 0.5, accept: float = 0.6, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, i, kind): the words that context, not form, tells to be identifiers of a kind."""
    seen = cut(occurrences(docs, id_col, text_col))
    edges = seen.select("core", F.explode("patterns").alias("pattern")).groupBy("core", "pattern").agg(F.count("*").alias("n"))
    forms = seen.select("core").distinct().withColumn("seed", _seed(F.col("core"))).where("seed is not null")
    forms = cut(forms.select("core", F.col("seed.kind").alias("kind"), F.col("seed.span").alias("span")))
    longer = cut(forms.where("core <> span").select("core", "span"))  # words that go on behind the match
    edges = cut(edges.join(near(longer), "core", "left").groupBy(F.coalesce("span", "core").alias("core"), "pattern").agg(F.sum("n").alias("n")))
    often = cut(edges.groupBy("pattern").agg(F.count("*").alias("distinct")).where(F.col("distinct") >= support).select("pattern"))
    totals = cut(pattern_counts(docs, often, text_col))
    edges = cut(edges.join(near(totals), "pattern"))
    seeds = cut(edges.select("core").distinct().join(forms.groupBy(F.col("span").alias("core")).agg(F.min("kind").alias("kind")), "core"))
    scores = seeds.select("core", "kind", F.lit(1.0).alias("score"))
    sure = None
    for _ in range(rounds):
        scored = edges.join(scores, "core")
        sums = scored.groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.count_if(F.col("score") >= accept).alias("good"), F.first("total").alias("total"))
        sure = cut(sums.where((F.col("good") >= support) & (F.col("mass") >= confidence * F.col("total"))).select("pattern", "kind", F.least(F.col("mass") / F.col("total"), F.lit(0.999)).alias("confidence")))
        reached = edges.join(near(sure), "pattern").groupBy("core", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        fresh = reached.join(seeds.select("core"), "core", "left_anti")
        scores = cut(seeds.select("core", "kind", F.lit(1.0).alias("score")).unionByName(fresh))
    new = cut(scores.join(seeds.select("core"), "core", "left_anti").where(F.col("score") >= accept).select("core", "kind"))
    # Few words are new: what they are not goes before patterns are spread out.
    spots = seen.join(near(new), "core").select("id", "h", "i", "kind", F.explode("patterns").alias("pattern")).join(near(sure), ["pattern", "kind"])
    best = F.max_by("kind", F.struct("confidence", "kind"))
    return spots.groupBy("id", "h", "i").agg(best.alias("kind"))


def added_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id2, h2, added): spans that context tells, of the documents that have any."""
    new = cut(bootstrap(docs, id_col=id_col, text_col=text_col, **options))
    few = new.select(F.col("id").alias("id2"), F.col("h").alias("h2")).distinct()
    # Where the new words stand in their texts: running lengths, of the documents concerned only.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows = rows.join(near(cut(few)), F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left_semi")
    rows = rows.dropDuplicates(["id", "h"]).select("id", "h", F.posexplode(_words(F.col("t"))).alias("i", "word"))
    rows = rows.select("id", "h", "i", "word", F.expr("sum(length(word)) over (partition by id, h order by i) - length(word)").alias("offset"))
    new = new.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("i").alias("i2"), "kind")
    placed = rows.join(new, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("i") == F.col("i2")))
    core = _core(F.regexp_replace("word", r"\s+$", ""))
    start = (F.col("offset") + F.length(F.regexp_extract("word", r"^[^\p{L}0-9+]*", 0))).cast("int")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = placed.groupBy("id", "h").agg(F.collect_list(F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(core)).alias("end"))).alias("added"))
    return added.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "added")


def _joint(base: Column, added: Column) -> Column:
    """All spans by form, and those by context that touch none of them."""
    apart = F.filter(added, lambda a: ~F.exists(base, lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return F.when(added.isNull(), base).otherwise(F.array_sort(F.concat(base, apart)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, h, base, spans): spans by form, and all spans; both as (start, rank of the kind, end)."""
    base = base_spans(docs, id_col, text_col)
    added = added_spans(docs, id_col, text_col, **options)
    both = base.join(added, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    return both.select("id", "h", "base", _joint(F.col("base"), F.col("added")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, with each identifier in the text replaced by its kind; null texts stay null."""
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    plain = rows.columns
    key, text = (plain[names.index(c)] for c in (id_col, text_col))
    added = cut(added_spans(rows, key, text, **options))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(_spans(F.coalesce(text, F.lit("")), k) for k in KINDS))))
    rows = rows.join(near(added), F.col(key).eqNullSafe(F.col("id2")) & (F.xxhash64(text) == F.col("h2")), "left")
    masked = redacted(F.col(text), _joint(F.col("base"), F.col("added")))
    return rows.select(*(masked.alias(c) if c == text else F.col(c) for c in plain)).toDF(*names)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counts() -> list[Column]:
    """How many base spans there are of each kind."""

    def of(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]


def form_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What form alone tells: the counts of each kind and the digest of the spans."""
    found = base_spans(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), *_counts(), F.sha2(listed(F.col("base")), 256).alias("base_sha256"))


#: The same in SQL.
_SQL_FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {n} AS rank, regexp_extract_all(t, '{f}') AS m, string_split_regex(t, '{f}') AS g FROM d" for n, (k, f) in enumerate(_SQL_FORMS.items()))
ORACLE_FORMS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({_MATCHES}),
e AS (SELECT doc_id, kind, rank, m, g, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0),
s AS (SELECT doc_id, kind, rank, m[i] AS h, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
v AS (SELECT *, regexp_replace(h, '[^0-9]', '', 'g') AS n FROM s),
ok AS (
  SELECT doc_id, kind, rank, a, a + length(h) AS z FROM v
  WHERE kind = 'email' OR (kind = 'phone' AND length(n) BETWEEN 10 AND 15)
    OR (kind = 'ip' AND regexp_full_match(h, '{_PART}(\.{_PART}){{3}}'))
    OR (kind = 'card' AND length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(n)), lambda j:
      CASE WHEN j % 2 = 0 THEN CAST(n[length(n) - j] AS INTEGER) WHEN CAST(n[length(n) - j] AS INTEGER) > 4 THEN 2 * CAST(n[length(n) - j] AS INTEGER) - 9 ELSE 2 * CAST(n[length(n) - j] AS INTEGER) END)) % 10 = 0)),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) AS spans FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN by_doc USING (doc_id)
"""


def contract_rows(docs: DataFrame, **options) -> DataFrame:
    """The query's columns."""
    found = find(docs, **options)
    return found.select(F.col("id").alias("doc_id"), *_counts(), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans replaced by its first kind in brackets."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.get(kinds, s["rank"]))
        return F.struct(F.when(s["start"] >= done["at"], more).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, zero, add)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
