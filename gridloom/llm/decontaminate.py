"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings (term, document, position) of the training texts. A phrase
is found from its rarest terms: a posting of the rarest one and a posting of the next
rarer one that stands where the phrase wants it (their lists, adjusted by the
phrase's offsets, are intersected) make a candidate, whose other words are then held
against the words around the posting. Windows of an item that overlap share these
two terms and their distance, and are looked up together.

Postings are needed only of terms that phrases are looked up by, so that two passes
over the texts build the index: corpus counts of all the phrases' terms, and then the
postings of the two rarest terms of each phrase. Benchmarks do not grow with the
training data; their tables are broadcast if their measured size allows, and else words
are counted or filtered before they are shuffled, without the texts they stand in.
Whatever grows with the training data is keyed by document.

All of it runs on built-in functions.

Rows: a document is known by its id and a hash of its text, so that repeated rows and
rows with equal or null ids each get their own result. A null or empty text has no words
and is never hit; items without words are in no document; an item without an id hits
like any other, but is not named. Texts of any length are read whole. Repeated items
are one. No documents give no rows; without items nothing is hit. Further columns are
not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.lineage import cut
from gridloom.llm.bloom import Bloom
from gridloom.llm.common import near, small

#: Fixed values of the contract: what stands between words, words of a window, and the share of hit words (1 in n).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHARE = 13, 20

#: Bits of the filter that words pass before they are shuffled, at most; fewer than its keys need let more words pass.
FILTER_BITS = 1 << 23


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none.

    Each byte of the text's UTF-8 becomes one character. Lowering these maps A-Z, and
    lead bytes of two-byte characters to bytes that begin longer ones; as their number
    of continuation bytes still tells them apart, different words stay different. (``lower``
    on the text itself would change other letters, too.)
    """
    octets = F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1")
    return F.array_remove(F.split(F.lower(octets), BETWEEN), "")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, w): a document's key and its words."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), words(F.col(text_col)).alias("w"))


def phrases_of(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, items): each distinct window of ``size`` words and the items, as strings, that have it.

    An item of fewer words, but not none, is one window. Windows of items with a null id
    count like others, but have no item to name.
    """
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    windows = rows.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("phrase"))
    return windows.groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, c): how often each of the given terms stands in the documents; absent ones are left out.

    Counted before anything is shuffled, so that a frequent word is one row of each task.
    """
    words = documents.select(F.explode("w").alias("term"))
    if small(terms):
        return words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("c"))
    return words.groupBy("term").agg(F.count("*").alias("c")).join(terms, "term")


def postings(documents: DataFrame, terms: DataFrame, reach: int = 0) -> DataFrame:
    """(term, id, h, pos, around): where the given terms stand, from 0.

    With ``reach``, terms whose column ``lead`` is true come with so many words to either
    side. Where the terms are too many to be broadcast, words that a Bloom filter does
    not take for terms go first; what is shuffled has the words around, never the text.
    """
    spread = documents.select("id", "h", "w", F.posexplode("w").alias("pos", "term"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice(F.col("w"), first + 1, F.col("pos") + reach - first + 1) if reach else F.lit(None).cast("array<string>")
    if small(terms):
        met = spread.join(F.broadcast(terms), "term").withColumn("around", around)
    else:
        terms = terms.groupBy("term").agg(*(F.max(c).alias(c) for c in terms.columns if c != "term")) if reach else terms.distinct()
        terms = cut(terms)
        filtered = Bloom.of(terms.select(F.col("term").alias("key")), terms.count(), 0.01, 11, FILTER_BITS)
        met = spread.where(filtered.has(F.col("term"))).select("term", "id", "h", "pos", around.alias("around")).join(terms, "term")
    return met.select("term", "id", "h", "pos", F.when(F.col("lead"), F.col("around")).alias("around") if reach else "around")


def lookups(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(t1, t2, apart, windows): the term pairs that phrases are looked up by, and the phrases of each.

    A phrase with a term that the corpus lacks is nowhere and left out. A phrase of one
    word has no second term. ``windows`` holds (offset of t1, n, phrase, items). Of terms
    that are equally rare the first by name counts as rarer.
    """
    offsets = phrases.select("phrase", "items", F.posexplode("phrase").alias("offset", "term"))
    terms = cut(offsets.select("term").distinct())
    counts = cut(term_counts(documents, terms))
    by = F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "term", "offset")))
    ranked = offsets.join(near(counts), "term", "left").groupBy("phrase", "items").agg(by.alias("by")).where(F.col("by")[0]["c"] > 0)
    second = F.size("by") > 1
    rare = ranked.select(
        F.col("by")[0]["term"].alias("t1"),
        F.when(second, F.get("by", F.lit(1))["term"]).alias("t2"),
        F.when(second, F.get("by", F.lit(1))["offset"] - F.col("by")[0]["offset"]).alias("apart"),
        F.struct(F.col("by")[0]["offset"].alias("offset"), F.size("phrase").alias("n"), "phrase", "items").alias("window"),
    )
    return rare.groupBy("t1", "t2", "apart").agg(F.collect_list("window").alias("windows"))


def occurrences(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, h, start, n, items): every occurrence of a phrase (distinct arrays ``phrase`` with their ``items``), exact."""
    phrases = cut(phrases)
    reach = phrases.agg(F.max(F.size("phrase"))).first()[0] or 1
    wanted = cut(lookups(documents, phrases))
    terms = wanted.select(F.explode(F.array(F.struct(F.col("t1").alias("term"), F.lit(True).alias("lead")), F.struct(F.col("t2").alias("term"), F.lit(False).alias("lead")))).alias("x"))
    terms = cut(terms.select("x.*").where("term is not null").groupBy("term").agg(F.max("lead").alias("lead")))
    index = cut(postings(documents, terms, reach))
    pairs = index.withColumnRenamed("term", "t1").join(near(wanted), "t1")
    alone = pairs.where("t2 is null").select("id", "h", "pos", "around", "windows")
    other = index.select(F.col("term").alias("t2"), F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("pos").alias("pos2")).distinct()
    met = pairs.where("t2 is not null").join(other, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("pos") + F.col("apart") == F.col("pos2")) & (pairs.t2 == other.t2)).select("id", "h", "pos", "around", "windows")
    lead = F.least(F.col("pos"), F.lit(reach))  # words of ``around`` in front of the posting
    fits = F.filter("windows", lambda w: (w["offset"] <= lead) & (F.slice(F.col("around"), F.greatest(lead - w["offset"] + 1, F.lit(1)), w["n"]) == w["phrase"]))
    found = met.unionByName(alone).select("id", "h", "pos", F.explode(fits).alias("w"))
    return found.select("id", "h", (F.col("pos") - F.col("w.offset")).alias("start"), F.col("w.n").alias("n"), F.col("w.items").alias("items")).distinct()


def _verdicts(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, h, n_words, n_hit, items, contaminated) of every row of ``docs``."""
    documents = keyed(docs, id_col, text_col)
    found = occurrences(documents, phrases_of(items, size, item_id_col, item_text_col))
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def add(done: Column, span: Column) -> Column:
        more = F.greatest(span["end"] - F.greatest(span["start"], done["end"]), F.lit(0))
        return F.struct(F.greatest(done["end"], span["end"]).alias("end"), (done["hit"] + more).alias("hit"))

    hits = found.groupBy("id", "h").agg(F.aggregate(spans, zero, add)["hit"].alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "n_hit", "items")
    base = documents.select("id", "h", F.size("w").cast("long").alias("n_words"))
    rows = base.join(hits, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    named = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("id", "h", "n_words", n_hit.alias("n_hit"), named.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    A word inside any occurrence of an item's window is hit. Contaminated: at least one
    word in ``share`` is. ``items`` names the items with occurring windows, as sorted strings.
    """
    rows = _verdicts(docs, items, size, share, id_col, text_col, item_id_col, item_text_col)
    return rows.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "contaminated")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, as they are, that are not contaminated. Columns may have any names."""
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    key, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    bad = _verdicts(rows.select(key.alias("doc_id"), text.alias("text")), items, **options).where("contaminated").select("id", "h").distinct()
    return rows.join(near(cut(bad)), key.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_anti").toDF(*names)


def near_each_other(docs: DataFrame, pairs: DataFrame, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b, pos_a, pos_b): proximity matches of word pairs (columns ``a``, ``b``), at most ``within`` words apart.

    Positions are dealt into stretches of ``within`` + 1 words and each posting of ``a``
    meets the three stretches around it, so that only close postings are compared.
    A word that stands beside its like is matched once.
    """
    documents = keyed(docs, id_col, text_col)
    pairs = cut(pairs.select("a", "b", F.get(words(F.col("a")), F.lit(0)).alias("ta"), F.get(words(F.col("b")), F.lit(0)).alias("tb")).where("ta is not null and tb is not null").distinct())
    terms = cut(pairs.select(F.explode(F.array("ta", "tb")).alias("term")).distinct())
    index = cut(postings(documents, terms).select("term", "id", "h", "pos").distinct())
    stretch = F.floor(F.col("pos") / (within + 1))
    left = index.withColumnRenamed("term", "ta").join(near(pairs), "ta").withColumn("at", F.explode(F.array(stretch - 1, stretch, stretch + 1))).withColumnRenamed("pos", "pos_a")
    right = index.select(F.col("term").alias("tb2"), F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("pos").alias("pos_b"), stretch.alias("at2"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("at") == F.col("at2")) & (F.col("tb") == F.col("tb2"))
    close = (F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & ((F.col("ta") != F.col("tb")) | (F.col("pos_a") < F.col("pos_b")))
    return left.join(right, same & close).select(F.col("id").alias(id_col), "a", "b", "pos_a", "pos_b")


def contract_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's columns: items as the digest of their comma-joined names."""
    rows = contamination(docs, items)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same in one piece of SQL: windows as joined words.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
dn AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM dp, (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)),
hits AS (SELECT dn.doc_id, dn.i, dn.n, bw.item_id FROM dn JOIN bw ON dn.n = bw.n AND dn.p = bw.p),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
