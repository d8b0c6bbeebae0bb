"""Queries over the text tables, one per operator, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, language_id, licenses, lm_score, media, pii, sentencepiece_codec, simhash, token_counts, url_filter
from gridloom.llm.common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their way back, as digests."""
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.listed_domains(spark))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and three differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, distance=3)
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), F.col("component").alias("component_id"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.contract_rows(table(spark, sf_dir, "documents"))


def pii_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds by form alone."""
    return pii.form_rows(table(spark, sf_dir, "documents"))


def held_out(column: str, parts: int) -> Column:
    """Whether a document is kept from training; one with a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    network = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, network).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm_score.fit(docs.where(~held_out("doc_id", 7)))
    scored = lm_score.score(docs, model, counts)
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's counts and base scores, rounded, without its model."""
    scored = op9_lm_score(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_media": op2_media,
    "op3_url_filter": op3_url_filter,
    "op4_licenses": op4_licenses,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_lm_score": op9_lm_score,
    "op10_token_counts": op10_token_counts,
    "pii_forms": pii_forms,
    "lm_base": lm_base,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "pii_forms": pii.ORACLE_FORMS,
    "lm_base": lm_score.ORACLE_BASE,
}
