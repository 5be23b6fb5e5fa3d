"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, licenses, media, neardup, packing, phrases, substring, suffix, toxicity, urls, warc
from .common import bound_batches, spill
from .sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: a picture is drawn for each vector; edited copies of every one whose id is divisible by 50 are searched among all.  A query's matches are lists."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = media.drawn(vectors.filter(F.col("vec_id") % 50 == 0), edited=True)
    return media.per_query(spill(media.find_copies(queries, media.drawn(vectors)), "copies"), queries)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the canonical URLs of every page whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, pages.filter(F.col("page_id") % 50 == 0).select("url"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeated_words(table(spark, sf_dir, "documents")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_shared_substrings(table(spark, sf_dir, "documents")))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_packing, op2_license_scan, op3_media_copies, op4_url_filter, op5_decontamination, op6_minhash_dedup, op7_toxicity, op8_warc, op9_substring_dedup, op10_suffix_dedup, op11_bpe, op12_source_divergence, op13_phrase_mining)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
