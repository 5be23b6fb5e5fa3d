"""The corpus pipeline: five stages over ``documents``, each working on all that the one before kept.

In every stage a null text counts as empty, rows that repeat an id are documents of
their own and rows without one come last; texts of any length are read whole; an
empty table gives an empty one; extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontam, neardup, packing, substring, toxicity
from lodestrata.llm.common import RID, attach, numbered, original, scratch
from lodestrata.llm.queries import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labels, rejects go; without labels of both kinds none does.

    Empty texts have no features and stay; equal texts have the same verdict.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Of rows that repeat an id and are alike the first by a hash of the text stays; texts without words
    are alike with nothing and stay.
    """
    return neardup.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that also start earlier are cut out; documents without such stay as they are, those left without words go.

    Of equal windows that with the smallest id stays, in one document the first; texts of
    fewer words, empty ones too, stay.
    """
    rows = numbered(docs)
    spans = substring.repeated_words(rows)
    kept = substring.kept_texts(attach(rows.select(RID, F.col("doc_id").cast("long").alias("doc_id"), "text"), spans, how="inner"))
    cut = rows.drop("text", "n_chars").join(kept.select(RID, F.col("kept").alias("text")), RID).withColumn("n_chars", F.length("text").cast("long"))
    whole = attach(rows, spans.select(RID, F.lit(b"").alias("payload")), how="left_anti")
    return original(whole, docs).unionByName(original(cut.filter("text <> ''"), docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go: at least one word in 20 stands in a window of 13 words that an item has.

    Texts without words stay; an empty benchmark contaminates nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of at most 2048; an empty text is one closing id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Regression, min-wise trees and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
