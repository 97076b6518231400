"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination and mixing, each over all rows left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, minhash_dedup, mixing, substring_dedup
from lodestone.llm.common import discard, materialize, small_batches
from lodestone.llm.queries import BLOCK, WEIGHTS


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is predicted; rejects those without a letter or a text.

    Where no row is labelled, no language can be learned and only documents without a letter go.
    """
    small_batches(spark)
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(language_id.language_column(model) != "und")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates, and one row where a doc_id repeats with the same text.

    Rows without a doc_id stay.
    """
    small_batches(spark)
    found = minhash_dedup.near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("rows"))
    marked = docs.join(found.where("NOT kept OR rows > 1").withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    again = marked.where("kept AND rows > 1").dropDuplicates(["doc_id", "text"])
    return marked.where("_id IS NULL").unionByName(again).select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that an earlier document holds; text and n_chars follow.

    Rows without a text or a doc_id stay as they are.
    """
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = substring_dedup.repeated_spans(docs, carry=others)
    now = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(now.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy, also an edited one, of a benchmark item. Rows without a text stay."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every document its place in the mix of sources."""
    return mixing.mix_sources(docs, WEIGHTS, BLOCK)


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
]

#: SQL cannot express the trained and the sketched stages; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
