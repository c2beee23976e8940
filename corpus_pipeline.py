"""A corpus through five stages: toxicity, near duplicates, repeated spans, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last
return the columns of documents. Between stages the rows are written to the shared folder as Parquet
and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, near_dedup, packing, span_dedup, toxicity
from tidemark.llm._io import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net).filter("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group stays: the one with the smallest doc_id (a null one is the largest). Rows
    are told apart by a number of their own, so those with null or repeated ids are decided one by one."""
    rows = span_dedup.numbered(docs)
    found = near_dedup.near_duplicates(rows.select(F.col("o").alias("doc_id"), "text"))
    return rows.join(found.filter("not kept").select(F.col("doc_id").alias("o")), "o", "left_anti").select("row.*")


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes that repeat an earlier string; n_chars follows."""
    return span_dedup.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item go."""
    rows = span_dedup.numbered(docs)
    leaks = decontam.contaminated(rows.select(F.col("o").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(leaks.select(F.col("doc_id").alias("o")).distinct(), "o", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 1024."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("span_dedup", cut_repeated_spans), ("decontaminate", drop_leaks), ("pack", pack)]
ORACLE_SQL = None  # a trained network and exact span removal are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
