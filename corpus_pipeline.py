"""Corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet into the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.llm.common import scratch_path, table
from flowforge.llm.packing import best_fit_packing
from flowforge.llm.quality import quality_rules
from flowforge.llm.simhash import keep_one_of_each
from flowforge.llm.substrings import remove_repeated_windows


def _documents(df: DataFrame, text: str, packed: str, columns: list[str]) -> DataFrame:
    """The columns of documents: the new text and its length, all others as they were."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col(c if c in ("doc_id", "source") else f"{packed}.{c}")
                       for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits go from the others."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    own = docs.select("doc_id", "text", "source", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    return _documents(quality_rules(own).filter("kept"), "clean_text", "_rest", docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    return keep_one_of_each(docs, shingle=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id holds go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeated_windows(docs, window=13, carry=rest)
    if "source" in rest:
        out = out.withColumn("source", F.col("carried.source"))
    return _documents(out, "kept_text", "carried", docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs, capacity=2048)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packing),
]

#: Fingerprints, tokenization and packing are not expressible in SQL; tests hold
#: every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
