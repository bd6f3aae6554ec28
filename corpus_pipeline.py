"""From raw documents to a mixed training set: filter, clean, deduplicate, decontaminate, mix."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import decontam, jaccard, lines, mixing, quality
from flowsieve.llm.common import NOT_BREAK, set_aside, table, where_late
from flowsieve.session import let_go, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; those without text fail them."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    docs, own = set_aside(docs, quality.ADDED)
    return where_late(quality.quality_rules(docs, trusted), F.col("kept")).select(*own)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of lines removed; a document of which nothing is left goes with them."""
    docs, own = set_aside(docs, ["n_lines", "n_removed"])
    cleaned = lines.dedup_lines(docs)
    cleaned = where_late(cleaned, (F.col("n_removed") == 0) | F.col("text").rlike(NOT_BREAK))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*own)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more join."""
    return jaccard.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark, as they are or with other values."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words it takes of each, repeats counted."""
    return where_late(mixing.mix(docs), F.col("taken") > 0)


def _after_others(stage):
    """``stage``, begun when what earlier ones hold is let go."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        let_go(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [
    ("quality rules", _after_others(quality_stage)),
    ("line dedup", _after_others(line_stage)),
    ("near copies", _after_others(near_copy_stage)),
    ("benchmark decontamination", _after_others(benchmark_stage)),
    ("mixing", _after_others(mixing_stage)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The stages fit weights, sign sets and solve sums; no SQL can express them.
ORACLE_SQL = None
