"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and returns the columns of ``documents``; the last one returns the documents with
their sampled segmentations. Nothing is expressed in SQL as a whole (the classes of near copies and the sampled segmentations are iterative or
random), so ``ORACLE_SQL`` is None; tests compare the operators and the stage of near copies with plain Python, not yet the other stages or
``run`` as a whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join, mixing, quality_rules, repeated_bytes, sampled_segmentation
from shelfwise.llm.tables import read_table
from shelfwise.staging import stage, stage_result

PIECES = "piece_bpe_32k.model"
PASSAGE = 200  # bytes; of the runs of 51 words in 6,000 texts of sf0.1 99.4 % are as long, but 5.7 % have 400 bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows of one id are kept or rejected each by its own text."""
    judged = quality_rules.judge_rows(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id.

    Rows are told apart by all their columns, not by id. A class without any id keeps one row, too; of several rows with the least id of
    a class the one with the least hash stays, of equal rows one. Rows of one id in different classes all stay. A text without words
    is a class of its own."""
    # nulls are skipped by the hash, so they are marked
    mark = F.xxhash64(*[part for c in docs.columns for part in (F.col(c), F.col(c).isNull())])
    own = docs.withColumn("_mark", mark)

    def first() -> DataFrame:
        classes = jaccard_join.near_copies(own, mark="_mark")
        least = classes.where("n_shingles = 0 or component_id = doc_id or component_id is null")
        by = F.expr("n_shingles = 0").alias("empty"), F.coalesce("class_id", "_mark").alias("class")
        return least.groupBy(*by).agg(F.min("_mark").alias("_mark"), F.count(F.lit(1)).alias("rows"))

    kept = stage_result(spark, first, "pipeline-kept")
    chosen = own.join(kept.select("_mark"), "_mark", "left_semi")
    if kept.where("rows > 1").take(1):
        chosen = chosen.dropDuplicates(["_mark"])
    return chosen.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of ``PASSAGE`` bytes that occur twice or more, so that passages of over 50 words go; documents of
    which nothing is left go."""
    cleaned = repeated_bytes.remove_repeats(docs, PASSAGE)
    changed = F.col("n_removed") > 0
    out = cleaned.where("n_bytes = 0 or n_removed < n_bytes")
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars"))
    return out.select(
        *[
            text.alias(c) if c == "text" else length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
            for c in docs.columns
        ]
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture reads it, at least once."""
    return mixing.realise(mixing.mix(docs)).select(*docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' sampled segmentations."""
    return sampled_segmentation.segmentations(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality rules", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("source mixture", mixture),
    ("sampled segmentation", segmentation),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
