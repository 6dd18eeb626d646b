"""Distinct titles that roll up: dense title numbers and bitmaps of them.

Titles are numbered in the order of their prefix, so those of a prefix lie side by side and fill few blocks of numbers. The cube has a row for each
prefix, class and block with a bitmap (4 KB) of the titles in it, and plain sums. Distinct counts over any of its dimensions, or over all, follow
from joined bitmaps: the titles are read once, however many reports there are. A title in several prefixes has the number of the least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.rules import AUTO, CLASSES
from shelfwise.operators.candidates import number
from shelfwise.operators.summaries import with_class_shares
from shelfwise.staging import stage

DIMENSIONS = ("SIGN_PREFIX", "klasifikace")
SUMS = ("rows", "copies", "use")


def number_titles(keys: DataFrame) -> DataFrame:
    """``title_key`` and ``title_no`` of every key that is there, from rows with ``title_key`` and ``SIGN_PREFIX``.

    Numbers go up with prefix and key, with a gap after each part that Spark made; they are written, so they do not change."""
    least = keys.where("title_key IS NOT NULL").groupBy("title_key").agg(F.min("SIGN_PREFIX").alias("SIGN_PREFIX"))
    ordered = least.repartitionByRange("SIGN_PREFIX", "title_key").sortWithinPartitions("SIGN_PREFIX", "title_key")
    return stage(ordered.select("title_key", (F.monotonically_increasing_id() + 1).alias("title_no")), "title-numbers")


def title_cube(titles: DataFrame) -> DataFrame:
    """Rows (prefix, class, ``block``) of classified titles: a bitmap of the titles, and sums. Rows without a key are in the sums only.

    Rows of one title, prefix and class become one before anything is joined, so neither a hot title nor those without a key are a hot group."""
    rows = stage(
        titles.groupBy(*DIMENSIONS, "title_key").agg(
            F.count("*").alias("rows"), F.sum(number("pocet_svazku")).alias("copies"), F.sum(number("vykon_na_svazek")).alias("use")
        ),
        "title-rows",
    )
    numbered = rows.join(number_titles(rows), "title_key", "left")
    cube = numbered.groupBy(*DIMENSIONS, F.bitmap_bucket_number("title_no").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("title_no")).alias("titles"), *[F.sum(c).alias(c) for c in SUMS]
    )
    return stage(cube, "title-cube")


def roll_up(cube: DataFrame, *dimensions: str) -> DataFrame:
    """Distinct ``titles`` and the sums for each combination of some dimensions, or over all: one row."""
    blocks = cube.groupBy(*dimensions, "block").agg(
        F.bitmap_count(F.bitmap_or_agg("titles")).alias("titles"), *[F.sum(c).alias(c) for c in SUMS]
    )
    return blocks.groupBy(*dimensions).agg(
        F.coalesce(F.sum("titles"), F.lit(0)).alias("titles"), *[F.sum(c).alias(c) for c in SUMS]
    )


def by_prefix(cube: DataFrame) -> DataFrame:
    """``summaries.by_prefix`` from the cube."""

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("klasifikace") == name, F.col("titles"))), F.lit(0)).alias(name)

    counted = roll_up(cube.where("SIGN_PREFIX IS NOT NULL"), *DIMENSIONS).groupBy("SIGN_PREFIX").agg(*map(of, CLASSES))
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return counted.withColumn("CELKEM_TITULU", total).orderBy(F.desc(AUTO), "SIGN_PREFIX")


def kpi(cube: DataFrame) -> DataFrame:
    """``summaries.kpi`` from the cube."""
    blocks = cube.groupBy("block").agg(
        F.bitmap_count(F.bitmap_or_agg("titles")).alias("titles"),
        *[F.sum(F.when(F.col("klasifikace") == c, F.col("rows")).otherwise(0)).alias(c) for c in CLASSES],
        *[F.sum(c).alias(c) for c in SUMS],
    )
    totals = blocks.agg(
        F.coalesce(F.sum("titles"), F.lit(0)).alias("titulu_celkem"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES],
        F.coalesce(F.sum("copies"), F.lit(0.0)).cast("bigint").alias("svazku_celkem"),
        F.coalesce(F.sum("use") / F.nullif(F.sum("rows"), F.lit(0)), F.lit(0.0)).alias("prum_vykon"),
    )
    return with_class_shares(totals)
