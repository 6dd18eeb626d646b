"""Summaries of classified titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.rules import AUTO, CLASSES, KEEP, MANUAL, PROTECTED
from shelfwise.functions.text import strip
from shelfwise.operators.candidates import MAX_SUGGESTIONS, TOP_PREFIXES, number

TERM_SEPARATORS = r"[|;,]"  # fixed value: what separates terms in a subject text
MIN_TERM_LENGTH = 2
HISTOGRAM_BINS = 30
DICTIONARY_BLOCK = 16 << 20  # bytes of a row group


def by_prefix(titles: DataFrame, *, prefix_col: str = "SIGN_PREFIX") -> DataFrame:
    """Distinct titles per prefix and class, and their total; most automatic candidates first."""
    distinct = titles.filter(F.col(prefix_col).isNotNull()).select(prefix_col, "klasifikace", "title_key").distinct()
    has_key = F.col("title_key").isNotNull()
    counted = distinct.groupBy(prefix_col).agg(
        *[F.count_if((F.col("klasifikace") == c) & has_key).alias(c) for c in CLASSES]
    )
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return counted.withColumn("CELKEM_TITULU", total).orderBy(F.desc(AUTO), prefix_col)


def focus_prefix(titles: DataFrame, prefix: str) -> DataFrame:
    return titles.filter(F.col("SIGN_PREFIX").cast("string") == prefix)


def top_auto_prefixes(summary: DataFrame, k: int = TOP_PREFIXES) -> DataFrame:
    return summary.orderBy(F.desc(AUTO), "SIGN_PREFIX").limit(k).select("SIGN_PREFIX", AUTO)


def kpi(titles: DataFrame) -> DataFrame:
    """One row: distinct titles, rows per class and their share, copies, mean use."""
    keys = titles.groupBy("title_key").agg(
        *[F.count_if(F.col("klasifikace") == c).alias(c) for c in CLASSES],
        F.sum(number("pocet_svazku")).alias("copies"),
        F.sum(number("vykon_na_svazek")).alias("use"),
        F.count("*").alias("rows"),
    )
    totals = keys.agg(
        F.count("title_key").alias("titulu_celkem"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES],
        F.coalesce(F.sum("copies"), F.lit(0.0)).cast("bigint").alias("svazku_celkem"),
        F.coalesce(F.sum("use") / F.nullif(F.sum("rows"), F.lit(0)), F.lit(0.0)).alias("prum_vykon"),
    )
    return with_class_shares(totals)


def with_class_shares(totals: DataFrame) -> DataFrame:
    share = {
        f"podil_{c}": 100.0 * F.col(c) / F.nullif(F.col("titulu_celkem"), F.lit(0))
        for c in (AUTO, MANUAL, PROTECTED, KEEP)
    }
    return totals.withColumns(share)


def class_counts(titles: DataFrame) -> DataFrame:
    return titles.groupBy("klasifikace").agg(F.count("*").alias("pocet")).orderBy(F.desc("pocet"), "klasifikace")


def facet_values(titles: DataFrame) -> DataFrame:
    """Distinct values of the three selectable attributes, one row per (facet, value)."""
    values = F.array(
        *[
            F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value"))
            for c in ("SIGN_PREFIX", "TITUL_JAZYK", "TITUL_DRUH_DOKUMENTU")
        ]
    )
    return titles.select(F.inline(values)).distinct().orderBy("facet", "value")


def fill_rate(titles: DataFrame) -> DataFrame:
    """How many titles have subject texts."""
    columns = [c for c in ("desk_subjects", "och_subjects") if c in titles.columns]
    filled = [F.count_if(strip(F.coalesce(F.col(c), F.lit(""))) != "").alias(f"{c}_vyplneno") for c in columns]
    return titles.agg(*filled, F.count("*").alias("celkem"))


def vocabulary_terms(texts: DataFrame, column: str) -> DataFrame:
    """Distinct terms of a joined text."""
    parts = texts.select(F.explode(F.split(F.col(column), TERM_SEPARATORS)).alias("part"))
    return parts.select(strip(F.col("part")).alias("term")).filter(F.length("term") >= MIN_TERM_LENGTH).distinct()


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """Distinct terms of a joined text, ordered without regard to case."""
    return vocabulary_terms(texts, column).orderBy(F.lower("term"), "term")


def write_vocabulary(texts: DataFrame, column: str, path: str) -> None:
    """The vocabulary as a dictionary: parts and row groups in the order of the lower-cased term, so that a prefix lies in few of them."""
    terms = vocabulary_terms(texts, column).withColumn("lower", F.lower("term"))
    ordered = terms.repartitionByRange("lower", "term").sortWithinPartitions("lower", "term")
    ordered.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", DICTIONARY_BLOCK).parquet(path)


def suggestions_from(spark: SparkSession, path: str, typed: str, k: int = MAX_SUGGESTIONS) -> DataFrame:
    """``suggestions`` from a written dictionary: the scan reads the range of the prefix only."""
    prefix = typed.strip().lower()
    terms = spark.read.parquet(path)
    if prefix:
        terms = terms.where((F.col("lower") >= prefix) & F.startswith("lower", F.lit(prefix)))
    return terms.orderBy("lower", "term").limit(k).select("term")


def suggestions(terms: DataFrame, typed: str, k: int = MAX_SUGGESTIONS) -> DataFrame:
    """First terms that start with what was typed."""
    prefix = typed.strip().lower()
    rows = terms.filter(F.startswith(F.lower("term"), F.lit(prefix))) if prefix else terms
    return rows.orderBy(F.lower("term"), "term").limit(k)


def loan_histogram(titles: DataFrame, column: str = "vypujcky_5_let", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from the least to the greatest number of loans."""
    counted = titles.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ends = titles.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    ranged = counted.withColumn("ends", ends).select(
        "v", "n", "ends.low", ((F.col("ends.high") - F.col("ends.low")) / F.lit(float(bins))).alias("width")
    )
    number_of = F.when(F.col("width") == 0, 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("low")) / F.nullif(F.col("width"), F.lit(0.0))), F.lit(bins - 1))
    )
    binned = ranged.filter("v IS NOT NULL").withColumn("bin", number_of.cast("int"))
    return binned.groupBy("bin").agg(F.sum("n").alias("pocet")).orderBy("bin")
