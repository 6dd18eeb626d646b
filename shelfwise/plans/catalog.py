"""Star schema in the session catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.copies import copies_per_title
from shelfwise.operators.enrich import copy_dimension, copy_links, decode_doc_types, reader_demographics, title_dimension
from shelfwise.schema import safe_long
from shelfwise.staging import discard

TABLES = ("fact_vypujcky", "dim_tituly", "dim_svazky", "dim_knoddel", "dim_opidy")


def save_star(
    spark: SparkSession,
    fact: DataFrame,
    titles: DataFrame,
    copies: DataFrame,
    branches: DataFrame,
    op_types: DataFrame,
    *,
    database: str | None = None,
    path: str | None = None,
    partition_fact_by: str | None = "YEAR",
) -> None:
    """Write the five tables; the fact is laid out by year so that queries on a period skip the rest.

    ``path`` makes them external tables below that folder.
    """
    prefix = f"{database}." if database else ""
    for name, df in zip(TABLES, (fact, titles, copies, branches, op_types), strict=True):
        if name == TABLES[0] and partition_fact_by:
            df = df.hint("rebalance", partition_fact_by)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if path:
            writer = writer.option("path", f"{path}/{name}")
        if name == TABLES[0] and partition_fact_by:
            writer = writer.partitionBy(partition_fact_by)
        writer.saveAsTable(prefix + name)


def save_dimensions(
    spark: SparkSession,
    copies: DataFrame,
    titles: DataFrame,
    *,
    subjects: DataFrame | None = None,
    doc_types: DataFrame | None = None,
    readers: DataFrame | None = None,
    buckets: int | None = None,
    database: str | None = None,
    path: str | None = None,
    keep_exact_age: bool = True,
    digits_only: bool = False,
    copy_texts: bool = True,
) -> dict[str, DataFrame]:
    """Write and return the large dimensions in buckets of their keys: copies with all texts of their titles, titles, readers' groups.

    Built once, they are joined to any number of operations without being shuffled again. ``buckets`` should grow with the dimensions; the default is
    the session's number of shuffle partitions, below which Spark would deal the buckets out anew. Without ``copy_texts`` no text is repeated for the copies of
    a title: ``dim_svazky_klice`` holds copies as numbers and ``dim_tituly_predmety`` titles with their subjects, for ``described_titles``.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = decode_doc_types(titles, doc_types) if doc_types is not None else titles
    if copy_texts:
        tables = {
            "dim_svazky_popis": (copy_dimension(copies, described, subjects), "SVAZKY_KEY"),
            "dim_tituly_popis": (described.withColumn("TITUL_KEY", safe_long(described, "TITUL_KEY")), "TITUL_KEY"),
        }
    else:
        tables = {
            "dim_svazky_klice": (copy_links(copies), "SVAZKY_KEY"),
            "dim_tituly_predmety": (title_dimension(described, subjects), "SVAZKY_PTR_TITUL"),
        }
    if readers is not None:
        demo = reader_demographics(readers, keep_exact_age=keep_exact_age, digits_only=digits_only)
        tables["dim_ctenari"] = (demo, "LEG_KEY")
    out = {}
    for name, (df, key) in tables.items():
        full = f"{database}.{name}" if database else name
        writer = df.repartition(buckets, key).write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).sortBy(key)
        if path:
            writer = writer.option("path", f"{path}/{name}")
        writer.saveAsTable(full)
        out[name] = spark.table(full)
        discard(spark, wait=True)  # the shuffle files of one table are not needed for the next
    return out


def title_copies_view(copies: DataFrame) -> DataFrame:
    """``v_titul_svazky``: distinct copies per title."""
    return copies_per_title(copies)


def loans_by_title_view(fact: DataFrame, *, loan_column: str = "ACTION_TYPE") -> DataFrame:
    """``v_loans_by_titul``: loans and first and last date per title.

    The view has always compared the action type with ``loan``, which holds descriptions in enriched tables; pass
    ``ACTION_GROUP`` to count by group.
    """
    return fact.groupBy("TITUL_KEY").agg(
        F.count_if(F.col(loan_column) == "loan").alias("loan_cnt"),
        F.min("DATE").alias("first_date"),
        F.max("DATE").alias("last_date"),
    )


def register_views(spark: SparkSession, *, database: str | None = None, loan_column: str = "ACTION_TYPE") -> None:
    prefix = f"{database}." if database else ""
    title_copies_view(spark.table(f"{prefix}dim_svazky")).createOrReplaceTempView("v_titul_svazky")
    fact = spark.table(f"{prefix}fact_vypujcky")
    loans_by_title_view(fact, loan_column=loan_column).createOrReplaceTempView("v_loans_by_titul")
