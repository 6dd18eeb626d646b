"""What is known about a table of operations as a whole: its kinds of operation, and the greatest date of each.

The summary of a table has one row per kind (action type and group, loan flag, operation code and its description) with the number of rows and
the greatest date and year. It keeps the names of the columns, so everything that asks for codes, action types or the end of the window can read the
summary in place of the table. Summaries merge: those of parts, or of a table and what was appended to it, give that of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.schema import safe_long
from shelfwise.staging import stage

# Columns that tell kinds of operation apart.
KIND_COLUMNS = ("ACTION_TYPE", "ACTION_GROUP", "IS_LOAN", "VYP_OPID", "OPIDY_POPIS")
ROWS = "rows"


def _aggregate(df: DataFrame, rows) -> DataFrame:
    keys = [c for c in KIND_COLUMNS if c in df.columns]
    values = [F.max(c).alias(c) for c in ("DATE", "YEAR") if c in df.columns]
    return df.groupBy(*keys).agg(*values, rows.alias(ROWS))


def summarise(events: DataFrame, *, by: str | None = None) -> DataFrame:
    """Summary in one pass over the narrow columns; unreadable dates and years count as NULL. ``by`` keeps the summaries of its values apart."""
    typed = {c: F.col(c) for c in KIND_COLUMNS if c in events.columns}
    if "DATE" in events.columns:
        typed["DATE"] = F.col("DATE").try_cast("timestamp_ntz")
    if "YEAR" in events.columns:
        typed["YEAR"] = safe_long(events, "YEAR").try_cast("int")
    part = F.col(by) if by else F.lit(0)
    narrow = events.select(*[c.alias(n) for n, c in typed.items()], part.alias("part"))
    keys = [c for c in KIND_COLUMNS if c in typed]
    values = [F.max(c).alias(c) for c in ("DATE", "YEAR") if c in typed]
    out = narrow.groupBy("part", *keys).agg(*values, F.count(F.lit(1)).alias(ROWS))
    return out if by else out.drop("part")


def merge(*summaries: DataFrame) -> DataFrame:
    """Summary of all parts together."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.drop("part") for s in summaries])
    return _aggregate(rows, F.sum(ROWS))


def write_summary(events: DataFrame, path: str, *, by: str, only: Sequence | None = None) -> None:
    """Write the summaries of the values of ``by``, one part of the dataset each. With ``only`` those of the given values are renewed
    (after their rows were written anew) and the others stay."""
    if only is not None:
        events = events.where(F.col(by).isin(*only))
    writer = summarise(events, by=by).repartition("part").write.mode("overwrite").partitionBy("part")
    writer.option("partitionOverwriteMode", "static" if only is None else "dynamic").parquet(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Summary of the whole, from its parts."""
    return merge(spark.read.parquet(path))


def summary_of(events: DataFrame, summary: DataFrame | None) -> DataFrame:
    """The summary at hand, or one made by a single pass and written, since several questions are asked of it."""
    return summary if summary is not None else stage(summarise(events), "summary")
