"""Copies per title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.schema import safe_long


def copies_per_title(copies: DataFrame) -> DataFrame:
    """Distinct copies of each title, from the table of copies."""
    pairs = copies.select(
        safe_long(copies, "SVAZKY_PTR_TITUL").alias("TITUL_KEY"), safe_long(copies, "SVAZKY_KEY").alias("SVAZKY_KEY")
    )
    return pairs.groupBy("TITUL_KEY").agg(F.count_distinct("SVAZKY_KEY").alias("pocet_svazku"))


def copies_seen_in_events(events: DataFrame) -> DataFrame:
    """Distinct copies of each title that occur in normalised operations."""
    rows = events.filter("TITUL_KEY IS NOT NULL").select("TITUL_KEY", "SVAZKY_KEY")
    return rows.groupBy("TITUL_KEY").agg(F.count_distinct("SVAZKY_KEY").alias("pocet_svazku"))
