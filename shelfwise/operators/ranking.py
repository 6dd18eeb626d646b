"""Rank and size within groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A summary of at most this many rows (a short text and a few numbers each) is broadcast; a larger one is joined with salt.
BROADCAST_ROWS = 1_000_000
SALTS = 32


def attach_summary(
    big: DataFrame,
    summary: DataFrame,
    *,
    null_safe: list[str],
    on: list[str],
    spread_by: list[str],
    max_broadcast_rows: int | None = None,
    rows_bound: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Left-join a per-group summary to its rows.

    The row count of the summary is checked first (a known bound on the rows of ``big`` can spare the count). Within the limit it is broadcast and ``big`` is not shuffled. Beyond
    it, ``big`` is spread over ``salts`` sub-groups and the summary repeated for each, so that a hot group is shared by
    many tasks.
    """
    limit = BROADCAST_ROWS if max_broadcast_rows is None else max_broadcast_rows
    keys = null_safe + on
    added = [c for c in summary.columns if c not in keys]
    small = (rows_bound is not None and rows_bound <= limit) or summary.limit(limit + 1).count() <= limit
    right = summary.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if not small:
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
        right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    condition = F.lit(True)
    for k in null_safe:
        condition = condition & big[k].eqNullSafe(right[f"_r_{k}"])
    for k in on:
        condition = condition & (big[k] == right[f"_r_{k}"])
    if not small:
        condition = condition & (big["_salt"] == right["_r_salt"])
    joined = big.join(F.broadcast(right) if small else right, condition, "left")
    return joined.select(*[c for c in big.columns if c != "_salt"], *added)


def rank_within(
    rows: DataFrame,
    *,
    group: str,
    measure: str,
    spread_by: list[str],
    max_broadcast_rows: int | None = None,
    rows_bound: int | None = None,
) -> DataFrame:
    """Add ``rank_v_signature`` (ties share the best rank, highest measure first) and ``pocet_v_signature``.

    Equal to a RANK and a COUNT over the whole group, but no task ever holds a group: rows are first counted per (group,
    measure), which holds at most about the square root of twice the counted operations per group. Ranks are running
    sums over that histogram.
    """
    histogram = rows.groupBy(group, measure).agg(F.count("*").alias("_n"))
    better = Window.partitionBy(group).orderBy(F.desc(measure)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    positions = histogram.select(
        group,
        measure,
        (F.coalesce(F.sum("_n").over(better), F.lit(0)) + 1).alias("rank_v_signature"),
        F.sum("_n").over(whole).alias("pocet_v_signature"),
    )
    return attach_summary(
        rows,
        positions,
        null_safe=[group],
        on=[measure],
        spread_by=spread_by,
        max_broadcast_rows=max_broadcast_rows,
        rows_bound=rows_bound,
    )
