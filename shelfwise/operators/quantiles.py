"""Exact interpolated quantiles of columns of any size, of several columns at once."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import stage

# Up to this many distinct values of all columns the built-in aggregate holds a column in one task; more are narrowed down.
SINGLE_TASK_VALUES = 1_000_000
BUCKETS = 512  # parts of a range that are told apart in one pass


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], *, max_values: int = SINGLE_TASK_VALUES
) -> list[float | None]:
    """Quantiles of one column."""
    return exact_quantiles_of(df, {column: probabilities}, max_values=max_values)[column]


def exact_quantiles_of(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], *, max_values: int = SINGLE_TASK_VALUES
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation for each column, NULLs ignored; None for each when there is no value.

    One pass over the rows counts equal values of all columns together, so a value that fills a third of the rows is one row from then on.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in wanted])
    values = df.select(F.inline(pairs)).where("v IS NOT NULL")
    histogram = stage(values.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), "histogram")
    sizes = {r["c"]: r for r in histogram.groupBy("c").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n")).collect()}
    probabilities = sorted({p for ps in wanted.values() for p in ps})
    if sum(r["values"] for r in sizes.values()) <= max_values:
        rows = histogram.groupBy("c").agg(F.percentile("v", F.lit(probabilities), F.col("n")).alias("q")).collect()
        found = {r["c"]: dict(zip(probabilities, r["q"], strict=True)) for r in rows}
        return {c: [found[c][p] if c in found else None for p in ps] for c, ps in wanted.items()}
    counts = {c: r["n"] for c, r in sizes.items()}
    at = {(c, i) for c, ps in wanted.items() if c in counts for p in ps for i in _around(p * (counts[c] - 1), counts[c])}
    values_at = _values_at(histogram, at)

    def quantile(c: str, p: float) -> float | None:
        if c not in counts:
            return None
        x = p * (counts[c] - 1)
        low, high = (values_at[c, i] for i in _around(x, counts[c]))
        return low + (high - low) * (x - math.floor(x))

    return {c: [quantile(c, p) for p in ps] for c, ps in wanted.items()}


def _around(x: float, count: int) -> tuple[int, int]:
    return math.floor(x), min(math.floor(x) + 1, count - 1)


def _values_at(histogram: DataFrame, at: set[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """Values at positions of the sorted columns, by narrowing the range that holds each position.

    A pass tells ``BUCKETS`` equal parts of every open range apart, for all columns and positions together; the part that holds the position
    becomes the next range, cut to the values in it. Counts are exact, so the positions are. The driver sees counts of parts only.
    """
    bounds = histogram.groupBy("c").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
    ends = {r["c"]: (r["low"], r["high"]) for r in bounds}
    open_ = {(c, i): (*ends[c], 0) for c, i in at}  # range and number of rows before it
    out: dict[tuple[str, int], float] = {}
    while open_:
        out |= {key: low for key, (low, high, _) in open_.items() if low == high}
        open_ = {key: x for key, x in open_.items() if key not in out}
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not ranges:
            break
        tests = []
        for number, (c, low, high) in enumerate(ranges):
            inside = (F.col("c") == c) & F.col("v").between(low, high)
            part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") - low) / (high - low) * BUCKETS))
            tests.append(F.when(inside, F.struct(F.lit(number).alias("range"), part.cast("int").alias("part"))))
        table = F.filter(F.array(*tests), lambda x: x.isNotNull())
        rows = (
            histogram.select("v", "n", F.inline(table))
            .groupBy("range", "part")
            .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("range", "part")
            .collect()
        )
        parts = {r: [x for x in rows if x["range"] == n] for n, r in enumerate(ranges)}
        for (c, i), (low, high, before) in open_.items():
            for x in parts[c, low, high]:
                if i < before + x["n"]:
                    break
                before += x["n"]
            open_[c, i] = (x["low"], x["high"], before)
    return out


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_quantiles(df, column, [0.5])[0]
