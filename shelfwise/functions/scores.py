"""Ratios, positions and scores of a title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9  # fixed value: keeps the candidate scores finite

# Points and limits of the risk score.
RISK_NO_LOANS = 70
RISK_FEW_LOANS = 20
RISK_LOW_POSITION = 10
RISK_STALE = 15
RISK_FEW_RANGE = (1, 2)
RISK_PERCENTILE = 30
RISK_YEARS = 3
RISK_YEARS_IF_NEVER = 99


def loans_per_copy(loans: Column, copies: Column) -> Column:
    return F.coalesce(loans.cast("double") / F.nullif(copies.cast("double"), F.lit(0.0)), F.lit(0.0))


def percentile_in_group(rank: Column, size: Column) -> Column:
    """Share of the group ranked below, in percent: multiplied before dividing."""
    return F.coalesce((size - rank) * F.lit(100.0) / F.nullif(size, F.lit(0)), F.lit(0.0))


def percentile_in_group_frame(rank: Column, size: Column) -> Column:
    """Same quantity, divided before multiplying (differs in the last binary digit)."""
    return F.coalesce((size - rank) / F.nullif(size, F.lit(0)) * F.lit(100.0), F.lit(0.0))


def position_text(rank: Column, size: Column) -> Column:
    return F.concat_ws("/", rank.cast("string"), size.cast("string"))


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, points).otherwise(0)


def risk_score(loans: Column, percentile: Column, years_since: Column) -> Column:
    return (
        _points(loans == 0, RISK_NO_LOANS)
        + _points(loans.between(*RISK_FEW_RANGE), RISK_FEW_LOANS)
        + _points(percentile <= RISK_PERCENTILE, RISK_LOW_POSITION)
        + _points(F.coalesce(years_since, F.lit(float(RISK_YEARS_IF_NEVER))) > RISK_YEARS, RISK_STALE)
    )


def write_off_score(copies: Column, per_copy: Column) -> Column:
    return (F.greatest(copies, F.lit(1)) - 1) / (per_copy + F.lit(EPSILON))


def buy_score(copies: Column, per_copy: Column) -> Column:
    return (per_copy + F.lit(EPSILON)) / F.greatest(copies, F.lit(1))
