"""Rolling time window and loan predicate over operations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.calendar import minus_years

# How rows without a date are treated: judged by their year one by one, or only when no row at all has a date.
ROW_YEAR = "row_year_fallback"
ALL_OR_NOTHING = "all_or_nothing"

# What makes a row a loan: the chosen action types (flags when none are chosen), or the flag column when it exists.
ACTIONS_FIRST = "actions_first"
FLAG_FIRST = "flag_first"
ANY_ACTION = "any_action"  # every row with an action type


@dataclass(frozen=True)
class UsagePolicy:
    """Parameters of the usage window."""

    years: int = 5
    loan_actions: tuple[str, ...] = ()
    date_policy: str = ROW_YEAR
    loan_policy: str = ACTIONS_FIRST
    now: dt.datetime | None = None  # end of the window when no row has a date; default is the current time

    @property
    def wanted_actions(self) -> list[str]:
        return [a.strip().lower() for a in self.loan_actions if a.strip()]


def _now(policy: UsagePolicy, unit: str | None = None) -> Column:
    if policy.now is not None:
        return F.lit(policy.now.isoformat(sep=" ")).cast("timestamp_ntz")
    current = F.localtimestamp()
    return F.date_trunc(unit, current).cast("timestamp_ntz") if unit else current


def window_bounds(source: DataFrame, policy: UsagePolicy, *, date: str = "dt", year: str = "yr") -> DataFrame:
    """One row with one value: both ends of the window, their years, and whether dates and years occur at all.

    Used as a scalar subquery, so that no join is planned and the ends are computed once and not per row. Its scan
    reads the date (and for all-or-nothing dates the year) and nothing else.
    """
    all_or_nothing = policy.date_policy == ALL_OR_NOTHING
    end = F.coalesce(F.max(date), _now(policy, "day" if all_or_nothing else None))
    start = minus_years(end, policy.years)
    values = {"end_dt": end, "start_dt": start, "end_year": F.year(end), "start_year": F.year(start)}
    if all_or_nothing:
        values |= {"dated": F.max(date).isNotNull(), "with_year": F.max(year).isNotNull()}
    return source.agg(F.struct(*[c.alias(n) for n, c in values.items()]).alias("bounds"))


def flag_window(
    events: DataFrame, bounds: DataFrame, policy: UsagePolicy, *, date: str = "dt", year: str = "yr"
) -> DataFrame:
    """Add ``in_window``."""
    b = bounds.scalar()
    by_date = F.col(date).between(b["start_dt"], b["end_dt"])
    by_year = F.col(year).between(b["start_year"], b["end_year"])
    if policy.date_policy == ROW_YEAR:
        inside = F.when(F.col(date).isNotNull(), by_date).otherwise(by_year)
    else:
        inside = F.when(b["dated"], by_date).otherwise(F.when(b["with_year"], by_year).otherwise(F.lit(True)))
    return events.withColumn("in_window", F.coalesce(inside, F.lit(False)))


def loan_predicate(policy: UsagePolicy, present: set[str]) -> Column:
    """Which rows count as loans; ``present`` names the flag columns the source really had."""
    wanted = policy.wanted_actions
    by_action = F.col("action_type").isin(*wanted) if wanted else None
    if policy.loan_policy == ANY_ACTION:
        return F.coalesce(F.col("action_type") != "", F.lit(False))
    flag, group = F.col("is_loan_flag"), F.col("action_group") == "loan"
    if policy.loan_policy == ACTIONS_FIRST:
        rule = by_action if by_action is not None else F.coalesce(flag, F.lit(False)) | F.coalesce(group, F.lit(False))
    elif "IS_LOAN" in present:
        rule = flag
    elif "ACTION_GROUP" in present:
        rule = group
    else:
        rule = by_action if by_action is not None else F.lit(True)
    return F.coalesce(rule, F.lit(False))


def filter_window(events: DataFrame, policy: UsagePolicy, *, loans_only: bool = False) -> DataFrame:
    """Rows inside the window; the frame of raw columns is kept as it is."""
    from shelfwise.operators.events import normalise_events

    narrow = normalise_events(events, keep_source=True)
    rows = flag_window(narrow, window_bounds(narrow, policy), policy).filter("in_window")
    if loans_only:
        rows = rows.filter(loan_predicate(policy, set(events.columns)))
    return rows.select(*[F.col(f"source.{c}").alias(c) for c in events.columns])
