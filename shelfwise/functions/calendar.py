"""Time parsing and calendar attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.schema import data_type

# Text forms of dates in uploaded files, and how each is written year first.
YEAR_FIRST = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2})?$"
DAY_FIRST_FORMS = (
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})( \d{1,2}:\d{2}:\d{2})?$", "$3-$2-$1$4"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})( \d{1,2}:\d{2})$", "$3-$2-$1$4:00"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})( \d{1,2}:\d{2}:\d{2})?$", "$3-$2-$1$4"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
)


def parse_time(df: DataFrame, name: str) -> Column:
    """Operation time as a zone-free timestamp; NULL when it cannot be read."""
    if not isinstance(data_type(df, name), T.StringType):
        return F.col(name).cast("timestamp_ntz")
    text = F.trim(F.col(name))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text).try_cast("timestamp_ntz")


def parse_day_first(c: Column) -> Column:
    """Time of a text, day first, without passing through any zone; NULL when it cannot be read."""
    text = F.trim(c.cast("string"))
    turned = F.when(text.rlike(YEAR_FIRST), text)
    for form, year_first in DAY_FIRST_FORMS:
        turned = turned.when(text.rlike(form), F.regexp_replace(text, form, year_first))
    return turned.try_cast("timestamp_ntz")


def calendar_columns(ts: Column) -> dict[str, Column]:
    year, month = F.year(ts), F.month(ts)
    return {
        "DATE": F.to_date(ts),
        "YEAR": year,
        "MONTH": month,
        "YEAR_MONTH": year * 100 + month,
        "WEEK": F.weekofyear(ts),
        "WEEKDAY": F.dayofweek(ts) - 1,
    }


def years_between(last: Column, end: Column) -> Column:
    """Whole days from ``last`` to ``end`` in years of 365.25 days, two decimals."""
    return F.round(F.datediff(end, last) / F.lit(365.25), 2)


def minus_years(ts: Column, years: int) -> Column:
    return ts - F.make_ym_interval(F.lit(years), F.lit(0))
