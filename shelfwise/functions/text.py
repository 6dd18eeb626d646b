"""Text helpers shared by several expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in the dumps' own text handling.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space.

    Blanks go first: the general form compares every character it passes with the whole set.
    """
    return F.btrim(F.trim(c), F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    """OR of the conditions, balanced so that long lists do not build a deep tree; FALSE for none."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [p[0] | p[1] if len(p) == 2 else p[0] for p in pairs]
    return conditions[0]


def contains(text: Column, term: str, *, literal: bool = False) -> Column:
    """Case-insensitive search; the term is a regular expression unless ``literal``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(low, F.lit(term.lower())) if literal else low.rlike(term.lower())
