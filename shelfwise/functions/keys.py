"""Title identity: combined key and shelf-mark prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions.text import strip

SEPARATOR = "||"
PREFIX_LENGTH = 2


def title_key(signature: Column, name: Column, *, null_as_empty: bool = False) -> Column:
    """``signature || name``; NULL when a part is NULL unless ``null_as_empty``."""
    if null_as_empty:
        signature, name = F.coalesce(signature, F.lit("")), F.coalesce(name, F.lit(""))
    return F.concat(signature, F.lit(SEPARATOR), name)


def is_ambiguous_key(signature: Column, name: Column) -> Column:
    """True when another (signature, name) pair could give the same key.

    That takes a second place at which the separator could be cut, so the key must hold it twice (overlaps count).
    """
    key = title_key(signature, name)
    first = F.instr(key, SEPARATOR)
    rest = F.substring(key, first + 1, F.length(key))
    return F.coalesce(F.instr(rest, SEPARATOR) > 0, F.lit(False))


def signature_prefix(signature: Column, length: int = PREFIX_LENGTH) -> Column:
    """Leading ASCII letters, else the part before the first blank; cut to ``length`` and upper-cased."""
    s = F.trim(signature)
    letters = F.regexp_extract(s, r"^([A-Za-z]+)", 1)
    first_part = F.split_part(s, F.lit(" "), F.lit(1))
    return F.upper(F.substring(F.coalesce(F.nullif(letters, F.lit("")), first_part), 1, length))


def signature_prefix_frame(signature: Column, length: int = PREFIX_LENGTH) -> Column:
    """Frame variant: NULL counts as empty, any white space separates, letters are looked for after upper-casing."""
    s = F.upper(strip(F.coalesce(signature, F.lit(""))))
    letters = F.regexp_extract(s, r"^([A-Z]+)", 1)
    first_part = F.regexp_extract(s, r"^(\S*)", 1)
    return F.substring(F.when(letters != "", letters).otherwise(first_part), 1, length)
