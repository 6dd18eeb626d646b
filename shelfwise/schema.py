"""Decisions taken from a schema alone, before any plan runs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns an event-level dataset is expected to have.
REQUIRED_EVENT_COLUMNS = (
    "TITUL_SIGN_FULL",
    "TITUL_NAZEV",
    "TITUL_ROK_VYDANI",
    "TITUL_JAZYK",
    "TITUL_DRUH_DOKUMENTU",
    "DATE",
    "YEAR",
    "ACTION_TYPE",
    "desk_subjects",
)

# What tells a table of titles from a table of operations.
TITLE_LEVEL_COLUMNS = {"title_key", "SIGN_PREFIX", "vypujcky_5_let"}
EVENT_LEVEL_COLUMNS = {"ACTION_TYPE", "DATE"}

# Fixed value: column renamed since older title tables were written.
LEGACY_RENAMES = {"pocet_udalosti_okno": "pocet_operaci_v_obdobi"}


@dataclass(frozen=True)
class ColumnCheck:
    missing: tuple[str, ...]
    present: tuple[str, ...]

    @property
    def warnings(self) -> tuple[str, ...]:
        if not self.missing:
            return ()
        return (f"missing columns: {', '.join(self.missing)}; defaults are used where possible",)


def check_columns(df: DataFrame, required: Sequence[str] = REQUIRED_EVENT_COLUMNS) -> ColumnCheck:
    have = set(df.columns)
    return ColumnCheck(
        missing=tuple(c for c in required if c not in have),
        present=tuple(c for c in required if c in have),
    )


def pick_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case; returns the spelling used by the table."""
    spelling = {c.upper(): c for c in columns}
    return next((spelling[c.upper()] for c in candidates if c.upper() in spelling), None)


def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Add every column of ``types`` that the frame lacks, as NULL of the stated type."""
    missing = {name: F.lit(None).cast(ddl) for name, ddl in types.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def is_title_level(df: DataFrame) -> bool:
    have = set(df.columns)
    return have >= TITLE_LEVEL_COLUMNS and not have & EVENT_LEVEL_COLUMNS


def rename_legacy(df: DataFrame) -> DataFrame:
    renames = {old: new for old, new in LEGACY_RENAMES.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(renames) if renames else df


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def safe_long(df: DataFrame, name: str) -> Column:
    """Column as BIGINT, NULL when it is not a number; halves are rounded up in text and to even in numbers."""
    dtype = data_type(df, name)
    c = F.col(name)
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    if isinstance(dtype, T.StringType):
        return F.coalesce(c.try_cast("bigint"), F.round(c.try_cast("double"), 0).try_cast("bigint"))
    if isinstance(dtype, (T.FractionalType,)):
        return F.bround(c, 0).try_cast("bigint")
    return c.try_cast("bigint")
