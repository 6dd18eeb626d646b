"""Operations in the narrow, typed form that the metrics need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.calendar import parse_day_first
from shelfwise.functions.text import strip
from shelfwise.schema import data_type, safe_long

# Text columns that cleaning fills and strips.
CLEANED_TEXT = (
    "TITUL_NAZEV",
    "TITUL_SIGN_FULL",
    "TITUL_JAZYK",
    "TITUL_DRUH_DOKUMENTU",
    "desk_subjects",
    "och_subjects",
)

# Columns that the narrow form reads, besides the shelf mark if it has another name.
SOURCE_COLUMNS = (
    "TITUL_KEY",
    *CLEANED_TEXT,
    "TITUL_ROK_VYDANI",
    "DATE",
    "YEAR",
    "ACTION_TYPE",
    "ACTION_GROUP",
    "IS_LOAN",
    "IS_RETURN",
    "VYP_OPID",
    "SVAZKY_KEY",
)


def _optional(df: DataFrame, name: str, ddl: str, default: object = None) -> Column:
    if name not in df.columns:
        return F.lit(default).cast(ddl)
    return F.col(name).try_cast(ddl) if ddl != "string" else F.col(name).cast("string")


def _long(df: DataFrame, name: str) -> Column:
    return safe_long(df, name) if name in df.columns else F.lit(None).cast("bigint")


def _lower_trim(df: DataFrame, name: str) -> Column:
    return F.lower(F.trim(_optional(df, name, "string")))


def normalise_events(
    df: DataFrame, *, signature_col: str = "TITUL_SIGN_FULL", keep_source: bool = False
) -> DataFrame:
    """Typed view of operations: absent columns become constants, unreadable values become NULL."""
    if "IS_RETURN" in df.columns:
        is_return = F.coalesce(_optional(df, "IS_RETURN", "boolean"), F.lit(False))
    elif "ACTION_GROUP" in df.columns:
        is_return = _lower_trim(df, "ACTION_GROUP") == "return"
    else:
        is_return = F.lit(False)
    columns = {
        "TITUL_KEY": _long(df, "TITUL_KEY"),
        "signature": _optional(df, signature_col, "string"),
        "title_name": _optional(df, "TITUL_NAZEV", "string"),
        "doc_type": _optional(df, "TITUL_DRUH_DOKUMENTU", "string"),
        "lang": _optional(df, "TITUL_JAZYK", "string"),
        "year_pub": _optional(df, "TITUL_ROK_VYDANI", "double"),
        "desk_subjects": _optional(df, "desk_subjects", "string", ""),
        "och_subjects": _optional(df, "och_subjects", "string", ""),
        "dt": _optional(df, "DATE", "timestamp_ntz"),
        "yr": _long(df, "YEAR").try_cast("int"),
        "action_type": _lower_trim(df, "ACTION_TYPE"),
        "action_group": _lower_trim(df, "ACTION_GROUP"),
        "is_loan_flag": _optional(df, "IS_LOAN", "boolean", False),
        "is_return_flag": is_return,
        "vyp_opid": _long(df, "VYP_OPID"),
        "SVAZKY_KEY": _long(df, "SVAZKY_KEY"),
    }
    selected = [c.alias(n) for n, c in columns.items()]
    if keep_source:
        selected.append(F.struct(*df.columns).alias("source"))
    return df.select(*selected)


def clean_events(df: DataFrame) -> DataFrame:
    """Uploaded frame made uniform: text filled and stripped, numbers and day-first dates read, action lower-cased."""
    out = {}
    for name in CLEANED_TEXT:
        out[name] = strip(F.coalesce(_optional(df, name, "string"), F.lit("")))
    out["TITUL_ROK_VYDANI"] = _optional(df, "TITUL_ROK_VYDANI", "double")
    if "DATE" not in df.columns:
        date = F.lit(None).cast("timestamp_ntz")
    elif isinstance(data_type(df, "DATE"), T.StringType):
        date = parse_day_first(F.col("DATE"))
    else:
        date = F.col("DATE").cast("timestamp_ntz")
    out["DATE"] = date
    out["YEAR"] = _optional(df, "YEAR", "double") if "YEAR" in df.columns else F.year(date).cast("double")
    out["ACTION_TYPE"] = strip(F.lower(F.coalesce(_optional(df, "ACTION_TYPE", "string"), F.lit(""))))
    return df.withColumns(out)
