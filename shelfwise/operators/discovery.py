"""What a table of operations contains: action types, operation codes, shelf-mark prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import PREFIX_LENGTH, signature_prefix, title_key
from shelfwise.functions.labels import opid_label
from shelfwise.schema import pick_column, safe_long

# Action types that stand for a loan where a table has neither flags nor groups.
LOAN_WORDS = ("loan", "vypujcka", "checkout", "borrow")
ACTION_LIMIT = 10_000


def _text(name: str) -> Column:
    return F.trim(F.col(name).cast("string"))


def _nothing(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def action_types(events: DataFrame) -> DataFrame:
    """Distinct non-blank action types, sorted."""
    if "ACTION_TYPE" not in events.columns:
        return _nothing(events, "a string")
    return events.select(_text("ACTION_TYPE").alias("a")).filter("a <> ''").distinct().orderBy("a")


def suggested_loan_actions(events: DataFrame) -> DataFrame:
    """Distinct action types of rows that are marked as loans by flag or group."""
    marks = []
    if "IS_LOAN" in events.columns:
        marks.append(F.coalesce(F.col("IS_LOAN").try_cast("boolean"), F.lit(False)))
    if "ACTION_GROUP" in events.columns:
        marks.append(F.coalesce(F.lower(_text("ACTION_GROUP")) == "loan", F.lit(False)))
    if "ACTION_TYPE" not in events.columns or not marks:
        return _nothing(events, "a string")
    marked = marks[0] if len(marks) == 1 else marks[0] | marks[1]
    return action_types(events.filter(marked))


def default_loan_actions(events: DataFrame) -> tuple[str, ...]:
    """Suggested loan actions, else every action type: a list of labels, which must be as short as one that people choose from."""
    found = suggested_loan_actions(events).take(ACTION_LIMIT + 1) or action_types(events).take(ACTION_LIMIT + 1)
    if len(found) > ACTION_LIMIT:
        raise ValueError(f"more than {ACTION_LIMIT} action types: name those that are loans")
    return tuple(r["a"] for r in found)


def preselected_actions(events: DataFrame) -> DataFrame:
    """Action types offered as loans for an uploaded table: those that are a word for loan, else all."""
    types = action_types(events)
    words = types.filter(F.lower("a").isin(*LOAN_WORDS))
    return words if words.take(1) else types


def loan_words(events: DataFrame) -> tuple[str, ...]:
    """The words for loan among the action types."""
    if "ACTION_TYPE" not in events.columns:
        return ()
    words = events.select(F.lower(_text("ACTION_TYPE")).alias("a")).filter(F.col("a").isin(*LOAN_WORDS))
    return tuple(sorted(r["a"] for r in words.distinct().collect()))  # no more than there are words


def distinct_opids(events: DataFrame, *, max_opids: int | None = None) -> DataFrame:
    """Distinct operation codes, ascending; with ``max_opids`` the first of them."""
    if "VYP_OPID" not in events.columns:
        return _nothing(events, "opid bigint")
    codes = events.select(safe_long(events, "VYP_OPID").alias("opid")).filter("opid IS NOT NULL").distinct()
    codes = codes.orderBy("opid")
    return codes if max_opids is None else codes.limit(max_opids)


def opid_legend(events: DataFrame) -> DataFrame:
    """Greatest trimmed description of each operation code."""
    if "VYP_OPID" not in events.columns:
        return _nothing(events, "opid bigint, popis string")
    described = "OPIDY_POPIS" in events.columns
    popis = _text("OPIDY_POPIS") if described else F.lit(None).cast("string")
    rows = events.filter("VYP_OPID IS NOT NULL").select(
        safe_long(events, "VYP_OPID").alias("opid"), popis.alias("popis")
    )
    # The pairs are few: reducing to them first hashes the rows; a maximum over text alone would sort all of them.
    pairs = rows.distinct()
    return pairs.groupBy("opid").agg(F.max("popis").alias("popis")).orderBy("opid")


def opid_labels(legend: DataFrame) -> DataFrame:
    """Readable label of each code in a legend or table of operation types."""
    lower = {c: c.lower() for c in legend.columns}
    code = pick_column(legend.columns, ("OPIDY_OPID", "opid", "id")) or next((c for c, x in lower.items() if "opid" in x), None)
    text = pick_column(legend.columns, ("OPIDY_POPIS", "popis", "text", "name")) or next(
        (c for c, x in lower.items() if any(w in x for w in ("popis", "text", "name"))), None
    )
    if code is None:
        return _nothing(legend, "opid bigint, popisek string")
    description = F.col(text).cast("string") if text else F.lit(None).cast("string")
    opid = safe_long(legend, code)
    return legend.select(opid.alias("opid"), opid_label(opid, description).alias("popisek")).orderBy("opid")


def prefix_summary(
    events: DataFrame, *, signature_col: str = "TITUL_SIGN_FULL", prefix_length: int = PREFIX_LENGTH
) -> DataFrame:
    """Number of titles per shelf-mark prefix, most first."""
    signature, name = F.col(signature_col).cast("string"), F.col("TITUL_NAZEV").cast("string")
    titles = events.select(
        title_key(signature, name).alias("title_key"),
        signature_prefix(signature, prefix_length).alias("SIGN_PREFIX"),
    ).distinct()
    return titles.groupBy("SIGN_PREFIX").agg(F.count("*").alias("TITULU")).orderBy(F.desc("TITULU"), "SIGN_PREFIX")


def prefix_summary_of_titles(titles: DataFrame) -> DataFrame:
    """The same from a table of titles, NULL prefix shown as empty."""
    prefix = F.coalesce(F.col("SIGN_PREFIX").cast("string"), F.lit(""))
    counted = titles.select(prefix.alias("SIGN_PREFIX")).groupBy("SIGN_PREFIX").agg(F.count("*").alias("TITULU"))
    return counted.orderBy(F.desc("TITULU"), "SIGN_PREFIX")
