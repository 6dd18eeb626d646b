"""Classification of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.rules import DEFAULT_RULES, ClassLimits, Rules, class_and_reason, exception_flag
from shelfwise.operators.keywords import flag_by_rules


def flag_exceptions(
    titles: DataFrame, rules: Rules | DataFrame = DEFAULT_RULES, *, enabled: bool = True, literal: bool = False
) -> DataFrame:
    """Rules as a mapping become part of the plan; rules as a table of (``column``, ``keyword``) are joined, so there can be any number."""
    if isinstance(rules, DataFrame) and enabled:
        return flag_by_rules(titles, rules, literal=literal)
    rules = {} if isinstance(rules, DataFrame) else rules
    return titles.withColumn("vyjimka_flag", exception_flag(titles.columns, rules, enabled=enabled, literal=literal))


def classify(
    titles: DataFrame,
    *,
    rules: Rules | DataFrame = DEFAULT_RULES,
    limits: ClassLimits | None = None,
    exceptions_enabled: bool = True,
    literal: bool = False,
) -> DataFrame:
    """Add the exception flag, the class and its reason: one projection without a shuffle, unless the rules are a table."""
    flagged = flag_exceptions(titles, rules, enabled=exceptions_enabled, literal=literal)
    code, reason = class_and_reason(flagged.columns, limits or ClassLimits())
    return flagged.withColumns({"klasifikace": code, "duvod_oznaceni": reason})


def rules_from_json(texts: DataFrame, column: str) -> DataFrame:
    """Rules kept in a table of JSON objects: one row per (column, keyword), entries that are no list left out."""
    parsed = texts.select(F.from_json(column, "map<string,variant>").alias("rules"))
    entries = parsed.select(F.explode("rules").alias("column", "words"))
    lists = entries.filter(F.schema_of_variant("words").startswith("ARRAY"))
    words = lists.select("column", F.explode(F.try_variant_get("words", "$", "array<string>")).alias("keyword"))
    return words.distinct()
