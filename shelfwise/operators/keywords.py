"""Many keywords looked for in the texts of many rows, with rules kept as a table.

A keyword is found through its rarest run of three characters: the texts are taken apart into such runs, which meet the keywords' runs in one hash join, and
a pair that meets is compared in full. The plan is the same for ten keywords and ten thousand. Keywords that are regular expressions have no fixed runs; they
are tested one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import any_of, contains
from shelfwise.operators.joins import is_short
from shelfwise.staging import stage

RUN = 3
SHORT_INDEX = 1_000_000  # keywords up to which the index is broadcast
MAX_PATTERNS = 1000
SPECIAL = r"[\\^$.|?*+()\[\]{}]"


def _runs(text: Column, size: Column) -> Column:
    """Distinct runs of ``size`` characters."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    runs = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))
    return F.when(F.length(text) >= size, runs).otherwise(F.array().cast("array<string>"))


def keyword_table(rules: DataFrame, *, literal: bool = False) -> DataFrame:
    """Rows ``column``, ``keyword``, ``pattern`` (whether it must be read as a regular expression): trimmed, lower-cased, without blanks and repeats."""
    word = F.lower(F.trim(F.col("keyword")))
    pattern = F.lit(False) if literal else word.rlike(SPECIAL)
    return rules.select("column", word.alias("keyword"), pattern.alias("pattern")).where("keyword <> ''").distinct()


def keyword_index(keywords: DataFrame) -> DataFrame:
    """``column``, ``keyword`` and the ``run`` it is found by: the one that the fewest keywords of the column have."""
    size = F.least(F.length("keyword"), F.lit(RUN))
    runs = keywords.select("column", "keyword", F.explode(_runs(F.col("keyword"), size)).alias("run"))
    held = runs.groupBy("column", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.join(held, ["column", "run"]).groupBy("column", "keyword").agg(F.min(F.struct("n", "run"))["run"].alias("run"))


def keyword_hits(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows of ``texts`` (``row``, ``column``, ``text`` in lower case) with each plain ``keyword`` they hold."""
    index = stage(keyword_index(keywords), "keyword-index")
    sizes = [r["size"] for r in index.select(F.length("run").alias("size")).distinct().collect()]  # 1 to RUN
    if not sizes:
        return texts.select("row", "column", F.lit("").alias("keyword")).limit(0)
    runs = F.flatten(F.array(*[_runs(F.col("text"), F.lit(s)) for s in sorted(sizes)]))
    apart = texts.select("row", "column", "text", F.explode(runs).alias("run"))
    listed = F.broadcast(index) if is_short(index, SHORT_INDEX) else index
    met = apart.join(listed, ["column", "run"])
    return met.where(F.contains("text", "keyword")).select("row", "column", "keyword")


def flag_by_rules(titles: DataFrame, rules: DataFrame, *, flag: str = "vyjimka_flag", literal: bool = False) -> DataFrame:
    """Titles with ``flag``: whether a column holds one of its keywords. ``rules`` has rows (``column``, ``keyword``), as ``rules_from_json`` gives them."""
    keywords = stage(keyword_table(rules, literal=literal).where(F.col("column").isin(*titles.columns)), "keywords")
    patterns = keywords.where("pattern").orderBy("column", "keyword").take(MAX_PATTERNS + 1)
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} keywords are regular expressions")
    by_pattern = any_of([contains(F.col(r["column"]).cast("string"), r["keyword"]) for r in patterns])
    plain = keywords.where("NOT pattern").select("column", "keyword")
    searched = [r["column"] for r in plain.select("column").distinct().collect()]  # columns of the titles
    if not searched:
        return titles.withColumn(flag, by_pattern)
    numbered = stage(titles.withColumn("_row", F.monotonically_increasing_id()), "titles-to-search")
    pairs = [F.struct(F.lit(c).alias("column"), F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("text")) for c in sorted(searched)]
    texts = numbered.select(F.col("_row").alias("row"), F.inline(F.array(*pairs)))
    hits = keyword_hits(texts, plain).select(F.col("row").alias("_row")).distinct().withColumn("_hit", F.lit(True))
    found = F.coalesce("_hit", F.lit(False)) | by_pattern
    return numbered.join(hits, "_row", "left").withColumn(flag, found).drop("_row", "_hit")
