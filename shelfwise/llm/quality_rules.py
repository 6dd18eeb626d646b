"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Every text gets counts and ratios. For each stratum (language) and each ratio a cutoff is chosen from a fixed grid: the lowest cutoff whose
rejections among the labelled good texts of the stratum are so few that an exact binomial bound limits the false rejection. A
cutoff passes when ``P(Bin(n, alpha) <= k) <= delta / tests``, where ``n`` good labelled texts hold ``k`` rejected ones. The cutoffs of one
ratio are tested from the loosest down until one fails (as a lower cutoff rejects no fewer texts, that is the lowest that passes), so they
share one error; ``tests`` is the number of ratios times that of the strata with enough good labelled texts for any cutoff to pass
(``tested_strata``; chosen by ``n`` alone). All chosen cutoffs hold together with probability ``1 - delta``, and a good text of a stratum is
rejected with probability ``alpha`` for each ratio at most. The grid does not depend on labels, so every labelled row is a holdout row. A
ratio without a passing cutoff rejects nothing; with the default policy one stratum needs 144 good labelled texts, four need 190 each.

Edge cases: a null or empty text has no words and fails the base rule; a null language is a stratum of its own; without labels, or with
too few, nothing but the base rule rejects; conflicting labels of one document count as the worse one; repeated rows are judged each;
repeated 3-word windows are found by a 64-bit hash of their words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.tables import let, restrict
from shelfwise.staging import stage

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class RiskPolicy:
    """``alpha``: false rejection allowed for each ratio and stratum; ``delta``: chance that any bound fails."""

    alpha: float = 0.03
    delta: float = 0.05
    grid: dict[str, tuple[float, ...]] = field(
        default_factory=lambda: {
            "symbol_ratio": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5),
            "dup_line_ratio": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
            "repeat_ratio": (0.05, 0.1, 0.2, 0.3, 0.4),
            "mean_word_chars": (7.0, 8.0, 10.0, 12.0, 15.0, 20.0),
        }
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(rows: Column) -> Column:
            twice = F.filter(
                rows,
                lambda r, j: F.coalesce(r["h"] == F.get(rows, j - 1)["h"], F.lit(False))
                | F.coalesce(r["h"] == F.get(rows, j + 1)["h"], F.lit(False)),
            )
            places = F.flatten(F.transform(twice, lambda r: F.array(r["i"], r["i"] + 1, r["i"] + 2)))
            return F.size(F.array_distinct(places))

        return let(tagged, count)

    def from_hashes(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)),
        )
        return let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
        )

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)
    )


def text_counts(text: Column) -> Column:
    """Struct of counts of one text, each intermediate array built once."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, f"{SPACE_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    lined = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return F.struct(
        counted.alias("words"),
        lined.alias("lines"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def features(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", extra: tuple[str, ...] = ()
) -> DataFrame:
    """One narrow row per document: counts, ratios and whether the base rule fails."""
    counted = docs.select(
        F.col(key),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        let(F.col(text), text_counts).alias("c"),
        *extra,
    )
    n_words = F.col("c.words.n").cast("long")
    n_repeat = F.col("c.words.r").cast("long")

    def ratio(top: Column, below: Column) -> Column:
        return F.when(below > 0, top / below).otherwise(F.lit(0.0))

    return counted.select(
        key,
        "stratum",
        n_words.alias("n_words"),
        F.col("c.word_chars").alias("word_chars"),
        F.col("c.n_symbols").alias("n_symbols"),
        F.col("c.lines.d").cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        ((n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)).alias("base_failed"),
        ratio(F.col("c.n_symbols"), F.col("c.word_chars")).alias("symbol_ratio"),
        ratio(F.col("c.lines.d"), F.col("c.lines.n")).alias("dup_line_ratio"),
        ratio(n_repeat, n_words).alias("repeat_ratio"),
        ratio(F.col("c.word_chars"), n_words).alias("mean_word_chars"),
        *extra,
    )


def largest_count(n: Column, alpha: float, log_limit: Column) -> Column:
    """Largest ``k`` with ``P(Bin(n, alpha) <= k) <= exp(log_limit)``, or -1; summed term by term in logarithms."""
    step = math.log(alpha) - math.log1p(-alpha)
    start = F.struct(
        (n * math.log1p(-alpha)).alias("term"), F.lit(float("-inf")).alias("total"), F.lit(-1).cast("long").alias("k")
    )

    def add(acc: Column, j: Column) -> Column:
        high, low = F.greatest(acc["total"], acc["term"]), F.least(acc["total"], acc["term"])
        total = F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))
        left = n - j
        following = F.when(left > 0, acc["term"] + F.log(F.greatest(left, F.lit(1))) - F.log(j + 1) + step).otherwise(
            F.lit(float("-inf"))
        )
        k = F.when((total <= log_limit) & (acc["k"] == j - 1), j).otherwise(acc["k"])
        return F.struct(following.alias("term"), total.alias("total"), k.alias("k"))

    # beyond the mean n * alpha the probability is at least about a half, so k lies below
    steps = F.sequence(F.lit(0).cast("long"), F.least(n, F.ceil(n * alpha) + 1).cast("long"))
    return F.aggregate(steps, start, add)["k"]


def tested_strata(sizes: list[int], ratios: int, alpha: float, delta: float) -> int:
    """Least ``m`` for which at most ``m`` strata of these sizes can pass a test at ``delta / (ratios * m)``, even with no text rejected."""
    m = 1
    while sum(n * math.log1p(-alpha) <= math.log(delta / (ratios * m)) for n in sizes) > m:
        m += 1
    return m


def thresholds(feats: DataFrame, labels: DataFrame, policy: RiskPolicy, key: str = "doc_id") -> DataFrame:
    """One row per stratum with a cutoff for each ratio (null: none). ``labels`` has quality and toxic for each key."""
    good = (
        labels.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            ((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("_good")
        )
        .where("_good")
    )
    held = feats.where(~F.col("base_failed")).join(good.select(key), key, "left_semi")
    tests = [(name, cut) for name, cuts in policy.grid.items() for cut in cuts]
    counts = stage(
        held.groupBy("stratum").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum((F.col(name) > cut).cast("long")).alias(f"k{i}") for i, (name, cut) in enumerate(tests)],
        ),
        "quality-counts",
    )
    # strata that can pass at all, each with many labelled texts, so these are few
    ratios = max(1, len(policy.grid))
    enough = F.col("n") * math.log1p(-policy.alpha) <= math.log(policy.delta / ratios)
    sizes = [r["n"] for r in counts.where(enough).select("n").collect()]
    log_limit = math.log(policy.delta / (ratios * tested_strata(sizes, ratios, policy.alpha, policy.delta)))
    bounded = counts.withColumn("k_max", largest_count(F.col("n"), policy.alpha, F.lit(log_limit)))
    cutoffs = {
        name: [F.when(F.col(f"k{i}") <= F.col("k_max"), F.lit(cut)) for i, (x, cut) in enumerate(tests) if x == name]
        for name in policy.grid
    }
    return bounded.select(
        "stratum", "n", "k_max", *[(F.least(*c) if len(c) > 1 else c[0]).alias(f"max_{name}") for name, c in cutoffs.items()]
    )


def _verdicts(feats: DataFrame, labels: DataFrame, policy: RiskPolicy, key: str) -> DataFrame:
    cutoffs = stage(thresholds(feats, labels, policy, key), "quality-cutoffs")  # one row per stratum
    broken = [F.when(F.col(name) > F.col(f"max_{name}"), F.lit(name)) for name in policy.grid]
    joined = feats.join(cutoffs.drop("n", "k_max"), "stratum", "left")
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(n) > F.col(f"max_{n}"), F.lit(False)) for n in policy.grid])
    return joined.select(
        *feats.columns,
        F.array_compact(F.array(*broken)).alias("broken_rules"),
        (~F.col("base_failed") & ~over).alias("kept"),
    )


def judge(docs: DataFrame, labels: DataFrame, policy: RiskPolicy | None = None, key: str = "doc_id") -> DataFrame:
    """Counts, ratios, the rules that a document breaks and ``kept``, one row per document."""
    feats = stage(features(docs, key), "quality-features")
    return _verdicts(feats, labels, policy or RiskPolicy(), key)


def judge_rows(docs: DataFrame, labels: DataFrame, policy: RiskPolicy | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``kept``: rows that fail are found by key and text, so repeated keys are judged by their own text."""
    mark = F.xxhash64(F.col(key), F.lit("|"), F.col("text"))
    own = docs.drop("kept", "_mark").withColumn("_mark", mark)
    feats = stage(features(own, key, extra=("_mark",)), "quality-features")
    failed = stage(_verdicts(feats, labels, policy or RiskPolicy(), key).where("not kept").select("_mark").distinct(), "quality-failed")
    return restrict(own, failed, "_mark", "left_anti").withColumn("kept", F.lit(True)).drop("_mark")
