"""Mixing sources to target weights: temperature, bisected exponent, budgeted block permutations.

The share of a source is its part of all tokens, its weight is ``share ** exponent`` normalised. The exponent (1: as they come, 0: all
sources alike) is bisected to meet a target entropy, a repetition limit or both. Weights times the token budget give each source a number
of epochs. An epoch is a permutation of the blocks of a source (documents fall into blocks by hash); a broken last epoch reads
its permutation up to the budget and cuts the block that straddles it by a hash of the document.

Tokens are counted over all documents; sources meet the driver never, only sums over them, one row for each exponent tried.

Edge cases: null is a source of its own; null and empty texts have no tokens and are read once; repeated rows fall into one block and
share its fate; one source keeps weight 1; an empty table gives an empty result. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
# Decisions are rows of five numbers; up to this many (about 10 MB) they are broadcast, beyond it they are joined by shuffle.
BROADCAST_DECISIONS = 200_000
SPLITS = 16  # exponents tried in one pass
ROUNDS = 6  # passes: the exponent is known to 16 ** -6


@dataclass(frozen=True)
class MixPolicy:
    """``max_epochs``: how often any token may be read. ``target_entropy``: share of the highest possible entropy; flattening stops there.
    ``budget``: tokens to read; unset, the least budget that reads every source once in full."""

    max_epochs: float | None = 1.5
    target_entropy: float | None = None
    budget: float | None = None
    blocks: int = 256
    seed: int = 17


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _source_key(source: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null")))


def with_block(docs: DataFrame, policy: MixPolicy, key: str, text: str, source: str) -> DataFrame:
    return docs.select(
        "*",
        _source_key(F.col(source)).alias("_source"),
        F.pmod(F.xxhash64(F.lit(policy.seed), F.col(key), F.col(text)), F.lit(policy.blocks)).cast("int").alias("_block"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("_tokens"),
        _unit(F.lit(policy.seed + 1), F.col(key), F.col(text)).alias("_u"),
    )


def _profile(sizes: DataFrame, exponents: list[float]) -> list:
    """For each exponent the entropy of the weights and the extreme ratios of weight to share."""
    tried = sizes.select("share", F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("x"))
    w = F.pow("share", F.col("x"))
    sums = tried.groupBy("x").agg(
        F.sum(w).alias("z"),
        F.sum(w * F.log(w)).alias("wlogw"),
        F.max(w / F.col("share")).alias("top"),
        F.min(w / F.col("share")).alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select("*", (F.log("z") - F.col("wlogw") / F.col("z")).alias("entropy")).orderBy("x").collect()


def _bisect(sizes: DataFrame, holds) -> float:
    """Least exponent in [0, 1] from which on ``holds`` is true; it is true at 1 by convention."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / SPLITS for i in range(SPLITS + 1)]
        rows = _profile(sizes, points)
        if not rows:
            return 1.0
        first = next((i for i, r in enumerate(rows) if holds(r)), SPLITS)
        if first == 0:
            return points[0]
        low, high = points[first - 1], points[first]
    return high


def solve_exponent(sizes: DataFrame, total: float, policy: MixPolicy) -> float:
    """``sizes`` has one row per source with its share."""
    wanted = []
    if policy.max_epochs is not None:

        def within(r) -> bool:
            budget = total * r["z"] / r["low"] if policy.budget is None else policy.budget
            return budget * r["top"] / (r["z"] * total) <= policy.max_epochs * (1 + 1e-9)

        wanted.append(_bisect(sizes, within))
    if policy.target_entropy is not None:
        # the largest exponent that still reaches the entropy: from the least one that no longer does, one step back
        wanted.append(
            _bisect(sizes, lambda r: r["n"] < 2 or r["entropy"] <= policy.target_entropy * math.log(r["n"]) + 1e-9)
        )
    return max(wanted, default=1.0)


def decisions(marked: DataFrame, policy: MixPolicy) -> DataFrame:
    """One row for each (source, block): weight, epochs, whole epochs and the part of the block in the broken one."""
    blocks = stage(marked.groupBy("_source", "_block").agg(F.sum("_tokens").alias("tokens")), "mix-blocks")
    sums = blocks.groupBy("_source").agg(F.sum("tokens").alias("n")).where("n > 0")
    total = float(sums.agg(F.sum("n")).first()[0] or 0)
    sizes = stage(sums.withColumn("share", F.col("n") / F.lit(total or 1.0)), "mix-sources")
    exponent = solve_exponent(sizes, total, policy)
    rows = _profile(sizes, [exponent])
    z, low = (rows[0]["z"], rows[0]["low"]) if rows else (1.0, 1.0)
    budget = policy.budget if policy.budget is not None else total * z / low
    weight = F.pow("share", F.lit(exponent)) / z
    targets = sizes.select("_source", "n", weight.alias("weight"), (weight * budget / F.col("n")).alias("epochs"))
    # an epoch count that is whole but for rounding is whole
    whole = F.floor(F.col("epochs") + 1e-6)
    order = F.xxhash64(F.lit(policy.seed), F.col("_source"), F.col("whole") + 1, F.col("_block"))
    # at most policy.blocks rows in a window
    before = Window.partitionBy("_source").orderBy(order, "_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(targets, "_source")
        .withColumn("whole", whole)
        .withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .select(
            "_source",
            "_block",
            F.lit(exponent).alias("mix_exponent"),
            F.col("weight").alias("mix_weight"),
            F.col("epochs").alias("mix_epochs"),
            F.col("whole").cast("int").alias("_whole"),
            F.when(
                F.col("tokens") > 0,
                F.greatest(
                    F.lit(0.0),
                    F.least(
                        F.lit(1.0),
                        (F.greatest(F.col("epochs") - F.col("whole"), F.lit(0.0)) * F.col("n") - F.col("before")) / F.col("tokens"),
                    ),
                ),
            )
            .otherwise(F.lit(0.0))
            .alias("_part"),
        )
    )


def mix(
    docs: DataFrame, policy: MixPolicy | None = None, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Each document with ``mix_tokens``, ``mix_block``, ``mix_exponent``, ``mix_weight`` and ``mix_epochs`` of its source, and
    ``mix_copies``, the number of times it is read."""
    policy = policy or MixPolicy()
    added = ("mix_tokens", "mix_block", "mix_exponent", "mix_weight", "mix_epochs", "mix_copies")
    own = docs.drop(*added, "_source", "_block", "_tokens", "_u")
    marked = with_block(own, policy, key, text, source)
    chosen = stage(decisions(marked.select("_source", "_block", "_tokens"), policy), "mix-decisions")
    few = chosen.count() <= BROADCAST_DECISIONS
    joined = marked.join(F.broadcast(chosen) if few else chosen, ["_source", "_block"], "left")
    copies = F.when(F.col("_tokens") > 0, F.col("_whole") + (F.col("_u") < F.col("_part")).cast("int")).otherwise(F.lit(1))
    return joined.select(
        *own.columns,
        F.col("_tokens").alias("mix_tokens"),
        F.col("_block").alias("mix_block"),
        "mix_exponent",
        "mix_weight",
        "mix_epochs",
        copies.alias("mix_copies"),
    )


def realise(mixed: DataFrame, seed: int = 17, source: str = "source") -> DataFrame:
    """One row for each reading: ``mix_epoch`` from 1 and ``mix_order``, by which the blocks of an epoch are permuted."""
    read = mixed.where(F.col("mix_copies") > 0).withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    )
    return read.withColumn(
        "mix_order", F.xxhash64(F.lit(seed), _source_key(F.col(source)), F.col("mix_epoch"), F.col("mix_block"))
    )
