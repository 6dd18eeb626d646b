"""Join helpers that check sizes before choosing a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import stage

# Operation types, document types, branches and the like: thousands of rows, mostly; their bytes are limited, too.
CODE_LIST_ROWS = 1_000_000
SALTS = 32
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1000  # a key with less than this part of the rows is not hot
HOT_ROWS = 1_000_000
HOT_DIMENSION_ROWS = 10 * HOT_KEYS
PLANNED_BYTES = 1 << 20  # a list that the optimizer puts below this needs no counting


def planned_bytes(df: DataFrame) -> int:
    """Size of a frame as the optimizer estimates it from file sizes; runs no job. Unknown counts as large."""
    if not hasattr(df, "_jdf"):
        return PLANNED_BYTES + 1
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_short(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most ``max_rows`` rows and ``BROADCAST_BYTES`` bytes; counting stops at the row limit."""
    if planned_bytes(df) <= min(PLANNED_BYTES, max_rows):
        return True
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= max_rows and (total or 0) <= BROADCAST_BYTES


def hot_keys(big: DataFrame, key: str, *, most: int = HOT_KEYS, least_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``1 / most`` of the rows (so there are at most ``most``) and at least ``least_rows`` of them. Reads the key only."""
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = big.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.where((F.col("_rows") >= least_rows) & (F.col("_rows") * most >= total)).select(key)


def join_laid_out(big: DataFrame, dimension: DataFrame, key: str, *, most: int = HOT_KEYS, least_rows: int = HOT_ROWS) -> DataFrame:
    """Left-join a dimension that lies in buckets of ``key``: it is read in place, only ``big`` is dealt out.

    Adaptive execution cannot split a partition that has to fit a bucket. So rows of hot keys, and rows without a key, go another way: the
    dimension's rows of the hot keys, few by definition, are broadcast (each key repeated as often as the dimension has it)."""
    hot = stage(hot_keys(big, key, most=most, least_rows=least_rows), "hot-keys")
    known: Column = F.col(key).isNotNull()
    if not hot.take(1):
        return big.where(known).join(dimension, key, "left").unionByName(_unmatched(big.where(~known), dimension, key))
    keys = F.broadcast(hot)
    cold = big.where(known).join(keys, key, "left_anti").join(dimension, key, "left")
    few = dimension.join(keys, key, "left_semi")
    rows = big.where(known).join(keys, key, "left_semi")
    # a dimension is not expected to repeat keys; where it does, its rows of hot keys may be too many to send
    heavy = rows.join(F.broadcast(few), key, "left") if is_short(few, HOT_DIMENSION_ROWS) else rows.join(few, key, "left")
    return cold.unionByName(heavy).unionByName(_unmatched(big.where(~known), dimension, key))


def _unmatched(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in dimension.schema.fields if f.name != key})


def join_code_list(
    big: DataFrame, codes: DataFrame, key: str, *, max_rows: int | None = None, short: bool | None = None
) -> DataFrame:
    """Left-join a list of codes to rows in which few codes cover most of the rows.

    The list is measured first (unless the caller has done it) and broadcast when it is as short as such lists are. A longer one is
    repeated per salt, so that the rows of a hot code are shared by many tasks.
    """
    limit = CODE_LIST_ROWS if max_rows is None else max_rows
    if is_short(codes, limit) if short is None else short:
        return big.join(F.broadcast(codes), key, "left")
    salted = codes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(SALTS)).cast("int")
    return big.withColumn("_salt", spread).join(salted, [key, "_salt"], "left").drop("_salt")
