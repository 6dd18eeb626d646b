"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and word pairs fall into ``BUCKETS`` hash buckets. Two generative models are the smoothed bucket frequencies of the target texts
(labelled good) and of all texts. A text's log-weight is the sum over its n-grams of the log-ratio of the two. Adding a Gumbel number to each
log-weight and keeping the greatest is sampling without replacement in proportion to the weights. Both models count all texts; their
size is fixed by the number of buckets. The cutoff is found by narrowing histograms, so no order of all texts is made.

Edge cases: null and empty texts have log-weight 0; without target texts every log-weight is 0 and the sample is uniform; repeated rows have
equal keys and are kept or dropped together; an empty table gives an empty result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.staging import stage

BUCKETS = 1 << 14
MAX_TARGET = 200_000  # labelled documents that the target model is fitted on
WORD = re.compile(r"[^\W_]+|[^\w\s]")
BINS = 1024
PRIOR = 1000.0


def buckets(text: str | None) -> np.ndarray:
    """Bucket of every word and word pair."""
    words = WORD.findall((text or "").lower())
    one = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)])
    return (both >> np.uint64(50)).astype(np.int64)


def log_ratios(docs: DataFrame, target: str, text: str = "text") -> np.ndarray:
    """Log-ratio of target to raw frequency of each bucket; ``target`` is a boolean column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for t, good in zip(batch.column("t").to_pylist(), batch.column("g").to_pylist(), strict=True):
                n = np.bincount(buckets(t), minlength=BUCKETS)
                sums[0] += n
                if good:
                    sums[1] += n
        yield pa.RecordBatch.from_pydict({"b": pa.array(np.arange(BUCKETS)), "raw": pa.array(sums[0]), "good": pa.array(sums[1])})

    counted = docs.select(F.col(text).alias("t"), F.col(target).alias("g")).mapInArrow(count, "b long, raw long, good long")
    rows = counted.groupBy("b").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows
    raw, good = np.full(BUCKETS, 0.01), np.zeros(BUCKETS)
    for b, r, g in rows:
        raw[b] += r
        good[b] += g
    # the raw model, as if of PRIOR n-grams, smooths that of the target; without target texts both are the same
    raw /= raw.sum()
    return np.log((good + PRIOR * raw) / (good.sum() + PRIOR) / raw) if good.any() else np.zeros(BUCKETS)


def scored(docs: DataFrame, ratios: np.ndarray, seed: int = 29, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``log_weight`` and ``sample_key``."""
    own = docs.drop("log_weight", "sample_key", "kept", "_t", "_u")
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    source = own.withColumn("_t", F.col(text)).withColumn("_u", unit).drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.array([float(ratios[buckets(t)].sum()) for t in batch.column("_t").to_pylist()], np.float64)
            gumbel = -np.log(-np.log(batch.column("_u").to_numpy()))
            names = [c for c in batch.schema.names if c not in ("_t", "_u")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(weight), pa.array(weight + gumbel)], names=[*names, "log_weight", "sample_key"]
            )

    fields = [f for f in source.schema.fields if f.name not in ("_t", "_u")]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("log_weight", T.DoubleType()), T.StructField("sample_key", T.DoubleType())]))


def cutoff(keys: DataFrame, k: int) -> float:
    """The k-th greatest ``sample_key``: histograms over narrower and narrower ranges, ``BINS`` numbers each."""
    low, high, total = keys.agg(F.min("sample_key"), F.max("sample_key"), F.count(F.lit(1))).first()
    if total <= k:
        return float("-inf")
    above = 0
    while True:
        width = (high - low) / BINS
        inside = keys.where((F.col("sample_key") >= low) & (F.col("sample_key") <= high))
        if width == 0 or low + width == low:
            return low
        number = F.least(F.floor((F.col("sample_key") - low) / width), F.lit(BINS - 1))
        rows = inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)), F.min("sample_key"), F.max("sample_key")).collect()
        for _, n, least, most in sorted(rows, reverse=True):
            if above + n >= k:
                low, high = least, most
                break
            above += n
        if low == high or n == 1:
            return low


def resample(
    docs: DataFrame, labels: DataFrame, share: float = 0.9, key: str = "doc_id", text: str = "text", max_target: int = MAX_TARGET
) -> DataFrame:
    """Each document with ``log_weight``, ``sample_key`` and ``kept``: the sample holds ``share`` of all rows.

    The target model is fitted on ``max_target`` good labelled documents at most (those with the least hash of their id), so that their ids can be
    broadcast and no text is shuffled; the raw model counts all documents."""
    good = labels.groupBy(key).agg(
        ((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)).alias("_good")
    )
    fitted = good.where("_good").orderBy(F.xxhash64(key), key).limit(max_target)
    marked = docs.select(key, text).join(F.broadcast(fitted), key, "left")
    keys = stage(scored(docs, log_ratios(marked, "_good", text), key=key, text=text), "importance-keys")
    limit = cutoff(keys, max(1, round(share * keys.count())))
    return keys.withColumn("kept", F.col("sample_key") >= limit)
