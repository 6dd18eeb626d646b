"""Removal of long byte strings that occur twice or more: sampled suffixes, naming by levels, merging of the remaining suffixes.

A start is a position whose next ``LENGTH`` bytes lie in its text. Two starts with equal strings must be found wherever they are. The method
follows suffix sorting by samples: a consistent sample of positions is named first, every other start is reached through its next sampled position,
and equal names are compared over growing lengths. Samples are locally consistent (the position of the least hash of a 64-byte string in a window; string
synchronizing sets) instead of residues of a difference cover, which takes about 20 times as many: see README.

1. Texts get a number each and are written once in buckets of it; every later step reads them there, and only narrow lists are shuffled.
2. Every start has one sample: the position ``a`` with the least hash among the 64-byte strings of its window, the leftmost of equals. Equal
   windows have their sample at the same distance ``d`` from the start, so starts are compared through samples at equal distance. Strings with a
   period of up to 32 bytes come last in that order, so stretches of few letters bring no samples of their own.
3. A stretch of period ``q`` that holds more than ``2 q`` windows repeats itself: all its bytes go. Of its windows the first ``2 q`` stay as its
   representatives for other texts; samples that only the others need are dropped.
4. Samples whose 64 bytes occur once are dropped.
5. By blocks of distances (all, then 64, 8 and 1 wide): the union of a block's windows is named; if it occurs twice, all its bytes go. The intersection is
   named, too; if it occurs once, no window of the block is repeated. Blocks between go to the next level, together with one representative of
   each repeated union that shares an intersection with one of them.

Names of unions, which decide removals, are cryptographic digests of 128 bits; equality of names stands for equality of strings. Intersections and samples are
compared by 64-bit hashes, where a collision costs work but changes no result. Counts are aggregated before any shuffle, and nothing is
gathered by name, so a string that a third of all texts holds is no hot group. Long texts are sampled in parts of bounded size.

Edge cases: null is the empty text; texts shorter than ``LENGTH`` lose nothing; rows repeated in full are copies of each other and lose
everything if they are long enough; overlapping occurrences count; matches never cross texts; an empty table gives an empty result.
Rows need no key: they are told apart by their number. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.shingles import RollingHash
from shelfwise.llm.tables import tidy
from shelfwise.staging import discard, stage, stage_buckets

LENGTH = 400
GRAM = 64
PERIOD = 32  # at most half of GRAM, so that neighbouring periodic grams have one period
LEVELS = (64, 8, 1)
PART_BYTES = 1 << 20  # bytes sampled or named together, unless (when naming) one text is longer
TASK_ROWS = 1 << 15  # narrow rows for which a task of its own is worth its fixed cost
TASK_TEXTS = 1 << 12  # the same for texts
ROW = "_row"
EIGHT = np.uint64(0x0101010101010101)  # eight true values


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the position of the least, the leftmost of equals."""
    n = len(h)
    rows = -(-n // width)
    top = np.iinfo(np.uint64).max
    grid = np.full(rows * width, top, np.uint64)
    grid[:n] = h
    grid = grid.reshape(rows, width)
    place = np.arange(rows * width).reshape(rows, width)
    low = np.minimum.accumulate(grid, axis=1)
    fresh = np.ones_like(grid, bool)
    fresh[:, 1:] = grid[:, 1:] < low[:, :-1]
    low_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    fresh[:, :-1] = grid[:, :-1] <= back[:, 1:]
    fresh[:, -1] = True
    back_at = np.minimum.accumulate(np.where(fresh, place, rows * width)[:, ::-1], axis=1)[:, ::-1]
    i = np.arange(n - width + 1)
    j = i + width - 1
    left, right = back.ravel()[i], low.ravel()[j]
    return np.where(left <= right, back_at.ravel()[i], low_at.ravel()[j])


def periodic_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every maximal string of ``GRAM`` bytes or more that has a period of up to ``PERIOD``, once for each period."""
    n = len(data)
    found = [(np.zeros(0, np.int64),) * 3]
    same = np.zeros((n + 8) // 8 * 8, bool)  # one false value at the end, at least
    for q in range(1, min(PERIOD, n - 1) + 1):
        np.equal(data[q:], data[: n - q], out=same[: n - q])
        same[n - q : n] = False
        # a run of GRAM - q true values holds three aligned eights
        at = np.flatnonzero(same.view(np.uint64) == EIGHT)
        if len(at) < 3:
            continue
        apart = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate([[0], apart + 1])], at[np.append(apart, len(at) - 1)]
        long = last - first >= 2
        start, end = first[long] * 8, (last[long] + 1) * 8
        for _ in range(7):
            start = start - ((start > 0) & same[start - 1])
            end = end + same[end]
        keep = end - start >= GRAM - q
        found.append((start[keep], end[keep] + q, np.full(int(keep.sum()), q)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _groups(data: np.ndarray, ends: np.ndarray, hashing: RollingHash, length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Samples of a stretch of bytes (position, first and last start, hash of the gram) and its periodic runs. ``ends`` tells for each byte where its
    text ends."""
    sums = hashing.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = hashing.spans(sums, at, at + GRAM)
    runs = periodic_runs(data)
    edge = np.zeros(len(grams) + 1, np.int32)
    np.add.at(edge, runs[0], 1)
    np.add.at(edge, runs[1] - GRAM + 1, -1)
    order = grams >> np.uint64(1) | (np.cumsum(edge[:-1]) > 0).astype(np.uint64) << np.uint64(63)
    anchor = leftmost_minima(order, length - GRAM + 1)
    start = np.flatnonzero(np.arange(length, length + len(anchor)) <= ends[: len(anchor)])
    a = anchor[start]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    last = np.append(first[1:], len(a))[: len(first)] - 1
    return (a[first], start[first], start[last], grams[a[first]].view(np.int64)), runs


def samples(
    data: np.ndarray, bounds: np.ndarray, hashing: RollingHash, length: int = LENGTH
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """Sampled positions of the texts that lie end to end in ``data`` (text ``i`` from ``bounds[i]`` to ``bounds[i + 1]``), with the distances
    of their starts (least, greatest) and the hash of their gram; and the strings that repeat themselves by their period."""
    found, spans = [(np.zeros(0, np.int64),) * 4], []
    tops = bounds[1:]
    ends = np.repeat(tops, np.diff(bounds)) if len(tops) > 1 else np.broadcast_to(tops, len(data))
    for lo in range(0, len(data) - length + 1, PART_BYTES):
        hi = min(len(data), lo + PART_BYTES + length - 1)
        (a, first, last, gram), runs = _groups(data[lo:hi], ends[lo:hi] - lo, hashing, length)
        found.append((a + lo, first + lo, last + lo, gram))
        far = runs[1] - runs[0] >= length + 2 * runs[2]
        for s, e, q in zip(*((x[far] + y).tolist() for x, y in zip(runs, (lo, lo, 0), strict=True)), strict=True):
            text = int(np.searchsorted(tops, s, side="right"))
            while s < e:  # a run may go on in the next text
                end = min(e, int(tops[text]))
                if end - s >= length + 2 * q:
                    spans.append((s, end, q))
                s, text = end, text + 1
    a, first, last, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    # a sample whose starts lie in two parts
    fresh = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]]))
    final = np.append(fresh[1:], len(a))[: len(fresh)] - 1
    a, first, last, gram = a[fresh], first[fresh], last[final], gram[fresh]
    if spans:
        s, e, q = (np.array(x) for x in zip(*spans, strict=True))
        turn = np.argsort(s + 2 * q, kind="stable")
        low, high = (s + 2 * q)[turn], np.maximum.accumulate((e - length)[turn])
        before = np.searchsorted(low, first, side="right") - 1
        needed = (before < 0) | (high[before] < last)
        a, first, last, gram = a[needed], first[needed], last[needed], gram[needed]
    runs = np.array([x[:2] for x in spans], np.int64).reshape(-1, 2)
    return (a, a - last, a - first, gram), (runs[:, 0], runs[:, 1])


def _layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and their bounds; null is empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), bounds


def _parts(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of ``PART_BYTES`` together, one text at least."""
    at = 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PART_BYTES, side="right")) - 1)
        yield at, stop
        at = stop


def _sampled(texts: DataFrame, length: int) -> DataFrame:
    """Samples, and as rows without a gram the strings that repeat themselves (from ``low`` to ``high``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = RollingHash()
        for batch in batches:
            rows = batch.column(ROW).to_numpy()
            data, bounds = _layout(batch.column("_text"))
            for i, j in _parts(bounds):
                own = bounds[i : j + 1] - bounds[i]
                (a, low, high, gram), (start, end) = samples(data[bounds[i] : bounds[j]], own, hashing, length)
                text, of_run = (np.searchsorted(own, x, side="right") - 1 for x in (a, start))
                none = np.zeros(len(start), np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        ROW: pa.array(rows[i + np.concatenate([text, of_run])]),
                        "a": pa.array(np.concatenate([a - own[text], none]).astype(np.int32)),
                        "low": pa.array(np.concatenate([low, start - own[of_run]]).astype(np.int32)),
                        "high": pa.array(np.concatenate([high, end - own[of_run]]).astype(np.int32)),
                        "gram": pa.array(np.concatenate([gram, none]), mask=np.arange(len(a) + len(start)) >= len(a)),
                    }
                )

    return texts.select(ROW, "_text").mapInArrow(tidy(run), f"{ROW} long, a int, low int, high int, gram long")


def _attach(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with the list of each; the lists of a bucket, a part of its texts' size, are hashed."""
    return texts.join(lists.hint("shuffle_hash"), ROW, how)


def _named(texts: DataFrame, wanted: DataFrame, width: int, length: int) -> DataFrame:
    """For every block of distances that is wanted the names of its union (null where it leaves the text) and its intersection."""
    far = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = RollingHash()
        for batch in batches:
            rows = batch.column(ROW).to_numpy()
            data, bounds = _layout(batch.column("_text"))
            lists = batch.column("wanted")
            held = lists.offsets.to_numpy().astype(np.int64)
            blocks = lists.flatten()
            held = held - held[0]
            for i, j in _parts(bounds):
                yield named(rows[i:j], data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], held[i : j + 1], blocks, hashing)

    def named(
        rows: np.ndarray, data: np.ndarray, bounds: np.ndarray, held: np.ndarray, blocks: pa.StructArray, hashing: RollingHash
    ) -> pa.RecordBatch:
        part = blocks.slice(held[0], held[-1] - held[0])
        a, low, high, start, size, weight = (part.field(c).to_numpy().astype(np.int64) for c in ("a", "low", "high", "start", "size", "weight"))
        text = np.repeat(np.arange(len(rows)), np.diff(held))
        first = np.maximum(start, low // width * width)
        last = np.minimum(start + size - 1, high)
        n = np.maximum(0, (last - first) // width + 1)
        place = np.repeat(np.arange(len(a)), n)
        d0 = first[place] + (np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)) * width
        d1 = np.minimum(d0 + width - 1, far)
        origin, end = bounds[text[place]], bounds[text[place] + 1]
        at = origin + a[place]
        left, right = at - d1, at - d0 + length
        inside = (left >= origin) & (right <= end)
        view = memoryview(data)
        names = [
            hashlib.blake2b(view[x:y], digest_size=16).digest() if fits else None
            for x, y, fits in zip(left.tolist(), right.tolist(), inside.tolist(), strict=True)
        ]
        core = hashing.spans(hashing.sums(data), at - d0, at - d1 + length)
        small = {"a": a[place], "low": low[place], "high": high[place], "d0": d0, "start": left - origin, "end": right - origin, "weight": weight[place]}
        return pa.RecordBatch.from_pydict(
            {
                ROW: pa.array(rows[text[place]]),
                **{c: pa.array(v.astype(np.int32)) for c, v in small.items()},
                "all": pa.array(names, pa.binary()),
                "core": pa.array(core.view(np.int64)),
            }
        )

    lists = wanted.groupBy(ROW).agg(F.collect_list(F.struct("a", "low", "high", "start", "size", "weight")).alias("wanted"))
    schema = f"{ROW} long, a int, low int, high int, d0 int, start int, end int, weight int, all binary, core long"
    return _attach(texts.select(ROW, "_text"), lists, "inner").mapInArrow(tidy(run), schema)


def few_tasks(df: DataFrame, rows: int, texts: int = 0) -> DataFrame:
    """``df``, made of so many rows and texts, in no more tasks than they are worth: with many shuffle partitions and few rows nearly all time
    goes into starting the tasks that write."""
    context = df.sparkSession.sparkContext
    tasks = max(2 * context.defaultParallelism, -(-rows // TASK_ROWS), -(-texts // TASK_TEXTS))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (``_row``, ``start``, ``end``) that together cover the repeated bytes. ``texts`` has ``_row`` and ``_text`` and lies in
    buckets of ``_row``."""
    spark = texts.sparkSession
    n_texts = texts.count()
    sampled = stage(_sampled(texts, length), "repeats-sampled")
    spans = [stage(sampled.where("gram is null").select(ROW, F.col("low").alias("start"), F.col("high").alias("end")), "repeats-spans")]
    rows = sampled.count()
    grams = sampled.where("gram is not null").groupBy("gram").count().where("count > 1").select("gram")
    grams = stage(few_tasks(grams, rows), "repeats-grams")
    whole = length - GRAM + 1
    block = [F.lit(x).alias(c) for c, x in (("start", 0), ("size", whole), ("weight", 1))]
    wanted = sampled.join(grams, "gram", "left_semi").select(ROW, "a", "low", "high", *block)
    wanted = stage(few_tasks(wanted, rows), "repeats-wanted")
    discard(spark, sampled, grams)
    for width in (whole, *LEVELS):
        named = stage(few_tasks(_named(texts, wanted, width, length), wanted.count(), n_texts), "repeats-named")
        rows = named.count()
        known = named.where("all is not null")
        repeated = (
            known.groupBy("all", "d0")
            .agg(F.sum("weight").alias("n"), F.min(F.struct(ROW, "a")).alias("rep"))
            .where("n > 1")
            .select("all", "d0", "rep")
        )
        repeated = stage(few_tasks(repeated, rows), "repeats-unions")
        met = known.join(repeated, ["all", "d0"], "left").drop("all")
        unknown = named.where("all is null").drop("all").withColumn("rep", F.lit(None).cast(repeated.schema["rep"].dataType))
        flagged = stage(few_tasks(met, rows).unionByName(unknown), "repeats-flagged")
        spans.append(stage(flagged.where("rep is not null and weight = 1").select(ROW, "start", "end"), "repeats-spans"))
        discard(spark, wanted, named, repeated)
        if width > 1:
            is_open = F.col("rep").isNull() & (F.col("weight") == 1)
            cores = (
                flagged.groupBy("core", "d0")
                .agg(F.sum("weight").alias("n"), F.sum(is_open.cast("int")).alias("open"))
                .where("n > 1 and open > 0")
                .select("core", "d0")
            )
            cores = stage(few_tasks(cores, rows), "repeats-cores")
            is_rep = (F.col(f"rep.{ROW}") == F.col(ROW)) & (F.col("rep.a") == F.col("a"))
            going = flagged.where(is_open | is_rep).join(cores, ["core", "d0"], "left_semi")
            weight = F.when(is_open, 1).otherwise(2).alias("weight")
            going = going.select(ROW, "a", "low", "high", F.col("d0").alias("start"), F.lit(width).alias("size"), weight)
            wanted = stage(few_tasks(going, rows), "repeats-wanted")
            discard(spark, cores)
        discard(spark, flagged)
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left, how many bytes go and in how many maximal runs."""
    kept, at, removed, runs = [], 0, 0, 0
    last = -1
    for start, end in sorted(spans):
        if start > last:
            kept.append(data[at:start])
            runs += 1
            last, removed = end, removed + end - start
        elif end > last:
            removed, last = removed + end - last, end
        at = max(at, last)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept_text`` (the bytes left, bad sequences at cuts
    within a character dropped)."""
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    own = docs.drop(*[c for c in added if c != text], ROW, "_text")
    laid_out = stage_buckets(own.withColumn(ROW, F.monotonically_increasing_id()), ROW, "repeats-texts")
    discard(docs.sparkSession)
    texts = laid_out.withColumn("_text", F.col(text).cast("string"))
    lists = repeated_spans(texts, length).groupBy(ROW).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    # a text that is a string already is not sent twice
    plain = isinstance(own.schema[text].dataType, T.StringType)
    source = text if plain else "_text"
    joined = _attach(texts.drop("_text") if plain else texts, lists, "left").drop(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _layout(batch.column(source))
            for i, j in _parts(bounds):
                yield without(batch.slice(i, j - i), data, bounds[i : j + 1])

    def without(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        out = []
        for x, y, found in zip(bounds[:-1], bounds[1:], part.column("_spans").to_pylist(), strict=True):
            left, removed, runs = cut(data[x:y].tobytes(), [(f["start"], f["end"]) for f in found or []])
            out.append((y - x, removed, runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        names = [c for c in part.schema.names if c not in ("_text", "_spans")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [part.column(c) for c in names] + [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
            names=[*names, *added],
        )

    fields = [f for f in joined.schema.fields if f.name not in ("_text", "_spans")]
    numbers = [T.StructField(c, T.LongType()) for c in added[:3]]
    schema = T.StructType([*fields, *numbers, *(T.StructField(c, T.StringType()) for c in added[3:])])
    return joined.mapInArrow(tidy(run), schema)
