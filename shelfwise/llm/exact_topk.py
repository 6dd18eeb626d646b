"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``, and lie in blocks of neighbouring ids (document ranges). A block keeps its forward index (its integer matrix)
and, for each dimension (term), the greatest and least value. For a query the bound of a block is the sum over terms of the larger of
query times greatest and query times least. Blocks are scored in order of their bounds until a bound falls below the kth score so far.

On the cluster, runs of blocks and runs of queries (both of bounded size) are rows, their numbers as short as they may be. Runs of blocks are dealt to homes, and each
query run is sent once to every home, not to every run of blocks: a task holds the blocks of its home and passes the query runs by them one at a time.
The candidates of a home are the best ``k`` of each query there, and a window with its group limit keeps the best ``k`` of all homes. Nothing
that grows with the table is broadcast or gathered. The scores to look at still grow with the square of the table where bounds rule out little.

Edge cases: a vector that is null, empty of values but present, or holds null, NaN or infinite components: only the empty one takes part, with
vectors of its own length as all do; components beyond ``2**40`` after scaling are cut to it; scores beyond the range of long are cut
to it; repeated ids are rows of their own, a query's own row alone is no candidate; ties go to the smaller id; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.staging import discard, stage

LIMIT = 1 << 40
BLOCK = 512  # vectors in a block
RUN_BYTES = 1 << 20  # of a run of blocks or of queries, with 8 bytes a number
HOME_BYTES = 32 << 20  # of the blocks of a home, as they are stored
LEAST_HOMES = 48  # if there are as many runs, so that small tables keep many tasks busy
FOUND = "query_id long, query_row long, vec_id long, score long"
NO_SCORE = -(1 << 63)


def _norm(x: np.ndarray) -> float:
    """Greatest length of a row."""
    return float(np.sqrt(np.square(x.astype(np.float64)).sum(axis=1).max(initial=0)))


def block_scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Integer inner products, as floating numbers where these are exact: no sum of some of the products is beyond the product of the lengths."""
    top = 1.001 * _norm(queries) * _norm(block)
    for kind, exact in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if top < exact:
            return queries.astype(kind) @ block.T.astype(kind)
    whole = queries.astype(object) @ block.T.astype(object)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[max(low, min(high, int(v))) for v in row] for row in whole], np.int64).reshape(whole.shape)


class _Best:
    """The best ``k`` rows of each of ``n`` queries so far."""

    def __init__(self, n: int, k: int):
        self.k, self.have = k, np.zeros(n, np.int64)
        self.ids, self.scores = np.zeros((n, k), np.int64), np.full((n, k), NO_SCORE, np.int64)

    def bar(self, kind: np.dtype) -> np.ndarray:
        """The least score that still counts; those beyond what ``kind`` holds exactly stay beyond."""
        full = self.have == self.k
        last = self.scores[:, -1]
        return np.where(full, last.astype(kind), kind.type(-np.inf) if kind.kind == "f" else NO_SCORE)

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(of)
        held = np.arange(self.k) < self.have[touched][:, None]
        of = np.concatenate([np.repeat(touched, self.have[touched]), of])
        ids, scores = np.concatenate([self.ids[touched][held], ids]), np.concatenate([self.scores[touched][held], scores])
        order = np.lexsort((ids, ~scores, of))  # ~ turns the order of all integers around
        of, ids, scores = of[order], ids[order], scores[order]
        starts = np.searchsorted(of, touched)
        counts = np.diff(np.append(starts, len(of)))
        place = np.arange(len(of)) - np.repeat(starts, counts)
        fits = place < self.k
        self.ids[of[fits], place[fits]], self.scores[of[fits], place[fits]] = ids[fits], scores[fits]
        self.have[touched] = np.minimum(counts, self.k)


def search_run(
    q: np.ndarray, q_rows: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its best ``k`` rows of the blocks of one home.

    Every query takes the blocks in the order of its bounds, in rounds of twice as many each; queries that take a block in the same round are
    multiplied with it together, but for those whose kth score is above its bound."""
    starts = range(0, len(v), BLOCK)
    high = np.stack([v[s : s + BLOCK].max(axis=0) for s in starts]).astype(np.float64)
    low = np.stack([v[s : s + BLOCK].min(axis=0) for s in starts]).astype(np.float64)
    positive, negative = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    # rounding may lower a bound by a relative 1e-12 at most
    bounds = positive @ high.T + negative @ low.T
    bounds += 1e-9 * (positive @ np.abs(high).T - negative @ np.abs(low).T)
    place = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1).astype(np.int32)
    best = _Best(len(q), k)
    done, size = 0, 1
    while done < len(starts):
        due = (place >= done) & (place < done + size)
        for b, s in enumerate(starts):
            some = np.flatnonzero(due[:, b] & (bounds[:, b] >= best.bar(bounds.dtype)))
            if not len(some):
                continue
            score = block_scores(q[some], v[s : s + BLOCK])
            bar = best.bar(score.dtype)[some]
            new = np.flatnonzero(best.have[some] < k)
            if len(new) and score.shape[1] > k + 1:  # of a block no more than k rows count, beside the query's own
                bar[new] = np.partition(score[new], -k - 1, axis=1)[:, -k - 1]
            of, at = np.divmod(np.flatnonzero(score >= bar[:, None]), score.shape[1])
            others = rows[s + at] != q_rows[some[of]]
            of, at = of[others], at[others]
            if len(of):
                best.add(some[of], ids[s : s + BLOCK][at], score[of, at].astype(np.int64))
        done, size = done + size, 2 * size
    return [(best.ids[i, :n], best.scores[i, :n]) for i, n in enumerate(best.have)]


def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a number and the numbers, as short as they may be."""
    least, most = int(values.min(initial=0)), int(values.max(initial=0))
    width = next(w for w in (2, 4, 8) if -(1 << (8 * w - 1)) <= least and most < 1 << (8 * w - 1))
    return width, values.astype(f"<i{width}").tobytes()


def _runs(table: DataFrame) -> DataFrame:
    """Rows of (dim, width, ids, row numbers, values): neighbouring vectors packed up to ``RUN_BYTES``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def flush(dim: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
            ids, rows, values = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            most = -(-RUN_BYTES // (8 * max(dim, 1)))
            end = len(ids) if all_rows else len(ids) // most * most
            for a in range(0, end, most):
                b = min(end, a + most)
                width, stored = _narrow(values[a:b])
                parts = ("<i8", ids), ("<i8", rows)
                cells = [pa.array([x[a:b].astype(kind).tobytes()], pa.binary()) for kind, x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([width], pa.int32()), *cells, pa.array([stored], pa.binary())],
                    names=["dim", "width", "ids", "rows", "values"],
                )
            if end < len(ids):
                held[dim] = [(ids[end:], rows[end:], values[end:])]

        for batch in batches:
            lists = batch.column("v")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                some = lists if len(at) == len(sizes) else lists.take(pa.array(at))
                values = some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                ids, rows = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("id", "row"))
                held.setdefault(int(dim), []).append((ids, rows, values))
                if sum(len(x[0]) for x in held[dim]) * 8 * max(dim, 1) >= RUN_BYTES:
                    yield from flush(int(dim), False)
        for dim in list(held):
            yield from flush(dim, True)

    return table.mapInArrow(pack, "dim int, width int, ids binary, rows binary, values binary")


def home_count(n_runs: int, stored: int) -> int:
    """Homes for so many runs of blocks of so many bytes together."""
    return max(1, -(-stored // HOME_BYTES), min(n_runs, LEAST_HOMES))


def _numbers(row: dict, name: str) -> np.ndarray:
    if name == "values":
        return np.frombuffer(row["values"], f"<i{row['width']}").reshape(-1 if row["dim"] else len(row["ids"]) // 8, row["dim"])
    return np.frombuffer(row[name], "<i8")


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition by home, in each home the runs of blocks before the runs of queries."""
    at, blocks, home = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if at != (row["dim"], row["home"]):
                at, blocks, home = (row["dim"], row["home"]), [], None
            if not row["is_query"]:
                blocks.append([_numbers(row, c) for c in ("values", "ids", "rows")])
                continue
            if not blocks:
                continue
            if home is None:
                home, blocks = [np.concatenate(x) for x in zip(*blocks, strict=True)], [None]
            q, q_ids, q_rows = (_numbers(row, c) for c in ("values", "ids", "rows"))
            found = search_run(q, q_rows, *home, k)
            sizes = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": np.repeat(q_ids, sizes),
                    "query_row": np.repeat(q_rows, sizes),
                    "vec_id": np.concatenate([f[0] for f in found]),
                    "score": np.concatenate([f[1] for f in found]),
                }
            )


def top_k(
    table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` for every row of ``table`` that satisfies ``is_query``."""
    x = F.col(vector)
    usable = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    )
    whole = F.transform(
        x,
        lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c.cast("double") * scale).cast("double"))).cast("long"),
    )
    vectors = (
        table.where(usable & F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    # by ranges of ids; the row number splits the rows of one id
    ordered = stage(vectors.repartitionByRange("id", "row").sortWithinPartitions("id", "row"), "topk-vectors")
    blocks = stage(_runs(ordered).withColumn("run", F.monotonically_increasing_id()), "topk-blocks")
    discard(table.sparkSession)
    n_runs, stored = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("values")), F.lit(0))).first()
    homes = home_count(n_runs, stored)
    home = F.pmod(F.xxhash64("run"), F.lit(homes)).cast("int")
    packed = _runs(ordered.where("q").repartitionByRange(1 + n_runs // 100, "id", "row").sortWithinPartitions("id", "row"))
    both = _met(blocks.select("*", home.alias("home")).drop("run"), packed, homes)
    found = both.mapInArrow(partial(_search, k), FOUND)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _met(blocks: DataFrame, queries: DataFrame, homes: int) -> DataFrame:
    """Runs of blocks with their ``home`` and each query run once for every home, a partition for a home, blocks first."""
    sent = queries.select("*", F.explode(F.sequence(F.lit(0), F.lit(homes - 1))).alias("home"), F.lit(True).alias("is_query"))
    both = blocks.withColumn("is_query", F.lit(False)).unionByName(sent)
    return both.repartitionById(homes, "home").sortWithinPartitions("dim", "home", "is_query")
