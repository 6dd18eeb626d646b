"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import stage


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by stars to the least node of each of its parts."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        star = [(x, find(x)) for x in list(parent)]
        star = [(x, r) for x, r in star if x != r]
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array(np.array([x for x, _ in star], np.int64)), "b": pa.array(np.array([r for _, r in star], np.int64))}
        )


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``a`` and ``b``; gives (``node``, ``component``) with the least node as the component, for
    every node that has an edge to another except the least of each component."""
    current = stage(edges.select("a", "b").where("a <> b").mapInArrow(forest, "a long, b long").distinct(), "cc-edges")
    while True:
        # large-star: every neighbour that is larger than a node joins the least of the node and its neighbours
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a node and its smaller neighbours join the least of these
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        following = stage(small, "cc-edges")
        # done when all edges are stars: no node is both a leaf and a centre, and each leaf has one centre
        leaves = following.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        centres = following.select(F.col("b").alias("a")).distinct()
        open_ = leaves.where("n > 1").select("a").limit(1).union(leaves.join(centres, "a", "left_semi").select("a").limit(1))
        if not open_.take(1):
            return following.select(F.col("a").alias("node"), F.col("b").alias("component"))
        current = following
