"""A Merkle manifest of a dataset: trees per group, their roots combined, and proofs from a few stored levels.

Every row is a leaf. The leaves of a group, in the order of their key, are the lowest level of a binary tree; the groups' roots, in the order
of the group, are the leaves of one more tree. Only every ``EVERY``-th level is written (checkpoints): a stored row is an aligned block of up
to ``2 ** EVERY`` nodes of one stored level, that is the base of one subtree. To extract proofs, stored levels are walked from the top down:
each block's interior nodes are computed anew from the block, the siblings on the way up are emitted for each of its nodes, joined to
the path of the block's own root, and the interior is discarded. So a proof costs one subtree for each stored level, whatever the size
of the group, and the manifest stores about ``1 + 2 ** -EVERY`` digests for each row.

Positions come from a range sort over (group, key, digest), so that a group which holds most of the rows is spread over many partitions,
and from row numbers within a partition plus the sizes of the partitions before it. No step gathers more than one block.

A digest H is the sha256 of the concatenated inputs; digests enter as 64 characters of lowercase hex. A run of nodes that is shorter than two
(the last of a level) becomes the H of what there is; the only node of a level is the root.

Edge cases: nulls in any column are part of the leaf (``-``); rows without a key come first in their group; rows of the same key are ordered by
their digest, equal rows are leaves of their own; null is a group, before all others; a tree of one leaf has that leaf as its root and an
empty path; an empty table has no root and no proofs. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.tables import BROADCAST_IDS
from shelfwise.staging import stage

EVERY = 8  # levels from one stored level to the next
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")  # what a leaf covers, in this order


def digest(parts: Sequence[bytes]) -> bytes:
    """H of digests in hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(values: Sequence[Column]) -> Column:
    """H of values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def interior(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels of a subtree from its base up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def height(size: int, every: int) -> int:
    """Levels that a block of a stored level with ``size`` nodes spans: all up to the root, or ``every``."""
    return min(every, max(size - 1, 0).bit_length())


def siblings(levels: list[list[bytes]], i: int) -> list[tuple[str, bytes]]:
    """The way from node ``i`` of the base to the top: side (``L``, ``R``, or ``-`` for none) and digest of each sibling."""
    out = []
    for nodes in levels[:-1]:
        other = i ^ 1
        out.append(("-", b"") if other >= len(nodes) else ("L" if other < i else "R", nodes[other]))
        i >>= 1
    return out


def fold(leaf: bytes, path: Sequence[tuple[str, bytes]]) -> bytes:
    """The root that a leaf and its path give."""
    for side, other in path:
        leaf = digest([leaf] if side == "-" else [other, leaf] if side == "L" else [leaf, other])
    return leaf


def pack(path: Sequence[tuple[str, bytes]]) -> bytes:
    return b"".join(side.encode() + bytes.fromhex(other.decode()) for side, other in path)


def unpack(path: bytes) -> list[tuple[str, bytes]]:
    out, i = [], 0
    while i < len(path):
        side = chr(path[i])
        end = i + (1 if side == "-" else 33)
        out.append((side, path[i + 1 : end].hex().encode()))
        i = end
    return out


def in_order(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within ``group`` by ``order``) and ``size`` (rows of the group), as a written table.

    The sort ends with a running number of the input, so that even equal rows are spread over partitions."""
    keys = [group, *order, "_row"]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = stage(ordered.drop("_row"), "merkle-order").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("_part", group).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        runs.select(
            "_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
            F.sum("_n").over(Window.partitionBy(group)).alias("size"),
        ),
        "merkle-starts",
    )
    # one row for each partition and group that meet
    small = starts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = placed.join(F.broadcast(starts) if small else starts, ["_part", group])
    return joined.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _lift(blocks: DataFrame, every: int) -> DataFrame:
    """Root of each block: the nodes of the next stored level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, roots = batch.column("size").to_pylist(), []
            for i, size in enumerate(sizes):
                nodes = [x.hex().encode() for x in batch.column("items")[i].values.field("node").to_pylist()]
                roots.append(bytes.fromhex(interior(nodes, height(size, every))[-1][0].decode()))
            nodes_above = [-(-size >> every) if size > 1 << every else 1 for size in sizes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("block"), pa.array(nodes_above, pa.int64()), pa.array(roots, pa.binary())],
                names=["g", "pos", "size", "node"],
            )

    return blocks.mapInArrow(run, "g string, pos long, size long, node binary")


@dataclass
class Tree:
    """Stored levels from the base up, as blocks (``g``, ``block``, ``size``, ``items``), and the root of each group (``g``, ``node``)."""

    stored: list[DataFrame]
    roots: DataFrame
    every: int

    @classmethod
    def build(cls, nodes: DataFrame, payload: Sequence[str] = (), every: int = EVERY) -> Tree:
        """From rows ``g``, ``pos``, ``size``, ``node`` (32 bytes) and what is to come back with a proof."""
        stored: list[DataFrame] = []
        while True:
            item = F.struct("pos", "node", *(payload if not stored else ()))
            block = F.shiftright("pos", every).alias("block")
            blocks = nodes.groupBy("g", block).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))
            stored.append(stage(blocks, f"merkle-level-{every * len(stored)}"))
            nodes = stage(_lift(stored[-1], every), "merkle-nodes")
            if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
                return cls(stored, nodes.select("g", "node"), every)

    def paths(self, above: DataFrame, emit: Callable | None = None, schema: str = "") -> DataFrame:
        """Proofs of all base nodes. ``above`` has the packed path of each group's root (``g``, ``path``) and passes on its further column
        ``extra``. ``emit`` makes the columns of ``schema`` from (group, extra, items, paths) of a block; by default ``g``, ``pos``, ``extra`` and ``path``."""
        every = self.every

        def extract(columns: Callable):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        items = batch.column("items")[i].values
                        nodes = [x.hex().encode() for x in items.field("node").to_pylist()]
                        levels = interior(nodes, height(batch.column("size")[i].as_py(), every))
                        rest = unpack(batch.column("path")[i].as_py())
                        found = [siblings(levels, k) + rest for k in range(len(nodes))]
                        yield columns(batch.column("g")[i].as_py(), batch.column("extra")[i].as_py(), items, found)

            return run

        def plain(g, extra, items, found):
            return pa.RecordBatch.from_pydict(
                {
                    "g": pa.array([g] * len(found), pa.string()),
                    "pos": items.field("pos"),
                    "extra": pa.array([extra] * len(found), pa.binary()),
                    "path": pa.array([pack(p) for p in found], pa.binary()),
                }
            )

        above = above.withColumn("block", F.lit(0).cast("long"))
        for level in reversed(range(len(self.stored))):
            last = level == 0 and emit is not None
            both = self.stored[level].join(above, ["g", "block"]).select("g", "size", "items", "path", "extra")
            above = both.mapInArrow(extract(emit if last else plain), schema if last else "g string, pos long, extra binary, path binary")
            if level:
                above = above.withColumnRenamed("pos", "block")
        return above


@dataclass
class Manifest:
    groups: Tree
    top: Tree
    root: str | None


def build(docs: DataFrame, group: str = "lang", key: str = "doc_id", claim: Sequence[Column] | None = None, every: int = EVERY) -> Manifest:
    """The manifest of ``docs``. ``claim`` are the values of a leaf as somebody presents them for verification (default: the values themselves)."""
    own = [F.col(c) for c in COLUMNS]
    leaves = docs.select(
        # null before all others, then by bytes
        F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("g"),
        F.col(key).cast("long").alias("key"),
        F.unhex(leaf_digest(own)).alias("node"),
        F.unhex(leaf_digest(own if claim is None else claim)).alias("claim"),
    )
    groups = Tree.build(in_order(leaves, "g", ["key", "node", "claim"]), ["key", "claim"], every)
    subroots = groups.roots.select(F.lit("").alias("all"), "g", "node")
    ranked = in_order(subroots, "all", ["g"]).select(F.col("all").alias("g"), "pos", "size", "node", F.col("g").alias("group"))
    top = Tree.build(ranked, ["group"], every)
    row = top.roots.first()
    return Manifest(groups, top, bytes(row["node"]).hex() if row else None)


def verify(manifest: Manifest) -> DataFrame:
    """Per leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, its ``proof`` (siblings in hex, bottom up, without the empty places), its digest, the root
    folded from the claimed leaf, and whether that is the root."""
    root = (manifest.root or "").encode()

    def of_groups(g, extra, items, found):
        return pa.RecordBatch.from_pydict(
            {
                "g": items.field("group"),
                "path": pa.array([pack(p) for p in found], pa.binary()),
                "extra": items.field("node"),
            }
        )

    def of_leaves(g, extra, items, found):
        claims = [x.hex().encode() for x in items.field("claim").to_pylist()]
        folded = [fold(c, p) for c, p in zip(claims, found, strict=True)]
        proofs = [[other for side, other in p if side != "-"] for p in found]
        n = len(found)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": items.field("key"),
                "leaf": pa.array([x.hex() for x in items.field("node").to_pylist()], pa.string()),
                "subroot": pa.array([extra.hex()] * n, pa.string()),
                "root": pa.array([root.decode()] * n, pa.string()),
                "proof": pa.array([[o.decode() for o in p] for p in proofs], pa.list_(pa.string())),
                "proof_sha256": pa.array([digest(p).decode() for p in proofs], pa.string()),
                "folded_root": pa.array([f.decode() for f in folded], pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
        )

    start = manifest.top.roots.select("g", F.lit(b"").alias("path"), "node").withColumnRenamed("node", "extra")
    # (group, path of its root, its root), joined to the blocks of its tree
    above = manifest.top.paths(start, of_groups, "g string, path binary, extra binary")
    schema = "doc_id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return manifest.groups.paths(above, of_leaves, schema)
