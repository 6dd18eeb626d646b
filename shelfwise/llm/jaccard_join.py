"""N-gram Jaccard join: a size-aware heavy-light join on word shingles, exact, giving connected classes of near-copies.

Sets are the distinct shingles of a text; texts with the same set are one node. All sets are ordered alike: tokens that many sets hold (heavy
tokens) last, else by hash. Sets that link share at least ``ceil(0.75 n)`` tokens, so the first ``n - ceil(0.75 n) + c`` tokens
of both share at least ``c``.

* Small sets (at most ``boundary`` tokens) enumerate the subsets of two of their prefix for ``c = 2``; two small sets that link share such a subset.
* Large sets are found by inverted lists over the tokens of the prefix for ``c = 1``; sets small enough to enumerate and large enough to link
  with a large one are in the lists, too.
* The boundary is the size class at which enumerating costs as much as reading the lists, by the sizes and list lengths counted here.
* Lists of up to ``list_limit`` nodes give pairs; a pair goes on when it shares as many listed tokens as a link needs. The rest is checked on
  the whole sets, first along one best partner per node, then whatever still lies between different classes.
* Longer lists (large groups of near-copies) are cut by hash into blocks of bounded size; each pair of blocks is one group,
  in which whole sets are compared by numpy and only a spanning forest of the links leaves the task.

No pair is capped or sampled; the checks compare whole sets.

Edge cases: texts that are null, empty or without words have no shingles and link with nothing; repeated rows share a node; repeated keys keep
their rows, the class id is the least key among all rows of a class (null only if all keys are null); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.llm.components import connected_components
from shelfwise.llm.shingles import PrimeHash, shingle_set
from shelfwise.llm.tables import give_back, parts_by_bytes, restrict, tidy
from shelfwise.staging import stage

PERCENT = 75
PART_BYTES = 4 << 20  # texts made into sets at a time
PART_NODES = 1024  # nodes made into rows of lists at a time


@dataclass(frozen=True)
class JoinPolicy:
    """``heavy``: sets that hold a token before it counts as heavy; raised so that at most ``max_heavy`` tokens (8 bytes each) are broadcast.
    ``list_limit``: nodes in a list that still gives pairs. ``block`` and ``block_tokens``: expected
    nodes and tokens in a block of a longer one, at most."""

    heavy: int = 50
    max_heavy: int = 1_000_000
    list_limit: int = 200
    block: int = 512
    block_tokens: int = 500_000


def need(n):
    """Least overlap of a set of ``n`` tokens with any set that it links with."""
    return -(-PERCENT * n // 100)


def links(overlap: Column, a: Column, b: Column) -> Column:
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _sets(docs: DataFrame, key: str, text: str, head: bool, mark: str | None = None) -> DataFrame:
    """``doc_id``, ``n``, ``set_id`` and the tokens by hash: the first of them (``head``) or all; also the column ``mark``, if named."""

    marks = [mark] if mark else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return set_batches(batches, head, marks)

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), *marks)
    return source.mapInArrow(tidy(run), ", ".join(["doc_id long, n long, set_id long, tokens array<long>"] + [f"{c} long" for c in marks]))


def set_batches(batches: Iterator[pa.RecordBatch], head: bool, marks: list[str]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts of each batch, some texts at a time."""
    hashing = PrimeHash()
    for batch in batches:
        for part in parts_by_bytes(batch, "t", PART_BYTES):
            sizes, ids, kept = [], [], []
            for t in part.column("t").to_pylist():
                s = shingle_set(t, hashing)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                kept.append(s[: 2 * (len(s) - need(len(s)) + 2)].copy() if head else s)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), tokens, *[part.column(c) for c in marks]],
                names=["doc_id", "n", "set_id", "tokens", *marks],
            )


def _texts_of(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows with one of ``keys``, and those without a key."""
    known = restrict(docs, keys.where(F.col(key).isNotNull()), key, "left_semi")
    return known.unionByName(docs.where(F.col(key).isNull()))


def _heavy_tokens(nodes: DataFrame, sizes: list[tuple[int, int]], policy: JoinPolicy) -> tuple[np.ndarray, float]:
    """Tokens held by many sets, and how many partners a light token brings on average; counted over the first tokens of all sets."""
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    counted = nodes.select(F.explode(F.slice("tokens", F.lit(1), (F.ceil(prefix * 1.4) + 1).cast("int"))).alias("token"))
    counts = stage(counted.groupBy("token").count().where("count > 1"), "jaccard-counts")
    n = F.col("count")
    held = F.when(n >= policy.heavy, n)
    total, pairs = counts.agg(F.sum(held), F.sum(F.when(n < policy.heavy, n * (n - 1)))).first()
    # tokens with count >= total / max_heavy are max_heavy at most
    limit = max(policy.heavy, math.ceil((total or 0) / policy.max_heavy))
    rows = counts.where(n >= limit).select("token").toPandas()
    tokens = sum(c * (1.4 * (size - need(size) + 1) + 1) for size, c in sizes)
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64)), (pairs or 0) / max(1.0, tokens)


def _boundary(sizes: list[tuple[int, int]], partners: float) -> int:
    """Largest small size: rows of subsets of two against rows of lists and their pairs, summed over size classes."""
    best, boundary, gain = 0.0, 0, 0.0
    for n, count in sorted(sizes):
        prefix = n - need(n)
        enumerate_cost = (prefix + 2) * (prefix + 1) / 2
        list_cost = (prefix + 1) * (1 + partners)
        gain += count * (list_cost - enumerate_cost)
        if gain > best:
            best, boundary = gain, n
    return boundary


def _postings(nodes: DataFrame, heavy: np.ndarray, boundary: int) -> DataFrame:
    """Rows (``kind``, ``list``, ``id``, ``n``): kind 0 for a list of a light key, 1 for one of a heavy token, 2 where the kept tokens
    do not reach the prefix and the whole set must be read."""
    lists_from = need(boundary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, PART_NODES) for b in batches for s in range(0, b.num_rows, PART_NODES)):
            ids, sizes = batch.column("set_id").to_pylist(), batch.column("n").to_pylist()
            flat = batch.column("tokens")
            values, offsets = flat.flatten().to_numpy().view(np.uint64), flat.offsets.to_numpy() - flat.offsets[0].as_py()
            is_heavy = np.isin(values, heavy)
            out_list, out_kind, out_id, out_n = [], [], [], []

            def put(keys: np.ndarray, kinds: np.ndarray | int, node: int, n: int) -> None:
                out_list.append(keys)
                out_kind.append(np.broadcast_to(np.asarray(kinds, np.int32), len(keys)))
                out_id.append(np.full(len(keys), node))
                out_n.append(np.full(len(keys), n))

            for i, (node, n) in enumerate(zip(ids, sizes, strict=True)):
                tokens, weight = values[offsets[i] : offsets[i + 1]], is_heavy[offsets[i] : offsets[i + 1]]
                p = n - need(n)
                small = n <= boundary
                wanted = min(n, p + 2 if small else p + 1)
                if len(tokens) < n and (~weight).sum() < wanted:
                    put(np.zeros(1, np.uint64), 2, node, n)
                    continue
                order = np.concatenate([np.flatnonzero(~weight), np.flatnonzero(weight)])
                tokens, weight = tokens[order], weight[order]
                if n >= lists_from:
                    put(tokens[: p + 1], weight[: p + 1], node, n)
                if small and n > 2:
                    a, b = np.triu_indices(min(n, p + 2), 1)
                    # order within a subset is that of all sets, so equal subsets give equal keys
                    put(_pair(tokens[a], tokens[b]), weight[a] & weight[b], node, n)
            if out_list:
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(np.concatenate(out_kind), pa.int32()),
                        "list": pa.array(np.concatenate(out_list).view(np.int64)),
                        "id": pa.array(np.concatenate(out_id).astype(np.int64)),
                        "n": pa.array(np.concatenate(out_n).astype(np.int64)),
                    }
                )

    return nodes.select("set_id", "n", "tokens").mapInArrow(tidy(run), "kind int, list long, id long, n long")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _light_pairs(light: DataFrame, heavy_counts: DataFrame, boundary: int) -> DataFrame:
    """Pairs of nodes that share a light list and enough lists for a link."""
    a = light.select("list", F.col("id").alias("a"), F.col("n").alias("na"))
    b = light.select("list", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "list").where(
        "a < b and 4 * least(na, nb) >= 3 * greatest(na, nb)"
    )
    shared = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("lists"))
    h = heavy_counts.select(F.col("id").alias("a"), F.col("heavy").alias("ha"))
    h2 = heavy_counts.select(F.col("id").alias("b"), F.col("heavy").alias("hb"))
    joined = shared.join(h, "a", "left").join(h2, "b", "left")
    zero = F.lit(0)
    tokens = F.col("lists") + F.least(F.coalesce("ha", zero), F.coalesce("hb", zero))
    # all tokens of the shorter-reaching prefix that the other set holds are in the other's prefix: what is shared beyond is the rest at most
    rest = F.greatest(F.expr(f"(na * {PERCENT} + 99) div 100"), F.expr(f"(nb * {PERCENT} + 99) div 100")) - 1
    overlap = F.expr(f"({PERCENT} * (na + nb) + {99 + PERCENT}) div {100 + PERCENT}")
    both_small = (F.col("na") <= boundary) & (F.col("nb") <= boundary)
    return joined.where(both_small | (tokens + rest >= overlap)).select("a", "b", "lists")


def _best_partners(pairs: DataFrame) -> DataFrame:
    """For each node its pair with the most lists in common."""
    forth = pairs.groupBy("a").agg(F.max(F.struct("lists", "b")).alias("x")).select("a", "x.b")
    back = pairs.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("x")).select("x.a", "b")
    return forth.union(back).distinct()


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(links(overlap, F.col("na"), F.col("nb"))).select("a", "b")


def forest_of_block(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between side 0 and side 1 (or within side 0 if there is no other)."""
    sizes = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    bits = 1 << max(6, int(4 * sizes.max() - 1).bit_length())
    member = np.repeat(np.arange(len(sets)), sizes)
    masks = np.zeros((len(sets), bits // 8), np.uint8)
    place = (tokens[inverse].view(np.uint64) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(masks, (member, place >> 3), (1 << (place & 7)).astype(np.uint8))
    words = masks.view(np.uint64)
    own = [inverse[e - n : e] for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    mark = np.zeros(len(tokens), bool)
    parent = np.arange(len(sets))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    edges = []
    two = sides.any()
    for i in np.argsort(sizes, kind="stable"):
        if two and sides[i]:
            continue
        others = np.flatnonzero(sides == 1) if two else np.arange(i + 1, len(sets))
        n, m = sizes[i], sizes[others]
        others = others[(4 * np.minimum(n, m) >= 3 * np.maximum(n, m))]
        # at least as many tokens differ as bits do
        differ = np.bitwise_count(words[others] ^ words[i]).sum(axis=1)
        others = others[(100 + PERCENT) * differ <= (100 - PERCENT) * (n + sizes[others])]
        if not len(others):
            continue
        mark[own[i]] = True
        for j in others:
            if find(int(i)) == find(int(j)):
                continue
            overlap = int(mark[own[j]].sum())
            if 100 * overlap >= PERCENT * (n + sizes[j] - overlap):
                parent[find(int(i))] = find(int(j))
                edges.append((int(ids[i]), int(ids[j])))
        mark[own[i]] = False
    return edges


def _groups(long_lists: DataFrame) -> DataFrame:
    """Rows (``list``, ``id``, ``length``, ``volume``) of the groups to compare: long lists, or all nodes that long lists connect where
    that makes fewer comparisons."""
    hubs = long_lists.groupBy("kind", "list").agg(F.min("id").alias("b"))
    stars = long_lists.join(hubs, ["kind", "list"]).select(F.col("id").alias("a"), "b")
    classes = connected_components(stars).withColumnRenamed("node", "id")
    placed = stage(
        long_lists.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id")), "jaccard-placed"
    )
    nodes = placed.select("component", "id", "n").distinct()
    cost = placed.groupBy("component").agg(F.sum("length").alias("by_lists"))
    whole = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("volume"))
    chosen = stage(
        cost.join(whole, "component").where("cast(length as double) * length <= by_lists"), "jaccard-whole"
    )
    by_class = nodes.join(chosen, "component").select(F.col("component").alias("list"), "id", "length", "volume", F.lit(2).alias("kind"))
    by_list = placed.join(chosen.select("component"), "component", "left_anti").select("list", "id", "length", "volume", "kind")
    return by_class.union(by_list)


def _heavy_links(long_lists: DataFrame, sets: DataFrame, policy: JoinPolicy) -> DataFrame:
    """Links of nodes that share a long list: hash blocks of a group, each pair of blocks compared on its own."""
    blocks = F.greatest(F.ceil(F.col("length") / policy.block), F.ceil(F.col("volume") / policy.block_tokens)).cast("int")
    sized = stage(_groups(long_lists), "jaccard-groups").withColumn("blocks", blocks)
    own = sized.withColumn("block", F.pmod(F.xxhash64("id", "list"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = own.withColumn("other", other).select(
        "kind",
        "list",
        "id",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    full = met.join(sets.select(F.col("set_id").alias("id"), "tokens"), "id")

    def compare(table: pa.Table) -> pa.Table:
        tokens = table.column("tokens").combine_chunks()
        bounds = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        sets_ = np.split(tokens.flatten().to_numpy(), bounds[1:-1])
        ids = table.column("id").to_numpy()
        sides = table.column("side").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        # a pair of different blocks in which one is empty holds no pair to compare
        edges = [] if not same and len(set(sides.tolist())) < 2 else forest_of_block(ids, sides, sets_)
        if len(tokens.values) > policy.block_tokens // 4:
            give_back()
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return full.groupBy("kind", "list", "i", "j").applyInArrow(compare, "a long, b long")


def near_copies(
    docs: DataFrame, policy: JoinPolicy | None = None, key: str = "doc_id", text: str = "text", mark: str | None = None
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    With ``mark``, a column of 64-bit row marks, also the mark and ``class_id``, which tells classes apart where keys are null or
    repeated (null for texts without shingles, each a class of its own)."""
    policy = policy or JoinPolicy()
    rows = stage(_sets(docs, key, text, head=True, mark=mark), "jaccard-heads")
    # one row per distinct set, under its least key
    nodes_of = stage(
        rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-nodes"
    )
    copies = rows.where("n > 0").select("set_id", "doc_id").join(nodes_of.select("set_id", "rep"), "set_id").where(
        "doc_id <> rep"
    )
    nodes = restrict(rows.where("n > 0"), copies.select("set_id", "doc_id").distinct(), ["set_id", "doc_id"], "left_anti")
    # sizes up to 4096 each, larger ones in steps of a sixteenth: a few hundred rows
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / 256.0)))
    rounded = F.when(F.col("n") <= 4096, F.col("n")).otherwise((F.floor(F.col("n") / step) * step).cast("long"))
    sizes = [(r[0], r[1]) for r in nodes_of.groupBy(rounded.alias("n")).count().collect()]
    heavy, partners = _heavy_tokens(nodes, sizes, policy)
    boundary = _boundary(sizes, partners)
    first = _postings(nodes, heavy, boundary)
    found = stage(first, "jaccard-postings")
    short = found.where("kind = 2").select(F.col("id").alias("set_id"))
    if short.take(1):
        reps = nodes_of.join(short, "set_id", "left_semi").select(F.col("rep").alias(key))
        whole = _sets(_texts_of(docs, reps, key), key, text, head=False)
        found = found.where("kind < 2").union(stage(_postings(whole, heavy, boundary), "jaccard-postings"))
    # lists of light keys are short, so a window counts them; those of heavy tokens are counted before they are dealt out
    of_list = Window.partitionBy("list")
    short_lists = found.where("kind = 0").withColumns(
        {"length": F.count(F.lit(1)).over(of_list), "volume": F.sum("n").over(of_list)}
    )
    lengths = found.where("kind = 1").groupBy("list").agg(F.count(F.lit(1)).alias("length"), F.sum("n").alias("volume"))
    heavy_lists = found.where("kind = 1").join(stage(lengths, "jaccard-lengths"), "list").select(short_lists.columns)
    lists = stage(short_lists.union(heavy_lists).where("length > 1"), "jaccard-lists")
    light = lists.where(F.col("length") <= policy.list_limit)
    long_lists = lists.where(F.col("length") > policy.list_limit)
    heavy_counts = long_lists.groupBy("id").agg(F.count(F.lit(1)).alias("heavy"))
    pairs = stage(_light_pairs(light, heavy_counts, boundary), "jaccard-pairs")
    wanted = stage(
        pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).union(long_lists.select("id")).distinct(), "jaccard-wanted"
    )
    reps = nodes_of.join(wanted, "set_id", "left_semi").select(F.col("rep").alias(key)).distinct()
    sets = stage(
        _sets(_texts_of(docs, reps, key), key, text, head=False)
        .join(wanted, "set_id", "left_semi")
        .dropDuplicates(["set_id"]),
        "jaccard-sets",
    )
    edges = stage(_checked(_best_partners(pairs), sets), "jaccard-links")
    if long_lists.take(1):
        edges = edges.union(stage(_heavy_links(long_lists, sets, policy), "jaccard-links"))
    # the pairs that still lie between classes
    classes = connected_components(edges)
    ca = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = pairs.join(ca, "a", "left").join(cb, "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")
    )
    more = stage(_checked(between.select("a", "b"), sets), "jaccard-links")
    if more.take(1):
        classes = connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    placed = nodes_of.join(classes.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id")
    )
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    # only sets that differ from their own class id are joined to the rows
    classed = [F.col("component").alias("class_id")] if mark else []
    named = placed.join(least, "component").select("set_id", "component_id", *classed)
    marks = [mark] if mark else []
    return (
        rows.select("doc_id", "n", "set_id", *marks)
        .join(named, "set_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            *marks,
            *(["class_id"] if mark else []),
        )
    )
