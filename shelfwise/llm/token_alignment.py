"""Alignment of two tokenizers' tokens over the bytes of each text, by merge-path partitioning.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte fallback; both read a blank and the text. Where tokens of
A and of B end at the same byte, a group ends; tokens whose byte ranges overlap are linked. The ends of all tokens of A and of B are two ascending
lists; merging them passes each linked pair once. The merge is cut by diagonals: on diagonal ``d`` a binary search finds how many of the first ``d``
merged ends are A's, so the piece between two diagonals can start on its own and all pieces have the same number of steps. Pieces emit their overlaps
and count the group ends they pass; prefix sums of these counts stitch the groups that cross pieces.

Texts are cut at single blanks between two characters that are no white space. Neither tokenizer joins across such a blank (A's pattern starts a new
part there, and no piece of B holds a blank after another character, which is checked when the model is loaded), so both have token ends there and no
group crosses it: a distinct unit of a batch is encoded and aligned once. Units are encoded many at a time and cut apart by their bytes.

How many documents hold a pair of ids linked is counted in a first pass: distinct pairs of each document, counted per batch, then by Spark. The second
pass needs the counts. Pairs are found by ``LIMIT``: if there are no more, all are broadcast, else the most frequent ones, at most ``LIMIT`` of them
(16 bytes each); documents then emit their other pairs, which are joined by shuffle. Each such pair is held by few documents, since all that are held by
many are broadcast, so no key of the join is hot.

Edge cases: texts that are null, empty, no valid UTF-8, or that either tokenizer does not restore byte by byte (B takes U+2581 for a blank) have no
tokens: zeros and an empty digest, and no part in the counts. Every row is a document of its own, also where ids are null or repeat. Strings of special
tokens are plain text. A long text is one batch. An empty table gives an empty result. Only the columns of key and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import stage

LIMIT = 2_000_000
STEP = 128  # merged ends in a piece
CHUNK = 8 << 20  # bytes of text aligned at a time
CALL = 1000  # units in one call of a tokenizer
BLOCK = 1 << 17  # units whose links are held at a time
LONG = 1000  # characters of a unit from which it is encoded alone
#: Fixed value: the pattern by which a byte-level pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space beside a blank, or at the ends of the text: Unicode's, and the separators that Python counts as such.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
IRREGULAR = f" {SPACE}|{SPACE} |^{SPACE}|{SPACE}$"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending; sorting is faster here than numpy's hashing."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


def merge_path(a: np.ndarray, b: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (index in ``a``, index in ``b``, group) of two ascending lists of token ends with the same last end."""
    n, m = len(a), len(b)
    total = n + m
    if not n or not m:
        none = np.zeros(0, np.int32)
        return none, none, none
    diagonal = np.arange(0, total, step)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        further = a[np.minimum(middle, n - 1)] <= b[np.maximum(diagonal - 1 - middle, 0)]
        low = np.where(open_ & further, middle + 1, low)
        high = np.where(open_ & ~further, middle, high)
    i, j = low, diagonal - low
    last = np.iinfo(np.int64).max
    a_end, b_end = np.append(a, last), np.append(b, last)
    a_start, b_start = np.concatenate([[0], a]), np.concatenate([[0], b])
    shape = (step, len(diagonal))
    at_a, at_b = np.empty(shape, np.int32), np.empty(shape, np.int32)
    linked, closed = np.empty(shape, bool), np.empty(shape, bool)
    for s in range(step):
        end_a, end_b = a_end[i], b_end[j]
        at_a[s], at_b[s] = i, j
        linked[s] = np.maximum(a_start[i], b_start[j]) < np.minimum(end_a, end_b)
        closed[s] = end_a == end_b
        take = end_a <= end_b
        i = np.minimum(i + take, n)
        j = np.minimum(j + ~take, m)
    steps = np.arange(step)[:, None] + diagonal < total
    linked &= steps & (at_a < n) & (at_b < m)
    closed &= steps & (at_a < n) & (at_b < m)
    # groups within a piece, then the pieces one after another
    passed = np.cumsum(closed, axis=0, dtype=np.int32)
    passed += np.concatenate([[0], np.cumsum(passed[-1])[:-1]]).astype(np.int32)
    passed -= closed
    keep = linked.T
    return at_a.T[keep], at_b.T[keep], passed.T[keep]


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, file_a: str, file_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte_of = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.merge = self._ranked(file_a)
        self.bytes_b = []
        self.separable = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:5], 16)]))
                continue
            self.separable &= "▁" not in piece[1:] or set(piece) == {"▁"}
            self.bytes_b.append(piece.replace("▁", " ").encode())
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def _ranked(self, file_a: str):
        """The merges as ranks for tiktoken, which is five times as fast, if the file says nothing but what ranks say: a byte-level pattern and merges
        that make the ids one after another. (A pair is then merged exactly when its bytes are a token, lowest id first.)"""
        import tiktoken

        with open(file_a, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        vocab = model.get("vocab") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or ()]
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
        plain &= spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and not cut.get("add_prefix_space")
        in_turn = all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
        ranks = {self.bytes_a[i]: i for i in vocab.values()} if plain and in_turn else {}
        if len(ranks) != len(vocab) or not ranks or b"" in ranks:
            return None
        return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str], alone: bool = False) -> Iterator[tuple[list[int], list[int]]]:
        """Of a blank and each text."""
        a = [" " + t for t in texts]
        if self.merge and not alone:
            ids = [self.merge.encode_ordinary(t) for t in a]
        else:
            ids = [x.ids for x in self.a.encode_batch_fast(a, add_special_tokens=False)]
        return zip(ids, self.b.encode(texts, num_threads=1), strict=True)

    def encode(self, words: list[str], sizes: np.ndarray):
        """Units (a blank and a word) in some order; in that order all ids and the counts of each unit, of A and of B; which units
        both restore. ``sizes`` are the words' bytes."""
        fits = [w and len(w) < LONG and not w[0].isspace() and not w[-1].isspace() for w in words]
        chained = [k for k, fit in enumerate(fits) if fit] if self.separable else []
        single = np.ones(len(words), bool)
        single[chained] = False
        alone = np.flatnonzero(single).tolist()
        order: list[int] = []
        flat: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        counts: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        calls = [chained[s : s + CALL] for s in range(0, len(chained), CALL)]
        texts = [" ".join([words[k] for k in call]) for call in calls]
        tables = ((self.bytes_a, self.size_a), (self.bytes_b, self.size_b))
        for call, text, both in zip(calls, texts, self._ids(texts) if texts else (), strict=True):
            data = b" " + text.encode()
            ends = np.cumsum(sizes[call] + 1)
            cut = [self._cut(ids, table, size, data, ends) for ids, (table, size) in zip(both, tables, strict=True)]
            if cut[0] is None or cut[1] is None:
                alone += call
                continue
            order += call
            for side, (ids, number) in enumerate(cut):
                flat[side].append(ids)
                counts[side].append(number)
        good = np.zeros(len(words), bool)
        good[order] = True
        for s in range(0, len(alone), CALL):
            part = alone[s : s + CALL]
            numbers: tuple[list[int], list[int]] = ([], [])
            for k, both in zip(part, self._ids([words[k] for k in part], alone=True), strict=True):
                data = b" " + words[k].encode()
                good[k] = all(b"".join([table[x] for x in ids]) == data for ids, (table, _) in zip(both, tables, strict=True))
                for side, ids in enumerate(both):
                    flat[side].append(np.array(ids if good[k] else [], np.int64))
                    numbers[side].append(len(ids) if good[k] else 0)
            for side in (0, 1):
                counts[side].append(np.array(numbers[side], np.int64))
        order += alone
        return np.array(order, np.int64), [np.concatenate(x) for x in flat], [np.concatenate(x) for x in counts], good[order]

    @staticmethod
    def _cut(ids: list[int], table: list[bytes], size: np.ndarray, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids and how many each unit has, or nothing if the tokens are not the units' bytes."""
        if b"".join([table[x] for x in ids]) != data:
            return None
        ids = np.array(ids, np.int64)
        token_ends = np.cumsum(size[ids])
        at = np.searchsorted(token_ends, ends)
        if not np.array_equal(token_ends[at], ends):
            return None
        return ids, np.diff(at, prepend=-1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow 255."""
    own = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 255 and x != 173]
    others = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(others)}


def units(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Words of the texts without the blank before them, and the order in which the texts come back."""
    irregular = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~irregular), np.flatnonzero(irregular)
    lists = [pc.split_pattern(texts.take(pa.array(plain)), " ").cast(pa.large_list(pa.large_string()))]
    if len(rest):
        cut = [[unit[1:] for unit in CUT.split(" " + t)] for t in texts.take(pa.array(rest)).to_pylist()]
        lists.append(pa.array(cut, pa.large_list(pa.large_string())))
    return pa.concat_arrays(lists), np.concatenate([plain, rest])


class Aligned:
    """The texts of a batch: ``order`` (rows of the batch), units by text, links by unit."""

    def __init__(self, pair: Pair, texts: pa.Array) -> None:
        lists, self.order = units(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        sizes = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = lists.offsets.to_numpy()
        self.offsets = offsets - offsets[0]
        order, (self.ids_a, self.ids_b), (self.n_a, self.n_b), self.good = pair.encode(words, sizes)
        self.count = len(words)
        place = np.empty(self.count, np.int64)
        place[order] = np.arange(self.count)
        self.unit = place[coded.indices.to_numpy(zero_copy_only=False)]
        link_a, link_b, self.group = merge_path(np.cumsum(pair.size_a[self.ids_a]), np.cumsum(pair.size_b[self.ids_b]))
        unit_of_a = np.repeat(np.arange(self.count, dtype=np.int32), self.n_a)
        self.link_a, self.link_b = link_a, link_b
        self.link_unit = unit_of_a[link_a]
        self.n_links = np.bincount(self.link_unit, minlength=self.count)
        self.first_link = np.concatenate([[0], np.cumsum(self.n_links)])
        opens = np.diff(self.group, prepend=-1) > 0
        self.n_groups = np.bincount(self.link_unit[opens], minlength=self.count)
        self.pairs = self.ids_a[link_a] << 32 | self.ids_b[link_b]
        self.whole = self.of_texts(~self.good) == 0

    def of_texts(self, per_unit: np.ndarray) -> np.ndarray:
        """Sums over the units of each text."""
        sums = np.concatenate([[0], np.cumsum(per_unit.astype(np.int64)[self.unit])])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def text_of_unit(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.whole)), np.diff(self.offsets))

    def _held(self, of_links: np.ndarray, of_units: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences of units in texts, the values of all their links, and the text of each."""
        n = self.n_links[of_units]
        ends = np.cumsum(n)
        at = np.repeat(self.first_link[of_units] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return of_links[at], np.repeat(texts, n)

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids and how many of the texts hold them."""
        values = distinct(self.pairs)
        size, n = max(1, len(values)), max(1, self.count)
        code = np.searchsorted(values, self.pairs)
        counts = np.zeros(len(values), np.int64)
        texts = self.text_of_unit()
        # texts of about BLOCK units at a time
        block = self.offsets[:-1] // BLOCK
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for first, last in zip(self.offsets[starts], np.append(self.offsets[starts[1:]], self.offsets[-1:]), strict=True):
            own, unit = texts[first:last], self.unit[first:last]
            chosen = self.whole[own]
            held = distinct(own[chosen] * n + unit[chosen])
            codes, of = self._held(code, held % n, held // n)
            counts += np.bincount(distinct(of * size + codes) % size, minlength=len(values))
        return values[counts > 0], counts[counts > 0]

    def rare(self, known: np.ndarray) -> list[list[dict]]:
        """For each text the pairs whose links are not ``known``, with the number of links."""
        values = distinct(self.pairs)
        code = np.searchsorted(values, self.pairs)
        out: list[list[dict]] = [[] for _ in self.whole]
        rare_units = np.bincount(self.link_unit[~known], minlength=self.count) > 0
        texts = self.text_of_unit()
        chosen = self.whole[texts] & rare_units[self.unit]
        marked, of = self._held(np.where(known, -1, code), self.unit[chosen], texts[chosen])
        of, marked = of[marked >= 0], marked[marked >= 0]
        keys, counts = np.unique(of * max(1, len(values)) + marked, return_counts=True)
        for t, v, n in zip((keys // max(1, len(values))).tolist(), values[keys % max(1, len(values))].tolist(), counts.tolist(), strict=True):
            out[t].append({"a": v >> 32, "b": v & 0xFFFFFFFF, "n": n})
        return out

    def group_texts(self, numbers: pa.Array) -> pa.Array:
        """The groups of each unit as text."""

        def ids(of_links: np.ndarray, values: np.ndarray) -> pa.Array:
            fresh = np.diff(of_links, prepend=-1) > 0
            sizes = np.bincount(self.group[fresh], minlength=total)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), numbers.take(pa.array(values)))
            return pc.binary_join(lists, b",")

        total = int(self.group[-1]) + 1 if len(self.group) else 0
        groups = pc.binary_join_element_wise(ids(self.link_a, self.ids_a), ids(self.link_b, self.ids_b), b"|")
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.n_groups)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, groups), b";")

    def groups(self, numbers: pa.Array) -> Iterator[tuple[bytes, str]]:
        """The groups of each text and their digest; both empty without tokens."""
        of_units = self.group_texts(numbers)
        for t, whole in enumerate(self.whole):
            start, end = self.offsets[t], self.offsets[t + 1]
            parts = []
            for block in range(start, end if whole else start, BLOCK):
                taken = of_units.take(pa.array(self.unit[block : min(block + BLOCK, end)]))
                parts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken), b";")[0].as_py())
            text = b";".join(parts)
            yield text, hashlib.sha256(text).hexdigest() if whole else ""


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``CHUNK`` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(sizes) - sizes) // CHUNK
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
        yield batch.slice(start, end - start)


def texts_of(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Rows with a text, and the texts."""
    sizes = pc.fill_null(pc.binary_length(part.column("t")), 0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    return rows, part.column("t").take(pa.array(rows)).cast(pa.large_string())


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.try_validate_utf8(F.col(text).cast("string")).alias("t"))


def pair_counts(docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``a``, ``b`` and ``n``: how many documents hold the two ids linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for batch in batches:
            for part in chunks(batch):
                rows, texts = texts_of(part)
                if not len(rows):
                    continue
                pair = pair or Pair(file_a, file_b)
                values, counts = Aligned(pair, texts).pair_counts()
                columns = [pa.array((values >> 32).astype(np.int32)), pa.array((values & 0xFFFFFFFF).astype(np.int32)), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    found = _source(docs, key, text).mapInArrow(run, "a int, b int, n long")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, with_groups: bool = False
) -> DataFrame:
    """Per document ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair is held by as many documents as any pair of its A id),
    ``count_sum`` (documents that hold the pair, summed over links), ``groups_sha256`` and, on request, the ``groups`` as text."""
    spark = docs.sparkSession
    counts = stage(pair_counts(docs, file_a, file_b, key, text), "alignment-counts")
    pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # at most ``limit`` pairs are held by total / limit documents
    least = 1 if pairs <= limit else -(-total // limit)
    sent = counts.where(F.col("n") >= least).toArrow()
    keys = sent.column("a").to_numpy().astype(np.int64) << 32 | sent.column("b").to_numpy()
    order = np.argsort(keys)
    # no longer than A's vocabulary
    best = counts.groupBy("a").agg(F.max("n").alias("best"))
    tops = best.toArrow()
    best_of = np.zeros(int(pc.max(tops.column("a")).as_py() or 0) + 1, np.int64)
    best_of[tops.column("a").to_numpy()] = tops.column("best").to_numpy()
    shared = spark.sparkContext.broadcast((keys[order], sent.column("n").to_numpy()[order], best_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = numbers = None
        keys, held, best_of = shared.value
        for batch in batches:
            for part in chunks(batch):
                rows, texts = texts_of(part)
                n = part.num_rows
                sums = {c: np.zeros(n, np.int64) for c in SUMS}
                groups, digests, rare = [b""] * n, [""] * n, [[] for _ in range(n)]
                if len(rows):
                    pair = pair or Pair(file_a, file_b)
                    if numbers is None:
                        numbers = pa.array([b"%d" % x for x in range(max(len(pair.bytes_a), len(pair.bytes_b)))])
                    found = Aligned(pair, texts)
                    at = np.minimum(np.searchsorted(keys, found.pairs), max(0, len(keys) - 1))
                    known = keys[at] == found.pairs if len(keys) else np.zeros(len(found.pairs), bool)
                    count = np.where(known, held[at] if len(keys) else 0, 0)
                    links = np.concatenate([[0], np.cumsum(count)])
                    is_best = np.concatenate([[0], np.cumsum(known & (count == best_of[np.minimum(found.pairs >> 32, len(best_of) - 1)]))])
                    first = found.first_link
                    per_unit = {
                        "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links,
                        "n_best": is_best[first[1:]] - is_best[first[:-1]], "count_sum": links[first[1:]] - links[first[:-1]],
                    }
                    place = rows[found.order]
                    for c, values in per_unit.items():
                        sums[c][place] = np.where(found.whole, found.of_texts(values), 0)
                    for row, (all_groups, sha) in zip(place.tolist(), found.groups(numbers), strict=True):
                        groups[row], digests[row] = all_groups if with_groups else b"", sha
                    if not known.all():
                        for row, some in zip(place.tolist(), found.rare(known), strict=True):
                            rare[row] = some
                columns = [part.column("k"), *[pa.array(sums[c]) for c in SUMS], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(groups, pa.binary()).cast(pa.string()), pa.array(rare, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])))],
                    names=["doc_id", *SUMS, "groups_sha256", "groups", "rare"],
                )

    schema = f"doc_id long, {', '.join(f'{c} long' for c in SUMS)}, groups_sha256 string, groups string, rare array<struct<a: int, b: int, n: long>>"
    rows = _source(docs, key, text).mapInArrow(run, schema)
    if least > 1:
        rows = _with_rare(rows, counts.where(F.col("n") < least), best)
    return rows.drop("rare") if with_groups else rows.drop("rare", "groups")


def _with_rare(rows: DataFrame, counts: DataFrame, best: DataFrame) -> DataFrame:
    """Add the links of the pairs that were not broadcast."""
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "alignment-rows")
    graded = counts.join(F.broadcast(best), "a").select("a", "b", F.col("n").alias("docs"), (F.col("n") == F.col("best")).alias("top"))
    single = rows.select("_row", F.explode("rare").alias("p")).select("_row", "p.*")
    sums = (
        single.join(graded, ["a", "b"])
        .groupBy("_row")
        .agg(F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("docs")).alias("_sum"))
    )
    more = {"n_best": "_best", "count_sum": "_sum"}
    joined = rows.join(sums, "_row", "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in more.items()}).drop("_row", *more.values())
