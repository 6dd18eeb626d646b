"""SentencePiece encoding and decoding: sampled segmentations without replacement by Gumbel top-k.

A text is cut into words that start with a blank, as the model's pieces never look across one. The lattice of a word has an edge for every
piece of the model that matches, and byte edges for a character that is no piece. Piece probabilities follow Zipf's law in the rank that the model
gives its pieces. Backward sums over the lattice make every edge a probability, so a segmentation of a whole text is a path of independent
choices, and the lattice of a text is the chain of its words' lattices.

Top-k without replacement is an A* search over that chain with perturbed bounds: the best path carries a Gumbel value; at every step the
paths that leave it form one open set, with a Gumbel value truncated by the path's and known from the set's mass alone. The set with the greatest
value is opened next: another edge at its step, then a free path to the end. Opening sets in this order gives the k paths with the
greatest perturbed log-probabilities, all different, exactly as if all paths had been perturbed. The (k+1)th value is the
threshold of the inclusion scores: ``log(1 - exp(-exp(log_prob - threshold)))``. Random numbers are seeded by a hash of key and text.

Decoding joins the pieces' bytes and drops the leading blank; it gives back every text exactly.

Edge cases: null and empty texts have one segmentation without ids (log-probability 0); a text with fewer segmentations than ``k`` gives them
all, with inclusion score 0; repeated rows give the same samples; the literal sign for a blank is spelled in bytes; memory follows the longest
text, and the lattices of words are kept from text to text up to a fixed size, which changes no result. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.shingles import RollingHash, _mix
from shelfwise.llm.tables import tidy

BLANK = "▁"
BATCH_BYTES = 1 << 18  # text handled together, unless one text is longer
CHUNK_BYTES = 1 << 16  # distinct words whose lattices are worked out at once, unless one word is longer
KEPT_BYTES = 3 << 18  # distinct words whose lattices go on to the next texts, about 100 bytes for each of theirs
ROOM = 1 << 21
SLOTS = 1 << 20
STEP = 0x9E3779B97F4A7C15


class Pieces:
    """The model's pieces as bytes, with a hash table from span hashes to ids."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        ranks = np.full(n, float(n))
        self.byte_ids = np.zeros(256, np.int64)
        ids = []
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_ids[value] = bytes([value]), i
                continue
            self.bytes[i] = piece.replace(BLANK, " ").encode()
            score = model.get_score(i)
            ranks[i] = -score if score > -n else n
            ids.append(i)
        self.spelled = pa.array(self.bytes, pa.large_binary())
        weight = 1.0 / (ranks + 2.0)
        self.log_prob = np.log(weight / weight.sum())
        self.hashing = RollingHash()
        flat = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
        sizes = np.array([len(self.bytes[i]) for i in ids])
        ends = np.cumsum(sizes)
        hashes = self.hashing.spans(self.hashing.sums(flat), ends - sizes, ends)
        self.lengths = np.unique(sizes)
        order = np.argsort(hashes)
        self.sorted_hashes, self.sorted_ids = hashes[order], np.array(ids)[order]
        # where the hashes with a leading part start: most spans are ruled out, the others found, by one look
        lead = (self.sorted_hashes >> np.uint64(44)).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[lead[fresh]] = fresh
        self.depth = int(np.diff(np.append(fresh, len(lead))).max())
        # length of the longest piece with the same first four bytes, or of one whose bytes fall into the same slot
        self.longest = np.zeros(SLOTS, np.uint8)
        long = np.flatnonzero(sizes >= 4)
        np.maximum.at(self.longest, self._slot(flat, (ends - sizes)[long]), np.minimum(sizes[long], 255).astype(np.uint8))

    @staticmethod
    def _slot(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Slots of the four bytes at each position; behind the end lie zeros."""
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
        four = padded[at] | padded[at + 1] << np.uint32(8) | padded[at + 2] << np.uint32(16) | padded[at + 3] << np.uint32(24)
        return (four * np.uint32(2654435761) >> np.uint32(12)).astype(np.int64)

    def reach(self, data: np.ndarray, left: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """How long a piece can be at the positions ``lead``, of which ``left`` bytes are left at each position."""
        longest = self.longest[self._slot(data, lead)].astype(np.int64)
        # a length above the table's range is not ruled out
        return np.minimum(left[lead], np.where(longest == 255, left[lead], np.maximum(longest, 3)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are pieces, and their ids."""
        where, ids = [], []
        slot = self.slots[(hashes >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(slot >= 0)
        at, wanted = slot[maybe], hashes[maybe]
        # hashes with the same leading part are neighbours, a few at most
        for _ in range(self.depth):
            hit = self.sorted_hashes[at] == wanted
            where.append(maybe[hit])
            ids.append(self.sorted_ids[at[hit]])
            going = ~hit & (at + 1 < len(self.sorted_hashes))
            maybe, at, wanted = maybe[going], at[going] + 1, wanted[going]
        return np.concatenate(where), np.concatenate(ids)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """The bytes of the sequences that lie end to end in ``ids``, with their leading blanks."""
        joined = self.spelled.take(pa.array(ids))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[bounds].tolist()
        whole = data.to_pybytes() if data else b""
        return (whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


@lru_cache(maxsize=1)
def worker_pieces(model_file: str) -> Pieces:
    """The pieces of a model, read once for all tasks of a worker."""
    return Pieces(model_file)


class _Numbering(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Growing:
    """An array that grows in place: room is reserved, and memory is used as it fills."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.empty(ROOM, kind), 0

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(2 * size, self.room.dtype)
            room[: self.size] = self.filled()
            self.room = room
        self.room[self.size : size] = values
        self.size = size

    def filled(self) -> np.ndarray:
        return self.room[: self.size]


class Lattices:
    """The lattices of distinct words laid end to end: edges sorted by position, with conditional probabilities. ``numbers`` tells the
    place of a word; ``extend`` adds the lattices of words that were numbered since."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.numbers = pieces, _Numbering()
        kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.float64, np.float64)
        self._columns = [Growing(k) for k in kinds]
        self._show()

    def _show(self) -> None:
        self.starts, self.word_end, self.first, self.begin, self.end, self.ids, self.log_p, self.p = (c.filled() for c in self._columns)

    def extend(self) -> None:
        words = [b" " + w for w in islice(self.numbers, len(self.starts), None)]
        ends = len(self.word_end) + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        at, before = 0, len(self.word_end)
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
            chunk = self._chunk(words[at:stop], self.pieces, before, self._columns[3].size)
            for column, values in zip(self._columns, chunk, strict=True):
                column.add(values)
            at, before = stop, int(ends[stop - 1])
        self._show()

    @staticmethod
    def _chunk(words: list[bytes], pieces: Pieces, shift: int, edges: int) -> tuple[np.ndarray, ...]:
        """Some words' starts, each position's word end and first edge, and the edges: begin, end, piece, log-probability, probability.
        ``shift`` bytes and ``edges`` edges come before."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        ends = np.repeat(starts + sizes, sizes)
        n = len(data)
        left = ends - np.arange(n)
        lead = (data & 0xC0) != 0x80
        sums = pieces.hashing.sums(data)
        froms, tos, ids = [], [], []
        one_piece = np.zeros(n, bool)
        char_end = np.arange(n) + 1
        for _ in range(3):
            inside = char_end < ends
            more = inside & ~lead[np.minimum(char_end, n - 1)]
            char_end = char_end + more
        # the longest piece of a position comes first: it is the likeliest as a rule
        fits = [np.flatnonzero(lead)]
        reach = pieces.reach(data, left, fits[0])
        for size in pieces.lengths:
            more = reach >= size
            reach = reach[more]
            fits.append(fits[-1][more])
        for size, at in reversed(list(zip(pieces.lengths, fits[1:], strict=True))):
            if not len(at):
                continue
            where, found = pieces.find(pieces.hashing.spans(sums, at, at + size))
            at = at[where]
            froms.append(at)
            tos.append(at + size)
            ids.append(found)
            if size <= 4:  # no character has more bytes
                one_piece[at[char_end[at] == at + size]] = True
        # characters that are no piece are spelled in bytes
        spelled = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        lone = np.flatnonzero(~one_piece[spelled]) if n else np.zeros(0, np.int64)
        froms.append(lone)
        tos.append(lone + 1)
        ids.append(pieces.byte_ids[data[lone]])
        begin, end, ids = (np.concatenate(x) for x in (froms, tos, ids))
        # numpy sorts short numbers by radix
        order = np.argsort(begin.astype(np.uint16) if n <= 1 << 16 else begin, kind="stable")
        begin, end, ids = begin[order], end[order], ids[order]
        score = pieces.log_prob[ids]
        # backward sums, by distance from the word's end; index n stands for any word's end
        back = np.full(n + 1, -np.inf)
        target = np.where(end == ends[begin] if n else np.zeros(0, bool), n, end)
        back[n] = 0.0
        distance = left[begin] if n else np.zeros(0, np.int64)
        turn = np.argsort(distance.astype(np.uint16) if n and distance.max() < 1 << 16 else distance, kind="stable")
        bounds = np.searchsorted(distance[turn], np.arange(1, (distance.max() if n else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            e = turn[a:b]
            value = score[e] + back[target[e]]
            first = np.flatnonzero(np.concatenate([[True], begin[e][1:] != begin[e][:-1]]))
            back[begin[e[first]]] = np.logaddexp.reduceat(value, first)
        total = back[target] + score
        log_p = total - back[begin]
        # the edges of a position are neighbours
        held = np.bincount(begin, minlength=n)
        first = np.cumsum(held) - held
        narrow = (begin + shift).astype(np.int32), (end + shift).astype(np.int32), ids.astype(np.int32)
        return starts + shift, ends + shift, first + edges, *narrow, log_p, np.exp(log_p)

    def last(self, position: np.ndarray) -> np.ndarray:
        """The last edge of each position."""
        following = np.minimum(position + 1, len(self.first) - 1)
        return np.where(position + 1 < len(self.first), self.first[following], len(self.begin)) - 1

    def choose(self, position: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each position by its probability."""
        edge = self.first[position]
        last = self.last(position)
        todo = np.flatnonzero((u >= self.p[edge]) & (edge < last))
        while len(todo):
            u[todo] -= self.p[edge[todo]]
            edge[todo] += 1
            todo = todo[(u[todo] >= self.p[edge[todo]]) & (edge[todo] < last[todo])]
        return edge

    def paths(self, words: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A free path from position ``at`` (-1: the start) through each word of ``words``: edges in order, and which word each belongs to.
        Random numbers follow from the words' ``keys``."""
        position = np.where(at < 0, self.starts[words], at)
        limit = self.word_end[self.starts[words]]
        active = np.flatnonzero(position < limit)
        rounds = []
        while len(active):
            edge = self.choose(position[active], _uniform(keys[active] + _times(len(rounds))))
            rounds.append((active, edge))
            position[active] = self.end[edge]
            active = active[position[active] < limit[active]]
        if not rounds:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        steps = np.zeros(len(words), np.int64)
        for turn, (active, _) in enumerate(rounds):
            steps[active] = turn + 1
        start = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), np.int64)
        for turn, (active, edge) in enumerate(rounds):
            edges[start[active] + turn] = edge
        return edges, np.repeat(np.arange(len(words)), steps)


@dataclass
class Path:
    """One segmentation: edges, the word of each, log-probability and perturbed value; at each step the perturbed value of the open set
    that leaves it there (-inf: none), and the edges that other paths took at a step besides its own."""

    edges: np.ndarray
    owner: np.ndarray
    log_prob: float
    value: float
    open: np.ndarray
    barred: dict[int, list[int]]


def _times(n: int) -> np.uint64:
    return np.uint64(n * STEP & (1 << 64) - 1)


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Random numbers in [0, 1), each a function of its key."""
    return (_mix(keys) >> np.uint64(11)) * 2.0**-53


def _truncated(mass: np.ndarray, value: float, rng: np.random.Generator) -> np.ndarray:
    """Greatest Gumbel value of sets with these log-masses, given that it is below ``value``."""
    return mass - np.log(np.exp(mass - value) + rng.exponential(size=len(mass)))


def _log_rest(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        rest = np.log1p(-np.minimum(p, 1.0))
    rest[p >= 1 - 1e-12] = -np.inf
    return rest


class Search:
    """The search of one text for the ``k`` paths with the greatest perturbed log-probabilities. ``wanted`` opens the next set and tells the words
    through which it needs a free path, ``take`` receives that path; ``threshold`` is the (k+1)th value (-inf: there is no further path)."""

    def __init__(self, lattices: Lattices, words: np.ndarray, k: int, seed: int) -> None:
        self.lattices, self.words, self.k, self.seed = lattices, words, k, seed & (1 << 64) - 1
        self.rng = np.random.Generator(np.random.PCG64(self.seed))
        self.paths: list[Path] = []
        self.threshold = -np.inf

    def wanted(self) -> tuple[np.ndarray, int, int] | None:
        """Words, the position to start from in the first (-1: its start), and the key from which each word's follows; None at the end."""
        none = np.zeros(0, np.int64)
        if not self.paths:
            self.value, self.word, self.fixed, self.barred = float(self.rng.gumbel()), 0, 0, []
            self.edges, self.owner, at = none, none, -1
        else:
            tops = [(float(p.open.max()) if len(p.open) else -np.inf) for p in self.paths]
            best = int(np.argmax(tops))
            if np.isneginf(tops[best]) or len(self.paths) == self.k:
                self.threshold = tops[best]
                return None
            source, self.value = self.paths[best], tops[best]
            step = self.fixed = int(source.open.argmax())
            source.open[step] = -np.inf
            self.barred = source.barred.get(step, [int(source.edges[step])])
            edge = self._other_edge(self.lattices.begin[source.edges[step]])
            self.word, at = int(source.owner[step]), int(self.lattices.end[edge])
            self.edges = np.concatenate([source.edges[:step], [edge]])
            self.owner = np.concatenate([source.owner[:step], [self.word]])
        return self.words[self.word :], at, self.seed + (len(self.paths) + 1) * STEP & (1 << 64) - 1

    def _other_edge(self, position: int) -> int:
        """An edge of a position besides those that are barred, by its probability."""
        options = [e for e in range(self.lattices.first[position], int(self.lattices.last(position)) + 1) if e not in self.barred]
        chance = np.cumsum(self.lattices.p[options])
        return options[min(int(np.searchsorted(chance, self.rng.random() * chance[-1], side="right")), len(options) - 1)]

    def take(self, tail: np.ndarray, tail_owner: np.ndarray, tail_log_p: np.ndarray, tail_rest: np.ndarray) -> None:
        """The tail's edges, their words, log-probabilities and the logarithms of what their steps leave to other edges."""
        fixed, edges, owner, log_p, rest = self.fixed, tail, tail_owner, tail_log_p, tail_rest
        if len(self.edges):
            edges, owner = np.concatenate([self.edges, tail]), np.concatenate([self.owner, tail_owner + self.word])
            log_p = np.concatenate([self.lattices.log_p[self.edges], tail_log_p])
            rest = np.concatenate([_log_rest(self.lattices.p[self.edges[fixed:]]), tail_rest])
        before = np.cumsum(log_p) - log_p
        own = before[fixed:] + rest
        if self.barred:
            taken = float(self.lattices.p[self.barred].sum() + self.lattices.p[edges[fixed]])
            own[0] = before[fixed] + _log_rest(np.array([taken]))[0]
        open_ = np.full(len(edges), -np.inf)
        open_[fixed:] = _truncated(own, self.value, self.rng)
        barred = {fixed: [*self.barred, int(edges[fixed])]} if self.barred else {}
        self.paths.append(Path(edges, owner, float(log_p.sum()), self.value, open_, barred))


def sample_paths(lattices: Lattices, searches: list[Search]) -> None:
    """Run the searches of several texts side by side: the free paths that they want next are drawn together."""
    while searches:
        asked = [(s, w) for s in searches if (w := s.wanted())]
        searches = [s for s, _ in asked]
        if not asked:
            return
        sizes = np.array([len(w[0]) for _, w in asked])
        starts = np.cumsum(sizes) - sizes
        at = np.full(int(sizes.sum()), -1)
        at[starts] = [w[1] for _, w in asked]
        nth = np.arange(1, len(at) + 1) - np.repeat(starts, sizes)
        keys = _mix(np.repeat(_mix(np.array([w[2] for _, w in asked], np.uint64)), sizes) + nth.astype(np.uint64))
        edges, owner = lattices.paths(np.concatenate([w[0] for _, w in asked]), at, keys)
        bounds = np.searchsorted(owner, np.append(starts, len(at)))
        log_p, rest = lattices.log_p[edges], _log_rest(lattices.p[edges])
        for search, start, a, b in zip(searches, starts, bounds[:-1], bounds[1:], strict=True):
            search.take(edges[a:b], owner[a:b] - start, log_p[a:b], rest[a:b])


def log_inclusion(log_prob: float, threshold: float) -> float:
    """Logarithm of the chance that a path's perturbed value exceeds the threshold."""
    if np.isneginf(threshold):
        return 0.0
    x = log_prob - threshold
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def split_words(text: str) -> list[bytes]:
    """Words of a text after its leading blank, each with the blanks before it but the first."""
    parts = text.encode("utf-8", "surrogatepass").split(b" ")
    if b"" not in parts:
        return parts
    out, blanks = [], b""
    for p in parts:
        if p:
            out.append(blanks + p)
            blanks = b""
        else:
            blanks += b" "
    return out + [blanks[1:]] if blanks else out


def segment_batch(
    texts: list[str | None], seeds: list[int], lattices: Lattices, k: int
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples: ids, log-probability, perturbed value, log of the inclusion score. Words of earlier batches are known."""
    number = lattices.numbers.__getitem__
    split = [np.fromiter(map(number, split_words(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    lattices.extend()
    searches = [Search(lattices, words, k, seed) if len(words) else None for words, seed in zip(split, seeds, strict=True)]
    sample_paths(lattices, [s for s in searches if s])
    empty = [(np.zeros(0, np.int64), 0.0, 0.0, 0.0)]
    return [
        [(lattices.ids[p.edges], p.log_prob, p.value, log_inclusion(p.log_prob, s.threshold)) for p in s.paths] if s else empty
        for s in searches
    ]


def segmentations(
    docs: DataFrame, model_file: str, k: int = 2, seed: int = 23, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each sample of each text: the columns of ``docs`` without the text (decoding gives it back), ``sample`` from 1, ``piece_ids``, ``log_prob``, ``perturbed``,
    ``log_inclusion`` and ``decoded_ok`` (decoding gave the text back)."""
    added = ("sample", "piece_ids", "log_prob", "perturbed", "log_inclusion", "decoded_ok")
    own = docs.drop(*[c for c in added if c not in (key, text)], "_text", "_seed")
    marked = own.withColumn("_text", F.col(text).cast("string")).withColumn("_seed", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    marked = marked.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(model_file)
        lattices = Lattices(pieces)
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("_text", "_seed")]
            sizes = np.nan_to_num(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(float))
            start = 0
            while start < batch.num_rows:
                # as many texts as fit, one at least
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), BATCH_BYTES, side="right")))
                if len(lattices.word_end) > KEPT_BYTES:
                    lattices = Lattices(pieces)
                part = batch.slice(start, stop - start)
                yield segmented(part, names, lattices)
                start = stop

    def segmented(part: pa.RecordBatch, names: list[str], lattices: Lattices) -> pa.RecordBatch:
        texts = part.column("_text").to_pylist()
        found = segment_batch(texts, part.column("_seed").to_pylist(), lattices, k)
        flat = [s for samples in found for s in samples]
        take = pa.array(np.repeat(np.arange(len(texts)), [len(s) for s in found]))
        ids = np.concatenate([s[0] for s in flat]).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
        spelled = lattices.pieces.spell(ids, offsets)
        wanted = ((" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts)
        ok = [next(spelled) == w for w, samples in zip(wanted, found, strict=True) for _ in samples]
        return pa.RecordBatch.from_arrays(
            [part.column(c).take(take) for c in names]
            + [
                pa.array(np.concatenate([np.arange(1, len(s) + 1) for s in found]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)),
                pa.array(ok, pa.bool_()),
            ],
            names=[*names, *added],
        )

    fields = [f for f in marked.schema.fields if f.name not in ("_text", "_seed")]
    schema = T.StructType(
        [
            *fields,
            T.StructField("sample", T.IntegerType()),
            T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
            *(T.StructField(c, T.DoubleType()) for c in added[2:5]),
            T.StructField("decoded_ok", T.BooleanType()),
        ]
    )
    return marked.mapInArrow(tidy(run), schema)
