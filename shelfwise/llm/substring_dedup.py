"""Removal of words covered by windows that also start in a document with a smaller id: FM-indexes searched backward.

Words are runs without ASCII white space. Every ``WINDOW`` consecutive words of a document are a window. An index of the whole corpus would have to
be searched by the whole corpus; so texts are cut into pieces that go only where equal windows can be:

1. Each window has an anchor, the least hash among its runs of ``GRAM`` words. Equal windows have equal anchors. Windows in a row with the same
   anchor form a piece (about five windows on average, at most ``LONGEST``). Anchors that only one document has are dropped: none of their windows is repeated.
2. The pieces of the other anchors, each distinct piece once with the least and greatest id that a part of a batch has for it, go to the shard of their
   anchor. An anchor with more than ``HEAVY`` pieces would make a shard too large: its windows become pieces of their own, dealt by their own hash.
3. A shard builds a compressed FM-index of its distinct pieces: the Burrows-Wheeler transform of their words in a wavelet matrix, with bit-planes and
   counts, the bounds of the suffixes' groups of 12 and of 13 equal words, and the least id of each group of 13. Suffixes are sorted to 16 words, which is exact for
   patterns of up to 16. All pieces are streamed through it: backward search extends a match word by word to the left; at ``WINDOW`` words the interval is a
   group, whose least id is reported, and the match is shortened on the right to 12 words by the group's bounds; where a word does not fit, the match
   is shortened by one and searched anew.
4. The intervals reported for a piece go back to its occurrences, and a window is removed where the least id is less than the document's.

Pieces are named by 128 bits; in an index, words are compared themselves. A piece that many documents hold is indexed once; its occurrences
are joined under adaptive execution, which splits it. Nothing but one piece per part of a batch is gathered by anchor.

Edge cases: null and empty texts have no words; documents with fewer than ``WINDOW`` words lose nothing; rows without an id lose nothing and count for no other;
rows of the same id do not count for each other, equal rows get equal results; repeats within a document alone remove nothing; a text of one repeated
word is cut into pieces of at most ``LONGEST`` windows; an empty table gives an empty result. Input columns other than key and text are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import stage

WINDOW = 13
GRAM = 6
LONGEST = 62  # windows of a piece, so that they fit the bits of a long
HEAVY = 20_000
SHARD_BYTES = 4 << 20
PART = 2 << 20  # bytes of text whose hashes are held at a time
PENDING = 50_000  # distinct pieces held before they are sent on
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def normal(text: bytes | None) -> bytes:
    """The words, joined by one space."""
    return b" ".join((text or b"").split())


class Runs:
    """Pieces of some texts (words joined by one space): for each the text, its first word, its windows and its anchor; also bounds of all words."""

    def __init__(self, texts: list[bytes]) -> None:
        self.count = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.data = b" ".join([t for t in texts if t])
        raw = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts = np.concatenate([[0], gaps + 1]) if len(raw) else np.zeros(0, np.int64)
        self.ends = np.append(gaps, len(raw)) if len(raw) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count  # first word of each text
        words, n = len(self.starts), len(self.starts) - WINDOW + 1
        self.text = self.word = self.windows = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.int64)
        if n <= 0:
            return
        hashes = self._words(raw)
        grams = np.zeros(words - GRAM + 1, np.uint64)
        for k in range(GRAM):
            grams = (grams + hashes[k : words - GRAM + 1 + k]) * SPREAD
        low = mix(grams)
        for shift in (1, 2, 4):  # least of 8 in a row
            low = np.minimum(low[:-shift], low[shift:])
        text_of = np.repeat(np.arange(len(texts)), self.count)
        whole = text_of[:n] == text_of[WINDOW - 1 :]
        fresh = np.ones(n, bool)
        fresh[1:] = (low[1:] != low[:-1]) | (text_of[1:n] != text_of[: n - 1])
        since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        at = np.flatnonzero(whole & (since % LONGEST == 0))
        # a run ends where the next one starts or where its text has no more windows
        ends = np.minimum(np.append(at[1:], n), (self.first + self.count - WINDOW + 1)[text_of[at]])
        self.text, self.word, self.windows = text_of[at], at, ends - at
        self.anchor = low[at].view(np.int64)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each word."""
        longest = int((self.ends - self.starts).max())
        powers = np.cumprod(np.full(longest + 1, SPREAD | np.uint64(1), np.uint64))
        place = np.arange(len(raw)) - np.repeat(self.starts, self.ends - self.starts + 1)[: len(raw)]
        values = (raw.astype(np.uint64) + np.uint64(1)) * powers[place]
        values[self.ends[:-1]] = 0  # the spaces; the last word of the data has none after it
        return mix(np.add.reduceat(values, self.starts))

    def number(self) -> np.ndarray:
        """Of each piece within its text."""
        per_text = np.bincount(self.text, minlength=len(self.count))
        return np.arange(len(self.text)) - (np.cumsum(per_text) - per_text)[self.text]

    def bounds(self, word: np.ndarray, windows: np.ndarray) -> tuple[list[int], list[int]]:
        """First byte and end of the windows from each word on."""
        return self.starts[word].tolist(), self.ends[word + windows + WINDOW - 2].tolist()


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these sizes, laid end to end: the run of each item and its place there."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PART`` bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= PART:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Wavelet:
    """A sequence of numbers as bit-planes, highest bit first, with the counts of ones before every 64th bit; answers many queries at once."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.planes, self.ones, self.zeros, self.bits = [], [], [], bits
        for bit in reversed(range(bits)):
            one = (values >> bit & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            plane = np.zeros(len(values) // 64 + 1, np.uint64)
            plane.view(np.uint8)[: len(packed)] = packed
            self.planes.append(plane)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(plane))]).astype(np.int32))
            self.zeros.append(int(len(values) - one.sum()))
            values = np.concatenate([values[~one], values[one]])

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before position ``at`` end in the lowest order, in which equal symbols lie together."""
        for level, (plane, ones, zeros) in enumerate(zip(self.planes, self.ones, self.zeros, strict=True)):
            block = at >> 6
            rest = plane[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            before = ones[block] + np.bitwise_count(rest)
            at = np.where(symbols >> (self.bits - 1 - level) & 1, zeros + before, at - before)
        return at


class FMIndex:
    """Pieces as sequences of words, each with a number (here the least id of its documents).

    ``text``: words as numbers from 1, a 0 after each piece. ``owner``: the number of the piece at each position."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, symbols: int) -> None:
        n = len(text)
        ranks = {1: text.astype(np.int64)}
        for depth in (1, 2, 4, 8):
            ranks[2 * depth], order = self._double(ranks[depth], depth)
        after = self._shift(ranks[4], 8)[order], self._shift(ranks[1], 12)[order]
        fresh = np.diff(ranks[8][order], prepend=-1) != 0
        fresh |= np.diff(after[0], prepend=-1) != 0
        self.group12 = np.cumsum(fresh, dtype=np.int32) - 1
        self.start12 = np.append(np.flatnonzero(fresh), n).astype(np.int32)
        fresh |= np.diff(after[1], prepend=-1) != 0
        start13 = np.flatnonzero(fresh)
        self.group13 = np.cumsum(fresh, dtype=np.int32) - 1
        self.least = np.minimum.reduceat(owner[order], start13) if n else owner
        before = np.concatenate([text[-1:], text[:-1]])[order]
        self.size, self.symbols = n, symbols
        self.wavelet = Wavelet(before, max(1, int(symbols).bit_length()))
        counts = np.bincount(text, minlength=symbols + 1)
        every = np.arange(symbols + 1)
        # from the place in the wavelet's order to the row of the suffix
        self.shift = np.cumsum(counts) - counts - self.wavelet.place(every, np.zeros(symbols + 1, np.int64))

    @staticmethod
    def _shift(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([rank[by:], np.zeros(min(by, len(rank)), rank.dtype)])

    def _double(self, rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of twice the depth, and the order of the suffixes by them."""
        key = rank * (int(rank.max(initial=0)) + 1) + self._shift(rank, depth)
        order = np.argsort(key, kind="stable")
        key = key[order]
        out = np.empty_like(rank)
        out[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        return out, order

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams the sequences ``text[start:end]`` (words that the index does not have are 0): positions where a match of ``WINDOW`` words
        starts, and the least number of the pieces that hold it."""
        found, least = [], []
        pos, end, floor = ends - 1, ends.copy(), starts
        low = np.zeros(len(pos), np.int64)
        high = np.full(len(pos), self.size, np.int64)
        while True:
            # without WINDOW words before its end, a sequence is done
            open_ = end - floor >= WINDOW
            pos, end, floor, low, high = pos[open_], end[open_], floor[open_], low[open_], high[open_]
            if not len(pos):
                break
            symbol = text[pos].astype(np.int64)
            both = self.wavelet.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            both += self.shift[np.concatenate([symbol, symbol])]
            low2, high2 = both[: len(pos)], both[len(pos) :]
            fits = (low2 < high2) & (symbol > 0)
            full = fits & (end - pos == WINDOW)
            if full.any():
                row = low2[full]
                found.append(pos[full])
                least.append(self.least[self.group13[row]])
                group = self.group12[row]
                low2[full], high2[full] = self.start12[group], self.start12[group + 1]
            # a word that no piece has ends all matches over it; otherwise the last word is given up and the rest searched anew
            missing = ~fits & (end - pos == 1)
            again = ~fits & ~missing
            end = np.where(full | again, end - 1, np.where(missing, pos, end))
            pos = np.where(fits, pos - 1, end - 1)
            low = np.where(fits, low2, 0)
            high = np.where(fits, high2, self.size)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found]), np.concatenate([none, *least])


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Pieces as words' numbers with a 0 after each, where each piece starts (and, last, the end), and how many words differ."""
    lists = pc.split_pattern(texts, b" ")
    coded = lists.flatten().dictionary_encode()
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(starts[-1], np.int32)
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    text[inside] = coded.indices.to_numpy(zero_copy_only=False) + 1
    return text, starts, len(coded.dictionary)


def search(shard: pa.Table) -> pa.Table:
    """Index the distinct pieces of a shard, stream them through it, and return those with a window that a smaller id has, with the least id of each window."""
    names = shard.column("piece").combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    n = len(names.dictionary)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, code, shard.column("low").to_numpy())
    np.maximum.at(high, code, shard.column("high").to_numpy())
    first = np.empty(n, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    text, starts, symbols = sequences(shard.column("text").combine_chunks().take(pa.array(first)))
    index = FMIndex(text, np.repeat(low, np.diff(starts)), symbols)
    at, least = index.statistics(text, starts[:-1], starts[1:] - 1)
    windows = np.diff(starts) - WINDOW  # a piece has its words and a 0
    offsets = np.concatenate([[0], np.cumsum(windows)])
    mins = np.full(offsets[-1], np.iinfo(np.int64).max)
    piece = np.searchsorted(starts, at, side="right") - 1
    mins[offsets[piece] + at - starts[piece]] = least
    kept = np.minimum.reduceat(mins, offsets[:-1]) < high if n else np.zeros(0, bool)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(mins))
    chosen = pa.array(np.flatnonzero(kept))
    return pa.table({"piece": names.dictionary.take(chosen), "least": lists.take(chosen)})


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(value).alias("h"), value.cast("binary").alias("t"))


def _anchors(docs: DataFrame, numbered: bool) -> DataFrame:
    """``anchor`` of each piece with its document and, where wanted, the hash of its text and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column("t").to_numpy(zero_copy_only=False)]
            ids, marks = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("h").to_numpy()
            for start, end in parts(texts):
                runs = Runs(texts[start:end])
                columns = {"anchor": runs.anchor, "doc_id": ids[start:end][runs.text].astype(np.int64)}
                if numbered:
                    columns |= {"h": marks[start:end][runs.text], "number": runs.number().astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    return docs.where("doc_id is not null").mapInArrow(run, "anchor long, doc_id long" + ", h long, number int" * numbered)


def _pieces(docs: DataFrame) -> DataFrame:
    """From documents with the ``numbers`` of their shared pieces (twice the number, plus one if the anchor is heavy): occurrences (``piece``, ``doc_id``, ``h``,
    ``word``), and distinct pieces with ``key``, ``text`` and the least and greatest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            rows = list(pending.items())
            nothing = [None] * len(rows)
            values = {"piece": [k for k, _ in rows], "doc_id": nothing, "h": nothing, "word": nothing}
            values |= {c: [v[i] for _, v in rows] for i, c in enumerate(("key", "text", "low", "high"))}
            pending.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in fields], schema=fields)

        fields = pa.schema(
            [("piece", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64()), ("word", pa.int32())]
            + [("key", pa.int64()), ("text", pa.binary()), ("low", pa.int64()), ("high", pa.int64())]
        )
        for batch in batches:
            texts = [normal(t) for t in batch.column("t").to_numpy(zero_copy_only=False)]
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            lists = batch.column("numbers")
            for start, end in parts(texts):
                runs = Runs(texts[start:end])
                chosen = np.full(len(runs.text), -1)
                per_text = np.bincount(runs.text, minlength=end - start)
                some = lists.slice(start, end - start)
                numbers = some.flatten().to_numpy()
                text, _ = spread(pc.list_value_length(some).to_numpy())
                chosen[(np.cumsum(per_text) - per_text)[text] + (numbers >> 1)] = numbers & 1
                at = np.flatnonzero(chosen >= 0)
                # the windows of a heavy anchor are pieces of their own
                piece, more = spread(np.where(chosen[at] == 1, runs.windows[at], 1))
                at = at[piece]
                word, text, heavy = runs.word[at] + more, runs.text[at], chosen[at] == 1
                columns = [*runs.bounds(word, np.where(heavy, 1, runs.windows[at])), runs.anchor[at].tolist(), heavy.tolist(), ids[start + text].tolist()]
                names, data = [], runs.data
                for low, high, anchor, alone, own in zip(*columns, strict=True):
                    value = data[low:high]
                    name = hashlib.blake2b(value, digest_size=16).digest()
                    known = pending.get(name)
                    if known is None:
                        key = int.from_bytes(name[:8], "little", signed=True) if alone else anchor
                        pending[name] = [key, value, own, own]
                    elif own < known[2]:
                        known[2] = own
                    elif own > known[3]:
                        known[3] = own
                    names.append(name)
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(ids[start + text]), pa.array(marks[start + text])]
                    + [pa.array((word - runs.first[text]).astype(np.int32))]
                    + [pa.nulls(n, f.type) for f in list(fields)[4:]],
                    schema=fields,
                )
                if len(pending) > PENDING:
                    yield flush()
        yield flush()

    return docs.mapInArrow(run, "piece binary, doc_id long, h long, word int, key long, text binary, low long, high long")


def _marked(spans: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the windows that the spans of some texts mark, text by text, and where those of each text start (and, last, the end)."""
    flat = spans.flatten()
    word, windows, bits = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("word", "n", "bits"))
    text, _ = spread(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
    span, place = spread(windows)
    marked = np.flatnonzero(bits[span] >> (windows[span] - 1 - place) & 1)
    span = span[marked]
    return word[span] + place[marked], np.searchsorted(text[span], np.arange(len(spans) + 1))


def _cut(rows: DataFrame) -> DataFrame:
    """Texts without the words of the windows that ``spans`` (first word, windows, bits) mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            texts = [t or b"" for t in batch.column("t").to_numpy(zero_copy_only=False)]
            for start, end in parts(texts):
                first, edges = _marked(batch.column("spans").slice(start, end - start))
                for i, t in enumerate(texts[start:end]):
                    words = t.split()
                    n, at = len(words), first[edges[i] : edges[i + 1]]
                    if len(at):
                        # windows that begin less those that end
                        change = np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
                        words = list(compress(words, (np.cumsum(change[:n]) == 0).tolist()))
                    left = b" ".join(words)
                    counts.append(n)
                    removed.append(n - len(words))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (the kept words, joined by one space)."""
    source = _source(docs, key, text)
    held = _anchors(source, numbered=False).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    shared = stage(held.where("low < high").select("anchor", (F.col("n") > heavy).cast("int").alias("heavy")), "substring-anchors")
    # the shared anchors, each once, are hashed, so that nobody sorts all anchors
    numbers = _anchors(source, numbered=True).join(shared.hint("shuffle_hash"), "anchor").groupBy("doc_id", "h").agg(F.collect_list(F.col("number").cast("long") * 2 + F.col("heavy")).alias("numbers"))
    pieces = stage(_pieces(source.join(stage(numbers, "substring-numbers"), ["doc_id", "h"])), "substring-pieces")

    distinct = pieces.where("text is not null").select("piece", "key", "text", "low", "high")
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // shard_bytes
    dealt = distinct.select(F.pmod("key", F.lit(shards)).alias("shard"), "piece", "text", "low", "high")
    found = stage(dealt.groupBy("shard").applyInArrow(search, "piece binary, least array<long>"), "substring-matches")

    smaller = F.aggregate("least", F.lit(0).cast("long"), lambda bits, x: bits * 2 + (x < F.col("doc_id")).cast("long"))
    marked = (
        pieces.where("text is null")
        .select("piece", "doc_id", "h", "word")
        .join(found, "piece")
        .select("doc_id", "h", F.struct("word", F.size("least").alias("n"), smaller.alias("bits")).alias("span"))
        .where("span.bits > 0")
    )
    spans = stage(marked.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans")), "substring-spans")
    cut = _cut(source.join(spans, ["doc_id", "h"], "left").select("doc_id", "t", "spans"))
    return cut.withColumn("kept_text", F.col("kept").cast("string")).drop("kept")
