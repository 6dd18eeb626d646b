"""Token ids in compressed shard files, one wavelet matrix per shard.

Documents are encoded in ascending order of their key; runs of whole documents form shards. A shard file holds the documents' keys and
lengths and a wavelet matrix of all ids: ids are numbered by their frequency in the shard, and there is one bit-plane for each bit of such a number, from the highest, each with the number of its zeros and the
counts of ones before every 512th bit. From that one file ``access``, ``rank``, ``count``, ``select`` and ``occurrences`` are answered without decoding,
and ``decode`` restores all ids. Files are written as Parquet rows, one shard in a file, so that Spark's committer handles lost
executors and any store that Spark can write will do.

The text of a document is cut at blanks and line feeds (and before closing signs), each distinct piece of a batch that no earlier batch of the worker had is encoded by the tokenizer and ids
are put together from pieces; pieces are kept up to a fixed number, which changes no result. The tokenizer's rules never look across white space, so the ids are those of the whole text (tested). ASCII texts are lower-cased first
unless they hold an added token, in whatever case. Words of Latin letters, which the tokenizer's normalizer only lower-cases and its pre-tokenizer leaves whole, go to its model without the two.

Edge cases: null and empty texts have the end id only; repeated keys keep the order of their texts' hashes; a text longer than a
shard makes a shard of its own length; an empty table writes no shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.staging import stage

SHARD_TOKENS = 1 << 20
MAGIC = b"WMX3"
STEP = 512  # bits between two stored counts
DELIMITER = "\x01"
JOINED = 100  # distinct pieces in one string for the tokenizer
KEPT_PIECES = 1_500_000  # pieces whose ids go on to the next texts, about 50 bytes each
CHUNK = 1 << 15  # ids dealt out at a time, so that their places stay in the processor's cache
COUNTED = 1 << 20  # ids below this are counted in an array
#: A Latin letter (but for the dotted capital I, which is lower-cased to two characters), signs that end no special token, white space.
CLOSING = r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,!?;:$%*#)&]+)([ \n])"
#: Words of these letters, which are one character each however they are normalized or lower-cased.
LATIN = re.compile("[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
#: The normalizer and the pre-tokenizer that only lower-case such a word and leave it whole.
LOWERING = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
SPLITTING = (
    r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, """
    "invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"
)


def narrowest(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


class WaveletMatrix:
    """Ids as bit-planes of their places in ``symbols``, the most frequent first; plane 0 is the highest bit."""

    def __init__(
        self, size: int, planes: list[np.ndarray], zeros: list[int], symbols: np.ndarray, ones: list[np.ndarray] | None = None
    ) -> None:
        self.size, self.planes, self.zeros, self.symbols = size, planes, zeros, symbols
        self.ones: list[np.ndarray] = list(ones or ())
        for plane in planes[len(self.ones) :]:
            per_step = np.bitwise_count(np.pad(plane, (0, -len(plane) % (STEP // 8)))).reshape(-1, STEP // 8).sum(axis=1)
            self.ones.append(np.concatenate([[0], np.cumsum(per_step, dtype=np.int64)]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if ids.max(initial=0) < COUNTED:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            at, counts = ids, counts[symbols]
            place = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
        else:
            symbols, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
            place = np.zeros(len(symbols), np.uint32)
        order = np.argsort(-counts, kind="stable")
        place[symbols[order] if at is ids else order] = np.arange(len(order))
        bits = max(0, len(symbols) - 1).bit_length()
        ids = place.astype(narrowest(bits))[at]
        planes, zeros = [], []
        for bit in reversed(range(bits)):
            one = (ids & ids.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(one))
            zeros.append(int(ids.size) - int(np.count_nonzero(one)))
            if bit:
                ids = cls._parted(ids, one, zeros[-1])
        return cls(int(ids.size), planes, zeros, symbols[order].astype(np.uint32))

    @staticmethod
    def _parted(ids: np.ndarray, one: np.ndarray, zeros: int) -> np.ndarray:
        """Ids without the bit, then those with it, each in their order."""
        out, zero, a, b = np.empty_like(ids), ~one, 0, zeros
        for s in range(0, len(ids), CHUNK):
            part = ids[s : s + CHUNK]
            at = np.flatnonzero(zero[s : s + CHUNK])
            part.take(at, out=out[a : a + len(at)], mode="clip")
            a += len(at)
            at = np.flatnonzero(one[s : s + CHUNK])
            part.take(at, out=out[b : b + len(at)], mode="clip")
            b += len(at)
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position ``i``."""
        step = i // STEP
        plane = self.planes[level][step * STEP // 8 : i // 8]
        rest = int(self.planes[level][i >> 3]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self.ones[level][step]) + int(np.bitwise_count(plane).sum()) + rest.bit_count()

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return int(self.symbols[value])

    def _code(self, symbol: int) -> int:
        """The place of an id in ``symbols``; without one, a number that no id has."""
        at = np.flatnonzero(self.symbols == symbol)
        return int(at[0]) if len(at) else 1 << len(self.zeros)

    def _interval(self, code: int, low: int, high: int) -> tuple[int, int]:
        if code >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            one = code >> (len(self.zeros) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id in positions ``low`` to ``high`` (exclusive)."""
        a, b = self._interval(self._code(symbol), low, self.size if high is None else high)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit equal to ``one``."""
        ones = self.ones[level]
        before = ones if one else np.arange(len(ones), dtype=np.int64) * STEP - ones
        step = int(np.searchsorted(before, k, side="right")) - 1
        step = min(step, (self.size - 1) // STEP)
        bits = np.unpackbits(self.planes[level][step * STEP // 8 : (step + 1) * STEP // 8])
        return step * STEP + int(np.flatnonzero(bits == one)[k - int(before[step])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        code = self._code(symbol)
        low, high = self._interval(code, 0, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in reversed(range(len(self.zeros))):
            one = code >> (len(self.zeros) - 1 - level) & 1
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane undoes its stable partition."""
        ids = np.zeros(self.size, narrowest(len(self.zeros)))
        for level in reversed(range(len(self.zeros))):
            one = np.unpackbits(self.planes[level], count=self.size).view(bool)
            out, zero, a, b = np.empty_like(ids), ~one, 0, self.zeros[level]
            ids[b:] |= ids.dtype.type(1 << (len(self.zeros) - 1 - level))
            for s in range(0, self.size, CHUNK):
                part = out[s : s + CHUNK]
                at = np.flatnonzero(zero[s : s + CHUNK])
                part[at] = ids[a : a + len(at)]
                a += len(at)
                at = np.flatnonzero(one[s : s + CHUNK])
                part[at] = ids[b : b + len(at)]
                b += len(at)
            ids = out
        return self.symbols[ids] if self.size else ids.astype(np.uint32)


@dataclass
class Shard:
    """Documents' keys (null as such), their numbers of ids, and the ids."""

    keys: np.ndarray
    known: np.ndarray
    lengths: np.ndarray
    matrix: WaveletMatrix

    def to_bytes(self) -> bytes:
        m = self.matrix
        head = struct.pack("<4sIQII", MAGIC, len(self.keys), m.size, len(m.planes), len(m.symbols))
        return b"".join(
            [head, self.keys.astype("<i8").tobytes(), self.known.astype("u1").tobytes(), self.lengths.astype("<i8").tobytes()]
            + [np.array(m.zeros, "<i8").tobytes(), m.symbols.astype("<u4").tobytes()]
            + [p.tobytes() for p in m.planes]
            + [x.astype("<i8").tobytes() for x in m.ones]
        )

    @classmethod
    def from_bytes(cls, blob: bytes) -> Shard:
        magic, n, size, levels, symbols = struct.unpack_from("<4sIQII", blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4sIQII")

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, count, at)
            at += out.nbytes
            return out

        keys, known, lengths = take("<i8", n), take("u1", n), take("<i8", n)
        zeros = [int(z) for z in take("<i8", levels)]
        ids = take("<u4", symbols)
        planes = [take("u1", -(-size // 8)) for _ in range(levels)]
        ones = [take("<i8", 1 + -(-size // STEP)) for _ in range(levels)]
        return cls(keys, known, lengths, WaveletMatrix(size, planes, zeros, ids, ones))


def _pieces(texts: pa.Array, added: Sequence[str] = ()) -> pa.ListArray:
    """Texts cut where the tokenizer never looks across: at blanks and line feeds and, to meet fewer different pieces, between a letter
    and closing signs that white space follows. ASCII texts are lower-cased, as the tokenizer would; texts that hold one of the ``added``
    tokens in any case are not, as only its own spelling is special."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lower = pc.ascii_lower(texts)
    plain = pc.string_is_ascii(texts)
    for token in added:
        plain = pc.and_(plain, pc.invert(pc.match_substring(lower, token.lower())))
    texts = pc.if_else(plain, lower, texts)
    texts = pc.replace_substring_regex(texts, CLOSING, r"\1 \2\3")
    return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


class Encoder:
    """A tokenizer, the ids of the delimiter, and which ids end a word (none, if its model does not mark them)."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.mark = self._ids([DELIMITER])[0]
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if suffix:
            self.word_end[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # a way to the model for words of Latin letters, of which no added token may be one or a part
        self.bare = None
        plain = (str(tokenizer.normalizer), str(tokenizer.pre_tokenizer)) == (LOWERING, SPLITTING)
        if plain and not any(LATIN.fullmatch(token) for token in self.added):
            from tokenizers import Tokenizer, pre_tokenizers

            self.bare = Tokenizer(tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            # the letters in the model's alphabet, and the blank between words
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            lower = {c.lower() for c in map(chr, range(0x250)) if LATIN.fullmatch(c)}
            self.letters = {ord(c): "".join(part for part, _ in level.pre_tokenize_str(c)) for c in lower} | {32: " "}
        # pieces met before, from the empty one on; for each where its ids start and how many there are
        self.known = pa.array([""], pa.large_string())
        self.sizes, self.starts, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str], bare: bool = False) -> list[np.ndarray]:
        tokenizer = self.bare if bare else self.tokenizer
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Calls of many pieces: the numbers of the pieces, their ids one after another, and how many each has."""
        latin, words, rest, out = [], [], [], []
        for i, p in enumerate(pieces):
            (rest if not p.isalpha() else latin if self.bare is not None and LATIN.fullmatch(p) else words).append(i)
        # letters alone make one word, whose last id ends it; where the count of such ids differs, a delimiter decides
        for own, bare in ((latin, True), (words, False)):
            if not self.word_end.any():
                rest += own
                continue
            calls = [own[s : s + JOINED] for s in range(0, len(own), JOINED)]
            texts = [" ".join([pieces[i] for i in c]) for c in calls]
            if bare:
                texts = [t.lower().translate(self.letters) for t in texts]
            for call, ids in zip(calls, self._ids(texts, bare), strict=True):
                ends = np.flatnonzero(self.word_end[ids])
                if len(ends) == len(call) and ends[-1] == len(ids) - 1:
                    out.append((call, ids, np.diff(ends, prepend=-1)))
                else:
                    rest += call
        plain = [i for i in rest if len(self.mark) == 1 and DELIMITER not in pieces[i]]
        calls = [plain[s : s + JOINED] for s in range(0, len(plain), JOINED)]
        # a delimiter ends each piece, so the ids between two delimiters are one piece's
        for call, ids in zip(calls, self._ids(["".join([f"{pieces[i]} {DELIMITER} " for i in c]) for c in calls]), strict=True):
            at = np.flatnonzero(ids == self.mark[0])
            out.append((call, np.delete(ids, at), np.diff(at, prepend=-1) - 1))
        alone = [i for i in rest if len(self.mark) != 1 or DELIMITER in pieces[i]]
        return out + [([i], ids, np.array([len(ids)])) for i, ids in zip(alone, self._ids([pieces[i] for i in alone]), strict=True)]

    def _learn(self, known: pa.Array) -> None:
        """The ids of the pieces that ``known`` has after those known already."""
        before = len(self.known)
        sizes, starts = (np.concatenate([x, np.zeros(len(known) - before, np.int64)]) for x in (self.sizes, self.starts))
        flat, held = [self.flat], len(self.flat)
        for call, ids, counts in self._joined(known.slice(before).to_numpy(zero_copy_only=False).tolist()):
            at = before + np.array(call, np.int64)
            sizes[at] = counts
            starts[at] = held + np.cumsum(counts) - counts
            flat.append(ids)
            held += len(ids)
        self.known, self.sizes, self.starts, self.flat = known, sizes, starts, np.concatenate(flat)

    def _keep(self, places: np.ndarray) -> None:
        """Forget all others: those that came back are likely to come again."""
        self.flat, ends = self._of(places)
        self.known, self.sizes = self.known.take(pa.array(places)), self.sizes[places]
        self.starts = ends - self.sizes

    def _of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and where those of each end."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        total = int(sizes.sum())
        kind = np.int32 if max(total, len(self.flat)) < 1 << 31 else np.int64
        at = np.repeat((self.starts[places] - (ends - sizes)).astype(kind), sizes)
        at += np.arange(total, dtype=kind)
        return self.flat[at], ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        pieces, before = _pieces(texts, self.added), len(self.known)
        # the known ones come first, so each has its own place as its code
        coded = pa.chunked_array([self.known, pieces.flatten()]).dictionary_encode()
        self._learn(coded.chunk(0).dictionary)
        order = coded.chunk(1).indices.to_numpy() if coded.num_chunks > 1 else np.zeros(0, np.int32)
        ids, ends = self._of(order)
        if len(self.known) > KEPT_PIECES:
            met = np.bincount(order, minlength=before)[:before] > 0
            met[0] = True
            self._keep(np.flatnonzero(met))
        text_ends = pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()
        totals = np.concatenate([[0], ends])[text_ends]
        return ids, np.diff(totals, prepend=0)


@lru_cache(maxsize=1)
def worker_encoder(tokenizer_file: str) -> Encoder:
    """One encoder for all tasks of a worker, which knows the pieces of earlier ones."""
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(tokenizer_file))


def encode_texts(tokenizer, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each text has."""
    return Encoder(tokenizer).encode(pa.array(texts, pa.large_string()))


def write_shards(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 2,
    shard_tokens: int = SHARD_TOKENS,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode and write the shard files, numbered by (part, seq) in the order of keys.

    Texts are encoded where they are read, once; their ids are written and then sorted, which moves and samples ids only."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(tokenizer_file)
        dtype = np.dtype(narrowest((len(encoder.word_end) - 1).bit_length())).newbyteorder("<")
        for batch in batches:
            ids, sizes = encoder.encode(batch.column("t"))
            offsets = np.concatenate([[0], np.cumsum(sizes * dtype.itemsize)])
            values = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(dtype))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("h"), pa.array(sizes, pa.int64()), values.cast(pa.binary())], names=["k", "h", "n", "ids"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[int] = []
        pending: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            known = np.array([k is not None for k in keys])
            numbers = np.array([k or 0 for k in keys], np.int64)
            blob = Shard(numbers, known, np.array(lengths), WaveletMatrix.build(np.concatenate(pending))).to_bytes()
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "n_tokens": pa.array([held], pa.int64()),
                    "shard": pa.array([blob], pa.binary()),
                }
            )

        for batch in batches:
            values = batch.column("ids")
            for i, (k, n) in enumerate(zip(batch.column("k").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                data = values[i].as_buffer()
                keys.append(k)
                lengths.append(n + 1)
                pending += [np.frombuffer(data, f"<u{data.size // n}").astype(np.uint32)] if n else []
                pending.append(np.array([end_id], np.uint32))
                held += n + 1
                if held >= shard_tokens:
                    yield shard()
                    keys, lengths, pending, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield shard()

    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    encoded = stage(texts.mapInArrow(encode, "k long, h long, n long, ids binary"), "token-ids")
    shards = encoded.orderBy("k", "h").mapInArrow(pack, "part int, seq int, n_tokens long, shard binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, and its shard's number."""
    files = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.from_bytes(batch.column("shard")[i].as_py())
                ids = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([batch.column("part")[i].as_py()] * n, pa.int32()),
                        "seq": pa.array([batch.column("seq")[i].as_py()] * n, pa.int32()),
                        "doc_id": pa.array(shard.keys, pa.int64(), mask=shard.known == 0),
                        "local": pa.array(starts, pa.int64()),
                        "n_tokens": pa.array(shard.lengths, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    # one row per shard: sums within a part, and over the parts, of which there are as many as shuffle partitions
    shards = files.select("part", "seq", F.col("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("size").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("part_start")
    )
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("own")).join(parts, "part")
    rows = files.mapInArrow(decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("part_start") + F.col("own") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "part", "seq"
    )
