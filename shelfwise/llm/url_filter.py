"""URL filter: all rules and globs run at once in one bit-parallel automaton (Shift-And over several words).

A glob is a string over bytes in which ``*`` stands for any run without ``/``, ``**`` for any run, ``?`` for one byte
other than ``/`` and ``\\`` takes the next character literally. Every state of every glob is one bit; the states of all globs lie side by
side in 64-bit words. One step over a byte ``c`` is ``D = ((D << 1) & B[c]) | (D & S[c])``: ``B`` holds the states that ``c`` leads
into, ``S`` those that a star keeps. Many URLs advance together, one numpy step for each byte position.

Edge cases: a null URL, or one without ``://``, has an empty host and path and can only meet a glob that accepts the empty string; an empty
table gives an empty result; repeated rows are judged each; a very long URL is walked to its end; when several rules fit, the longest
counts, and of rules of one length the first in the list. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY, SEGMENT = "**", "*"
SPECIAL = "*?\\"


@dataclass(frozen=True)
class UrlRule:
    """``action`` (allow or block) for a host with its subdomains and every path that starts with ``path``."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    def globs(self) -> list[str]:
        literal = "".join(f"\\{c}" if c in SPECIAL else c for c in self.text)
        return [f"{literal}**", f"*.{literal}**"]


@dataclass(frozen=True)
class UrlGlob:
    """``action`` for canonical URLs (host and path) that a glob accepts, where no rule fits."""

    action: str
    glob: str


def parse_glob(glob: str) -> list[bytes | str | None]:
    """Tokens of a glob: one byte, ``None`` for any byte but ``/``, or one of the two stars."""
    out: list[bytes | str | None] = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out += [bytes([b]) for b in glob[i].encode()]
        elif c == "*":
            wide = glob.startswith("**", i)
            i += wide
            out.append(ANY if wide else SEGMENT)
        elif c == "?":
            out.append(None)
        else:
            out += [bytes([b]) for b in c.encode()]
        i += 1
    return out


class GlobAutomaton:
    """All globs packed into one multiword bit-vector."""

    def __init__(self, globs: Sequence[str]) -> None:
        parsed = [parse_glob(g) for g in globs]
        n_bits = sum(1 + sum(t not in (ANY, SEGMENT) for t in p) for p in parsed)
        self.words = max(1, -(-n_bits // 64))
        into = np.zeros((256, self.words), np.uint64)
        stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        not_slash = np.arange(256) != ord("/")
        at = 0
        for tokens in parsed:
            self._set(self.start, at)
            for t in tokens:
                word, bit = divmod(at, 64)
                mask = np.uint64(1 << bit)
                if t == ANY:
                    stay[:, word] |= mask
                elif t == SEGMENT:
                    stay[not_slash, word] |= mask
                else:
                    at += 1
                    word, bit = divmod(at, 64)
                    accepted = not_slash if t is None else t[0]
                    into[accepted, word] |= np.uint64(1 << bit)
            self.final.append((at // 64, np.uint64(1 << (at % 64))))
            at += 1
        self.into, self.stay = into, stay

    @staticmethod
    def _set(row: np.ndarray, at: int) -> None:
        row[at // 64] |= np.uint64(1 << (at % 64))

    def accepts(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (text, glob). Texts are walked in step, longest first, so those that ended drop out."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        offsets = (np.cumsum(lengths) - lengths)[order]
        running = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for i, m in enumerate(running):
            c = flat[offsets[:m] + i]
            now = state[:m]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:m] = (moved & self.into[c]) | (now & self.stay[c])
        out = np.zeros((len(texts), len(self.final)), bool)
        for g, (word, mask) in enumerate(self.final):
            out[order, g] = (state[:, word] & mask) != 0
        return out


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def filter_urls(
    df: DataFrame, url: str, rules: Sequence[UrlRule], globs: Sequence[UrlGlob] = (), default: str = "allow"
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``glob`` and ``verdict``: the longest rule's action, else that of the first glob
    that accepts, else ``default``."""
    ranked = sorted(rules, key=lambda r: -len(r.text))
    patterns = [g for r in ranked for g in r.globs()] + [g.glob for g in globs]
    actions = np.array([r.action for r in ranked] + [g.action for g in globs] + [default], object)
    rule_names = np.array([r.text for r in ranked] + [None] * (len(globs) + 1), object)
    glob_names = np.array([None] * len(ranked) + [g.glob for g in globs] + [None], object)
    n_rules = len(ranked)
    added = ("host", "path", "rule", "glob", "verdict")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(patterns)
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [url_parts(u) for u in batch.column("_url").to_pylist()]
            hits = automaton.accepts([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            by_rule = hits[:, : 2 * n_rules].reshape(len(parts), n_rules, 2).any(axis=2)
            decided = np.concatenate([by_rule, hits[:, 2 * n_rules :], np.ones((len(parts), 1), bool)], axis=1)
            first = decided.argmax(axis=1)
            columns = [
                pa.array([h for h, _ in parts], pa.string()),
                pa.array([p for _, p in parts], pa.string()),
                *(pa.array(names[first], pa.string()) for names in (rule_names, glob_names, actions)),
            ]
            kept = [c for c in batch.schema.names if c != "_url"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=kept + list(added))

    kept = df.drop(*added) if url not in added else df.drop(*[c for c in added if c != url])
    source = kept.select("*", F.col(url).cast("string").alias("_url"))
    source = source.drop(url) if url in added else source
    fields = [f for f in source.schema.fields if f.name != "_url"]
    schema = T.StructType([*fields, *(T.StructField(c, T.StringType()) for c in added)])
    return source.mapInArrow(judge, schema)
