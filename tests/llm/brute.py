"""Plain Python statements of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPACES.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def shingles(text, k=5):
    words = SPACES.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def components(docs):
    """doc_id -> (n_shingles, component_id) of (doc_id, text) pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), find(d)) for d, s in sets}


def removal(docs, length=400):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256) of (doc_id, text) pairs."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out
