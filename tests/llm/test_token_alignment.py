"""Alignment of two tokenizers against a plain double loop over whole texts."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest

from shelfwise.llm import token_alignment
from shelfwise.llm.queries import BYTES, PIECES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def files():
    return public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    alphabet = "abcdefghij ABC  .,;!'\"\n\t123é ž漢😀-()"
    out = [None, "", " ", "  ", "\n", "a", "a ", " a", "two  blanks", "x\n\ny z \n w", "tab\tend\t", "it's we'll don't 'tis", "▁", "some▁ words"]
    out += ["<s> </s> <unk> <0x41> <|endoftext|> x", "word <|endoftext|>", "é ́x", "　wide　 space", "a\x00b c", "\x85 n\x1cp \x1d q"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) + rng.choice(["", ".", "\n"]) for _ in range(60)]
    return out + [out[-1], out[-1], "x" * 2000, " ".join(rng.choice(words) for _ in range(40_000))]


def plain(texts, pair):
    """Per text n_a, n_b, n_groups, n_links, n_best, count_sum and groups."""
    found = []
    for t in texts:
        a = b = []
        if t:
            a = pair.a.encode(" " + t, add_special_tokens=False).ids
            b = pair.b.encode(t)
            if b"".join(pair.bytes_a[x] for x in a) != (" " + t).encode() or b"".join(pair.bytes_b[x] for x in b) != (" " + t).encode():
                a = b = []
        spans = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            ends = np.cumsum([len(table[x]) for x in ids]).tolist()
            spans.append(list(zip(ids, [0, *ends], ends)))
        links, low = [], 0
        for x, start, end in spans[0]:
            while low < len(spans[1]) and spans[1][low][2] <= start:
                low += 1
            links += [(x, y) for y, s, e in spans[1][low : low + end - start + 1] if s < end and e > start]
        shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        group_of = {e: k for k, e in enumerate(shared)}
        groups = [([], []) for _ in shared]
        for side in (0, 1):
            k = 0
            for x, _, e in spans[side]:
                groups[k][side].append(x)
                k += e in group_of
        text = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        found.append((len(a), len(b), len(shared), links, text))
    held = Counter(p for *_, links, _ in found for p in set(links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (n_a, n_b, n_g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), text) for n_a, n_b, n_g, links, text in found
    ]


def test_query_is_the_plain_alignment(spark, texts, files, tmp_path):
    rows = [(None if i % 50 == 3 else i // 2, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op13_token_alignment"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain(texts, token_alignment.Pair(*files))
    assert sum(w[0] > 0 for w in want) > 200 and sum(w[0] == 0 for w in want) > 2
    expected = [(r[0], *w[:6], sha256(w[6].encode()).hexdigest() if w[0] else "") for r, w in zip(rows, want, strict=True)]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(expected, key=repr)


def test_pairs_beyond_the_broadcast(spark, texts, files):
    docs = spark.createDataFrame([(i, t, "g", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, groups string, rare long, _row long")
    want = plain(texts, token_alignment.Pair(*files))
    got = token_alignment.align(docs, *files, limit=40, with_groups=True).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", *token_alignment.SUMS, "groups")) for r in got) == [(i, *w) for i, w in enumerate(want)]


def test_empty_table(spark, files):
    df = token_alignment.align(spark.createDataFrame([], DOCS), *files)
    assert df.count() == 0


@pytest.mark.parametrize("step", [1, 2, 7, 128])
def test_merge_path_pieces(step):
    rng = np.random.default_rng(step)
    for _ in range(30):
        last = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(1, 80)), last)) for _ in range(2))
        i, j, group = token_alignment.merge_path(a, b, step)
        want, shared = [], np.intersect1d(a, b)
        for x, (s, e) in enumerate(zip([0, *a[:-1]], a, strict=True)):
            want += [(x, y, int((shared <= max(s, p)).sum())) for y, (p, q) in enumerate(zip([0, *b[:-1]], b, strict=True)) if s < q and p < e]
        assert list(zip(i.tolist(), j.tolist(), group.tolist(), strict=True)) == want
