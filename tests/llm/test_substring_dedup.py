"""Windows of 13 words that a smaller id has, against plain Python; the index against plain search."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import substring_dedup
from shelfwise.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Sorted (doc_id, n_words, n_removed, sha256) of (doc_id, text) pairs."""
    texts = [(d, SPACES.findall(t or "")) for d, t in rows]
    least = {}
    for d, words in texts:
        for i in range(len(words) - 12 if d is not None else 0):
            w = tuple(words[i : i + 13])
            least[w] = min(least.get(w, d), d)
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - 12 if d is not None else 0):
            if least[tuple(words[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((d, len(words), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)

    def words(n, size=4000):
        return [f"w{rng.randrange(size)}é" for _ in range(n)]

    out = [(None, None), (1, None), (2, ""), (3, " \n\t\x0b"), (4, " ".join(words(12))), (5, "a " * 400), (6, "a\n" * 13), (7, "A " * 20), (8, "a b " * 300)]
    out += [(9, "a " * 12), (10, "a b " * 300 + "c"), (11, "nb sp " * 14), (12, "nb sp " * 13), (13, "x" * 500_000), (14, "x" * 500_000)]
    base = words(300)
    for i in range(30):  # near copies
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(300)] = words(1)[0]
        out.append((100 + i, rng.choice([" ", "\n", "  "]).join(copy)))
    passage = words(13)
    for i in range(40):  # a passage of exactly 13 words and one of 12 in many texts
        own = words(rng.randrange(0, 60))
        at = rng.randrange(0, len(own) + 1)
        out.append((300 - i, " ".join([*own[:at], *(passage if i % 2 else passage[:12]), *own[at:]])))
    few = [" ".join(words(rng.randrange(1, 90), 3)) for _ in range(25)]  # three words in any order
    out += [(400 + i, t) for i, t in enumerate(few)] + [(400, few[3]), (401, few[1]), (401, few[1]), (None, few[2]), (None, few[2])]
    return out + [(500, " ".join(words(60_000, 2_000_000))), (-7, " ".join(base[100:180]))]


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS).repartition(5)


def test_query_is_plain_python(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op12_substring_dedup"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = plain(rows)
    assert sorted(map(tuple, df.collect()), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 40 and sum(r[2] == 0 for r in want) > 10


def test_heavy_anchors_and_small_shards(spark, rows):
    docs = table(spark, rows).selectExpr("doc_id", "text", "1 AS h", "2 AS t", "3 AS numbers", "4 AS n_words")
    found = substring_dedup.remove_repeats(docs, heavy=3, shard_bytes=2000).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found if r["doc_id"] is not None) == [
        r for r in sorted(plain(rows), key=lambda r: (r[0] is None, r)) if r[0] is not None
    ]
    assert all(sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in found) and len(found) == len(rows)


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


def test_pieces_do_not_depend_on_neighbours(rows):
    texts = [substring_dedup.normal((t or "").encode()) for _, t in rows if len(t or "") < 10_000]
    together = substring_dedup.Runs(texts)
    apart = [substring_dedup.Runs([t]) for t in texts]
    for k, one in enumerate(apart):
        own = together.text == k
        assert together.anchor[own].tolist() == one.anchor.tolist() and together.windows[own].tolist() == one.windows.tolist()
        assert together.number()[own].tolist() == list(range(len(one.text)))
        assert sum(one.windows) == max(0, one.count[0] - 12)


@pytest.mark.parametrize("symbols", [1, 2, 5, 40])
def test_matching_statistics(symbols):
    rng = random.Random(symbols)
    pieces = [[rng.randrange(symbols) for _ in range(rng.randrange(13, 40))] for _ in range(30)]
    owners = [rng.randrange(-50, 50) for _ in pieces]
    text, starts, n = substring_dedup.sequences(pa.array([" ".join(f"w{x}" for x in p).encode() for p in pieces], pa.binary()))
    index = substring_dedup.FMIndex(text, np.repeat(np.array(owners), np.diff(starts)), n)
    number = {f"w{x}": text[starts[k] + i] for k, p in enumerate(pieces) for i, x in enumerate(p)}
    # streamed: the pieces cut and put together anew, with words that the index does not have
    streams = [rng.choice(pieces)[rng.randrange(6) :] + [rng.randrange(symbols + 2) for _ in range(rng.randrange(9))] + rng.choice(pieces) for _ in range(40)]
    streams += [p[: rng.randrange(1, 14)] for p in pieces]
    flat = np.array([number.get(f"w{x}", 0) for s in streams for x in s], np.int32)
    ends = np.cumsum([len(s) for s in streams])
    at, least = index.statistics(flat, ends - [len(s) for s in streams], ends)
    want = {}
    for s, end in zip(streams, ends.tolist(), strict=True):
        for i in range(len(s) - 12):
            held = [o for p, o in zip(pieces, owners, strict=True) for j in range(len(p) - 12) if p[j : j + 13] == s[i : i + 13]]
            if held:
                want[end - len(s) + i] = min(held)
    assert dict(zip(at.tolist(), least.tolist(), strict=True)) == want and len(at) == len(want)


def test_marked_windows_of_many_texts_at_once():
    """Spans of several texts, with null and empty lists, against their bits one by one; also in a slice."""
    rng = random.Random(4)
    spans = [None, [], [{"word": 3, "n": 62, "bits": (1 << 62) - 1}]]
    for _ in range(30):
        sizes = [rng.randrange(1, 63) for _ in range(rng.randrange(0, 5))]
        spans.append([{"word": rng.randrange(1000), "n": n, "bits": rng.getrandbits(n)} for n in sizes])
    kind = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32()), ("bits", pa.int64())]))
    for start, end in ((0, len(spans)), (2, 9), (0, 2)):
        first, edges = substring_dedup._marked(pa.array(spans, kind).slice(start, end - start))
        got = [first[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        assert got == [
            [s["word"] + k for s in x or [] for k in range(s["n"]) if s["bits"] >> (s["n"] - 1 - k) & 1] for x in spans[start:end]
        ]


def test_all_anchors_are_neither_sorted_nor_numbered_twice(spark, rows, monkeypatch):
    staged = []
    stage = substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, label: staged.append((label, df._jdf.queryExecution().toString())) or stage(df, label))
    substring_dedup.remove_repeats(table(spark, rows))
    plans = dict(staged)
    assert "number#" not in plans["substring-anchors"]
    assert "ShuffledHashJoin" in plans["substring-numbers"] and "SortMergeJoin" not in plans["substring-numbers"]
