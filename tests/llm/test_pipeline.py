"""Stages of the pipeline against plain Python, null and repeated ids included."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Groups of near copies, each with ids of its own, without ids, or with ids that other groups have."""
    rng = random.Random(9)
    out = []
    for group in range(24):
        base = words(rng, 120)
        for j in range(rng.choice([1, 1, 3])):
            text = " ".join([*base[: 118 - j], *words(rng, j), *base[118:]])
            key = [100 + 10 * group + j, None, 5 + group % 2, None if j else 900 + group][group % 4]
            out.append((key, text, "en", f"s{group % 3}", len(text)))
    same = " ".join(words(rng, 80))
    out += [(7, same, "en", "a", 1), (7, same, "en", "a", 1), (7, same, "de", "a", 1), (7, same.upper(), "en", "a", 1)]
    out += [(None, same + " end", "en", "a", 1), (None, " ".join(words(rng, 70)), "en", None, None)]
    return out + [out[-1], (None, None, "en", "a", 0), (None, None, "en", "a", 0), (None, "", None, "a", 0), (5, "", "en", "a", 0), (5, " ", "en", "a", 0)]


def classes(rows):
    """Lists of rows, one for each class of near copies."""
    found = {}
    for i, (_, c) in brute.components([(i, r[1]) for i, r in enumerate(rows)]).items():
        found.setdefault(c, []).append(rows[i])
    return list(found.values())


def check_near_copies(got, rows):
    """One row of each class, with its least id; equal rows without words are one."""
    wordless = {r for r in rows if not brute.shingles(r[1])}
    assert Counter(r for r in got if r in wordless) == Counter(wordless)
    groups = [c for c in classes(rows) if c[0] not in wordless]
    left = Counter(r for r in got if r not in wordless)
    assert left.total() == len(groups)
    for group in groups:
        ids = [r[0] for r in group if r[0] is not None]
        assert [r[0] for r in set(group) for _ in range(left[r])] == [min(ids, default=None)]


def test_near_copies_by_row(spark, rows):
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()]
    check_near_copies(got, rows)
    again = [tuple(r) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows[::-1], DOCS).repartition(5), "").collect()]
    assert Counter(again) == Counter(got)
    assert corpus_pipeline.near_copies(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_passages_of_over_fifty_words(spark):
    """Passages of 60 short words, of less than 400 bytes, go from all texts that share them; other texts stay as they are."""
    rng = random.Random(4)
    passages = [" ".join(words(rng, 60)) for _ in range(5)]
    assert max(len(p.encode()) for p in passages) < 400
    rows, clean = [], []
    for i in range(40):
        a, b = (" ".join(words(rng, rng.randrange(20, 90))) for _ in range(2))
        shared = i < 15
        rows.append((i, f"{a} {passages[i % 5]} {b}" if shared else f"{a} {b}", "en", "s", 1))
        clean += [] if shared else [rows[-1][:2]]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()}
    assert len(got) == 40 and all(got[i].text == t for i, t in clean)
    for i, t, *_ in rows[:15]:
        assert passages[i % 5] not in got[i].text and got[i].n_chars == len(got[i].text) <= len(t) - len(passages[i % 5])
