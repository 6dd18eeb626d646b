"""Repeated bytes and shingles where hashes and stretches of few letters are at their worst."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from shelfwise.llm import jaccard_join, repeated_bytes
from shelfwise.llm.shingles import PrimeHash, RollingHash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], DOCS)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def stretches():
    """Texts of few letters: runs shorter, as long and longer than a window, with other texts around, cut by text ends, and their mixtures."""
    rng = random.Random(11)
    out = ["a" * n for n in (63, 399, 400, 401, 463, 3000)] + ["ab" * n for n in (200, 201, 300, 1500)] + ["abc" * 134, None, ""]
    for unit in ("-", "=*", "0 ", "xyz", "0123456789abcdef", "".join(rng.choices("pq", k=31)), "".join(rng.choices("pq", k=40)), "ž "):
        size = len(unit.encode())
        for length in (300, 400, 400 + size, 400 + 2 * size, 1200):
            run = (unit * (length // size + 1))[:length]
            out.append(prose(rng, rng.randrange(0, 60)) + run + prose(rng, rng.randrange(0, 60)))
        out.append("".join(prose(rng, 3) + unit * rng.randrange(1, 900 // size) for _ in range(8)))
    out.append("".join(rng.choice("ab") * rng.randrange(1, 600) for _ in range(60)))
    out.append("".join(rng.choice("ab") * rng.randrange(1, 600) for _ in range(60)))
    out.append("".join(rng.choices("ab", k=3000)))
    return list(enumerate(out))


def test_stretches_of_few_letters(spark, stretches):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(frame(spark, stretches)).collect()}
    assert got == brute.removal(stretches)


def test_rows_without_key_and_clashing_columns(spark):
    rng = random.Random(12)
    same, lone = prose(rng, 200), prose(rng, 200)
    docs = frame(spark, [(None, same), (None, same), (None, lone), (1, None), (1, "")]).withColumn("kept_text", F.lit("clash")).withColumn("_row", F.lit(1))
    got = sorted((r.text or "", r.n_removed, r.kept_text) for r in repeated_bytes.remove_repeats(docs).collect())
    n = len(same)
    assert got == sorted([(same, n, ""), (same, n, ""), (lone, 0, lone), ("", 0, ""), ("", 0, "")])


def test_periodic_runs():
    rng = random.Random(13)
    for _ in range(60):
        text = "".join(rng.choice(["x" * rng.randrange(1, 120), "ab" * rng.randrange(1, 80), prose(rng, 3), "pqrst" * rng.randrange(1, 30)]) for _ in range(6)).encode()
        got = {tuple(map(int, x)) for x in zip(*repeated_bytes.periodic_runs(np.frombuffer(text, np.uint8)), strict=True)}
        expected = set()
        for q in range(1, min(repeated_bytes.PERIOD, len(text) - 1) + 1):
            i = 0
            while i + q < len(text):
                j = i
                while j + q < len(text) and text[j] == text[j + q]:
                    j += 1
                if j + q - i >= repeated_bytes.GRAM and j > i:
                    expected.add((i, j + q, q))
                i = j + 1
        assert got == expected


def test_samples_of_long_texts(monkeypatch):
    """Few samples whatever the text, the same ones for any size of parts."""
    rng = np.random.default_rng(14)
    letters = rng.integers(97, 123, 100_000).astype(np.uint8)
    bounds = np.array([0, len(letters)])
    whole, _ = repeated_bytes.samples(letters, bounds, RollingHash())
    assert 400 < len(whole[0]) < 800
    monkeypatch.setattr(repeated_bytes, "PART_BYTES", 7000)
    parts, _ = repeated_bytes.samples(letters, bounds, RollingHash())
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True))
    for period in (1, 2, 13, 32):
        (a, *_), (start, end) = repeated_bytes.samples(np.resize(letters[:period], 100_000), bounds, RollingHash())
        assert len(a) < 3000 and (np.unique(np.concatenate([np.arange(s, e) for s, e in zip(start, end, strict=True)])) == np.arange(100_000)).all()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_crafted_words_do_not_link(spark):
    """Words that collide modulo a power of two for every base: not one text, not linked."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, word), (2, other), (3, f"x {word} y z w"), (4, f"x {other} y z w")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(frame(spark, docs)).collect()}
    assert got == {i: (1, i) for i in range(1, 5)}


def test_prime_hash():
    """Equal spans have equal hashes wherever they lie, also beyond a stretch of sums; against integers."""
    from shelfwise.llm import shingles

    rng = np.random.default_rng(15)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = rng.integers(0, 1500, 300)
    end = start + rng.integers(0, 1500, 300)
    hashing = PrimeHash()
    got = hashing.spans(hashing.sums(data), start, end)
    parts = [[sum((int(c) + 1) * pow(b, i, shingles.PRIME) for i, c in enumerate(data[s:e])) % shingles.PRIME for s, e in zip(start, end, strict=True)] for b in shingles.BASES]
    plain = np.array(parts[0], np.uint64) | np.array(parts[1], np.uint64) << np.uint64(31)
    assert (got == shingles._mix(plain)).all()
    small, shingles.STRETCH = shingles.STRETCH, 700
    assert (hashing.spans(hashing.sums(data), start, end) == got).all()
    shingles.STRETCH = small


def test_sets_of_large_texts_are_made_some_at_a_time():
    texts = [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(600)] + [None, "", "one"]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts)), pa.int64()), "t": pa.array(texts)})
    out = list(jaccard_join.set_batches(iter([batch]), False, []))
    assert max(b.num_rows for b in out) < 250 and sum(b.num_rows for b in out) == len(texts)
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert [r["n"] for r in rows] == [2996] * 600 + [0, 0, 1] == [len(r["tokens"]) for r in rows]


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """Many shuffle partitions do not make many tasks that write a few rows each."""
    from shelfwise.staging import stage

    rng = random.Random(6)
    shared = ["".join(rng.choices("abcdefgh ", k=500)) for _ in range(40)]
    rows = [(i, "".join(rng.choices("abcdefgh ", k=300)) + shared[i % 40] + "".join(rng.choices("abcdefgh ", k=rng.randrange(300)))) for i in range(200)]
    written = []

    def counted(df, label):
        table = stage(df, label)
        written.append((label, len(table.inputFiles())))
        return table

    monkeypatch.setattr(repeated_bytes, "stage", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repeated_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    assert len(got) == 200 and all(r.n_removed >= 500 for r in got)
    most = 2 * spark.sparkContext.defaultParallelism
    # tables of the samples' scan and of its spans follow the scan
    assert len(written) > 10 and max(n for label, n in written if label not in ("repeats-sampled", "repeats-spans", "repeats-flagged")) <= most


def test_tables_on_the_way_are_deleted(spark):
    from shelfwise.staging import stage, stage_result

    seen = []

    def make():
        seen.append(stage(spark.range(10), "on-the-way"))
        inner = stage_result(spark, lambda: stage(seen[0], "inner").where("id > 2"), "inner-result")
        seen.append(inner)
        return inner.where("id > 4")

    result = stage_result(spark, make, "result")
    assert sorted(r.id for r in result.collect()) == [5, 6, 7, 8, 9]
    for table in seen:
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
            table.collect()
