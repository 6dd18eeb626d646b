"""Operators against plain Python on small inputs with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from shelfwise.llm import (
    exact_topk,
    importance,
    jaccard_join,
    language_id,
    mixing,
    quality_rules,
    repeated_bytes,
    sampled_segmentation,
    token_shards,
    url_filter,
)
from shelfwise.llm.components import connected_components
from shelfwise.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Texts with groups of near copies, shared passages, junk and edge cases."""
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "one two", "One\x0bTWO", "a b c d e", "a b c d e", "é" * 300, "x" * 900, "x" * 401, "ab" * 450]
    passage = " ".join(words(rng, 90))
    for _ in range(12):
        base = words(rng, rng.choice([6, 9, 14, 40, 200]))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 1))
            texts.append(" ".join(copy))
    base = words(rng, 120)
    for _ in range(40):  # a group that is longer than a list of the small policy below
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(120)] = words(rng, 1)[0]
        texts.append(" ".join(copy))
    for _ in range(6):
        own = words(rng, 60)
        texts.append(" ".join([*own[:30], passage, *own[30:]]) + "\nžlutý kůň — " + passage[100:600])
    return list(enumerate(texts))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], DOCS)


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://A.Net/x?y", "http://net", "http://evilnet/", "https://a.example.net/en/1", "http://example.net/fr/",
        "http://b.example.com/de/#x", "http://x.org/fr/1", "http://x.org/en/?q=/fr/", "a://b://c.net/", "http://h.com/a/net/", "http://example.net/en/",
        "ftp://" + "é" * 50 + ".net/" + "p" * 5000,
    ]
    df = spark.createDataFrame([(i, u, "old", "kept") for i, u in enumerate(urls)], "page_id long, url string, host string, extra string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, "url", URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.url_parts(u)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best.text if best else None)
        assert got[i].verdict == (best.action if best else "allow") and got[i].extra == "kept"
    assert url_filter.filter_urls(df.limit(0), "url", URL_RULES).count() == 0


def test_globs_over_several_words():
    globs = ["a*c", "a**c", "?b", "**x**y", "\\*", "", "é?"] + [f"{'q' * i}*" for i in range(20)]
    texts = ["ac", "abc", "a/c", "ab", "/b", "zxzy", "*", "", "éa", "qqq", "q" * 19 + "z"]
    expected = []
    import re

    for t in texts:
        row = []
        for g in globs:
            parts = url_filter.parse_glob(g)
            pattern = b"".join(
                b".*" if p == "**" else b"[^/]*" if p == "*" else b"[^/]" if p is None else re.escape(p) for p in parts
            )
            row.append(re.fullmatch(pattern, t.encode(), re.S) is not None)
        expected.append(row)
    automaton = url_filter.GlobAutomaton(globs)
    assert automaton.words > 1
    assert automaton.accepts([t.encode() for t in texts]).tolist() == expected


def test_quality_counts(spark, corpus):
    docs = corpus + [(900, "a b c a b c\nx\n\nx\n#$ <|>"), (901, "a a a a"), (902, "y " * 3000)]
    got = {r.doc_id: r for r in quality_rules.features(frame(spark, docs)).collect()}
    for d, t in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.counts(t)


@pytest.mark.parametrize("n", [0, 10, 1000, 5000])
def test_exact_binomial_bound(spark, n):
    alpha, limit = 0.01, math.log(0.001)
    cdf, k = 0.0, -1
    for j in range(n + 1):
        cdf += math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j)
        if cdf > math.exp(limit):
            break
        k = j
    got = spark.range(1).select(quality_rules.largest_count(F.lit(n).cast("long"), alpha, F.lit(limit)).alias("k")).first().k
    assert got == k


def test_quality_thresholds_limit_false_rejection(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        text = " ".join(words(rng, 60)) + (" ####" * 20 if bad else " #" if i % 9 == 0 else "")
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(1, 1, 1), (None, 1, 0)]
    docs = frame(spark, rows)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i] for i in range(4000) if i % 4) and not any(got[i] for i in range(0, 4000, 4))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(docs.limit(0), none).count() == 0


SMALL = jaccard_join.JoinPolicy(heavy=5, list_limit=10, block=8)


@pytest.mark.parametrize("policy", [None, SMALL], ids=["default", "blocks"])
def test_near_copies(spark, corpus, policy):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_copies(frame(spark, corpus), policy).collect()}
    assert got == brute.components(corpus)


def test_near_copies_edge_cases(spark):
    docs = frame(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B c d e f"), (None, None), (7, "other words here"), (8, None)])
    got = sorted(map(tuple, jaccard_join.near_copies(docs).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 0, None), (7, 1, 7), (8, 0, 8)], key=str)
    assert jaccard_join.near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    assert got == {**{i: 0 for i in range(1, 51)}, 150: 100, 200: 100}


def test_repeated_bytes(spark, corpus):
    docs = frame(spark, corpus).withColumn("n_bytes", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.remove_repeats(docs).collect()}
    assert got == brute.removal(corpus)
    assert repeated_bytes.remove_repeats(docs.limit(0)).count() == 0
    twice = frame(spark, [(1, "q" * 10 + " ".join(map(str, range(300))))] * 2)
    assert [(r.n_removed == r.n_bytes, r.n_spans) for r in repeated_bytes.remove_repeats(twice).collect()] == [(True, 1)] * 2


def test_leftmost_minima():
    rng = np.random.default_rng(0)
    for n, width in ((1, 1), (10, 3), (100, 7), (50, 50), (64, 8)):
        h = rng.integers(0, 6, n).astype(np.uint64)
        expected = [i + int(np.argmin(h[i : i + width])) for i in range(n - width + 1)]
        assert repeated_bytes.leftmost_minima(h, width).tolist() == expected


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 8).tolist()) for i in range(1500)]
    rows += [(1500, None), (1600, [1.0, None]), (1700, [float("nan")] * 8), (1800, [float("inf")] * 8), (100, rows[7][1]), (1900, []), (2000, [1e30] * 8)]
    rows += [(3000 + i, rows[3][1]) for i in range(30)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 100 == 0).collect()))
    kept = [(i, [max(-(2**40), min(2**40, math.floor(1024 * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, v) in enumerate(kept):
        if i % 100 == 0:
            s = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, (j, w) in enumerate(kept) if b != a and len(w) == len(v)]
            expected += [(i, r + 1, j, x) for r, (x, j) in enumerate(sorted(s, key=lambda p: (-p[0], p[1]))[:10])]
    assert got == sorted(expected)
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_sends_a_query_to_homes_not_to_runs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "RUN_BYTES", 2048)  # 32 vectors
    monkeypatch.setattr(exact_topk, "LEAST_HOMES", 3)
    monkeypatch.setattr(exact_topk, "BLOCK", 8)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(-90, 90, (900, 8)), rng.integers(-90, 90, (300, 8)) * 40_000])  # numbers of 2 and of 4 bytes
    df = spark.createDataFrame([(i, [x / 1024 for x in row]) for i, row in enumerate(values.tolist())], "vec_id long, embedding array<double>")
    sent = []
    real = exact_topk._met
    monkeypatch.setattr(exact_topk, "_met", lambda *a: sent.append(real(*a)) or sent[-1])
    result = exact_topk.top_k(df, F.col("vec_id") % 20 == 0, k=7)
    assert "Join" not in result._jdf.queryExecution().optimizedPlan().toString()
    counts = {r.is_query: (r.n, r.homes, r.width) for r in sent[0].groupBy("is_query").agg(
        F.count("*").alias("n"), F.count_distinct("home").alias("homes"), F.array_sort(F.collect_set("width")).alias("width")).collect()}
    runs = counts[False][0]
    assert runs >= 37 and counts[False][1:] == (3, [2, 4])
    assert counts[True][0] < runs and counts[True][1] == 3  # three times each, where each was sent to every run
    got = {}
    for r in result.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    scores = values[::20] @ values.T
    for i, own in zip(range(0, 1200, 20), scores.tolist(), strict=True):
        best = sorted((j for j in range(1200) if j != i), key=lambda j: (-own[j], j))[:7]
        assert sorted(got[i]) == [(n + 1, j, own[j]) for n, j in enumerate(best)]
    # sums of products beyond 2**24 and 2**53 are exact, and the least score there is comes last
    q, v = np.array([[1 << 40, -(1 << 40)], [3, 5]]), np.array([[1 << 40, 1 - (1 << 40)], [1 << 40, 0], [-(1 << 40), 1 << 40], [7, 1]])
    found = exact_topk.search_run(q, np.array([-1, 3]), v, np.arange(4), np.arange(4), 4)
    assert [(f[0].tolist(), f[1].tolist()) for f in found] == [([0, 1, 3, 2], [(1 << 63) - 1, (1 << 63) - 1, 6 << 40, -(1 << 63)]), ([1, 2, 0], [3 << 40, 2 << 40, 5 - (2 << 40)])]


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 50)), "en", "big" if i % 10 else f"small{i % 3}", 0) for i in range(3000)]
    rows += [(9000, None, "en", None, 0), (9001, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, mixing.MixPolicy(max_epochs=2.0)).collect()
    by = {}
    for r in out:
        n, read, e = by.get(r.source, (0, 0, 0))
        by[r.source] = (n + r.mix_tokens, read + r.mix_tokens * r.mix_copies, r.mix_epochs)
    assert len(out) == len(rows) and all(r.mix_copies >= 1 for r in out)
    ratios = {s: e for s, (n, _, e) in by.items() if n}
    assert max(ratios.values()) == pytest.approx(2.0, rel=1e-3) and min(ratios.values()) == pytest.approx(1.0)
    for n, read, e in by.values():
        if n:
            assert read == pytest.approx(e * n, abs=200)
    assert mixing.realise(mixing.mix(df)).count() == sum(r.mix_copies for r in mixing.mix(df).collect())
    half = mixing.mix(df, mixing.MixPolicy(max_epochs=None, target_entropy=0.9, budget=75_000.0)).collect()
    assert sum(r.mix_tokens * r.mix_copies for r in half) == pytest.approx(75_000, rel=0.02)
    w = {r.source: r.mix_weight for r in half if r.mix_weight}
    assert -sum(x * math.log(x) for x in w.values()) / math.log(len(w)) == pytest.approx(0.9, abs=1e-3)
    assert mixing.mix(df.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "äöüßxyzk"}
    rows = [(i, " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(20)), k) for i in range(300) for k in letters]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 200"), language_id.TrainPolicy(max_train=300))
    test = df.where("doc_id >= 200").union(spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "12 .. 4", "aa")], df.schema))
    got = language_id.predict(test.withColumn("score", F.lit("clash")), model).collect()
    right = [r.lang_pred == r.lang for r in got if r.doc_id >= 200]
    assert np.mean(right) > 0.99
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in got if r.doc_id < 200)
    assert all(0 <= r.score <= 1 for r in got)
    untrained = language_id.train(df.limit(0), language_id.TrainPolicy())
    assert {r.lang_pred for r in language_id.predict(df.limit(5), untrained).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3)] for k in range(520)}
    rows = [(12 * i + j, " ".join(rng.choices(w, k=12)), k) for i, (k, w) in enumerate(words.items()) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, language_id.TrainPolicy(max_train=10_000, epochs=8))
    assert model.languages == sorted(words)
    last = [r for r in language_id.predict(df, model).collect() if r.lang >= "l500"]
    assert np.mean([r.lang_pred == r.lang for r in last]) > 0.5
    with pytest.raises(ValueError, match="languages"):
        language_id.train(df, language_id.TrainPolicy(max_languages=519))
    # the sample does not depend on how rows are dealt, also where one key holds more rows than the bound
    same = df.union(spark.createDataFrame([(3, f"word{i} other", "l000") for i in range(3000)], df.schema))
    small = language_id.TrainPolicy(max_train=600, epochs=1)
    tables = [language_id.train(same.repartition(n), small).table for n in (2, 5)]
    assert np.array_equal(*tables)


def test_wavelet_matrix():
    rng = np.random.default_rng(6)
    for n, top in ((0, 1), (1, 1), (700, 5), (5000, 49_408)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        shard = token_shards.Shard(np.array([1]), np.array([1]), np.array([n]), token_shards.WaveletMatrix.build(ids))
        m = token_shards.Shard.from_bytes(shard.to_bytes()).matrix
        assert m.decode().tolist() == ids.tolist()
        for i in range(0, n, 97):
            assert m.access(i) == ids[i]
            assert m.count(int(ids[i]), i // 2, i) == (ids[i // 2 : i] == ids[i]).sum()
        for symbol in {*ids[:3].tolist(), 7, 1 << 20}:
            assert m.occurrences(symbol) == np.flatnonzero(ids == symbol).tolist()


def test_token_shards(spark, corpus, tmp_path):
    import zlib

    from tokenizers import Tokenizer

    odd = ["It's  DON'T\u00a0x\u0301 \u0301y", "a\x01b \x01 c", "<|endoftext|> The. end, <|startoftext|>x", "tab\tx\r\ny\x1cz", "Σς ΑΣ. İ, ﬁ", "!., ,. ...x. y,. Z. "]
    docs = corpus + [(2000 + i, t) for i, t in enumerate(odd)]
    file = public_tokenizers.path("word_bpe_49k.json")
    token_shards.write_shards(frame(spark, docs), str(tmp_path / "shards"), file, shard_tokens=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_shards.read_documents(spark, str(tmp_path / "shards")).collect()}
    tokenizer, start = Tokenizer.from_file(file), 0
    for d, t in sorted(docs):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_segmentation_round_trip(spark, corpus):
    docs = corpus + [(2000, "  two  blanks   \n\t"), (2001, "漢字 ▁ literal\x00 end "), (2002, " "), (2003, "ž" * 50)]
    df = frame(spark, docs).withColumn("sample", F.lit("clash"))
    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = sampled_segmentation.segmentations(df, file, k=3).collect()
    assert all(r.decoded_ok for r in rows)
    assert {r.doc_id for r in rows} == {d for d, _ in docs}
    seen = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r["sample"])):
        assert r.perturbed <= seen.get(r.doc_id, (math.inf, set()))[0] and tuple(r.piece_ids) not in seen.get(r.doc_id, (0, set()))[1]
        seen[r.doc_id] = (r.perturbed, seen.get(r.doc_id, (0, set()))[1] | {tuple(r.piece_ids)})
    again = sampled_segmentation.segmentations(df.repartition(3), file, k=3).collect()
    key = lambda r: (r.doc_id, r["sample"], tuple(r.piece_ids))
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_segmentation_distribution():
    """Of all segmentations of a word the first sample follows their probabilities, and inclusion follows Gumbel top-k."""
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sampled_segmentation.Pieces(file)
    found = {}

    def walk(rest, ids, log_p):
        if not rest:
            found[tuple(ids)] = log_p
        for i, b in enumerate(pieces.bytes):
            if b and len(b) > 0 and rest.startswith(b) and i not in byte_pieces:
                walk(rest[len(b) :], [*ids, i], log_p + pieces.log_prob[i])

    byte_pieces = set(pieces.byte_ids.tolist())
    walk(b" the cat", [], 0.0)
    found = {k: v for k, v in found.items() if sentencepiece.SentencePieceProcessor(model_file=file).decode(list(k)) == "the cat"}
    total = np.logaddexp.reduce(list(found.values()))
    n = 4000
    drawn = sampled_segmentation.segment_batch(["the cat"] * n, list(range(n)), sampled_segmentation.Lattices(pieces), 2)
    first = {}
    for samples in drawn:
        assert tuple(samples[0][0].tolist()) in found
        first[tuple(samples[0][0].tolist())] = first.get(tuple(samples[0][0].tolist()), 0) + 1
        assert samples[0][1] == pytest.approx(found[tuple(samples[0][0].tolist())] - total, abs=1e-6)
    for k, v in found.items():
        p = math.exp(v - total)
        assert first.get(k, 0) / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-3)
    # without replacement: the second sample of those with first k is distributed as the rest
    best = max(found, key=found.get)
    p = math.exp(found[best] - total)
    both = sum(best in {tuple(s[0].tolist()) for s in samples} for samples in drawn) / n
    expected = p + sum(math.exp(v - total) * p / (1 - math.exp(v - total)) for k, v in found.items() if k != best)
    assert both == pytest.approx(expected, abs=0.03)


def test_importance_resampling(spark):
    rng = random.Random(8)
    good = [(i, " ".join(rng.choices(["fine", "prose", "reads", "well"], k=30))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choices(["buy", "now", "cheap", "click"], k=30))) for i in range(200)]
    docs = frame(spark, [*good, *bad, (5000, None), (5001, "")]).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    rows = importance.resample(docs, labels, share=0.5).collect()
    assert sum(r.kept for r in rows) == 201
    assert {r.doc_id for r in rows if r.kept} >= set(range(200))
    assert {r.log_weight for r in rows if r.doc_id >= 5000} == {0.0}
    keys = sorted((r.sample_key for r in rows), reverse=True)
    frame_ = spark.createDataFrame([(k,) for k in keys], "sample_key double")
    assert [importance.cutoff(frame_, k) for k in (1, 7, 401)] == [keys[0], keys[6], keys[400]]
    assert {r.log_weight for r in importance.resample(docs, labels.limit(0)).collect()} == {0.0}
    assert importance.resample(docs.limit(0), labels).count() == 0
