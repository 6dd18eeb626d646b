"""Cutoffs of the quality rules are attainable with few labels, and hold the bound."""

from __future__ import annotations

import math
import random

import pytest

from shelfwise.llm import quality_rules

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    """300 good and 40 low-quality texts in en, 250 and 20 in de, 100 and 20 in fr (too few); of the good ones 3 in en have symbols (ratio 0.13)."""
    rng = random.Random(7)
    docs, labels = [], []
    for lang, good, low in (("en", 300, 40), ("de", 250, 20), ("fr", 100, 20)):
        for i in range(good + low):
            signs = " ####" * 10 if i >= good or (lang == "en" and i < 3) else ""
            docs.append((len(docs), " ".join(f"w{rng.randrange(3000)}" for _ in range(60)) + signs, lang))
            labels.append((len(labels), int(i < good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS), docs, labels


def bound(n, alpha, limit):
    total, k = 0.0, -1
    for j in range(n + 1):
        total += math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j)
        if total > limit:
            return k
        k = j
    return k


def test_low_quality_texts_go_where_labels_suffice(spark, tables):
    docs, labels, rows, marks = tables
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()}
    for (i, _, lang), (_, good, _) in zip(rows, marks, strict=True):
        # en holds 3 good texts above the cutoffs to 0.1, more than 300 labels allow; fr has too few labels
        assert kept[i] == (good == 1 or lang != "de")


def test_bound_per_stratum(spark, tables):
    docs, labels, _, _ = tables
    policy = quality_rules.RiskPolicy()
    got = {r.stratum: (r.n, r.k_max, r.max_symbol_ratio) for r in quality_rules.thresholds(quality_rules.features(docs), labels, policy).collect()}
    limit = policy.delta / (4 * 2)  # four ratios, two strata with enough labels
    assert {s: (n, k) for s, (n, k, _) in got.items()} == {s: (n, bound(n, policy.alpha, limit)) for s, n in (("en", 300), ("de", 250), ("fr", 100))}
    assert [got[s][2] for s in ("en", "de", "fr")] == [0.15, 0.02, None] and got["en"][1] < 3


def test_tested_strata():
    for sizes in ([], [100], [184, 45, 32], [144, 144], [167, 167], [168, 150], [190] * 4, [189] * 4, [1739, 428, 421, 284], [300] * 500):
        m = quality_rules.tested_strata(sizes, 4, 0.03, 0.05)
        able = [sum(0.97**n <= 0.05 / (4 * x) for n in sizes) for x in range(1, m + 1)]
        assert able[-1] <= m and all(a > x for x, a in enumerate(able[:-1], 1))
