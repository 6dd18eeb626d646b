"""Rules as a table against the rules as part of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.rules import AUTO, PROTECTED, ClassLimits
from shelfwise.operators.classify import classify, flag_exceptions
from shelfwise.operators.keywords import keyword_index, keyword_table
from shelfwise.operators.quantiles import exact_quantiles_of


def table(spark, rules):
    return spark.createDataFrame([(c, w) for c, words in rules.items() for w in words], "column string, keyword string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "Žluťoučký kůň", "ab", "a", "aaa", "aaaa b", "praha 1", "PRAGENSIA"]
    texts += ["".join(rng.choice("abc ž.") for _ in range(rng.randrange(30))) for _ in range(200)]
    return spark.createDataFrame([(i % 150, t, rng.choice(texts)) for i, t in enumerate(texts)], "k int, a string, b string").repartition(3)


@pytest.mark.parametrize("literal", [True, False])
def test_equal_to_the_rules_in_the_plan(spark, titles, literal):
    rules = {
        "a": ["a", "ab", " ABC ", "", "kůň", "praha", "b.c" if literal else "b.?c", "aaa", "aaa"],
        "b": ["ž", "ca ", "^ac", "no such text", "žc$"] if not literal else ["ž.", "$", "(", "ca"],
        "missing": ["x"],
    }
    want = flag_exceptions(titles, rules, literal=literal)
    got = flag_exceptions(titles, table(spark, rules), literal=literal)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert {r["vyjimka_flag"] for r in got.collect()} == {True, False}


def test_no_rules(spark, titles):
    nothing = table(spark, {})
    assert flag_exceptions(titles, nothing).where("vyjimka_flag").count() == 0
    assert flag_exceptions(titles, table(spark, {"a": ["", " "]})).count() == titles.count()
    assert flag_exceptions(titles, table(spark, {"a": ["a"]}), enabled=False).where("vyjimka_flag").count() == 0


def test_ten_thousand_keywords(spark):
    words = [f"word{i}x" for i in range(10_000)]
    titles = spark.range(300).select(F.concat(F.lit("the WORD"), F.col("id") * 67, F.lit("X is here")).alias("TITUL_NAZEV"))
    rules = table(spark, {"TITUL_NAZEV": words})
    flagged = flag_exceptions(titles, rules)
    assert flagged.where("vyjimka_flag").count() == len([i for i in range(300) if i * 67 < 10_000])
    # the plan does not grow with the keywords
    few = flag_exceptions(titles, table(spark, {"TITUL_NAZEV": words[:10]}))
    sizes = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, flagged)]
    assert sizes[1] < 1.2 * sizes[0]
    held = keyword_index(keyword_table(rules).select("column", "keyword")).groupBy("run").count().agg(F.max("count")).first()[0]
    assert held <= 1000


def test_reason_of_a_title_found_by_a_table(spark):
    df = spark.createDataFrame(
        [("Praha 1", 0, None, 1.0), ("x", 0, 0.5, 99.0)],
        "TITUL_NAZEV string, vypujcky_5_let long, roky_od_posledni_vypujcky double, percentil_v_signature double",
    )
    got = classify(df, rules=table(spark, {"TITUL_NAZEV": ["PRAHA", "other"]}), limits=ClassLimits()).orderBy("TITUL_NAZEV").collect()
    assert [r["klasifikace"] for r in got] == [PROTECTED, AUTO]
    assert got[0]["duvod_oznaceni"] == "chráněno výjimkou: praha"


@pytest.mark.parametrize("limit", [10**6, 0])
def test_quantiles_of_several_columns(spark, limit):
    rng = random.Random(4)
    data = [(rng.choice([0.0, 0.0, rng.gauss(0, 1e6), 1e-9 * i]), None if i % 3 else i, None, float(i % 2)) for i in range(3001)]
    df = spark.createDataFrame(data, "a double, b long, c double, d double").repartition(3)
    wanted = {"a": [0.0, 0.1, 0.5, 0.77, 1.0], "b": [0.2, 0.5], "c": [0.5], "d": [0.25, 0.5, 1.0]}
    got = exact_quantiles_of(df, wanted, max_values=limit)
    for i, (c, ps) in enumerate(wanted.items()):
        values = sorted(r[i] for r in data if r[i] is not None)
        for p, q in zip(ps, got[c], strict=True):
            if not values:
                assert q is None
                continue
            x = p * (len(values) - 1)
            low, high = values[int(x)], values[min(int(x) + 1, len(values) - 1)]
            assert q == pytest.approx(low + (high - low) * (x - int(x)), rel=1e-12, abs=1e-18)
