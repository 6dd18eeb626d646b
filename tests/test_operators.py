import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import candidates as cand
from shelfwise.operators import discovery, summaries
from shelfwise.operators.classify import rules_from_json
from shelfwise.operators.enrich import assemble_titles, enrich_operations
from shelfwise.operators.joins import join_code_list
from shelfwise.operators.quality import validate_build
from shelfwise.operators.quantiles import exact_quantiles
from shelfwise.operators.subjects import title_subjects


@pytest.mark.parametrize("max_values", [0, 1_000_000])
@pytest.mark.parametrize("kind", ["mixed", "single", "two", "distinct"])
def test_quantiles_match_numpy(spark, kind, max_values):
    rnd = random.Random(4)
    values = {
        "mixed": [0.0] * 400 + [rnd.random() for _ in range(1200)] + [7.5] * 11,
        "single": [3.0],
        "two": [1.0, 2.0],
        "distinct": [float(i) for i in rnd.sample(range(5000), 3000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(4)
    probabilities = [0.0, 0.1, 0.2, 0.5, 0.8, 0.9, 1.0]
    got = exact_quantiles(df, "x", probabilities, max_values=max_values)
    assert got == pytest.approx(list(np.quantile(values, probabilities)), abs=1e-12)


@pytest.mark.parametrize("max_values", [0, 10])
def test_quantiles_of_nothing(spark, max_values):
    assert exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5], max_values=max_values) == [None]


@pytest.mark.parametrize("max_rows", [0, 100])
def test_code_list_join_is_the_same_with_salt(spark, max_rows):
    big = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("k"))
    codes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2")], "k bigint, t string")
    got = join_code_list(big, codes, "k", max_rows=max_rows).select("id", "k", "t")
    want = big.join(codes, "k", "left").select("id", "k", "t")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


TITLES = (
    "title_key string, SIGN_PREFIX string, TITUL_NAZEV string, TITUL_JAZYK string, TITUL_DRUH_DOKUMENTU string, "
    "desk_subjects string, och_subjects string, pocet_opid_4 bigint, pocet_svazku bigint, vykon_na_svazek double, "
    "klasifikace string"
)


@pytest.fixture(scope="module")
def titles(spark):
    rows = [
        ("k1", "JD", "Praha stará", "cze", "a", "historie | město", "dějiny", 5, 10, 0.1, "AUTO_KANDIDAT"),
        ("k2", "JD", "Brno", "cze", "b", "", None, 0, 2, 3.0, "PONECHAT"),
        ("k3", "AB", None, "eng", "a", "music; Art,x", "umění", None, 1, 9.0, "RUCNI_POSOUZENI"),
        ("k3", "AB", "dup", "eng", "a", " ", "", 1, 4, 0.0, "RUCNI_POSOUZENI"),
        (None, None, "lost", None, None, None, "", 1, None, None, "CHRANENO_VYJIMKOU"),
    ]
    return spark.createDataFrame(rows, TITLES)


def names(df):
    return sorted(r["TITUL_NAZEV"] or "-" for r in df.collect())


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        (cand.Filters(), ["-", "Brno", "Praha stará", "dup", "lost"]),
        (cand.Filters(prefixes=["JD"]), ["Brno", "Praha stará"]),
        (cand.Filters(languages=["eng"], doc_types=["a"]), ["-", "dup"]),
        (cand.Filters(classes=["PONECHAT"]), ["Brno"]),
        (cand.Filters(name="PRAHA|brno"), ["Brno", "Praha stará"]),
        (cand.Filters(name="a|b", literal=True), []),
        (cand.Filters(desk_terms=["MĚSTO", " ", "art"]), ["-", "Praha stará"]),
        (cand.Filters(desk_terms=["x"], och_terms=["umě"]), ["-"]),
        (cand.Filters(count_column="pocet_opid_4", count_range=(0, 1)), ["-", "Brno", "dup", "lost"]),
        (cand.Filters(count_column="nothing", count_range=(0, 1)), ["-", "Brno", "Praha stará", "dup", "lost"]),
        (cand.Filters(copies_range=(0, 2), use_range=(0.0, 3.0)), ["Brno", "lost"]),
        (cand.Filters(copies_range=(4, None)), ["Praha stará", "dup"]),
    ],
)
def test_filters(titles, filters, expected):
    assert names(cand.apply_filters(titles, filters)) == expected


def test_filters_reach_the_scan(spark, titles, tmp_path):
    titles.write.parquet(str(tmp_path / "t"))
    df = cand.apply_filters(spark.read.parquet(str(tmp_path / "t")), cand.Filters(prefixes=["JD"], classes=["PONECHAT"]))
    plan = df.select("title_key")._jdf.queryExecution().executedPlan().toString()
    assert "SIGN_PREFIX" in plan.split("PushedFilters")[1].split("]")[0]
    assert "vykon_na_svazek" not in plan.split("ReadSchema")[1]


def test_candidate_lists(titles):
    off = cand.write_off_candidates(titles, k=2).collect()
    assert [r["TITUL_NAZEV"] for r in off] == ["dup", "Praha stará"]
    buy = cand.buy_candidates(titles, max_copies=2, min_use=1.0).collect()
    assert [r["TITUL_NAZEV"] for r in buy] == [None, "Brno"]
    assert cand.medians(titles) == (2, 0.1)
    unclear = cand.unclear_cases(titles)
    assert {r["TITUL_NAZEV"]: r["typ"] for r in unclear.collect()} == {
        "Praha stará": cand.UNCLEAR_HIGH, "Brno": cand.UNCLEAR_HIGH, "lost": cand.UNCLEAR_LOW,
    }
    assert cand.candidate_table(unclear).columns[0] == "typ"
    assert cand.count_filter_bounds(titles, "pocet_opid_4") == (5, 5)


def test_recommended_ranges(titles):
    ranges = cand.recommended_ranges(titles)
    copies, use = [10, 2, 1, 4, 0], [0.1, 3.0, 9.0, 0.0, 0.0]
    assert ranges.copies_high == int(max(3, np.quantile(copies, 0.9)))
    assert ranges.copies_low == int(max(1, np.quantile(copies, 0.1)))
    assert (ranges.use_low, ranges.use_high) == pytest.approx((np.quantile(use, 0.2), np.quantile(use, 0.8)))
    assert ranges.write_off["copies_range"] == (ranges.copies_high, 10)
    assert ranges.buy["copies_range"] == (0, 1) and ranges.buy["use_range"][1] == 9.0


def test_top_k_uses_a_bounded_plan(titles):
    plan = cand.write_off_candidates(titles)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_summaries(titles):
    matrix = {r["SIGN_PREFIX"]: r.asDict() for r in summaries.by_prefix(titles).collect()}
    assert set(matrix) == {"JD", "AB"}
    assert matrix["AB"]["RUCNI_POSOUZENI"] == 1 and matrix["AB"]["CELKEM_TITULU"] == 1
    kpi = summaries.kpi(titles).first()
    assert (kpi["titulu_celkem"], kpi["RUCNI_POSOUZENI"], kpi["svazku_celkem"]) == (3, 2, 17)
    assert kpi["prum_vykon"] == pytest.approx(12.1 / 5) and kpi["podil_PONECHAT"] == pytest.approx(100 / 3)
    empty = summaries.kpi(titles.filter("FALSE")).first()
    assert (empty["titulu_celkem"], empty["prum_vykon"], empty["podil_PONECHAT"]) == (0, 0.0, None)
    assert summaries.fill_rate(titles).first().asDict() == {
        "desk_subjects_vyplneno": 2, "och_subjects_vyplneno": 2, "celkem": 5,
    }
    facets = [(r["facet"], r["value"]) for r in summaries.facet_values(titles).collect()]
    assert ("TITUL_JAZYK", "") in facets and len(facets) == 9
    assert [r["pocet"] for r in summaries.class_counts(titles).collect()][0] == 2
    assert summaries.focus_prefix(titles, "AB").count() == 2


def test_vocabulary(titles):
    terms = [r["term"] for r in summaries.vocabulary(titles, "desk_subjects").collect()]
    assert terms == ["Art", "historie", "music", "město"] or terms == ["Art", "historie", "město", "music"]
    found = summaries.suggestions(summaries.vocabulary(titles, "desk_subjects"), " M").collect()
    assert {r["term"] for r in found} == {"music", "město"}


def test_histogram(spark):
    df = spark.createDataFrame([(i,) for i in [0, 0, 1, 29, 30, None]], "vypujcky_5_let bigint")
    assert {r["bin"]: r["pocet"] for r in summaries.loan_histogram(df).collect()} == {0: 2, 1: 1, 29: 2}
    same = df.filter("vypujcky_5_let = 0")
    assert {r["bin"]: r["pocet"] for r in summaries.loan_histogram(same).collect()} == {0: 2}


def test_discovery_edge_cases(spark):
    df = spark.createDataFrame(
        [(4, " a ", " x", True, None), (4, "", "y ", None, "LOAN "), (None, None, None, False, "loan"), (7, "b", None, False, "x")],
        "VYP_OPID bigint, ACTION_TYPE string, OPIDY_POPIS string, IS_LOAN boolean, ACTION_GROUP string",
    )
    assert [r["a"] for r in discovery.action_types(df).collect()] == ["a", "b"]
    assert [r["a"] for r in discovery.suggested_loan_actions(df).collect()] == ["a"]
    assert discovery.default_loan_actions(df.drop("IS_LOAN", "ACTION_GROUP")) == ("a", "b")
    assert [tuple(r) for r in discovery.opid_legend(df).collect()] == [(4, "y"), (7, None)]
    assert [r["opid"] for r in discovery.distinct_opids(df, max_opids=1).collect()] == [4]
    assert discovery.distinct_opids(df.drop("VYP_OPID")).count() == 0
    assert discovery.opid_legend(df.drop("OPIDY_POPIS")).first()["popis"] is None


def test_prefix_summary_counts_keys(spark):
    rows = [("JD 1", "a"), ("JD 1", "a"), ("JD 2", "b"), (None, "c"), ("AB 1", None)]
    df = spark.createDataFrame(rows, "TITUL_SIGN_FULL string, TITUL_NAZEV string")
    got = {r["SIGN_PREFIX"]: r["TITULU"] for r in discovery.prefix_summary(df).collect()}
    assert got == {"JD": 2, None: 1, "AB": 1}


def test_rules_table(spark):
    df = spark.createDataFrame([('{"A": ["x", 1], "B": "no", "C": {"d": [1]}}',), ("broken",)], "t string")
    assert sorted(map(tuple, rules_from_json(df, "t").collect())) == [("A", "1"), ("A", "x")]


def test_subject_tables(spark):
    och = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 9), (None, 1)], "ptr_titul int, PTR_TXOCH int")
    txoch = spark.createDataFrame([(1, " b "), (2, "a"), (2, "a "), (3, "z")], "TXOCH_KEY int, TXOCH_TEXT string")
    desk = spark.createDataFrame([(1, 5, "own"), (3, 6, " ")], "DESK_PTR_TITUL int, DESK_PTR_DESKT int, DESK_TEXT string")
    deskt = spark.createDataFrame([(5,)], "DESKT_KEY int")
    txdesk = spark.createDataFrame([(5, "via"), (6, "never")], "TXDESK_PTR_DESKT int, TXDESK_TEXT string")
    got = {r["TITUL_KEY"]: (r["och_subjects"], r["desk_subjects"]) for r in title_subjects(och, txoch, desk, deskt, txdesk).collect()}
    # the key of txdesk also serves as a direct link, so text 6 is reached that way
    assert got == {1: ("a | b", "own | via"), 2: ("", ""), 3: ("", "never")}
    only = title_subjects(och=och, txoch=txoch)
    assert only.columns == ["TITUL_KEY", "och_subjects", "desk_subjects"]
    assert title_subjects(och=och) is None and title_subjects(desk=deskt) is None


def star(spark):
    ops = spark.createDataFrame(
        [(1, 7, "2024-01-07 10:00:00", 4, 1), (2, None, "bad", 8, 9), (None, 8, "2024-02-29", None, None)],
        "STAT_VYP_PTR_SVAZKY bigint, STAT_VYP_PTR_LEG bigint, STAT_VYP_TIME string, STAT_VYP_OPID bigint, "
        "STAT_VYP_PTR_KNODDEL bigint",
    )
    copies = spark.createDataFrame([(1, 10), (2, 20)], "SVAZKY_KEY bigint, SVAZKY_PTR_TITUL bigint")
    titles = spark.createDataFrame(
        [(10, "JD 1", "n", "z", "1999", "cze", "k")],
        "TITUL_KEY bigint, TITUL_SIGN_FULL string, TITUL_NAZEV string, TITUL_ZAHLAVI string, TITUL_ROK_VYDANI string, "
        "TITUL_JAZYK string, TITUL_DRUH_DOKUMENTU string",
    )
    types = spark.createDataFrame([(4, "loan"), (8, " ")], "OPIDY_OPID bigint, OPIDY_POPIS string")
    places = spark.createDataFrame([(1, "b", "s", "p")], "KNODDEL_KEY bigint, KNODDEL_NAZEV string, KNODDEL_ULICE string, KNODDEL_PSC string")
    readers = spark.createDataFrame([(7, 30, "0", "110 00")], "LEG_KEY bigint, VEK bigint, POHLAVI string, ADRESY_PSC string")
    return ops, copies, titles, types, places, readers


def test_enriched_operations(spark):
    ops, copies, titles, types, places, readers = star(spark)
    doc = spark.createDataFrame([("k", "book")], "CISELNIKY_ZKRATKA string, CISELNIKY_TEXT string")
    subjects = spark.createDataFrame([(20, "d", "o")], "TITUL_KEY bigint, desk_subjects string, och_subjects string")
    wide = enrich_operations(ops, copies, titles, types, places, doc_types=doc, subjects=subjects, readers=readers)
    rows = {r["VYP_PTR_SVAZKY"]: r for r in wide.collect()}
    assert "STAT_VYP_PTR_LEG" not in wide.columns and "VYP_PTR_LEG" not in wide.columns
    a, b, c = rows[1], rows[2], rows[None]
    assert (a["TITUL_KEY"], a["TITUL_DRUH_DOKUMENTU"], a["TITUL_ROK_VYDANI"], a["ACTION_TYPE"]) == (10, "book", 1999, "loan")
    assert (a["DATE"], a["WEEKDAY"], a["VEK_BUCKET"], a["POHLAVI"], a["PSC_PREFIX"]) == (dt.date(2024, 1, 7), 0, "25-34", None, "110")
    assert (b["TITUL_KEY"], b["TITUL_KEY_STR"], b["VYP_TIME"], b["ACTION_TYPE"], b["desk_subjects"]) == (20, "20", None, "8", "d")
    assert (c["ACTION_GROUP"], c["ACTION_TYPE"], c["IS_LOAN"], c["och_subjects"]) == ("other", None, False, "")
    private = enrich_operations(ops, copies, titles, types, places, readers=readers, keep_exact_age=False)
    assert "VEK" not in private.columns and "VEK_BUCKET" in private.columns


def test_title_assembly_keeps_unmatched(spark):
    sig = spark.createDataFrame([(1, "a"), (2, "b")], "TITUL_KEY bigint, TITUL_SIGN_FULL string")
    name = spark.createDataFrame([(1, "n"), (1, "n2")], "TITUL_KEY bigint, TITUL_NAZEV string")
    head = spark.createDataFrame([(2, "h")], "TITUL_KEY bigint, TITUL_ZAHLAVI string")
    meta = spark.createDataFrame([(2, "x", "l", "d")], "TITUL_KEY bigint, TITUL_ROK_VYDANI string, TITUL_JAZYK string, TITUL_DRUH_DOKUMENTU string")
    rows = sorted(map(tuple, assemble_titles(sig, name, head, meta).collect()), key=repr)
    assert rows == [(1, "a", "n", None, None, None, None), (1, "a", "n2", None, None, None, None), (2, "b", None, "h", None, "l", "d")]


def test_validation_counts_repeated_copies_like_a_join(spark):
    fact = spark.createDataFrame(
        [(1, 10, dt.date(2024, 1, 1)), (1, 10, dt.date(2024, 1, 3)), (2, 20, None), (None, None, None), (9, 10, None)],
        "SVAZKY_KEY bigint, TITUL_KEY bigint, DATE date",
    )
    copies = spark.createDataFrame([(1, 10), (1, 10), (2, None), (3, 10)], "SVAZKY_KEY bigint, SVAZKY_PTR_TITUL bigint")
    titles = spark.createDataFrame([(10,), (10,), (None,)], "TITUL_KEY bigint")
    row = validate_build(fact, copies, titles).first()
    joined = fact.join(copies, "SVAZKY_KEY", "left")
    assert row["rows_with_svazky_ptr_titul"] == joined.filter("SVAZKY_PTR_TITUL IS NOT NULL").count() == 4
    assert row["pct_rows_with_titul_via_svazky"] == pytest.approx(100 * 4 / joined.count())
    assert (row["fact_rows"], row["fact_rows_missing_titul"], row["fact_rows_missing_svazek"]) == (5, 1, 1)
    assert (row["min_date"], row["max_date"], row["fact_unique_tituly"]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3), 2)
    assert (row["min_svazku"], row["median_svazku"], row["max_svazku"]) == (1, 1.5, 2)
    assert (row["dim_tituly_rows"], row["dim_tituly_unique"]) == (3, 1)
    empty = validate_build(fact.filter("FALSE"), copies, titles).first()
    assert empty["fact_rows"] == 0 and empty["pct_rows_with_titul_via_svazky"] is None


def test_hot_copy_is_split_over_tasks(spark):
    """A third of the operations on one copy: adaptive execution splits the partition of that copy."""
    _, _, titles, types, places, _ = star(spark)
    n = 30000
    ops = spark.range(n).repartition(8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("STAT_VYP_PTR_SVAZKY"),
        F.lit("2024-01-01 00:00:00").alias("STAT_VYP_TIME"),
        F.lit(4).alias("STAT_VYP_OPID"),
        F.lit(1).alias("STAT_VYP_PTR_KNODDEL"),
    )
    copies = spark.range(n).select(F.col("id").alias("SVAZKY_KEY"), F.lit(10).alias("SVAZKY_PTR_TITUL"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        wide = enrich_operations(ops, copies, titles, types, places)
        rows = wide.collect()
        plan = wide._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == n and {r["TITUL_KEY"] for r in rows} == {10}
    assert "skew=true" in plan


def test_validation_groups_copies_once(spark, monkeypatch):
    """The join coverage of repeated, unknown and missing copies, dealt to several tasks, without joining them."""
    from shelfwise.operators import quality

    monkeypatch.setattr(quality, "COPIES_AT_ONCE", 7)
    fact = spark.range(300).selectExpr("CASE WHEN id % 11 = 0 THEN NULL ELSE id % 40 END AS SVAZKY_KEY", "id % 5 AS TITUL_KEY", "date'2024-01-01' AS DATE")
    copies = spark.range(60).selectExpr("CASE WHEN id = 50 THEN NULL ELSE id % 25 END AS SVAZKY_KEY", "nullif(id % 3, 0) AS SVAZKY_PTR_TITUL")
    titles = spark.range(5).selectExpr("id AS TITUL_KEY")
    build = validate_build(fact, copies, titles)
    row = build.first()
    joined = fact.join(copies, "SVAZKY_KEY", "left")
    met, linked = joined.count(), joined.where("SVAZKY_PTR_TITUL IS NOT NULL").count()
    assert row["rows_with_svazky_ptr_titul"] == linked
    assert row["pct_rows_with_titul_via_svazky"] == pytest.approx(100.0 * linked / met)
    assert "SortMergeJoin" not in build._jdf.queryExecution().executedPlan().toString()
