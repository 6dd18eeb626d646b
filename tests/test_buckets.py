"""Dimensions in buckets: equal rows, no shuffle of the dimensions, hot keys and missing keys apart."""

import random
import re

import pytest

from shelfwise.operators import enrich
from shelfwise.operators.enrich import enrich_from_dimensions, enrich_operations
from shelfwise.operators.joins import hot_keys, join_laid_out
from shelfwise.plans.catalog import save_dimensions


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    keys = [None, 0, 0, 0, *range(40), 999]  # copy 0 is hot, copy 999 unknown
    ops = [(rng.choice(keys), f"2024-0{1 + i % 9}-11", rng.choice([4, 5, 8]), 1, rng.choice([None, 3, 3, 3, *range(20)])) for i in range(600)]
    out = {
        "operations": spark.createDataFrame(
            ops, "STAT_VYP_PTR_SVAZKY long, STAT_VYP_TIME string, STAT_VYP_OPID long, STAT_VYP_PTR_KNODDEL long, STAT_VYP_PTR_LEG long"
        ),
        "copies": spark.createDataFrame([(i, i % 7) for i in range(40)] + [(5, 1)], "SVAZKY_KEY long, SVAZKY_PTR_TITUL long"),  # copy 5 twice
        "titles": spark.createDataFrame(
            [(i, f"JD {i}", "h", f"n{i}", 2000, "cze", "a") for i in range(6)],
            "TITUL_KEY long, TITUL_SIGN_FULL string, TITUL_ZAHLAVI string, TITUL_NAZEV string, TITUL_ROK_VYDANI long, TITUL_JAZYK string, "
            "TITUL_DRUH_DOKUMENTU string",
        ),
        "op_types": spark.createDataFrame([(4, "loan"), (5, "return")], "OPIDY_OPID long, OPIDY_POPIS string"),
        "branches": spark.createDataFrame([(1, "n", "u", "p")], "KNODDEL_KEY long, KNODDEL_NAZEV string, KNODDEL_ULICE string, KNODDEL_PSC string"),
        "readers": spark.createDataFrame([(i, i, "5", "110 00") for i in range(18)], "LEG_KEY long, VEK long, POHLAVI string, ADRESY_PSC string"),
    }
    return {k: v.repartition(3) for k, v in out.items()}


@pytest.fixture(scope="module")
def dims(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dims"))
    return save_dimensions(spark, tables["copies"], tables["titles"], readers=tables["readers"], path=path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("least_rows", [1, 40, 10**9])
def test_equal_to_the_plain_join(tables, dims, least_rows):
    t = tables
    want = enrich_operations(t["operations"], t["copies"], t["titles"], t["op_types"], t["branches"], readers=t["readers"])
    got = enrich_from_dimensions(
        t["operations"], dims["dim_svazky_popis"], t["op_types"], t["branches"], demographics=dims["dim_ctenari"], least_rows=least_rows, most=20
    )
    assert got.columns == want.columns and rows(got) == rows(want)


def test_hot_keys_are_few(spark):
    df = spark.createDataFrame([(i % 10 if i < 50 else 77,) for i in range(100)] + [(None,)] * 200, "k long")
    assert [r["k"] for r in hot_keys(df, "k", most=20, least_rows=2).collect()] == [77]
    assert hot_keys(df, "k", most=1000, least_rows=2).count() == 11 and hot_keys(df, "k", least_rows=60).count() == 0


def test_dimensions_are_not_shuffled(spark, tables, dims):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = tables["operations"].selectExpr("STAT_VYP_PTR_SVAZKY AS SVAZKY_KEY", "STAT_VYP_OPID")
        text = join_laid_out(big, dims["dim_svazky_popis"], "SVAZKY_KEY", least_rows=10**9)._jdf.queryExecution().executedPlan().toString()
        plain = big.join(dims["dim_svazky_popis"].repartition(3), "SVAZKY_KEY", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1  # the operations
    assert len(re.findall(r"Exchange hashpartitioning", plain)) == 2


def test_titles_in_buckets_of_their_own(spark, tables, tmp_path):
    t = tables
    subjects = spark.createDataFrame(
        [(0, "d0", "o0"), (0, "d1", "o1"), (6, "only", "subjects"), (None, "x", "y")], "TITUL_KEY long, desk_subjects string, och_subjects string"
    )
    titles = t["titles"].unionByName(t["titles"].where("TITUL_KEY = 2"))  # title 2 twice, title 6 has subjects only
    whole = save_dimensions(spark, t["copies"], titles, subjects=subjects, readers=t["readers"], path=str(tmp_path / "a"))
    apart = save_dimensions(spark, t["copies"], titles, subjects=subjects, readers=t["readers"], path=str(tmp_path / "b"), copy_texts=False)
    rest = (t["op_types"], t["branches"])
    want = rows(enrich_from_dimensions(t["operations"], whole["dim_svazky_popis"], *rest, demographics=whole["dim_ctenari"], least_rows=40, most=20))
    got = enrich_from_dimensions(
        t["operations"], apart["dim_svazky_klice"], *rest, demographics=apart["dim_ctenari"], described_titles=apart["dim_tituly_predmety"],
        least_rows=40, most=20,
    )
    assert apart["dim_svazky_klice"].columns == ["SVAZKY_KEY", "SVAZKY_PTR_TITUL"]
    assert rows(got) == want
    plain = enrich_operations(t["operations"], t["copies"], titles, *rest, subjects=subjects, readers=t["readers"])
    assert rows(plain) == want


def joins(df):
    return re.findall(r"Join [^\n]*?(_reader|VYP_PTR_SVAZKY|SVAZKY_PTR_TITUL)#", df._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("laid_out", [False, True])
def test_large_operations_need_the_disks_for_one_join_at_a_time(spark, tables, tmp_path, monkeypatch, laid_out):
    t = dict(tables)
    for name in ("operations", "copies"):
        t[name].write.parquet(str(tmp_path / name))
        t[name] = spark.read.parquet(str(tmp_path / name))
    t["copies"] = t["copies"].unionByName(t["copies"].where("SVAZKY_KEY = 0")).repartition(2)  # rows that a shuffle makes, the hot copy twice
    monkeypatch.setattr("shelfwise.staging.stage_root", lambda _: str(tmp_path / "stages"))
    rest = (t["op_types"], t["branches"])

    def enriched():
        if not laid_out:
            return enrich_operations(t["operations"], t["copies"], t["titles"], *rest, readers=t["readers"])
        dims = save_dimensions(spark, t["copies"], t["titles"], readers=t["readers"], path=str(tmp_path / f"dims{enrich.STAGED_BYTES}"), copy_texts=False)
        return enrich_from_dimensions(
            t["operations"], dims["dim_svazky_klice"], *rest, demographics=dims["dim_ctenari"], described_titles=dims["dim_tituly_predmety"],
            least_rows=40, most=20,
        )

    want = enriched()
    assert {"_reader", "VYP_PTR_SVAZKY", "SVAZKY_PTR_TITUL"} <= set(joins(want))
    expected = rows(want)
    monkeypatch.setattr(enrich, "STAGED_BYTES", 1)
    got = enriched()
    assert got.columns == want.columns and set(joins(got)) == {"SVAZKY_PTR_TITUL"}  # the others are done
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("stages/shelfwise-stages/*/*")}
    assert len(list(tmp_path.glob("stages/shelfwise-stages/*/operations-*"))) == 1 and "copies" not in left
    assert rows(got) == expected
