import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import calendar, keys, labels, operations, readers, rules, scores, text
from shelfwise.schema import check_columns, ensure_columns, is_title_level, pick_column, rename_legacy, safe_long


def test_signature_prefix(evaluate):
    values = ["JD 30652", " jd 1", "821 A", "Č 12", "", "x", "A1B", None, "  ", "\tJD 1"]
    expected = ["JD", "JD", "82", "Č", "", "X", "A", None, "", "\tJ"]
    assert evaluate(values, "string", keys.signature_prefix) == expected
    frame = ["JD", "JD", "82", "Č", "", "X", "A", "", "", "JD"]
    assert evaluate(values, "string", keys.signature_prefix_frame) == frame


def test_title_key_and_ambiguity(spark):
    rows = [("a", "b"), ("a||b", "c"), ("a", "b||c"), ("a|", "b"), ("a", "|b"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(rows, "s string, n string")
    s, n = F.col("s"), F.col("n")
    out = df.select(
        keys.title_key(s, n).alias("k"),
        keys.title_key(s, n, null_as_empty=True).alias("e"),
        keys.is_ambiguous_key(s, n).alias("a"),
    ).collect()
    assert [r["k"] for r in out] == ["a||b", "a||b||c", "a||b||c", "a|||b", "a|||b", None, None]
    assert [r["e"] for r in out][-2:] == ["||x", "x||"]
    assert [r["a"] for r in out] == [False, True, True, True, True, False, False]


def test_age_groups(evaluate):
    ages = [None, -1, 0, 5, 6, 12, 13, 17, 18, 24, 25, 44, 45, 84, 85, 120]
    groups = [None, None, "0-5", "0-5", "6-12", "6-12", "13-17", "13-17", "18-24", "18-24", "25-34", "35-44", "45-54"]
    assert evaluate(ages, "bigint", readers.age_group) == groups + ["75-84", "85+", "85+"]


def test_sex_and_postcode(evaluate):
    assert evaluate([None, "", " ", "0", "1", "5", " 6 ", "M"], "string", readers.sex_code) == (
        [None, None, None, None, None, "5", "6", "M"]
    )
    codes = [None, "$NIC$", "", "110 00", "1 2", "1a1b0", "12345", "ab123", "12"]
    assert evaluate(codes, "string", readers.postcode_prefix) == (
        [None, None, None, "110", None, "11b", "123", "b12", None]
    )
    digits = evaluate(codes, "string", lambda c: readers.postcode_prefix(c, digits_only=True))
    assert digits == [None, None, None, "110", None, "110", "123", "123", None]


def test_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2021-01-03 10:00:00' AS t")
    row = df.select(*[c.alias(n) for n, c in calendar.calendar_columns(F.col("t")).items()]).first()
    assert row.asDict() == {
        "DATE": dt.date(2021, 1, 3), "YEAR": 2021, "MONTH": 1, "YEAR_MONTH": 202101, "WEEK": 53, "WEEKDAY": 0,
    }


def test_times_from_text(spark):
    df = spark.createDataFrame([("2025-12-01 07:18:24",), ("2025-12-01",), ("nonsense",), (None,)], "t string")
    parsed = [r[0] for r in df.select(calendar.parse_time(df, "t")).collect()]
    assert parsed == [dt.datetime(2025, 12, 1, 7, 18, 24), dt.datetime(2025, 12, 1), None, None]
    day_first = spark.createDataFrame([("3.2.2024",), ("2024-02-03",), ("31/12/2023",), ("x",)], "t string")
    parsed = [r[0] for r in day_first.select(calendar.parse_day_first(F.col("t"))).collect()]
    assert parsed == [dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3), dt.datetime(2023, 12, 31), None]


def test_operation_flags(evaluate):
    codes = [4, 94, 97, 225, 5, 95, 98, 226, 7, None]
    groups = evaluate(codes, "bigint", lambda c: operations.operation_flags(c)["ACTION_GROUP"])
    assert groups == ["loan"] * 4 + ["return"] * 4 + ["other"] * 2
    loans = evaluate(codes, "bigint", lambda c: operations.operation_flags(c)["IS_LOAN"])
    assert loans == [True] * 4 + [False] * 6


def test_action_type_falls_back_to_the_code(spark):
    df = spark.createDataFrame([("loan", 4), (" ", 5), (None, 6)], "p string, o bigint")
    assert [r[0] for r in df.select(operations.action_type(F.col("p"), F.col("o"))).collect()] == ["loan", "5", "6"]


def test_scores(spark):
    df = spark.createDataFrame([(0, 0, 10.0, None), (2, 4, 30.0, 3.1), (9, 3, 31.0, 1.0)], "l long, c long, p double, y double")
    out = df.select(
        scores.loans_per_copy(F.col("l"), F.col("c")).alias("use"),
        scores.risk_score(F.col("l"), F.col("p"), F.col("y")).alias("risk"),
        scores.write_off_score(F.col("c"), F.lit(0.0)).alias("w"),
        scores.buy_score(F.col("c"), F.lit(1.0)).alias("b"),
    ).collect()
    assert [r["use"] for r in out] == [0.0, 0.5, 3.0]
    assert [r["risk"] for r in out] == [95, 45, 0]
    assert [r["w"] for r in out] == [0.0, 3 / 1e-9, 2 / 1e-9]
    assert [r["b"] for r in out] == [(1 + 1e-9), (1 + 1e-9) / 4, (1 + 1e-9) / 3]


def test_parse_rules():
    assert rules.parse_rules('{"A": ["x", 1], "B": "no list", "C": []}') == {"A": ["x", "1"], "C": []}
    assert rules.parse_rules("not json") is rules.DEFAULT_RULES
    assert rules.parse_rules("[1]") is rules.DEFAULT_RULES


def test_search_is_a_regular_expression_unless_literal(evaluate):
    values = ["Praha", "a.b", "axb", None]
    assert evaluate(values, "string", lambda c: text.contains(c, "A.B")) == [False, True, True, False]
    assert evaluate(values, "string", lambda c: text.contains(c, "A.B", literal=True)) == [False, True, False, False]


def test_opid_labels(spark):
    df = spark.createDataFrame([(4, "loan out"), (5, None), (7, "nan"), (98, " ")], "o bigint, p string")
    out = [r[0] for r in df.select(labels.opid_label(F.col("o"), F.col("p"))).collect()]
    assert out == ["loan out (OPID 4)", "Abs. vrácení (OPID 5)", "OPID 7", "Prez. vrácení (OPID 98)"]


def test_labelled_keeps_unknown_columns(spark):
    df = spark.createDataFrame([("AUTO_KANDIDAT", 1, 2), ("x", 3, 4)], "klasifikace string, pocet_opid_5 int, other int")
    out = labels.labelled(df)
    assert out.columns == ["Počet operací (OPID 5)", "other", "Klasifikace"]
    assert [r["Klasifikace"] for r in out.collect()] == ["Automatický kandidát (nízký výskyt)", "x"]


def test_schema_decisions(spark):
    df = spark.createDataFrame([(1, "12.7")], "TITUL_NAZEV int, x string")
    check = check_columns(df)
    assert "DATE" in check.missing and check.present == ("TITUL_NAZEV",) and check.warnings
    assert pick_column(["a", "Txoch_Key"], ("OCH", "TXOCH_KEY")) == "Txoch_Key"
    assert pick_column(["a"], ("b",)) is None
    assert ensure_columns(df, {"y": "bigint", "x": "string"}).dtypes[-1] == ("y", "bigint")
    assert not is_title_level(df)
    assert rename_legacy(df.withColumnRenamed("x", "pocet_udalosti_okno")).columns[-1] == "pocet_operaci_v_obdobi"
    titles = spark.createDataFrame([], "title_key string, SIGN_PREFIX string, vypujcky_5_let long")
    assert is_title_level(titles)


@pytest.mark.parametrize(
    ("ddl", "value", "expected"),
    [("string", "12.7", 13), ("string", "12", 12), ("string", "x", None), ("double", 12.7, 13), ("int", 5, 5)],
)
def test_safe_long(spark, ddl, value, expected):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    assert df.select(safe_long(df, "v")).first()[0] == expected


def test_day_first_times_know_no_zone(spark):
    texts = ["31.3.2024 2:30:00", "31.3.2024 2:30", "31/3/2024 2:30:00", "2024-03-31 02:30:00", "27.10.2024 2:30", "31-3-2024", "31.2.2024", "1.1.24", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    night, autumn = dt.datetime(2024, 3, 31, 2, 30), dt.datetime(2024, 10, 27, 2, 30)
    want = [night] * 4 + [autumn, dt.datetime(2024, 3, 31), None, None, None]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Prague"):  # 2:30 of the first day does not exist there, that of the second occurs twice
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(calendar.parse_day_first(F.col("t"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
