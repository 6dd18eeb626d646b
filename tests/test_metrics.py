"""Metrics against a row-by-row statement of the rules in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import metrics, ranking
from shelfwise.operators.classify import classify
from shelfwise.operators.windowing import UsagePolicy, filter_window
from shelfwise.functions.rules import ClassLimits

SCHEMA = (
    "TITUL_KEY bigint, TITUL_SIGN_FULL string, TITUL_NAZEV string, TITUL_DRUH_DOKUMENTU string, TITUL_JAZYK string, "
    "TITUL_ROK_VYDANI bigint, DATE date, YEAR int, ACTION_TYPE string, ACTION_GROUP string, IS_LOAN boolean, "
    "IS_RETURN boolean, VYP_OPID bigint, SVAZKY_KEY bigint"
)
END = dt.date(2024, 2, 29)


def make_rows(seed=1, n=600):
    """Random operations with the awkward cases: missing key parts, keys spelled in two ways, undated rows, a hot title."""
    rnd = random.Random(seed)
    titles = [
        (1, "JD 1", "hot"), (2, "JD 2", "plain"), (3, "jd 3", "lower"), (4, "821 A", "digits"), (5, None, "no mark"),
        (6, "JD 6", None), (7, "AB", "x||y"), (8, "AB||x", "y"), (9, "", "empty mark"), (10, " Č 1", "accent"),
        (None, "ZZ 1", "no key"), (12, "JD 2", "plain"), (13, "OLD 1", "only old"),
    ]
    kinds = [(4, "Loan Out ", "loan", True, False), (5, "return", "return", False, True), (7, "7", "other", False, False),
             (97, None, "loan", True, False), (None, "odd", None, None, None)]
    rows = []
    for i in range(n):
        key, sign, name = titles[0] if rnd.random() < 0.34 else rnd.choice(titles)
        opid, action, group, loan, ret = rnd.choice(kinds)
        if key == 13:
            date, year = dt.date(2010, 1, 1), 2010
        elif rnd.random() < 0.1:
            date, year = None, rnd.choice([None, 2020, 2021, 2022, 2023, 2024, 2025])
        else:
            date = END - dt.timedelta(days=rnd.choice([0, 1, 365, 730, 731, 732, 900, rnd.randrange(1500)]))
            year = date.year
        copy = rnd.choice([None, *range(5)])
        rows.append((key, sign, name, f"t{rnd.randrange(2)}", "cze", 2000, date, year, action, group, loan, ret, opid,
                     None if copy is None else (key or 0) * 10 + copy))
    rows.append((2, "JD 2", "plain", "t0", "cze", 2000, END, 2024, "Loan Out ", "loan", True, False, 4, 20))
    rows.append((2, "JD 2", "plain", "t0", "cze", 2000, dt.date(2022, 2, 28), 2022, "Loan Out ", "loan", True, False, 4, 20))
    rows.append((2, "JD 2", "plain", "t0", "cze", 2000, dt.date(2022, 2, 27), 2022, "Loan Out ", "loan", True, False, 4, 20))
    return rows


def expected_metrics(rows, years, actions):
    start = dt.date(END.year - years, 2, 28)
    by_pair, by_key, copies = {}, {}, {}
    for (tk, sign, name, _, _, _, date, year, action, group, loan, ret, opid, copy) in rows:
        pair = by_pair.setdefault((sign, name), {"TITUL_KEY": set()})
        pair["TITUL_KEY"].add(tk)
        if tk is not None and copy is not None:
            copies.setdefault(tk, set()).add(copy)
        inside = start <= date <= END if date else year is not None and start.year <= year <= END.year
        if sign is None or name is None or not inside:
            continue
        use = by_key.setdefault(f"{sign}||{name}", {"loans": 0, "ops": 0, "is_loan": 0, "ret": 0, "op4": 0, "last": None})
        use["ops"] += 1
        use["is_loan"] += bool(loan)
        use["ret"] += bool(ret)
        use["op4"] += opid == 4
        is_loan = (action or "").strip().lower() in actions if actions else bool(loan) or group == "loan"
        if is_loan:
            use["loans"] += 1
            use["last"] = max(filter(None, [use["last"], date]), default=None)
    out = {}
    for (sign, name), pair in by_pair.items():
        key = None if sign is None or name is None else f"{sign}||{name}"
        use = by_key.get(key, {"loans": 0, "ops": 0, "is_loan": 0, "ret": 0, "op4": 0, "last": None})
        title = min((k for k in pair["TITUL_KEY"] if k is not None), default=None)
        held = len(copies.get(title, ()))
        since = round((END - use["last"]).days / 365.25, 2) if use["last"] else None
        out[(sign, name)] = dict(use, copies=held, per=use["loans"] / held if held else 0.0, since=since)
    return out


@pytest.mark.parametrize("actions", [(), ("loan out",)])
def test_title_metrics_by_brute_force(spark, actions):
    rows = make_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    policy = UsagePolicy(years=2, loan_actions=actions)
    got = metrics.title_metrics(df, policy=policy).collect()
    want = expected_metrics(rows, 2, actions)
    assert len(got) == len(want)
    for r in got:
        w = want[(r["TITUL_SIGN_FULL"], r["TITUL_NAZEV"])]
        assert (
            r["vypujcky_5_let"], r["pocet_operaci_v_obdobi"], r["pocet_vypujcek_is_loan"], r["pocet_vraceni_is_return"],
            r["pocet_opid_4"], r["pocet_svazku"], r["vykon_na_svazek"], r["roky_od_posledni_vypujcky"],
        ) == (w["loans"], w["ops"], w["is_loan"], w["ret"], w["op4"], w["copies"], w["per"], w["since"])
        same = [x["vypujcky_5_let"] for x in got if x["SIGN_PREFIX"] == r["SIGN_PREFIX"]]
        assert r["pocet_v_signature"] == len(same)
        assert r["rank_v_signature"] == 1 + sum(x > r["vypujcky_5_let"] for x in same)
    assert {r["TITUL_SIGN_FULL"]: r["vypujcky_5_let"] for r in got if r["title_key"] == "AB||x||y"}.keys() == {"AB", "AB||x"}


def test_keys_spelled_in_two_ways_share_their_counts(spark):
    rows = make_rows(seed=3)
    got = metrics.title_metrics(spark.createDataFrame(rows, SCHEMA), policy=UsagePolicy(years=3), opids=[])
    shared = got.filter("title_key = 'AB||x||y'").select("pocet_operaci_v_obdobi", "vypujcky_5_let").collect()
    assert len(shared) == 2 and shared[0] == shared[1] and shared[0][0] > 0


def test_one_prefix_equals_filtered_whole(spark):
    df = spark.createDataFrame(make_rows(seed=5), SCHEMA)
    policy = UsagePolicy(years=2)
    whole = metrics.title_metrics(df, policy=policy).filter("SIGN_PREFIX = 'AB'")
    part = metrics.title_metrics(df, policy=policy, sign_prefix=" ab ")
    assert sorted(map(repr, part.collect())) == sorted(map(repr, whole.collect()))
    assert metrics.title_metrics(df, policy=policy, sign_prefix="(vsechny)").count() == metrics.title_metrics(df).count()


def test_copies_table_wins_over_operations(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    copies = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 2), (4, None)], "SVAZKY_KEY bigint, SVAZKY_PTR_TITUL bigint")
    got = {r["TITUL_KEY"]: r["pocet_svazku"] for r in metrics.title_metrics(df, copies=copies).collect()}
    assert got[1] == 2 and got[2] == 1 and got[3] == 0


def test_star_repeats_rows_for_repeated_dimension_keys(spark):
    ops = spark.createDataFrame(
        [(1, "2024-01-05 10:00:00", 4), (1, "2024-01-06 10:00:00", 5), (9, "2024-01-07 00:00:00", 4)],
        "STAT_VYP_PTR_SVAZKY bigint, STAT_VYP_TIME string, STAT_VYP_OPID bigint",
    )
    copies = spark.createDataFrame([(1, 100), (1, 100)], "SVAZKY_KEY bigint, SVAZKY_PTR_TITUL bigint")
    titles = spark.createDataFrame(
        [(100, "JD 1", "book", "h", 2000, "cze", "a")],
        "TITUL_KEY bigint, TITUL_SIGN_FULL string, TITUL_NAZEV string, TITUL_ZAHLAVI string, TITUL_ROK_VYDANI bigint, "
        "TITUL_JAZYK string, TITUL_DRUH_DOKUMENTU string",
    )
    types = spark.createDataFrame([(4, "loan"), (4, "again")], "OPIDY_OPID bigint, OPIDY_POPIS string")
    got = metrics.title_metrics_from_star(ops, copies, titles, types, policy=UsagePolicy(years=1)).collect()
    by_key = {r["title_key"]: r for r in got}
    # the loan is repeated by two copies and two types, the return by two copies
    assert by_key["JD 1||book"]["vypujcky_5_let"] == 4
    assert by_key["JD 1||book"]["pocet_operaci_v_obdobi"] == 6
    assert by_key["JD 1||book"]["pocet_svazku"] == 1
    assert by_key[None]["vypujcky_5_let"] == 0 and by_key[None]["TITUL_SIGN_FULL"] is None


def test_frame_variant(spark):
    rows = make_rows(seed=7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["title_key"]: r for r in metrics.title_metrics_frame(df, policy=UsagePolicy(years=2)).collect()}
    start = dt.date(2022, 2, 28)
    want = {}
    for r in rows:
        key = f"{(r[1] or '').strip()}||{(r[2] or '').strip()}"
        w = want.setdefault(key, [0, 0])
        if r[6] and start <= r[6] <= END:  # undated rows are out as soon as any row has a date
            w[0] += bool(r[10])
            w[1] += 1
    assert {k: [r["vypujcky_5_let"], r["pocet_operaci_v_obdobi"]] for k, r in got.items()} == want
    assert got["||no mark"]["SIGN_PREFIX"] == "" and got["AB||x||y"]["pocet_operaci_v_obdobi"] > 0


def test_frame_without_dates_uses_years(spark):
    rows = [("JD 1", "a", y, True) for y in (2019, 2022, 2024, 2024)]
    df = spark.createDataFrame(rows, "TITUL_SIGN_FULL string, TITUL_NAZEV string, YEAR int, IS_LOAN boolean")
    policy = UsagePolicy(years=2, now=dt.datetime(2024, 6, 1))
    row = metrics.title_metrics_frame(df, policy=policy).first()
    assert (row["vypujcky_5_let"], row["pocet_svazku"], row["bez_svazku"]) == (3, 0, True)


def test_table_without_action_columns(spark):
    df = spark.createDataFrame(
        [("JD 1", "a", dt.date(2024, 1, 1)), ("JD 1", "a", dt.date(2023, 1, 2))],
        "TITUL_SIGN_FULL string, TITUL_NAZEV string, DATE date",
    )
    row = metrics.title_metrics(df, policy=UsagePolicy(years=1)).first()
    assert (row["vypujcky_5_let"], row["pocet_operaci_v_obdobi"], row["desk_subjects"]) == (0, 2, "")


def test_filter_window_keeps_columns(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    out = filter_window(df, UsagePolicy(years=2), loans_only=True)
    assert out.columns == df.columns
    assert out.filter("NOT (IS_LOAN <=> TRUE) AND NOT (ACTION_GROUP <=> 'loan')").count() == 0


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_rank_is_the_same_with_and_without_broadcast(spark, limit):
    rows = [("hot", i % 4, i) for i in range(300)] + [(None, i % 3, i) for i in range(40)] + [("b", i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, m bigint, id bigint").repartition(4)
    got = ranking.rank_within(df, group="g", measure="m", spread_by=["id"], max_broadcast_rows=limit)
    w = Window.partitionBy("g")
    want = df.select(
        "*",
        F.rank().over(w.orderBy(F.desc("m"))).cast("bigint").alias("rank_v_signature"),
        F.count("*").over(w).alias("pocet_v_signature"),
    )
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)


def title(loans, percentile, years, name="x", doc="a"):
    return (f"s||{name}", name, doc, loans, percentile, years)


TITLE_SCHEMA = (
    "title_key string, TITUL_NAZEV string, TITUL_DRUH_DOKUMENTU string, vypujcky_5_let bigint, "
    "percentil_v_signature double, roky_od_posledni_vypujcky double"
)


def test_classes_and_reasons(spark):
    cases = [
        (title(0, 0.0, 0.5), "AUTO_KANDIDAT", "nejvýše 3 výpůjček v okně analýzy (automatický kandidát)"),
        (title(0, 0.0, None), "RUCNI_POSOUZENI", "poslední výpůjčka starší než 1.0 roku"),
        (title(1, 30.0, 0.5), "RUCNI_POSOUZENI", "nízká výpůjčnost (1–2) a spodní 30 % ve signatuře"),
        (title(1, 30.0, 1.1), "RUCNI_POSOUZENI", "poslední výpůjčka starší než 1.0 roku"),
        (title(3, 0.0, 1.0), "AUTO_KANDIDAT", "nejvýše 3 výpůjček v okně analýzy (automatický kandidát)"),
        (title(4, 0.0, 1.0), "PONECHAT", "nedostatečný důvod pro změnu stavu (běžný výskyt / lepší pozice ve signatuře)"),
        (title(0, 0.0, None, "Stará Praha"), "CHRANENO_VYJIMKOU", "chráněno výjimkou: praha"),
        (title(9, 0.0, 0.0, "y", "Poezie"), "CHRANENO_VYJIMKOU", "chráněno výjimkou: poezie"),
        (title(9, 0.0, 0.0, "zvláštní"), "CHRANENO_VYJIMKOU", "chráněno výjimkou (shoda s pravidlem)"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], TITLE_SCHEMA)
    rules = {"TITUL_NAZEV": ["PRAHA", " zvl.štní "], "TITUL_DRUH_DOKUMENTU": ["poezie", ""], "missing": ["x"]}
    out = classify(df, rules=rules, limits=ClassLimits(1, 2, 30.0, 1.0, 3)).collect()
    assert [(r["klasifikace"], r["duvod_oznaceni"]) for r in out] == [c[1:] for c in cases]
    off = classify(df, rules=rules, exceptions_enabled=False).filter("vyjimka_flag OR klasifikace = 'CHRANENO_VYJIMKOU'")
    assert off.count() == 0
    literal = classify(df, rules={"TITUL_NAZEV": ["zvl.štní"]}, literal=True)
    assert literal.filter("vyjimka_flag").count() == 0


def test_zero_limit_never_gives_automatic_candidates(spark):
    df = spark.createDataFrame([title(0, 0.0, None), title(5, 90.0, 0.1)], TITLE_SCHEMA)
    assert {r["klasifikace"] for r in classify(df).collect()} == {"RUCNI_POSOUZENI", "PONECHAT"}


def test_joined_operations_are_made_once(spark):
    from shelfwise.operators import metrics

    ops = spark.range(50).selectExpr("id % 7 AS TITUL_KEY", "id AS SVAZKY_KEY", "id AS other", "date'2024-01-01' AS DATE", "2024 AS YEAR")
    names = spark.range(7).selectExpr("id AS TITUL_KEY", "concat('JD ', id) AS TITUL_SIGN_FULL", "'n' AS TITUL_NAZEV")
    joined = ops.join(names, "TITUL_KEY", "left")
    settled = metrics._settled(joined)
    assert "Join" not in settled._jdf.queryExecution().optimizedPlan().toString() and "other" not in settled.columns
    assert sorted(settled.collect()) == sorted(joined.drop("other").select(*settled.columns).collect())
    again = metrics._settled(settled.withColumn("IS_LOAN", F.lit(True)))
    assert again.inputFiles() == settled.inputFiles()  # a plain scan is left as it is
