"""Summary of operations, counts in long form, and the plans that depend on them."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.test_metrics import END, SCHEMA, make_rows

from shelfwise.operators import discovery, facts, metrics
from shelfwise.operators.enrich import enrich_operations
from shelfwise.operators.events import normalise_events
from shelfwise.operators.windowing import ALL_OR_NOTHING, UsagePolicy, window_bounds


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(make_rows(seed=5), SCHEMA).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_summary_answers_for_the_table(events):
    summary = facts.summarise(events)
    assert summary.count() == 5 and summary.agg(F.sum("rows")).first()[0] == events.count()
    for ask in (discovery.action_types, discovery.suggested_loan_actions, discovery.distinct_opids):
        assert rows(ask(summary)) == rows(ask(events))
    described = events.withColumn("OPIDY_POPIS", F.concat(F.lit(" d"), F.col("VYP_OPID") % 3, F.col("TITUL_KEY") % 2))
    assert rows(discovery.opid_legend(facts.summarise(described))) == rows(discovery.opid_legend(described))
    for policy in (UsagePolicy(years=3), UsagePolicy(date_policy=ALL_OR_NOTHING)):
        bounds = [window_bounds(normalise_events(t), policy).first()[0] for t in (summary, events)]
        assert bounds[0] == bounds[1]


def test_summaries_merge(spark, events, tmp_path):
    whole = rows(facts.summarise(events))
    halves = events.randomSplit([0.5, 0.5], seed=1)
    merged = facts.merge(*[facts.summarise(h) for h in halves], facts.summarise(events.limit(0)))
    assert rows(merged) == whole
    path = str(tmp_path / "summary")
    facts.write_summary(events, path, by="YEAR")
    assert rows(facts.read_summary(spark, path)) == whole
    # one year's rows are written anew: only its part changes
    more = events.unionByName(events.where("YEAR = 2023").withColumn("ACTION_TYPE", F.lit("new")))
    facts.write_summary(more, path, by="YEAR", only=[2023])
    assert rows(facts.read_summary(spark, path)) == rows(facts.summarise(more))


def test_summary_of_a_table_without_kinds(spark):
    df = spark.createDataFrame([("2024-01-02", "x"), ("bad", None)], "DATE string, TITUL_NAZEV string")
    assert [tuple(r) for r in facts.summarise(df).collect()] == [(dt.datetime(2024, 1, 2), 2)]
    assert facts.merge(facts.summarise(df)).first()["rows"] == 2


def test_long_counts_are_the_columns(events):
    policy = UsagePolicy(years=3)
    wide = metrics.title_metrics(events, policy=policy, opids=[4, 5, 7, 97])
    counts = Counter()
    for r in wide.select("title_key", *[f"pocet_opid_{k}" for k in (4, 5, 7, 97)]).distinct().collect():
        for k in (4, 5, 7, 97):
            if r["title_key"] is not None and r[f"pocet_opid_{k}"]:
                counts[r["title_key"], k] = r[f"pocet_opid_{k}"]
    long = metrics.opid_counts(events, policy=policy)
    assert {(r["title_key"], r["opid"]): r["n"] for r in long.collect()} == counts and long.count() == len(counts)
    back = metrics.with_opid_counts(wide, long, [4, 97]).orderBy("title_key", "TITUL_KEY")
    assert rows(back.select("title_key", "pocet_opid_4", "pocet_opid_97")) == rows(wide.select("title_key", "pocet_opid_4", "pocet_opid_97"))


def test_hundred_thousand_codes(spark):
    n = 100_000
    events = spark.range(n).select(
        F.lit(1).alias("TITUL_KEY"), F.lit("JD 1").alias("TITUL_SIGN_FULL"), F.concat(F.lit("t"), F.col("id") % 3).alias("TITUL_NAZEV"),
        F.lit(END).alias("DATE"), F.col("id").alias("VYP_OPID"),
    )
    long = metrics.opid_counts(events)
    assert long.count() == n and long.agg(F.sum("n"), F.countDistinct("opid")).first()[:] == (n, n)
    with pytest.raises(ValueError, match="long form"):
        metrics.title_metrics(events)
    named = metrics.with_opid_counts(metrics.title_metrics(events, opids=[]), long, [7, n + 1])
    assert rows(named.select("title_key", "pocet_opid_7", f"pocet_opid_{n + 1}")) == [("JD 1||t0", 0, 0), ("JD 1||t1", 1, 0), ("JD 1||t2", 0, 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_the_cube_carries_no_text(spark, events, tmp_path):
    events.withColumn("desk_subjects", F.lit("a long text")).write.parquet(f"{tmp_path}/operations")
    fact = spark.read.parquet(f"{tmp_path}/operations")
    policy = UsagePolicy(years=3, loan_actions=("loan out",))
    summary = facts.summary_of(fact, None)
    bounds = window_bounds(normalise_events(summary), policy)
    usage = metrics.WideUsage(normalise_events(fact), bounds, policy, set(fact.columns))
    text = plan(usage.cube)
    keys = re.search(r"Exchange hashpartitioning\(([^)]*)\)", text).group(1)
    assert {k.split("#")[0].strip() for k in keys.split(",")[:6]} == {*metrics.ID, "vyp_opid", "loan", "is_loan_flag", "is_return_flag"}
    assert "SortAggregate" not in text
    # the operations are scanned once before the cube is there; the ends of the window come from the written summary
    assert scans(usage.cube) == 1 and all("/operations" in f for f in usage.cube.inputFiles())
    assert all("/summary-" in f for f in bounds.inputFiles())
    assert scans(usage.measures([4])) == 2  # the cube and the dictionary


def test_equal_hashes_are_noticed(events, monkeypatch):
    real = metrics.F.xxhash64
    monkeypatch.setattr(metrics.F, "xxhash64", lambda *parts: F.lit(7).cast("bigint"))
    with pytest.raises(RuntimeError, match="128-bit"):
        metrics.title_metrics(events, opids=[])
    monkeypatch.setattr(metrics.F, "xxhash64", real)
    assert metrics.title_metrics(events, opids=[]).count() > 0


def test_readers_are_joined_before_texts(spark):
    rng = random.Random(2)
    big = 200  # beyond any broadcast in this session
    ops = spark.createDataFrame([(i % big, f"2024-01-{1 + i % 28:02d}", 4, 1, rng.randrange(big)) for i in range(500)],
        "STAT_VYP_PTR_SVAZKY long, STAT_VYP_TIME string, STAT_VYP_OPID long, STAT_VYP_PTR_KNODDEL long, STAT_VYP_PTR_LEG long")
    copies = spark.createDataFrame([(i, i) for i in range(big)], "SVAZKY_KEY long, SVAZKY_PTR_TITUL long")
    titles = spark.createDataFrame([(i, f"s{i}", "h", f"n{i}", 2000, "cze", "a") for i in range(big)],
        "TITUL_KEY long, TITUL_SIGN_FULL string, TITUL_ZAHLAVI string, TITUL_NAZEV string, TITUL_ROK_VYDANI long, TITUL_JAZYK string, TITUL_DRUH_DOKUMENTU string")
    readers = spark.createDataFrame([(i, 30, "5", "110 00") for i in range(big)], "LEG_KEY long, VEK long, POHLAVI string, ADRESY_PSC string")
    types = spark.createDataFrame([(4, "loan")], "OPIDY_OPID long, OPIDY_POPIS string")
    places = spark.createDataFrame([(1, "n", "u", "p")], "KNODDEL_KEY long, KNODDEL_NAZEV string, KNODDEL_ULICE string, KNODDEL_PSC string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(enrich_operations(ops, copies, titles, types, places, readers=readers))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"(SortMergeJoin \[[^\]]*\]|BroadcastHashJoin \[[^\]]*\])", text)
    order = [re.search(r"\[(\w+)#", j).group(1) for j in joins]  # from the top of the plan down
    assert order.index("VYP_OPID") < order.index("VYP_PTR_SVAZKY") < order.index("_reader")
    # the operations' own row when they are dealt out for the copy join: numbers and the reader's groups
    dealt = next(line for line in text.splitlines() if "Exchange hashpartitioning(VYP_PTR_SVAZKY" in line)
    assert dealt
