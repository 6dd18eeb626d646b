import re
import time

import pytest
from pyspark.sql import functions as F

from shelfwise.operators.windowing import UsagePolicy
from shelfwise.plans import catalog, ingest, rebuild
from shelfwise.plans.review import load_titles, review
from shelfwise.staging import discard, drop_stages, new_stage_path, settle, stage, stage_buckets, stage_root
from workload.dump_writer import write_dump


def test_dump_files_of_a_table():
    names = ["svazky-1.txt", "vypujcky2024-02.txt", "vypujcky2024-01.txt", "vypujckyX.txt", "txoch2.txt", "opidy.txt"]
    assert ingest.dump_files(names, "vypujcky") == ["vypujcky2024-01.txt", "vypujcky2024-02.txt"]
    assert ingest.dump_files(names, "svazky") == []
    assert ingest.dump_files([*names, "svazky-2.txt"], "svazky") == ["svazky-1.txt", "svazky-2.txt"]
    assert ingest.dump_files(names, "txoch") == ["txoch2.txt"]
    assert ingest.dump_files(names, "desk") == []


def write(folder, name, columns, rows):
    widths = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True))
    body = [line(columns), "  ".join("=" * w for w in widths), *[line(r) for r in rows]]
    (folder / name).write_bytes("\n".join(["eSQL>", "select", "", *body, "Records affected: 1", ""]).encode("cp1250"))


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    raw, derived = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("derived"))
    loans = ["STAT_VYP$PTR_SVAZKY", "STAT_VYP$PTR_LEG", "STAT_VYP$TIME", "STAT_VYP$OPID", "STAT_VYP$PTR_KNODDEL"]
    write(raw, "vypujcky2024-01.txt", loans, [("1", "7", "2024-01-05 10:00:00", "4", "1"), ("3", "7", "2024-01-06 10:00:00", "5", "1")])
    write(raw, "vypujcky2023-01.txt", loans, [("1", "8", "2023-01-05 10:00:00", "4", "2"), ("9", "8", "2023-01-05 10:00:00", "4", "2")])
    write(raw, "svazky-1.txt", ["SVAZKY$KEY", "SVAZKY$PTR_TITUL"], [("1", "10"), ("2", "10")])
    write(raw, "svazky-2.txt", ["SVAZKY$KEY", "SVAZKY$PTR_TITUL"], [("3", "20")])
    write(raw, "tituly-signatura.txt", ["TITUL$KEY", "TITUL$SIGN_FULL"], [("10", "JD 10"), ("20", "AB 20")])
    write(raw, "tituly-nazev.txt", ["TITUL$KEY", "TITUL$NAZEV"], [("10", "Žlutý kůň"), ("20", "Druhý")])
    write(raw, "tituly-zahlavi.txt", ["TITUL$KEY", "TITUL$ZAHLAVI"], [("10", "h")])
    write(raw, "tituly-rokjazykdruh.txt", ["TITUL$KEY", "TITUL$ROK_VYDANI", "TITUL$JAZYK", "TITUL$DRUH_DOKUMENTU"], [("10", "1999", "cze", "a"), ("20", "x", "eng", "b")])
    write(raw, "opidy.txt", ["OPIDY$OPID", "OPIDY$POPIS"], [("4", "půjčeno"), ("5", "vráceno")])
    write(raw, "knihovny.txt", ["KNODDEL$KEY", "KNODDEL$NAZEV", "KNODDEL$ULICE", "KNODDEL$PSC"], [("1", "n", "u", "p")])
    write(raw, "druhdokumentu.txt", ["CISELNIKY$ZKRATKA", "CISELNIKY$TEXT"], [("a", "kniha")])
    write(raw, "legitky.txt", ["LEG$KEY", "VEK", "POHLAVI", "ADRESY$PSC"], [("7", "30", "5", "110 00")])
    write(raw, "och.txt", ["OCH$PTR_TITUL", "OCH$PTR_TXOCH"], [("10", "1"), ("10", "2")])
    write(raw, "txoch.txt", ["TXOCH$KEY", "TXOCH$TEXT"], [("1", "b text")])
    write(raw, "txoch2.txt", ["TXOCH$KEY", "TXOCH$TEXT"], [("2", "a text")])
    report = rebuild.rebuild_all(spark, str(raw), derived, policy=UsagePolicy(years=1)).first()
    return derived, report


def test_rebuild_all(spark, built):
    derived, report = built
    assert (report["fact_rows"], report["fact_rows_missing_titul"], report["rows_with_svazky_ptr_titul"]) == (4, 1, 3)
    assert (report["min_svazku"], report["max_svazku"], report["dim_tituly_rows"]) == (1, 2, 2)
    fact = spark.read.parquet(ingest.table_path(derived, rebuild.ENRICHED))
    row = fact.filter("TITUL_KEY = 10 AND YEAR = 2024").first()
    assert (row["TITUL_NAZEV"], row["TITUL_DRUH_DOKUMENTU"], row["ACTION_TYPE"], row["och_subjects"]) == (
        "Žlutý kůň", "kniha", "půjčeno", "a text | b text",
    )
    assert (row["VEK_BUCKET"], row["PSC_PREFIX"], row["KNODDEL_NAZEV"]) == ("25-34", "110", "n")
    titles = {r["TITUL_KEY"]: r for r in spark.read.parquet(ingest.table_path(derived, "titles_metrics")).collect()}
    assert (titles[10]["vypujcky_5_let"], titles[10]["pocet_svazku"], titles[10]["och_subjects"]) == (1, 2, "a text | b text")
    assert titles[20]["vypujcky_5_let"] == 0 and titles[20]["pocet_operaci_v_obdobi"] == 1


def test_review_of_both_kinds_of_dataset(spark, built):
    derived = built[0]
    policy = UsagePolicy(years=1, loan_actions=("půjčeno",))
    from_titles = load_titles(spark, ingest.table_path(derived, "titles_metrics"), policy=policy)
    from_rows = load_titles(spark, ingest.table_path(derived, rebuild.ENRICHED), policy=policy)
    as_frame = load_titles(spark, ingest.table_path(derived, rebuild.ENRICHED), policy=policy, as_frame=True)
    for titles in (from_titles, from_rows, as_frame):
        loans = {r["TITUL_KEY"]: (r["vypujcky_okno"], r["okno_let"]) for r in titles.collect()}
        assert loans[10] == (1, 1) and loans[20] == (0, 1)
    parts = review(from_titles, rules={"och_subjects": ["A TEXT"]}, focus="JD")
    assert [r["klasifikace"] for r in parts.results.collect()] == ["CHRANENO_VYJIMKOU"]
    assert parts.kpi.first()["titulu_celkem"] == parts.summary.first()["CELKEM_TITULU"] == 1
    assert parts.write_off.count() == parts.buy.count() == 1 and parts.unclear.count() == 2
    assert parts.class_counts.first()["pocet"] == 1 and parts.top_auto.first()["AUTO_KANDIDAT"] == 0
    one = load_titles(spark, ingest.table_path(derived, "titles_metrics"), sign_prefix="AB")
    assert [r["TITUL_KEY"] for r in one.collect()] == [20]


def test_year_partitions_are_pruned(spark, built):
    fact = spark.read.parquet(ingest.table_path(built[0], rebuild.ENRICHED))
    plan = fact.filter("YEAR = 2024").select("TITUL_KEY")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YEAR" in plan


def test_missing_inputs_stop_the_build(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="vypujcky"):
        rebuild.build_enriched(spark, str(tmp_path))


def test_star_schema(spark, built, tmp_path):
    derived = built[0]
    tables = ingest.load_tables(spark, derived, [rebuild.ENRICHED, "tituly", "svazky", "knoddel", "opidy"])
    spark.sql("CREATE DATABASE IF NOT EXISTS star")
    catalog.save_star(spark, *tables.values(), database="star", path=str(tmp_path))
    assert {t.name for t in spark.catalog.listTables("star") if not t.isTemporary} == set(catalog.TABLES)
    catalog.register_views(spark, database="star")
    assert {r["TITUL_KEY"]: r["pocet_svazku"] for r in spark.table("v_titul_svazky").collect()} == {10: 2, 20: 1}
    assert {r["loan_cnt"] for r in spark.table("v_loans_by_titul").collect()} == {0}
    catalog.register_views(spark, database="star", loan_column="ACTION_GROUP")
    loans = {r["TITUL_KEY"]: r["loan_cnt"] for r in spark.table("v_loans_by_titul").collect()}
    assert loans == {10: 2, 20: 0, None: 1}


def test_stages_live_in_the_named_folder(spark):
    df = stage(spark.range(5), "numbers")
    assert df.count() == 5
    assert stage_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(stage_root(spark) in f for f in df.inputFiles())


def test_stages_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("shelfwise.staging.stage_root", lambda _: str(tmp_path))
    spark.range(3).write.parquet(new_stage_path(spark, "x"))
    others = tmp_path / "shelfwise-stages" / "another-application"
    others.mkdir()
    assert list(tmp_path.glob("shelfwise-stages/*/x-*"))
    drop_stages(spark)
    assert list(tmp_path.glob("shelfwise-stages/*")) == [others]


def test_buckets_and_discard(spark):
    rows = spark.range(100).withColumn("text", F.col("id").cast("string"))
    laid_out = stage_buckets(rows, "id", "texts")
    narrow = stage(spark.range(0, 200, 2).withColumnRenamed("id", "key"), "narrow")
    joined = laid_out.join(narrow.hint("shuffle_hash"), F.col("id") == F.col("key"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and joined.count() == 50
    discard(spark, narrow)
    assert laid_out.count() == 100
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(narrow.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_a_settled_table_leaves_no_shuffle_files(spark):
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    names = lambda: {x for x in re.findall(r"shuffle_\d+", str(kept.getAllFiles()))}
    discard(spark, wait=True)
    for _ in range(3):  # the last query's files go, too
        before = names()
        rows = spark.range(1000).repartition(3, "id").selectExpr("id % 7 AS k").repartition(5, "k")
        table = settle(rows.where(F.col("k") >= 0), "settled")
        until = time.monotonic() + 5
        while names() - before and time.monotonic() < until:
            time.sleep(0.1)
        assert not names() - before and table.count() == 1000


def test_a_rebuild_leaves_no_lines_of_dumps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("shelfwise.staging.stage_root", lambda _: str(tmp_path / "stages"))
    raw, derived = str(tmp_path / "raw"), str(tmp_path / "derived")
    links = spark.range(40).selectExpr("id AS OCH_PTR_TITUL", "id % 3 AS OCH_PTR_TXOCH").distinct()
    write_dump(links, f"{raw}/och.txt")
    write_dump(spark.range(3).selectExpr("id AS TXOCH_KEY", "concat('t', id) AS TXOCH_TEXT"), f"{raw}/txoch.txt")
    assert ingest.ingest_dumps(spark, raw, derived) == ["txoch", "och"]
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.glob("stages/shelfwise-stages/*/*")}
    assert not left  # neither the rows that were dumped nor the lines, files and layouts that were read
    assert spark.read.parquet(ingest.table_path(derived, "och")).exceptAll(links).count() == 0
    assert rebuild.build_subjects(spark, derived).where("och_subjects LIKE 't%'").count() == 40
