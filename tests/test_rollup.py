"""Distinct titles rolled up from bitmaps against counts of the rows, and the preselected loans of an uploaded table."""

import random

from pyspark.sql import functions as F

from shelfwise.functions.rules import CLASSES
from shelfwise.operators import rollup, summaries
from shelfwise.operators.windowing import ANY_ACTION, UsagePolicy
from shelfwise.plans.review import load_titles, with_preselected_loans

TITLES = "SIGN_PREFIX string, klasifikace string, title_key string, pocet_svazku long, vykon_na_svazek double"


def titles(n, seed=3):
    """Titles of several classes and prefixes, repeated rows, one prefix with a third of all, rows without key, prefix or numbers."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        prefix = rng.choice(["HOT", f"P{rng.randrange(30)}", f"P{rng.randrange(30)}"])
        out += [(prefix, rng.choice(CLASSES), f"t{i}", rng.randrange(5), rng.random())] * rng.choice([1, 1, 2])
    odd = [(None, CLASSES[0], "t1", 1, 1.0), ("HOT", CLASSES[1], None, None, None), ("P1", CLASSES[1], "t2", 1, 0.5), (None, None, None, 2, 2.0)]
    return out + odd * 3


def test_cube_rolls_up(spark):
    rows = titles(3000)
    df = spark.createDataFrame(rows, TITLES).repartition(7)
    cube = rollup.title_cube(df)
    for dims in ((), ("klasifikace",), ("SIGN_PREFIX",), ("SIGN_PREFIX", "klasifikace")):
        at = [("SIGN_PREFIX", "klasifikace").index(d) for d in dims]
        want = {}
        for r in rows:
            keys, count = want.setdefault(tuple(r[i] for i in at), (set(), []))
            keys.add(r[2])
            count.append(r[3] or 0)
        got = {tuple(r[d] for d in dims): (r["titles"], r["rows"], r["copies"] or 0) for r in rollup.roll_up(cube, *dims).collect()}
        assert got == {k: (len(keys - {None}), len(c), sum(c)) for k, (keys, c) in want.items()}
    assert [tuple(r) for r in rollup.by_prefix(cube).collect()] == [tuple(r) for r in summaries.by_prefix(df).collect()]
    a, b = rollup.kpi(cube).first().asDict(), summaries.kpi(df).first().asDict()
    assert a.keys() == b.keys() and all(abs(a[c] - b[c]) < 1e-9 for c in a)


def test_titles_of_a_prefix_lie_in_few_blocks(spark):
    n = 100_000
    df = spark.range(n).select(
        F.concat(F.lit("P"), F.col("id") % 10).alias("SIGN_PREFIX"), F.lit(CLASSES[0]).alias("klasifikace"),
        F.concat(F.lit("t"), "id").alias("title_key"), F.lit(1).alias("pocet_svazku"), F.lit(1.0).alias("vykon_na_svazek"),
    )
    cube = rollup.title_cube(df)
    assert rollup.roll_up(cube).first()["titles"] == n
    assert cube.count() <= 10 + n // 32768 + 4 * 2 + 10  # blocks begin anew at prefixes, at their borders and at those of parts


def test_empty_cube(spark):
    df = spark.createDataFrame([], TITLES)
    cube = rollup.title_cube(df)
    assert rollup.by_prefix(cube).count() == 0
    assert rollup.kpi(cube).first().asDict() == summaries.kpi(df).first().asDict()
    assert rollup.roll_up(cube).first()["titles"] == 0


def test_preselected_loans(spark):
    def chosen(rows, columns="ACTION_TYPE string", policy=None):
        return with_preselected_loans(spark.createDataFrame(rows, columns), policy or UsagePolicy())

    assert chosen([(" Loan",), ("BORROW ",), ("return",), (None,)]).wanted_actions == ["borrow", "loan"]
    assert chosen([("půjčeno",), ("",)]).loan_policy == ANY_ACTION
    own = UsagePolicy(loan_actions=("x",))
    assert chosen([("loan",)], policy=own) == own
    assert chosen([("loan", True)], "ACTION_TYPE string, IS_LOAN boolean") == UsagePolicy()
    assert chosen([(1,)], "n int") == UsagePolicy()


def test_any_action_type_is_a_loan(spark, tmp_path):
    rows = [("A 1", "one", "2024-03-01", kind) for kind in ("půjčeno", "vráceno", " ", None)]
    events = spark.createDataFrame(rows, "TITUL_SIGN_FULL string, TITUL_NAZEV string, DATE string, ACTION_TYPE string")
    events.withColumn("VYP_OPID", F.lit(4)).write.parquet(str(tmp_path / "upload"))
    titles = load_titles(spark, str(tmp_path / "upload"), as_frame=True)
    assert [(r["vypujcky_5_let"], r["pocet_operaci_v_obdobi"]) for r in titles.collect()] == [(2, 4)]
