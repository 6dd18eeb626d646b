"""The written dictionary of terms against the terms themselves."""

import random

from shelfwise.operators import summaries


def test_suggestions_from_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    texts = ["|".join(" " + "".join(rng.choice("aAbBŽž%_") for _ in range(rng.randrange(6))) for _ in range(5)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(4)
    summaries.write_vocabulary(df, "t", str(tmp_path / "d"))
    terms = summaries.vocabulary(df, "t")
    for typed in ("", " A", "ab", "ž", "%", "a_", "zz"):
        want = [r["term"] for r in summaries.suggestions(terms, typed, 20).collect()]
        assert [r["term"] for r in summaries.suggestions_from(spark, str(tmp_path / "d"), typed, 20).collect()] == want
    plan = summaries.suggestions_from(spark, str(tmp_path / "d"), "ab")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lower,ab)" in plan and "StringStartsWith(lower,ab)" in plan
    # parts do not overlap, so a prefix is in one or two of them
    ends = sorted(
        (rows[0][0], rows[-1][0])
        for f in (tmp_path / "d").glob("*.parquet")
        if (rows := [tuple(r) for r in spark.read.parquet(str(f)).select("lower").collect()])
    )
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
