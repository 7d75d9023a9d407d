"""Distributed ranking, carry-forward, rank picks and per-key joins, with hot keys and outliers."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentrace.plans.ranking import carried_forward, indexed, numbered, rank_picks
from lumentrace.plans.skew import join_per_key, known, with_key_stats
from lumentrace.session import cut_lineage


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(11)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    ids = rng.permutation(n) * 3
    ids[:5] = [10**12, -(10**12), 10**15, 5 * 10**14, -7]  # far outliers
    value = np.where(rng.random(n) < 0.3, 1.5, np.round(rng.normal(0, 1e6, n), 3))
    return pd.DataFrame({"key": key, "id": ids, "value": value})


def test_positions_in_groups(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = indexed(df, "id", groups=["key"], buckets=8).toPandas().sort_values("id")
    want = skewed.sort_values("id").assign(row_idx=lambda d: d.groupby("key").cumcount())
    assert (got["row_idx"].to_numpy() == want["row_idx"].to_numpy()).all()
    whole = indexed(df, "id", name="i").toPandas().sort_values("id")
    assert (whole["i"].to_numpy() == np.arange(len(skewed))).all()


def test_positions_by_time(spark):
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, s),) for s in (50, 3, 7, 1)]
    got = indexed(spark.createDataFrame(rows, "ts TIMESTAMP"), "ts").orderBy("ts").collect()
    assert [r.row_idx for r in got] == [0, 1, 2, 3]


def test_carry_forward(spark, skewed):
    holes = skewed.assign(a=skewed["value"].where(skewed["id"] % 7 == 0))
    df = spark.createDataFrame(holes).withColumn("a", F.nanvl("a", F.lit(None).cast("double"))).repartition(6)
    got = carried_forward(df, "id", ["a"], ["key"]).toPandas().sort_values("id")
    want = holes.sort_values("id").assign(a=lambda d: d.groupby("key")["a"].ffill())
    np.testing.assert_array_equal(got["a"].astype(float).to_numpy(), want["a"].to_numpy())


def test_rank_picks_equal_sorted_arrays(spark, skewed):
    df = spark.createDataFrame(skewed).repartition(5)
    got = rank_picks(df, "value", ["key"], {"low": F.bround((F.col("n") - 1) * 0.2), "high": F.bround((F.col("n") - 1) * 0.8)}).toPandas()
    for _, r in got.iterrows():
        values = np.sort(skewed.loc[skewed["key"] == r["key"], "value"])
        n = len(values)
        assert r["low"] == values[int(np.round((n - 1) * 0.2))] and r["high"] == values[int(np.round((n - 1) * 0.8))]


def test_numbering_by_text_bursts_and_ties(spark):
    rng = np.random.default_rng(9)
    words = [f"region {'x' * (i % 7)}{i}" for i in range(2000)] + ["", "é", "zz", None]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    got = {r.w: r.n for r in numbered(df, "w", "n").collect()}
    want = sorted((w for w in words if w is not None), key=lambda w: w.encode())
    assert got == {w: i for i, w in enumerate([None, *want])}
    times = np.concatenate([np.full(1500, 7.0), 7 + rng.uniform(0, 1e-9, 1500), [1e300, -1e300]])
    burst = spark.createDataFrame([(i, float(t)) for i, t in enumerate(times)], "id int, t double").repartition(5)
    out = numbered(burst, "t", "n", ties=["id"], cuts=63)
    assert sorted((r.t, r.id) for r in out.collect()) == [(r.t, r.id) for r in sorted(out.collect(), key=lambda r: r.n)]
    assert out.groupBy(F.floor(F.col("n") / 500)).count().count() == 7
    assert numbered(df.filter("false"), "w", "n").count() == 0
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def _picked(spark, rows, ranks, schema="key int, value double", **more):
    df = spark.createDataFrame(rows, schema).repartition(6)
    return {r.key: tuple(r[name] for name in ranks) for r in rank_picks(df, "value", ["key"], {n: F.lit(r).cast("long") for n, r in ranks.items()}, **more).collect()}


@pytest.mark.parametrize("cells", [3, 50, 2000])
def test_rank_picks_with_outliers_ties_and_nan(spark, cells):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    groups = {
        0: np.concatenate([rng.normal(1e6, 1e-3, 3000), [1e300, -1e300, inf, -inf]]),
        1: np.full(500, 7.0), 2: np.array([nan, nan, 1.0]), 3: np.array([nan]), 4: np.repeat([1.0, 2.0, 3.0], [1, 900, 2]), 5: np.exp(rng.normal(0, 50, 2000)),
    }
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [(None, 1.0), (0, None), (6, None)]
    ranks = {"first": 0, "second": 1, "some": 450, "late": 1500, "none": 10**6, "before": -1}
    got = _picked(spark, rows, ranks, cells=cells)
    assert set(got) == set(groups)
    for k, values in groups.items():
        ordered = np.sort(values)  # NaN last
        want = [float(ordered[r]) if 0 <= r < len(ordered) else None for r in ranks.values()]
        assert [repr(v) for v in got[k]] == [repr(v) for v in want]


def test_rank_picks_of_large_whole_numbers_and_times(spark):
    big = [2**62 + i for i in range(200)]
    got = _picked(spark, [(1, v) for v in big], {"a": 3, "b": 199}, "key int, value long")
    assert got[1] == (big[3], big[199])
    times = [datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=i) for i in range(50)]
    assert _picked(spark, [(1, t) for t in times], {"a": 49}, "key int, value timestamp")[1] == (times[49],)


def test_rank_picks_shuffle_one_cell_only(spark):
    df = spark.range(400_000).selectExpr("id % 2 AS key", "rand(5) AS value").repartition(4).persist()
    out = rank_picks(df, "value", ["key"], {"p": F.floor(F.col("n") / 5)})
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2 * 4  # initial and final plan of three aggregates and a join
    df.unpersist()


def test_facts_beyond_the_bound_stay_a_table(spark):
    facts = spark.range(30).selectExpr("id AS key", "id * 2 AS two")
    few, many = known(facts, 30), known(facts, 29)
    assert few.small and not many.small
    big = spark.range(300).selectExpr("id % 40 AS key")
    assert few.joined_to(big, ["key"]).count() == many.joined_to(big, ["key"]).count() == 230


def test_per_key_joins_keep_every_row(spark, skewed):
    df = spark.createDataFrame(skewed)
    small = df.groupBy("key").agg(F.max("value").alias("top")).filter("key <> 3")
    assert join_per_key(df, small, ["key"]).count() == (skewed["key"] != 3).sum()
    assert join_per_key(df, small, ["key"], "left").count() == len(skewed)
    assert join_per_key(df, small, ["key"], "left_anti").count() == (skewed["key"] == 3).sum()
    stats = with_key_stats(df, ["key"], {"n": F.count(F.lit(1))}).toPandas()
    assert (stats["n"] == stats.groupby("key")["id"].transform("size")).all()


def test_shuffle_joins_give_the_same(spark, skewed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(skewed).repartition(5)
        got = indexed(df, "id", groups=["key"]).toPandas().sort_values("id")
        want = skewed.sort_values("id").groupby("key").cumcount()
        assert (got["row_idx"].to_numpy() == want.to_numpy()).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lineage_is_cut_in_the_named_folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    out = cut_lineage(spark.range(10).repartition(3))
    assert out.count() == 10
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert any(tmp_path.rglob("part-*"))


def exchanged(df):
    """Columns that go through a shuffle in the plan of ``df``, per exchange."""
    import re

    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", formatted)
    return [[c.split("#")[0] for c in i.split(", ")] for i in inputs]


def test_bucketed_movies_are_not_shuffled(spark, traces, tmp_path):
    from lumentrace.operators import rois as I
    from lumentrace.operators import signals as G
    from lumentrace.operators.bleach import flagged
    from lumentrace.sources.bucketed import attach_bucketed, write_bucketed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = [f"bucketed_{n}_{abs(hash(str(tmp_path)))}" for n in ("one", "two", "area", "members")]
    try:
        second = traces.withColumn("trace", F.transform("trace", lambda v: v * 0.5 + 1))
        area = traces.filter("(x + y) % 3 <> 0").select("measu", "x", "y")
        members = traces.select("measu", "x", "y", F.concat(F.lit("r"), F.col("x") % 2).alias("roi"))
        weights = I.weighted(members)
        plain = {"one": traces, "two": second, "area": area, "members": weights}
        held = {k: write_bucketed(df, n, str(tmp_path / k), 3) for (k, df), n in zip(plain.items(), names, strict=True)}
        spark.sql(f"DROP TABLE {names[0]}")
        held["one"] = attach_bucketed(spark, names[0], str(tmp_path / "one"), "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>", 3)
        facts = known(traces.select("measu").distinct().selectExpr("measu", "2 AS bg_start", "5 AS bg_end"))
        of = lambda t: (
            G.ratio_change(t["one"], t["two"], t["area"], facts), I.roi_trace_points(G.dff(t["one"], facts), t["members"]), flagged(t["one"], t["area"]),
        )
        for got, want in zip(of(held), of(plain), strict=True):
            assert not any({"trace", "trace2"} & set(columns) for columns in exchanged(got))
            keys = [c for c in ("measu", "roi", "x", "y", "t") if c in got.columns]
            a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (got, want.select(*got.columns)))
            for c in a.columns:
                x, y = (np.array(list(d[c])) for d in (a, b))
                np.testing.assert_allclose(x, y, atol=1e-9) if x.dtype.kind == "f" else np.testing.assert_array_equal(x, y)
        assert any({"trace"} & set(columns) for columns in exchanged(of(plain)[0]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_no_side_of_a_salted_join_is_broadcast_by_its_estimate(spark, tmp_path):
    """A small file says little about the rows it becomes, such as copies per salt."""
    spark.range(500).selectExpr("id AS key", "'x' AS text").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    big = facts.select("key", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = join_per_key(big, facts, ["key"], how)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == (0 if how == "left_anti" else 10_000)
