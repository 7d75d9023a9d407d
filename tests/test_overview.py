"""Overview and movie numerics against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.model import Params
from lumentrace.operators import filters as R
from lumentrace.operators import overview as O
from lumentrace.plans import recipes


@pytest.fixture(scope="module")
def centred(spark, traces):
    return traces.withColumn("trace", F.transform("trace", lambda v: v - 100))


@pytest.fixture(scope="module")
def area(traces):
    return traces.filter("(x + y) % 3 <> 0").select("measu", "x", "y")


def subset(values, mode, margin, mask):
    if mode == 3:
        bx, by = int(values.shape[0] * margin), int(values.shape[1] * margin)
        return values[bx : values.shape[0] - bx, by : values.shape[1] - by]
    return values[mask] if mode in (5, 6) else values


def nearest(values, p):
    ordered = np.sort(values, axis=None)
    return ordered[int(np.round((len(ordered) - 1) * p / 100))]


@pytest.mark.parametrize("tens", [0, 1, 2])
@pytest.mark.parametrize("mode", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("percentile", [False, True])
def test_limits_and_scaling(centred, area, movie, tens, mode, percentile):
    params = Params(
        individual_scale=10 * tens + mode, scale_min=-12.0, scale_max=9.0, percentile_scale=percentile, percentile_value=20.0
    )
    pixels = R.exploded(centred)
    limits = O.data_limits(pixels, params, 6, 5, area)
    mask = np.array([[(x + y) % 3 != 0 for y in range(5)] for x in range(6)])
    found = {r.measu: (r.vmin, r.vmax) for r in limits.collect()}
    for m in range(2):
        values = movie[m] - 100
        chosen = subset(values, mode, 0.2, mask)
        low = nearest(chosen, 20) if percentile else chosen.min()
        high = nearest(chosen, 80) if percentile else chosen.max()
        if mode == 1:
            low, high = -12.0, 9.0
        if mode in (4, 6):
            low = -12.0
        np.testing.assert_allclose(found[m], (low, high))
    scaled = O.scaled_pixels(pixels, limits, params.individual_scale).agg(F.min("v"), F.max("v")).first()
    assert scaled[0] >= 0 and scaled[1] <= 1


@pytest.mark.parametrize("code", range(8))
@pytest.mark.parametrize("reverse", [False, True])
def test_rotation(spark, traces, code, reverse):
    image = np.arange(30).reshape(6, 5)
    pixels = traces.filter("measu = 0").select("measu", "x", "y", (F.col("x") * 5 + F.col("y")).alias("v"))
    swap, second, first = O.ROTATIONS[code]
    want = image.T if swap else image
    if second:
        want = np.fliplr(want)
    if first != reverse:
        want = np.flipud(want)
    got = np.zeros(want.shape)
    for r in O.rotated(pixels, code, 6, 5, reverse).collect():
        got[r.x, r.y] = r.v
    np.testing.assert_array_equal(got, want)


def test_frame_ranges():
    assert O.frame_range(-3, 0, 20) == (0, 20)
    assert O.frame_range(5, -1, 20) == (5, 20)
    assert O.frame_range(5, 100, 20) == (5, 20)
    assert O.frame_range(5, 5, 20) == (5, 6)
    for bad in ((30, 0), (8, 5)):
        with pytest.raises(ValueError):
            O.frame_range(*bad, 20)
    assert O.cropped_size(Params(cut_border=2, movie_last_frame=4), 6, 7, 20) == (2, 3, 5)
    with pytest.raises(ValueError):
        O.check_border(3, 6, 9)


def test_thresholds():
    for bad in ("x3", "a", "r1,2"):
        with pytest.raises(ValueError):
            O.threshold_value(bad, F.lit(0), F.lit(1))


def test_threshold_clips_percent(spark):
    row = spark.range(1).select(
        O.threshold_value("r150", F.lit(2.0), F.lit(4.0)).alias("a"), O.threshold_value("r-5", F.lit(2.0), F.lit(4.0)).alias("b"),
        O.threshold_value("a-0.5", F.lit(2.0), F.lit(4.0)).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (4.0, 2.0, -0.5)


def test_constant_background_is_clipped(spark):
    flat = spark.createDataFrame([(1, x, 0, 7.0) for x in range(3)], "measu BIGINT, x INT, y INT, v DOUBLE")
    assert {r.background for r in O.background_scaled(flat).collect()} == {1.0}


def test_three_digit_texts(spark):
    values = [0.0, 1.0, -0.08, 0.3, 12.345, 123.456, 999.6, 1234.5, 0.00012345, 0.000012345, -1e-10, 1e6]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE").select("i", O.three_digits(F.col("v")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == [f"{v:.3g}" for v in values]


def test_three_digit_texts_round_the_exact_value(spark):
    values = [12350.0, 12450.0, 7765.0, 1545.0, 100.5, 1.005, 1.125, -2.345e30, 9.995e-5, 999.5, 1e23, 5e-324, 1.7e308, -0.0, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i INT, v DOUBLE").select("i", O.three_digits(F.col("v")).alias("t"))
    assert [r.t for r in rows.orderBy("i").collect()] == [*(f"{v:.3g}" for v in values), None]


def test_every_price_has_a_text(spark, tmp_path):
    from lumentrace.catalog import load

    prices = [901.82, 999.49, 999.5, 1000.0, 12350.0, 12450.0, 68423.46, 104997.88, None]
    schema = "l_orderkey BIGINT, l_linenumber INT, l_partkey BIGINT, l_extendedprice DOUBLE, l_quantity DOUBLE"
    spark.createDataFrame([(i, 1, i, p, 3.0 * i) for i, p in enumerate(prices)], schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = load()[0]["o22_three_digits"](spark, str(tmp_path)).orderBy("l_orderkey").collect()
    assert [r.text for r in rows] == [None if p is None else f"{p:.3g}" for p in prices]
    assert [r.ratio_text for r in rows] == [f"{3.0 * i / 7:.3g}" for i in range(len(prices))]


def test_tapestry_rows_inherit(spark):
    rows = spark.createDataFrame(
        [(0, "row1", "A", [1, 2, 3, 4], {"feature": "22"}), (1, "row2", None, [5, 6, 7, 8, 9], None), (2, "row3", None, None, {"x": "1"})],
        "row_idx INT, row_name STRING, animal STRING, measus ARRAY<BIGINT>, flags MAP<STRING,STRING>",
    )
    known = spark.createDataFrame([("A", m) for m in range(1, 9)], "animal STRING, measu BIGINT")
    plan = O.tapestry_plan(rows, known).orderBy("row_idx", "position").collect()
    assert [(r.row_idx, r.measu) for r in plan] == [(0, m) for m in range(1, 5)] + [(i, m) for i in (1, 2) for m in range(5, 10)]
    assert all(r.animal == "A" for r in plan)
    assert [r.flags for r in plan if r.position == 0] == [{"feature": "22"}, {"feature": "22"}, {"x": "1"}]
    assert [r.measu for r in plan if r.empty] == [9, 9]


def test_feature_numbers(centred):
    from lumentrace.functions.features import FeatureContext

    ctx = FeatureContext.from_params(Params(first_frame=3, last_frame=8))
    assert O.overview_frames(centred, "chunk_magnitude_basic", ctx, [0, 2]).count() == 120
    assert O.overview_frames(centred, "chunk_magnitude_basic", ctx, "all").count() == 180
    with pytest.raises(ValueError):
        O.overview_frames(centred, 22, ctx, 1)


def test_scale_codes():
    assert O.decode_scale(120) == {"individual_scale": 3, "scale_margin": 0.2, "percentile_scale": False}
    assert O.decode_scale(1205) == {"individual_scale": 2, "percentile_scale": True, "percentile_value": 5.0}


@pytest.mark.parametrize("source", ["none", "foto1", "raw1", "sig1"])
def test_movie_table(spark, centred, traces, area, source):
    from lumentrace.model import STIMULI

    stim = spark.createDataFrame([(0, 0, "A", -1.0, 600.0, 1000.0, 200.0)], STIMULI)
    params = Params(
        individual_scale=22, threshold_on=source, threshold_positive="r50", threshold_negative="r10", cut_border=1, movie_first_frame=2,
        movie_last_frame=9, time_filter=True, space_filter=True, suppress_milliseconds=False,
    )
    out = recipes.movie_table(centred, stim, params, 6, 5, 20, traces, area)
    rows = out.collect()
    assert len(rows) == 2 * 4 * 3 * 8
    assert all(0 <= r.v <= 1 for r in rows)
    texts = {r.t: (r.time_text, r.stimulus_text) for r in rows if r.measu == 0}
    assert texts[2] == ("- 0.200 s", None) and texts[3] == (" 0.000 s", "A@-1.0") and texts[5][1] == "A@-1.0" and texts[6][1] is None
    outside = {(r.x + 1 + r.y + 1) % 3 for r in rows if not r.shown}
    assert 0 in outside
