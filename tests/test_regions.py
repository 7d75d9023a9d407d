"""Regions, region files and region tables on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.model import Params
from lumentrace.operators import gdm as H
from lumentrace.operators import rois as I
from lumentrace.sources import gdm_csv as CSV
from lumentrace.sources import roi_text as RT

# The strip fixture: label, centre, diameter; frame 172 x 130.
STRIP = [
    ("MyFirstROI", 61.34, 69.81, 11.0),
    ("2", 116.08, 48.76, 11.0),
    ("3", 110.36, 91.47, 11.0),
    ("4", 90.81, 67.41, 11.0),
    ("5", 66.45, 99.89, 11.0),
]


def outline(cx, cy, r):
    """Midpoint circle, step by step."""
    points, a, b, d = set(), r, 0, 3 - 2 * r
    while a >= b:
        for p, q in ((a, b), (b, a)):
            points |= {(cx + s * p, cy + u * q) for s in (1, -1) for u in (1, -1)}
        if d < 0:
            d += 4 * b + 6
        else:
            d += 4 * (b - a) + 10
            a -= 1
        b += 1
    return points


@pytest.mark.parametrize("radius", list(range(0, 25)) + [40, 63])
def test_circles_follow_the_midpoint_rule(spark, radius):
    shapes = spark.createDataFrame([("c", 70.9, 70.2, 2.0 * radius + 0.9)], "roi STRING, cx DOUBLE, cy DOUBLE, d DOUBLE")
    got = {(r.x, r.y) for r in I.circle_pixels(shapes, 500, 500).collect()}
    assert got == {(x, y) for x, y in outline(70, 70, radius) if x >= 0 and y >= 0}


def test_strip_circles_are_clipped_outlines(spark):
    shapes = spark.createDataFrame(STRIP + [("edge", 0.0, 129.0, 11.0)], "roi STRING, cx DOUBLE, cy DOUBLE, d DOUBLE")
    rows = I.circle_pixels(shapes, 172, 130).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.roi, set()).add((r.x, r.y))
    assert sizes["MyFirstROI"] == outline(61, 69, 5)
    assert sizes["edge"] == {(x, y) for x, y in outline(0, 129, 5) if x >= 0 and y < 130}
    disc = I.circle_pixels(shapes, 172, 130, filled=True).filter("roi = '2'").collect()
    assert outline(116, 48, 5) < {(r.x, r.y) for r in disc}


def test_polygon_with_borders(spark):
    shapes = spark.createDataFrame(
        [("p", [(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)]), ("out", [(-2.0, -2.0), (-1.0, -2.0), (-1.0, -1.0)])],
        "roi STRING, vertices ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>",
    )
    got = {(r.x, r.y) for r in I.polygon_pixels(shapes, 20, 20).collect()}
    assert got == {(x, y) for x in range(1, 6) for y in range(1, 5)}


def test_weights_sum_to_one(spark):
    shapes = spark.createDataFrame(STRIP, "roi STRING, cx DOUBLE, cy DOUBLE, d DOUBLE")
    weights = I.weighted(I.circle_pixels(shapes, 172, 130))
    area = weights.filter("x % 2 = 0").select("x", "y")
    for table in (weights, I.weighted_within(weights, area)):
        for r in table.groupBy("roi").agg(F.sum("w").alias("s")).collect():
            assert abs(r.s - 1) < 1e-12


def test_region_traces_match_array_sums(spark, traces, movie):
    rng = np.random.default_rng(1)
    w = rng.random((2, 6, 5))
    rows = [(f"r{k}", x, y, float(w[k, x, y])) for k in range(2) for x in range(6) for y in range(5)]
    weights = spark.createDataFrame(rows, "roi STRING, x INT, y INT, w DOUBLE")
    for r in I.roi_traces(traces, weights).collect():
        want = (movie[r.measu] * w[int(r.roi[1])][..., None]).sum(axis=(0, 1))
        np.testing.assert_allclose(r.trace, want)


def test_text_files_round_trip(spark, tmp_path):
    shapes = spark.createDataFrame(
        [(n, "circle", x, y, d, None) for n, x, y, d in STRIP] + [("p", "polygon", None, None, None, [(1.5, 2.5), (4.0, 9.0), (3.0, 3.0)])],
        "roi STRING, kind STRING, cx DOUBLE, cy DOUBLE, d DOUBLE, vertices ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>",
    )
    RT.write_roi_text(shapes, str(tmp_path / "rois"))
    back = {r.roi: r for r in RT.read_roi_text(spark, str(tmp_path / "rois")).collect()}
    assert back["MyFirstROI"].cx == 61.34 and back["MyFirstROI"].d == 11.0
    assert [(v.x, v.y) for v in back["p"].vertices] == [(2.0, 2.0), (4.0, 9.0), (3.0, 3.0)]
    (tmp_path / "bad.roi").write_text("square\tx\t1\t2\n")
    with pytest.raises(Exception):
        RT.read_roi_text(spark, str(tmp_path / "bad.roi")).collect()


def test_coordinate_files(spark, tmp_path):
    (tmp_path / "a.coor").write_text("2\n10\t20\tleft\n30\t5\t right\n1\t1\tunused\n")
    rows = sorted(RT.read_coor(spark, str(tmp_path / "a.coor")).collect(), key=lambda r: r.roi_idx)
    assert [(r.roi, r.cx, r.cy) for r in rows] == [("left", 10, 20), ("right", 30, 5)]
    square = I.square_pixels(
        spark.createDataFrame([("left", 1, 20, 2)], "roi STRING, cx INT, cy INT, half INT"), 30, 22
    ).collect()
    assert {(r.x, r.y) for r in square} == {(x, 21 - y) for x in range(0, 4) for y in range(18, 22)}
    (tmp_path / "b.coor").write_text("5\n10\t20\tleft\n")
    with pytest.raises(Exception):
        RT.read_coor(spark, str(tmp_path / "b.coor")).collect()


def test_relabel_only_when_counts_agree(spark):
    rois = spark.createDataFrame([("a", 5), ("b", 7)], "roi STRING, roi_idx INT")
    two = spark.createDataFrame([(0, "x"), (1, "y")], "label_idx INT, label STRING")
    assert sorted(r.roi for r in I.relabelled(rois, two).collect()) == ["x", "y"]
    assert sorted(r.roi for r in I.relabelled(rois, two.limit(1)).collect()) == ["0", "1"]


def test_region_source_choice(spark):
    shapes = spark.createDataFrame([("s", 5, 5)], "roi STRING, cx INT, cy INT")
    assert I.roi_pixels(Params(roi_source=0, roi_radius=1), shapes, 10, 10).count() == 9
    with pytest.raises(NotImplementedError):
        I.roi_pixels(Params(roi_source=9), shapes, 10, 10)


# --- tables -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark):
    roi = spark.createDataFrame(
        [(1, "a", [float(i) for i in range(50)]), (1, "b", [float(i * i) for i in range(50)]), (2, "a", [1.0] * 20)],
        "measu BIGINT, roi STRING, trace ARRAY<DOUBLE>",
    )
    stim = spark.createDataFrame(
        [(1, 0, "A", -1.0, 2000.0, 3000.0, 200.0), (1, 1, "B", -2.0, 5100.0, 6100.0, 200.0), (2, 0, "A", -1.0, 400.0, 600.0, 200.0)],
        "measu BIGINT, stim_idx INT, odor STRING, conc DOUBLE, on_ms DOUBLE, off_ms DOUBLE, period_ms DOUBLE",
    )
    return roi, stim


def test_chunks_two_seconds(tables):
    roi, stim = tables
    params = Params(chunk_pre_s=2.0, chunk_post_s=2.0, first_frame=1, last_frame=3)
    got = {(r.measu, r.roi, r.stim_idx): r for r in H.chunks(roi, stim, params).collect()}
    assert len(got) == 5
    r = got[1, "a", 0]
    assert r.trace == [float(i) for i in range(0, 26)] and r.t_start_s == 0 and r.stim_on_ms == 2000.0
    r = got[1, "a", 1]  # 15.5 and 40.5 round half-even to 16 and 40
    assert r.trace == [float(i) for i in range(16, 41)] and abs(r.t_start_s - 3.2) < 1e-12
    assert abs(r.stim_on_ms - (5100 - 3200)) < 1e-9 and r.ctv == 2.0
    assert got[2, "a", 0].n_frames == 14


def test_chunks_of_hundred_seconds_are_whole_traces(tables):
    roi, stim = tables
    full = {(r.measu, r.roi): r.trace for r in roi.collect()}
    for r in H.chunks(roi, stim, Params(chunk_pre_s=100.0, chunk_post_s=100.0)).collect():
        assert r.trace == full[r.measu, r.roi] and r.t_start_s == 0


def test_feature_out_of_range_is_nan(tables):
    roi, stim = tables
    rows = H.chunks(roi, stim, Params(first_frame=25, last_frame=45)).collect()
    assert all(np.isnan(r.ctv) for r in rows)


def test_output_switch_and_guards(spark, tables):
    roi, stim = tables
    with pytest.raises(NotImplementedError):
        H.region_table(Params(output_type="movies"), roi, None, None, stim)
    numbered = roi.withColumn("idx", F.col("measu"))
    with pytest.raises(Exception):
        H.matrix(numbered).collect()
    assert H.matrix(numbered.filter("measu = 1")).count() == 2
    with pytest.raises(Exception):
        H.subset(numbered, spark.createDataFrame([(1,), (9,)], "idx BIGINT")).collect()


def test_wide_text_round_trip(spark, tables, tmp_path):
    roi, _ = tables
    rows = roi.withColumns(
        {"Measu": F.col("measu"), "GloTag": F.col("roi"), "Cycle": F.lit(200.0), "TraceOffset": F.lit(0.0), "NumFrames": F.size("trace"), "line": F.lit("x_1")}
    ).select("Cycle", "line", "GloTag", "Measu", "TraceOffset", "NumFrames", "trace")
    CSV.write_gdm(rows, str(tmp_path / "gdm"))
    header = next((tmp_path / "gdm").glob("*.csv")).read_text().splitlines()[0].split(";")
    assert header[:7] == ["line", "TraceOffset", "NumFrames", "Cycle", "GloTag", "Measu", "PlaceHolder"]
    assert header[7] == "Frame0" and len(header) == 7 + 50
    back = {(r.Measu, r.GloTag): r for r in CSV.read_gdm(spark, str(tmp_path / "gdm")).collect()}
    want = {(str(r.measu), r.roi): r.trace for r in roi.collect()}
    assert {k: r.trace for k, r in back.items()} == want
    assert {r.line for r in back.values()} == {"x"}
    assert "PlaceHolder" not in CSV.read_gdm_metadata(spark, str(tmp_path / "gdm")).columns
    H.export_by_animal(roi.withColumn("animal", F.lit("a1")), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).filter("animal = 'a1'").count() == 3


def test_equal_labels_of_two_files_stay_apart(spark):
    shapes = spark.createDataFrame([("1", "a.roi", 10.0, 10.0, 4.0), ("1", "b.roi", 30.0, 30.0, 4.0)], "roi STRING, file STRING, cx DOUBLE, cy DOUBLE, d DOUBLE")
    weights = I.weighted(I.circle_pixels(shapes, 172, 130))
    sums = {(r.file, r.roi): (round(r.s, 9), r.n) for r in weights.groupBy("file", "roi").agg(F.sum("w").alias("s"), F.count("w").alias("n")).collect()}
    assert set(sums) == {("a.roi", "1"), ("b.roi", "1")} and all(s == 1.0 for s, _ in sums.values())
    lines = spark.createDataFrame([("1", "a", 1, 5), ("1", "a", 2, 6), ("1", "b", 1, 7)], "roi STRING, file STRING, line_no INT, cx INT")
    assert sorted((r.file, r.cx) for r in I.last_definitions(lines).collect()) == [("a", 6), ("b", 7)]


def test_chunk_background_is_that_of_the_recording(spark):
    """A ramp with the onset at frame 20: frames 4 to 19 of the chunk, whose mean is 11.5."""
    roi = spark.createDataFrame([(1, "r", [float(i) for i in range(64)])], "measu BIGINT, roi STRING, trace ARRAY<DOUBLE>")
    stim = spark.createDataFrame([(1, 0, "o", 1.0, 4000.0, 5000.0, 200.0)], "measu BIGINT, stim_idx INT, odor STRING, conc DOUBLE, on_ms DOUBLE, off_ms DOUBLE, period_ms DOUBLE")
    rows = H.chunks(roi, stim, Params(chunk_pre_s=100.0, chunk_post_s=100.0, feature=303)).collect()
    assert [r.ctv for r in rows] == [11.5] and rows[0].ctvs == [11.5]


def test_ragged_traces_keep_all_frames(spark, tmp_path):
    rows = [(1, "a", [1.0, 2.0, 3.0, 4.0, 5.0], 5), (2, "b", [6.0], 1), (3, "c", [], 0)]
    table = spark.createDataFrame(rows, "Measu BIGINT, GloTag STRING, trace ARRAY<DOUBLE>, NumFrames INT")
    CSV.write_gdm(table, str(tmp_path / "ragged"))
    back = {r.Measu: r.trace for r in CSV.read_gdm(spark, str(tmp_path / "ragged")).collect()}
    assert back == {str(m): t for m, _, t, _ in rows}
    wide = CSV.to_wide(table).select("Measu", "frames")
    assert {len(r.frames) for r in wide.collect()} == {5}
    assert H.wide_to_long(wide).count() == 6


def test_region_files_of_three_levels(spark):
    recordings = spark.createDataFrame([(1, "m1", "A"), (2, "m2", "A"), (3, "m3", "B"), (4, "m4", "C")], "measu BIGINT, label STRING, animal STRING")
    files = spark.createDataFrame(
        [("one", 0, "m1"), ("a", 0, "A"), ("late", 1, "m3"), ("b", 0, "B"), ("b2", 0, "B"), ("c", 1, "C"), ("d", 2, "m4"), ("other", 0, "Z")],
        "file STRING, folder INT, stem STRING",
    )
    got = {r.measu: r.file for r in I.chosen_files(recordings, files, ["label", "animal"]).collect()}
    assert got == {1: "one", 2: "a", 3: "b", 4: "c"}
    shapes = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1"), ("d", "r9")], "file STRING, roi STRING")
    rows = I.chosen_shapes(recordings, files, shapes, ["label", "animal"]).collect()
    assert sorted((r.measu, r.roi) for r in rows) == [(2, "r1"), (2, "r2"), (3, "r1")]
    more = recordings.unionByName(spark.createDataFrame([(5, "m5", None)], recordings.schema))
    assert I.chosen_files(more, files, ["label", "animal"], missing="skip").count() == 4
    with pytest.raises(Exception, match="no region file for recording 5"):
        I.chosen_files(more, files, ["label", "animal"]).collect()


@pytest.mark.parametrize("number", [0, 3])
def test_region_pixels_are_never_broadcast(spark, tmp_path, number):
    """Shapes are few and their pixels many; the driver holds neither those nor copies of region sizes."""
    fields = "concat('r', id) AS roi", "'circle' AS kind", "CAST(id % 50 AS INT) AS cx", "CAST(id % 40 AS INT) AS cy", "7D AS d"
    spark.range(60).selectExpr(*fields, "CAST(NULL AS ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) AS vertices").write.parquet(str(tmp_path / "s"))
    out = I.roi_pixels(Params(roi_source=number), spark.read.parquet(str(tmp_path / "s")), 50, 40)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    sums = out.groupBy("roi").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 60 and all(abs(r.w - 1) < 1e-9 for r in sums)
