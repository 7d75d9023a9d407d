"""Measurement lists: checks, merging, naming, time texts."""

import pytest
from pyspark.sql import functions as F

from lumentrace.functions import text as X
from lumentrace.model import meta_def, meta_rows
from lumentrace.operators import measurements as L


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("A", 1, "x", 1), ("A", 2, "y", 0), ("B", 7, "x", -1), ("B", 9, "z", None)],
        "animal STRING, measu BIGINT, label STRING, analyze INT",
    )


def test_metadata_definition(spark):
    assert len(meta_rows()) == 43 and meta_def(spark).count() == 43
    required = {r.lst_name for r in L.required_columns(spark.createDataFrame([(1,)], "a INT"), 4).collect()}
    assert required == {"Label", "Measu", "Analyze", "DBB1", "Lambda", "Cycle", "dbb2"}


def test_lookup_needs_exactly_one(rows):
    assert L.lookup(rows, "label", "y").first().measu == 2
    for value in ("x", "nothing"):
        with pytest.raises(Exception):
            L.lookup(rows, "label", value).collect()


def test_row_at_position(rows):
    assert L.row_at(rows, 2, "measu").first().measu == 7
    assert L.row_at(rows, 4, "measu").count() == 0
    assert {r.measu for r in L.row_at(rows, 1, "measu", ["animal"]).collect()} == {2, 9}


def test_analyze_states(rows):
    def states(passed):
        got = rows.select("measu", L.analyze_state(F.lit(passed), F.col("analyze")).alias("a")).collect()
        return {r.measu: r.a for r in got}

    assert states(True) == {1: 1, 2: 0, 7: 1, 9: 1}
    assert states(False) == {1: 0, 2: 0, 7: 0, 9: 0}


def test_selection(rows):
    assert L.analysed(rows, None).count() == 4 and L.analysed(rows, [1, 0]).count() == 2
    assert L.selected_legacy(rows, measu=7).count() == 1


def test_update_of_unknown_column_fails(spark, rows):
    with pytest.raises(ValueError):
        L.updated(rows, spark.createDataFrame([(1, "q")], "measu BIGINT, colour STRING"))


def test_append_renumbers_and_keeps_labels(spark, rows):
    more = spark.createDataFrame([(5, "p"), (3, "q")], "measu BIGINT, label STRING")
    got = {r.measu: r.label for r in L.appended(rows, more, None).collect()}
    assert got[10] == "q" and got[11] == "p" and len(got) == 6
    assert {r.label for r in L.appended(rows, more, "_b").filter("measu > 9").collect()} == {"q_b", "p_b"}


def test_old_values_win_unless_all_are_missing(spark, rows):
    old = spark.createDataFrame(
        [(1, None, None, "n1"), (2, "old", None, "n2"), (50, "far", 8, "n3")], "measu BIGINT, label STRING, analyze INT, note STRING"
    )
    got = {r.measu: (r.label, r.analyze, r.note) for r in L.merged_old_values(rows, old, ["label", "analyze", "note", "absent"]).collect()}
    assert got == {1: (None, 1, "n1"), 2: ("old", 0, "n2"), 7: (None, -1, None), 9: (None, None, None)}


def test_unique_labels(rows):
    got = {r.measu: r.unique_label for r in L.unique_labels(rows).collect()}
    assert got == {1: "x", 2: "y", 7: "x(1)", 9: "z"}


def test_pairs_by_position(spark):
    df = spark.createDataFrame(
        [("A", 1, 340, "a1", 1), ("A", 2, 380, "b1", 1), ("A", 3, 340, "a2", 1), ("A", 4, 380, "b2", 1), ("A", 5, 340, "a3", 1)],
        "animal STRING, measu BIGINT, lambda_nm INT, dbb1 STRING, analyze INT",
    )
    got = {r.measu: (r.dbb2, r.analyze) for r in L.paired_wavelengths(df).collect()}
    assert got == {1: ("b1", 1), 2: (None, 0), 3: ("b2", 1), 4: (None, 0)}


def test_vendor_conversions(spark):
    lif = spark.createDataFrame([(1, "s", 200.0, 0.5, "1D1E5F6D3A8C000", "f")], "measu BIGINT, Label STRING, Cycle DOUBLE, PxSzX DOUBLE, TimeStamp STRING, file STRING")
    row = L.from_vendor(lif, "lif").first()
    assert row.SampFreq == 5.0 and row.PxSzY == 0.5
    assert row.UTC == (int("1D1E5F6D3A8C000", 16) - 116444736000000000) / 1e7
    ome = spark.createDataFrame(
        [(1, "s", 100.0, 488, "2021-06-09T08:25:04", 0.25, 1.0, 2.0, "d", "e")],
        "measu BIGINT, Label STRING, GDMfreq DOUBLE, Lambda INT, AcquisitionDate STRING, first_frame_s DOUBLE, PsSzX DOUBLE, PsSzY DOUBLE, dbb1 STRING, dbb2 STRING",
    )
    assert L.from_vendor(ome, "ome").first().UTC == 1623227104.25
    with pytest.raises(NotImplementedError):
        L.from_vendor(lif, "abc")


def test_label_odour(spark):
    df = spark.createDataFrame([("01_MOL_-2",), ("01_MOL-3",), ("MOL",), ("a_b",), ("a-b-c",)], "label STRING")
    got = [(r.odour, r.oconc) for r in L.with_label_odour(df).collect()]
    assert got == [("MOL", "-2"), ("MOL", "-3"), ("unknown", "0"), ("b", "0"), ("unknown", "0")]


def test_paths(spark):
    df = spark.createDataFrame([("C:\\data\\an1\\m1.pst",), ("m2",)], "p STRING")
    got = df.select(X.slashes("p").alias("s"), X.animal_of_path("p").alias("a")).collect()
    assert [(r.s, r.a) for r in got] == [("C:/data/an1/m1.pst", "m1"), ("m2", "m2")]
    seconds = spark.range(1).select(X.clock_text(F.lit(3725.9)).alias("t"), X.excel_seconds(F.lit(25570.0)).alias("e")).first()
    assert (seconds.t, seconds.e) == ("01:02:05", 86400.0)
    assert [r[0] for r in spark.createDataFrame([("1",), ("True",), ("0",), (None,)], "c STRING").select(X.truth("c")).collect()] == [True, True, False, False]


def test_candidates_in_order(spark):
    df = spark.createDataFrame([("an_1", "m")], "animal STRING, dbb1 STRING")
    paths = df.select(L.candidate_paths(F.col("dbb1"), F.col("animal"), ".pst", "/d").alias("c")).first().c
    assert paths == [
        "/d/m", "/d/m.pst", "/d/an_1/m", "/d/an_1/m.pst", "/d/an_1.pst/m.pst", "/d/an_1/an_1.pst/m", "/d/an_1/an_1.pst/m.pst",
        "/d/an/m", "/d/an/m.pst", "/d/an/an_1.pst/m", "/d/an/an_1.pst/m.pst",
    ]


def test_binning_must_divide(spark):
    df = spark.createDataFrame([(0, "l", 10, 9, 1.0, 1.0)], "row_idx INT, label STRING, frame_x INT, frame_y INT, pxszx DOUBLE, pxszy DOUBLE")
    with pytest.raises(Exception):
        L.binned_metadata(df, 2).collect()


def test_every_name_in_every_vocabulary(spark):
    from lumentrace.model import meta_rows

    rows = [r for r in meta_rows()]
    assert dict((r[0], r[4]) for r in rows)["PhTime"] == "pharma_time"
    places = {"list": 0, "settings": 3, "p1": 4}
    kinds = [k for k in places if k in ("list", "settings")]
    for source in kinds:
        for target in kinds:
            names = [(r[places[source]], r[places[target]]) for r in rows if r[places[source]] and r[places[target]]]
            df = spark.createDataFrame([tuple(range(len(names)))], [a for a, _ in names])
            assert L.renamed(df, source, target).columns == [b for _, b in names]


def test_loaded_copies_only_facts_of_loaded_recordings(spark, traces):
    meta = spark.range(1000).selectExpr("id AS measu", "concat('l', id) AS label")
    out = L.loaded(meta, traces)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftSemi" in plan
    assert {(r.measu, r.label, r["count"]) for r in out.groupBy("measu", "label").count().collect()} == {(0, "l0", 30), (1, "l1", 30)}


def test_first_existing_of_odd_rows_equals_a_look_at_every_candidate(spark):
    tags, names = ["a_1", "a", "", None, "b.pst", "x/y"], ["f", "d\\f", "f.tif", "f.pst.tif", "", None, "a/f.pst"]
    rows = [(i % 35 if i % 11 else None, t, n) for i, (t, n) in enumerate((t, n) for t in tags for n in names)]
    df = spark.createDataFrame(rows, "measu long, animal string, dbb1 string")
    endings = [".pst", ".tif"]
    every = F.concat(*[L.candidate_paths(F.replace("dbb1", F.lit("\\"), F.lit("/")), F.col("animal"), e, "/r") for e in endings])
    tried = [(r.measu, r.animal, r.dbb1, r.c) for r in df.select("*", every.alias("c")).collect()]
    listed = sorted({c for *_, some in tried for c in some})[::3] + ["/elsewhere", "/elsewhere", None]
    listing = spark.createDataFrame([(p,) for p in listed], "path string")
    best = {}
    for measu, _, _, some in tried:
        hits = [(i, c) for i, c in enumerate(some) if c in listed]
        best[measu] = min([*hits, *([best[measu]] if measu in best else [])], default=(99, None))
    got = L.first_existing(df, listing, "measu", endings, "/r")
    assert got.columns == ["measu", "animal", "dbb1", "existing_path"]
    want = [(m, t, n, best[m][1] if m is not None else None) for m, t, n, _ in tried]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len({w[3] for w in want}) > 10


def test_first_existing_sends_places_not_candidates(spark):
    df = spark.range(40).selectExpr("id AS measu", "concat('a', id, '_x') AS animal", "concat('f', id) AS dbb1")
    listing = df.selectExpr("concat('/r/', animal, '/', dbb1, '.tif') AS path")
    out = L.first_existing(df, listing, "measu", [".pst", ".tif", ".lsm"], "/r")
    assert out.filter("existing_path IS NULL").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "posexplode" not in plan
    tried = L._tried(F.col("dbb1"), F.col("animal"), [".pst", ".tif", ".lsm"], "/r")
    places = df.select(F.size(F.array_distinct(F.transform(tried, lambda p: L._place(p, [".pst", ".tif", ".lsm"])))).alias("n"), F.size(tried).alias("m"))
    assert {tuple(r) for r in places.collect()} == {(5, 33)}
