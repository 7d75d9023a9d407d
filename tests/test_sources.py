"""Files: lists, protocols, binary stacks, versions, exports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.sources import export as EX
from lumentrace.sources import lists as LS
from lumentrace.sources import movements as MV
from lumentrace.sources import stacks as ST


def test_list_files(spark, tmp_path):
    path = tmp_path / "a.lst"
    path.write_bytes("Measu\t Label \tOdour\n1\t  caf\xe9_1\tMOL\n2\tb\t\n".encode("latin-1"))
    df = LS.read_list(spark, str(path))
    assert df.columns == ["Measu", "Label", "Odour"]
    assert df.orderBy("Measu").first().Label == "caf\xe9_1"
    old = spark.createDataFrame([("1", "kept")], "Measu STRING, Odour STRING")
    LS.write_list(df, str(tmp_path / "out"), ["Label", "Measu"], old=old, keep_old=["Odour"])
    back = LS.read_list(spark, str(tmp_path / "out"))
    assert back.columns == ["Label", "Measu", "Odour"]
    assert {r.Measu: r.Odour for r in back.collect()} == {"1": "kept", "2": None}
    LS.convert_list(spark, str(path), str(tmp_path / "settings"), "list", "settings")
    assert LS.read_list(spark, str(tmp_path / "settings")).columns == ["label", "measu", "odorants"]


def test_protocol_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Animal : A7\nTrial : T2\nFPS : 4\nDuration : 30\nCam_Exposure\t: 5\nStimuli : oil, hexanol ,air\n")
    rows = LS.read_protocols(spark, str(tmp_path / "p.txt")).orderBy("measu").collect()
    assert [r.stimulus for r in rows] == ["oil", "hexanol", "air"]
    assert all(r.cycle == 250.0 and r.label == "A7_T2" and r.n_frames == 30 and r.analyze == -1 for r in rows)


def test_binary_stacks(spark, tmp_path):
    rng = np.random.default_rng(2)
    movies = {}
    for k, (nx, ny, nt) in enumerate([(5, 4, 6), (3, 7, 2)]):
        raw = rng.integers(0, 60000, (nt, ny, nx)).astype("<u2")
        raw.tofile(tmp_path / f"m{k}.pst")
        (tmp_path / f"m{k}.inf").write_text(f"[Info]\nWidth={nx}\r\nHeight={ny}\nFrames={nt}\nother=a=b\n")
        movies[k] = raw
    names = spark.createDataFrame([("m0", 0), ("m1", 1)], "stem STRING, measu BIGINT")
    geometry = ST.read_geometry(spark, str(tmp_path), names)
    rows = ST.read_stacks(spark, str(tmp_path), geometry, rows_per_batch=7).collect()
    assert len(rows) == 20 + 21
    for r in rows:
        raw = movies[r.measu]
        np.testing.assert_array_equal(r.trace, raw[:, raw.shape[1] - 1 - r.y, r.x])
    short = geometry.withColumn("frames", F.lit(100))
    with pytest.raises(Exception):
        ST.read_stacks(spark, str(tmp_path), short).collect()


def test_one_large_stack_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    movies, names = {}, []
    for k, (nx, ny, nt) in enumerate([(5, 4, 60), (3, 7, 2), (40, 30, 11)]):
        raw = rng.integers(0, 60000, (nt, ny, nx)).astype("<u2")
        raw.tofile(tmp_path / f"m{k}.{'pst' if k else 'ps'}")
        (tmp_path / f"m{k}.inf").write_text(f"[Info]\nWidth={nx}\r\nHeight={ny}\nFrames={nt}\nother=a=b\n")
        movies[k] = raw
        names.append((f"m{k}", k))
    recordings = spark.createDataFrame(names, "stem STRING, measu BIGINT")
    spark.dataSource.register(ST.StackRanges)
    parts = spark.read.format("stack_ranges").options(bytes="500").load(str(tmp_path))
    pieces = parts.filter("stem = 'm0'").select("t0", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(pieces) > 3 and len({r.p for r in pieces}) == len({r.t0 for r in pieces})
    for size in (500, 1 << 20, 7):
        rows = ST.read_stack_ranges(spark, str(tmp_path), recordings, bytes=size, block=9).collect()
        assert len(rows) == 20 + 21 + 1200
        for r in rows:
            raw = movies[r.measu]
            np.testing.assert_array_equal(r.trace, raw[:, raw.shape[1] - 1 - r.y, r.x])
    (tmp_path / "m1.inf").write_text("Width=3\nHeight=7\nFrames=3\n")
    with pytest.raises(Exception, match="bytes expected"):
        ST.read_stack_ranges(spark, str(tmp_path), recordings).collect()


def test_casts(spark, traces):
    pixels = A.unrolled(traces, "measu", "x", "y")
    whole = pixels.withColumn("v", F.floor("v").cast("double"))
    same = ST.cast_to_range(whole, "uint8", scale=False)
    assert same.agg(F.sum("v")).first()[0] == whole.agg(F.sum("v")).first()[0]
    stretched = ST.cast_to_range(pixels, "int16", scale=True).groupBy("measu").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    assert {(r.a, r.b) for r in stretched.collect()} == {(-32768, 32767)}
    with pytest.raises(Exception):
        ST.cast_to_range(pixels, "uint8", scale=False).collect()


def test_movement_lists_take_the_last_block(spark, tmp_path):
    path = str(tmp_path / "a.moveList")
    first = spark.createDataFrame([(1, t, 1, 1, 5) for t in range(3)], "measu BIGINT, t INT, dx INT, dy INT, quality INT")
    second = first.withColumns({"dx": F.col("t") - 1, "dy": -F.col("t"), "quality": F.lit(9)})
    MV.append_shifts(first, path)
    MV.append_shifts(second, path)
    got = {(r.t, r.dx, r.dy, r.quality) for r in MV.read_shifts(spark, path).collect()}
    assert got == {(t, t - 1, -t, 9) for t in range(3)}


def test_versions_and_exports(spark, traces, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    LS.write_versioned(df, str(tmp_path / "v"), "20240101")
    LS.write_versioned(df.withColumn("v", F.lit("b")), str(tmp_path / "v"), "20240102")
    assert {r.v for r in spark.read.parquet(str(tmp_path / "v" / "runs" / "*")).collect()} == {"a", "b"}
    newest = LS.latest_version(spark, str(tmp_path / "v")).first()
    assert (newest.v, newest.run_ts) == ("b", "20240102")
    meta = spark.createDataFrame([(0, "A", "l0"), (1, "B", "l1")], "measu BIGINT, animal STRING, label STRING")
    overview = traces.select("measu", "x", "y", F.col("trace")[0].alias("value"))
    EX.export_processed(EX.processed_rows(meta, overview, traces, 5), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert back.count() == 60 and {r.animal for r in back.select("animal").distinct().collect()} == {"A", "B"}
    one = back.filter("animal = 'B' AND x = 2 AND y = 0").first()
    assert one.trace == traces.filter("measu = 1 AND x = 2 AND y = 4").first().trace


def test_an_interrupted_run_is_invisible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        LS.latest_version(spark, path)
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k INT, v STRING")
    LS.write_versioned(df, path, "1")
    whole = LS._enter

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(LS, "_enter", killed)
    with pytest.raises(KeyboardInterrupt):
        LS.write_versioned(df.withColumn("v", F.lit("b")), path, "2")
    assert {r.v for r in LS.latest_version(spark, path).collect()} == {"a"}
    monkeypatch.setattr(LS, "_enter", whole)
    LS.write_versioned(df.withColumn("v", F.lit("c")), path, "2")
    assert [r.v for r in LS.latest_version(spark, path).collect()] == ["c", "c"]
    with pytest.raises(ValueError, match="complete already"):
        LS.write_versioned(df, path, "2")


def test_setups():
    assert LS.setup_source(4) == ("pst", 2)
    with pytest.raises(NotImplementedError):
        LS.setup_source(99)


def test_export_copies_only_facts_of_exported_recordings(spark, traces):
    meta = spark.range(1000).selectExpr("id AS measu", "concat('a', id) AS animal", "'l' AS label")
    overview = traces.select("measu", "x", "y", F.lit(1.0).alias("value"))
    rows = EX.processed_rows(meta, overview, traces, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "LeftSemi" in plan
    assert rows.groupBy("animal").count().orderBy("animal").collect() == [("a0", 30), ("a1", 30)]
