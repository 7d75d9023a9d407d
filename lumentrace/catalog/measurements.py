"""Queries for measurement lists (M*, S16, U2, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import text as X
from lumentrace.operators import measurements as L

meas = M.measurements


@query(
    "m1_defaults",
    sql_over("meas", body="""SELECT measu, 'not set yet' AS "Odour", '-1' AS "StimON", '200' AS "Cycle" FROM meas"""),
)
def _(spark, sf):
    return L.with_defaults(meas(spark, sf).select("measu")).select("measu", "Odour", "StimON", "Cycle")


@query("m2_numbers", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS cell_num FROM part")
def _(spark, sf):
    cells = M.table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE CAST(p_size AS STRING) END AS cell")
    return L.with_numbers(cells, ["cell"]).select("p_partkey", "cell_num")


@query(
    "m3_missing_required",
    """WITH c AS (SELECT unnest(['Label', 'Measu', 'Analyze', 'DBB1', 'Lambda', 'Cycle', 'dbb2']) AS lst_name),
u AS (SELECT count(o_orderpriority) AS "Label", count(o_orderkey) AS "Measu", count(o_totalprice) AS "Cycle" FROM orders)
SELECT lst_name FROM c WHERE NOT (lst_name = 'Label' AND (SELECT "Label" FROM u) > 0) AND NOT (lst_name = 'Measu' AND (SELECT "Measu" FROM u) > 0)
  AND NOT (lst_name = 'Cycle' AND (SELECT "Cycle" FROM u) > 0)""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr(
        "o_orderpriority AS Label", "o_orderkey AS Measu", "CAST(NULL AS INT) AS Lambda", "o_totalprice AS Cycle"
    )
    return L.missing_required(rows, 4)


@query("m4_lookup", sql_over("meas", body="SELECT animal, measu, label, analyze FROM meas WHERE measu = 77"))
def _(spark, sf):
    return L.lookup(meas(spark, sf).select("animal", "measu", "label", "analyze"), "measu", 77)


@query(
    "m5_row_at_position",
    sql_over("meas", body="""SELECT animal, measu, label FROM (SELECT *, row_number() OVER (PARTITION BY animal ORDER BY measu) - 1 AS r FROM meas) WHERE r = 3"""),
)
def _(spark, sf):
    return L.row_at(meas(spark, sf).select("animal", "measu", "label"), 3, "measu", ["animal"])


@query("m6_columns_of_type", "SELECT o_totalprice AS \"Cycle\", o_orderdate AS \"UTC\" FROM orders")
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS Measu", "o_orderpriority AS Label", "o_totalprice AS Cycle", "o_orderdate AS UTC"
    )
    return L.columns_of_type(rows, "recording")


@query("m7_analysed", sql_over("meas", body="SELECT measu FROM meas WHERE analyze IN (1, -1)"))
def _(spark, sf):
    return L.analysed(meas(spark, sf), [1, -1]).select("measu")


@query("m8_select_legacy", "SELECT p_partkey AS measu, p_size AS analyze FROM part WHERE p_size % 5 = 0")
def _(spark, sf):
    return L.selected_legacy(M.table(spark, sf, "part").selectExpr("p_partkey AS measu", "p_size AS analyze"), divisor=5)


@query(
    "m9_update_cells",
    sql_over("meas", body="""SELECT measu, CASE WHEN measu % 10 = 3 THEN 'checked' ELSE label END AS label,
CASE WHEN measu % 20 = 3 THEN 1 ELSE analyze END AS analyze FROM meas"""),
)
def _(spark, sf):
    rows = meas(spark, sf).select("measu", "label", "analyze")
    changes = rows.filter("measu % 10 = 3").selectExpr("measu", "'checked' AS label", "CASE WHEN measu % 20 = 3 THEN 1 END AS analyze")
    return L.updated(rows, changes)


@query("m10_cell", sql_over("meas", body="SELECT label FROM meas WHERE measu = 5"))
def _(spark, sf):
    return L.value_of(meas(spark, sf), 5, "label")


def _note_row(row):
    """A user's row function: notes the period in the label and adds a column."""
    row["slow"] = bool(row["cycle"] > 200)
    row["label"] = f"{row['label']}@{int(row['cycle'])}"
    return row


@query(
    "m11_row_function",
    sql_over("meas", body="SELECT measu, label || '@' || CAST(CAST(cycle AS BIGINT) AS VARCHAR) AS label, cycle, cycle > 200 AS slow FROM meas"),
)
def _(spark, sf):
    rows = meas(spark, sf).select("measu", "label", "cycle")
    return L.mapped_rows(rows, _note_row, "measu BIGINT, label STRING, cycle DOUBLE, slow BOOLEAN")


@query(
    "m12_analyze_state",
    sql_over("meas", body="SELECT measu, CASE WHEN price <= 100000 THEN 0 WHEN analyze < 0 THEN 1 ELSE analyze END AS analyze FROM meas"),
)
def _(spark, sf):
    return meas(spark, sf).select("measu", L.analyze_state(F.col("price") > 100000, F.col("analyze")).alias("analyze"))


def with_paths(spark, sf):
    return meas(spark, sf).selectExpr("animal", "measu", "label", "analyze", "concat('a', measu % 500) AS dbb1", "concat('b', measu % 300) AS dbb2")


def part_files(spark, sf):
    """A file listing: one entry per part that exists."""
    return M.table(spark, sf, "part").filter("p_size % 3 <> 0")


@query(
    "m13_check_files",
    sql_over("meas", body=""", f AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size % 3 <> 0)
SELECT measu, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 0 WHEN analyze < 0 THEN 1 ELSE analyze END AS analyze,
  CASE WHEN a.k IS NULL THEN 'a' || CAST(measu % 500 AS VARCHAR) ELSE '/data/a' || CAST(measu % 500 AS VARCHAR) || '.pst' END AS dbb1
FROM meas LEFT JOIN f a ON a.k = measu % 500 LEFT JOIN f b ON b.k = measu % 300"""),
)
def _(spark, sf):
    stems = part_files(spark, sf).selectExpr("explode(array(concat('a', p_partkey), concat('b', p_partkey))) AS stem")
    listing = stems.withColumn("path", F.concat(F.lit("/data/"), "stem", F.lit(".pst")))
    return L.checked_files(with_paths(spark, sf), listing, ["dbb1", "dbb2"], absolute=True).select("measu", "analyze", "dbb1")


@query(
    "m14_check_loading",
    sql_over("meas", "pixels", body=""", n AS (SELECT DISTINCT measu FROM pixels)
SELECT m.measu, CASE WHEN n.measu IS NULL THEN 0 WHEN analyze < 0 THEN 1 ELSE analyze END AS analyze FROM meas m LEFT JOIN n USING (measu)"""),
)
def _(spark, sf):
    return L.checked_loading(meas(spark, sf).select("measu", "analyze"), M.traces(spark, sf), 64)


@query(
    "m15_append_list",
    sql_over("meas", body=""", mx AS (SELECT max(measu) AS mx FROM meas)
SELECT measu, label FROM meas UNION ALL SELECT mx + row_number() OVER (ORDER BY p_partkey), p_name || '_new' FROM part, mx"""),
)
def _(spark, sf):
    second = M.table(spark, sf, "part").selectExpr("p_partkey AS measu", "p_name AS label")
    return L.appended(meas(spark, sf).select("measu", "label"), second, "_new")


@query(
    "m16_merge_old_values",
    sql_over("meas", body=""", old AS (SELECT p_partkey AS measu, CASE WHEN p_size > 10 THEN p_type END AS label, p_brand AS note FROM part)
SELECT m.measu, o.label, m.analyze, o.note FROM meas m LEFT JOIN old o USING (measu)"""),
)
def _(spark, sf):
    old = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu", "CASE WHEN p_size > 10 THEN p_type END AS label", "p_brand AS note", "CAST(NULL AS INT) AS analyze"
    )
    return L.merged_old_values(meas(spark, sf).select("measu", "label", "analyze"), old, ["label", "note", "analyze"])


@query(
    "m17_known_and_extra",
    sql_over("meas", body="SELECT measu, label, CAST(analyze AS VARCHAR) AS extra_analyze, animal AS extra_animal, 2 AS n_extra FROM meas"),
)
def _(spark, sf):
    out = L.split_extra(meas(spark, sf).select("measu", "label", "analyze", "animal"), ["measu", "label"])
    return out.select("measu", "label", F.col("extra")["analyze"].alias("extra_analyze"), F.col("extra")["animal"].alias("extra_animal"), F.size("extra").alias("n_extra"))


@query(
    "m18_recording_facts",
    """SELECT p_partkey AS measu, CAST(p_size AS VARCHAR) AS age_min, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + 4 AS VARCHAR) END AS age_max,
1000.0 / p_size AS frequency, CASE WHEN p_partkey % 4 = 0 THEN 2.4 ELSE p_size * 0.5 END AS pixel_x, CASE WHEN p_partkey % 4 = 0 THEN 2.4 ELSE p_size * 0.25 END AS pixel_y FROM part""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu",
        "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN concat(p_size, '-', p_size + 4) ELSE concat(p_size, ';', p_size + 4) END AS age",
        "CAST(p_size AS DOUBLE) AS cycle",
        "CASE WHEN p_partkey % 4 = 0 THEN '02.Apr' ELSE CAST(p_size * 0.5 AS STRING) END AS pxszx",
        "CAST(p_size * 0.25 AS STRING) AS pxszy",
    )
    return L.recording_facts(rows).select("measu", "age_min", "age_max", "frequency", "pixel_x", "pixel_y")


def list_cells(spark, sf):
    return M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu", "CASE WHEN p_size % 3 = 0 THEN 'not set yet' ELSE p_name END AS Odour",
        "CASE WHEN p_size % 2 = 0 THEN '200.0' ELSE CAST(p_size AS STRING) END AS Cycle", "'-1' AS StimON",
    )


@query(
    "m19_defaults_test",
    """SELECT p_partkey AS measu, p_size % 3 = 0 AS odour_default, p_size % 2 = 0 AS cycle_default FROM part""",
)
def _(spark, sf):
    out = L.non_default(list_cells(spark, sf), ["Odour", "Cycle", "StimON"])
    return out.select("measu", (~F.map_contains_key("metadata", F.lit("Odour"))).alias("odour_default"), (~F.map_contains_key("metadata", F.lit("Cycle"))).alias("cycle_default"))


@query(
    "m20_non_default_metadata",
    """SELECT p_partkey AS measu, CASE WHEN p_size % 3 <> 0 THEN 'Odour=' || p_name || ';' ELSE '' END ||
CASE WHEN p_size % 2 <> 0 THEN 'Cycle=' || CAST(p_size AS VARCHAR) || ';' ELSE '' END AS metadata FROM part""",
)
def _(spark, sf):
    out = L.non_default(list_cells(spark, sf), ["Odour", "Cycle", "StimON"])
    text = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";")))
    return out.select("measu", F.array_join(text, "").alias("metadata"))


@query(
    "m20_stimulus_lists",
    sql_over("stimuli", body="SELECT measu, count(*) AS n_on, round(sum(on_ms), 4) AS sum_on, round(sum(off_ms - on_ms), 4) AS sum_len FROM stimuli GROUP BY 1"),
)
def _(spark, sf):
    out = L.stimulus_lists(M.stimuli(spark, sf))

    def total(c):
        return F.aggregate(F.split(c, ", "), F.lit(0.0), lambda a, v: a + v.cast("double"))

    return out.select("measu", F.size(F.split("stim_on_ms", ", ")).alias("n_on"), F.round(total("stim_on_ms"), 4).alias("sum_on"), F.round(total("stim_len"), 4).alias("sum_len"))


@query(
    "m21_timing_period",
    """SELECT p_partkey AS measu, CASE WHEN p_size % 7 = 0 THEN -1.0 ELSE (p_size * 3.0) / 2 END AS cycle,
CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS analyze FROM part""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu",
        "CASE WHEN p_size % 14 = 0 THEN '(No calibration available)' WHEN p_size % 7 = 0 THEN '5.0' ELSE concat(' ', p_size, ' ', p_size * 2, ' ', p_size * 4) END AS timing_ms",
    )
    return L.timed(rows).select("measu", "cycle", "analyze")


@query(
    "m22_mtime",
    sql_over("meas", body=""", s AS (SELECT measu, CAST(utc - min(utc) OVER (PARTITION BY animal) AS BIGINT) AS s FROM meas)
SELECT measu, CASE WHEN s // 3600 < 10 THEN '0' ELSE '' END || CAST(s // 3600 AS VARCHAR) || printf(':%02d:%02d', (s // 60) % 60, s % 60) AS mtime FROM s"""),
)
def _(spark, sf):
    return L.with_mtime(meas(spark, sf)).select("measu", "mtime")


_PAIRS = """, k AS (SELECT animal, measu, 340 + 40 * (measu % 2) AS lambda_nm, 'f' || CAST(measu AS VARCHAR) AS dbb1, analyze FROM meas),
r AS (SELECT *, row_number() OVER (PARTITION BY animal, lambda_nm ORDER BY measu) AS rn FROM k)
SELECT a.measu, a.lambda_nm, b.dbb1 AS dbb2, a.analyze FROM r a JOIN r b ON a.animal = b.animal AND a.rn = b.rn WHERE a.lambda_nm = 340 AND b.lambda_nm = 380
UNION ALL SELECT b.measu, b.lambda_nm, NULL, 0 FROM r a JOIN r b ON a.animal = b.animal AND a.rn = b.rn WHERE a.lambda_nm = 340 AND b.lambda_nm = 380"""


@query("m23_pair_wavelengths", sql_over("meas", body=_PAIRS))
def _(spark, sf):
    rows = meas(spark, sf).selectExpr("animal", "measu", "340 + 40 * (measu % 2) AS lambda_nm", "concat('f', measu) AS dbb1", "analyze")
    return L.paired_wavelengths(rows).select("measu", "lambda_nm", "dbb2", "analyze")


@query(
    "m24_vendor_vws",
    """SELECT o_orderkey + 1 AS "Measu", o_orderpriority AS "Label", o_totalprice AS "Cycle",
'd/' || CAST(o_orderkey AS VARCHAR) || '.pst' AS "DBB1", 340 AS "Lambda", o_custkey AS "UTC" FROM orders""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS index", "o_orderpriority AS Label", "o_totalprice AS dt", "340 AS MonochromatorWL_nm", "o_custkey AS UTCTime",
        "concat('d/', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.ps' ELSE '.pst' END) AS Location",
    )
    return L.from_vendor(rows, "vws")


@query(
    "m24_vendor_lsm",
    """SELECT p_partkey AS "Measu", p_name AS "Label", p_size * 0.25 * 1000 AS "Cycle", 488 AS "Lambda", (40000.0 + p_size * 0.5 - 25569) * 86400 AS "UTC",
round(p_size * 0.000001 / 1e-6, 6) AS "PxSzX", round(p_size * 0.000002 / 1e-6, 6) AS "PxSzY", p_brand AS "DBB1" FROM part""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu", "p_name AS Name", "p_size * 0.25D AS TimeIntervall", "488 AS Wavelength", "40000.0D + p_size * 0.5D AS Sample0time",
        "p_size * 0.000001D AS VoxelSizeX", "p_size * 0.000002D AS VoxelSizeY", "p_brand AS file",
    )
    return L.from_vendor(rows, "lsm").withColumns({c: F.round(c, 6) for c in ("PxSzX", "PxSzY")})


@query(
    "m24_vendor_lif",
    """SELECT p_partkey AS "Measu", p_name AS "Label", p_size * 0.5 AS "Cycle", 1000.0 / (p_size * 0.5) AS "SampFreq", p_retailprice AS "PxSzX",
p_retailprice AS "PxSzY", p_partkey * 86400.5 AS "UTC", p_brand AS "DBB1" FROM part""",
)
def _(spark, sf):
    ticks = F.lit(116444736000000000) + (F.col("p_partkey") * 86400.5 * 10000000).cast("long")
    rows = M.table(spark, sf, "part").select(
        F.col("p_partkey").alias("measu"), F.col("p_name").alias("Label"), (F.col("p_size") * 0.5).alias("Cycle"),
        F.col("p_retailprice").alias("PxSzX"), F.hex(ticks).alias("TimeStamp"), F.col("p_brand").alias("file"),
    )
    return L.from_vendor(rows, "lif")


@query(
    "m24_vendor_ome",
    """SELECT o_orderkey AS "Measu", o_orderpriority AS "Label", o_totalprice AS "Cycle", 488 AS "Lambda", epoch_us(o_orderdate) / 1000000.0 + 0.25 AS "UTC",
1.0 AS "PxSzX", 2.0 AS "PxSzY", o_clerk AS "DBB1", o_orderstatus AS "dbb2" FROM (SELECT *, 'c' || CAST(o_custkey AS VARCHAR) AS o_clerk FROM orders)""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS measu", "o_orderpriority AS Label", "o_totalprice AS GDMfreq", "488 AS Lambda",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") AS AcquisitionDate", "0.25D AS first_frame_s", "1.0D AS PsSzX", "2.0D AS PsSzY",
        "concat('c', o_custkey) AS dbb1", "o_orderstatus AS dbb2",
    )
    return L.from_vendor(rows, "ome")


@query(
    "m25_usable_recordings",
    "SELECT p_partkey AS measu FROM part WHERE p_size % 4 <> 0 AND p_partkey % 3 = 0",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu",
        "CASE p_size % 4 WHEN 0 THEN 'Snapshot_1' ELSE concat(p_type, '_', p_brand) END AS label",
        "CASE p_partkey % 3 WHEN 0 THEN '0 200 400' WHEN 1 THEN '12' ELSE '(No calibration available)' END AS timing_ms",
    )
    return L.usable_recordings(rows).select("measu")


@query(
    "m26_label_odour",
    """SELECT p_partkey AS measu, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'unknown' END AS odour,
CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '-' || CAST(p_size AS VARCHAR) END AS oconc FROM part""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu",
        "concat(CASE WHEN p_size % 2 = 0 THEN concat('A01_', p_type) ELSE p_type END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('_-', p_size) END) AS label",
    )
    return L.with_label_odour(rows).select("measu", "odour", "oconc")


@query("m27_zero_based", "SELECT p_partkey AS measu, p_size - 1 AS stim_on, p_size + 9 AS stim_off, p_name || '_zero_based' AS comment FROM part")
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr("p_partkey AS measu", "p_size AS stim_on", "p_size + 10 AS stim_off", "p_name AS comment")
    return L.zero_based(rows)


@query(
    "m28_path_parts",
    """SELECT page_id, regexp_extract(p, '([^/]+?)(\\.[^./]*)?$', 1) AS animal, regexp_replace(substr(p, 7), '\\.[^./]*$', '') AS relative FROM
(SELECT page_id, '/data/' || replace(split_part(url, '/', 3), '.', '_') || '/' || CAST(page_id AS VARCHAR) || '.lif' AS p FROM pages)""",
)
def _(spark, sf):
    path = F.concat(
        F.lit("\\data\\"), F.replace(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit("_")), F.lit("\\"),
        F.col("page_id").cast("string"), F.lit(".lif"),
    )
    rows = M.table(spark, sf, "pages").select("page_id", path.alias("p"))
    return rows.select("page_id", X.animal_of_path("p").alias("animal"), X.relative_path("p", "/data").alias("relative"))


@query(
    "m29_first_existing_path",
    sql_over("meas", body="""SELECT measu, CASE WHEN measu % 4 = 0 THEN '/data/f' || CAST(measu AS VARCHAR) || '.pst'
  WHEN measu % 4 = 1 THEN '/data/' || animal || '_x/' || animal || '_x.pst/f' || CAST(measu AS VARCHAR) || '.pst'
  WHEN measu % 4 = 2 THEN '/data/' || animal || '/f' || CAST(measu AS VARCHAR) END AS existing_path FROM meas"""),
)
def _(spark, sf):
    rows = meas(spark, sf).selectExpr("measu", "concat(animal, '_x') AS animal", "concat('f', measu) AS dbb1")
    files = meas(spark, sf).selectExpr(
        "explode(CASE measu % 4 WHEN 0 THEN array(concat('/data/f', measu, '.pst'), concat('/data/', animal, '_x/f', measu)) "
        "WHEN 1 THEN array(concat('/data/', animal, '_x/', animal, '_x.pst/f', measu, '.pst')) "
        "WHEN 2 THEN array(concat('/data/', animal, '/f', measu)) ELSE array('/elsewhere') END) AS path"
    )
    return L.first_existing(rows, files, "measu", [".pst"], "/data").select("measu", "existing_path")


@query("m30_measurement_label", sql_over("meas", body="SELECT measu, animal || '_' || CAST(measu AS VARCHAR) || '_' || label AS full_label FROM meas"))
def _(spark, sf):
    return L.measurement_labels(meas(spark, sf), ["label"]).select("measu", "full_label")


@query(
    "m31_unique_labels",
    sql_over("meas", body=""", r AS (SELECT measu, label, row_number() OVER (PARTITION BY label ORDER BY measu) - 1 AS i FROM meas)
SELECT measu, label || CASE WHEN i > 0 THEN '(' || CAST(i AS VARCHAR) || ')' ELSE '' END AS unique_label FROM r"""),
)
def _(spark, sf):
    return L.unique_labels(meas(spark, sf).select("measu", "label")).select("measu", "unique_label")


@query(
    "m32_foreign_times",
    sql_over("meas", body="""SELECT measu, utc AS from_excel, utc AS from_filetime, utc + 1.5 AS from_iso FROM meas"""),
)
def _(spark, sf):
    day = (F.col("utc") / 86400).cast("long")
    rows = meas(spark, sf).select(
        "measu", (day + 25569).cast("double").alias("serial"),
        F.hex(F.col("utc").cast("long") * 10000000 + F.lit(116444736000000000)).alias("filetime"),
        F.concat(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T00:00:00")).alias("iso"),
    )
    return rows.select(
        "measu", X.excel_seconds("serial").alias("from_excel"), X.filetime_seconds("filetime").alias("from_filetime"), X.iso_seconds("iso", 1.5).alias("from_iso")
    )


@query("m33_path_separators", "SELECT page_id, url AS path FROM pages")
def _(spark, sf):
    rows = M.table(spark, sf, "pages").select("page_id", F.replace("url", F.lit("/"), F.lit("\\")).alias("path"))
    return rows.select("page_id", X.slashes("path").alias("path"))


@query("m34_load_recordings", sql_over("meas", "pixels", body="SELECT measu, x, y, label, round(sum(v), 4) AS total FROM pixels JOIN meas USING (measu) GROUP BY ALL"))
def _(spark, sf):
    out = L.loaded(meas(spark, sf).select("measu", "label"), M.traces(spark, sf))
    return out.select("measu", "x", "y", "label", F.round(F.aggregate("trace", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(
    "m35_latest_file",
    """SELECT o_custkey AS folder, arg_max('f' || CAST(o_orderkey AS VARCHAR) || '.LST', struct_pack(a := o_orderdate, b := 'f' || CAST(o_orderkey AS VARCHAR) || '.LST')) AS path
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def _(spark, sf):
    files = M.table(spark, sf, "orders").selectExpr(
        "o_custkey AS folder", "concat('f', o_orderkey, '.LST') AS path", "o_orderdate AS modified",
        "concat('f', o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '.LST' ELSE '.lst.bak' END) AS name",
    )
    return L.latest_matching(files, r"f\d+\.lst", ["folder"])


@query(
    "m36_binned_metadata",
    """SELECT p_partkey AS measu, p_size AS frame_x, p_size * 2 AS frame_y, p_size / 8.0 AS pxszx, p_size / 4.0 AS pxszy,
p_name || '_' || CAST(p_partkey AS VARCHAR) AS label, p_name || '/' || p_name || '_' || CAST(p_partkey AS VARCHAR) || '.tif' AS dbb1 FROM part""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu", "p_partkey AS row_idx", "p_name AS label", "p_size * 2 AS frame_x", "p_size * 4 AS frame_y",
        "p_size * 0.25D AS pxszx", "p_size * 0.5D AS pxszy",
    )
    return L.binned_metadata(rows, 2).select("measu", "frame_x", "frame_y", "pxszx", "pxszy", "label", "dbb1")


@query("s16_rename_columns", """SELECT o_orderpriority AS label, o_orderkey AS measu, o_totalprice AS "GDMfreq", o_custkey FROM orders""")
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr("o_custkey", "o_totalprice AS Cycle", "o_orderkey AS Measu", "o_orderpriority AS Label")
    return L.renamed(rows, "list", "settings")


@query("u2_row_function", sql_over("meas", body="SELECT measu, label || '@' || CAST(CAST(cycle AS BIGINT) AS VARCHAR) AS label, cycle, cycle > 200 AS slow FROM meas WHERE analyze = 1"))
def _(spark, sf):
    rows = L.analysed(meas(spark, sf), [1]).select("measu", "label", "cycle")
    return L.mapped_rows(rows, _note_row, "measu BIGINT, label STRING, cycle DOUBLE, slow BOOLEAN")


@query("u3_row_predicate", sql_over("meas", body="SELECT measu FROM meas WHERE label LIKE '%HIGH%' AND cycle > 150"))
def _(spark, sf):
    return meas(spark, sf).filter(F.col("label").contains("HIGH") & (F.col("cycle") > 150)).select("measu")
