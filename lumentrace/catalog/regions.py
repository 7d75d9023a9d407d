"""Queries for region-trace tables (H*, S5-S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.features import backgrounds, signal
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.operators import gdm as H
from lumentrace.operators import rois as I
from lumentrace.operators import stimuli as T
from lumentrace.plans import recipes
from lumentrace.sources import gdm_csv as CSV

P = Params()
CHUNK = P.with_(chunk_pre_s=0.3, chunk_post_s=0.5, first_frame=1, last_frame=3)


def roi_traces(spark, sf):
    return recipes.region_signals(signal(spark, sf), M.roi_membership(spark, sf), None, P)


def metadata(spark, sf):
    rows = M.measurements(spark, sf).select("measu", "animal", "label")
    facts = backgrounds(spark, sf).join(T.onsets(M.stimuli(spark, sf)), "measu", "left")
    return facts.join(rows, "measu")


def full(spark, sf, params=P):
    text = I.descriptions(M.roi_membership(spark, sf), "labels", "embedding label")
    return H.full_traces(roi_traces(spark, sf), metadata(spark, sf), text, params)


def indexed_full(spark, sf):
    """Rows numbered by recording and region: ten regions at most per recording."""
    number = (F.col("measu") * 10 + F.substring("roi", 2, 2).cast("int")).cast("long")
    return full(spark, sf).withColumn("idx", number)


_H1 = """, h AS (SELECT measu, roi, avg(v) FILTER (t BETWEEN 44 AND 46) - avg(v) FILTER (t BETWEEN 24 AND 26) AS ctv,
  count(*) AS n_frames, sum(v) AS total, max(v) FILTER (t = 63) AS last FROM roi_tr GROUP BY ALL),
np AS (SELECT measu, roi, count(*) AS n FROM roi_px GROUP BY ALL)
"""


@query(
    "h1_full_trace_table",
    sql_over(
        "roi_tr", "meas",
        body=_H1
        + """SELECT animal, measu, roi, label, 'File: labels; Pixels: ' || CAST(n AS VARCHAR) || '; Label;' || roi || ';embedding label' AS glo_info,
0.0 AS t_start_s, 200.0 AS period_ms, CAST(n_frames AS INTEGER) AS n_frames, round(total, 6) AS total, round(ctv, 6) AS ctv
FROM h JOIN np USING (measu, roi) JOIN meas USING (measu)""",
    ),
)
def full_trace_table(spark, sf):
    return full(spark, sf).select(
        "animal", "measu", "roi", "label", "glo_info", "t_start_s", "period_ms", "n_frames",
        F.round(A.total(F.col("trace")), 6).alias("total"), F.round("ctv", 6).alias("ctv"),
    )


@query(
    "h1_feature_22and35",
    sql_over(
        "roi_tr", "meas",
        body=""", o AS (SELECT measu, CAST(trunc(on_ms / (100 + 50 * (measu % 5))) AS INTEGER) AS o FROM onset),
k AS (SELECT measu, o + 1 AS s, least(CAST(trunc((on_ms + 3000) / (100 + 50 * (measu % 5))) AS INTEGER) + 1, 63) AS e FROM o JOIN onset USING (measu)),
pk AS (SELECT measu, roi, any_value(s) AS s, arg_min(t, struct_pack(a := -v, b := t)) AS m FROM roi_tr JOIN k USING (measu) WHERE t BETWEEN s AND e GROUP BY ALL),
w AS (SELECT measu, roi, least(greatest(m, 1), 62) AS m, least(greatest(s - 1, 1), 62) AS b FROM pk),
c35 AS (SELECT measu, roi, avg(v) FILTER (t BETWEEN m - 1 AND m + 1) - avg(v) FILTER (t BETWEEN b - 1 AND b + 1) AS c35
  FROM roi_tr JOIN w USING (measu, roi) GROUP BY ALL),
h AS (SELECT measu, roi, avg(v) FILTER (t BETWEEN 44 AND 46) - avg(v) FILTER (t BETWEEN 24 AND 26) AS c22 FROM roi_tr JOIN meas USING (measu) GROUP BY ALL)
SELECT measu, roi, 100.0 + 50 * (measu % 5) AS period_ms, 2 AS n_values, round(c22, 6) AS first, round(c35, 6) AS second FROM h LEFT JOIN c35 USING (measu, roi)""",
    ),
)
def _(spark, sf):
    """Every value of a feature with two, at the period of each recording."""
    text = I.descriptions(M.roi_membership(spark, sf))
    own = M.measurements(spark, sf).select("measu", F.col("cycle").alias("period_ms"))
    facts = metadata(spark, sf).join(own, "measu")
    out = H.full_traces(roi_traces(spark, sf), facts, text, P.with_(feature="22and35"))
    first, second = (F.round(F.col("ctvs")[i], 6).alias(name) for i, name in enumerate(("first", "second")))
    return out.select("measu", "roi", "period_ms", F.size("ctvs").alias("n_values"), first, second)


_H2 = """, b AS (SELECT measu, stim_idx, odor, conc, on_ms, off_ms, greatest(0, CAST(round_even((on_ms - 300) / 200, 0) AS INTEGER)) AS s,
  least(64, CAST(round_even((off_ms + 500) / 200, 0) AS INTEGER)) AS e FROM stimuli),
c AS (SELECT roi_tr.measu, roi, stim_idx, any_value(odor) AS odour, any_value(conc) AS oconc, any_value(off_ms - on_ms) AS stim_len_ms,
  any_value(on_ms - s * 200) AS stim_on_ms, any_value(s * 200 / 1000) AS t_start_s, count(v) FILTER (t BETWEEN s AND e) AS n_frames,
  sum(v) FILTER (t BETWEEN s AND e) AS total,
  CASE WHEN count(v) FILTER (t BETWEEN s AND e) >= 5 THEN avg(v) FILTER (t BETWEEN s + 2 AND s + 4) - avg(v) FILTER (t BETWEEN s AND s + 2) END AS ctv
  FROM roi_tr JOIN b USING (measu) GROUP BY ALL)
"""


@query(
    "h2_chunk_table",
    sql_over(
        "roi_tr", "stimuli",
        body=_H2
        + """SELECT measu, roi, stim_idx, odour, oconc, stim_len_ms, round(stim_on_ms, 6) AS stim_on_ms, round(t_start_s, 6) AS t_start_s,
CAST(n_frames AS INTEGER) AS n_frames, round(total, 6) AS total, round(ctv, 6) AS ctv FROM c""",
    ),
)
def _(spark, sf):
    out = H.region_table(CHUNK.with_(output_type="chunks_only"), roi_traces(spark, sf), None, None, M.stimuli(spark, sf))
    total = F.when(F.col("n_frames") > 0, A.total(F.col("trace")))
    return out.select(
        "measu", "roi", "stim_idx", "odour", "oconc", "stim_len_ms", F.round("stim_on_ms", 6).alias("stim_on_ms"),
        F.round("t_start_s", 6).alias("t_start_s"), "n_frames", F.round(total, 6).alias("total"),
        F.round(F.nanvl("ctv", F.lit(None).cast("double")), 6).alias("ctv"),
    )


@query(
    "h2_chunk_extremes",
    sql_over("roi_tr", "stimuli", body=_H2 + "SELECT measu, roi, stim_idx, 3 AS n_values FROM c"),
)
def _(spark, sf):
    out = H.chunks(roi_traces(spark, sf), M.stimuli(spark, sf), CHUNK.with_(feature="chunk_magnitude_basic"))
    return out.select("measu", "roi", "stim_idx", F.size("ctvs").alias("n_values"))


@query(
    "h2_chunk_background",
    sql_over(
        "roi_tr", "stimuli", "bg",
        body=_H2
        + """, k AS (SELECT r.measu, r.roi, b.stim_idx, r.t - b.s AS i, r.v, bg_start, bg_end FROM roi_tr r JOIN b ON b.measu = r.measu AND r.t BETWEEN b.s AND b.e
  JOIN bg ON bg.measu = r.measu),
m AS (SELECT measu, roi, stim_idx, avg(v) FILTER (i BETWEEN bg_start AND bg_end) AS v FROM k GROUP BY ALL)
SELECT c.measu, c.roi, c.stim_idx, round(m.v, 6) AS ctv FROM c LEFT JOIN m USING (measu, roi, stim_idx)""",
    ),
)
def _(spark, sf):
    """Feature 303 of chunks reads the background frames of the recording."""
    out = H.chunks(roi_traces(spark, sf), M.stimuli(spark, sf), CHUNK.with_(feature=303))
    return out.select("measu", "roi", "stim_idx", F.round(F.nanvl("ctv", F.lit(None).cast("double")), 6).alias("ctv"))


@query(
    "h3_output_switch",
    sql_over("roi_tr", "stimuli", "meas", body=_H2 + """, f AS (SELECT measu, roi, count(*) AS n, sum(v) AS total FROM roi_tr JOIN meas USING (measu) GROUP BY ALL)
SELECT 'full_traces' AS output, measu, roi, CAST(NULL AS INTEGER) AS stim_idx, CAST(n AS INTEGER) AS n_frames, round(total, 6) AS total FROM f
UNION ALL SELECT 'chunks_only', measu, roi, stim_idx, CAST(n_frames AS INTEGER), round(total, 6) FROM c"""),
)
def _(spark, sf):
    """Both tables: full traces, and chunks by stimulus."""
    text = I.descriptions(M.roi_membership(spark, sf))
    params, parts = CHUNK.with_(first_frame=25, last_frame=45), []
    for kind in ("full_traces", "chunks_only"):
        out = H.region_table(params.with_(output_type=kind), roi_traces(spark, sf), metadata(spark, sf), text, M.stimuli(spark, sf))
        pulse = F.col("stim_idx") if kind == "chunks_only" else F.lit(None).cast("int").alias("stim_idx")
        total = F.round(F.when(F.col("n_frames") > 0, A.total(F.col("trace"))), 6).alias("total")
        parts.append(out.select(F.lit(kind).alias("output"), "measu", "roi", pulse, "n_frames", total))
    return parts[0].unionByName(parts[1])


@query(
    "h4_append_tables",
    """WITH a AS (SELECT s_suppkey AS idx, s_name AS roi, CAST(NULL AS VARCHAR) AS note FROM supplier), m AS (SELECT max(idx) AS m FROM a)
SELECT idx, roi, note FROM a UNION ALL SELECT m + row_number() OVER (ORDER BY p_partkey), p_name, p_brand FROM part, m""",
)
def _(spark, sf):
    first = M.table(spark, sf, "supplier").selectExpr("s_suppkey AS idx", "s_name AS roi")
    second = M.table(spark, sf, "part").selectExpr("p_partkey AS idx", "p_name AS roi", "p_brand AS note")
    return H.appended(first, second)


@query("h5_subset_by_index", "SELECT p_partkey AS idx, p_name FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)")
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr("p_partkey AS idx", "p_name")
    return H.subset(rows, M.table(spark, sf, "supplier").selectExpr("s_suppkey AS idx"))


@query("h6_subset_by_condition", sql_over("roi_tr", "meas", body=_H1 + "SELECT measu, roi, round(ctv, 6) AS ctv FROM h JOIN meas USING (measu) WHERE ctv > 0"))
def _(spark, sf):
    return H.where(full(spark, sf), F.col("ctv") > 0).select("measu", "roi", F.round("ctv", 6).alias("ctv"))


@query("h7_row_by_index", sql_over("roi_tr", "meas", body=_H1 + "SELECT 13 AS idx, measu, roi, round(total, 6) AS total FROM h JOIN meas USING (measu) WHERE measu = 1 AND roi = 'r3'"))
def _(spark, sf):
    return H.row(indexed_full(spark, sf), 13).select("idx", "measu", "roi", F.round(A.total(F.col("trace")), 6).alias("total"))


@query("h8_matrix", sql_over("roi_tr", "meas", body="SELECT measu * 10 + CAST(substr(roi, 2) AS INTEGER) AS idx, t, round(v, 6) AS v FROM roi_tr JOIN meas USING (measu)"))
def _(spark, sf):
    out = H.matrix(indexed_full(spark, sf))
    return A.unrolled(out, "idx").withColumn("v", F.round("v", 6))


@query("h9_export_attributes", sql_over("roi_tr", "meas", body=_H1 + """SELECT measu, roi, 0.0 AS "TraceOffset", 200.0 AS "Cycle", CAST(n_frames AS INTEGER) AS "NumFrames" FROM h JOIN meas USING (measu)"""))
def _(spark, sf):
    return H.export_attributes(full(spark, sf)).select("measu", "roi", "TraceOffset", "Cycle", "NumFrames")


@query("h10_clean_line", "SELECT p_partkey, p_type AS line FROM part")
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_type, '_', p_brand, '_x') ELSE p_type END AS line")
    return H.cleaned_line(rows)


@query(
    "h11_time_axis",
    sql_over("roi_tr", "stimuli", body=_H2 + """SELECT r.measu, r.roi, stim_idx, r.t - CAST(s AS INTEGER) AS t, round(s * 200 / 1000 + (r.t - s) * 200 / 1000, 6) AS time_s, round(v, 6) AS v
FROM roi_tr r JOIN b ON b.measu = r.measu AND r.t BETWEEN s AND e"""),
)
def _(spark, sf):
    out = H.with_time_axis(H.chunks(roi_traces(spark, sf), M.stimuli(spark, sf), CHUNK), "measu", "roi", "stim_idx")
    return out.withColumns({"time_s": F.round("time_s", 6), "v": F.round("v", 6)})


def ragged(spark, sf):
    """Region traces of several lengths: those of odd recordings end after 60 frames."""
    even = F.col("measu") % 2 == 0
    rows = full(spark, sf).withColumn("n_frames", F.when(even, F.col("n_frames")).otherwise(60))
    return rows.withColumn("trace", F.when(even, F.col("trace")).otherwise(F.slice("trace", 1, 60)))


_RAGGED = "(measu % 2 = 0 OR t < 60)"


@query("h12_wide_to_long", sql_over("roi_tr", "meas", body=f"SELECT measu, roi, t AS frame, round(v, 6) AS value FROM roi_tr JOIN meas USING (measu) WHERE {_RAGGED}"))
def _(spark, sf):
    wide = CSV.to_wide(ragged(spark, sf).select("measu", "roi", "trace")).drop("PlaceHolder")
    return H.wide_to_long(wide).withColumn("value", F.round("value", 6))


@query(
    "h13_compare_sources",
    sql_over("roi_tr", "meas", body="""SELECT measu, roi, t AS frame, round(v, 6) AS "signal", CASE WHEN v > 0 THEN round(v * 100, 4) END AS percent FROM roi_tr JOIN meas USING (measu)"""),
)
def _(spark, sf):
    long = A.unrolled(full(spark, sf), "measu", "roi").withColumnRenamed("t", "frame")
    plain = long.withColumn("value", F.round("v", 6))
    percent = long.filter(F.col("v") > 0).withColumn("value", F.round(F.col("v") * 100, 4))
    return H.compared({"signal": plain, "percent": percent}, ["measu", "roi", "frame"])


@query("h14_export_loop", sql_over("roi_tr", "meas", body=_H1 + "SELECT animal, measu, roi, round(ctv, 6) AS ctv FROM h JOIN meas USING (measu) WHERE analyze IN (1, -1)"))
def _(spark, sf):
    accepted = M.measurements(spark, sf).filter(F.col("analyze").isin(1, -1)).select("measu")
    return full(spark, sf).join(accepted, "measu", "left_semi").select("animal", "measu", "roi", F.round("ctv", 6).alias("ctv"))


@query(
    "h15_legacy_table",
    sql_over("roi_tr", "meas", body=f"""SELECT measu AS "NMeasu", roi AS "NGloTag", 200.0 AS "NGDMfreq", CASE WHEN measu % 2 = 0 THEN 64 ELSE 60 END AS "NFrames",
animal AS "TAnimal", label AS "TLabel", t, CASE WHEN {_RAGGED} THEN round(v, 6) END AS v FROM roi_tr JOIN meas USING (measu)"""),
)
def _(spark, sf):
    """All frames of all rows; the short ones end in nulls."""
    out = H.legacy_table(ragged(spark, sf)).drop("NCTV")
    long = A.unrolled(out, *[c for c in out.columns if c != "frames"], trace="frames")
    return long.withColumn("v", F.round("v", 6))


def wide_text(spark, sf):
    """The wide table as its lines of text say it, all cells being text."""
    rows = ragged(spark, sf).select(
        F.col("measu").alias("Measu"), F.col("roi").alias("GloTag"), F.col("animal").alias("Animal"),
        F.concat("label", F.lit("_x")).alias("line"), F.col("n_frames").alias("NumFrames"), "trace",
    )
    wide = CSV.to_wide(rows)
    lines = wide.select(CSV.wide_lines(wide).alias("value"))
    return CSV.parse_wide(lines, [c for c in wide.columns if c != "frames"])


@query(
    "s5_read_wide_table",
    sql_over("roi_tr", "meas", body=f"""SELECT CAST(measu AS VARCHAR) AS "Measu", roi AS "GloTag", label AS line, t, round(v, 6) AS v FROM roi_tr JOIN meas USING (measu) WHERE {_RAGGED}"""),
)
def _(spark, sf):
    table = CSV.from_wide(wide_text(spark, sf))
    return A.unrolled(table, "Measu", "GloTag", "line").withColumn("v", F.round("v", 6))


@query(
    "s6_metadata_only",
    sql_over("roi_tr", "meas", body=_H1 + """SELECT CAST(measu AS VARCHAR) AS "Measu", roi AS "GloTag", animal AS "Animal", label AS line, CASE WHEN measu % 2 = 0 THEN '64' ELSE '60' END AS "NumFrames" FROM h JOIN meas USING (measu)"""),
)
def _(spark, sf):
    return CSV.metadata_only(wide_text(spark, sf))


@query(
    "s7_wide_table",
    sql_over("roi_tr", "meas", body=f"""SELECT CAST(measu AS VARCHAR) AS "Measu", roi AS "GloTag", 'Trace begins->' AS "PlaceHolder", t, CASE WHEN {_RAGGED} THEN round(v, 6) END AS v FROM roi_tr JOIN meas USING (measu)"""),
)
def _(spark, sf):
    """Every frame cell of every line, empty ones included."""
    cells = wide_text(spark, sf).withColumn("frames", F.col("frames").cast("array<double>"))
    long = A.unrolled(cells, "Measu", "GloTag", "PlaceHolder", trace="frames")
    return long.withColumn("v", F.round("v", 6))
