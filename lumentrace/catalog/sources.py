"""Queries for scans and sinks that need no files of their own (S*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.features import long
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.operators import filters as R
from lumentrace.operators import measurements as L
from lumentrace.sources import lists as LS
from lumentrace.sources import movements as MV
from lumentrace.sources import stacks as ST


HEADER = "Label  \tMeasu \t Cycle\tOdour   "


def list_text(spark, sf):
    """Orders as tab text with blanks after the separators."""
    cells = [F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_totalprice"), F.lit("not set yet")]
    return M.table(spark, sf, "orders").select(F.array_join(F.array(*[c.cast("string") for c in cells]), "\t  ").alias("value"))


@query("s1_read_list", """SELECT o_orderpriority AS "Label", o_orderkey AS "Measu", o_totalprice AS "Cycle", 'not set yet' AS "Odour" FROM orders""")
def _(spark, sf):
    return LS.parse_list(list_text(spark, sf), HEADER).withColumns({"Measu": F.col("Measu").cast("long"), "Cycle": F.col("Cycle").cast("double")})


@query("s3_convert_list", """SELECT o_orderpriority || chr(9) || CAST(o_orderkey AS VARCHAR) || chr(9) || 'not set yet' AS line FROM orders""")
def _(spark, sf):
    """The list under the names of the settings, written again as lines."""
    renamed = L.renamed(LS.parse_list(list_text(spark, sf), HEADER), "list", "settings").select("label", "measu", "odorants")
    return renamed.select(LS.list_lines(renamed).alias("line"))


@query(
    "s11_decode_stacks",
    """WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, embedding FROM embeddings)
SELECT vec_id AS measu, CAST(i % 8 AS INTEGER) AS x, CAST(1 - (i // 8) % 2 AS INTEGER) AS y, CAST(i // 16 AS INTEGER) AS t,
floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 10000) % 65536 AS v FROM v""",
)
def _(spark, sf):
    """Vectors as stacks of 8 x 2 pixels and 4 frames, packed to little-endian bytes and decoded."""
    counts = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 10000) % 65536).cast("int"))
    two = lambda n: F.lpad(F.hex(n), 2, "0")
    packed = F.transform(counts, lambda n: F.concat(two(n % 256), two(F.floor(n / 256))))
    jobs = M.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("measu"), F.lit(8).alias("width"), F.lit(2).alias("height"), F.lit(4).alias("frames"),
        F.unhex(F.array_join(packed, "")).alias("content"),
    )
    return A.unrolled(ST.decode_stacks(jobs), "measu", "x", "y")


@query("s2_column_order", 'SELECT o_orderpriority AS "Label", o_orderkey AS "Measu", o_custkey FROM orders')
def _(spark, sf):
    rows = M.table(spark, sf, "orders").selectExpr("o_custkey", "o_orderkey AS Measu", "o_orderpriority AS Label")
    return LS.ordered_columns(rows, ["Label", "Measu", "Odour"])


@query(
    "s4_combine_metadata",
    "SELECT s_suppkey AS measu, s_name AS label, NULL AS cycle FROM supplier UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 3",
)
def _(spark, sf):
    first = M.table(spark, sf, "supplier").selectExpr("s_suppkey AS measu", "s_name AS label")
    second = M.table(spark, sf, "part").selectExpr("p_partkey AS measu", "p_name AS label", "p_size AS cycle")
    return LS.combined([first, second], F.col("cycle").isNull() | (F.col("cycle") > 3))


@query("s12_axis_order", sql_over("pixels", body="SELECT measu, y AS x, 9 - x AS y, t, round(v, 6) AS v FROM pixels"))
def _(spark, sf):
    rows = R.exploded(M.traces(spark, sf)).withColumnsRenamed({"x": "row", "y": "column"})
    return ST.axes_normalised(rows, 10).withColumn("v", F.round("v", 6))


def interleaved(spark, sf):
    first = R.exploded(M.traces(spark, sf)).withColumn("w", F.lit(1))
    return first.unionByName(R.exploded(M.traces2(spark, sf)).withColumn("w", F.lit(0)))


@query("s13_split_wavelengths", sql_over("pixels", "pixels2", body="SELECT measu, x, y, t, round(p.v, 6) AS v1, round(q.v, 6) AS v2 FROM pixels p JOIN pixels2 q USING (measu, x, y, t)"))
def _(spark, sf):
    pairs = ST.paired_channels(interleaved(spark, sf))
    return pairs.withColumns({"v1": F.round("v1", 6), "v2": F.round("v2", 6)})


@query(
    "s14_cut_series",
    """WITH s AS (SELECT user_id AS series, event_id AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t FROM events)
SELECT series, t0, t // 12 AS measu, CAST(t % 12 AS INTEGER) AS t FROM s""",
)
def _(spark, sf):
    from lumentrace.plans.ranking import indexed

    rows = M.table(spark, sf, "events").selectExpr("user_id AS series", "event_id AS t0")
    return ST.cut_series(indexed(rows, "t0", groups=["series"], name="t"), 12)


@query(
    "s14_check_series",
    """SELECT user_id AS series, count(*) = (count(*) // 12) * 12 AS complete FROM events GROUP BY 1""",
)
def _(spark, sf):
    events = M.table(spark, sf, "events")
    counts = events.groupBy(F.col("user_id").alias("series")).agg(F.count(F.lit(1)).alias("n"))
    frames = counts.select("series", (F.col("n") - 1).alias("t"))
    return ST.check_series(frames, counts.select("series", F.floor(F.col("n") / 12).alias("n_stim")), 12)


@query(
    "s15_cast_to_range",
    sql_over("pixels", body=""", l AS (SELECT measu, min(v) AS a, max(v) AS b FROM pixels GROUP BY 1)
SELECT measu, x, y, t, CAST(trunc((v - a) / (b - a) * 255) AS INTEGER) AS v FROM pixels JOIN l USING (measu)"""),
)
def _(spark, sf):
    return ST.cast_to_range(R.exploded(M.traces(spark, sf)), "uint8", scale=True)


@query("s17_movement_list", sql_over("pixels", body="SELECT DISTINCT measu, t, t % 4 - 1 AS dx, t % 3 - 1 AS dy, t % 9 AS quality FROM pixels"))
def _(spark, sf):
    """Shifts as the text rows of a movement list, behind an older block, and parsed back."""
    frames = R.exploded(M.traces(spark, sf)).select("measu", "t").distinct()
    shifts = frames.selectExpr("measu", "t", "t % 4 - 1 AS dx", "t % 3 - 1 AS dy", "t % 9 AS quality")
    old = shifts.selectExpr("measu", "t", "9 AS dx", "9 AS dy", "0 AS quality")
    rows = MV.movement_rows(old).withColumn("line_no", F.lit(0)).unionByName(MV.movement_rows(shifts).withColumn("line_no", F.lit(1)))
    return MV.parse_movement_rows(rows)


@query("s19_versions", "SELECT p_partkey, p_name || ' v2' AS p_name, '20240102' AS run_ts FROM part WHERE p_partkey % 3 <> 2")
def _(spark, sf):
    """Four runs: the third was interrupted before its manifest entry, the fourth while its rows were written."""
    parts = M.table(spark, sf, "part").select("p_partkey", "p_name")
    runs, entries = None, None
    for i, (run, kept, shown) in enumerate((("20240101", 3, 3), ("20240102", 2, 2), ("20240103", 3, None), ("20240104", 1, 3)), 1):
        rows = LS.versioned(parts.filter(F.col("p_partkey") % 3 < kept).withColumn("p_name", F.concat("p_name", F.lit(f" v{i}"))), run)
        runs = rows if runs is None else runs.unionByName(rows)
        if shown:
            entry = parts.filter(F.col("p_partkey") % 3 < shown).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run).alias("run_ts"), "rows")
            entries = entry if entries is None else entries.unionByName(entry)
    return LS.newest_complete(runs, entries).select("p_partkey", "p_name", "run_ts")


@query(
    "s20_column_docs",
    """SELECT s_suppkey AS position, s_name AS "column", 'nation ' || CAST(n_nationkey AS VARCHAR) AS description, 'Column ' || CAST(s_suppkey AS VARCHAR) || ': nation ' || CAST(n_nationkey AS VARCHAR) AS line
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT r_regionkey + (SELECT max(s_suppkey) FROM supplier), NULL, r_name, 'Column ' || CAST(r_regionkey + (SELECT max(s_suppkey) FROM supplier) AS VARCHAR) || ': ' || r_name FROM region""",
)
def _(spark, sf):
    suppliers = M.table(spark, sf, "supplier")
    columns = suppliers.selectExpr("s_suppkey AS position", "s_name AS column")
    docs = suppliers.join(M.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_name AS column", "concat('nation ', n_nationkey) AS description"
    )
    extra = M.table(spark, sf, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS position", "r_name AS description")
    return LS.column_docs(columns, docs, extra)


@query(
    "s21_source_choice",
    sql_over("meas", body="""SELECT measu, CASE WHEN measu % 3 = 0 THEN '/data/f' || CAST(measu AS VARCHAR) || '.pst' WHEN measu % 3 = 1 THEN '/data/f' || CAST(measu AS VARCHAR) || '.tif' END AS existing_path FROM meas"""),
)
def _(spark, sf):
    rows = M.measurements(spark, sf).selectExpr("measu", "animal", "concat('f', measu) AS dbb1")
    files = rows.selectExpr("concat('/data/f', measu, CASE measu % 3 WHEN 0 THEN '.pst' WHEN 1 THEN '.tif' ELSE '.xyz' END) AS path")
    return LS.chosen_files(rows, files, 3, "/data").select("measu", "existing_path")


@query(
    "s22_without_list",
    """SELECT DISTINCT split_part(url, '/', 3) AS "Label", 1000.0 / 4 AS "Cycle", '-1' AS "Measu", 'not set yet' AS "Odour" FROM pages""",
)
def _(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    files = M.table(spark, sf, "pages").select(F.concat(F.lit("/raw/"), host, F.lit(".lif")).alias("path"))
    return LS.without_list(files, 4.0).select("Label", "Cycle", "Measu", "Odour")


@query(
    "s23_protocols",
    """WITH p AS (SELECT p_partkey, p_size, unnest([p_type, p_brand, p_name]) AS stimulus, unnest([0, 1, 2]) AS measu FROM part)
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS file, CAST(measu AS INTEGER) AS measu, stimulus, 1000.0 / p_size AS cycle,
'A' || CAST(p_partkey AS VARCHAR) || '_12:30: T' || CAST(p_size AS VARCHAR) AS label, p_size * 3 AS n_frames, -1 AS "analyze", '0' AS lambda_nm FROM p""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("Animal : A"), F.col("p_partkey").cast("string"), F.lit("\nTrial: 12:30: T"), F.col("p_size").cast("string"),
        F.lit("\r\nFPS : "), F.col("p_size").cast("string"),
        F.lit("\nDuration: "), (F.col("p_size") * 3).cast("string"), F.lit("\n\nStimuli : "), F.concat_ws(", ", "p_type", "p_brand", "p_name"),
    )
    texts = M.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"), text.alias("value"))
    return LS.parse_protocols(texts)


@query("t_canonical_traces", sql_over("pixels", body="SELECT measu, x, y, t, round(v, 6) AS v FROM pixels"))
def _(spark, sf):
    """Array form to long form and back."""
    return long(R.collected(R.exploded(M.traces(spark, sf))))
