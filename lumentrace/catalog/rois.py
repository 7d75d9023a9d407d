"""Queries for regions (I*) and region files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.features import signal
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.operators import rois as I
from lumentrace.sources import roi_text as RT

NX, NY = 172, 130


def circles(spark, sf):
    return M.table(spark, sf, "supplier").selectExpr(
        "s_name AS roi", "s_suppkey % 180 + 0.34 AS cx", "(s_suppkey * 7) % 130 + 0.41 AS cy", "CAST(5 + s_nationkey AS DOUBLE) AS d"
    )


def polygons(spark, sf):
    x, y = "(s_suppkey % 160)", "((s_suppkey * 7) % 120)"
    return M.table(spark, sf, "supplier").selectExpr(
        "s_name AS roi",
        "array("
        + ", ".join(
            f"named_struct('x', double({x} + {dx}), 'y', double({y} + {dy}))"
            for dx, dy in (("0", "0"), ("6 + s_nationkey", "2"), ("9", "8"), ("-2", "5 + s_nationkey"))
        )
        + ") AS vertices",
    )


def squares(spark, sf):
    return M.table(spark, sf, "supplier").selectExpr(
        "s_name AS roi", "CAST(s_suppkey % 172 AS INT) AS cx", "CAST((s_suppkey * 7) % 130 AS INT) AS cy", "1 + s_nationkey % 5 AS half"
    )


@query(
    "i1_circle_outline",
    """WITH c AS (SELECT s_name AS roi, CAST(s_suppkey % 180 AS INTEGER) AS cx, CAST((s_suppkey * 7) % 130 AS INTEGER) AS cy,
  CAST(trunc((5 + s_nationkey) / 2) AS INTEGER) AS r FROM supplier),
p AS (SELECT roi, cx, cy, r, dx, dy, greatest(abs(dx), abs(dy)) AS a, least(abs(dx), abs(dy)) AS b
  FROM c CROSS JOIN range(-20, 21) u(dx) CROSS JOIN range(-20, 21) w(dy) WHERE abs(dx) <= r AND abs(dy) <= r)
SELECT roi, CAST(cx + dx AS INTEGER) AS x, CAST(cy + dy AS INTEGER) AS y FROM p
WHERE 2 * b * b + a * a + (a - 1) * (a - 1) < 2 * r * r AND 2 * b * b + (a + 1) * (a + 1) + a * a >= 2 * r * r
  AND cx + dx BETWEEN 0 AND 171 AND cy + dy BETWEEN 0 AND 129""",
)
def _(spark, sf):
    return I.circle_pixels(circles(spark, sf), NX, NY)


_POLY = """WITH s AS (SELECT s_name AS roi, s_suppkey % 160 AS bx, (s_suppkey * 7) % 120 AS b_y, s_nationkey AS k FROM supplier),
v AS (SELECT roi, 0 AS i, bx AS x, b_y AS y FROM s UNION ALL SELECT roi, 1, bx + 6 + k, b_y + 2 FROM s
  UNION ALL SELECT roi, 2, bx + 9, b_y + 8 FROM s UNION ALL SELECT roi, 3, bx - 2, b_y + 5 + k FROM s),
e AS (SELECT a.roi, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM v a JOIN v b ON a.roi = b.roi AND b.i = (a.i + 1) % 4),
bb AS (SELECT roi, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v GROUP BY 1),
g AS (SELECT roi, x, y FROM bb CROSS JOIN range(0, 172) a(x) CROSS JOIN range(0, 130) b(y)
  WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1),
t AS (SELECT g.roi, g.x, g.y,
  count(*) FILTER ((py > g.y) <> (qy > g.y) AND g.x < (qx - px) * (g.y - py) / CAST(nullif(qy - py, 0) AS DOUBLE) + px) AS n,
  bool_or((qx - px) * (g.y - py) = (qy - py) * (g.x - px) AND g.x BETWEEN least(px, qx) AND greatest(px, qx)
          AND g.y BETWEEN least(py, qy) AND greatest(py, qy)) AS edge
  FROM g JOIN e USING (roi) GROUP BY ALL)
SELECT roi, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM t WHERE n % 2 = 1 OR edge"""


@query("i2_polygon_fill", _POLY)
def _(spark, sf):
    return I.polygon_pixels(polygons(spark, sf), NX, NY)


_SQUARE = """WITH s AS (SELECT s_name AS roi, s_suppkey % 172 AS cx, (s_suppkey * 7) % 130 AS cy, 1 + s_nationkey % 5 AS h FROM supplier),
sq AS (SELECT roi, CAST(x AS INTEGER) AS x, CAST(129 - y AS INTEGER) AS y FROM s CROSS JOIN range(0, 172) a(x) CROSS JOIN range(0, 130) b(y)
  WHERE abs(x - cx) <= h AND abs(y - cy) <= h)
"""


@query("i3_square", _SQUARE + "SELECT roi, x, y FROM sq")
def _(spark, sf):
    return I.square_pixels(squares(spark, sf), NX, NY)


def footprints(spark, sf):
    """Mean image of every recording."""
    return M.traces(spark, sf).select(
        F.concat(F.lit("f"), F.col("measu").cast("string")).alias("roi"), "x", "y", A.mean(F.col("trace")).alias("f")
    )


_MEANS = ", g AS (SELECT measu, x, y, avg(v) AS v FROM pixels GROUP BY ALL)"
_FOOT = _MEANS + """, f AS (SELECT 'f' || CAST(measu AS VARCHAR) AS roi, x, y, v AS f FROM g),
w AS (SELECT roi, x, y, f / sum(f) OVER (PARTITION BY roi) AS w, f >= quantile_cont(f, 0.75) OVER (PARTITION BY roi) AS member FROM f)
"""


@query("i4_footprint", sql_over("pixels", body=_FOOT + "SELECT roi, x, y, round(w, 9) AS w, member FROM w"))
def _(spark, sf):
    out = I.footprint_weights(footprints(spark, sf))
    return out.select("roi", "x", "y", F.round("w", 9).alias("w"), "member")


@query("i5_label_image", sql_over("pixels", body=_MEANS + " SELECT measu AS roi, x, y FROM g WHERE v - 1000 > 0"))
def _(spark, sf):
    return I.labelled_pixels(M.traces(spark, sf).select(F.col("measu").alias("roi"), "x", "y", (A.mean(F.col("trace")) - 1000).alias("v")))


@query("i6_whole_frame", sql_over("pixels", body="SELECT DISTINCT measu, 'uniform' AS roi, x, y FROM pixels"))
def _(spark, sf):
    return I.whole_frame_roi(M.traces(spark, sf))


_W = """, wt AS (SELECT measu, roi, x, y, 1.0 / count(*) OVER (PARTITION BY measu, roi) AS w FROM roi_px)
"""


@query("i7_weights", sql_over("roi_px", body=_W + "SELECT measu, roi, x, y, round(CAST(w AS DOUBLE), 9) AS w FROM wt"))
def _(spark, sf):
    return I.weighted(M.roi_membership(spark, sf)).select("measu", "roi", "x", "y", F.round("w", 9).alias("w"))


_WIN = ", wi AS (SELECT measu, roi, x, y, w / sum(w) OVER (PARTITION BY measu, roi) AS w FROM wt JOIN area USING (measu, x, y))\n"


@query("i8_weights_within_area", sql_over("roi_px", "area", body=_W + _WIN + "SELECT measu, roi, x, y, round(CAST(w AS DOUBLE), 9) AS w FROM wi"))
def _(spark, sf):
    out = I.weighted_within(I.weighted(M.roi_membership(spark, sf)), M.area(spark, sf))
    return out.select("measu", "roi", "x", "y", F.round("w", 9).alias("w"))


_NEIGH = """, nb AS (SELECT roi, x, y, (SELECT count(*) FROM sq q WHERE q.roi = p.roi AND abs(q.x - p.x) + abs(q.y - p.y) = 1) AS n FROM sq p)
"""


@query("i9_perimeter", _SQUARE + _NEIGH + "SELECT roi, x, y FROM nb WHERE n < 4")
def _(spark, sf):
    return I.perimeter(I.square_pixels(squares(spark, sf), NX, NY))


@query("i10_without_perimeter", _SQUARE + _NEIGH + "SELECT roi, x, y FROM nb WHERE n = 4")
def _(spark, sf):
    return I.without_perimeter(I.square_pixels(squares(spark, sf), NX, NY))


@query(
    "i11_footprint_perimeter",
    sql_over("pixels", body=_FOOT + """, m AS (SELECT roi, x, y FROM w WHERE member)
SELECT p.roi, p.x, p.y FROM m p LEFT JOIN m q ON q.roi = p.roi AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL HAVING count(q.x) < 4"""),
)
def _(spark, sf):
    return I.footprint_perimeter(footprints(spark, sf))


@query("i12_roi_traces", sql_over("roi_tr", body="SELECT measu, roi, t, round(v, 6) AS v FROM roi_tr"))
def _(spark, sf):
    out = I.roi_trace_points(signal(spark, sf), I.weighted(M.roi_membership(spark, sf)))
    return out.withColumn("v", F.round("v", 6))


@query(
    "i12_roi_traces_within_area",
    sql_over("dff", "roi_px", "area", body=_W + _WIN + "SELECT measu, roi, t, round(sum(w * v), 6) AS v FROM dff JOIN wi USING (measu, x, y) GROUP BY ALL"),
)
def _(spark, sf):
    weights = I.weighted_within(I.weighted(M.roi_membership(spark, sf)), M.area(spark, sf))
    return I.roi_trace_points(signal(spark, sf), weights).withColumn("v", F.round("v", 6))


@query(
    "i12_roi_traces_lineitem",
    """SELECT l_suppkey AS measu, l_linenumber AS roi, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 28 AS INTEGER) AS t,
round(sum(l_quantity * l_extendedprice), 2) AS v, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    """Long-form region traces over the largest table: one map-side combined shuffle."""
    frame = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 28).cast("int")
    pixels = M.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("measu"), F.col("l_linenumber").alias("roi"), frame.alias("t"),
        F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("v"),
    )
    out = I.weighted_points(pixels, F.count(F.lit(1)).alias("n"))
    return out.withColumn("v", F.round("v", 2))


@query("i13_mask_mean", sql_over("pixels", "area", body="SELECT measu, t, round(avg(v), 6) AS v FROM pixels JOIN area USING (measu, x, y) GROUP BY ALL"))
def _(spark, sf):
    return I.mask_mean(M.traces(spark, sf), M.area(spark, sf)).withColumn("v", F.round("v", 6))


@query(
    "i14_descriptions",
    sql_over("roi_px", body="""SELECT measu, roi, count(*) AS n_pixels,
'File: labels; Pixels: ' || CAST(count(*) AS VARCHAR) || '; Label;' || roi || ';embedding label' AS glo_info FROM roi_px GROUP BY measu, roi"""),
)
def _(spark, sf):
    return I.descriptions(M.roi_membership(spark, sf), "labels", "embedding label")


@query(
    "i15_last_definition",
    """SELECT p_brand AS roi, min(p_partkey) AS line_no, arg_max(p_size, p_partkey) AS cx, arg_max(p_name, p_partkey) AS text FROM part GROUP BY 1""",
)
def _(spark, sf):
    shapes = M.table(spark, sf, "part").selectExpr("p_brand AS roi", "p_partkey AS line_no", "p_size AS cx", "p_name AS text")
    return I.last_definitions(shapes)


@query(
    "i16_relabel",
    """SELECT n_name AS roi, s_suppkey AS roi_idx, r FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) a
JOIN (SELECT 'S' || CAST(s_suppkey * 2 AS VARCHAR) AS n_name, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) b USING (r)""",
)
def _(spark, sf):
    suppliers = M.table(spark, sf, "supplier")
    rois = suppliers.selectExpr("s_name AS roi", "s_suppkey AS roi_idx", "s_suppkey + 1 AS r")
    labels = suppliers.selectExpr("s_suppkey AS label_idx", "concat('S', s_suppkey * 2) AS label")
    return I.relabelled(rois, labels)


@query("i17_label_inventory", sql_over("roi_px", body="SELECT measu, roi AS label, count(*) AS n_pixels FROM roi_px GROUP BY ALL HAVING count(*) > 1"))
def _(spark, sf):
    return I.label_inventory(M.roi_membership(spark, sf).withColumnRenamed("roi", "label"))


@query(
    "i18_shift_rois",
    sql_over("roi_px", body="SELECT measu, roi, CAST((x + measu % 4) % 10 AS INTEGER) AS x, CAST((y + 10 - measu % 3) % 10 AS INTEGER) AS y FROM roi_px"),
)
def _(spark, sf):
    members = M.roi_membership(spark, sf)
    moves = M.traces(spark, sf).select("measu").distinct().selectExpr("measu", "measu % 4 * 2 AS shift_x", "measu % 3 * -2 AS shift_y")
    return I.shifted_rois(members, moves, 10, 10, shrink=2).select("measu", "roi", "x", "y")


@query("i19_duplicate_ids", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return I.duplicate_ids(M.table(spark, sf, "part"), "p_name")


def _source(spark, sf, number, shapes):
    out = I.roi_pixels(Params(roi_source=number), shapes, NX, NY)
    return out.withColumn("w", F.round("w", 9))


def in_two_files(shapes):
    """The same labels in two files: two regions each."""
    return shapes.withColumn("file", F.explode(F.array(F.lit("a.roi"), F.lit("b.roi"))))


@query("i20_source_0_coor", """WITH s AS (SELECT s_name AS roi, s_suppkey % 172 AS cx, (s_suppkey * 7) % 130 AS cy FROM supplier),
sq AS (SELECT roi, CAST(x AS INTEGER) AS x, CAST(129 - y AS INTEGER) AS y FROM s CROSS JOIN range(0, 172) a(x) CROSS JOIN range(0, 130) b(y)
  WHERE abs(x - cx) <= 5 AND abs(y - cy) <= 5)
SELECT f AS file, roi, x, y, round(CAST(1.0 / count(*) OVER (PARTITION BY f, roi) AS DOUBLE), 9) AS w FROM sq, (VALUES ('a.roi'), ('b.roi')) v(f)""")
def _(spark, sf):
    return _source(spark, sf, 0, in_two_files(squares(spark, sf)))


@query("i20_source_2_area_labels", sql_over("pixels", body=_MEANS + """, l AS (SELECT measu, 'm' || CAST(measu % 3 AS VARCHAR) AS roi, x, y FROM g WHERE v - 1000 > 0)
SELECT measu, roi, x, y, round(CAST(1.0 / count(*) OVER (PARTITION BY measu, roi) AS DOUBLE), 9) AS w FROM l"""))
def _(spark, sf):
    label = F.concat(F.lit("m"), (F.col("measu") % 3).cast("string"))
    image = M.traces(spark, sf).select("measu", label.alias("roi"), "x", "y", (A.mean(F.col("trace")) - 1000).alias("v"))
    return _source(spark, sf, 2, image)


@query("i20_source_3_text", _POLY.replace("SELECT roi, CAST(x", "SELECT roi, round(CAST(1.0 / count(*) OVER (PARTITION BY roi) AS DOUBLE), 9) AS w, CAST(x"))
def _(spark, sf):
    shapes = polygons(spark, sf).selectExpr("roi", "'polygon' AS kind", "CAST(NULL AS DOUBLE) AS cx", "CAST(NULL AS DOUBLE) AS cy", "CAST(NULL AS DOUBLE) AS d", "vertices")
    return _source(spark, sf, 3, shapes)


@query("i20_source_4_footprints", sql_over("pixels", body=_FOOT + "SELECT roi, x, y, round(w, 9) AS w FROM w"))
def _(spark, sf):
    return _source(spark, sf, 4, footprints(spark, sf))


@query("i20_source_5_area_footprints", sql_over("pixels", body=_MEANS + """, f AS (SELECT measu, 'area' AS roi, x, y, v AS f FROM g)
SELECT measu, roi, x, y, round(f / sum(f) OVER (PARTITION BY measu), 9) AS w FROM f"""))
def _(spark, sf):
    image = M.traces(spark, sf).select("measu", F.lit("area").alias("roi"), "x", "y", A.mean(F.col("trace")).alias("f"))
    return _source(spark, sf, 5, image)


@query("i20_source_6_whole_frame", sql_over("pixels", body=""", g AS (SELECT DISTINCT measu, x, y FROM pixels)
SELECT measu, 'uniform' AS roi, x, y, round(CAST(1.0 / count(*) OVER (PARTITION BY measu) AS DOUBLE), 9) AS w FROM g"""))
def _(spark, sf):
    return _source(spark, sf, 6, M.traces(spark, sf))


@query(
    "i20_file_precedence",
    """WITH f AS (SELECT 'own' || CAST(o_orderkey AS VARCHAR) AS file, 1 AS folder, CAST(o_orderkey AS VARCHAR) AS stem FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT 'animal' || CAST(c_custkey AS VARCHAR), 0, 'a' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'late' || CAST(c_custkey AS VARCHAR), 1, 'a' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT DISTINCT 'all' || o_orderpriority, 2, o_orderpriority FROM orders),
m AS (SELECT o_orderkey AS measu, file, folder, CASE stem WHEN CAST(o_orderkey AS VARCHAR) THEN 0 WHEN 'a' || CAST(o_custkey AS VARCHAR) THEN 1 ELSE 2 END AS level
  FROM orders JOIN f ON stem = CAST(o_orderkey AS VARCHAR) OR stem = 'a' || CAST(o_custkey AS VARCHAR) OR stem = o_orderpriority),
c AS (SELECT measu, file FROM m QUALIFY row_number() OVER (PARTITION BY measu ORDER BY folder, level, file) = 1)
SELECT measu, file, 'r' || CAST(i AS VARCHAR) AS roi, CAST(length(file) * (i + 1) AS INTEGER) AS cx, CAST(i + 3 AS INTEGER) AS cy
FROM c CROSS JOIN range(0, 3) r(i) WHERE i <= length(file) % 3""",
)
def _(spark, sf):
    """Region files for single recordings, for animals (in two folders) and for all, each with one to three regions."""
    orders, customers = (M.table(spark, sf, t) for t in ("orders", "customer"))
    recordings = orders.selectExpr("o_orderkey AS measu", "CAST(o_orderkey AS STRING) AS label", "concat('a', o_custkey) AS animal", "o_orderpriority AS general")
    own = orders.filter("o_orderkey % 5 = 0").selectExpr("concat('own', o_orderkey) AS file", "1 AS folder", "CAST(o_orderkey AS STRING) AS stem")
    animal = customers.filter("c_custkey % 3 = 0").selectExpr("concat('animal', c_custkey) AS file", "0 AS folder", "concat('a', c_custkey) AS stem")
    late = customers.filter("c_custkey % 4 = 0").selectExpr("concat('late', c_custkey) AS file", "1 AS folder", "concat('a', c_custkey) AS stem")
    general = orders.selectExpr("concat('all', o_orderpriority) AS file", "2 AS folder", "o_orderpriority AS stem").distinct()
    files = own.unionByName(animal).unionByName(late).unionByName(general)
    shapes = files.select("file", F.explode(F.sequence(F.lit(0), F.length("file") % 3)).alias("i")).selectExpr(
        "file", "concat('r', i) AS roi", "length(file) * (i + 1) AS cx", "i + 3 AS cy"
    )
    return I.chosen_shapes(recordings, files, shapes, ["label", "animal", "general"]).select("measu", "file", "roi", "cx", "cy")


@query("i21_area_of_rois", sql_over("roi_px", body="SELECT DISTINCT measu, x, y FROM roi_px WHERE roi IN ('r1', 'r4', 'r7')"))
def _(spark, sf):
    return I.area_of_rois(M.roi_membership(spark, sf), ["r1", "r4", "r7"])


_CIRCLE_LINE = r"""printf('circle\t%s\t%.2f\t%.2f\t%.2f', s_name, s_suppkey % 180 + 0.34, (s_suppkey * 7) % 130 + 0.41, CAST(5 + s_nationkey AS DOUBLE))"""


@query(
    "s8_parse_roi_text",
    """SELECT s_name AS roi, 'circle' AS kind, round(CAST(s_suppkey % 180 + 0.34 AS DOUBLE), 2) AS cx, round(CAST((s_suppkey * 7) % 130 + 0.41 AS DOUBLE), 2) AS cy,
CAST(5 + s_nationkey AS DOUBLE) AS d, NULL AS n_vertices FROM supplier
UNION ALL SELECT s_name, 'polygon', NULL, NULL, NULL, 4 FROM supplier""",
)
def _(spark, sf):
    shapes = circles(spark, sf).selectExpr("roi", "'circle' AS kind", "cx", "cy", "d", "CAST(NULL AS array<struct<x:double,y:double>>) AS vertices")
    polys = polygons(spark, sf).selectExpr("roi", "'polygon' AS kind", "CAST(NULL AS DOUBLE) AS cx", "CAST(NULL AS DOUBLE) AS cy", "CAST(NULL AS DOUBLE) AS d", "vertices")
    both = shapes.withColumns({c: F.col(c).cast("double") for c in ("cx", "cy")}).unionByName(polys)
    lines = both.select(RT.roi_lines(both).alias("value"))
    parsed = RT.parse_roi_lines(lines)
    return parsed.select("roi", "kind", "cx", "cy", "d", F.when(F.col("vertices").isNotNull(), F.size("vertices")).alias("n_vertices"))


@query(
    "s9_roi_text_lines",
    """SELECT 'circle' || chr(9) || s_name || chr(9) || printf('%.2f', CAST(s_suppkey % 180 + 0.34 AS DOUBLE)) || chr(9) ||
printf('%.2f', CAST((s_suppkey * 7) % 130 + 0.41 AS DOUBLE)) || chr(9) || printf('%.2f', CAST(5 + s_nationkey AS DOUBLE)) AS line FROM supplier""",
)
def _(spark, sf):
    shapes = circles(spark, sf).withColumns(
        {"kind": F.lit("circle"), "vertices": F.lit(None).cast("array<struct<x:double,y:double>>"),
         "cx": F.col("cx").cast("double"), "cy": F.col("cy").cast("double")}
    )
    return shapes.select(RT.roi_lines(shapes).alias("line"))


@query(
    "s10_parse_coor",
    """SELECT 'f' || CAST(s_suppkey // 5 AS VARCHAR) AS file, s_name AS roi, CAST(s_suppkey % 172 AS INTEGER) AS cx, CAST((s_suppkey * 7) % 130 AS INTEGER) AS cy,
CAST(s_suppkey % 5 AS INTEGER) AS roi_idx FROM supplier WHERE s_suppkey % 5 < 4""",
)
def _(spark, sf):
    """Files of five lines below a count of four, parsed back: the fifth line is unused."""
    suppliers = M.table(spark, sf, "supplier")
    line = F.concat_ws("\t", F.col("s_suppkey") % 172, (F.col("s_suppkey") * 7) % 130, F.col("s_name"))
    file = F.concat(F.lit("f"), F.expr("s_suppkey div 5").cast("string")).alias("file")
    body = suppliers.select(file, (F.col("s_suppkey") % 5 + 1).alias("line_no"), line.alias("value"))
    heads = suppliers.filter("s_suppkey % 5 = 0").select(file, F.lit(0).cast("long").alias("line_no"), F.lit("4").alias("value"))
    return RT.parse_coor_lines(heads.unionByName(body))
