"""Queries for overview and movie numerics (O*, S18, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.corrections import gauss_sql, kernel_sql
from lumentrace.catalog.features import _C22, _C35_CTES, backgrounds, context, signal, with_context
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.operators import filters as R
from lumentrace.operators import overview as O
from lumentrace.operators import rois as I
from lumentrace.operators import stimuli as T
from lumentrace.plans import recipes
from lumentrace.sources import export as EX
from lumentrace.plans.skew import with_facts

P = Params()


def overview(spark, sf):
    """C22 image of every recording."""
    frames = O.overview_frames(with_context(spark, sf), 22, context(), 0)
    return frames.select("measu", "x", "y", F.col("value").alias("v"))


def movie(spark, sf):
    return R.exploded(signal(spark, sf))


def rnd(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_OV = f", ov AS (SELECT measu, x, y, {_C22} AS v FROM dff GROUP BY measu, x, y)\n"


@query(
    "o1_overview_features",
    sql_over("dff", body=_C35_CTES + "SELECT p.measu, p.x, p.y, 1 AS feature, round(value, 6) AS value FROM (SELECT DISTINCT measu, x, y FROM dff) p LEFT JOIN c35 USING (measu, x, y)"),
)
def _(spark, sf):
    return rnd(O.overview_frames(with_context(spark, sf), "22and35", context(), [1]), "value")


@query(
    "o2_feature_by_stimulus",
    sql_over(
        "dff", "stimuli",
        body="""
, k AS (SELECT measu, stim_idx, CAST(trunc(on_ms / 200) AS INTEGER) + 1 AS s, least(CAST(trunc((on_ms + 3000) / 200) AS INTEGER) + 1, 63) AS e FROM stimuli),
pk AS (SELECT measu, x, y, stim_idx, any_value(s) AS s, arg_min(t, struct_pack(a := -v, b := t)) AS m FROM dff JOIN k USING (measu) WHERE t BETWEEN s AND e GROUP BY measu, x, y, stim_idx),
w AS (SELECT measu, x, y, stim_idx, least(greatest(m, 1), 62) AS m, least(greatest(s - 1, 1), 62) AS b FROM pk),
c AS (SELECT measu, x, y, stim_idx, avg(v) FILTER (t BETWEEN m - 1 AND m + 1) - avg(v) FILTER (t BETWEEN b - 1 AND b + 1) AS value
      FROM dff JOIN w USING (measu, x, y) GROUP BY ALL)
SELECT p.measu, p.x, p.y, k.stim_idx, 0 AS feature, round(value, 6) AS value FROM (SELECT DISTINCT measu, x, y FROM dff) p JOIN k USING (measu)
LEFT JOIN c USING (measu, x, y, stim_idx)""",
    ),
)
def _(spark, sf):
    return rnd(O.overview_grid(signal(spark, sf), M.stimuli(spark, sf), 35, P), "value")


@query("o3_border_crop", sql_over("dff", body=_OV + "SELECT measu, x - 2 AS x, y - 2 AS y, round(v, 6) AS v FROM ov WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7"))
def _(spark, sf):
    return rnd(O.cropped(overview(spark, sf), 2, 10, 10), "v")


def two_sizes(spark, sf):
    """Overviews of two cameras: odd recordings are 10 x 8 pixels; with the size on every row."""
    pixels = overview(spark, sf)
    facts = M.traces(spark, sf).select("measu").distinct().selectExpr("measu", "10 AS nx", "CASE WHEN measu % 2 = 0 THEN 10 ELSE 8 END AS ny")
    return with_facts(pixels, facts).filter("y < ny")


_INNER = "x BETWEEN 2 AND 7 AND y BETWEEN 2 AND CASE WHEN measu % 2 = 0 THEN 7 ELSE 5 END"


@query("o3_border_crop_two_sizes", sql_over("dff", body=_OV + f"SELECT measu, x - 2 AS x, y - 2 AS y, round(v, 6) AS v FROM ov WHERE {_INNER}"))
def _(spark, sf):
    return rnd(O.cropped(two_sizes(spark, sf), 2, F.col("nx"), F.col("ny")).drop("nx", "ny"), "v")


@query(
    "o5_limits_centre_two_sizes",
    sql_over("dff", body=_OV + """SELECT measu, round(min(v), 6) AS vmin, round(max(v), 6) AS vmax FROM ov
WHERE x BETWEEN 2 AND 7 AND y BETWEEN CASE WHEN measu % 2 = 0 THEN 2 ELSE 1 END AND CASE WHEN measu % 2 = 0 THEN 7 ELSE 6 END GROUP BY 1"""),
)
def _(spark, sf):
    out = O.data_limits(two_sizes(spark, sf), P.with_(individual_scale=3), F.col("nx"), F.col("ny"))
    return out.withColumns({c: F.round(c, 6) for c in ("vmin", "vmax")})


@query("o3_exclusion_mask", sql_over("pixels", body="SELECT DISTINCT measu, x, y, NOT (x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7) AS excluded FROM pixels"))
def _(spark, sf):
    return O.exclusion_mask(M.traces(spark, sf), 2, 10, 10)


@query("o4_frame_crop", sql_over("dff", body="SELECT measu, x - 1 AS x, y - 1 AS y, t, round(v, 6) AS v FROM dff WHERE t BETWEEN 10 AND 40 AND x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8"))
def _(spark, sf):
    cut = O.cropped_movie(signal(spark, sf), P.with_(movie_first_frame=10, movie_last_frame=40, cut_border=1), 10, 10, 64)
    return rnd(A.unrolled(cut, "measu", "x", "y", "first_frame").select("measu", "x", "y", (F.col("t") + F.col("first_frame")).alias("t"), "v"), "v")


def _limits(name, changes, sql, source="overview"):
    @query(name, sql)
    def _(spark, sf):
        pixels = overview(spark, sf) if source == "overview" else movie(spark, sf)
        out = O.data_limits(pixels, P.with_(**changes), 10, 10, M.area(spark, sf))
        return rnd(out, "vmin", "vmax")


_limits("o5_limits_fixed", {"individual_scale": 1}, sql_over("dff", body="SELECT DISTINCT measu, -0.08 AS vmin, 0.3 AS vmax FROM dff"))
_limits("o5_limits_data", {"individual_scale": 2}, sql_over("dff", body=_OV + "SELECT measu, round(min(v), 6) AS vmin, round(max(v), 6) AS vmax FROM ov GROUP BY 1"))
_limits(
    "o5_limits_centre", {"individual_scale": 3},
    sql_over("dff", body=_OV + "SELECT measu, round(min(v), 6) AS vmin, round(max(v), 6) AS vmax FROM ov WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7 GROUP BY 1"),
)
_limits("o5_limits_fixed_min", {"individual_scale": 14}, sql_over("dff", body=_OV + "SELECT measu, -0.08 AS vmin, round(max(v), 6) AS vmax FROM ov GROUP BY 1"))
_limits(
    "o5_limits_area", {"individual_scale": 25},
    sql_over("dff", "area", body=_OV + "SELECT measu, round(min(v), 6) AS vmin, round(max(v), 6) AS vmax FROM ov JOIN area USING (measu, x, y) GROUP BY 1"),
)
_limits(
    "o5_limits_area_fixed_min", {"individual_scale": 6},
    sql_over("dff", "area", body=_OV + "SELECT measu, -0.08 AS vmin, round(max(v), 6) AS vmax FROM ov JOIN area USING (measu, x, y) GROUP BY 1"),
)
_limits(
    "o5_limits_percentile_movie", {"individual_scale": 2, "percentile_scale": True, "percentile_value": 20.0},
    sql_over("dff", body=""", r AS (SELECT measu, v, row_number() OVER (PARTITION BY measu ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY measu) AS n FROM dff)
SELECT measu, round(max(v) FILTER (r = CAST(round_even((n - 1) * 0.2, 0) AS BIGINT)), 6) AS vmin, round(max(v) FILTER (r = CAST(round_even((n - 1) * 0.8, 0) AS BIGINT)), 6) AS vmax
FROM r GROUP BY 1"""),
    source="movie",
)

_LIM = ", lim AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM ov GROUP BY 1)\n"


@query(
    "o6_normalise",
    sql_over("dff", body=_OV + _LIM + """SELECT measu, x, y, round((v - lo) / (hi - lo), 6) AS lin,
round(CASE WHEN v >= 0 THEN 0.5 + 0.5 * v / hi ELSE 0.5 * (v - lo) / (0 - lo) END, 6) AS bilin,
round((v + greatest(-lo, hi)) / (2 * greatest(-lo, hi)), 6) AS sym FROM ov JOIN lim USING (measu)"""),
)
def _(spark, sf):
    pixels = overview(spark, sf).withColumns({"lin": F.col("v"), "bilin": F.col("v"), "sym": F.col("v")})
    limits = O.data_limits(pixels, P.with_(individual_scale=2), 10, 10)
    joined = O.join_per_key(pixels, limits, ["measu"])
    low, high = F.col("vmin"), F.col("vmax")
    out = joined.withColumns({n: O.normalised(F.col("v"), low, high, s) for n, s in (("lin", 2), ("bilin", 12), ("sym", 22))})
    return rnd(out.select("measu", "x", "y", "lin", "bilin", "sym"), "lin", "bilin", "sym")


@query(
    "o7_threshold_mask",
    sql_over("dff", body=_OV + _LIM + "SELECT measu, x, y, v > lo + 0.01 * 60 * (hi - lo) OR v < -0.02 AS shown FROM ov JOIN lim USING (measu)"),
)
def _(spark, sf):
    return O.threshold_mask(overview(spark, sf), "r60", "a-0.02").select("measu", "x", "y", "shown")


def _mask(name, on, sql):
    @query(name, sql)
    def _(spark, sf):
        params = P.with_(threshold_on=on, threshold_positive="r55", threshold_negative="r20")
        raw = R.exploded(M.traces(spark, sf))
        out = O.masked_movie(movie(spark, sf), params, raw, R.morphology(M.traces(spark, sf)), M.area(spark, sf))
        return out.select("measu", "x", "y", "t", "shown")


_THRESH = "(m.v > lo + 0.01 * 55 * (hi - lo) OR m.v < lo + 0.01 * 20 * (hi - lo)) AND a.x IS NOT NULL AS shown"
_mask("o8_mask_none", "none", sql_over("dff", "area", body="SELECT m.measu, m.x, m.y, m.t, a.x IS NOT NULL AS shown FROM dff m LEFT JOIN area a USING (measu, x, y)"))
_mask(
    "o8_mask_foto", "foto1",
    sql_over("dff", "area", body=f""", f AS (SELECT measu, x, y, avg(v) AS v FROM pixels WHERE t BETWEEN 1 AND 5 GROUP BY ALL), l AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1)
SELECT d.measu, d.x, d.y, d.t, {_THRESH} FROM dff d JOIN f m USING (measu, x, y) JOIN l USING (measu) LEFT JOIN area a USING (measu, x, y)"""),
)
_mask(
    "o8_mask_raw", "raw1",
    sql_over("pixels", "area", body=f""", l AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1)
SELECT m.measu, m.x, m.y, m.t, {_THRESH} FROM pixels m JOIN l USING (measu) LEFT JOIN area a USING (measu, x, y)"""),
)
_mask(
    "o8_mask_signal", "sig1",
    sql_over("dff", "area", body=f""", l AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM dff GROUP BY 1)
SELECT m.measu, m.x, m.y, m.t, {_THRESH} FROM dff m JOIN l USING (measu) LEFT JOIN area a USING (measu, x, y)"""),
)


@query(
    "o9_background_limits",
    sql_over("dff", "area", body=_OV + """, m AS (SELECT o.*, a.x IS NOT NULL AS shown FROM ov o LEFT JOIN area a USING (measu, x, y)),
l AS (SELECT measu, min(v) FILTER (NOT shown) AS lo, max(v) FILTER (NOT shown) AS hi, min(v) AS lo2, max(v) AS hi2 FROM m GROUP BY 1)
SELECT measu, x, y, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) AS only_shown, round((v - lo2) / (hi2 - lo2), 6) AS whole FROM m JOIN l USING (measu)"""),
)
def _(spark, sf):
    members = M.area(spark, sf).withColumn("shown", F.lit(True))
    pixels = overview(spark, sf).join(members, ["measu", "x", "y"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    some = O.background_scaled(pixels, "onlyShown").withColumnRenamed("background", "only_shown")
    out = O.background_scaled(some, "full").withColumnRenamed("background", "whole")
    return rnd(out.select("measu", "x", "y", "only_shown", "whole"), "only_shown", "whole")


@query(
    "o10_composite",
    sql_over("dff", body=_OV + ", f AS (SELECT measu, x, y, avg(v) AS f FROM pixels WHERE t BETWEEN 1 AND 5 GROUP BY ALL)\nSELECT measu, x, y, round(CASE WHEN v > 0 THEN v ELSE f END, 6) AS v FROM ov JOIN f USING (measu, x, y)"),
)
def _(spark, sf):
    foto = R.morphology(M.traces(spark, sf)).withColumnRenamed("v", "f")
    both = overview(spark, sf).join(foto, ["measu", "x", "y"])
    return rnd(both.select("measu", "x", "y", O.composed(F.col("v") > 0, F.col("v"), F.col("f")).alias("v")), "v")


@query(
    "o11_colours",
    sql_over("dff", body=_OV + _LIM + """, s AS (SELECT measu, x, y, floor((v - lo) / (hi - lo) * 255) / 255.0 * 3 AS s FROM ov JOIN lim USING (measu))
SELECT measu, x, y, CAST(floor(least(s, 1) * 255 + 0.5) AS INTEGER) AS r, CAST(floor(least(greatest(s - 1, 0), 1) * 255 + 0.5) AS INTEGER) AS g,
CAST(floor(greatest(s - 2, 0) * 255 + 0.5) AS INTEGER) AS b FROM s"""),
)
def _(spark, sf):
    pixels = overview(spark, sf)
    scaled = O.scaled_pixels(pixels, O.data_limits(pixels, P.with_(individual_scale=2), 10, 10), 2)
    return scaled.select("measu", "x", "y", O.colour(F.col("v"), "heat").alias("c")).select("measu", "x", "y", "c.r", "c.g", "c.b")


@query(
    "o11_standard_colours",
    """WITH n AS (SELECT vec_id, CAST(greatest(least(floor(abs(CAST(embedding[1] AS DOUBLE)) * 255), 255), 0) AS INTEGER) AS i FROM embeddings),
h AS (SELECT vec_id, 255 / 360.0::DOUBLE * (1 - i / 255.0::DOUBLE) * 6.0::DOUBLE AS h FROM n),
f AS (SELECT vec_id, CAST(trunc(h) AS INTEGER) AS k, h - trunc(h) AS f FROM h),
c AS (SELECT vec_id, k, 1 - f AS q, 1 - (1 - f) AS t FROM f)
SELECT vec_id, CAST(floor(255 * (CASE WHEN k IN (0, 5) THEN 1 WHEN k = 1 THEN q WHEN k = 4 THEN t ELSE 0 END) + 0.5) AS INTEGER) AS r,
CAST(floor(255 * (CASE WHEN k = 0 THEN t WHEN k IN (1, 2) THEN 1 WHEN k = 3 THEN q ELSE 0 END) + 0.5) AS INTEGER) AS g,
CAST(floor(255 * (CASE WHEN k = 2 THEN t WHEN k IN (3, 4) THEN 1 WHEN k = 5 THEN q ELSE 0 END) + 0.5) AS INTEGER) AS b FROM c""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "embeddings").select("vec_id", F.abs(F.col("embedding")[0].cast("double")).alias("v"))
    return rows.select("vec_id", O.colour(F.col("v"), "standard").alias("c")).select("vec_id", "c.r", "c.g", "c.b")



@query("o12_stack_frame", sql_over("dff", body=_OV + "SELECT measu, x, y, round(v, 6) AS v, CAST(t AS INTEGER) AS t FROM ov CROSS JOIN range(0, 12) r(t)"))
def _(spark, sf):
    return rnd(O.stacked(overview(spark, sf), 12), "v")


@query(
    "o13_rotate",
    sql_over("pixels", body=""", p AS (SELECT DISTINCT measu, x, y FROM pixels),
m(code, swp, b, a) AS (VALUES (0, 0, 0, 0), (1, 1, 1, 0), (2, 0, 1, 1), (3, 1, 0, 1), (4, 1, 0, 0), (5, 0, 0, 1), (6, 1, 1, 1), (7, 0, 1, 0)),
q AS (SELECT code, measu, x AS x0, y AS y0, CASE WHEN swp = 1 THEN y ELSE x END AS x, CASE WHEN swp = 1 THEN x ELSE y END AS y, a, b FROM p CROSS JOIN m)
SELECT code, measu, x0, y0, CASE WHEN a = 0 THEN 9 - x ELSE x END AS x, CASE WHEN b = 1 THEN 9 - y ELSE y END AS y FROM q"""),
)
def _(spark, sf):
    base = M.traces(spark, sf).select("measu", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"))
    out = None
    for code in range(8):
        part = O.rotated(base, code, 10, 10, reverse=True).withColumn("code", F.lit(code))
        out = part if out is None else out.unionByName(part)
    return out


@query("o14_output_image", sql_over("dff", body=_OV + _LIM + """SELECT measu, 9 - y AS "row", x AS "column", CAST(trunc((v - lo) / (hi - lo) * 255) AS INTEGER) AS v FROM ov JOIN lim USING (measu)"""))
def _(spark, sf):
    pixels = overview(spark, sf)
    scaled = O.scaled_pixels(pixels, O.data_limits(pixels, P.with_(individual_scale=2), 10, 10), 2)
    return O.output_pixels(scaled, 10)


@query(
    "o15_mark_rois",
    sql_over("dff", "roi_px", body=_OV + """, n AS (SELECT p.measu, p.roi, p.x, p.y, count(q.x) AS n FROM roi_px p LEFT JOIN roi_px q
  ON q.measu = p.measu AND q.roi = p.roi AND abs(q.x - p.x) + abs(q.y - p.y) = 1 GROUP BY ALL),
c AS (SELECT roi, dense_rank() OVER (ORDER BY roi) - 1 AS c FROM (SELECT DISTINCT roi FROM roi_px))
SELECT o.measu, o.x, o.y, n.x IS NOT NULL AS marked, round(coalesce(CAST(c AS DOUBLE), v), 6) AS v FROM ov o LEFT JOIN (SELECT * FROM n JOIN c USING (roi) WHERE n < 4) n USING (measu, x, y)"""),
)
def _(spark, sf):
    members = M.roi_membership(spark, sf)
    colours = O.roi_colours(members)
    outlines = I.perimeter(members).join(colours, "roi").withColumn("roi_order", F.col("colour"))
    return rnd(O.marked_rois(overview(spark, sf), outlines), "v")


@query(
    "o16_movie_table",
    sql_over(
        "dff", "area", "stimuli",
        body=""", l AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM dff JOIN area USING (measu, x, y) WHERE x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND t BETWEEN 10 AND 50 GROUP BY 1),
o AS (SELECT measu, min(on_ms) AS first FROM stimuli GROUP BY 1),
st AS (SELECT d.measu, d.t, arg_min(odor || '@' || CAST(conc AS VARCHAR), stim_idx) AS s FROM (SELECT DISTINCT measu, t FROM dff) d JOIN stimuli s ON s.measu = d.measu AND on_ms <= d.t * 200 AND off_ms >= d.t * 200 GROUP BY 1, 2)
SELECT d.measu, d.x - 1 AS x, d.y - 1 AS y, d.t, round((least(greatest(v, lo), hi) - lo) / (hi - lo), 6) AS v, a.x IS NOT NULL AS shown, s AS stimulus_text,
CASE WHEN d.t * 200 - coalesce(first, 0) < 0 THEN '-' ELSE '' END || printf('%2d', CAST(round_even(abs(d.t * 200 - coalesce(first, 0)) / 1000, 0) AS INTEGER)) || ' s' AS time_text
FROM dff d JOIN l USING (measu) LEFT JOIN o USING (measu) LEFT JOIN area a USING (measu, x, y) LEFT JOIN st ON st.measu = d.measu AND st.t = d.t
WHERE d.x BETWEEN 1 AND 8 AND d.y BETWEEN 1 AND 8 AND d.t BETWEEN 10 AND 50""",
    ),
)
def _(spark, sf):
    params = P.with_(individual_scale=5, cut_border=1, movie_first_frame=10, movie_last_frame=50)
    out = recipes.movie_table(signal(spark, sf), M.stimuli(spark, sf), params, 10, 10, 64, M.traces(spark, sf), M.area(spark, sf))
    return rnd(out.select("measu", "x", "y", "t", "v", "shown", "stimulus_text", "time_text"), "v")


_T3 = A.gaussian_weights(P.time_filter_size)


@query(
    "o16_movie_filtered",
    sql_over(
        "dff", "stimuli",
        body=kernel_sql("ft", "dff", "t", _T3, -(len(_T3) // 2), "reflect", 64) + gauss_sql("f", "ft", P.space_filter_size, "reflect")
        + """, l AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM fy GROUP BY 1),
rl AS (SELECT measu, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1),
o AS (SELECT measu, min(on_ms) AS first FROM stimuli GROUP BY 1),
c AS (SELECT measu, x, y, t, least(greatest(v, lo), hi) AS v, lo, hi FROM fy JOIN l USING (measu))
SELECT c.measu, c.x, c.y, c.t, round(CASE WHEN NOT (c.lo < 0 AND c.hi > 0) THEN (c.v - c.lo) / (c.hi - c.lo)
  WHEN c.v >= 0 THEN 0.5 + 0.5 * c.v / c.hi ELSE 0.5 * (c.v - c.lo) / (0 - c.lo) END, 6) AS v,
  r.v > rl.lo + 0.01 * 50 * (rl.hi - rl.lo) OR r.v < 0 AS shown,
  CASE WHEN c.t * 200 - coalesce(first, 0) < 0 THEN '-' ELSE '' END || printf('%2d', CAST(round_even(abs(c.t * 200 - coalesce(first, 0)) / 1000, 0) AS INTEGER)) || ' s' AS time_text
FROM c JOIN pixels r USING (measu, x, y, t) JOIN rl ON rl.measu = c.measu LEFT JOIN o ON o.measu = c.measu""",
    ),
)
def _(spark, sf):
    params = P.with_(individual_scale=12, time_filter=True, space_filter=True, threshold_on="raw1", threshold_positive="r50")
    out = recipes.movie_table(signal(spark, sf), M.stimuli(spark, sf), params, 10, 10, 64, M.traces(spark, sf))
    return rnd(out.select("measu", "x", "y", "t", "v", "shown", "time_text"), "v")


@query("o17_frame_rate", sql_over("meas", body="SELECT measu, 2.0 * 1000.0 / cycle AS fps FROM meas"))
def _(spark, sf):
    return M.measurements(spark, sf).select("measu", O.frames_per_second(F.col("cycle"), 2.0).alias("fps"))


@query("o18_value_at_point", sql_over("dff", body=_OV + "SELECT measu, x, y, round(v * 100, 4) AS v FROM ov WHERE x = 4 AND y = 7"))
def _(spark, sf):
    return rnd(O.value_at(overview(spark, sf), 4, 7, 100.0), "v", digits=4)


@query(
    "o19_tapestry_plan",
    """WITH r AS (SELECT conv_id, turn AS row_idx, role || CAST(turn AS VARCHAR) AS row_name, CASE WHEN turn % 3 = 0 THEN 'a' || CAST(conv_id AS VARCHAR) END AS animal,
  CASE WHEN turn % 2 = 0 THEN [conv_id, conv_id + turn, conv_id * 2] END AS measus FROM conversations),
f AS (SELECT conv_id, row_idx, row_name, last_value(animal IGNORE NULLS) OVER w AS animal, last_value(measus IGNORE NULLS) OVER w AS measus FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
u AS (SELECT conv_id, row_idx, row_name, animal, unnest(measus) AS measu, unnest(range(0, 3)) AS position FROM f)
SELECT conv_id, row_idx, row_name, u.animal, CAST(position AS INTEGER) AS position, u.measu, m.o_orderkey IS NULL AS empty FROM u
LEFT JOIN orders m ON m.o_orderkey = u.measu AND 'a' || CAST(m.o_custkey % 200 AS VARCHAR) = u.animal""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn AS row_idx", "concat(role, turn) AS row_name", "CASE WHEN turn % 3 = 0 THEN concat('a', conv_id) END AS animal",
        "CASE WHEN turn % 2 = 0 THEN array(conv_id, conv_id + turn, conv_id * 2) END AS measus",
    )
    known = M.table(spark, sf, "orders").selectExpr("concat('a', o_custkey % 200) AS animal", "o_orderkey AS measu")
    return O.tapestry_plan(rows, known, ["conv_id"])


@query(
    "o20_chosen_by_column",
    sql_over("meas", body=""", w AS (SELECT 'a' || CAST(c_custkey AS VARCHAR) AS animal, 0 AS position, '2-HIGH' AS value FROM customer)
SELECT w.animal, position, value, measu FROM w LEFT JOIN meas m ON m.animal = w.animal AND m.label = value"""),
)
def _(spark, sf):
    wanted = M.table(spark, sf, "customer").selectExpr("concat('a', c_custkey) AS animal", "0 AS position", "'2-HIGH' AS value")
    return O.chosen_by_column(wanted, M.measurements(spark, sf), "label")


@query("o21_common_limits", sql_over("dff", body=_OV + _LIM + "SELECT CAST(round_even(min(lo), 3) AS DOUBLE) AS vmin, CAST(round_even(max(hi), 3) AS DOUBLE) AS vmax FROM lim"))
def _(spark, sf):
    return O.common_limits(O.data_limits(overview(spark, sf), P.with_(individual_scale=2), 10, 10))


@query(
    "o22_three_digits",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
printf('%.3g', l_extendedprice) AS text, printf('%.3g', l_quantity / 7) AS ratio_text FROM lineitem""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
        O.three_digits(F.col("l_extendedprice")).alias("text"), O.three_digits(F.col("l_quantity") / 7).alias("ratio_text"),
    )


def _caption(row: dict) -> str:
    """A user's caption: label and period."""
    return f"{row['label']} / {row['cycle']:.0f} ms"


@query("u4_user_text", sql_over("meas", body="SELECT measu, label || ' / ' || CAST(CAST(cycle AS BIGINT) AS VARCHAR) || ' ms' AS caption FROM meas"))
def _(spark, sf):
    return M.measurements(spark, sf).select("measu", O.user_text(_caption, ["label", "cycle"]).alias("caption"))


@query(
    "o23_plot_bounds",
    sql_over("roi_tr", body="SELECT roi, round(min(v) - 0.1 * (max(v) - min(v)), 6) AS lower, round(max(v) + 0.1 * (max(v) - min(v)), 6) AS upper FROM roi_tr GROUP BY 1"),
)
def _(spark, sf):
    points = I.roi_trace_points(signal(spark, sf), I.weighted(M.roi_membership(spark, sf)))
    return rnd(O.plot_bounds(points, "roi"), "lower", "upper")


@query(
    "o24_scale_codes",
    sql_over("dff", body=_OV + """, r AS (SELECT measu, v, row_number() OVER (PARTITION BY measu ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY measu) AS n FROM ov)
SELECT 130 AS code, measu, round(min(v), 6) AS vmin, round(max(v), 6) AS vmax FROM ov WHERE x BETWEEN 3 AND 6 AND y BETWEEN 3 AND 6 GROUP BY measu
UNION ALL SELECT 1205, measu, round(max(v) FILTER (r = CAST(round_even((n - 1) * 0.05, 0) AS BIGINT)), 6), round(max(v) FILTER (r = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)), 6) FROM r GROUP BY measu"""),
)
def _(spark, sf):
    out = None
    for code in (130, 1205):
        limits = O.data_limits(overview(spark, sf), P.with_(**O.decode_scale(code)), 10, 10).withColumn("code", F.lit(code))
        out = limits if out is None else out.unionByName(limits)
    return rnd(out, "vmin", "vmax")


@query(
    "s18_processed_export",
    sql_over("dff", "meas", body=_OV + """SELECT animal, measu, d.x, 9 - d.y AS y, any_value(label) AS label, round(any_value(ov.v), 6) AS response, round(sum(d.v), 6) AS total
FROM dff d JOIN ov USING (measu, x, y) JOIN meas USING (measu) GROUP BY animal, measu, d.x, d.y"""),
)
def _(spark, sf):
    meta = M.measurements(spark, sf).select("measu", "animal", "label", "cycle")
    frames = overview(spark, sf).withColumnRenamed("v", "value")
    rows = EX.processed_rows(meta, frames, signal(spark, sf), 10)
    return rows.select("animal", "measu", "x", "y", "metadata.label", F.round("response", 6).alias("response"), F.round(A.total(F.col("trace")), 6).alias("total"))


@query("r27_correction_pipeline")
def _(spark, sf):
    params = P.with_(
        replace_init_frames=2, median_filter=1, mean_filter=2, scatter_factor=0.5, scatter_radius_um=2.0, bleach_method="log_uniform",
    )
    facts = backgrounds(spark, sf).select("measu", "bg_start", "bg_end", F.lit(5.0).alias("rate_hz"))
    out = recipes.corrected(M.traces(spark, sf), facts, M.area(spark, sf), params, 10, 10, (2.0, 2.0), frames=64)
    return rnd(R.exploded(out).select("measu", "x", "y", "t", "v"), "v", digits=4)


@query("g6_composite_signal")
def _(spark, sf):
    facts = backgrounds(spark, sf).select("measu", "bg_start", "bg_end", F.lit(5.0).alias("rate_hz"))
    out = recipes.composite_signal(
        M.traces(spark, sf), facts, M.area(spark, sf), P.with_(calc_method=4302, scatter_factor=-0.5), 10, 10, M.traces2(spark, sf), (2.0, 2.0), frames=64
    )
    return rnd(R.exploded(out).select("measu", "x", "y", "t", "v"), "v", digits=5)


@query(
    "g6_composite_no_bleach",
    sql_over(
        "pixels", "pixels2", "area", "bg",
        body="""
, b AS (SELECT measu, x, y, avg(p.v) FILTER (t < bg_end) AS b1, avg(q.v) FILTER (t < bg_end) AS b2, avg(p.v) AS e1, avg(q.v) AS e2
  FROM pixels p JOIN pixels2 q USING (measu, x, y, t) JOIN bg USING (measu) WHERE t BETWEEN bg_start AND bg_end GROUP BY ALL),
r AS (SELECT measu, x, y, t, (p.v / e1) / (q.v / e2) * (b1 / b2) AS r FROM pixels p JOIN pixels2 q USING (measu, x, y, t) JOIN b USING (measu, x, y)),
m AS (SELECT measu, x, y, avg(r) AS m FROM r JOIN bg USING (measu) WHERE t >= bg_start AND t < bg_end GROUP BY ALL)
SELECT measu, x, y, t, round(r - m, 6) AS v FROM r JOIN m USING (measu, x, y)""",
    ),
)
def _(spark, sf):
    facts = backgrounds(spark, sf).select("measu", "bg_start", "bg_end", F.lit(5.0).alias("rate_hz"))
    out = recipes.composite_signal(M.traces(spark, sf), facts, M.area(spark, sf), P.with_(calc_method=4900), 10, 10, M.traces2(spark, sf), frames=64)
    return rnd(R.exploded(out).select("measu", "x", "y", "t", "v"), "v")
