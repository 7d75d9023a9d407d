"""Queries for pixel corrections (R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.features import backgrounds, long, signal
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.operators import bleach as B
from lumentrace.operators import filters as R
from lumentrace.operators import motion as MO
from lumentrace.operators import rois as I
from lumentrace.operators import stimuli as T
from lumentrace.plans.skew import with_facts

P = Params()


def rounded(pixels, digits: int = 6):
    return pixels.select("measu", "x", "y", "t", F.round("v", digits).alias("v"))


def fold_sql(expr: str, n: int, edge: str) -> str:
    if edge == "nearest":
        return f"least(greatest({expr}, 0), {n - 1})"
    m = f"((({expr}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END)"


def kernel_sql(name: str, src: str, axis: str, weights: list[float], low: int, edge: str, n: int = 10) -> str:
    """One axis of a separable filter as a DuckDB CTE: an offset join."""
    taps = ", ".join(f"({low + k}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(weights))
    cols = ["measu", "x", "y", "t"]
    on = " AND ".join(
        f"q.{c} = p.{c}" if c != axis else f"q.{c} = {fold_sql(f'p.{c} + d', n, edge)}" for c in cols
    )
    return f""", {name} AS (SELECT p.measu, p.x, p.y, p.t, sum(w * q.v) AS v FROM {src} p CROSS JOIN (VALUES {taps}) o(d, w)
  JOIN {src} q ON {on} GROUP BY ALL)
"""


@query(
    "r1_replace_start",
    sql_over("pixels", body="""SELECT p.measu, p.x, p.y, p.t, round(q.v, 6) AS v FROM pixels p JOIN pixels q
ON p.measu = q.measu AND p.x = q.x AND p.y = q.y AND q.t = greatest(p.t, 5)"""),
)
def _(spark, sf):
    return long(M.traces(spark, sf).withColumn("trace", R.replaced_start(F.col("trace"), 5)))


_MEAN_SQL = sql_over(
    "pixels",
    body=kernel_sql("kt", "pixels", "t", [1 / 4] * 4, -2, "nearest", 64)
    + kernel_sql("kx", "kt", "x", [1 / 3] * 3, -1, "nearest")
    + kernel_sql("ky", "kx", "y", [1 / 3] * 3, -1, "nearest")
    + "SELECT measu, x, y, t, round(v, 6) AS v FROM ky",
)


@query("r2_mean_filter", _MEAN_SQL)
def _(spark, sf):
    sizes = R.filter_sizes(3, 3, 4)
    return rounded(R.mean_filter(M.traces(spark, sf), *sizes, frames=64))


_BOX = """, off AS (SELECT dx, dy, dt FROM range(-1, 2) a(dx), range(-1, 2) b(dy), range({lo}, {hi}) c(dt)),
nb AS (SELECT p.measu, p.x, p.y, p.t, q.v, row_number() OVER (PARTITION BY p.measu, p.x, p.y, p.t ORDER BY q.v) - 1 AS k
  FROM pixels p CROSS JOIN off JOIN pixels q ON q.measu = p.measu AND q.x = least(greatest(p.x + dx, 0), 9)
  AND q.y = least(greatest(p.y + dy, 0), 9) AND q.t = least(greatest(p.t + dt, 0), 63))
SELECT measu, x, y, t, round(v, 6) AS v FROM nb WHERE k = {k}"""


@query("r3_median_filter", sql_over("pixels", body=_BOX.format(lo=-1, hi=2, k=13)))
def _(spark, sf):
    return rounded(R.median_filter(M.traces(spark, sf), *R.filter_sizes(3, 3, 3), frames=64))


@query("r4_median_frames", sql_over("pixels", body=_BOX.format(lo=0, hi=1, k=4)))
def _(spark, sf):
    return rounded(R.filter_frames(R.exploded(M.traces(spark, sf)), "median", 3))


@query(
    "r4_mean_trace",
    sql_over("pixels", body=kernel_sql("kt", "pixels", "t", [1 / 3] * 3, -1, "nearest", 64) + "SELECT measu, x, y, t, round(v, 6) AS v FROM kt"),
)
def _(spark, sf):
    return long(M.traces(spark, sf).withColumn("trace", R.filter_trace(F.col("trace"), "mean", 3)))


def gauss_sql(prefix: str, src: str, sigma: float, edge: str) -> str:
    w = A.gaussian_weights(sigma)
    low = -(len(w) // 2)
    return kernel_sql(f"{prefix}x", src, "x", w, low, edge) + kernel_sql(f"{prefix}y", f"{prefix}x", "y", w, low, edge)


@query(
    "r5_gaussian_space",
    sql_over("pixels", body=gauss_sql("g", "pixels", 1.0, "reflect") + "SELECT measu, x, y, t, round(v, 6) AS v FROM gy"),
)
def _(spark, sf):
    return rounded(R.gaussian_frames(R.exploded(M.traces(spark, sf)), 1.0))


_W3 = A.gaussian_weights(3.0)


@query(
    "r6_gaussian_time",
    sql_over("pixels", body=kernel_sql("gt", "pixels", "t", _W3, -(len(_W3) // 2), "reflect", 64)
             + "SELECT measu, x, y, t, round(v, 6) AS v FROM gt"),
)
def _(spark, sf):
    return long(M.traces(spark, sf).withColumn("trace", R.gaussian_trace(F.col("trace"), 3.0)))


_EXCESS = gauss_sql("g", "pixels", 0.8, "nearest") + """, ex AS (SELECT measu, x, y, t, p.v - gy.v AS v FROM pixels p
  JOIN gy USING (measu, x, y, t))
""" + gauss_sql("h", "ex", 0.8, "nearest")


@query(
    "r7_scattered_light",
    sql_over("pixels", body=_EXCESS + "SELECT measu, x, y, t, round(p.v + 1.5 * hy.v, 6) AS v FROM pixels p JOIN hy USING (measu, x, y, t)"),
)
def _(spark, sf):
    sigma = R.scatter_radius(40.0, 40.0, 200.0 / 3)
    return rounded(R.descattered(R.exploded(M.traces(spark, sf)), 1.5, sigma))


@query(
    "r8_scatter_signed",
    sql_over("pixels", body=_EXCESS + """SELECT measu, x, y, t, round(p.v + 0.5 * ex.v, 6) AS high_pass, round(p.v + 0.5 * hy.v, 6) AS scatter
FROM pixels p JOIN ex USING (measu, x, y, t) JOIN hy USING (measu, x, y, t)"""),
)
def _(spark, sf):
    pixels = R.exploded(M.traces(spark, sf))
    high = R.descattered_signed(pixels, 0.5, 0.8).withColumnRenamed("v", "h")
    low = R.descattered_signed(pixels, -0.5, 0.8).withColumnRenamed("v", "s")
    both = high.join(low, ["measu", "x", "y", "t"])
    return both.select("measu", "x", "y", "t", F.round("h", 6).alias("high_pass"), F.round("s", 6).alias("scatter"))


_BLEACH = P.with_(bleach_exclude_seconds=3.0, bleach_initial_factor=2.0)
_WEIGHTS = """, wt AS (SELECT measu, CAST(t AS INTEGER) AS t, CASE WHEN t >= bg_end AND t < least(bg_end + 15, 63) THEN 0.0 WHEN t < 2 THEN 0.0
  WHEN t < bg_end THEN 2.0 ELSE 1.0 END AS w FROM bg, range(0, 64) r(t))
"""


def facts(spark, sf):
    return backgrounds(spark, sf).select("measu", "bg_start", "bg_end", F.lit(5.0).alias("rate_hz"))


@query("r9_bleach_weights", sql_over("bg", body=_WEIGHTS + "SELECT measu, t, CAST(w AS DOUBLE) AS w FROM wt"))
def _(spark, sf):
    w = B.bleach_weights(F.lit(64), F.col("bg_end"), F.col("rate_hz"), _BLEACH, True)
    return A.unrolled(facts(spark, sf), "measu", trace=w, names=("t", "w"))


_CURVE = """, curve AS (SELECT p.measu, p.t, avg(p.v) AS y FROM pixels p GROUP BY ALL)
"""


@query(
    "r10_start_parameters",
    sql_over(
        "pixels",
        body=_CURVE
        + """, b AS (SELECT measu, 1.01 * min(y) - 0.01 * max(y) AS o FROM curve GROUP BY 1)
SELECT measu, round(exp(regr_intercept(ln(y - o), t)), 5) AS a, round(regr_slope(ln(y - o), t), 6) AS k,
       round(any_value(o), 6) AS "offset" FROM curve JOIN b USING (measu) GROUP BY 1""",
    ),
)
def _(spark, sf):
    frames = R.exploded(M.traces(spark, sf)).groupBy("measu", "t").agg(F.avg("v").alias("y"))
    out = B.start_parameters(frames)
    return out.select("measu", F.round("a", 5).alias("a"), F.round("k", 6).alias("k"), F.round("offset", 6).alias("offset"))


@query("r11_fit_parameters")
def _(spark, sf):
    rows = B._with_weights(M.traces(spark, sf), facts(spark, sf), _BLEACH)
    fitted = B.fitted_traces(rows.select("measu", "x", "y", "trace", "weights"), curve="trace")
    return fitted.select("measu", "x", "y", *[F.round(c, 4).alias(c) for c in "akc"])


@query("r12_bleach_pixelwise")
def _(spark, sf):
    out = B.pixelwise(M.traces(spark, sf), facts(spark, sf), M.area(spark, sf), _BLEACH)
    return A.unrolled(out, "measu", "x", "y").withColumn("v", F.round("v", 4))


@query("r13_bleach_uniform")
def _(spark, sf):
    out = B.uniform(M.traces(spark, sf), facts(spark, sf), M.area(spark, sf), _BLEACH)
    return A.unrolled(out, "measu", "x", "y").withColumn("v", F.round("v", 4))


@query(
    "r13_uniform_curve",
    sql_over(
        "dff", "area",
        body=""", rel AS (SELECT measu, x, y, t, v / f0 AS v FROM pixels JOIN f0 USING (measu, x, y))
SELECT measu, t, round(avg(CASE WHEN a.x IS NOT NULL THEN r.v ELSE 0 END), 6) AS v FROM rel r LEFT JOIN area a USING (measu, x, y) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    curve = B.uniform_curves(M.traces(spark, sf), facts(spark, sf), M.area(spark, sf))
    return A.unrolled(curve, "measu").withColumn("v", F.round("v", 6))


@query("r14_bleach_whole_frame")
def _(spark, sf):
    out = B.whole_frame(signal(spark, sf), facts(spark, sf), M.area(spark, sf), _BLEACH, lamp_noise_sigma=5.0)
    return A.unrolled(out, "measu", "x", "y").withColumn("v", F.round("v", 4))


@query(
    "r15_bleach_rectangle",
    sql_over("pixels", body="SELECT DISTINCT measu, x, y FROM pixels WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7"),
)
def _(spark, sf):
    return B.bleach_area(M.traces(spark, sf), M.area(spark, sf), 10, 10, P.with_(bleach_exclude_area=False))


def two_sizes(spark, sf):
    """Movies of two cameras: odd recordings are 10 x 8 pixels; with the size on every row."""
    traces = M.traces(spark, sf)
    facts = traces.select("measu").distinct().selectExpr("measu", "10 AS nx", "CASE WHEN measu % 2 = 0 THEN 10 ELSE 8 END AS ny")
    return with_facts(traces, facts).filter("y < ny")


@query(
    "r15_bleach_rectangle_two_sizes",
    sql_over("pixels", body="SELECT DISTINCT measu, x, y FROM pixels WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND CASE WHEN measu % 2 = 0 THEN 7 ELSE 5 END"),
)
def _(spark, sf):
    return B.bleach_area(two_sizes(spark, sf), M.area(spark, sf), F.col("nx"), F.col("ny"), P.with_(bleach_exclude_area=False))


@query(
    "r18_apply_shift_two_sizes",
    sql_over("pixels", body=""", s AS (SELECT *, CASE WHEN measu % 2 = 0 THEN 10 ELSE 8 END AS ny FROM pixels)
SELECT measu, CAST((x + t % 4 - 1 + 10) % 10 AS INTEGER) AS x, CAST((y + t % 3 - 1 + ny) % ny AS INTEGER) AS y, t, round(v, 6) AS v FROM s WHERE y < ny"""),
)
def _(spark, sf):
    movie = two_sizes(spark, sf)
    pixels = A.unrolled(movie, "measu", "x", "y", "nx", "ny")
    shifts = pixels.select("measu", "t").distinct().selectExpr("measu", "t", "t % 4 - 1 AS dx", "t % 3 - 1 AS dy")
    return rounded(MO.rolled(pixels, shifts, F.col("nx"), F.col("ny")).drop("nx", "ny"))


@query("r15_bleach_area", sql_over("area", body="SELECT measu, x, y FROM area"))
def _(spark, sf):
    return B.bleach_area(M.traces(spark, sf), M.area(spark, sf), 10, 10, P)


@query(
    "r16_area_mask",
    sql_over(
        "pixels",
        body=""", plane AS (SELECT measu, x, y, t * 3 // 64 AS k, avg(v) AS v FROM pixels WHERE measu % 2 = 0 GROUP BY ALL),
pos AS (SELECT measu, x, y FROM plane GROUP BY ALL HAVING bool_or(v - 1002.5 > 0))
SELECT p.measu, p.x, p.y, p.measu % 2 = 1 OR a.x IS NOT NULL AS in_area FROM (SELECT DISTINCT measu, x, y FROM pixels) p
LEFT JOIN pos a USING (measu, x, y)""",
    ),
)
def _(spark, sf):
    pixels = M.traces(spark, sf)
    # Every second recording has an area file: three planes, the mean brightness above 1002.5 in each third of all frames.
    thirds = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: A.mean(F.filter("trace", lambda v, t: F.floor(t * 3 / 64) == k)))
    planes = R.exploded(pixels.withColumn("trace", thirds)).filter("measu % 2 = 0")
    area = B.area_from_planes(planes.withColumn("v", F.col("v") - 1002.5))
    return B.with_area(pixels.select("measu", "x", "y"), area)


_MOTION = """, o AS (SELECT dx, dy FROM range(-1, 2) a(dx), range(-1, 2) b(dy)),
sc AS (SELECT p.measu, p.t, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, corr(p.v, r.v) AS c
  FROM pixels p CROSS JOIN o JOIN pixels r ON r.measu = p.measu AND r.t = 5 AND r.x = (p.x + dx + 10) % 10 AND r.y = (p.y + dy + 10) % 10
  WHERE r.x BETWEEN 1 AND 8 AND r.y BETWEEN 1 AND 8 AND p.t <> 5 GROUP BY ALL),
best AS (SELECT measu, t, arg_max(dx, c) AS dx, arg_max(dy, c) AS dy, max(c) AS c FROM sc GROUP BY ALL),
sh AS (SELECT measu, t, CASE WHEN c > 0 THEN dx ELSE 0 END AS dx, CASE WHEN c > 0 THEN dy ELSE 0 END AS dy,
   CASE WHEN c > 0 THEN CAST(trunc(c * 10) AS INTEGER) ELSE 0 END AS quality FROM best
   UNION ALL SELECT DISTINCT measu, 5, 0, 0, 0 FROM pixels)
"""


@query("r17_motion_estimate", sql_over("pixels", body=_MOTION + "SELECT measu, t, dx, dy, quality FROM sh"))
def _(spark, sf):
    return MO.estimated_shifts(R.exploded(M.traces(spark, sf)), 10, 10)


_ROLLED = "SELECT measu, (x + dx + 10) % 10 AS x, (y + dy + 10) % 10 AS y, t, round(v, 6) AS v FROM pixels JOIN sh USING (measu, t)"


@query(
    "r18_apply_shift",
    sql_over("pixels", body=", sh AS (SELECT DISTINCT measu, t, t % 4 - 1 AS dx, t % 3 - 1 AS dy FROM pixels)\n" + _ROLLED),
)
def _(spark, sf):
    pixels = R.exploded(M.traces(spark, sf))
    shifts = pixels.select("measu", "t").distinct().selectExpr("measu", "t", "t % 4 - 1 AS dx", "t % 3 - 1 AS dy")
    return rounded(MO.rolled(pixels, shifts, 10, 10))


@query("r19_motion_corrected", sql_over("pixels", body=_MOTION + _ROLLED))
def _(spark, sf):
    return rounded(MO.motion_corrected(R.exploded(M.traces(spark, sf)), "compute", 10, 10))


@query(
    "r20_binning",
    sql_over("pixels", body="""SELECT measu, x // 3 AS x, y // 3 AS y, t, trunc(avg(v)) AS v FROM pixels
WHERE x < 9 AND y < 9 GROUP BY ALL"""),
)
def _(spark, sf):
    return rounded(R.binned(R.exploded(M.traces(spark, sf)), 3))


@query("r21_morphology", sql_over("pixels", body="SELECT measu, x, y, round(avg(v), 6) AS v FROM pixels WHERE t BETWEEN 1 AND 5 GROUP BY ALL"))
def _(spark, sf):
    return R.morphology(M.traces(spark, sf)).withColumn("v", F.round("v", 6))


_TAPS = R.highpass_taps(1000.0, 100.0, 40.0, 20.0)


@query(
    "r22_highpass",
    sql_over("pixels", body=kernel_sql("hp", "pixels", "t", _TAPS[::-1], (len(_TAPS) - 1) // 2 - len(_TAPS) + 1, "nearest", 64)
             + "SELECT measu, x, y, t, round(v, 6) AS v FROM hp"),
)
def _(spark, sf):
    return long(M.traces(spark, sf).withColumn("trace", R.highpass(F.col("trace"), 1000.0)))


@query(
    "r23_light_normalised",
    sql_over("pixels", "area", body=""", l AS (SELECT measu, avg(v) AS l FROM pixels JOIN area USING (measu, x, y) WHERE t >= 4 AND t < 12 GROUP BY 1)
SELECT measu, x, y, t, round(v * (1000.0 / l), 6) AS v FROM pixels JOIN l USING (measu)"""),
)
def _(spark, sf):
    return rounded(R.light_normalised(R.exploded(M.traces(spark, sf)), M.area(spark, sf), (4, 12)))


@query(
    "r24_pyramid",
    sql_over("pixels", body=""", off AS (SELECT a - 2 AS dx, b - 2 AS dy, least(a, b, 4 - a, 4 - b) + 1 AS w FROM range(0, 5) p(a), range(0, 5) q(b))
SELECT p.measu, p.x, p.y, p.t, round(sum(w * q.v), 4) AS v FROM pixels p CROSS JOIN off JOIN pixels q
  ON q.measu = p.measu AND q.t = p.t AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL"""),
)
def _(spark, sf):
    return rounded(R.pyramid_sum(R.exploded(M.traces(spark, sf)), 5), 4)


@query(
    "r25_equal_shapes",
    sql_over("pixels", "pixels2", body=""", a AS (SELECT measu, count(*) AS n FROM pixels GROUP BY 1), b AS (SELECT measu, count(*) AS n FROM pixels2 GROUP BY 1)
SELECT measu, a.n = b.n AS same_shape FROM a JOIN b USING (measu)"""),
)
def _(spark, sf):
    return R.same_shape(M.traces(spark, sf), M.traces2(spark, sf))


@query(
    "r26_replace_nan",
    sql_over("pixels", body=""", m AS (SELECT measu, min(v) FILTER ((x + y + t) % 7 <> 0) AS m FROM pixels GROUP BY 1)
SELECT measu, x, y, t, round(CASE WHEN (x + y + t) % 7 = 0 THEN m ELSE v END, 6) AS v FROM pixels JOIN m USING (measu)"""),
)
def _(spark, sf):
    pixels = R.exploded(M.traces(spark, sf))
    holes = pixels.withColumn("v", F.when((F.col("x") + F.col("y") + F.col("t")) % 7 == 0, float("nan")).otherwise(F.col("v")))
    return rounded(R.without_nan(holes))


@query(
    "r28_byte_scaling",
    sql_over("pixels", body="SELECT measu, x, y, t, CAST(floor((least(greatest(v, 980.0), 1020.0) - 980.0) * 255 / 40.0 + 0.5) AS BIGINT) AS v FROM pixels"),
)
def _(spark, sf):
    pixels = R.exploded(M.traces(spark, sf))
    return pixels.withColumn("v", R.bytescaled(F.col("v"), F.lit(980.0), F.lit(1020.0))).select("measu", "x", "y", "t", "v")
