"""Queries for signals and trace features (G*, C*, U1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.registry import query, sql_over
from lumentrace.functions import arrays as A
from lumentrace.functions import features as C
from lumentrace.model import Params
from lumentrace.operators import signals as G
from lumentrace.operators import stimuli as T
from lumentrace.plans.skew import join_per_key

P = Params()


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return M.traces(spark, sf).select("measu").distinct()


def backgrounds(spark: SparkSession, sf: str) -> DataFrame:
    return T.background_ranges(recordings(spark, sf), M.stimuli(spark, sf), P)


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """dF/F movie of the first wavelength."""
    return G.dff(M.traces(spark, sf), backgrounds(spark, sf))


def long(traces: DataFrame, digits: int = 6) -> DataFrame:
    return A.unrolled(traces, "measu", "x", "y").withColumn("v", F.round("v", digits))


@query("g1_scaled_first", sql_over("pixels", body="SELECT measu, x, y, t, round(v / 1000, 6) AS v FROM pixels"))
def _(spark, sf):
    return long(G.signal(P.with_(calc_method=0), M.traces(spark, sf), None))


@query("g2_scaled_second", sql_over("pixels2", body="SELECT measu, x, y, t, round(v / 1000, 6) AS v FROM pixels2"))
def _(spark, sf):
    return long(G.signal(P.with_(calc_method=1), M.traces(spark, sf), None, M.traces2(spark, sf)))


@query("g3_dff", sql_over("dff", body="SELECT measu, x, y, t, round(v, 6) AS v FROM dff"))
def _(spark, sf):
    return long(G.signal(P.with_(calc_method=3000), M.traces(spark, sf), backgrounds(spark, sf)))


@query(
    "g4_ratio",
    sql_over(
        "pixels", "pixels2", "area", "bg",
        body="""
, m AS (SELECT p.measu, avg(p.v) AS m1, avg(q.v) AS m2 FROM pixels p JOIN pixels2 q USING (measu, x, y, t)
        JOIN area USING (measu, x, y) JOIN bg USING (measu) WHERE t BETWEEN bg_start AND bg_end GROUP BY 1),
r AS (SELECT measu, x, y, t, (p.v / m1) / (q.v / m2) AS r FROM pixels p JOIN pixels2 q USING (measu, x, y, t)
      JOIN m USING (measu)),
b AS (SELECT measu, x, y, avg(r) AS b FROM r JOIN bg USING (measu) WHERE t BETWEEN bg_start AND bg_end GROUP BY ALL)
SELECT measu, x, y, t, round(r - b, 6) AS v FROM r JOIN b USING (measu, x, y)""",
    ),
)
def _(spark, sf):
    return long(
        G.signal(P.with_(calc_method=4), M.traces(spark, sf), backgrounds(spark, sf), M.traces2(spark, sf), M.area(spark, sf))
    )


@query(
    "g5_plain_ratio",
    sql_over("pixels", "pixels2", body="SELECT measu, x, y, t, round(p.v / q.v, 6) AS v FROM pixels p JOIN pixels2 q USING (measu, x, y, t)"),
)
def _(spark, sf):
    return long(G.plain_ratio(M.traces(spark, sf), M.traces2(spark, sf)))


@query(
    "g7_method_dispatch",
    sql_over(
        "dff", "pixels", "pixels2",
        body="""SELECT 0 AS method, count(*) AS n, round(sum(v / 1000), 4) AS total FROM pixels
UNION ALL SELECT 1, count(*), round(sum(v / 1000), 4) FROM pixels2
UNION ALL SELECT 3, count(*), round(sum(v), 4) FROM dff""",
    ),
)
def _(spark, sf):
    parts = []
    for method in (0, 1, 3):
        movie = G.signal(P.with_(calc_method=method), M.traces(spark, sf), backgrounds(spark, sf), M.traces2(spark, sf))
        parts.append(
            movie.select(F.size("trace").alias("n"), A.total(F.col("trace")).alias("s"))
            .agg(F.sum("n").alias("n"), F.round(F.sum("s"), 4).alias("total"))
            .select(F.lit(method).alias("method"), "n", "total")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- features on the signal of every pixel --------------------------------------------


def with_context(spark: SparkSession, sf: str) -> DataFrame:
    """Signal traces with the background range and first onset of their recording."""
    bg = backgrounds(spark, sf)
    on = M.stimuli(spark, sf).groupBy("measu").agg(F.min_by("on_ms", "stim_idx").alias("on_ms"))
    return join_per_key(signal(spark, sf), bg.join(on, "measu", "left"), ["measu"], spread=["x", "y"])


def context(params: Params = P) -> C.FeatureContext:
    return C.FeatureContext.from_params(
        params, on_ms=F.col("on_ms"), background=(F.col("bg_start"), F.col("bg_end"))
    )


def _feature_query(name: str, feature: int | str, sql: str) -> None:
    @query(name, sql)
    def _(spark, sf):
        values = C.apply_feature(with_context(spark, sf), feature, context())
        return values.withColumn("value", F.round("value", 6))


def _agg_sql(expr: str, where: str = "TRUE") -> str:
    return sql_over(
        "dff",
        body=f"""SELECT measu, x, y, 0 AS feature, round({expr}, 6) AS value
FROM dff JOIN bg USING (measu) WHERE {where} GROUP BY measu, x, y""",
    )


_C22 = "avg(v) FILTER (t BETWEEN 44 AND 46) - avg(v) FILTER (t BETWEEN 24 AND 26)"
_feature_query("c0_background_alias", 0, _agg_sql("avg(v)", "t BETWEEN bg_start AND bg_end"))
_feature_query("c22_rise", 22, _agg_sql(_C22))
_feature_query("c222_rise_four", 222, _agg_sql("avg(v) FILTER (t BETWEEN 45 AND 48) - avg(v) FILTER (t BETWEEN 25 AND 28)"))
_feature_query("c300_mean_all", 300, _agg_sql("avg(v)"))
_feature_query("c301_mean_early", 301, _agg_sql("avg(v)", "t BETWEEN 4 AND 9"))
_feature_query("c302_mean_window", 302, _agg_sql("avg(v)", "t BETWEEN 25 AND 46"))
_feature_query("c303_mean_background", 303, _agg_sql("avg(v)", "t BETWEEN bg_start AND bg_end"))
_feature_query("c330_median_all", 330, _agg_sql("median(v)"))
_feature_query("c331_median_early", 331, _agg_sql("median(v)", "t BETWEEN 4 AND 9"))
_feature_query("c332_median_window", 332, _agg_sql("median(v)", "t BETWEEN 25 AND 46"))
_feature_query("c333_median_background", 333, _agg_sql("median(v)", "t BETWEEN bg_start AND bg_end"))

_C35_CTES = """
, k AS (SELECT measu, CAST(trunc(on_ms / 200) AS INTEGER) + 1 AS s,
               least(CAST(trunc((on_ms + 3000) / 200) AS INTEGER) + 1, 63) AS e FROM onset),
pk AS (SELECT measu, x, y, arg_min(t, struct_pack(a := -v, b := t)) AS m
       FROM dff JOIN k USING (measu) WHERE t BETWEEN s AND e GROUP BY ALL),
w AS (SELECT measu, x, y, least(greatest(m, 1), 62) AS m, least(greatest(s - 1, 1), 62) AS b
      FROM pk JOIN k USING (measu)),
c35 AS (SELECT measu, x, y, avg(v) FILTER (t BETWEEN m - 1 AND m + 1) - avg(v) FILTER (t BETWEEN b - 1 AND b + 1) AS value
      FROM dff JOIN w USING (measu, x, y) GROUP BY ALL)
"""
_feature_query(
    "c35_peak_after_onset",
    35,
    sql_over(
        "dff",
        body=_C35_CTES
        + """SELECT p.measu, p.x, p.y, 0 AS feature, round(value, 6) AS value
FROM (SELECT DISTINCT measu, x, y FROM dff) p LEFT JOIN c35 USING (measu, x, y)""",
    ),
)
_feature_query(
    "c22_35_rise_and_peak",
    "22and35",
    sql_over(
        "dff",
        body=_C35_CTES
        + f""", c22 AS (SELECT measu, x, y, {_C22} AS value FROM dff GROUP BY ALL)
SELECT measu, x, y, 0 AS feature, round(value, 6) AS value FROM c22
UNION ALL SELECT measu, x, y, 1, round(c35.value, 6) FROM c22 LEFT JOIN c35 USING (measu, x, y)""",
    ),
)

_CHUNK_CTES = """
, l AS (SELECT measu, x, y, arg_min(t, struct_pack(a := v, b := t)) AS lmin, arg_min(t, struct_pack(a := -v, b := t)) AS lmax
        FROM dff WHERE t < 32 GROUP BY ALL),
r AS (SELECT measu, x, y, any_value(lmin) AS lmin, any_value(lmax) AS lmax,
             arg_min(t, struct_pack(a := v, b := t)) AS lo, arg_min(t, struct_pack(a := -v, b := t)) AS hi
      FROM dff JOIN l USING (measu, x, y) WHERE t >= lmin GROUP BY measu, x, y),
bp AS (SELECT measu, x, y,
         CASE WHEN lo = lmin THEN lo WHEN hi = lmin THEN lo WHEN lo < hi THEN hi ELSE lo END AS base,
         CASE WHEN lo = lmin THEN hi WHEN hi = lmin THEN lmax WHEN lo < hi THEN lo ELSE hi END AS peak FROM r),
ch AS (SELECT measu, x, y, any_value(base) AS base, any_value(peak) AS peak,
         max(v) FILTER (t = peak) - max(v) FILTER (t = base) AS magnitude
       FROM dff JOIN bp USING (measu, x, y) GROUP BY measu, x, y)
"""


@query(
    "c_chunk_magnitude",
    sql_over(
        "dff",
        body=_CHUNK_CTES
        + """SELECT measu, x, y, 0 AS feature, round(magnitude, 6) AS value FROM ch
UNION ALL SELECT measu, x, y, 1, base FROM ch UNION ALL SELECT measu, x, y, 2, peak FROM ch""",
    ),
)
def _(spark, sf):
    values = C.apply_feature(signal(spark, sf), "chunk_magnitude_basic", context())
    return values.withColumn("value", F.round("value", 6))


@query("c_basic_chunk_value", sql_over("dff", body=_CHUNK_CTES + "SELECT measu, x, y, round(magnitude, 6) AS value FROM ch"))
def _(spark, sf):
    return signal(spark, sf).select("measu", "x", "y", F.round(C.chunk_value(F.col("trace")), 6).alias("value"))


@query(
    "c_list_features",
    sql_over(
        "dff",
        body=_C35_CTES + """, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT measu, x, y FROM dff)), m AS (SELECT count(value) AS m FROM c35)
SELECT feature, n AS pixels, CASE WHEN feature = 35 THEN m ELSE n END AS defined
FROM n, m, (VALUES (0), (22), (35), (222), (300), (301), (302), (303), (330), (331), (332), (333)) f(feature)""",
    ),
)
def _(spark, sf):
    """Every feature known by number, over all pixels in one pass: how many have a value."""
    numbers = [r.feature for r in C.available_features(spark).collect()]
    values = C.apply_features(with_context(spark, sf), numbers, context()).filter("part = 0")
    counted = values.groupBy(F.col("feature").cast("int").alias("feature"))
    return counted.agg(F.count(F.lit(1)).alias("pixels"), F.count("value").alias("defined"))


@query(
    "c_frame_masks",
    sql_over(
        "dff",
        body=f"""SELECT measu, x, y, round(avg(v) FILTER (t BETWEEN 25 AND 45), 6) AS m12,
round(max(v) FILTER (t = 45) - max(v) FILTER (t = 25), 6) AS m20, round({_C22}, 6) AS m22 FROM dff GROUP BY ALL""",
    ),
)
def _(spark, sf):
    trace, ctx = F.col("trace"), context()
    value = {m: C.weighted_sum(trace, C.frame_weights(m, F.size(trace), ctx)) for m in (12, 20, 22)}
    return signal(spark, sf).select("measu", "x", "y", *[F.round(v, 6).alias(f"m{m}") for m, v in value.items()])


@query(
    "c_frame_35_global_peak",
    sql_over(
        "dff",
        body="""
, curve AS (SELECT measu, t, round(avg(v), 12) AS v, any_value(onset_frame) AS o FROM dff JOIN onset USING (measu)
            WHERE t >= onset_frame AND t < onset_frame + 15 GROUP BY ALL),
pk AS (SELECT measu, any_value(o) AS o, arg_min(t, struct_pack(a := -v, b := t)) AS m FROM curve GROUP BY 1)
SELECT measu, x, y, round(sum(v * CASE WHEN t BETWEEN o - 3 AND o - 1 THEN -1 WHEN t BETWEEN m - 1 AND m + 1 THEN 1 ELSE 0 END) / 3, 6) AS value
FROM dff JOIN pk USING (measu) GROUP BY measu, x, y""",
    ),
)
def _(spark, sf):
    onsets = T.first_onsets(M.stimuli(spark, sf))
    out = C.global_peak_overview(signal(spark, sf), onsets, rate_hz=5.0)
    return out.withColumn("value", F.round("value", 6))


@query(
    "c_leg_features",
    sql_over(
        "dff",
        body=f"""SELECT measu, x, y, round(avg(v) FILTER (t BETWEEN 10 AND 18), 6) AS f1,
round(sum(v) FILTER (t BETWEEN 44 AND 46) - sum(v) FILTER (t BETWEEN 24 AND 26), 6) AS f22,
round(sum(v) FILTER (t BETWEEN 22 AND 34) - sum(v) FILTER (t BETWEEN 5 AND 18), 6) AS f23,
round(max(v) FILTER (t BETWEEN 20 AND 34) - max(v) FILTER (t = 18), 6) AS f35 FROM dff GROUP BY ALL""",
    ),
)
def _(spark, sf):
    trace, onset, rate = F.col("trace"), F.lit(20), F.lit(5.0)
    return signal(spark, sf).select(
        "measu", "x", "y",
        F.round(C.early_mean(trace), 6).alias("f1"),
        F.round(C.rise_three_sum(trace, context()), 6).alias("f22"),
        F.round(C.onset_contrast_sum(trace, onset, rate), 6).alias("f23"),
        F.round(C.onset_peak_contrast(trace, onset, rate), 6).alias("f35"),
    )


_STRONGEST = """, s AS (SELECT measu, x, y, arg_min(struct_pack(v := v, t := t), struct_pack(a := -abs(v), b := t)) AS s
  FROM dff GROUP BY ALL)
"""


@query("c_sign_response", sql_over("dff", body=_STRONGEST + "SELECT measu, x, y, s.v > 0 AS positive FROM s"))
def _(spark, sf):
    return signal(spark, sf).select("measu", "x", "y", C.response_positive(F.col("trace")).alias("positive"))


@query(
    "c_contam_contaminated",
    sql_over("dff", body=_STRONGEST + "SELECT measu, x, y, NOT (s.t BETWEEN 16 AND 48) AS contaminated FROM s"),
)
def _(spark, sf):
    return signal(spark, sf).select("measu", "x", "y", C.contaminated(F.col("trace")).alias("contaminated"))


_RISING = """
, {n}s AS (SELECT measu, x, y, t, v, lead(v) OVER w - v AS d, median(v) OVER g AS md, min(v) OVER g AS lo, max(v) OVER g AS hi
  FROM {src} WINDOW w AS (PARTITION BY measu, x, y ORDER BY t), g AS (PARTITION BY measu, x, y)),
{n}k AS (SELECT measu, x, y, t, CASE WHEN d <= 0 THEN md ELSE v END AS v, md, lo, hi FROM {n}s),
{n} AS (SELECT measu, x, y, t, CASE WHEN v >= lo + 0.85 * (hi - lo) THEN md ELSE v END AS v FROM {n}k)
"""


@query(
    "c_delay_rising_phase",
    sql_over(
        "pixels", "pixels2",
        body=_RISING.format(n="pa", src="pixels")
        + _RISING.format(n="pb", src="pixels2")
        + """, c AS (SELECT measu, x, y, a.t - b.t AS lag, sum(a.v * b.v) AS s FROM pa a JOIN pb b USING (measu, x, y) GROUP BY ALL)
SELECT measu, x, y, CAST(arg_max(lag, s) AS INTEGER) AS lag FROM c GROUP BY ALL""",
    ),
)
def _(spark, sf):
    both = M.traces(spark, sf).join(M.traces2(spark, sf).withColumnRenamed("trace", "trace2"), ["measu", "x", "y"])
    return both.select("measu", "x", "y", C.rising_phase_delay(F.col("trace"), F.col("trace2")).alias("lag"))


@query(
    "c_bic_model_choice",
    sql_over(
        "dff",
        body="""
, rss AS (SELECT measu, x, y, sum(v * v) AS r0, sum((v - p) * (v - p)) AS r1 FROM
   (SELECT measu, x, y, t, v, coalesce(lag(v) OVER (PARTITION BY measu, x, y ORDER BY t), 0) AS p FROM dff) GROUP BY ALL),
b AS (SELECT measu, x, y, 64 * ln(r0 / 64) + 1 * ln(64) AS b0, 64 * ln(r1 / 64) + 2 * ln(64) AS b1 FROM rss)
SELECT measu, x, y, CASE WHEN b1 < b0 - 5 THEN 'step' ELSE 'level' END AS model,
       round(CASE WHEN b1 < b0 - 5 THEN b1 ELSE b0 END, 5) AS bic FROM b""",
    ),
)
def _(spark, sf):
    trace = F.col("trace")
    previous = F.concat(F.array(F.lit(0.0)), F.slice(trace, 1, F.size(trace) - 1))
    squares = A.total(F.transform(trace, lambda v: v * v))
    steps = A.total(F.zip_with(trace, previous, lambda v, p: (v - p) * (v - p)))
    candidates = F.array(
        F.struct(F.lit("level").alias("model"), F.lit(1).alias("components"), squares.alias("rss")),
        F.struct(F.lit("step").alias("model"), F.lit(2).alias("components"), steps.alias("rss")),
    )
    scores = (
        signal(spark, sf)
        .select("measu", "x", "y", F.size(trace).alias("n"), F.explode(candidates).alias("c"))
        .select("measu", "x", "y", "c.model", "c.components",
                C.model_score(F.col("c.rss"), F.col("n"), F.col("c.components")).alias("bic"))
    )
    return C.choose_model(scores, ["measu", "x", "y"], margin=5.0).withColumn("bic", F.round("bic", 5))


@query(
    "c_apply_two_features",
    sql_over(
        "dff",
        body=_C35_CTES + f""", a AS (SELECT measu, x, y, {_C22} AS c22, avg(v) FILTER (t BETWEEN 45 AND 48) - avg(v) FILTER (t BETWEEN 25 AND 28) AS c222 FROM dff GROUP BY measu, x, y)
SELECT measu, x, y, '222' AS feature, 0 AS part, round(c222, 6) AS value FROM a
UNION ALL SELECT measu, x, y, '22and35', 0, round(c22, 6) FROM a
UNION ALL SELECT measu, x, y, '22and35', 1, round(c35.value, 6) FROM a LEFT JOIN c35 USING (measu, x, y)""",
    ),
)
def _(spark, sf):
    """Two features, three values, in one pass over the signal."""
    return C.apply_features(with_context(spark, sf), [222, "22and35"], context()).withColumn("value", F.round("value", 6))


@query(
    "c_safe_out_of_range",
    sql_over(
        "dff",
        body="""SELECT measu, x, y, measu % 2 <> 0 AS undefined, round(CASE WHEN measu % 2 = 0 THEN late - early END, 6) AS value FROM (
  SELECT measu, x, y, avg(v) FILTER (t BETWEEN 44 AND 46) AS late, avg(v) FILTER (t BETWEEN 24 AND 26) AS early FROM dff GROUP BY measu, x, y)""",
    ),
)
def _(spark, sf):
    """Traces that end before or at the last frame of the feature."""
    trace = F.slice("trace", F.lit(1), F.when(F.col("measu") % 2 == 0, 47).otherwise(46))
    rows = signal(spark, sf).withColumn("trace", trace)
    [value] = C.safe(C.rise_three(F.col("trace"), context()))
    return rows.select("measu", "x", "y", F.isnan(value).alias("undefined"), F.round(F.nanvl(value, F.lit(None).cast("double")), 6).alias("value"))


def last_minus_first(time_trace, sampling_period, first_frame, last_frame, stimulus_number,
                     stim_on_times, stim_off_times, flags, p1):
    """A user's own feature: difference of two frames, and their distance in ms."""
    return [time_trace[last_frame] - time_trace[first_frame], (last_frame - first_frame) * sampling_period]


def first_pulse_contrast(
    time_trace, sampling_period, first_frame, last_frame, stimulus_number, stim_on_times, stim_off_times, flags, p1
):
    """Value at the first pulse, number of pulses, and the recording it came from."""
    frame = int(stim_on_times[0] / sampling_period)
    return [time_trace[frame], len(stim_off_times), p1["measu"]]


@query(
    "u1_user_feature_context",
    sql_over(
        "dff",
        body=""", n AS (SELECT measu, count(*) AS pulses FROM stimuli GROUP BY 1)
SELECT measu, x, y, round(max(v) FILTER (t = CAST(trunc(on_ms / (100 + 50 * (measu % 5))) AS INTEGER)), 6) AS at_pulse,
any_value(CAST(pulses AS DOUBLE)) AS pulses, CAST(measu AS DOUBLE) AS recording FROM dff JOIN onset USING (measu) JOIN n USING (measu)
WHERE trunc(on_ms / (100 + 50 * (measu % 5))) < 64 GROUP BY ALL""",
    ),
)
def _(spark, sf):
    """The pulses, period and facts of each recording reach the user's function."""
    pulse = F.array_sort(F.collect_list(F.struct("stim_idx", "on_ms", "off_ms")))
    facts = M.stimuli(spark, sf).groupBy("measu").agg(pulse.alias("p")).select(
        "measu", F.col("p.on_ms").alias("on"), F.col("p.off_ms").alias("off"), (100.0 + 50 * (F.col("measu") % 5)).alias("period")
    )
    rows = join_per_key(signal(spark, sf), facts, ["measu"], spread=["x", "y"]).filter(F.floor(F.col("on")[0] / F.col("period")) < 64)
    value = C.user_feature(first_pulse_contrast, P)(F.col("trace"), F.col("period"), F.col("on"), F.col("off"), F.struct("measu"))
    out = rows.select("measu", "x", "y", value.alias("f"))
    return out.select("measu", "x", "y", F.round(F.col("f")[0], 6).alias("at_pulse"), F.col("f")[1].alias("pulses"), F.col("f")[2].alias("recording"))


@query(
    "u1_user_feature",
    sql_over(
        "dff",
        body="""SELECT measu, x, y, round(max(v) FILTER (t = 45) - max(v) FILTER (t = 25), 6) AS change,
4000.0 AS span_ms FROM dff GROUP BY ALL""",
    ),
)
def _(spark, sf):
    run = C.user_feature(last_minus_first, P)
    out = signal(spark, sf).select("measu", "x", "y", run(F.col("trace")).alias("f"))
    return out.select("measu", "x", "y", F.round(F.col("f")[0], 6).alias("change"), F.col("f")[1].alias("span_ms"))
