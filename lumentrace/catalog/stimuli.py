"""Queries for stimulus operators (T*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.catalog import tables as M
from lumentrace.catalog.registry import query, sql_over
from lumentrace.model import Params
from lumentrace.operators import stimuli as T

# List cells derived from `part`: one, two or three pulses, some with broadcast singles.
_CELLS = {
    "cycle": "CAST(100 + 100 * (p_size % 3) AS DOUBLE)",
    "odour": "CASE WHEN p_partkey % 3 = 1 THEN concat(p_type, ',', p_brand) ELSE p_name END",
    "oconc": "CASE WHEN p_partkey % 4 = 0 THEN 'not set yet' ELSE CAST(-(p_size % 7) AS {str}) END",
    "stim_on": "CASE WHEN p_partkey % 3 = 1 THEN concat(p_size, ',', p_size + 20) "
    "WHEN p_partkey % 3 = 0 THEN CAST(p_size AS {str}) ELSE '-1' END",
    "stim_on_ms": "CASE WHEN p_partkey % 3 = 2 THEN CAST(100 * p_size AS {str}) ELSE '-1' END",
    "stim_off": "CASE WHEN p_partkey % 6 = 1 THEN concat(p_size + 4, ',', p_size + 30) "
    "WHEN p_partkey % 6 = 3 THEN CAST(p_size + 6 AS {str}) ELSE '-1' END",
    "stim_len": "CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE '1000' END",
    "stim2on": "CASE WHEN p_partkey % 9 = 0 THEN CAST(p_size + 50 AS {str}) ELSE '0' END",
    "stim2on_ms": "'-1'",
    "stim2off": "CASE WHEN p_partkey % 9 = 2 THEN CAST(p_size + 60 AS {str}) ELSE '0' END",
    "stim2len": "CASE WHEN p_partkey % 18 = 0 THEN '2000' ELSE '0' END",
}


def stimulus_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = [f"{e.format(str='STRING')} AS {c}" for c, e in _CELLS.items()]
    return M.table(spark, sf, "part").selectExpr("p_partkey AS measu", *cells)


_PART_SQL = """WITH cells AS (SELECT p_partkey AS measu, {cells} FROM part),
g AS (SELECT measu, cycle,
  string_split(nullif(odour, 'not set yet'), ',') AS odour, string_split(nullif(oconc, 'not set yet'), ',') AS oconc,
  string_split(nullif(stim_on, '-1'), ',') AS son, string_split(nullif(stim_on_ms, '-1'), ',') AS sms,
  string_split(nullif(stim_off, '-1'), ',') AS soff, string_split(nullif(stim_len, '0'), ',') AS slen,
  nullif(stim2on, '0') AS on2, nullif(stim2off, '0') AS off2, nullif(stim2len, '0') AS len2 FROM cells),
n AS (SELECT *, greatest(coalesce(len(odour), 0), coalesce(len(oconc), 0), coalesce(len(son), 0), coalesce(len(sms), 0),
  coalesce(len(soff), 0), coalesce(len(slen), 0)) AS n FROM g),
e AS (SELECT *, unnest(range(0, n)) AS i FROM n WHERE n > 0),
first AS (SELECT measu, cycle, n, CAST(i AS INTEGER) AS stim_idx,
  CAST(CASE WHEN len(son) > 1 THEN son[i + 1] ELSE son[1] END AS INTEGER) AS p_stim_on,
  CAST(CASE WHEN len(soff) > 1 THEN soff[i + 1] ELSE soff[1] END AS INTEGER) AS p_stim_off,
  CAST(CASE WHEN len(sms) > 1 THEN sms[i + 1] ELSE sms[1] END AS DOUBLE) AS p_stim_on_ms,
  CAST(CASE WHEN len(slen) > 1 THEN slen[i + 1] ELSE slen[1] END AS INTEGER) AS p_stim_len,
  trim(CASE WHEN len(odour) > 1 THEN odour[i + 1] ELSE odour[1] END) AS p_odour,
  CAST(CASE WHEN len(oconc) > 1 THEN oconc[i + 1] ELSE oconc[1] END AS DOUBLE) AS p_oconc,
  on2, off2, len2, odour, oconc FROM e),
second AS (SELECT measu, cycle, n, 1 AS stim_idx, CAST(on2 AS INTEGER), CAST(off2 AS INTEGER), CAST(NULL AS DOUBLE),
  CAST(len2 AS INTEGER), p_odour, p_oconc FROM first WHERE n = 1 AND coalesce(on2, off2, len2) IS NOT NULL),
pulses AS (SELECT measu, cycle, n, stim_idx, p_stim_on, p_stim_off, p_stim_on_ms, p_stim_len, p_odour, p_oconc FROM first
  UNION ALL SELECT * FROM second)
""".format(cells=", ".join(f"{e.format(str='VARCHAR')} AS {c}" for c, e in _CELLS.items()))

_P = ["p_stim_on", "p_stim_off", "p_stim_on_ms", "p_stim_len", "p_odour", "p_oconc"]


@query("t1_explode_cells", _PART_SQL + f"SELECT measu, stim_idx, {', '.join(_P)} FROM first")
def _(spark, sf):
    return T.exploded_cells(stimulus_cells(spark, sf)).select("measu", "stim_idx", *_P)


@query("t2_second_pulse", _PART_SQL + f"SELECT measu, stim_idx, {', '.join(_P)} FROM pulses")
def _(spark, sf):
    return T.with_second_pulse(stimulus_cells(spark, sf)).select("measu", "stim_idx", *_P)


@query(
    "t3_resolve_times",
    _PART_SQL
    + """, timed AS (SELECT *, coalesce(p_stim_on * cycle, p_stim_on_ms) AS on_ms FROM pulses)
SELECT measu, stim_idx, p_odour AS odor, p_oconc AS conc, on_ms,
       coalesce((p_stim_off + 1) * cycle, on_ms + p_stim_len) AS off_ms, cycle AS period_ms
FROM timed WHERE on_ms IS NOT NULL AND coalesce((p_stim_off + 1) * cycle, on_ms + p_stim_len) IS NOT NULL""",
)
def _(spark, sf):
    return T.parse_stimuli(stimulus_cells(spark, sf))


@query("t4_shift_pulses", sql_over("stimuli", body="SELECT measu, stim_idx, on_ms + 150 AS on_ms, off_ms + 150 AS off_ms FROM stimuli"))
def _(spark, sf):
    moved = T.shifted(M.stimuli(spark, sf), 150.0)
    return moved.select("measu", "stim_idx", "on_ms", "off_ms")


@query("t5_count_stimuli", sql_over("stimuli", body="SELECT measu, count(*) AS n_stimuli, count(DISTINCT odor) AS n_odors FROM stimuli GROUP BY 1"))
def _(spark, sf):
    return T.counted(M.stimuli(spark, sf))


_ACTIVE = """, hit AS (SELECT event_id, c.measu, t_ms, stim_idx, odor, conc FROM clock c LEFT JOIN stimuli s
  ON c.measu = s.measu AND on_ms <= t_ms AND off_ms >= t_ms)
"""


@query(
    "t6_active_stimuli",
    sql_over(
        "clock", "stimuli",
        body=_ACTIVE
        + """SELECT event_id, measu, coalesce(string_agg(odor, ';' ORDER BY stim_idx), '') AS odors, count(stim_idx) AS n
FROM hit GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    out = T.active_stimuli(M.stimuli(spark, sf), M.clock(spark, sf), "event_id")
    return out.select("event_id", "measu", F.array_join("odors", ";").alias("odors"), F.size("concs").cast("long").alias("n"))


@query("t7_durations", sql_over("stimuli", body="SELECT measu, stim_idx, off_ms - on_ms AS duration_ms FROM stimuli"))
def _(spark, sf):
    return T.durations(M.stimuli(spark, sf)).select("measu", "stim_idx", "duration_ms")


@query(
    "t8_pulse_frames",
    _PART_SQL
    + """, timed AS (SELECT *, coalesce(p_stim_on * cycle, p_stim_on_ms) AS on_ms FROM pulses),
r AS (SELECT measu, stim_idx, on_ms / cycle AS a, coalesce((p_stim_off + 1) * cycle, on_ms + p_stim_len) / cycle AS b FROM timed)
SELECT measu, stim_idx, CASE WHEN a = floor(a) THEN a END AS start_frame, CASE WHEN b = floor(b) THEN b END AS end_frame
FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(spark, sf):
    return T.pulse_frames(T.parse_stimuli(stimulus_cells(spark, sf))).select("measu", "stim_idx", "start_frame", "end_frame")


@query("t9_first_onset", sql_over("onset", body="SELECT measu, onset_frame FROM onset"))
def _(spark, sf):
    return T.first_onsets(M.stimuli(spark, sf))


@query(
    "t10_background_range",
    sql_over("bg", "onset", body="""SELECT measu, bg_start, bg_end, CASE WHEN bg_start = 4 THEN onset_frame ELSE -1 END AS onset_frame
FROM bg LEFT JOIN onset USING (measu)"""),
)
def _(spark, sf):
    recordings = M.traces(spark, sf).select("measu").distinct()
    return T.background_ranges(recordings, M.stimuli(spark, sf), Params())


@query(
    "t11_parse_lists",
    """WITH e AS (SELECT p_partkey AS measu, unnest([p_size * 1.5, 100.0 - p_size]) AS time, unnest([p_type, p_brand]) AS odor,
  unnest([1000.0, p_size * 10.0]) AS length FROM part)
SELECT measu, string_agg(odor, ';' ORDER BY time, odor) AS odors, min(time) AS first_ms,
       arg_min(length, struct_pack(a := time, b := odor)) AS first_length FROM e GROUP BY 1""",
)
def _(spark, sf):
    rows = M.table(spark, sf, "part").selectExpr(
        "p_partkey AS measu",
        "concat('[''', p_type, ''', ''', p_brand, ''']') AS odours",
        "concat('[', p_size * 1.5, ', ', 100.0 - p_size, ']') AS times",
        "concat('[1000.0, ', p_size * 10.0, ']') AS lengths",
    )
    out = T.parsed_lists(rows, "odours", "times", "lengths")
    return out.select(
        "measu", F.array_join("odours", ";").alias("odors"), F.col("times")[0].alias("first_ms"),
        F.col("lengths")[0].alias("first_length"),
    )


@query(
    "t12_relative_time",
    sql_over(
        "clock", "stimuli",
        body=""", f AS (SELECT measu, min(on_ms) AS o FROM stimuli GROUP BY 1),
r AS (SELECT event_id, measu, t_ms - coalesce(o, 0) AS rel FROM clock LEFT JOIN f USING (measu)),
p AS (SELECT *, abs(rel) / 1000 AS s, floor(abs(rel) / 1000 / 60) AS m FROM r)
SELECT event_id, measu, rel AS rel_ms, (CASE WHEN rel < 0 THEN '-' ELSE '' END) ||
  (CASE WHEN m > 0 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || ' m ' ELSE '' END) || printf('%6.3f', s - m * 60) || ' s' AS time_text
FROM p""",
    ),
)
def _(spark, sf):
    out = T.relative_times(M.clock(spark, sf), M.stimuli(spark, sf))
    return out.select("event_id", "measu", "rel_ms", "time_text")


@query(
    "t13_frame_labels",
    sql_over(
        "clock", "stimuli",
        body=_ACTIVE
        + """SELECT event_id, measu, arg_min(odor || '@' || CAST(conc AS VARCHAR), stim_idx) AS stimulus_text FROM hit GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return T.frame_labels(M.stimuli(spark, sf), M.clock(spark, sf), "event_id").select("event_id", "measu", "stimulus_text")


@query(
    "t14_stimulus_trains",
    sql_over(
        "stimuli",
        body=""", p AS (SELECT measu, CAST(trunc(arg_min(on_ms / 200, stim_idx)) AS INTEGER) AS s,
   CAST(trunc(arg_min(off_ms / 200, stim_idx)) AS INTEGER) AS e FROM stimuli GROUP BY 1),
k AS (SELECT measu, s + 7 * k AS s, e + 7 * k AS e FROM p, range(0, 20) r(k) WHERE k = 0 OR e + 7 * k < 79),
f AS (SELECT measu, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT user_id AS measu FROM events), range(0, 80) r(t))
SELECT f.measu, f.t, coalesce(bool_or(f.t >= k.s AND f.t < k.e), FALSE) AS stimulated FROM f LEFT JOIN k USING (measu) GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    counts = M.table(spark, sf, "events").select(F.col("user_id").alias("measu")).distinct().withColumn("n_frames", F.lit(80))
    return T.stimulus_trains(M.stimuli(spark, sf), counts, 7)
