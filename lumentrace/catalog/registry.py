"""Registry of named queries and the shared SQL definitions of the model tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; ``sql`` is its independent DuckDB twin."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The model tables written as DuckDB SQL; `lumentrace.catalog.tables` is the Spark side.
_CTES = {
    "px0": """px0 AS (
  SELECT vec_id // 100 AS measu, CAST(vec_id % 10 AS INTEGER) AS x, CAST((vec_id // 10) % 10 AS INTEGER) AS y,
         label, embedding, unnest(range(0, len(embedding))) AS t0 FROM embeddings)""",
    "pixels": """pixels AS (
  SELECT measu, x, y, CAST(t0 AS INTEGER) AS t, 1000 + 100 * CAST(embedding[t0 + 1] AS DOUBLE) AS v FROM px0)""",
    "pixels2": """pixels2 AS (
  SELECT measu, x, y, CAST(t0 AS INTEGER) AS t,
         800 + 50 * CAST(embedding[len(embedding) - t0] AS DOUBLE) AS v FROM px0)""",
    "area": """area AS (
  SELECT vec_id // 100 AS measu, CAST(vec_id % 10 AS INTEGER) AS x, CAST((vec_id // 10) % 10 AS INTEGER) AS y
  FROM embeddings WHERE label % 3 <> 0)""",
    "roi_px": """roi_px AS (
  SELECT vec_id // 100 AS measu, 'r' || CAST(label AS VARCHAR) AS roi, CAST(vec_id % 10 AS INTEGER) AS x,
         CAST((vec_id // 10) % 10 AS INTEGER) AS y FROM embeddings)""",
    "stimuli": """stimuli AS (
  SELECT user_id AS measu,
         CAST(event_id AS INTEGER) AS stim_idx,
         json_extract_string(props, '$.k') AS odor, value AS conc,
         (epoch_us(ts) - 1704067200000000) / 200000000.0 AS on_ms,
         (epoch_us(ts) - 1704067200000000) / 200000000.0 + value * 10 AS off_ms,
         200.0 AS period_ms
  FROM events WHERE event_type = 'purchase')""",
    "clock": """clock AS (
  SELECT event_id, user_id AS measu, (epoch_us(ts) - 1704067200000000) / 200000000.0 AS t_ms
  FROM events WHERE event_type = 'view')""",
    "onset": """onset AS (
  SELECT measu, CAST(trunc(arg_min(on_ms / period_ms, stim_idx)) AS INTEGER) AS onset_frame,
         arg_min(on_ms, stim_idx) AS on_ms FROM stimuli GROUP BY measu)""",
    "bg": """bg AS (
  SELECT m.measu,
         CASE WHEN onset_frame - 1 > 4 THEN 4 ELSE 3 END AS bg_start,
         CASE WHEN onset_frame - 1 > 4 THEN onset_frame - 1 ELSE 5 END AS bg_end
  FROM (SELECT DISTINCT vec_id // 100 AS measu FROM embeddings) m LEFT JOIN onset USING (measu))""",
    "dff": """f0 AS (SELECT measu, x, y, avg(v) AS f0 FROM pixels JOIN bg USING (measu)
         WHERE t BETWEEN bg_start AND bg_end GROUP BY ALL),
dff AS (SELECT measu, x, y, t, v / (CASE WHEN f0 = 0 THEN 1 ELSE f0 END) - 1 AS v FROM pixels JOIN f0 USING (measu, x, y))""",
    "roi_tr": """roi_tr AS (SELECT measu, roi, t, avg(v) AS v FROM dff JOIN roi_px USING (measu, x, y) GROUP BY ALL)""",
    "meas": """meas AS (
  SELECT 'a' || CAST(o_custkey AS VARCHAR) AS animal, o_orderkey AS measu, o_orderpriority AS label,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE -1 END AS analyze,
         CAST(100 + 50 * (o_orderkey % 5) AS DOUBLE) AS cycle, epoch_us(o_orderdate) / 1000000.0 AS utc,
         o_totalprice AS price
  FROM orders)""",
}
_NEEDS = {
    "pixels": ["px0"],
    "pixels2": ["px0"],
    "onset": ["stimuli"],
    "bg": ["stimuli", "onset"],
    "dff": ["px0", "pixels", "stimuli", "onset", "bg"],
    "roi_tr": ["px0", "pixels", "stimuli", "onset", "bg", "dff", "roi_px"],
}


def sql_over(*tables: str, body: str) -> str:
    """Prefix ``body`` with the model tables it uses. ``body`` may start with more CTEs
    written as ``, name AS (...)`` followed by its SELECT."""
    names: list[str] = []
    for table in tables:
        for name in [*_NEEDS.get(table, []), table]:
            if name not in names:
                names.append(name)
    text = "WITH " + ",\n".join(_CTES[n] for n in names) + "\n" + body
    return re.sub(r'(?<!")\banalyze\b(?!")', '"analyze"', text)  # a keyword in DuckDB
