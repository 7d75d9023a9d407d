"""Compare named queries with their SQL twins: python tools/check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


#: Queries with a fit inside, which SQL does not repeat; unit tests compare them with brute force.
NO_SQL = {
    "g6_composite_signal", "r11_fit_parameters", "r12_bleach_pixelwise", "r13_bleach_uniform",
    "r14_bleach_whole_frame", "r27_correction_pipeline",
}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if hasattr(value, "as_integer_ratio") and not isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(canonical(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=repr)


def compare(con, df, sql, name=""):
    """Whether a query's rows equal those of its SQL twin, and a line about it."""
    start = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = f"spark {time.time() - start:.2f}s"
    if sql is None:
        return name in NO_SQL, f"{len(got[1])} rows, no SQL, {took}"
    con.execute(sql)
    want = rows_of([d[0] for d in con.description], con.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}"
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    # repr separates 1 from 1.0, so compare values before giving up
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if a != b and bad:
        return False, f"{len(a - b)} differ; spark {sorted(a - b)[:2]} sql {sorted(b - a)[:2]}"
    return True, f"{len(got[1])} rows, {took}"


def main() -> int:
    from lumentrace.catalog import load
    from lumentrace.session import build_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = load()
    con, failed = connect(sf), 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ok, text = compare(con, fn(spark, sf), oracles.get(name), name)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s  {text}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
