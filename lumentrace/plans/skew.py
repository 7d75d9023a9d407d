"""Joins and statistics that stay balanced when one key holds a large share of all rows.

A table is marked for broadcast only after its rows were counted (:class:`Known`). Beyond that the
salted equi-join below is what runs, by shuffle and merge at any size, and a hot key is spread over
``salts`` tasks. The estimate of Catalyst decides nothing there: it comes from the size of packed
files, and counts neither the copies per salt nor the rows of an unrolled array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Facts that are broadcast at most; a row is a key and a few numbers.
FACT_ROWS = 10_000
_SALT = "__salt"


def join_per_key(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    salts: int = SALTS,
    estimated: bool = False,
) -> DataFrame:
    """Join per-key facts (at most a few rows per key) onto a large table.

    The salt comes from a hash of ``spread`` columns, so a recomputed task sees the
    same salt again. ``how`` may be inner, left, left_semi or left_anti. ``salts=1`` is
    for keys that are known to be even, such as buckets of a hot key. ``estimated=True`` leaves
    it to Catalyst whether a side is broadcast; it is for tables whose size is bounded elsewhere.
    """
    if salts == 1:
        return big.join(small, list(keys), how)
    spread = [c for c in (spread or big.columns) if c not in keys] or list(keys)
    hashable = [c for c in spread if not dict(big.dtypes)[c].startswith("map")]
    salted = big.withColumn(_SALT, F.pmod(F.xxhash64(*hashable), F.lit(salts)).cast("int"))
    replicas = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not estimated:
        replicas = replicas.hint("merge")
    return salted.join(replicas, [*keys, _SALT], how).drop(_SALT)


def facts_in_use(facts: DataFrame, big: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The facts of keys that the large table has, so that no others are copied for its salts."""
    return facts.join(big.select(*keys).distinct().hint("merge"), list(keys), "left_semi")


@dataclass(frozen=True)
class Known:
    """One-row-per-key facts, and whether they are few enough to be broadcast."""

    df: DataFrame
    small: bool

    def joined_to(self, big: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
        """Join the facts onto a large table: a counted small table is broadcast, any other goes by salted keys."""
        return big.join(F.broadcast(self.df), list(keys), how) if self.small else join_per_key(big, self.df, keys, how)


def known(facts: DataFrame | Known, rows: int = FACT_ROWS) -> Known:
    """The facts, computed now if there are at most ``rows`` of them; no more than ``rows`` + 1 reach the driver."""
    if isinstance(facts, Known):
        return facts
    held = facts.limit(rows + 1).collect()
    if len(held) > rows:
        return Known(facts, False)
    return Known(facts.sparkSession.createDataFrame(held, facts.schema), True)


def with_facts(df: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach facts of each recording ``(measu, nx, ny, n_frames, period_ms, ...)`` to its rows.

    Where an operator takes a size it also takes a column, so that recordings of different
    cameras go through one job: ``cropped(with_facts(pixels, facts), 2, F.col("nx"), F.col("ny"))``.
    """
    return join_per_key(df, facts, ["measu"], spread=[c for c in ("roi", "x", "y", "t") if c in df.columns])


def with_key_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: dict[str, Column],
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Attach per-key aggregates to every row without a whole-key window.

    The aggregate combines map-side first; only one row per key travels to the join.
    """
    summary = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_per_key(df, summary, keys, spread=spread)
