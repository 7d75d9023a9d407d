"""Exact ranking, carry-forward and rank picks that never sort a whole group in one task.

Ranking and carry-forward split the rows into order-preserving buckets first, rank inside
each bucket, and add the number of rows of the buckets before it. Only the per-bucket
counts (at most ``buckets ** 2`` rows per group) are ever put in sequence. Buckets
are cut between exact bounds, twice, so that a few far outliers cannot push all other
rows into one bucket, and so that a recomputed task finds the same buckets again.
Rank picks count between quantiles of a sketch instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.plans.skew import join_per_key, known

BUCKETS = 64
#: Cells a quantile sketch cuts a group into, and its accuracy: ranks are off by at most 1 / ACCURACY of the rows.
CELLS, ACCURACY = 2000, 50_000
#: Ranges that :func:`numbered` cuts a table into.
LABEL_CUTS = 255


def order_bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Monotone bucket number 0..buckets-1 of ``value`` between two exact bounds."""
    v, lo, hi = (c.cast("double") for c in (value, low, high))
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * buckets), F.lit(buckets - 1))).otherwise(
        F.lit(0)
    ).cast("int")


def _numeric(column: Column, dtype: str) -> Column:
    if dtype.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp"))
    if dtype == "date":
        return F.unix_date(column)
    return column


def _bucketed_by_order(df: DataFrame, order: str, buckets: int) -> DataFrame:
    """Buckets of an order column, cut between bounds of the whole table.

    A group with many rows spreads over many order values and so over many buckets. The
    bounds are scalar subqueries (two numbers, then one pair per first-level bucket), so
    the rows themselves are neither joined nor moved here.
    """
    value = _numeric(F.col(order), dict(df.dtypes)[order]).cast("double")
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    first = order_bucket(value, low, high, buckets)
    found = df.groupBy(first.alias("b")).agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r"))
    pairs = found.agg(F.map_from_entries(F.collect_list(F.struct("b", "r"))).alias("m"))  # at most `buckets` entries
    bounds = pairs.select(
        F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.try_element_at("m", i))
    ).scalar()
    marked = df.withColumn("__first", first).withColumn("__r", F.get(bounds, F.col("__first")))
    finer = order_bucket(value, F.col("__r.lo"), F.col("__r.hi"), buckets)
    return marked.withColumn("__bucket", F.col("__first") * buckets + finer).drop("__first", "__r")


def indexed(
    df: DataFrame,
    order: str,
    groups: Sequence[str] = (),
    name: str = "row_idx",
    ties: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """0-based position of each row inside its group by a numeric or time column."""
    groups = list(groups)
    marked = _bucketed_by_order(df, order, buckets)
    per_bucket = marked.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *groups, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(*groups, "__bucket").orderBy(order, *ties)
    return (
        join_per_key(marked, offsets, [*groups, "__bucket"], salts=1)
        .withColumn(name, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__bucket", "__before")
    )


def numbered(df: DataFrame, order: str, name: str = "row_idx", ties: Sequence[str] = (), cuts: int = LABEL_CUTS) -> DataFrame:
    """0-based position of each row by any column that can be ordered, text too; nulls come first.

    The rows are cut between values of the column (with ``ties``, so that even one value of very many rows is cut): those of
    the ``cuts`` rows with the smallest hashes, which a recomputed task finds again. They and the counts
    between them are read when the plan is built; rows are then numbered within their range.
    """
    key = F.struct(order, *ties)
    picked = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(cuts).distinct().orderBy("k").collect()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(order, *ties).schema)
    held = df.sparkSession.createDataFrame([(i + 1, r.k) for i, r in enumerate(picked)], f"i INT, k STRUCT<{fields}>")
    bounds = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda e: e["k"])).scalar()
    marked = df.withColumn("__bounds", bounds)
    steps = [1 << i for i in reversed(range(max(1, len(picked).bit_length())))]
    # binary search: the number of bounds that are not after the row
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(at + s <= len(picked), F.when(F.get("__bounds", at + s - 1) <= key, at + s).otherwise(at)).otherwise(at),
    )
    marked = marked.withColumn("__range", found).drop("__bounds")
    counts = {r["__range"]: r["count"] for r in marked.groupBy("__range").count().collect()}
    before, total = [], 0
    for i in range(len(picked) + 1):
        before.append(F.lit(total))
        total += counts.get(i, 0)
    inside = Window.partitionBy("__range").orderBy(order, *ties)
    place = F.get(F.array(*before), F.col("__range")).cast("long") + F.row_number().over(inside) - 1
    return marked.withColumn(name, place).drop("__range")


def carried_forward(
    df: DataFrame,
    order: str,
    columns: Sequence[str],
    groups: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Replace nulls by the last non-null value before them, per group and column."""
    groups = list(groups)
    marked = _bucketed_by_order(df, order, buckets)
    tails = marked.groupBy(*groups, "__bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__tail_{c}") for c in columns]
    )
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *groups,
        "__bucket",
        *[F.last(f"__tail_{c}", ignorenulls=True).over(before).alias(f"__prev_{c}") for c in columns],
    )
    inside = (
        Window.partitionBy(*groups, "__bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_per_key(marked, carried, [*groups, "__bucket"], salts=1)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__prev_{c}")) for c in columns}
    return joined.withColumns(filled).select(*df.columns)


def rank_picks(
    df: DataFrame,
    value: str,
    groups: Sequence[str],
    ranks: dict[str, Column],
    cells: int = CELLS,
) -> DataFrame:
    """Exact order statistics: one row per group with the value at each 0-based rank.

    ``ranks`` are expressions over the group's row count ``n``. A mergeable quantile sketch, combined map-side, cuts
    every group into ``cells``. One more pass counts what lies below the cell a rank falls into (one number for each task)
    and the values of that cell and its neighbours: only these rows, about 3 / ``cells`` of all, are shuffled, as
    counts of equal values. The sketch is computed when the plan is built. NaN counts as the largest value,
    nulls do not count (nor do null groups), and a rank that a group does not have is null; a group without any of the
    ranks has no row.
    """
    groups = list(groups)
    rows = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in (*groups, value)])).select(*groups, value, _numeric(F.col(value), dict(df.dtypes)[value]).cast("double").alias("__v"))
    proper = F.when(~F.isnan("__v"), F.col("__v"))
    sketch = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count(proper).alias("__m"),
        F.percentile_approx(proper, [i / cells for i in range(cells + 1)], ACCURACY).alias("__cuts"),
    )
    facts = known(sketch.select(*groups, *[_bracket(rank.cast("long"), cells).alias(name) for name, rank in ranks.items()]))
    asked = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("b")) for k, name in enumerate(ranks)]), lambda e: e["b"]["r"].isNotNull())
    brackets = replace(facts, df=facts.df.select(*groups, asked.alias("__asked")))
    marked = brackets.joined_to(rows.filter(~F.isnan("__v")), groups)
    each = marked.select(*groups, value, "__v", F.explode("__asked").alias("e")).filter(F.col("__v") <= F.col("e.b.hi"))
    inside = F.col("__v") >= F.col("e.b.lo")
    counted = each.groupBy(
        *groups, F.col("e.k").alias("__k"), F.col("e.b.r").alias("__r"), inside.alias("__in"), F.when(inside, F.col(value)).alias("__value")
    ).agg(F.count(F.lit(1)).alias("__c"))
    ordered = Window.partitionBy(*groups, "__k").orderBy("__in", "__value").rowsBetween(Window.unboundedPreceding, 0)
    ends = counted.withColumn("__end", F.sum("__c").over(ordered))
    hit = F.col("__in") & (F.col("__r") < F.col("__end")) & (F.col("__r") >= F.col("__end") - F.col("__c"))
    found = [F.max(F.when(hit & (F.col("__k") == k), F.col("__value"))).alias(f"__p_{name}") for k, name in enumerate(ranks)]
    picks = facts.df.join(ends.groupBy(*groups).agg(*found), groups, "left")
    kind = dict(df.dtypes)[value]
    out = []
    for name in ranks:
        nan = F.lit(float("nan")).cast(kind) if kind in ("double", "float") else F.lit(None).cast(kind)
        lost = F.raise_error(F.lit("a rank is outside the cells around it")).cast(kind)
        pick = F.when(F.isnull(f"{name}.r"), F.lit(None).cast(kind)).when(F.col(f"{name}.nan"), nan)
        out.append(pick.when(F.isnull(f"__p_{name}"), lost).otherwise(F.col(f"__p_{name}")).alias(name))
    any_rank = F.coalesce(*[F.col(f"{name}.r") for name in ranks]).isNotNull()
    return picks.filter(any_rank).select(*groups, *out)


def _bracket(rank: Column, cells: int) -> Column:
    """The rank (null if the group has no such row), whether it is a NaN, and values it lies between for certain.

    A sketch's error is at most 1 / ACCURACY of the rows, far less than the cell that is added on each side.
    """
    cell = lambda r, by: F.least(F.floor(r.cast("double") / F.greatest("__m", F.lit(1)) * cells), F.lit(cells)).cast("int") + by
    first, last = cell(rank - 1, -1), cell(rank + 2, 2)
    low = F.when(first <= 0, F.lit(float("-inf"))).otherwise(F.get("__cuts", first))
    high = F.when(last >= cells, F.lit(float("inf"))).otherwise(F.get("__cuts", last))
    valid = (rank >= 0) & (rank < F.col("n"))
    return F.struct(F.when(valid, rank).alias("r"), (rank >= F.col("__m")).alias("nan"), low.alias("lo"), high.alias("hi"))
