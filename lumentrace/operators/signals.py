"""Signal calculation from raw traces (array form: one row per pixel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.plans.skew import Known, join_per_key, known


def scaled(trace: Column | str) -> Column:
    """Counts divided by 1000."""
    return F.transform(A.col(trace), lambda v: v / 1000)


def baseline(trace: Column | str, start: Column, end: Column) -> Column:
    """Mean over the background frames, both ends included."""
    return A.mean(A.span(A.col(trace), start, end))


def relative_change(trace: Column | str, start: Column, end: Column) -> Column:
    """V / F0 - 1, where a zero F0 divides by 1."""
    trace = A.col(trace)
    divisor = A.let(baseline(trace, start, end), lambda f: F.when(f == 0, 1.0).otherwise(f))
    return A.against(trace, divisor, lambda v, f: v / f - 1)


def _with(traces: DataFrame, facts: DataFrame | Known) -> DataFrame:
    """Facts of recordings on their traces; those that are :class:`Known` to be few move no trace."""
    if isinstance(facts, Known):
        return facts.joined_to(traces, ["measu"])
    return join_per_key(traces, facts, ["measu"], spread=["x", "y"])


def dff(traces: DataFrame, backgrounds: DataFrame | Known) -> DataFrame:
    """G3 over a movie table; ``backgrounds(measu, bg_start, bg_end)``."""
    joined = _with(traces, backgrounds)
    value = relative_change("trace", F.col("bg_start"), F.col("bg_end"))
    return joined.withColumn("trace", value).select(*traces.columns)


def ratio_change(traces1: DataFrame, traces2: DataFrame, area: DataFrame, backgrounds: DataFrame | Known) -> DataFrame:
    """Ratio of the normalised wavelengths minus each pixel's background ratio.

    The wavelengths meet once, with a flag for the area; both masked means come from one
    aggregate, are read when the plan is built (:func:`known`) and joined back. Nothing else needs an exchange: on tables
    bucketed by pixel no trace is shuffled. A zero denominator gives null where an array
    library would give inf or NaN.
    """
    pixel = ["measu", "x", "y"]
    members = area.select(*pixel).distinct().withColumn("__in", F.lit(True))
    both = traces1.join(traces2.withColumnRenamed("trace", "trace2"), pixel).join(members, pixel, "left")
    joined = _with(both, backgrounds)
    inside = joined.filter("__in")
    sums = {}
    for name, trace in (("1", "trace"), ("2", "trace2")):
        window = A.span(F.col(trace), F.col("bg_start"), F.col("bg_end"))
        sums[f"s{name}"], sums[f"n{name}"] = A.total(window), F.size(window).cast("double")
    parts = inside.select("measu", *[c.alias(n) for n, c in sums.items()])
    means = parts.groupBy("measu").agg(*[F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}")).alias(f"m{i}") for i in "12"])
    joined = known(means).joined_to(joined, ["measu"])
    m1c, m2c = F.col("m1"), F.col("m2")
    ratio = F.zip_with(
        "trace", "trace2", lambda a, b: F.try_divide(F.try_divide(a, m1c), F.try_divide(b, m2c))
    )
    with_ratio = joined.withColumn("ratio", ratio)
    base = A.mean(A.span(F.col("ratio"), F.col("bg_start"), F.col("bg_end")))
    return with_ratio.withColumn("base", base).select(
        "measu", "x", "y", A.against(F.col("ratio"), F.col("base"), lambda r, b: r - b).alias("trace")
    )


def plain_ratio(traces1: DataFrame, traces2: DataFrame) -> DataFrame:
    """First over second wavelength."""
    both = traces1.join(traces2.withColumnRenamed("trace", "trace2"), ["measu", "x", "y"])
    return both.select("measu", "x", "y", F.zip_with("trace", "trace2", F.try_divide).alias("trace"))


def signal(
    params: Params,
    traces1: DataFrame,
    backgrounds: DataFrame | Known,
    traces2: DataFrame | None = None,
    area: DataFrame | None = None,
) -> DataFrame:
    """Choose the calculation by method number."""
    method = params.calc_method
    if method == 0:
        return traces1.withColumn("trace", scaled("trace"))
    if method == 1:
        return traces2.withColumn("trace", scaled("trace"))
    if method == 3 or 3000 <= method < 4000:
        return dff(traces1, backgrounds)
    if method == 4 or 4000 <= method < 5000:
        return ratio_change(traces1, traces2, area, backgrounds)
    raise NotImplementedError(f"no calculation method {method}")
