"""Bleach correction: weights, start values, fits per pixel or per recording, areas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.functions.fits import fit_decay
from lumentrace.model import Params
from lumentrace.operators.filters import gaussian_trace
from lumentrace.plans.skew import Known, join_per_key, known

PIXEL = ["measu", "x", "y"]


def bleach_weights(n: Column, end_bg: Column, rate_hz: Column, params: Params, exclude: Column | bool) -> Column:
    """Fit weight of every frame, as an array of length ``n``. Later rules win."""
    exclude = exclude if isinstance(exclude, Column) else F.lit(exclude)
    stop = F.least(F.bround(end_bg + params.bleach_exclude_seconds * rate_hz).cast("int"), n - 1)

    def weight(t: Column) -> Column:
        base = F.when(t < end_bg, float(params.bleach_initial_factor)).otherwise(1.0)
        started = F.when(t < params.bleach_start_frame, 0.0).otherwise(base)
        return F.when(exclude & (t >= end_bg) & (t < stop), 0.0).otherwise(started)

    return F.transform(F.sequence(F.lit(0), n - 1), weight)


def start_parameters(curves: DataFrame) -> DataFrame:
    """R10 for ``curves(measu, t, y)``: A, K and offset, as aggregates only."""
    bounds = curves.groupBy("measu").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    bounds = bounds.withColumn("offset", 1.01 * F.col("lo") - 0.01 * F.col("hi"))
    points = join_per_key(curves, bounds, ["measu"], spread=["t"])
    shifted = F.when(F.col("y") > F.col("offset"), F.ln(F.col("y") - F.col("offset")))
    fit = points.groupBy("measu").agg(
        F.regr_slope(shifted, F.col("t").cast("double")).alias("k"),
        F.regr_intercept(shifted, F.col("t").cast("double")).alias("b"),
        F.any_value("offset").alias("offset"),
        F.any_value("lo").alias("lo"),
    )
    flat = F.col("offset") == F.col("lo")
    return fit.select(
        "measu",
        F.when(flat, 0.0).otherwise(F.exp("b")).alias("a"),
        F.when(flat, 1.0).otherwise(F.col("k")).alias("k"),
        F.col("offset"),
    )


def fitted_traces(rows: DataFrame, curve: str = "curve", weights: str = "weights") -> DataFrame:
    """Add ``fit`` and (``a``, ``k``, ``c``) to every row, in Arrow batches.

    Rows of a batch that share length and weights are solved together; rows without weights are not fitted.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits: list = [None] * len(batch)
            params = np.full((len(batch), 3), np.nan)
            groups: dict[bytes, list[int]] = {}
            for i, w in enumerate(batch[weights]):
                if w is None:
                    continue
                groups.setdefault(np.asarray(w, dtype=float).tobytes(), []).append(i)
            for key, members in groups.items():
                w = np.frombuffer(key)
                y = np.stack([np.asarray(batch[curve].iloc[i], dtype=float) for i in members])
                curves, values = fit_decay(y, w)
                for i, fitted, abc in zip(members, curves, values):
                    fits[i], params[i] = fitted, abc
            yield batch.assign(fit=fits, a=params[:, 0], k=params[:, 1], c=params[:, 2])

    return rows.mapInPandas(solve, f"{fields}, fit ARRAY<DOUBLE>, a DOUBLE, k DOUBLE, c DOUBLE")


def flagged(traces: DataFrame, mask: DataFrame) -> DataFrame:
    """Traces with ``in_mask``."""
    marks = mask.select(*PIXEL).distinct().withColumn("in_mask", F.lit(True))
    return traces.join(marks, PIXEL, "left").withColumn("in_mask", F.col("in_mask").isNotNull())


def _with_weights(traces: DataFrame, facts: DataFrame | Known, params: Params, where: Column | None = None) -> DataFrame:
    """``facts(measu, bg_end, rate_hz)`` decide the weights of each recording; rows outside ``where`` get none."""
    joined = known(facts).joined_to(traces, ["measu"])
    w = bleach_weights(F.size("trace"), F.col("bg_end"), F.col("rate_hz"), params, params.bleach_exclude_stimulus)
    return joined.withColumn("weights", w if where is None else F.when(where, w))


def pixelwise(traces: DataFrame, facts: DataFrame | Known, mask: DataFrame, params: Params) -> DataFrame:
    """Inside the mask y - fit + mean(fit), elsewhere unchanged; adds A, K, C."""
    return pixelwise_flagged(flagged(traces, mask), facts, params)


def pixelwise_flagged(traces: DataFrame, facts: DataFrame | Known, params: Params) -> DataFrame:
    """R12 for traces with ``in_mask``. The movie is read once; pixels outside pass through."""
    weighted = _with_weights(traces, facts, params, F.col("in_mask"))
    fitted = fitted_traces(weighted.select(*PIXEL, "trace", "weights"), curve="trace")
    ok = ~F.isnan("a") & ~F.isnan("k") & F.col("weights").isNotNull()
    level = A.mean(F.col("fit"))
    corrected = F.zip_with(
        F.zip_with("trace", "fit", lambda v, f: v - f), F.array_repeat(level, F.size("trace")), lambda d, m: d + m
    )
    inside = F.col("weights").isNotNull()
    return fitted.select(
        *PIXEL, F.when(ok, corrected).otherwise(F.col("trace")).alias("trace"), *[F.when(inside, F.col(c)).alias(c) for c in "akc"]
    )


def uniform_curves(traces: DataFrame, facts: DataFrame | Known, mask: DataFrame, masked_mean: bool = False) -> DataFrame:
    """R13 curve: frame means of F/F0 per recording; ``facts`` adds bg_start.

    As established, pixels outside the mask count as zeros in the mean of the whole
    frame. ``masked_mean=True`` averages only pixels of the mask.
    """
    return uniform_curves_flagged(flagged(traces, mask), facts, masked_mean)


def uniform_curves_flagged(traces: DataFrame, facts: DataFrame | Known, masked_mean: bool = False) -> DataFrame:
    """R13 curve of traces with ``in_mask``; frames are combined map-side."""
    joined = known(facts).joined_to(traces, ["measu"])
    f0 = A.mean(A.span(F.col("trace"), F.col("bg_start"), F.col("bg_end")))
    relative = A.against(F.col("trace"), f0, F.try_divide)
    frames = A.unrolled(joined, "measu", F.col("in_mask").alias("m"), trace=relative)
    value = F.when(F.col("m"), F.nanvl("v", F.lit(None).cast("double")))
    if not masked_mean:
        value = F.when(F.col("v").isNotNull(), F.when(F.col("m"), F.col("v")).otherwise(0.0))
    curve = frames.groupBy("measu", "t").agg(F.avg(value).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))["v"]
    return curve.groupBy("measu").agg(ordered.alias("trace"))


def uniform(traces: DataFrame, facts: DataFrame | Known, mask: DataFrame, params: Params, masked_mean: bool = False) -> DataFrame:
    """One fit per recording, subtracted from F/F0 of every pixel, times F0."""
    return uniform_flagged(flagged(traces, mask), facts, params, masked_mean)


def uniform_flagged(traces: DataFrame, facts: DataFrame | Known, params: Params, masked_mean: bool = False) -> DataFrame:
    """R13 for traces with ``in_mask``. The fits of all recordings are facts of their own (:func:`known`)."""
    facts = known(facts)
    curves = _with_weights(uniform_curves_flagged(traces, facts, masked_mean), facts, params)
    fitted = fitted_traces(curves.select("measu", "trace", "weights", "bg_start", "bg_end"), curve="trace")
    level = A.mean(F.col("fit"))
    shift = known(fitted.select("measu", A.against(F.col("fit"), level, lambda f, m: m - f).alias("shift"), "a", "k", "c", "bg_start", "bg_end"))
    joined = shift.joined_to(traces, ["measu"])
    f0 = A.mean(A.span(F.col("trace"), F.col("bg_start"), F.col("bg_end")))
    moved = F.zip_with(A.against(F.col("trace"), f0, F.try_divide), "shift", lambda v, s: v + s)
    return joined.withColumn("f0", f0).select(
        *PIXEL, A.against(moved, F.col("f0"), lambda v, f: v * f).alias("trace"), "a", "k", "c"
    )


def whole_frame(
    signal: DataFrame,
    facts: DataFrame | Known,
    mask: DataFrame,
    params: Params,
    use_mean: bool = False,
    lamp_noise_sigma: float | None = None,
) -> DataFrame:
    """Subtract the fit of the masked frame median (or mean) from a dF/F movie.

    The median is taken per (recording, frame), so a group is one frame at most.
    ``lamp_noise_sigma`` (frames per second) also removes what a 1 s Gaussian leaves of
    the curve.
    """
    return whole_frame_flagged(flagged(signal, mask), facts, params, ["trace"], use_mean, lamp_noise_sigma).select(*PIXEL, "trace", "a", "k", "c")


def whole_frame_flagged(
    signal: DataFrame,
    facts: DataFrame | Known,
    params: Params,
    columns: Sequence[str],
    use_mean: bool = False,
    lamp_noise_sigma: float | None = None,
) -> DataFrame:
    """R14 for traces with ``in_mask``: every one of ``columns`` less the fit of its own curve.

    The curves of all columns come from one pass; a, k and c belong to the last one.
    """
    inside = signal.filter("in_mask").select("measu", F.arrays_zip(*columns).alias("zipped"))
    reduce = F.avg if use_mean else (lambda c: F.percentile(c, F.lit(0.5)))
    frames = A.unrolled(inside, "measu", trace="zipped")
    curve = frames.groupBy("measu", "t").agg(*[reduce(f"v.{c}").alias(c) for c in columns])
    ordered = F.array_sort(F.collect_list(F.struct("t", *columns)))
    curves = curve.groupBy("measu").agg(ordered.alias("o")).select("measu", *[F.col("o").getField(c).alias(c) for c in columns])
    fits = _with_weights(curves.withColumn("trace", F.col(columns[0])), facts, params).select("measu", *dict.fromkeys([*columns, "trace"]), "weights")
    for c in columns:
        fits = fitted_traces(fits.drop("a", "k", "c"), curve=c)
        detract = F.col("fit")
        if lamp_noise_sigma:
            fast = F.zip_with(c, gaussian_trace(F.col(c), lamp_noise_sigma), lambda v, g: v - g)
            detract = F.zip_with(detract, fast, lambda f, n: f + n)
        fits = fits.withColumn(f"__d_{c}", detract).drop("fit")
    shifts = known(fits.select("measu", *[f"__d_{c}" for c in columns], "a", "k", "c"))
    joined = shifts.joined_to(signal, ["measu"])
    left = {c: F.zip_with(c, f"__d_{c}", lambda v, d: v - d) for c in columns}
    return joined.withColumns(left).drop(*[f"__d_{c}" for c in columns])


def marked(traces: DataFrame, area: DataFrame, nx: int | Column, ny: int | Column, params: Params) -> DataFrame:
    """Traces with ``in_mask`` by the rule of :func:`bleach_area`; the centre rectangle needs no join."""
    if params.bleach_exclude_area:
        return flagged(traces, area)
    return traces.withColumn("in_mask", _in_centre(nx, ny, params))


def _in_centre(nx: int | Column, ny: int | Column, params: Params) -> Column:
    cut_x, cut_y = (F.bround(A.lit(n) * params.bleach_cut_border / 100).cast("int") for n in (nx, ny))
    return F.col("x").between(cut_x, A.lit(nx) - cut_x - 1) & F.col("y").between(cut_y, A.lit(ny) - cut_y - 1)


def bleach_area(pixels: DataFrame, area: DataFrame, nx: int | Column, ny: int | Column, params: Params) -> DataFrame:
    """The area mask, or the centre rectangle after cutting a percentage per side. Sizes may be columns."""
    if params.bleach_exclude_area:
        return area.select("measu", "x", "y").distinct()
    return pixels.select("measu", "x", "y").filter(_in_centre(nx, ny, params)).distinct()


def area_from_planes(planes: DataFrame) -> DataFrame:
    """Pixels that are positive in any plane. ``planes(measu, x, y, v)``."""
    positive = planes.groupBy("measu", "x", "y").agg(F.bool_or(F.col("v") > 0).alias("in_area"))
    return positive.filter("in_area").select("measu", "x", "y")


def with_area(pixels: DataFrame, area: DataFrame) -> DataFrame:
    """Flag pixels by the area; a recording without an area file is all true."""
    key = ["measu", "x", "y"]
    members = area.select(*key).distinct()
    has = known(members.select("measu").distinct().withColumn("__has", F.lit(True)))
    marked = pixels.join(members.withColumn("__in", F.lit(True)), key, "left")
    joined = has.joined_to(marked, ["measu"], "left")
    return joined.withColumn("in_area", F.col("__in").isNotNull() | F.col("__has").isNull()).drop("__in", "__has")
