"""Whole analyses composed of operators; each is one lazy plan over all recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.operators import bleach as B
from lumentrace.operators import filters as R
from lumentrace.operators import overview as O
from lumentrace.operators import rois as I
from lumentrace.operators import signals as G
from lumentrace.operators import stimuli as T
from lumentrace.operators import tiles as W
from lumentrace.plans.skew import Known, known
from lumentrace.session import cut_lineage


def _settled(df: DataFrame, materialise: bool | None) -> DataFrame:
    """Cut the lineage if asked to, or (None) wherever a checkpoint folder is set; a movie that is read twice is then computed once."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return cut_lineage(df) if materialise or (materialise is None and folder) else df


def correction_steps(params: Params, pixel_size: tuple[float, float]) -> list:
    """The neighbourhood filters of R27 in their order: median, mean, scattered light."""
    steps: list = []
    sizes = R.filter_sizes(params.median_filter, params.median_filter_space, params.median_filter_time)
    if sizes:
        steps.append(W.Median(*sizes))
    sizes = R.filter_sizes(params.mean_filter, params.mean_filter_space, params.mean_filter_time)
    if sizes:
        steps.append(W.Mean(*sizes))
    if params.scatter_factor > 0:
        steps.append(W.Scatter(params.scatter_factor, R.scatter_radius(params.scatter_radius_um, *pixel_size)))
    return steps


def corrected(
    traces: DataFrame,
    facts: DataFrame,
    area: DataFrame,
    params: Params,
    nx: int | Column,
    ny: int | Column,
    pixel_size: tuple[float, float] = (1.0, 1.0),
    materialise: bool | None = None,
    frames: int | None = None,
) -> DataFrame:
    """Replace first frames, median, mean, scattered light, bleaching, in this order.

    ``facts(measu, bg_start, bg_end, rate_hz)``. Steps that are off cost nothing. All neighbourhood filters share one
    shuffle to tiles if ``frames`` bounds the length of a recording, else two. Bleach
    correction reads the filtered movie twice: it is written to the checkpoint folder before, where there is one
    (``materialise=False``: never).
    """
    if params.replace_init_frames:
        traces = traces.withColumn("trace", R.replaced_start(F.col("trace"), params.replace_init_frames))
    steps = correction_steps(params, pixel_size)
    if params.bleach_method == "None":
        return W.filtered(traces, steps, frames=frames)
    flagged = B.marked(traces, area, nx, ny, params)
    flagged = _settled(W.filtered(flagged, steps, keep=["in_mask"], frames=frames), materialise)
    held = known(facts.select("measu", "bg_start", "bg_end", "rate_hz"))
    if params.bleach_method in ("log_pixelwise_1cpu", "log_pixelwise_parallel"):
        return B.pixelwise_flagged(flagged, held, params).select("measu", "x", "y", "trace")
    if params.bleach_method == "log_uniform":
        return B.uniform_flagged(flagged, held, params).select("measu", "x", "y", "trace")
    raise NotImplementedError(f"no bleach method {params.bleach_method!r}")


def composite_signal(
    traces1: DataFrame,
    facts: DataFrame,
    area: DataFrame,
    params: Params,
    nx: int | Column,
    ny: int | Column,
    traces2: DataFrame | None = None,
    pixel: tuple[float, float] = (1.0, 1.0),
    materialise: bool | None = None,
    frames: int | None = None,
) -> DataFrame:
    """Methods 3xyy (one wavelength) and 4xyy (ratio): x is the bleach digit, yy the
    scattered-light radius in micrometres. The background ends before its end frame.

    Bleach digit: 0-3 use the area mask, others the centre rectangle; odd excludes the stimulus; 2, 3, 6, 7 remove lamp
    noise; 9 is no bleach correction. Both wavelengths, the mask and the background images share a row from the start, so
    movies are joined once and filtered once; what belongs to a recording is broadcast when counted small.
    """
    digit, sigma_um = params.calc_method // 100 % 10, params.calc_method % 100
    ratio = params.calc_method // 1000 == 4
    key = ["measu", "x", "y"]
    channels = ["trace", "trace2"] if ratio else ["trace"]
    both = traces1.select(*key, "trace")
    if ratio:
        both = both.join(traces2.select(*key, F.col("trace").alias("trace2")), key)
    held = known(facts.select("measu", "bg_start", "bg_end", "rate_hz"))
    rows = held.joined_to(B.marked(both, area, nx, ny, params.with_(bleach_exclude_area=digit <= 3)), ["measu"])
    window = lambda c: A.span(F.col(c), F.col("bg_start"), F.col("bg_end") - 1)
    rows = rows.withColumns({f"b_{c}": A.mean(window(c)) for c in channels})
    light = rows.filter("in_mask").groupBy("measu").agg(*[F.avg(f"b_{c}").alias(f"l_{c}") for c in channels])
    level = lambda c: 1000.0 / F.when(F.col(f"l_{c}") == 0, 1.0).otherwise(F.col(f"l_{c}"))
    rows = known(light).joined_to(rows, ["measu"])
    rows = rows.withColumns({c: A.against(F.col(c), level(c), lambda v, k: v * k) for c in channels})
    steps = []
    if sigma_um and params.scatter_factor:
        steps.append(W.Scatter(abs(params.scatter_factor), R.scatter_radius(float(sigma_um), *pixel), once=params.scatter_factor > 0))
    kept = ["in_mask", "bg_start", "bg_end", *[f"b_{c}" for c in channels]]
    signal = W.filtered(rows, steps, channels, kept, frames)
    signal = signal.withColumns({c: G.relative_change(c, F.col("bg_start"), F.col("bg_end")) for c in channels})
    if digit != 9:
        fit = params.with_(bleach_exclude_stimulus=digit in (1, 3, 5, 7))
        noise = 1000.0 / 200.0 if digit in (2, 3, 6, 7) else None
        rates = Known(held.df.select("measu", F.col("bg_end"), "rate_hz"), held.small)
        signal = B.whole_frame_flagged(_settled(signal, materialise), rates, fit, channels, lamp_noise_sigma=noise)
    if ratio:
        quotient = F.zip_with("trace", "trace2", lambda a, b: F.try_divide(1 + a, 1 + b))
        signal = signal.withColumn("trace", A.against(quotient, F.try_divide("b_trace", "b_trace2"), lambda q, s: q * s))
    return signal.select(*key, A.against(F.col("trace"), A.mean(window("trace")), lambda v, b: v - b).alias("trace"))


def region_signals(signal: DataFrame, members: DataFrame, area: DataFrame | None, params: Params) -> DataFrame:
    """Region traces of a signal movie, inside the area when the parameters ask for it."""
    weights = I.weighted(members)
    if params.within_area:
        weights = I.weighted_within(weights, area)
    return I.roi_traces(signal, weights)


def movie_table(
    signal: DataFrame,
    stimuli: DataFrame,
    params: Params,
    nx: int,
    ny: int,
    n: int,
    raw: DataFrame,
    area: DataFrame | None = None,
    period_ms: float = 200.0,
    materialise: bool | None = None,
) -> DataFrame:
    """Frames of a movie as rows: filtered, cropped, scaled to 0..1, masked, with the
    time and stimulus text of their frame.

    The filtered movie is read again for its limits: with a filter, and where there is a checkpoint folder, it is written there
    in between (``materialise``: always or never).
    """
    if params.time_filter and params.time_filter_size > 0:
        signal = signal.withColumn("trace", R.gaussian_trace(F.col("trace"), params.time_filter_size))
    if params.space_filter and params.space_filter_size > 0:
        signal = W.filtered(signal, [W.Gaussian(params.space_filter_size)], frames=n)
    start, end = O.frame_range(params.movie_first_frame, params.movie_last_frame, n)
    kept = R.exploded(signal).filter(F.col("t").between(start, end - 1))
    pixels = O.cropped(kept, params.cut_border, nx, ny)
    if materialise or params.time_filter or params.space_filter:
        pixels = _settled(pixels, materialise)
    inner_area = O.cropped(area, params.cut_border, nx, ny) if area is not None else None
    w, h, _ = O.cropped_size(params, nx, ny, n)
    limits = O.data_limits(pixels, params, w, h, inner_area)
    scaled = O.scaled_pixels(pixels, limits, params.individual_scale)
    # Thresholds look at raw or foto values of the cropped frame.
    raw_kept = O.cropped(R.exploded(raw).filter(F.col("t").between(start, end - 1)), params.cut_border, nx, ny)
    foto = O.cropped(R.morphology(raw), params.cut_border, nx, ny)
    masked = O.masked_movie(scaled, params, raw_kept, foto, inner_area)
    recordings = raw.select("measu").distinct()
    frames = recordings.withColumn("t", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
    frames = frames.withColumn("t_ms", F.col("t") * period_ms)
    frames = frames.withColumn("frame_key", F.struct("measu", "t"))
    texts = T.frame_labels(stimuli, frames, "frame_key")
    times = T.relative_times(texts, stimuli, with_ms=not params.suppress_milliseconds)
    return masked.join(times.select("measu", "t", "time_text", "stimulus_text"), ["measu", "t"])
