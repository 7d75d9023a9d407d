"""Trace features: each turns one trace into a list of values.

A feature is a function ``(trace, ctx) -> list[Column]``. Values whose frames fall
outside the trace are null; `safe` turns them into NaN for region tables.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.model import Params


@dataclass(frozen=True)
class FeatureContext:
    """What a feature may read beside the trace: columns of the same row, or literals."""

    period_ms: Column = field(default_factory=lambda: F.lit(200.0))
    first_frame: Column = field(default_factory=lambda: F.lit(25))
    last_frame: Column = field(default_factory=lambda: F.lit(45))
    on_ms: Column = field(default_factory=lambda: F.lit(None).cast("double"))
    background: tuple[Column, Column] = field(default_factory=lambda: (F.lit(3), F.lit(5)))
    params: Params = field(default_factory=Params)

    @classmethod
    def from_params(cls, params: Params, **columns) -> "FeatureContext":
        return cls(
            first_frame=F.lit(params.first_frame),
            last_frame=F.lit(params.last_frame),
            params=params,
            **columns,
        )


Feature = Callable[[Column, FeatureContext], list[Column]]
FEATURES: dict[str, Feature] = {}


def _feature(*names: int | str) -> Callable[[Feature], Feature]:
    def register(fn: Feature) -> Feature:
        for name in names:
            FEATURES[str(name)] = fn
        return fn

    return register


def _within(i: Column, low: int, high: Column) -> Column:
    return (i >= low) & (i <= high)


@_feature(22)
def rise_three(trace: Column, ctx: FeatureContext) -> list[Column]:
    """Mean of 3 frames around last minus mean of 3 around first."""
    return [A.around(trace, ctx.last_frame) - A.around(trace, ctx.first_frame)]


@_feature(222)
def rise_four(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C222: mean of 4 frames from last minus mean of 4 from first."""

    def four(i: Column) -> Column:
        return (A.at(trace, i) + A.at(trace, i + 1) + A.at(trace, i + 2) + A.at(trace, i + 3)) / 4

    return [four(ctx.last_frame) - four(ctx.first_frame)]


@_feature(35)
def peak_after_onset(trace: Column, ctx: FeatureContext) -> list[Column]:
    """3-frame mean at the maximum within 3 s after onset minus the pre-onset mean."""
    n = F.size(trace)
    start = (ctx.on_ms / ctx.period_ms).cast("int") + 1
    end = F.least(((ctx.on_ms + 3000) / ctx.period_ms).cast("int") + 1, n - 1)

    def clamp(i: Column) -> Column:
        return F.least(F.greatest(i, F.lit(1)), n - 2)

    def contrast(peak: Column) -> Column:
        before = clamp(start - ctx.params.prestim_end_background)
        return F.when(peak.isNotNull(), A.around(trace, clamp(peak)) - A.around(trace, before))

    return [F.when(start <= end, A.let(A.first_argmax(A.span(trace, start, end)) + start, contrast))]


@_feature("22and35")
def rise_and_peak(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C22_35: both features."""
    return rise_three(trace, ctx) + peak_after_onset(trace, ctx)


def _window(trace: Column, ctx: FeatureContext, reduce: Callable[[Column], Column]) -> list[Column]:
    # One frame more than the parameter says is included, as users of this feature expect.
    n = F.size(trace)
    end = ctx.last_frame + 1
    ok = _within(end, 0, n - 1) & _within(ctx.first_frame, 0, n - 1)
    return [F.when(ok, reduce(A.span(trace, ctx.first_frame, end)))]


@_feature(300)
def mean_all(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C300."""
    return [A.nanmean(trace)]


@_feature(301)
def mean_early(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C301: frames 4..9."""
    return [A.nanmean(A.span(trace, 4, 9))]


@_feature(302)
def mean_window(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C302: first .. last + 1."""
    return _window(trace, ctx, A.nanmean)


@_feature(303, 0)
def mean_background(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C303 and its alias C0: background frames, end included."""
    return [A.nanmean(A.span(trace, *ctx.background))]


@_feature(330)
def median_all(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C330."""
    return [A.nanmedian(trace)]


@_feature(331)
def median_early(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C331: frames 4..9."""
    return [A.nanmedian(A.span(trace, 4, 9))]


@_feature(332)
def median_window(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C332: first .. last + 1."""
    return _window(trace, ctx, A.nanmedian)


@_feature(333)
def median_background(trace: Column, ctx: FeatureContext) -> list[Column]:
    """C333: background frames, end included."""
    return [A.nanmedian(A.span(trace, *ctx.background))]


@_feature("chunk_magnitude_basic")
def chunk_magnitude(trace: Column, ctx: FeatureContext | None = None) -> list[Column]:
    """C_chunk: (value at peak - value at base, base position, peak position).

    The response rides on a flat or falling baseline. The search starts at the lowest
    value of the left half; which of the later extremes comes first decides the sign.
    """
    found = _chunk_extremes(trace)
    return [found["value"], found["base"], found["peak"]]


def _chunk_extremes(trace: Column) -> Column:
    def left(half: Column) -> Column:
        return F.struct(A.first_argmin(half).alias("low"), A.first_argmax(half).alias("high"))

    def right(first: Column) -> Column:
        rest = A.span(trace, first["low"], F.size(trace))
        return F.struct(
            first["low"].alias("start"), first["high"].alias("left_high"),
            A.first_argmin(rest).alias("low"), A.first_argmax(rest).alias("high"),
        )

    def ends(s: Column) -> Column:
        only_left = (s["low"] != 0) & (s["high"] == 0)
        negative = (s["low"] != 0) & (s["low"] < s["high"])
        return F.struct(
            (s["start"] + F.when(negative & ~only_left, s["high"]).otherwise(s["low"])).alias("base"),
            F.when(only_left, s["left_high"]).when(negative, s["start"] + s["low"]).otherwise(s["start"] + s["high"]).alias("peak"),
        )

    def measured(e: Column) -> Column:
        value = A.at(trace, e["peak"]) - A.at(trace, e["base"])
        return F.struct(value.alias("value"), e["base"].alias("base"), e["peak"].alias("peak"))

    half = A.span(trace, 0, F.floor(F.size(trace) / 2) - 1)
    return A.let(A.let(A.let(A.let(half, left), right), ends), measured)


def chunk_value(trace: Column) -> Column:
    """C_basic: only the magnitude."""
    return _chunk_extremes(trace)["value"]


def strongest_index(trace: Column) -> Column:
    """Position of the first largest absolute value."""
    return A.first_argmax(F.transform(trace, F.abs))


def response_positive(trace: Column) -> Column:
    """C_sign."""
    return A.at(trace, strongest_index(trace)) > 0


def contaminated(trace: Column) -> Column:
    """C_contam: the strongest value lies outside the middle half."""
    n, i = F.size(trace), strongest_index(trace)
    return ~((i >= n * 0.25) & (i <= n * 0.75))


def early_mean(trace: Column) -> Column:
    """C_leg 1: mean of frames 10..18."""
    return A.mean(A.span(trace, 10, 18))


def rise_three_sum(trace: Column, ctx: FeatureContext) -> Column:
    """C_leg 22: sums instead of means."""
    return 3 * A.around(trace, ctx.last_frame) - 3 * A.around(trace, ctx.first_frame)


def onset_contrast_sum(trace: Column, onset: Column, rate_hz: Column) -> Column:
    """C_leg 23: sum of [on+2, on+3 s) minus sum of [on-3 s, on-1)."""
    after = A.span(trace, onset + 2, F.bround(onset + 3 * rate_hz).cast("int") - 1)
    before = A.span(trace, F.bround(onset - 3 * rate_hz).cast("int"), onset - 2)
    return A.total(after) - A.total(before)


def onset_peak_contrast(trace: Column, onset: Column, rate_hz: Column) -> Column:
    """C_leg 35: maximum of [on, on+3 s) minus the value just before onset."""
    after = A.span(trace, onset, F.bround(onset + 3 * rate_hz).cast("int") - 1)
    return F.array_max(after) - A.mean(A.span(trace, onset - 2, onset - 2))


def safe(values: Sequence[Column]) -> list[Column]:
    """C_safe: values that cannot be computed become NaN."""
    return [F.coalesce(v.cast("double"), F.lit(float("nan"))) for v in values]


def feature(name: int | str) -> Feature:
    try:
        return FEATURES[str(name)]
    except KeyError:
        raise NotImplementedError(f"no feature named {name!r}") from None


def available_features(spark: SparkSession) -> DataFrame:
    """C_list: the features known by number."""
    numbers = sorted(int(n) for n in FEATURES if n.isdigit())
    return spark.createDataFrame([(n,) for n in numbers], "feature INT")


def apply_feature(traces: DataFrame, name: int | str, ctx: FeatureContext, trace: str = "trace") -> DataFrame:
    """C_apply: feature values of every row, one output row per feature number."""
    values = F.array(*[v.cast("double") for v in feature(name)(F.col(trace), ctx)])
    keep = [c for c in ("measu", "roi", "x", "y") if c in traces.columns]
    return A.unrolled(traces, *keep, trace=values, names=("feature", "value"))


def apply_features(traces: DataFrame, names: Sequence[int | str], ctx: FeatureContext, trace: str = "trace") -> DataFrame:
    """C_apply for several features in one pass: a row per feature and value, with the feature's name and the value's number."""
    each = [
        F.struct(F.lit(str(name)).alias("feature"), F.lit(i).alias("part"), v.cast("double").alias("value"))
        for name in names for i, v in enumerate(feature(name)(F.col(trace), ctx))
    ]
    keep = [c for c in ("measu", "roi", "x", "y") if c in traces.columns]
    return traces.select(*keep, F.explode(F.array(*each)).alias("e")).select(*keep, "e.*")


# The argument names of a user feature, in order; part of the user-function contract.
USER_FEATURE_ARGUMENTS = (
    "time_trace",
    "sampling_period",
    "first_frame",
    "last_frame",
    "stimulus_number",
    "stim_on_times",
    "stim_off_times",
    "flags",
    "p1",
)


def user_feature(fn: Callable, params: Params | None = None, period_ms: float = 200.0) -> Callable[..., Column]:
    """A user's Python feature as an Arrow-batched column function.

    The result takes the trace and, as columns of the same row, the period, the on- and
    off-times of the recording's pulses (arrays, in ms) and its facts (a struct, which the
    function gets as a dict in ``p1``). ``fn`` gets the trace as an array, the parameters in
    ``flags`` and returns a list.
    """
    given = tuple(inspect.signature(fn).parameters)
    if given != USER_FEATURE_ARGUMENTS:
        raise TypeError(f"a feature function takes {USER_FEATURE_ARGUMENTS}, not {given}")
    p = params or Params()

    @F.pandas_udf("array<double>")
    def run(traces: pd.Series, periods: pd.Series, on: pd.Series, off: pd.Series, facts: pd.DataFrame) -> pd.Series:
        rows = facts.to_dict("records")
        values = [
            [
                float(v)
                for v in fn(
                    time_trace=trace,
                    sampling_period=period,
                    first_frame=p.first_frame,
                    last_frame=p.last_frame,
                    stimulus_number=p.stimulus_number,
                    stim_on_times=None if start is None else list(start),
                    stim_off_times=None if end is None else list(end),
                    flags=p,
                    p1=row,
                )
            ]
            for trace, period, start, end, row in zip(traces, periods, on, off, rows)
        ]
        return pd.Series(values, index=traces.index, dtype=object)

    def column(
        trace: Column, period: Column | None = None, on: Column | None = None, off: Column | None = None, facts: Column | None = None
    ) -> Column:
        times = F.lit(None).cast("array<double>")
        return run(
            trace, F.lit(float(period_ms)) if period is None else period, times if on is None else on,
            times if off is None else off, F.struct(F.lit(None).cast("string").alias("measu")) if facts is None else facts,
        )

    return column


# --- frame-mask features: a linear combination of frames -----------------------------


def frame_weights(name: int, n: Column, ctx: FeatureContext) -> Column:
    """C_frame weights of methods 12, 20 and 22 as an array of length ``n``."""
    first, last = ctx.first_frame, ctx.last_frame

    def weight(i: Column) -> Column:
        if name == 12:
            return F.when((i >= first) & (i <= last), 1.0 / (last + 1 - first)).otherwise(0.0)
        if name == 20:
            return F.when(i == first, -1.0).when(i == last, 1.0).otherwise(0.0)
        if name == 22:
            return (
                F.when(F.abs(i - first) <= 1, -1.0 / F.lit(3.0)).when(F.abs(i - last) <= 1, 1.0 / F.lit(3.0)).otherwise(0.0)
            )
        raise NotImplementedError(f"no frame mask {name!r}")

    return F.transform(F.sequence(F.lit(0), n - 1), weight)


def weighted_sum(trace: Column, weights: Column) -> Column:
    return A.total(F.zip_with(trace, weights, lambda v, w: v * w))


def frame_mask_overview(traces: DataFrame, name: int, ctx: FeatureContext) -> DataFrame:
    """C_frame for the fixed-frame methods: no shuffle, one pass over the traces."""
    trace = F.col("trace")
    return traces.select("measu", "x", "y", weighted_sum(trace, frame_weights(name, F.size(trace), ctx)).alias("value"))


def global_peak_overview(traces: DataFrame, onsets: DataFrame, rate_hz: float) -> DataFrame:
    """C_frame 35: the frame-mean curve picks one peak frame per recording.

    ``onsets(measu, onset_frame)``. The curve is averaged map-side per (recording, frame).
    The three frames around the peak weigh 1/3, then the three before the onset -1/3, which
    holds where both meet; frames that do not exist weigh nothing.
    """
    from lumentrace.plans.skew import join_per_key

    marked = join_per_key(traces, onsets, ["measu"], spread=["x", "y"])
    stop = F.col("onset_frame") + int(3 * rate_hz)
    frames = A.unrolled(marked, "measu", "onset_frame")
    curve = (
        frames.filter((F.col("t") >= F.col("onset_frame")) & (F.col("t") < stop))
        .groupBy("measu", "t")
        .agg(F.avg("v").alias("v"))
    )
    peaks = curve.groupBy("measu").agg((-F.max(F.struct("v", (-F.col("t")).alias("k")))["k"]).alias("peak"))
    trace, on, peak = F.col("trace"), F.col("onset_frame"), F.col("peak")

    def weight(i: Column) -> Column:
        return F.when(F.abs(i - (on - 2)) <= 1, F.lit(-1.0)).when(F.abs(i - peak) <= 1, F.lit(1.0)).otherwise(0.0)

    near = F.array_distinct(F.concat(*[F.array(on - 3 + k, peak - 1 + k) for k in range(3)]))
    value = A.total(F.transform(near, lambda i: F.coalesce(A.at(trace, i) * weight(i), F.lit(0.0)))) / 3
    return join_per_key(marked, peaks, ["measu"], spread=["x", "y"]).select("measu", "x", "y", value.alias("value"))


# --- response delay and model choice --------------------------------------------------


def rising_phases(rows: np.ndarray) -> np.ndarray:
    """Traces (rows) with all values but those of the rising phase set to the median."""
    low, high = rows.min(1, keepdims=True), rows.max(1, keepdims=True)
    middle = np.median(rows, axis=1, keepdims=True)
    falls = np.zeros(rows.shape, bool)
    falls[:, :-1] = np.diff(rows, axis=1) <= 0
    kept = np.where(falls, middle, rows)
    return np.where(kept >= low + 0.85 * (high - low), middle, kept)


def best_lags(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair of rows, the smallest lag at which their full cross-correlation is largest.

    All lags come from one Fourier transform of the stacked rows; where several are the largest but for rounding, these
    few are summed directly.
    """
    n, k = first.shape[1], second.shape[1]
    size = 1 << (n + k - 2).bit_length()
    spectrum = np.fft.rfft(first, size) * np.conj(np.fft.rfft(second, size))
    around = np.fft.irfft(spectrum, size)
    full = np.concatenate([around[:, size - k + 1 :], around[:, :n]], axis=1)
    margin = 1e-10 * np.linalg.norm(first, axis=1) * np.linalg.norm(second, axis=1)
    close = full >= (full.max(1) - margin)[:, None]
    best = np.argmax(full, axis=1)
    for i in np.flatnonzero(close.sum(1) > 1):
        best[i] = max(np.flatnonzero(close[i]), key=lambda j: (_at_lag(first[i], second[i], j - k + 1), -j))
    return best - k + 1


def _at_lag(a: np.ndarray, b: np.ndarray, lag: int) -> float:
    start, stop = max(lag, 0), min(len(a), len(b) + lag)
    return float(np.dot(a[start:stop], b[start - lag : stop - lag]))


#: Values whose transforms a batch holds at once.
_TRANSFORMED = 1 << 21


def rising_phase_delay(stimulus: Column, output: Column) -> Column:
    """C_delay: lag of the best cross-correlation of the rising phases, per row; null without both traces.

    Rows of a batch whose traces are equally long are transformed together. A NaN makes every lag equal, so the first counts.
    """

    @F.pandas_udf("int")
    def lag(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(a), index=a.index, dtype="Int32")
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (s, r) in enumerate(zip(a, b)):
            if s is not None and r is not None and len(s) and len(r):
                groups.setdefault((len(s), len(r)), []).append(i)
        for (n, k), members in groups.items():
            step = max(1, _TRANSFORMED // (n + k))
            for cut in range(0, len(members), step):
                rows = members[cut : cut + step]
                first, second = (rising_phases(np.stack([np.asarray(c.iloc[i], dtype=float) for i in rows])) for c in (a, b))
                out.iloc[rows] = best_lags(first, second) + (k - n)
        return out

    return lag(stimulus, output)


def model_score(residual_sum: Column, n: Column, k: Column) -> Column:
    """C_bic: n ln(RSS / n) + k ln n."""
    return n * F.ln(residual_sum / n) + k * F.ln(n)


def choose_model(scores: DataFrame, keys: Sequence[str], margin: float = 50.0) -> DataFrame:
    """C_bic choice: best one-component candidate unless the best two-component one is
    better by more than ``margin``. ``scores(keys..., model, components, bic)``."""

    def best(components: int) -> Column:
        candidate = F.when(F.col("components") == components, F.struct("bic", "model"))
        return F.min(candidate).alias(f"best{components}")

    chosen = scores.groupBy(*keys).agg(best(1), best(2))
    two = F.col("best2.bic") < F.col("best1.bic") - margin
    return chosen.select(
        *keys,
        F.when(two, F.col("best2.model")).otherwise(F.col("best1.model")).alias("model"),
        F.when(two, F.col("best2.bic")).otherwise(F.col("best1.bic")).alias("bic"),
    )
