"""Overview images and movies as tables: crop, limits, normalisation, masks, composition."""

from __future__ import annotations

import colorsys
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.functions import features as C
from lumentrace.model import Params
from lumentrace.plans.ranking import carried_forward, numbered, rank_picks
from lumentrace.plans.skew import join_per_key

PIXEL = ["measu", "x", "y"]


def overview_frames(
    traces: DataFrame, feature: int | str, ctx: C.FeatureContext, number: int | Sequence[int] | str = 0
) -> DataFrame:
    """O1: feature images; ``number`` is one feature, a list or ``"all"``."""
    available = len(C.feature(feature)(F.col("trace"), ctx))
    wanted = list(range(available)) if number == "all" else [number] if isinstance(number, int) else list(number)
    if any(n < 0 or n >= available for n in wanted):
        raise ValueError(f"feature numbers are 0..{available - 1}, asked for {wanted}")
    frames = C.apply_feature(traces, feature, ctx)
    return frames if len(wanted) == available else frames.filter(F.col("feature").isin(wanted))


def overview_grid(traces: DataFrame, stimuli: DataFrame, feature: int | str, params: Params) -> DataFrame:
    """O2: the feature of every pixel for every stimulus of its recording.

    A trace meets the pulses of its recording as one array and is read once per pulse where
    it lies; only feature values are multiplied by pulses.
    """
    pulse = F.struct("stim_idx", "on_ms", "period_ms")
    pulses = stimuli.groupBy("measu").agg(F.collect_list(pulse).alias("__pulses"))
    joined = join_per_key(traces, pulses, ["measu"], spread=["x", "y"])

    def at(p: Column) -> Column:
        ctx = C.FeatureContext.from_params(params, on_ms=p["on_ms"], period_ms=p["period_ms"])
        values = [v.cast("double") for v in C.feature(feature)(F.col("trace"), ctx)]
        return F.struct(p["stim_idx"].alias("stim_idx"), F.array(*values).alias("values"))

    found = joined.select(*PIXEL, F.explode(F.transform("__pulses", at)).alias("__f"))
    rows = found.select(*PIXEL, "__f.stim_idx", "__f.values")
    return A.unrolled(rows, *PIXEL, "stim_idx", trace="values", names=("feature", "value"))


def check_border(cut: int, nx: int | Column, ny: int | Column) -> None:
    if isinstance(nx, Column) or isinstance(ny, Column):
        return  # checked row by row
    if cut >= 0.5 * nx or cut >= 0.5 * ny:
        raise ValueError(f"border {cut} is too large for a frame of {nx} x {ny}")


def inside_border(cut: int, nx: int | Column, ny: int | Column) -> Column:
    inside = F.col("x").between(F.lit(cut), A.lit(nx) - cut - 1) & F.col("y").between(F.lit(cut), A.lit(ny) - cut - 1)
    too_large = (2 * cut >= A.lit(nx)) | (2 * cut >= A.lit(ny))
    return F.when(too_large, F.raise_error(F.lit("the border is too large for a frame")).cast("boolean")).otherwise(inside)


def cropped(pixels: DataFrame, cut: int, nx: int | Column, ny: int | Column) -> DataFrame:
    """O3: cut a border on every side; positions count from the new corner. Sizes may be columns."""
    check_border(cut, nx, ny)
    kept = pixels.filter(inside_border(cut, nx, ny))
    return kept.withColumns({"x": F.col("x") - cut, "y": F.col("y") - cut})


def exclusion_mask(pixels: DataFrame, cut: int, nx: int | Column, ny: int | Column) -> DataFrame:
    """O3: true for pixels that the crop removes."""
    check_border(cut, nx, ny)
    return pixels.select(*PIXEL, (~inside_border(cut, nx, ny)).alias("excluded"))


def frame_range(first: int, last: int, n: int) -> tuple[int, int]:
    """Frames kept, as [start, end): negative first is 0, last <= 0 is the end."""
    start = min(max(first, 0), n)
    end = min(last + 1, n) if last > 0 else n
    if start >= end:
        raise ValueError(f"no frames between {first} and {last} in a movie of {n}")
    return start, end


def cropped_movie(traces: DataFrame, params: Params, nx: int, ny: int, n: int) -> DataFrame:
    """Border and frame crop of a movie; ``t`` keeps counting from the original."""
    start, end = frame_range(params.movie_first_frame, params.movie_last_frame, n)
    cut = cropped(traces, params.cut_border, nx, ny)
    return cut.withColumns({"trace": A.span(F.col("trace"), start, end - 1), "first_frame": F.lit(start)})


def cropped_size(params: Params, nx: int, ny: int, n: int) -> tuple[int, int, int]:
    """Size after the crop."""
    check_border(params.cut_border, nx, ny)
    start, end = frame_range(params.movie_first_frame, params.movie_last_frame, n)
    return nx - 2 * params.cut_border, ny - 2 * params.cut_border, end - start


def data_limits(
    pixels: DataFrame, params: Params, nx: int | Column, ny: int | Column, area: DataFrame | None = None, value: str = "v"
) -> DataFrame:
    """Lower and upper limit per recording, of frames or movies alike.

    Unit digit: 0/1 fixed; 2 data; 3 centre rectangle; 4 fixed minimum; 5 inside the
    area; 6 fixed minimum, inside the area. Percentiles pick the element nearest to the
    rank (half-even), found by counting, not by sorting a movie.
    """
    mode = params.individual_scale % 10
    if mode in (0, 1):
        return pixels.select("measu").distinct().select(
            "measu", F.lit(params.scale_min).alias("vmin"), F.lit(params.scale_max).alias("vmax")
        )
    if mode not in (2, 3, 4, 5, 6):
        raise NotImplementedError(f"no scale mode {mode}")
    chosen = pixels
    if mode == 3:
        bx, by = ((A.lit(n) * params.scale_margin).cast("int") for n in (nx, ny))
        chosen = pixels.filter(F.col("x").between(bx, A.lit(nx) - bx - 1) & F.col("y").between(by, A.lit(ny) - by - 1))
    if mode in (5, 6):
        chosen = pixels.join(area.select(*PIXEL).distinct(), PIXEL, "left_semi")
    if params.percentile_scale:
        p, n = params.percentile_value / 100, F.col("n")
        limits = rank_picks(
            chosen, value, ["measu"],
            {"vmin": F.bround((n - 1) * p), "vmax": F.bround((n - 1) * ((100 - params.percentile_value) / 100))},
        )
    else:
        limits = chosen.groupBy("measu").agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    if mode in (4, 6):
        limits = limits.withColumn("vmin", F.lit(params.scale_min))
    return limits.select("measu", "vmin", "vmax")


def normalised(v: Column, low: Column, high: Column, individual_scale: int = 0) -> Column:
    """Value to 0..1. Tens digit: 0 linear; 1 bilinear around 0; 2 symmetric around 0.
    The last two are linear when 0 is not strictly between the limits."""

    def linear(a: Column, b: Column) -> Column:
        return F.try_divide(F.least(F.greatest(v, a), b) - a, b - a)

    tens = individual_scale // 10
    plain = linear(low, high)
    across = (low < 0) & (high > 0)
    if tens == 0:
        return plain
    if tens == 1:
        clipped = F.least(F.greatest(v, low), high)
        two_sided = F.when(clipped >= 0, 0.5 + 0.5 * F.try_divide(clipped, high)).otherwise(
            0.5 * F.try_divide(clipped - low, -low)
        )
        return F.when(across, two_sided).otherwise(plain)
    if tens == 2:
        side = F.greatest(F.abs(low), F.abs(high))
        return F.when(across, linear(-side, side)).otherwise(plain)
    raise NotImplementedError(f"no centring mode {tens}")


def scaled_pixels(pixels: DataFrame, limits: DataFrame, individual_scale: int, value: str = "v") -> DataFrame:
    """O5 limits applied by O6."""
    joined = join_per_key(pixels, limits, ["measu"])
    return joined.withColumn(value, normalised(F.col(value), F.col("vmin"), F.col("vmax"), individual_scale)).drop("vmin", "vmax")


def threshold_value(text: str, low: Column, high: Column) -> Column:
    """``aX`` is X itself, ``rX`` is X per cent of the range (X clipped to 0..100)."""
    if re.fullmatch(r"[ra][-.0-9]+", text) is None:
        raise ValueError(f"not a threshold: {text!r}")
    number = float(text[1:])
    if text[0] == "a":
        return F.lit(number)
    return low + 0.01 * min(max(number, 0.0), 100.0) * (high - low)


def threshold_mask(pixels: DataFrame, positive: str, negative: str, value: str = "v") -> DataFrame:
    """True above the positive or below the negative threshold of the recording."""
    limits = pixels.groupBy("measu").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = join_per_key(pixels, limits, ["measu"])
    low, high = F.col("__lo"), F.col("__hi")
    shown = (F.col(value) > threshold_value(positive, low, high)) | (F.col(value) < threshold_value(negative, low, high))
    return joined.withColumn("shown", shown).drop("__lo", "__hi")


def masked_movie(
    signal: DataFrame, params: Params, raw: DataFrame, foto: DataFrame, area: DataFrame | None = None
) -> DataFrame:
    """Add ``shown`` to ``signal(measu, x, y, t, v)`` (or a frame without ``t``).

    Source: none, foto1 (one frame for all times), raw1 or sig1 (per frame) or the
    overview itself; pixels outside the area are never shown.
    """
    keys = [c for c in ("measu", "x", "y", "t") if c in signal.columns]
    source = params.threshold_on.lower()
    pos, neg = params.threshold_positive, params.threshold_negative
    if source == "none":
        out = signal.withColumn("shown", F.lit(True))
    elif source == "foto1":
        mask = threshold_mask(foto, pos, neg).select(*PIXEL, "shown")
        out = signal.join(mask, PIXEL)
    elif source == "raw1":
        mask = threshold_mask(raw, pos, neg).select(*keys, "shown")
        out = signal.join(mask, keys)
    elif source in ("sig1", "overview"):
        out = threshold_mask(signal, pos, neg)
    else:
        raise NotImplementedError(f"no threshold source {params.threshold_on!r}")
    if area is not None:
        members = area.select(*PIXEL).distinct().withColumn("__in", F.lit(True))
        out = out.join(members, PIXEL, "left").withColumn("shown", F.col("shown") & F.col("__in").isNotNull()).drop("__in")
    return out


def background_scaled(pixels: DataFrame, scale: str = "full", value: str = "v") -> DataFrame:
    """Background to 0..1 by the limits of all pixels (``full``) or of those outside
    the mask (``onlyShown``); a constant background is clipped to 0..1."""
    counted = F.col(value) if scale == "full" else F.when(~F.col("shown"), F.col(value))
    limits = pixels.groupBy("measu").agg(F.min(counted).alias("__lo"), F.max(counted).alias("__hi"))
    joined = join_per_key(pixels, limits, ["measu"])
    low, high = F.col("__lo"), F.col("__hi")
    constant = F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn(
        "background", F.when(low == high, constant).otherwise(normalised(F.col(value), low, high))
    ).drop("__lo", "__hi")


def composed(shown: Column, inside: Column, outside: Column) -> Column:
    """One of two values by the mask."""
    return F.when(shown, inside).otherwise(outside)


# Anchor colours (red, green, blue) of the lookup tables, evenly spaced.
COLOUR_ANCHORS = {
    "gray": [(0, 0, 0), (255, 255, 255)],
    "heat": [(0, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)],
    "two_sided": [(0, 0, 255), (255, 255, 255), (255, 0, 0)],
}


def spectrum() -> list[tuple[int, int, int]]:
    """The standard table: hue from 255/360 to 0 in 256 steps, full saturation and value."""
    return [tuple(int(255 * c + 0.5) for c in colorsys.hsv_to_rgb(255 / 360 * (1 - i / 255), 1.0, 1.0)) for i in range(256)]


def colour(v: Column, table: str = "standard") -> Column:
    """Colour of a 0..1 value from a 256-step table: the standard one, or between anchor colours."""
    if table == "standard":
        levels = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("rgb", c)]) for c in spectrum()])
        return F.get(levels, F.least(F.greatest(F.floor(v * 255), F.lit(0)), F.lit(255)).cast("int"))
    anchors = COLOUR_ANCHORS[table]
    step = F.least(F.greatest(F.floor(v * 255), F.lit(0)), F.lit(255)) / 255.0 * (len(anchors) - 1)
    left = F.least(F.floor(step), F.lit(len(anchors) - 2)).cast("int")
    part = step - left
    parts = {}
    for i, name in enumerate("rgb"):
        levels = F.array(*[F.lit(float(a[i])) for a in anchors])
        low, high = F.get(levels, left), F.get(levels, left + 1)
        parts[name] = F.floor(low + (high - low) * part + 0.5).cast("int")
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def stacked(frames: DataFrame, depth: int) -> DataFrame:
    """The same frame at every time."""
    return frames.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))


# Rotation code -> (swap axes, mirror second axis, mirror first axis).
ROTATIONS = {
    0: (False, False, False),
    1: (True, True, False),
    2: (False, True, True),
    3: (True, False, True),
    4: (True, False, False),
    5: (False, False, True),
    6: (True, True, True),
    7: (False, True, False),
}


def rotated(pixels: DataFrame, code: int, nx: int | Column, ny: int | Column, reverse: bool = False) -> DataFrame:
    """Rotate or mirror by a code 0..7; ``reverse`` toggles the first-axis mirror."""
    swap, second, first = ROTATIONS[code]
    first = first != reverse
    x, y = (F.col("y"), F.col("x")) if swap else (F.col("x"), F.col("y"))
    wide, high = (ny, nx) if swap else (nx, ny)
    return pixels.withColumns({"x": wide - 1 - x if first else x, "y": high - 1 - y if second else y})


def output_pixels(pixels: DataFrame, ny: int | Column, value: str = "v") -> DataFrame:
    """Image rows and columns with 8-bit values, first row on top."""
    return pixels.withColumns(
        {"row": ny - 1 - F.col("y"), "column": F.col("x"), value: (F.col(value) * 255).cast("int")}
    ).drop("x", "y")


def roi_colours(rois: DataFrame) -> DataFrame:
    """A number per region label in sorted order, numbered range by range."""
    return numbered(rois.select("roi").distinct(), "roi", "colour").withColumn("colour", F.col("colour").cast("int"))


def marked_rois(pixels: DataFrame, outlines: DataFrame, value: str = "v") -> DataFrame:
    """Values of outline pixels become the colour of the last region drawn there.

    ``outlines(x, y, roi_order, colour[, measu])``.
    """
    keys = [c for c in PIXEL if c in outlines.columns]
    top = outlines.groupBy(*keys).agg(F.max_by("colour", "roi_order").alias("__c"))
    return pixels.join(top, keys, "left").withColumn("marked", F.col("__c").isNotNull()).withColumn(
        value, F.coalesce(F.col("__c").cast("double"), F.col(value))
    ).drop("__c")


def frames_per_second(period_ms: Column, speed: float = 1.0) -> Column:
    """O17."""
    return F.try_divide(speed * F.lit(1000.0), period_ms)


def value_at(pixels: DataFrame, x: int, y: int, factor: float = 1.0, value: str = "v") -> DataFrame:
    """The value under a point, times the legend factor."""
    point = pixels.filter((F.col("x") == x) & (F.col("y") == y))
    return point.withColumn(value, F.col(value) * factor)


def tapestry_plan(rows: DataFrame, measurements: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Patches of a tapestry. Unset cells come from the row above; recordings are
    placed in their order; an unknown recording leaves an empty patch.

    ``rows(row_idx, row_name, animal, measus, flags)``.
    """
    inherited = [c for c in ("animal", "measus", "flags", "formats") if c in rows.columns]
    full = carried_forward(rows, "row_idx", inherited, groups)
    keep = [c for c in full.columns if c != "measus"]
    patches = A.unrolled(full, *keep, trace="measus", names=("position", "measu"))
    known = measurements.select("animal", "measu", F.lit(True).alias("__known")).distinct()
    joined = patches.join(known, ["animal", "measu"], "left")
    return joined.withColumn("empty", F.col("__known").isNull()).drop("__known")


def chosen_by_column(wanted: DataFrame, measurements: DataFrame, column: str) -> DataFrame:
    """Recordings by the value of another column. ``wanted(animal, position, value)``."""
    side = measurements.select("animal", F.col(column).cast("string").alias("value"), "measu")
    return wanted.join(side, ["animal", "value"], "left")


def common_limits(limits: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Limits shared by all patches, 3 decimals."""
    return limits.groupBy(*groups).agg(
        F.bround(F.min("vmin"), 3).alias("vmin"), F.bround(F.max("vmax"), 3).alias("vmax")
    )


def three_digits(v: Column) -> Column:
    """Text with three significant digits, trailing zeros dropped, in Arrow batches.

    As ``%.3g`` of C, which rounds the exact value of the double, half to even; Java's formatter rounds its shortest decimal up.
    """

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([f"{x:.3g}" for x in values], dtype=object)

    return F.when(v.isNotNull(), run(v.cast("double")))


def limit_text(low: Column, high: Column) -> Column:
    """Limits under a patch."""
    return F.concat(three_digits(low), F.lit(" to "), three_digits(high))


def user_text(fn: Callable[[dict], str], columns: Sequence[str]) -> Column:
    """A user's text function of a list row, in Arrow batches."""

    @F.pandas_udf("string")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([fn(row) for row in rows.to_dict("records")], dtype=object)

    return run(F.struct(*columns))


def plot_bounds(points: DataFrame, hue: str, value: str = "v") -> DataFrame:
    """Lower and upper plot bound per line group, 10 % beyond the data."""
    clean = F.nanvl(value, F.lit(None).cast("double"))
    limits = points.groupBy(hue).agg(F.min(clean).alias("lo"), F.max(clean).alias("hi"))
    margin = 0.1 * (F.col("hi") - F.col("lo"))
    return limits.select(hue, (F.col("lo") - margin).alias("lower"), (F.col("hi") + margin).alias("upper"))


def decode_scale(code: int) -> dict:
    """Older scale codes as parameters. 1xx: centre rectangle with a margin of xx %;
    1yxx: percentile fraction xx / 100 with mode y; the tens digit of the mode centres."""
    if 100 <= code < 200:
        return {"individual_scale": 3, "scale_margin": (code % 100) / 100, "percentile_scale": False}
    if 1000 <= code < 2000:
        mode, percent = divmod(code % 1000, 100)
        return {"individual_scale": mode, "percentile_scale": True, "percentile_value": float(percent)}
    return {"individual_scale": code % 100, "percentile_scale": False}
