"""Stimulus operators: parsing pulses out of list cells and asking when they are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.plans.skew import join_per_key

# List columns of the first and second pulse, their types and defaults.
PULSE_COLUMNS = {
    "stim_on": ("int", "stim2on", "-1", "0"),
    "stim_off": ("int", "stim2off", "-1", "0"),
    "stim_on_ms": ("double", "stim2on_ms", "-1", "-1"),
    "stim_len": ("int", "stim2len", "0", "0"),
    "odour": ("string", "odour", "not set yet", "not set yet"),
    "oconc": ("double", "oconc", "not set yet", "not set yet"),
}

#: Width of the narrowest cells of the interval index.
FINEST_MS = 1.0


def _given(name: str, default: str) -> Column:
    """The cell's text, or null when it is missing or equals its default."""
    cell = F.trim(F.col(name).cast("string"))
    number = F.expr(f"try_cast(trim(cast({name} AS STRING)) AS DOUBLE)")
    is_default = cell == default
    if default.lstrip("-").isdigit():
        is_default = is_default | F.coalesce(number == float(default), F.lit(False))
    return F.when(cell.isNotNull() & ~is_default, cell)


def _typed(text: Column, dtype: str) -> Column:
    """Parse one entry; empty text is null, other unreadable text is an error."""
    text = F.when(F.trim(text) != "", F.trim(text))
    return text if dtype == "string" else text.cast(dtype)


def _pulse_rows(measurements: DataFrame, second: bool) -> DataFrame:
    """Parse the list cells of a recording into an array of pulses and unroll it once."""
    cells = F.array(*[F.split(_given(c, spec[2]), ",") for c, spec in PULSE_COLUMNS.items()])
    lists = measurements.withColumn("__cells", cells)
    widths = F.transform(F.filter("__cells", lambda c: c.isNotNull()), lambda c: F.size(c))
    lists = lists.withColumn("__widths", widths)
    longer = F.array_distinct(F.filter("__widths", lambda w: w > 1))
    n = F.when(F.size(longer) <= 1, F.array_max("__widths")).otherwise(
        F.raise_error(F.lit("stimulus cells hold lists of different lengths")).cast("int")
    )
    lists = lists.withColumn("n_stim", n)

    def entry(i: Column) -> Column:
        parts = []
        for k, (c, spec) in enumerate(PULSE_COLUMNS.items()):
            cell = F.get("__cells", F.lit(k))
            text = F.get(cell, F.when(F.size(cell) > 1, i).otherwise(0))
            parts.append(_typed(text, spec[0]).alias(f"p_{c}"))
        return F.struct(i.cast("int").alias("stim_idx"), *parts)

    pulses = F.when(F.col("n_stim").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("n_stim") - 1), entry))
    if second:
        given = {c: _typed(_given(spec[1], spec[3]), spec[0]) for c, spec in PULSE_COLUMNS.items()}
        timed = F.coalesce(*[v.cast("double") for c, v in given.items() if c.startswith("stim")])
        other = F.struct(F.lit(1).alias("stim_idx"), *[v.alias(f"p_{c}") for c, v in given.items()])
        alone = (F.col("n_stim") == 1) & timed.isNotNull()
        pulses = F.when(alone, F.concat(pulses, F.array(other))).otherwise(pulses)
    rows = lists.select(*measurements.columns, "n_stim", F.explode_outer(pulses).alias("__p"))
    return rows.filter(F.col("__p").isNotNull()).select(*measurements.columns, "n_stim", "__p.*")


def exploded_cells(measurements: DataFrame) -> DataFrame:
    """One row per stimulus from comma lists; single values go to every stimulus.

    Lists of different lengths (other than one) are an error, recordings without any
    stimulus cell give no row.
    """
    return _pulse_rows(measurements, second=False)


def with_second_pulse(measurements: DataFrame) -> DataFrame:
    """T1 + T2: pulses of the lists, plus the second-pulse columns of single-pulse rows."""
    return _pulse_rows(measurements, second=True)


def resolved(pulses: DataFrame) -> DataFrame:
    """on/off times in ms; incomplete pulses are dropped, contradictions are errors.

    Input: p_* columns and ``cycle`` (ms per frame). An off-frame beats a length.
    """
    period = F.col("cycle")
    on_frame, on_ms = F.col("p_stim_on"), F.col("p_stim_on_ms")
    from_frame = on_frame * period
    same = F.round(from_frame * 1000).cast("long") == F.round(on_ms * 1000).cast("long")
    wrong = F.raise_error(F.lit("stimulus frame and time contradict each other or are negative")).cast("double")
    negative = (on_frame < 0) | (on_ms < 0)
    start = (
        F.when(F.coalesce(negative, F.lit(False)), wrong)
        .when(on_frame.isNotNull() & on_ms.isNotNull(), F.when(same, from_frame).otherwise(wrong))
        .otherwise(F.coalesce(from_frame, on_ms))
    )
    end = F.coalesce((F.col("p_stim_off") + 1) * period, F.col("on_ms") + F.col("p_stim_len"))
    timed = (
        pulses.withColumn("on_ms", start)
        .withColumn("off_ms", end)
        .filter(F.col("on_ms").isNotNull() & F.col("off_ms").isNotNull())
    )
    return timed.select(
        "measu",
        F.col("stim_idx").cast("int").alias("stim_idx"),
        F.col("p_odour").alias("odor"),
        F.col("p_oconc").alias("conc"),
        "on_ms",
        "off_ms",
        period.alias("period_ms"),
    )


def parse_stimuli(measurements: DataFrame) -> DataFrame:
    """Measurement list to pulses: T1, T2 and T3 in one lazy plan, no shuffle."""
    return resolved(with_second_pulse(measurements))


def shifted(stimuli: DataFrame, offset_ms: float) -> DataFrame:
    """T4: move every pulse."""
    return stimuli.withColumns(
        {"on_ms": F.col("on_ms") + offset_ms, "off_ms": F.col("off_ms") + offset_ms}
    )


def counted(stimuli: DataFrame) -> DataFrame:
    """T5: pulses and different odours per recording."""
    per_odor = stimuli.groupBy("measu", "odor").agg(F.count(F.lit(1)).alias("n"))
    return per_odor.groupBy("measu").agg(
        F.sum("n").alias("n_stimuli"), F.count("odor").alias("n_odors")
    )


def interval_cells(on: Column, off: Column, finest_ms: float = FINEST_MS) -> Column:
    """The cells (level, cell) a pulse is laid on: at most two or three, on the level whose cells are as wide as the pulse.

    Cells of level k are ``finest_ms`` * 2^k wide, so short pulses of a burst lie in narrow cells and a long
    one among them does not multiply.
    """
    length = F.greatest(off - on, F.lit(0.0))
    level = F.greatest(F.ceil(F.log2(length / finest_ms)), F.lit(0)).cast("int")
    level = F.when(length <= finest_ms, F.lit(0)).otherwise(level)
    first = _cell(on, level, finest_ms)
    cells = F.sequence(first, F.greatest(first, _cell(off, level, finest_ms)))
    return F.transform(cells, lambda c: F.struct(level.alias("level"), c.alias("cell")))


def _cell(ms: Column, level: Column, finest_ms: float) -> Column:
    return F.floor(ms / (F.lit(float(finest_ms)) * F.pow(F.lit(2.0), level)))


def active_pairs(stimuli: DataFrame, times: DataFrame, finest_ms: float = FINEST_MS) -> DataFrame:
    """Interval join behind T6, T13 and T14: times inside pulses, both ends included.

    Pulses lie on cells whose width doubles from level to level (:func:`interval_cells`); a time looks into one cell of every
    level that any pulse uses. Both meet by (recording, level, cell) equality, so a recording with very many
    rows is cut along its time axis. ``times(measu, t_ms, ...)``.
    """
    laid = stimuli.withColumn("__c", F.explode(interval_cells(F.col("on_ms"), F.col("off_ms"), finest_ms)))
    used = stimuli.select(F.get(interval_cells(F.col("on_ms"), F.col("off_ms"), finest_ms), F.lit(0))["level"].alias("l"))
    levels = used.agg(F.array_sort(F.collect_set("l"))).scalar()  # a few dozen numbers at most
    asked = times.withColumn("__level", F.explode(levels)).withColumn("__cell", _cell(F.col("t_ms"), F.col("__level"), finest_ms))
    laid = laid.withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    pairs = asked.join(laid, ["measu", "__level", "__cell"])
    return pairs.filter((F.col("on_ms") <= F.col("t_ms")) & (F.col("off_ms") >= F.col("t_ms"))).drop("__level", "__cell")


def active_stimuli(stimuli: DataFrame, times: DataFrame, key: str, finest_ms: float = FINEST_MS) -> DataFrame:
    """For every time, the odours and concentrations active then, in pulse order.

    ``key`` identifies a time row; a time without stimulus keeps empty lists.
    """
    pairs = active_pairs(stimuli, times.select(key, "measu", "t_ms"), finest_ms)
    lists = pairs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("stim_idx", "odor", "conc"))).alias("hits")
    )
    joined = times.join(lists, key, "left")
    hits = F.coalesce(F.col("hits"), F.array().cast("array<struct<stim_idx:int,odor:string,conc:double>>"))
    return joined.select(*times.columns, hits["odor"].alias("odors"), hits["conc"].alias("concs"))


def frame_labels(
    stimuli: DataFrame, times: DataFrame, key: str, with_conc: bool = True, finest_ms: float = FINEST_MS
) -> DataFrame:
    """Text of the first active stimulus per time, null when none is active."""
    pairs = active_pairs(stimuli, times.select(key, "measu", "t_ms"), finest_ms)
    first = pairs.groupBy(key).agg(F.min(F.struct("stim_idx", "odor", "conc")).alias("s"))
    text = F.concat(F.col("s.odor"), F.lit("@"), F.col("s.conc").cast("string")) if with_conc else F.col("s.odor")
    return times.join(first.select(key, text.alias("stimulus_text")), key, "left")


def durations(stimuli: DataFrame) -> DataFrame:
    """T7."""
    return stimuli.withColumn("duration_ms", F.col("off_ms") - F.col("on_ms"))


def pulse_frames(stimuli: DataFrame, allow_fractional: bool = False) -> DataFrame:
    """First and last frame of each pulse; fractions become null unless allowed."""

    def frame(ms: str) -> Column:
        exact = F.col(ms) / F.col("period_ms")
        return exact if allow_fractional else F.when(exact == F.floor(exact), exact)

    return stimuli.withColumns({"start_frame": frame("on_ms"), "end_frame": frame("off_ms")})


def first_onsets(stimuli: DataFrame) -> DataFrame:
    """Onset frame of the first listed (not earliest) stimulus, truncated."""
    frame = F.col("on_ms") / F.col("period_ms")
    return stimuli.groupBy("measu").agg(F.min_by(frame, "stim_idx").cast("int").alias("onset_frame"))


def onsets(stimuli: DataFrame, number: int = 0) -> DataFrame:
    """On-time of the ``number``-th listed stimulus of every recording that has one."""
    if number == 0:
        return stimuli.groupBy("measu").agg(F.min_by("on_ms", "stim_idx").alias("on_ms"))
    from lumentrace.plans.ranking import rank_picks

    picked = rank_picks(stimuli, "stim_idx", ["measu"], {"stim": F.lit(number)})
    picked = picked.filter(F.col("stim").isNotNull()).withColumnRenamed("stim", "stim_idx")
    return stimuli.join(picked, ["measu", "stim_idx"], "left_semi").select("measu", "on_ms")


def background_ranges(recordings: DataFrame, stimuli: DataFrame, params: Params) -> DataFrame:
    """Background frames per recording. ``recordings`` has one row per ``measu``."""
    low, high = params.default_background
    if not params.stimulus_based_background:
        return recordings.select("measu", F.lit(low).alias("bg_start"), F.lit(high).alias("bg_end"), F.lit(-1).alias("onset_frame"))
    end = F.col("onset_frame") - params.prestim_end_background
    usable = F.coalesce(end > params.start_background, F.lit(False))
    return recordings.select("measu").join(first_onsets(stimuli), "measu", "left").select(
        "measu",
        F.when(usable, params.start_background).otherwise(low).alias("bg_start"),
        F.when(usable, end).otherwise(high).alias("bg_end"),
        F.when(usable, F.col("onset_frame")).otherwise(-1).alias("onset_frame"),
    )


def parsed_lists(rows: DataFrame, odors: str, times: str, lengths: str) -> DataFrame:
    """Three list literals as arrays, all ordered by time."""

    def numbers(c: str) -> Column:
        return F.transform(F.split(F.regexp_replace(c, r"[\[\]\s']", ""), ","), lambda v: v.cast("double"))

    names = F.split(F.regexp_replace(odors, r"[\[\]']", ""), r",\s*")
    zipped = F.arrays_zip(numbers(times).alias("time"), names.alias("odor"), numbers(lengths).alias("length"))
    ordered = F.array_sort(zipped)
    return rows.withColumn("__s", ordered).withColumns(
        {odors: F.col("__s.odor"), times: F.col("__s.time"), lengths: F.col("__s.length")}
    ).drop("__s")


def time_text(ms: Column, with_ms: bool = True) -> Column:
    """Signed ``m`` and ``s`` text of a time in milliseconds."""
    seconds = F.abs(ms) / 1000
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    sign = F.when(ms < 0, "-").otherwise("")
    minute_text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" m "))).otherwise("")
    rest_text = F.lpad(F.format_string("%.3f", F.bround(rest, 3)), 6, " ") if with_ms else F.lpad(
        F.bround(rest).cast("int").cast("string"), 2, " "
    )
    return F.concat(sign, minute_text, rest_text, F.lit(" s"))


def relative_times(frames: DataFrame, stimuli: DataFrame, with_ms: bool = True) -> DataFrame:
    """Time of each frame after the earliest onset of its recording, with its text.

    ``frames(measu, t_ms, ...)``; recordings without stimulus count from frame time 0.
    """
    earliest = stimuli.groupBy("measu").agg(F.min("on_ms").alias("__on"))
    joined = join_per_key(frames, earliest, ["measu"], "left", spread=["t_ms"])
    relative = F.col("t_ms") - F.coalesce(F.col("__on"), F.lit(0.0))
    return joined.withColumn("rel_ms", relative).withColumn("time_text", time_text(F.col("rel_ms"), with_ms)).drop("__on")


def stimulus_trains(stimuli: DataFrame, frame_counts: DataFrame, isi_frames: int) -> DataFrame:
    """Flag frames inside repeats of the first pulse (end excluded).

    ``frame_counts(measu, n_frames)``. The pulse repeats every ``isi_frames`` while its
    end stays below the last frame; a frame asks only the latest repeat before it.
    """
    first = stimuli.groupBy("measu").agg(
        F.min(F.struct("stim_idx", (F.col("on_ms") / F.col("period_ms")).cast("int").alias("on"),
                       (F.col("off_ms") / F.col("period_ms")).cast("int").alias("off"))).alias("p")
    )
    rows = frame_counts.join(first, "measu", "left")
    n = F.col("n_frames")
    width = F.col("p.off") - F.col("p.on")
    since = F.col("t") - F.col("p.on")
    if isi_frames > 0:
        last_repeat = F.greatest(F.floor((n - 2 - F.col("p.on") - width) / isi_frames), F.lit(0))
        repeat = F.least(F.floor(since / isi_frames), last_repeat)
    else:
        repeat = F.lit(0)
    active = (since >= 0) & (since - repeat * isi_frames < width)
    return rows.withColumn("t", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "measu", "t", F.coalesce(active, F.lit(False)).alias("stimulated")
    )
