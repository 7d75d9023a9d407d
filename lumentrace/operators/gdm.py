"""Region-trace tables: full traces, stimulus-locked chunks, reshaping and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.functions import features as C
from lumentrace.model import Params
from lumentrace.operators.stimuli import background_ranges, onsets
from lumentrace.plans.ranking import indexed
from lumentrace.plans.skew import join_per_key


#: Features that read the background frames of the recording.
BACKGROUND_FEATURES = ("0", "303", "333")


def feature_values(params: Params, trace: Column, ctx: C.FeatureContext) -> dict[str, Column]:
    """``ctvs``, all C_safe values of the chosen feature, and ``ctv``, the first of them."""
    values = C.safe(C.feature(params.feature)(trace, ctx))
    return {"ctvs": F.array(*values), "ctv": values[0]}


def full_traces(
    roi_traces: DataFrame,
    metadata: DataFrame,
    descriptions: DataFrame,
    params: Params,
    period_ms: float = 200.0,
) -> DataFrame:
    """H1: a row per region with metadata, trace, feature value and region text.

    ``metadata`` has one row per recording and may carry ``on_ms``, ``bg_start`` and
    ``bg_end`` for features that need them, and ``period_ms``, the sampling period of the
    recording (else the given one); ``descriptions(measu, roi, glo_info)``.
    """
    described = roi_traces.join(descriptions.select("measu", "roi", "glo_info"), ["measu", "roi"], "left")
    joined = join_per_key(described, metadata, ["measu"], spread=["roi"])
    if "period_ms" not in joined.columns:
        joined = joined.withColumn("period_ms", F.lit(float(period_ms)))
    ctx = _context(joined, params)
    return joined.withColumns(
        {
            "t_start_s": F.lit(0.0),
            "n_frames": F.size("trace"),
            **feature_values(params, F.col("trace"), ctx),
        }
    )


def _context(df: DataFrame, params: Params) -> C.FeatureContext:
    columns = {"period_ms": F.col("period_ms")}
    if "on_ms" in df.columns:
        columns["on_ms"] = F.col("on_ms")
    if "bg_start" in df.columns:
        columns["background"] = (F.col("bg_start"), F.col("bg_end"))
    return C.FeatureContext.from_params(params, **columns)


def chunks(roi_traces: DataFrame, stimuli: DataFrame, params: Params, backgrounds: DataFrame | None = None) -> DataFrame:
    """H2: per region and stimulus the trace from before the pulse to after it.

    Features that read background frames take the range of the recording from
    ``backgrounds(measu, bg_start, bg_end)``, or else the T10 range of its pulses.

    Bounds are rounded half-even to frames; the end frame is included; the on-time is
    given relative to the rounded chunk start. Arrays are cut in place, so no frame rows
    are made.
    """
    period = F.col("period_ms")
    start = F.greatest(
        F.lit(0), F.bround((F.col("on_ms") - params.chunk_pre_s * 1000) / period).cast("int")
    )
    end = F.bround((F.col("off_ms") + params.chunk_post_s * 1000) / period).cast("int")
    cut = (
        join_per_key(roi_traces, stimuli, ["measu"], spread=["roi"])
        .withColumn("start_idx", start)
        .withColumn("end_idx", F.least(F.size("trace"), end))
    )
    chunk = A.span(F.col("trace"), F.col("start_idx"), F.col("end_idx"))
    cut = cut.withColumn("chunk", chunk)
    facts = {"period_ms": period}
    if str(params.feature) in ("35", "22and35"):
        # These read the on-time of the chosen stimulus of the recording.
        chosen = onsets(stimuli, params.stimulus_number).withColumnRenamed("on_ms", "chosen_on_ms")
        cut = join_per_key(cut, chosen, ["measu"], "left", spread=["roi", "stim_idx"])
        facts["on_ms"] = F.col("chosen_on_ms")
    if str(params.feature) in BACKGROUND_FEATURES:
        if backgrounds is None:
            backgrounds = background_ranges(stimuli.select("measu").distinct(), stimuli, params)
        ranges = backgrounds.select("measu", "bg_start", "bg_end")
        cut = join_per_key(cut, ranges, ["measu"], "left", spread=["roi", "stim_idx"])
        facts["background"] = (F.col("bg_start"), F.col("bg_end"))
    ctx = C.FeatureContext.from_params(params, **facts)
    values = feature_values(params, F.col("chunk"), ctx)
    return cut.select(
        "measu", "roi", "stim_idx", F.col("odor").alias("odour"), F.col("conc").alias("oconc"),
        (F.col("off_ms") - F.col("on_ms")).alias("stim_len_ms"),
        (F.col("on_ms") - F.col("start_idx") * period).alias("stim_on_ms"),
        (F.col("start_idx") * period / 1000).alias("t_start_s"),
        "period_ms",
        F.size("chunk").alias("n_frames"),
        F.col("chunk").alias("trace"),
        *[v.alias(name) for name, v in values.items()],
    )


def region_table(
    params: Params, roi_traces: DataFrame, metadata: DataFrame, descriptions: DataFrame, stimuli: DataFrame
) -> DataFrame:
    """H3: full traces or chunks, by output type."""
    if params.output_type == "full_traces":
        return full_traces(roi_traces, metadata, descriptions, params)
    if params.output_type == "chunks_only":
        return chunks(roi_traces, stimuli, params)
    raise NotImplementedError(f"no output type {params.output_type!r}")


def appended(first: DataFrame, second: DataFrame, index: str = "idx") -> DataFrame:
    """H4: second table after the first, numbered from max + 1; all columns are kept."""
    top = F.coalesce(first.agg(F.max(index)).scalar(), F.lit(-1))
    moved = indexed(second, index, name="__i").withColumn(index, top + 1 + F.col("__i")).drop("__i")
    return first.unionByName(moved, allowMissingColumns=True)


def subset(table: DataFrame, indices: DataFrame, index: str = "idx") -> DataFrame:
    """H5: rows of an index list; an index that does not exist is an error."""
    wanted = indices.select(index).distinct()
    unknown = wanted.join(table, index, "left_anti").agg(F.count(F.lit(1))).scalar()
    guard = F.assert_true(unknown == 0, F.lit("some indices do not exist"))
    return table.join(wanted, index, "left_semi").filter(guard.isNull())


def where(table: DataFrame, condition: Column) -> DataFrame:
    """H6: rows by a condition on their metadata."""
    return table.filter(condition)


def row(table: DataFrame, i: int, index: str = "idx") -> DataFrame:
    """H7: one row by index."""
    return table.filter(F.col(index) == i)


def matrix(table: DataFrame, index: str = "idx") -> DataFrame:
    """H8: index and trace, if all traces have one length; otherwise an error."""
    same = table.agg(F.min(F.size("trace")) == F.max(F.size("trace"))).scalar()
    guard = F.assert_true(same, F.lit("traces have different lengths"))
    return table.filter(guard.isNull()).select(index, "trace")


def export_attributes(table: DataFrame) -> DataFrame:
    """H9: offset, period and frame count under their file names."""
    return table.withColumns(
        {"TraceOffset": F.col("t_start_s"), "Cycle": F.col("period_ms"), "NumFrames": F.size("trace")}
    )


def cleaned_line(table: DataFrame, column: str = "line") -> DataFrame:
    """Keep the part of ``line`` before the first underscore."""
    return table.withColumn(column, F.get(F.split(column, "_"), F.lit(0)))


def with_time_axis(table: DataFrame, *keep: str) -> DataFrame:
    """Long form with the time of every sample in seconds."""
    frames = A.unrolled(table, *keep, "t_start_s", "period_ms")
    return frames.select(*keep, "t", (F.col("t_start_s") + F.col("t") * F.col("period_ms") / 1000).alias("time_s"), "v")


def wide_to_long(wide: DataFrame, value: str = "value") -> DataFrame:
    """Frames to rows, without empty ones: the array ``frames`` of a wide table, or the
    columns FrameN of one that has them; the number is the position or in the name."""
    if "frames" in wide.columns:
        ids = [c for c in wide.columns if c != "frames"]
        return A.unrolled(wide, *ids, trace="frames", names=("frame", value)).filter(F.col(value).isNotNull())
    frames = [c for c in wide.columns if c.lower().startswith("frame") and c[5:].isdigit()]
    ids = [c for c in wide.columns if c not in frames]
    long = wide.unpivot(ids, frames, "__name", value)
    return long.select(*ids, F.substring("__name", 6, 10).cast("int").alias("frame"), value).filter(F.col(value).isNotNull())


def compared(tables: dict[str, DataFrame], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Values of several sources side by side, one row per key."""
    tagged = None
    for source, table in tables.items():
        part = table.select(*keys, value).withColumn("source", F.lit(source))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*keys).pivot("source", list(tables)).agg(F.first(value))


def export_by_animal(table: DataFrame, path: str) -> None:
    """All accepted recordings in one job, a folder per animal."""
    table.write.mode("overwrite").partitionBy("animal").parquet(path)


def padded(table: DataFrame, trace: str = "trace") -> Column:
    """A trace with nulls up to the length of the longest one in the table."""
    longest = table.agg(F.coalesce(F.max(F.size(trace)), F.lit(0))).scalar()
    rest = F.greatest(longest - F.size(trace), F.lit(0))
    return F.concat(F.col(trace), F.array_repeat(F.lit(None).cast("double"), rest))


def legacy_table(table: DataFrame) -> DataFrame:
    """The fixed numeric and text columns of the older export, and ``frames`` of one length.

    The frames stay one array, so the plan does not grow with the movie; text output writes
    them as one column each.
    """
    return table.select(
        F.col("measu").alias("NMeasu"),
        F.col("roi").alias("NGloTag"),
        F.col("period_ms").alias("NGDMfreq"),
        F.col("n_frames").alias("NFrames"),
        F.col("ctv").alias("NCTV"),
        F.col("animal").alias("TAnimal"),
        F.col("label").alias("TLabel"),
        padded(table).alias("frames"),
    )
