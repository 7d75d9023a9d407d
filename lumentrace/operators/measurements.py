"""Measurement lists: defaults, checks, selection, merging, pairing, naming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.functions import text as X
from lumentrace.model import defaults, meta_def, meta_rows
from lumentrace.plans.ranking import indexed, rank_picks
from lumentrace.plans.skew import facts_in_use, join_per_key

# Columns of each vocabulary in the metadata definition.
VOCABULARIES = {"list": 0, "settings": 3, "recording": 4}


def with_defaults(df: DataFrame) -> DataFrame:
    """M1: add every known column that is absent, filled with its default."""
    present = {c.lower() for c in df.columns}
    absent = {c: F.lit(v) for c, v in defaults().items() if c.lower() not in present}
    return df.withColumns(absent) if absent else df


def with_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M2: numeric reading of text cells beside the text."""
    return df.withColumns({f"{c}_num": X.number(c) for c in columns})


def required_columns(df: DataFrame, setup: int | str) -> DataFrame:
    """Columns a setup requires, as a small DataFrame."""
    return meta_def(df.sparkSession).filter(F.col("requirement").isin("all", str(setup))).select("lst_name")


def missing_required(df: DataFrame, setup: int | str) -> DataFrame:
    """M3: required columns that no recording fills (absent ones included)."""
    cells = F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in df.columns])
    used = df.select(F.explode(F.array_compact(cells)).alias("lst_name")).groupBy("lst_name").agg(F.count(F.lit(1)).alias("n"))
    return required_columns(df, setup).join(used, "lst_name", "left_anti")


def _the_only(hits: DataFrame, what: str) -> DataFrame:
    """One row, or an error when there is none or more than one."""
    row = hits.agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct("*")).alias("__row"))
    text = F.concat(F.lit(f"{what}: expected one recording, found "), F.col("__n").cast("string"))
    guarded = F.when(F.col("__n") == 1, F.col("__row")).otherwise(F.raise_error(text).cast(row.schema["__row"].dataType))
    return row.select(guarded.alias("__row")).select("__row.*")


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """M4: the row with a value in a column; none or several are an error."""
    return _the_only(df.filter(F.col(column) == value), f"{column}={value}")


def row_at(df: DataFrame, position: int, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """M5: the row at a position (0-based) of every group by a unique order column.

    Groups that are too short give no row. Only order values are ranked.
    """
    groups = list(groups)
    base = df if groups else df.withColumn("__all", F.lit(0))
    keys = groups or ["__all"]
    picked = rank_picks(base, order, keys, {"__v": F.lit(position)}).filter(F.col("__v").isNotNull())
    return base.join(picked.withColumnRenamed("__v", order), [*keys, order], "left_semi").select(*df.columns)


def columns_of_type(df: DataFrame, group: str) -> DataFrame:
    """M6: the columns of one type group."""
    wanted = [row[0] for row in meta_rows() if row[1] == group]
    return df.select(*[c for c in df.columns if c in wanted])


def analysed(df: DataFrame, accepted: Sequence[int] | None) -> DataFrame:
    """M7: recordings whose Analyze is accepted; None accepts all."""
    return df if accepted is None else df.filter(F.col("analyze").isin(list(accepted)))


def selected_legacy(df: DataFrame, divisor: int | None = None, measu: int | None = None) -> DataFrame:
    """M8: Analyze divisible by a value, or one recording."""
    if measu is not None:
        return df.filter(F.col("measu") == measu)
    return df.filter(F.col("analyze") % divisor == 0)


def updated(df: DataFrame, changes: DataFrame) -> DataFrame:
    """M9: overwrite cells from ``changes(measu, ...)``; null means unchanged and columns
    the list does not know are an error."""
    columns = [c for c in changes.columns if c != "measu"]
    unknown = set(columns) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    renamed = changes.select("measu", *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = df.join(renamed, "measu", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in columns}).select(*df.columns)


def value_of(df: DataFrame, measu: int, column: str) -> DataFrame:
    """One cell."""
    return lookup(df.select("measu", column), "measu", measu).select(column)


def mapped_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """A user's row function (dict in, dict out), run batch by batch. It may add
    columns; ``schema`` names all that it returns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([fn(row) for row in batch.to_dict("records")])

    return df.mapInPandas(run, schema)


def analyze_state(passed: Column, current: Column) -> Column:
    """A failure is 0; a pass turns missing or negative into 1 and keeps the rest."""
    return F.when(~passed, 0).when(current.isNull() | (current < 0), 1).otherwise(current)


#: List names of the file columns in recording vocabulary, for their defaults.
DEFAULT_OF = {"dbb1": "DBB1"}


def checked_files(df: DataFrame, listing: DataFrame, columns: Sequence[str], absolute: bool = False) -> DataFrame:
    """All data files of a recording must be listed. ``listing(stem, path)``.

    A null or default cell names no file. Such cells get join keys of their own, so that the
    default, which most rows of one wavelength hold, does not meet in one task.
    """
    found = F.lit(True)
    base = defaults()
    files = listing.groupBy("stem").agg(F.min("path").alias("path"))
    joined = df
    for c in columns:
        side = files.select(F.col("stem").alias(f"__key_{c}"), F.col("path").alias(f"__path_{c}"))
        unset = F.col(c).isNull() | F.col(c).eqNullSafe(F.lit(base.get(DEFAULT_OF.get(c, c))))
        own = F.concat(F.lit("\u0000"), F.xxhash64(*[k for k in df.columns if not dict(df.dtypes)[k].startswith("map")]).cast("string"))
        joined = joined.withColumn(f"__key_{c}", F.when(unset, own).otherwise(F.col(c))).join(side, f"__key_{c}", "left")
        found = found & F.col(f"__path_{c}").isNotNull()
    joined = joined.withColumn("analyze", analyze_state(found, F.col("analyze")))
    if absolute:
        joined = joined.withColumns({c: F.coalesce(F.col(f"__path_{c}"), F.col(c)) for c in columns})
    return joined.select(*df.columns)


def checked_loading(df: DataFrame, traces: DataFrame, frames: Column | int) -> DataFrame:
    """Recordings without pixels or with traces of another length are not analysed."""
    seen = traces.groupBy("measu").agg(F.min(F.size("trace")).alias("__a"), F.max(F.size("trace")).alias("__b"))
    frames = frames if isinstance(frames, Column) else F.lit(frames)
    joined = df.join(seen, "measu", "left")
    good = F.coalesce((F.col("__a") == frames) & (F.col("__b") == frames), F.lit(False))
    return joined.withColumn("analyze", analyze_state(good, F.col("analyze"))).select(*df.columns)


def appended(first: DataFrame, second: DataFrame, suffix: str | None = None, order: str = "measu") -> DataFrame:
    """Second list after the first, renumbered from max + 1, labels with a suffix."""
    top = F.coalesce(first.agg(F.max("measu")).scalar(), F.lit(-1))
    renumbered = indexed(second, order, name="__i").withColumn("measu", top + 1 + F.col("__i")).drop("__i")
    if suffix is not None:
        renumbered = renumbered.withColumn("label", F.concat("label", F.lit(suffix)))
    return first.unionByName(renumbered, allowMissingColumns=True)


def merged_old_values(new: DataFrame, old: DataFrame, columns: Sequence[str], key: str = "measu") -> DataFrame:
    """Chosen columns that the old list has take its values, nulls included, unless
    all matched old values of the column are null. Old-only chosen columns are added."""
    chosen = [c for c in dict.fromkeys(columns) if c in old.columns and c != key]
    side = old.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__old_{c}") for c in chosen])
    joined = new.join(side, key, "left")
    merged = {c: F.col(f"__old_{c}") for c in chosen}
    shared = [c for c in chosen if c in new.columns]
    if shared:  # one aggregate tells for all columns
        known = joined.agg(F.struct(*[(F.count(f"__old_{c}") > 0).alias(c) for c in shared])).scalar()
        for c in shared:
            merged[c] = F.when(known[c], merged[c]).otherwise(F.col(c))
    return joined.withColumns(merged).select(*new.columns, *[c for c in chosen if c not in new.columns])


def renamed(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rename columns between vocabularies; known ones first in definition order."""
    a, b = VOCABULARIES[source], VOCABULARIES[target]
    known = [(row[a], row[b] or row[a]) for row in meta_rows() if row[a] in df.columns]
    rest = [c for c in df.columns if c not in {k for k, _ in known}]
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in known], *rest)


def split_extra(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Known columns as they are, all others in one text map."""
    others = [c for c in df.columns if c not in known]
    pairs = [x for c in others for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in df.columns if c in known], extra.alias("extra"))


def recording_facts(df: DataFrame) -> DataFrame:
    """Age range, frequency and pixel size (2.4 where the cell is not a number)."""
    low, high = X.age_range("age")
    size = X.number("pxszx")
    return df.withColumns(
        {
            "age_min": low,
            "age_max": high,
            "frequency": X.frequency("cycle"),
            "pixel_x": F.coalesce(size, F.lit(2.4)),
            "pixel_y": F.when(size.isNull(), F.lit(2.4)).otherwise(X.number("pxszy")),
        }
    )


def non_default(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A text map of the cells that differ from their default.

    Numbers are compared as numbers; ``columns`` are list names present in ``df``.
    """
    base = defaults()
    entries = []
    for c in columns:
        text = F.col(c).cast("string")
        same = text.eqNullSafe(F.lit(base[c]))
        as_number = F.expr(f"try_cast('{base[c]}' AS DOUBLE)")
        same = same | F.coalesce(X.number(f"`{c}`") == as_number, F.lit(False))
        entries.append(F.struct(F.lit(c).alias("k"), F.when(~same, text).alias("v")))
    kept = F.filter(F.array(*entries), lambda e: e["v"].isNotNull())
    return df.withColumn("metadata", F.map_from_entries(kept))


def stimulus_lists(stimuli: DataFrame) -> DataFrame:
    """On-times and durations of a recording as comma lists, in pulse order.

    A recording's list holds its own pulses only; it is text for a metadata cell.
    """
    pulses = F.array_sort(F.collect_list(F.struct("stim_idx", "on_ms", (F.col("off_ms") - F.col("on_ms")).alias("len"))))
    joined = stimuli.groupBy("measu").agg(pulses.alias("p"))
    return joined.select(
        "measu",
        F.array_join(F.transform("p", lambda s: s["on_ms"].cast("string")), ", ").alias("stim_on_ms"),
        F.array_join(F.transform("p", lambda s: s["len"].cast("string")), ", ").alias("stim_len"),
    )


def timed(df: DataFrame, timing: str = "timing_ms") -> DataFrame:
    """Sampling period from the timing text; a failure is -1 and not analysed."""
    dt = X.timing_period(timing)
    return df.withColumns({"cycle": F.coalesce(dt, F.lit(-1.0)), "analyze": dt.isNotNull().cast("int")})


def with_mtime(df: DataFrame) -> DataFrame:
    """Time since the first recording of the animal."""
    first = df.groupBy("animal").agg(F.min("utc").alias("__first"))
    joined = join_per_key(df, first, ["animal"], spread=["measu"])
    return joined.withColumn("mtime", X.clock_text(F.col("utc") - F.col("__first"))).drop("__first")


def paired_wavelengths(df: DataFrame, group: str = "animal", order: str = "measu") -> DataFrame:
    """The i-th 340 nm and 380 nm recordings belong together: the first gets the
    second's file as ``dbb2``, the second is not analysed. Unpaired rows are dropped."""
    wanted = df.filter(F.col("lambda_nm").isin(340, 380))
    numbered = indexed(wanted, order, groups=[group, "lambda_nm"], name="__i")
    row = F.struct(*df.columns)
    pairs = numbered.groupBy(group, "__i").agg(
        F.max(F.when(F.col("lambda_nm") == 340, row)).alias("a"), F.max(F.when(F.col("lambda_nm") == 380, row)).alias("b")
    )
    pairs = pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    first = F.col("a").withField("dbb2", F.col("b.dbb1"))
    second = F.col("b").withField("dbb2", F.lit(None).cast("string")).withField("analyze", F.lit(0))
    return pairs.select(F.explode_outer(F.array(first, second)).alias("row")).select("row.*")


def from_vendor(df: DataFrame, vendor: str) -> DataFrame:
    """Already parsed vendor metadata as list columns, with unit conversions.

    vws: index from 0, a file name whose last letter was lost; lsm: seconds and metres,
    Excel time; lif: FILETIME in hexadecimal, one pixel size; ome: plain names.
    """
    if vendor == "vws":
        columns = {
            "Measu": F.col("index") + 1, "Label": F.col("Label"), "Cycle": F.col("dt"),
            "DBB1": F.regexp_replace("Location", r"\.ps$", ".pst"), "Lambda": F.col("MonochromatorWL_nm"), "UTC": F.col("UTCTime"),
        }
    elif vendor == "lsm":
        columns = {
            "Measu": F.col("measu"), "Label": F.col("Name"), "Cycle": F.col("TimeIntervall") * 1000, "Lambda": F.col("Wavelength"),
            "UTC": X.excel_seconds("Sample0time"), "PxSzX": F.col("VoxelSizeX") / 1e-6, "PxSzY": F.col("VoxelSizeY") / 1e-6,
            "DBB1": F.col("file"),
        }
    elif vendor == "lif":
        columns = {
            "Measu": F.col("measu"), "Label": F.col("Label"), "Cycle": F.col("Cycle"), "SampFreq": X.frequency("Cycle"),
            "PxSzX": F.col("PxSzX"), "PxSzY": F.col("PxSzX"), "UTC": X.filetime_seconds("TimeStamp"), "DBB1": F.col("file"),
        }
    elif vendor == "ome":
        columns = {
            "Measu": F.col("measu"), "Label": F.col("Label"), "Cycle": F.col("GDMfreq"), "Lambda": F.col("Lambda"),
            "UTC": X.iso_seconds("AcquisitionDate", F.col("first_frame_s")), "PxSzX": F.col("PsSzX"), "PxSzY": F.col("PsSzY"),
            "DBB1": F.col("dbb1"), "dbb2": F.col("dbb2"),
        }
    else:
        raise NotImplementedError(f"no vendor {vendor!r}")
    return df.select(*[v.alias(k) for k, v in columns.items()])


def usable_recordings(df: DataFrame) -> DataFrame:
    """Labels without Snapshot or Delta and with an underscore, two timing entries."""
    label, timing = F.col("label"), F.col("timing_ms")
    good = ~label.contains("Snapshot") & ~label.contains("Delta") & label.contains("_")
    return df.filter(good & (F.size(F.split(timing, " ")) >= 2) & (timing != "(No calibration available)"))


def with_label_odour(df: DataFrame) -> DataFrame:
    """M26."""
    odour, conc = X.odour_from_label("label")
    return df.withColumns({"odour": odour, "oconc": conc})


def zero_based(
    df: DataFrame, columns: Sequence[str] = ("stim_on", "stim_off", "stim2on", "stim2off"), note: str = "_zero_based"
) -> DataFrame:
    """Frame numbers from 1 to frame numbers from 0, with a note behind the comment."""
    changes = {c: F.col(c) - 1 for c in columns if c in df.columns}
    return df.withColumns({**changes, "comment": F.concat("comment", F.lit(note))})


def _short(tag: Column) -> Column:
    return F.regexp_replace(tag, "_?[^_]*$", "")


def candidate_paths(path: Column, tag: Column, extension: Column | str, root: str, short: Column | None = None) -> Column:
    """The eleven places where a data file may lie, best first. ``short``: the tag without its last part, where it is known."""
    root = root.rstrip("/")
    ext = F.lit(extension)
    short = _short(tag) if short is None else short

    def under(*parts: Column) -> Column:
        return F.concat_ws("/", F.lit(root), *parts)

    plain, full, tag_file = path, F.concat(path, ext), F.concat(tag, ext)
    return F.array(
        under(plain),
        under(full),
        under(tag, plain),
        under(tag, full),
        under(tag_file, full),
        under(tag, tag_file, plain),
        under(tag, tag_file, full),
        under(short, plain),
        under(short, full),
        under(short, tag_file, plain),
        under(short, tag_file, full),
    )


def _tried(path: Column, tag: Column, extensions: Sequence[str], root: str, short: Column | None = None) -> Column:
    """Candidates of all extensions in order; one lambda, so the code of a plan does not grow with them."""
    return F.flatten(F.transform(F.array(*[F.lit(e) for e in extensions]), lambda e: candidate_paths(path, tag, e, root, short)))


def _place(path: Column, extensions: Sequence[str]) -> Column:
    """A hash of a path without the extensions of its parts: most candidates of a recording share it with others."""
    bare = F.concat(path, F.lit("/"))
    for e in extensions:
        bare = F.replace(bare, F.lit(f"{e}/"), F.lit("/"))
    return F.xxhash64(bare)


def first_existing(df: DataFrame, listing: DataFrame, key: str, extensions: Sequence[str], root: str) -> DataFrame:
    """First candidate that exists, per recording. ``listing(path)``.

    Candidates do not travel: a recording goes once to each place (:func:`_place`) that its candidates have, five at most as a
    rule, whatever the number of extensions; there every listed path is looked up among the candidates themselves. The best one
    is a map-side minimum of (priority, path). Sizes of unrolled rows can't be estimated, so all joins are merged.
    """
    path, tag = F.col("__path"), F.col("__tag")
    tried = _tried(path, tag, extensions, root, F.col("__short"))
    places = F.array_distinct(F.transform(tried, lambda p: _place(p, extensions)))
    named = df.select(key, X.slashes("dbb1").alias("__path"), F.col("animal").alias("__tag")).withColumn("__short", _short(tag))
    asked = named.select(key, path, tag, F.explode_outer(places).alias("__at"))  # the inner form computes the array twice
    files = listing.filter("path IS NOT NULL").select("path").distinct().select("path", _place(F.col("path"), extensions).alias("__at"))
    near = asked.join(files.hint("merge"), "__at").withColumn("__short", _short(tag))
    none = 11 * len(extensions)
    prio = F.pmod(F.array_position(tried, F.col("path")) - 1, F.lit(none + 1))  # none where the path is no candidate
    best = near.select(key, F.struct(prio.alias("prio"), "path").alias("b")).groupBy(key).agg(F.min("b").alias("b"))
    found = best.filter(F.col("b.prio") < none).select(key, F.col("b.path").alias("existing_path"))
    return df.join(found.hint("merge"), key, "left")


def measurement_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tag, recording number and chosen columns in one label."""
    parts = [F.col(c).cast("string") for c in columns]
    return df.withColumn("full_label", F.concat_ws("_", F.col("animal"), F.col("measu").cast("string"), *parts))


def unique_labels(df: DataFrame, label: str = "label", order: str = "measu") -> DataFrame:
    """V, v(1), v(2), ... in order. A label shared by a large part of all rows is
    numbered in buckets of its order column, not in one task."""
    numbered = indexed(df, order, groups=[label], name="__i")
    suffix = F.when(F.col("__i") > 0, F.concat(F.lit("("), F.col("__i").cast("string"), F.lit(")"))).otherwise("")
    return numbered.withColumn("unique_label", F.concat(F.col(label), suffix)).drop("__i")


def loaded(df: DataFrame, traces: DataFrame) -> DataFrame:
    """Metadata with the pixels of each recording."""
    return join_per_key(traces, facts_in_use(df, traces, ["measu"]), ["measu"], spread=["x", "y"])


def latest_matching(listing: DataFrame, pattern: str, groups: Sequence[str] = ()) -> DataFrame:
    """Newest file whose whole name matches. ``listing(path, name, modified)``."""
    hits = listing.filter(F.col("name").rlike(f"(?i)^(?:{pattern})$"))
    newest = F.max(F.struct("modified", "path")).alias("b")
    return hits.groupBy(*groups).agg(newest).select(*groups, F.col("b.path").alias("path"))


def binned_metadata(df: DataFrame, b: int) -> DataFrame:
    """Metadata after binning by b: frame size / b (must divide) and, as established,
    pixel size / b; labels get the row number, the old label names the folder."""

    def divided(c: str) -> Column:
        wrong = F.raise_error(F.lit("the bin factor must divide the frame size")).cast("int")
        return F.when(F.col(c) % b == 0, (F.col(c) / b).cast("int")).otherwise(wrong)

    numbered = F.concat_ws("_", "label", F.col("row_idx").cast("string"))
    return df.withColumns(
        {
            "frame_x": divided("frame_x"),
            "frame_y": divided("frame_y"),
            "pxszx": F.col("pxszx") / b,
            "pxszy": F.col("pxszy") / b,
            "dbb1": F.concat(F.col("label"), F.lit("/"), numbered, F.lit(".tif")),
            "animal": F.col("label"),
            "label": numbered,
            "dbb2": F.lit(" "),
        }
    )
