"""Data model: table schemas, parameters with their defaults, the metadata definition."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

TRACES = "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>"
PIXELS = "measu BIGINT, x INT, y INT, t INT, v DOUBLE"
STIMULI = (
    "measu BIGINT, stim_idx INT, odor STRING, conc DOUBLE, on_ms DOUBLE, off_ms DOUBLE, period_ms DOUBLE"
)
AREA = "measu BIGINT, x INT, y INT"
ROI_SHAPES = (
    "roi STRING, kind STRING, cx DOUBLE, cy DOUBLE, d DOUBLE, vertices ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>"
)
ROI_PIXELS = "roi STRING, x INT, y INT, w DOUBLE"
SHIFTS = "measu BIGINT, t INT, dx INT, dy INT, quality INT"

#: Measurement-list schema: typed core columns, stimulus cells kept as text lists.
MEASUREMENTS = (
    "animal STRING, measu BIGINT, label STRING, analyze INT, odour STRING, stimulus STRING, oconc STRING, "
    "dbb1 STRING, dbb2 STRING, cycle DOUBLE, lambda_nm STRING, utc DOUBLE, mtime STRING, pxszx DOUBLE, "
    "pxszy DOUBLE, age STRING, stim_on STRING, stim_on_ms STRING, stim_off STRING, stim_len STRING, "
    "stim2on STRING, stim2on_ms STRING, stim2off STRING, stim2len STRING, extra MAP<STRING,STRING>"
)

META_DEF = (
    "lst_name STRING, type STRING, units STRING, settings_name STRING, p1_name STRING, "
    "requirement STRING, default_value STRING"
)

# The metadata definition (list name | group | unit | settings name |
# recording name | setup that requires the column | default).
_META_ROWS = """
Label|microscope||label|ex_name|all|not set yet
Measu|microscope||measu|messungszahl|all|-1
Analyze|analysis||analyze|analyze|all|-1
Odour|stimulus||odorants|odor||not set yet
Stimulus|stimulus||stim|stimulus||not set yet
OConc|stimulus||conc|odor_nr||not set yet
DBB1|paths||dbb|dbb1|all|not set yet
DBB_Folder|paths||dbb_folder|dbb_folder||not set yet
Lambda|microscope|nm|Lambda|lambda_nm|all|0
StimON|stimulus||stim_on|||-1
StimONms|stimulus||stim_on_ms|||-1
StimOFF|stimulus||stim_off|||-1
StimLen|stimulus||stim_len|||0
Stim2ON|stimulus||stim2on|||0
Stim2ONms|stimulus||stim2on_ms|||-1
Stim2OFF|stimulus||stim2off|||0
Stim2Len|stimulus||stim2Len|||0
Cycle|recording|ms|GDMfreq|trial_ticks|all|200
SampFreq|recording|Hz|SampFreq|frequency||5
MTime|||mtime|m_time||-00:00:00
Control|||control|kontrollmessung||0
Pharma|treatment||pharma|treatment||not set yet
PhTime|treatment||pharma_time|pharma_time||0
PhConc|treatment||pharma_conc|treat_conc||0
Comment|||comment|remark||not set yet
ShiftX|||shiftx|shiftX||0
ShiftY|||shifty|shiftY||0
StimISI|stimulus||stim_isi|stimulus_ISI||0
setting|||setting|viewlabel||not set yet
dbb2|paths||dbb2|dbb2|4|not set yet
dbb3|paths||dbb3|dbb3|0|not set yet
PxSzX|microscope|um|PxSzX|pixelsizex||0
PxSzY|microscope|um|PxSzY|pixelsizey||0
PosZ|microscope|um|position_z|posz||0
Countl|||countl|||0
slvFlip|||slvflip|||0
Age|animal|days|age|agetxt||-1
Sex|animal||sex|sex||not set yet
Side|animal||side|bodyside||not set yet
UTC|recording||UTC|utc||0
FrameSizeX|microscope|pixels|FrameSizeX|format_x||0
FrameSizeY|microscope|pixels|FrameSizeY|format_y||0
NumFrames|recording||Nframes|frames||0
""".strip()


def meta_rows() -> list[tuple[str | None, ...]]:
    """The metadata definition as tuples in schema order; empty cells are null."""
    return [tuple(cell or None for cell in line.split("|")) for line in _META_ROWS.splitlines()]


def meta_def(spark: SparkSession) -> DataFrame:
    """The metadata definition as a 43-row dimension."""
    return spark.createDataFrame(meta_rows(), META_DEF)


def defaults() -> dict[str, str]:
    """Default text of every known list column."""
    return {row[0]: row[6] for row in meta_rows()}


@dataclass(frozen=True)
class Params:
    """Parameters of the analysis, with the defaults a fresh set-up starts from."""

    # signal
    calc_method: int = 3
    setup: int = 665
    start_background: int = 4
    prestim_end_background: int = 1
    default_background: tuple[int, int] = (3, 5)
    stimulus_based_background: bool = True
    # corrections
    replace_init_frames: int = 0
    mean_filter: int = 0
    mean_filter_space: int = 3
    mean_filter_time: int = 3
    median_filter: int = 0
    median_filter_space: int = 3
    median_filter_time: int = 3
    scatter_factor: float = 0.0
    scatter_radius_um: float = 50.0
    bleach_method: str = "None"
    bleach_cut_border: float = 20.0
    bleach_exclude_area: bool = True
    bleach_exclude_stimulus: bool = True
    bleach_start_frame: int = 2
    bleach_exclude_seconds: float = 0.0
    bleach_initial_factor: float = 1.0
    # features
    feature: int | str = 22
    feature_number: int = 0
    first_frame: int = 25
    last_frame: int = 45
    stimulus_number: int = 0
    # region traces
    output_type: str = "full_traces"
    chunk_pre_s: float = 0.0
    chunk_post_s: float = 0.0
    within_area: bool = False
    roi_source: int = 3
    roi_threshold: float = 75.0
    roi_radius: int = 5
    # overview and movie numerics
    scale_min: float = -0.08
    scale_max: float = 0.3
    individual_scale: int = 3
    scale_margin: float = 0.2
    percentile_scale: bool = False
    percentile_value: float = 0.0
    cut_border: int = 0
    rotate: int = 0
    reverse: bool = False
    threshold_on: str = "none"
    threshold_scale: str = "full"
    threshold_image: str = "foto1"
    threshold_positive: str = "a0"
    threshold_negative: str = "a0"
    legend_factor: float = 1.0
    space_filter: bool = False
    space_filter_size: float = 1.0
    time_filter: bool = False
    time_filter_size: float = 3.0
    movie_first_frame: int = 0
    movie_last_frame: int = -1
    movie_speed: float = 1.0
    suppress_milliseconds: bool = True
    mark_stimulus: int = 1
    stimulus_offset_ms: float = 0.0
    label_columns: tuple[str, ...] = ("measu",)

    def with_(self, **changes) -> "Params":
        """A copy with some values changed; unknown names are an error."""
        known = {f.name for f in fields(self)}
        unknown = set(changes) - known
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, **changes)
