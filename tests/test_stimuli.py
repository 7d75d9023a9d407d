"""Golden stimulus tables and stimulus operators on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.model import MEASUREMENTS, STIMULI, Params
from lumentrace.operators import stimuli as T

UNSET = dict(
    stim_on="-1", stim_on_ms="-1", stim_off="-1", stim_len="0", stim2on="0", stim2on_ms="-1", stim2off="0", stim2len="0"
)


def listing(spark, *rows):
    names = [part.split()[0] for part in MEASUREMENTS.split(", ")]
    full = []
    for i, cells in enumerate(rows):
        values = {**UNSET, "odour": "FAKE", "oconc": "-10", "cycle": 200.0, "measu": i, **cells}
        full.append(tuple(values.get(n) for n in names))
    return spark.createDataFrame(full, MEASUREMENTS)


ONE = {"stimON": {"stim_on": "25"}, "stimONms": {"stim_on_ms": "5000"}}
END = {
    "stimLen": ({"stim_len": "1000"}, 6.0),
    "stimOFF": ({"stim_off": "35"}, 7.2),
    "stimOFF_stimLen": ({"stim_off": "35", "stim_len": "1000"}, 7.2),
}
TWO_ON = {"stimON": {"stim_on": "25,50"}, "stimONms": {"stim_on_ms": "5000,10000"}}
TWO_END = {
    "stimLen": ({"stim_len": "1000,1000"}, 6.0, 11.0),
    "stimOFF": ({"stim_off": "35,60"}, 7.2, 12.2),
    "stimOFF_stimLen": ({"stim_off": "35,60", "stim_len": "1000,1000"}, 7.2, 12.2),
}
OLD_ON = {
    "stimON": {"stim_on": "25", "stim2on": "50"},
    "stimONms": {"stim_on_ms": "5000", "stim2on_ms": "10000"},
}
OLD_END = {
    "stimLen": ({"stim_len": "1000", "stim2len": "1000"}, 6.0, 11.0),
    "stimOFF": ({"stim_off": "35", "stim2off": "60"}, 7.2, 12.2),
    "stimOFF_stimLen": ({"stim_off": "35", "stim_len": "1000", "stim2off": "60", "stim2len": "1000"}, 7.2, 12.2),
}


def pulses(spark, cells):
    rows = T.parse_stimuli(listing(spark, cells)).orderBy("stim_idx").collect()
    assert all(r.odor == "FAKE" and r.conc == -10.0 and r.period_ms == 200.0 for r in rows)
    return [(r.on_ms / 1000, r.off_ms / 1000) for r in rows]


@pytest.mark.parametrize("on", ONE)
@pytest.mark.parametrize("end", END)
def test_one_stimulus(spark, on, end):
    cells, stop = END[end]
    assert pulses(spark, {**ONE[on], **cells}) == [(5.0, stop)]


@pytest.mark.parametrize("on", TWO_ON)
@pytest.mark.parametrize("end", TWO_END)
def test_two_stimuli_in_lists(spark, on, end):
    cells, a, b = TWO_END[end]
    assert pulses(spark, {**TWO_ON[on], **cells}) == [(5.0, a), (10.0, b)]


@pytest.mark.parametrize("on", OLD_ON)
@pytest.mark.parametrize("end", OLD_END)
def test_two_stimuli_in_second_columns(spark, on, end):
    cells, a, b = OLD_END[end]
    assert pulses(spark, {**OLD_ON[on], **cells}) == [(5.0, a), (10.0, b)]


def test_mixed_list_without_second_off_frame(spark):
    cells = {"stim_on": "25, 50", "stim_off": "35,", "stim_len": "1000"}
    assert pulses(spark, cells) == [(5.0, 7.2), (10.0, 11.0)]


def test_single_values_go_to_every_stimulus(spark):
    assert pulses(spark, {"stim_on": "25,50,60", "stim_len": "1000"}) == [(5.0, 6.0), (10.0, 11.0), (12.0, 13.0)]


def test_no_stimulus_gives_no_rows(spark):
    rows = T.parse_stimuli(listing(spark, {"odour": "not set yet", "oconc": "not set yet"}))
    assert rows.count() == 0


@pytest.mark.parametrize(
    "cells",
    [
        {"stim_on": "25,50,60", "stim_off": "35,60"},  # lists of different lengths
        {"stim_on": "abc", "stim_len": "1000"},  # not a number
        {"stim_on": "25", "stim_on_ms": "5001", "stim_len": "1000"},  # frame and time disagree
        {"stim_on": "-5", "stim_len": "1000"},  # negative
    ],
)
def test_invalid_stimuli_fail(spark, cells):
    with pytest.raises(Exception):
        T.parse_stimuli(listing(spark, cells)).collect()


def test_incomplete_stimuli_are_dropped(spark):
    assert pulses(spark, {"stim_on": "25"}) == []


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (1, 0, "A", -2.0, 1000.0, 2000.0, 200.0),
        (1, 1, "B", -3.0, 500.0, 1500.0, 200.0),
        (2, 0, "C", -1.0, 90.0, 300.0, 200.0),
    ]
    return spark.createDataFrame(rows, STIMULI)


def test_active_stimuli_include_both_ends(spark, table):
    times = spark.createDataFrame([(i, 1, float(t)) for i, t in enumerate([499, 500, 1000, 1500, 2000, 2001])], "k INT, measu BIGINT, t_ms DOUBLE")
    got = {r.k: r.odors for r in T.active_stimuli(table, times, "k", finest_ms=300.0).collect()}
    assert got == {0: [], 1: ["B"], 2: ["A", "B"], 3: ["A", "B"], 4: ["A"], 5: []}


def heavy_tailed():
    rng = np.random.default_rng(4)
    on = np.concatenate([rng.uniform(0, 1e6, 300), 5e5 + rng.uniform(0, 5, 200), [0.0, -50.0, 7.0, 9.0]])
    length = np.concatenate([np.exp(rng.normal(3, 3, 300)), rng.uniform(0, 1, 200), [1e9, 1e6, 0.0, -5.0]])
    return [(1 + i % 2, i, "A", -1.0, float(a), float(a + n), 200.0) for i, (a, n) in enumerate(zip(on, length))]


@pytest.mark.parametrize("finest", [1.0, 0.001, 1e5])
def test_interval_join_with_heavy_tails_and_bursts(spark, finest):
    rows = heavy_tailed()
    pulses = spark.createDataFrame(rows, STIMULI).repartition(4)
    rng = np.random.default_rng(5)
    t = np.concatenate([rng.uniform(-100, 1.2e6, 400), 5e5 + rng.uniform(-1, 7, 300), [r[4] for r in rows[:20]], [r[5] for r in rows[:20]]])
    times = spark.createDataFrame([(i, 1 + i % 2, float(x)) for i, x in enumerate(t)], "k INT, measu BIGINT, t_ms DOUBLE").repartition(3)
    got = sorted((r.k, r.stim_idx) for r in T.active_pairs(pulses, times, finest).collect())
    assert got == sorted((i, r[1]) for i, x in enumerate(t) for r in rows if r[0] == 1 + i % 2 and r[4] <= x <= r[5])


def test_pulses_are_laid_on_few_cells(spark):
    pulses = spark.createDataFrame(heavy_tailed(), STIMULI)
    cells = pulses.select(F.size(T.interval_cells(F.col("on_ms"), F.col("off_ms"))).alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 3


def test_first_listed_onset_not_earliest(table):
    got = {r.measu: r.onset_frame for r in T.first_onsets(table).collect()}
    assert got == {1: 5, 2: 0}


def test_background_range_defaults(spark, table):
    recordings = spark.createDataFrame([(1,), (2,), (3,)], "measu BIGINT")
    params = Params(start_background=1, prestim_end_background=2)
    got = {r.measu: (r.bg_start, r.bg_end, r.onset_frame) for r in T.background_ranges(recordings, table, params).collect()}
    assert got == {1: (1, 3, 5), 2: (3, 5, -1), 3: (3, 5, -1)}
    fixed = T.background_ranges(recordings, table, Params(stimulus_based_background=False))
    assert {(r.bg_start, r.bg_end) for r in fixed.collect()} == {(3, 5)}


def test_onset_of_a_later_stimulus(table):
    assert [(r.measu, r.on_ms) for r in T.onsets(table, 1).collect()] == [(1, 500.0)]


def test_time_texts(spark):
    df = spark.createDataFrame([(-1500.0,), (0.0,), (61250.0,), (125000.0,)], "ms DOUBLE")
    got = df.select(T.time_text(F.col("ms")).alias("a"), T.time_text(F.col("ms"), False).alias("b")).collect()
    assert [r.a for r in got] == ["- 1.500 s", " 0.000 s", "1 m  1.250 s", "2 m  5.000 s"]
    assert [r.b for r in got] == ["- 2 s", " 0 s", "1 m  1 s", "2 m  5 s"]


def test_trains_repeat_until_the_end(spark):
    one = spark.createDataFrame([(1, 0, "A", 0.0, 400.0, 1000.0, 200.0)], STIMULI)
    counts = spark.createDataFrame([(1, 12)], "measu BIGINT, n_frames INT")
    got = [r.t for r in T.stimulus_trains(one, counts, 4).filter("stimulated").orderBy("t").collect()]
    expected = [False] * 12
    start, end = 2, 5
    expected[start:end] = [True] * 3
    start, end = start + 4, end + 4
    while end < 11:
        expected[start:end] = [True] * 3
        start, end = start + 4, end + 4
    assert got == [t for t, on in enumerate(expected) if on]
