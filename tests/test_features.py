"""Trace features: values, ties, NaN, borders, user functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.functions import features as C
from lumentrace.model import Params
from lumentrace.operators import signals as G
from lumentrace.streaming import dff_stream, traces_stream


def one(spark, trace, *columns):
    df = spark.createDataFrame([(1, 0, 0, [float(v) for v in trace])], "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>")
    row = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [row[i] for i in range(len(columns))]


def ctx(**kw):
    return C.FeatureContext.from_params(Params(**kw.pop("params", {})), **kw)


def chunk_reference(v):
    v = np.asarray(v)
    half = v[: len(v) // 2]
    m, top = half.argmin(), half.argmax()
    low, high = v[m:].argmin(), v[m:].argmax()
    if low == 0:
        base, peak = m, m + high
    elif high == 0:
        base, peak = m + low, top
    elif low < high:
        base, peak = m + high, m + low
    else:
        base, peak = m + low, m + high
    return v[peak] - v[base], base, peak


@pytest.mark.parametrize("seed", range(12))
def test_chunk_magnitude(spark, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 5, 21).astype(float) if seed % 2 else rng.normal(0, 1, 20)
    if seed % 3 == 0:
        v[0] = v.max() + 3
    assert tuple(one(spark, v, *C.chunk_magnitude(F.col("trace")))) == pytest.approx(chunk_reference(v))


def test_peak_takes_the_first_maximum(spark):
    v = np.zeros(60)
    v[[20, 24]] = 5.0
    v[25] = 1.0
    [value] = one(spark, v, *C.peak_after_onset(F.col("trace"), ctx(on_ms=F.lit(3000.0))))
    assert value == pytest.approx(5 / 3)


def test_peak_is_cut_at_the_end(spark):
    v = np.arange(30.0)
    [late] = one(spark, v, *C.peak_after_onset(F.col("trace"), ctx(on_ms=F.lit(5000.0))))
    assert late == pytest.approx(28 - 25)  # peak clamped to frame 28, base is frame 25
    [beyond] = one(spark, v, *C.peak_after_onset(F.col("trace"), ctx(on_ms=F.lit(60000.0))))
    assert beyond is None


def test_windows_and_borders(spark):
    v = np.arange(48.0)
    trace = F.col("trace")
    assert one(spark, v, *C.rise_three(trace, ctx())) == [20.0]
    assert one(spark, v, *C.rise_three(trace, ctx(params={"last_frame": 47}))) == [None]
    assert one(spark, v, *C.rise_three(trace, ctx(params={"first_frame": 0}))) == [None]
    assert one(spark, v, *C.rise_four(trace, ctx(params={"last_frame": 44}))) == [19.0]
    assert one(spark, v, *C.rise_four(trace, ctx(params={"last_frame": 45}))) == [None]
    assert one(spark, v, *C.mean_window(trace, ctx())) == [np.arange(25, 47).mean()]
    assert one(spark, v, *C.mean_window(trace, ctx(params={"last_frame": 47}))) == [None]
    assert np.isnan(one(spark, v, *C.safe(C.rise_three(trace, ctx(params={"last_frame": 47}))))[0])


def test_nan_is_ignored(spark):
    v = np.array([np.nan, 1.0, 2.0, 9.0, np.nan, 4.0])
    trace = F.col("trace")
    got = one(spark, v, *C.mean_all(trace, ctx()), *C.median_all(trace, ctx()), *C.median_early(trace, ctx()))
    assert got == [4.0, 3.0, 4.0]


def test_zero_baseline_divides_by_one(spark):
    v = [0.0, 0.0, 0.0, 5.0]
    [out] = one(spark, v, G.relative_change("trace", F.lit(0), F.lit(2)))
    assert out == [-1.0, -1.0, -1.0, 4.0]


def test_registry(spark):
    numbers = [r.feature for r in C.available_features(spark).orderBy("feature").collect()]
    assert numbers == [0, 22, 35, 222, 300, 301, 302, 303, 330, 331, 332, 333]
    with pytest.raises(NotImplementedError):
        C.feature(999)
    with pytest.raises(NotImplementedError):
        G.signal(Params(calc_method=7), None, None)
    with pytest.raises(ValueError):
        Params().with_(no_such_parameter=1)


def test_user_feature_signature_is_checked():
    with pytest.raises(TypeError):
        C.user_feature(lambda trace: [0.0])


def test_model_choice_needs_a_clear_margin(spark):
    scores = spark.createDataFrame(
        [(1, "a", 1, -100.0), (1, "b", 1, -90.0), (1, "c", 2, -149.0), (2, "a", 1, -100.0), (2, "c", 2, -151.0)],
        "k INT, model STRING, components INT, bic DOUBLE",
    )
    got = {r.k: r.model for r in C.choose_model(scores, ["k"]).collect()}
    assert got == {1: "a", 2: "c"}


def test_signal_runs_on_a_stream(spark, traces, tmp_path):
    """Row-wise operators need no change for a streaming source."""
    traces.write.parquet(str(tmp_path / "in"))
    out = dff_stream(traces_stream(spark, str(tmp_path / "in")), Params())
    query = out.writeStream.format("memory").queryName("dff_stream").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("dff_stream").exceptAll(dff_stream(traces, Params())).count() == 0
    assert spark.table("dff_stream").count() == 60


def test_global_peak_at_the_onset(spark):
    """Frame on-1 is next to the peak and before the onset: the later rule, -1/3, holds."""
    from lumentrace.functions import features as C

    trace = [1.0, 2.0, 4.0, 8.0, 100.0, 16.0, 3.0, 2.0, 1.0, 0.0]
    traces = spark.createDataFrame([(1, 0, 0, trace), (2, 0, 0, trace[:5])], "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>")
    onsets = spark.createDataFrame([(1, 4), (2, 4)], "measu BIGINT, onset_frame INT")
    got = {r.measu: r.value for r in C.global_peak_overview(traces, onsets, 5.0).collect()}
    assert abs(got[1] - (100 + 16 - 2 - 4 - 8) / 3) < 1e-9 and abs(got[2] - (100 - 2 - 4 - 8) / 3) < 1e-9


def test_delays_by_transforms_equal_direct_sums(spark):
    rng = np.random.default_rng(21)

    def rising(values):
        falls = np.append(np.diff(values) <= 0, False)
        kept = np.where(falls, np.median(values), values)
        return np.where(kept >= values.min() + 0.85 * (values.max() - values.min()), np.median(values), kept)

    pairs = []
    for n in (64, 50, 1000):
        for _ in range(12):
            a = np.cumsum(rng.normal(size=n))
            pairs.append((a, np.roll(a, int(rng.integers(0, 20))) + 0.1 * rng.normal(size=n)))
    pairs += [(np.zeros(8), np.zeros(8)), (np.ones(5), np.arange(5.0)), (np.tile([0.0, 1.0, 0.5], 20), np.tile([0.5, 0.0, 1.0], 20)), (np.array([1.0]), np.array([2.0]))]
    want = [int(np.argmax(np.correlate(rising(a), rising(b), "full"))) - len(a) + 1 for a, b in pairs]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)] + [(99, None, [1.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.lag for r in df.repartition(3).select("i", C.rising_phase_delay(F.col("a"), F.col("b")).alias("lag")).collect()}
    assert got.pop(99) is None
    assert [got[i] for i in range(len(pairs))] == want


def test_delay_of_long_traces():
    rng = np.random.default_rng(22)
    a = np.cumsum(rng.normal(size=(4, 10_000)), axis=1)
    b = np.stack([np.roll(x, k) for x, k in zip(a, (3, 0, 500, 77), strict=True)])
    want = [int(np.argmax(np.correlate(x, y, "full"))) - 9_999 for x, y in zip(a, b, strict=True)]
    assert C.best_lags(a, b).tolist() == want


def test_several_features_in_one_pass(spark, traces):
    ctx = C.FeatureContext.from_params(Params(first_frame=5, last_frame=12))
    both = C.apply_features(traces, [22, 300], ctx)
    for name in (22, 300):
        one = {(r.measu, r.x, r.y): r.value for r in C.apply_feature(traces, name, ctx).collect()}
        got = {(r.measu, r.x, r.y): r.value for r in both.filter(F.col("feature") == str(name)).collect()}
        assert got == one
