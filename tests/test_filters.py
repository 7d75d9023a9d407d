"""Filters, motion and bleaching against NumPy written for these tests."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.functions.fits import fit_decay, start_values
from lumentrace.model import Params
from lumentrace.operators import bleach as B
from lumentrace.operators import filters as R
from lumentrace.operators import motion as MO
from lumentrace.plans import recipes


def neighbours(image, axis, low, high, edge):
    """The values at offsets low..high along an axis, stacked in front."""
    n = image.shape[axis]
    out = []
    for d in range(low, high + 1):
        i = np.arange(n) + d
        if edge == "nearest":
            i = np.clip(i, 0, n - 1)
        else:
            i = i % (2 * n)
            i = np.where(i < n, i, 2 * n - 1 - i)
        out.append(np.take(image, i, axis=axis))
    return np.stack(out)


def box(movie, sizes):
    for axis, k in zip((1, 2, 3), sizes):
        movie = neighbours(movie, axis, -(k // 2), k - k // 2 - 1, "nearest").mean(axis=0)
    return movie


def median(movie, sizes):
    stack = movie[None]
    for axis, k in zip((1, 2, 3), sizes):
        stack = np.concatenate([neighbours(s, axis, -(k // 2), k - k // 2 - 1, "nearest") for s in stack])
    return np.sort(stack, axis=0)[stack.shape[0] // 2]


def gauss(movie, sigma, axes, edge):
    w = np.array(A.gaussian_weights(sigma))
    r = len(w) // 2
    for axis in axes:
        movie = np.tensordot(w, neighbours(movie, axis, -r, r, edge), axes=1)
    return movie


@pytest.mark.parametrize("space,time", [(3, 1), (1, 3), (2, 3), (5, 4), (10, 10)])
def test_mean_filter(traces, movie, to_array, space, time):
    got = to_array(R.mean_filter(traces, space, time), movie.shape)
    np.testing.assert_allclose(got, box(movie, (space, space, time)))


@pytest.mark.parametrize("space,time", [(3, 1), (1, 3), (2, 3), (3, 4), (10, 10)])
def test_median_filter(traces, movie, to_array, space, time):
    got = to_array(R.median_filter(traces, space, time), movie.shape)
    np.testing.assert_allclose(got, median(movie, (space, space, time)))


@pytest.mark.parametrize("sigma", [0.4, 1.0, 2.5])
@pytest.mark.parametrize("edge", ["reflect", "nearest"])
def test_gaussian_frames(traces, movie, to_array, sigma, edge):
    got = to_array(R.gaussian_frames(R.exploded(traces), sigma, edge), movie.shape)
    np.testing.assert_allclose(got, gauss(movie, sigma, (1, 2), edge))


def test_gaussian_trace_longer_than_trace(traces, movie, to_array):
    out = R.exploded(traces.withColumn("trace", R.gaussian_trace(F.col("trace"), 6.0)))
    np.testing.assert_allclose(to_array(out, movie.shape), gauss(movie, 6.0, (3,), "reflect"))


def test_scattered_light(traces, movie, to_array):
    got = to_array(R.descattered(R.exploded(traces), 1.5, 1.2), movie.shape)
    excess = movie - gauss(movie, 1.2, (1, 2), "nearest")
    np.testing.assert_allclose(got, movie + 1.5 * gauss(excess, 1.2, (1, 2), "nearest"))


@pytest.mark.parametrize("size", [1, 4, 5, 7])
def test_pyramid(traces, movie, to_array, size):
    got = to_array(R.pyramid_sum(R.exploded(traces), size), movie.shape)
    ring = np.minimum(np.arange(size), np.arange(size)[::-1])
    kernel = np.minimum.outer(ring, ring) + 1 if size % 2 else np.ones((size, size))
    low = size // 2
    padded = np.pad(movie, ((0, 0), (low, low), (low, low), (0, 0)))
    want = sum(
        kernel[i, j] * padded[:, i : i + movie.shape[1], j : j + movie.shape[2]] for i in range(size) for j in range(size)
    )
    np.testing.assert_allclose(got, want)


def test_constant_stays_constant(spark, to_array):
    rows = [(0, x, y, [3.0] * 8) for x in range(4) for y in range(4)]
    flat = spark.createDataFrame(rows, "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>")
    for out in (R.mean_filter(flat, 3, 3), R.median_filter(flat, 3, 3), R.gaussian_frames(R.exploded(flat), 1.0)):
        np.testing.assert_allclose(to_array(out, (1, 4, 4, 8)), 3.0)


def test_highpass(traces, movie, to_array):
    taps = np.array(R.highpass_taps(1000.0))
    assert abs(taps.sum()) < 1e-9
    delay = (len(taps) - 1) // 2
    got = to_array(R.exploded(traces.withColumn("trace", R.highpass(F.col("trace"), 1000.0))), movie.shape)
    padded = np.concatenate([np.repeat(movie[..., :1], 2 * delay + 2, -1), movie, np.repeat(movie[..., -1:], 2 * delay + 2, -1)], -1)
    want = np.apply_along_axis(lambda s: np.convolve(s, taps), 3, padded)[..., 3 * delay + 2 : 3 * delay + 2 + movie.shape[3]]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_replaced_start_makes_equal_frames(traces):
    row = traces.select(R.replaced_start(F.col("trace"), 5).alias("t"), "trace").first()
    assert len(set(row.t[:6])) == 1 and row.t[5:] == row.trace[5:] and row.t[6] != row.t[5]
    same = traces.select(R.replaced_start(F.col("trace"), 20).alias("t"), "trace").first()
    assert same.t == same.trace


def test_binning_drops_incomplete_blocks(traces, movie, to_array):
    got = to_array(R.binned(R.exploded(traces), 2), (2, 3, 2, 20))
    want = np.trunc(movie[:, :6, :4].reshape(2, 3, 2, 2, 2, 20).mean(axis=(2, 4)))
    np.testing.assert_allclose(got, want)


def test_shape_guard(spark, traces):
    shorter = traces.withColumn("trace", F.slice("trace", 1, 10))
    assert {r.same_shape for r in R.same_shape(traces, traces).collect()} == {True}
    assert R.checked_shapes(traces, traces).count() == 60
    with pytest.raises(Exception):
        R.checked_shapes(traces, shorter).collect()


# --- motion -----------------------------------------------------------------------------


def test_known_shifts_are_found_and_undone(spark, to_array, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (20, 21))
    moves = {0: (1, -2), 1: (0, 0), 2: (0, 1), 3: (-1, -1), 4: (2, 0), 5: (0, 0), 6: (-2, 2), 7: (2, 1)}
    rows = []
    for t, (dx, dy) in moves.items():
        image = np.roll(base, (-dx, -dy), axis=(0, 1))
        rows += [(0, x, y, t, float(image[x, y])) for x in range(20) for y in range(21)]
    pixels = spark.createDataFrame(rows, "measu BIGINT, x INT, y INT, t INT, v DOUBLE").repartition(4)
    found = {r.t: (r.dx, r.dy, r.quality) for r in MO.estimated_shifts(pixels, 20, 21).collect()}
    assert {t: f[:2] for t, f in found.items()} == moves
    assert found[5][2] == 0 and found[0][2] in (9, 10)
    path = str(tmp_path / "a.moveList")
    for mode in ("compute", "compute_save", "reuse"):
        out = MO.motion_corrected(pixels, mode, 20, 21, movement_file=path)
        images = to_array(out, (1, 20, 21, 8))
        for t in moves:
            np.testing.assert_allclose(images[0, :, :, t], base)
    with pytest.raises(NotImplementedError):
        MO.motion_corrected(pixels, "guess", 20, 21)


def test_roll_there_and_back(spark, traces, movie, to_array):
    pixels = R.exploded(traces)
    shifts = pixels.select("measu", "t").distinct().selectExpr("measu", "t", "t % 4 - 1 AS dx", "t % 3 - 1 AS dy")
    back = shifts.selectExpr("measu", "t", "-dx AS dx", "-dy AS dy")
    there = MO.rolled(pixels, shifts, 6, 5)
    np.testing.assert_allclose(to_array(MO.rolled(there, back, 6, 5), movie.shape), movie)


# --- bleaching --------------------------------------------------------------------------


def test_fit_finds_a_known_decay():
    t = np.arange(80.0)
    y = np.stack([50 * np.exp(-0.03 * t) + 200, 20 * np.exp(-0.3 * t) + 10, 400 * np.exp(-0.01 * t) + 5])
    fitted, abc = fit_decay(y, np.ones(80))
    np.testing.assert_allclose(abc[:2], [[50, -0.03, 200], [20, -0.3, 10]], rtol=1e-4)
    np.testing.assert_allclose(fitted[:2], y[:2], atol=2e-2)
    # The third decay is longer than its trace: A stops at its upper bound.
    offset = 1.01 * y[2].min() - 0.01 * y[2].max()
    a0 = start_values(t, y[2:])[0][0]
    np.testing.assert_allclose(abc[2, 0], max(y[2].max() - offset, a0))


def test_fit_is_as_good_as_a_dense_grid():
    rng = np.random.default_rng(5)
    t = np.arange(60.0)
    y = 30 * np.exp(-0.05 * t) + 100 + rng.normal(0, 1, (6, 60))
    w = np.where(t < 10, 2.0, 1.0)
    w[20:30] = 0
    fitted, abc = fit_decay(y, w)
    keep = w != 0
    got = ((fitted - y)[:, keep] ** 2 * w[keep] ** 2).sum(axis=1)
    best = np.full(6, np.inf)
    for k in np.concatenate([-np.geomspace(1e-4, 2, 4000), np.geomspace(1e-4, 0.5, 500)]):
        basis = np.stack([np.exp(k * t[keep]), np.ones(keep.sum())], axis=1) * w[keep][:, None]
        sol = np.linalg.lstsq(basis, (y[:, keep] * w[keep]).T, rcond=None)[0]
        low, high = y[:, keep].min(axis=1), y[:, keep].max(axis=1)
        offset = 1.01 * low - 0.01 * high
        inside = (sol[0] >= np.minimum(low - offset, 0) - 1e9) & (sol[0] <= np.maximum(high - offset, np.abs(sol[0])))
        rss = ((basis @ sol - (y[:, keep] * w[keep]).T) ** 2).sum(axis=0)
        best = np.where(inside, np.minimum(best, rss), best)
    assert (got <= best * (1 + 1e-3)).all()


def test_flat_trace_keeps_start_values():
    fitted, abc = fit_decay(np.full((1, 30), 7.0), np.ones(30))
    np.testing.assert_allclose(abc, [[0.0, 1.0, 7.0]])
    np.testing.assert_allclose(fitted, 7.0)


@pytest.fixture(scope="module")
def bleached(spark):
    t = np.arange(40.0)
    rows = []
    for m in range(2):
        for x in range(4):
            for y in range(4):
                v = (20 + x) * np.exp(-0.06 * t) + 300 + 10 * y
                rows.append((m, x, y, v.tolist()))
    return spark.createDataFrame(rows, "measu BIGINT, x INT, y INT, trace ARRAY<DOUBLE>")


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([(0, 3, 9, 5.0), (1, 4, 12, 5.0)], "measu BIGINT, bg_start INT, bg_end INT, rate_hz DOUBLE")


def test_pixelwise_correction(bleached, facts):
    mask = bleached.filter("x < 2").select("measu", "x", "y")
    params = Params(bleach_exclude_seconds=2.0)
    out = B.pixelwise(bleached, facts, mask, params)
    before = {(r.measu, r.x, r.y): np.array(r.trace) for r in bleached.collect()}
    rows = out.collect()
    assert len(rows) == 32
    for r in rows:
        old, new = before[r.measu, r.x, r.y], np.array(r.trace)
        if r.x < 2:
            assert abs(new.mean() - old.mean()) < 1e-6  # the mean of a trace is kept
            assert new.std() < 0.05 * old.std()
            assert r.k < 0
        else:
            np.testing.assert_array_equal(new, old)
            assert r.a is None


@pytest.mark.parametrize("masked_mean", [False, True])
def test_uniform_correction(bleached, facts, masked_mean):
    mask = bleached.filter("x < 2").select("measu", "x", "y")
    out = B.uniform(bleached, facts, mask, Params(), masked_mean)
    raw = np.zeros((2, 4, 4, 40))
    for r in bleached.collect():
        raw[r.measu, r.x, r.y] = r.trace
    f0 = np.stack([raw[0, :, :, 3:10].mean(-1), raw[1, :, :, 4:13].mean(-1)])
    rel = raw / f0[..., None]
    inside = np.zeros((4, 4), bool)
    inside[:2] = True
    for m, bg_end in ((0, 9), (1, 12)):
        curve = rel[m][inside].mean(axis=0) if masked_mean else (rel[m] * inside[..., None]).mean(axis=(0, 1))
        w = np.ones(40)
        w[:2] = 0
        fit = fit_decay(curve[None], w)[0][0]
        want = (rel[m] - fit + fit.mean()) * f0[m][..., None]
        for r in out.filter(F.col("measu") == m).collect():
            np.testing.assert_allclose(r.trace, want[r.x, r.y], rtol=1e-6)


def test_weight_rules_in_order(spark):
    params = Params(bleach_exclude_seconds=1.0, bleach_initial_factor=3.0, bleach_start_frame=2)
    row = spark.range(1).select(B.bleach_weights(F.lit(20), F.lit(6), F.lit(5.0), params, True).alias("w")).first()
    want = np.ones(20)
    want[:6] = 3
    want[:2] = 0
    want[6:11] = 0
    assert row.w == want.tolist()


@pytest.mark.parametrize("method", ["None", "log_pixelwise_1cpu", "log_pixelwise_parallel", "log_uniform"])
@pytest.mark.parametrize("by_area", [True, False])
def test_correction_pipeline(bleached, facts, method, by_area):
    area = bleached.filter("y < 3").select("measu", "x", "y")
    params = Params(bleach_method=method, bleach_exclude_area=by_area, median_filter=1, mean_filter=2, replace_init_frames=2)
    out = recipes.corrected(bleached, facts, area, params, 4, 4)
    rows = out.collect()
    assert len(rows) == 32 and all(len(r.trace) == 40 for r in rows)
    if method == "log_uniform" and by_area:
        again = recipes.corrected(bleached, facts, area, params, 4, 4, materialise=True)
        got = {(r.measu, r.x, r.y): r.trace for r in again.collect()}
        for r in rows:
            np.testing.assert_allclose(got[r.measu, r.x, r.y], r.trace)
    with pytest.raises(NotImplementedError):
        recipes.corrected(bleached, facts, area, params.with_(bleach_method="linear"), 4, 4)


def test_whole_frame_correction(bleached, facts):
    area = bleached.select("measu", "x", "y")
    signal = bleached.withColumn("trace", F.transform("trace", lambda v: v / 300 - 1))
    out = B.whole_frame(signal, facts, area, Params(bleach_exclude_stimulus=False)).filter("measu = 0").collect()
    stack = np.array([[r.measu, *r.trace] for r in signal.filter("measu = 0").collect()])[:, 1:]
    w = np.ones(40)
    w[:2] = 0
    fit = fit_decay(np.median(stack, axis=0)[None], w)[0][0]
    got = np.sort(np.array([r.trace for r in out]), axis=0)
    np.testing.assert_allclose(got, np.sort(stack - fit, axis=0), atol=1e-9)


def test_decay_rate_is_free():
    t = np.arange(64.0)
    for a, k, c in ((2, -5, 3), (2, -3, 3), (3, -12, 1), (5, -0.05, 1), (100, -0.5, 7)):
        y = (a * np.exp(k * t) + c)[None]
        fitted, abc = fit_decay(y, np.ones(64))
        assert np.abs(fitted - y).max() < 1e-8 and np.allclose(abc[0], [a, k, c], rtol=1e-5)


def test_likely_shifts_hold_the_first_best(spark):
    """Transforms and running sums against every candidate, with ties from a periodic image."""
    rng = np.random.default_rng(3)
    noise, wave = rng.normal(size=(240, 200)), np.add.outer(np.arange(60) % 4, np.arange(48) % 4).astype(float)
    for ref, image, r in ((noise, np.roll(noise, (3, -5), (0, 1)) + 0.1 * rng.normal(size=noise.shape), 9), (wave, np.roll(wave, (1, 0), (0, 1)), 5)):
        inner = slice(r, -r)
        target = ref[inner, inner] - ref[inner, inner].mean()
        best, where = 0.0, None
        for dx in range(-r, r + 1):
            for dy in range(-r, r + 1):
                moved = np.roll(image, (dx, dy), (0, 1))[inner, inner]
                moved = moved - moved.mean()
                score = (moved * target).sum() / np.sqrt((target**2).sum() * (moved**2).sum())
                if score > best:
                    best, where = score, (dx, dy)
        likely = MO._likely_shifts(image, target, r)
        assert where in likely and likely == sorted(likely) and len(likely) < 40
    assert MO._likely_shifts(np.ones((20, 20)), np.zeros((16, 16)), 2)
