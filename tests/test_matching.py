"""Template matching and drift on planted recordings."""

import numpy as np
import pytest

from dagspark.operators import matching, motion, sorting
from dagspark.operators.tabular import ROW


def shape(channels, centre, width, skew, size):
    t = np.arange(-matching.BEFORE, matching.AFTER)
    wave = -np.exp(-0.5 * (t / width) ** 2) + skew * np.exp(-0.5 * ((t - 6) / 4) ** 2)
    space = np.exp(-0.5 * ((np.arange(channels) - centre) / 0.8) ** 2)
    return size * space[:, None] * wave[None, :]


def planted(seed, n, channels, units):
    """A recording of unit noise with each unit's spikes; a third of the second unit's overlap the first's."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(channels, n))
    first = np.arange(100, n - 100, 160) + rng.integers(-20, 20, len(range(100, n - 100, 160)))
    second = np.concatenate([first[::3] + rng.integers(3, 12, len(first[::3])), first[1::3] + 75])
    times = [first, np.sort(second)]
    for t, s in zip(times, units, strict=True):
        for at in t:
            x[:, at - matching.BEFORE : at + matching.AFTER] += s
    return x, times


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x.T)], f"{ROW} long, " + ", ".join(f"ch{c} double" for c in range(len(x)))).repartition(4)


def test_overlapping_units_are_told_apart(spark):
    units = [shape(5, 1, 1.5, 0.3, 14), shape(5, 3, 3.0, 0.6, 12)]
    x, times = planted(1, 24_000, 5, units)
    df = frame(spark, x)
    truth = spark.createDataFrame([(f"t{u}", int(t)) for u, ts in enumerate(times) for t in ts], "unit_id string, sample_index long")
    for block in (30_000, 5_000):
        got = matching.sort_templates(df, block=block).persist()
        best = {r.unit1: r.agreement for r in sorting.best_matches(sorting.compare(truth, got, 30_000.0)).collect()}
        assert set(best) == {"t0", "t1"}
        assert min(best.values()) >= 0.9
        assert got.select("unit_id").distinct().count() == 2
        got.unpersist()
    assert sorting.sort_spikes(df, "template").count() > 0


def test_units_of_one_channel_are_told_apart(spark):
    units = [shape(3, 1, 1.2, 0.0, 18), shape(3, 1, 4.0, 0.8, 14)]
    x, times = planted(2, 20_000, 3, units)
    truth = spark.createDataFrame([(f"t{u}", int(t)) for u, ts in enumerate(times) for t in ts], "unit_id string, sample_index long")
    best = sorting.best_matches(sorting.compare(truth, matching.sort_templates(frame(spark, x)), 30_000.0)).collect()
    assert {r.unit1 for r in best} == {"t0", "t1"}
    assert min(r.agreement for r in best) >= 0.85


def test_quiet_recordings_have_no_units(spark):
    x = np.random.default_rng(3).normal(size=(3, 3000))
    assert matching.sort_templates(frame(spark, x), threshold=6.0).count() == 0
    assert matching.sort_templates(frame(spark, np.zeros((2, 50)))).count() == 0
    assert matching.matched(np.zeros((1, 5)), np.ones((1, 1, 32)), 5) == []


def test_a_planted_drift_is_recovered_and_taken_back(spark):
    rng = np.random.default_rng(5)
    channels, n, rate = 12, 24_000, 1000.0
    true = 1.5 * np.sin(np.arange(n) / n * 2 * np.pi)
    still, moved = rng.normal(size=(channels, n)) * 0.3, None
    moved = still.copy()
    for centre in (2.0, 4.3, 6.1, 8.7):
        for at in rng.integers(50, n - 50, 500):
            span = slice(at - matching.BEFORE, at + matching.AFTER)
            still[:, span] += shape(channels, centre, 1.5, 0.2, 10)
            moved[:, span] += shape(channels, centre + true[at], 1.5, 0.2, 10)
    df = frame(spark, moved)
    got, width = motion.drift(df, rate)
    assert width == 1000
    want = true[500::1000]
    assert np.abs((got - got.mean()) - (want - want.mean())).max() < 0.5
    back = np.array([r[1:] for r in sorting.preprocess(df, "correct_motion", rate).orderBy(ROW).collect()]).T
    assert back.shape == moved.shape
    inner = slice(3, 9)
    assert ((back - still)[inner] ** 2).mean() < 0.5 * ((moved - still)[inner] ** 2).mean()


def test_positions_from_pairs():
    p = np.array([0.0, 1.0, -2.0, 3.0])
    a, b = np.array([0, 0, 1, 2, 1]), np.array([1, 2, 3, 3, 2])
    got = motion.positions(a, b, p[b] - p[a], np.array([1.0, 2.0, 0.5, 1.0, 1.0]), 4)
    assert got - got[0] == pytest.approx(p, abs=1e-6)


def test_motion_of_still_and_tiny_recordings(spark):
    assert motion.drift(frame(spark, np.zeros((3, 40))), 10.0)[0].tolist() == [0.0] * 4
    one = frame(spark, np.ones((1, 5)))
    assert motion.correct_motion(one, 10.0).count() == 5
