"""Filters in four steps against one transform of the whole channel."""

import numpy as np
import pytest

from dagspark.operators import signal, sorting, spectral
from dagspark.operators.tabular import ROW


def frame(spark, **channels):
    n = len(next(iter(channels.values())))
    rows = [(i, *(None if np.isnan(v[i]) else float(v[i]) for v in channels.values())) for i in range(n)]
    return spark.createDataFrame(rows, f"{ROW} long, " + ", ".join(f"`{c}` double" for c in channels)).repartition(5)


def one_task(x, rate, keep):
    return np.fft.irfft(np.where(keep(np.fft.rfftfreq(len(x), 1 / rate)), np.fft.rfft(np.nan_to_num(x)), 0), len(x))


def values(df, *columns):
    rows = df.orderBy(ROW).collect()
    return [np.array([r[c] for r in rows]) for c in columns]


@pytest.mark.parametrize("n", [1200, 1201, 1009, 2, 3, 17])
@pytest.mark.parametrize("unit", [16, 64, 5000])
def test_filters_equal_one_transform(spark, n, unit):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), np.cumsum(rng.normal(size=n))
    y[n // 2] = np.nan
    df = frame(spark, a=x, b=y)
    for low, high, notch in ((8, 30, None), (0, 125, 50.0)):
        f = spectral.filtered(df, lambda n, cols, low=low, high=high, notch=notch: [spectral.band(n, 250.0, low, high, notch)] * 2, unit)
        keep = lambda f, low=low, high=high, notch=notch: (f >= low) & (f <= high) & (True if notch is None else np.abs(f - notch) > 1)
        for got, want in zip(values(f, "a", "b"), (x, y), strict=True):
            assert got == pytest.approx(one_task(want, 250.0, keep), abs=1e-9)


@pytest.mark.parametrize("n", [900, 907])
def test_delays_equal_one_transform(spark, n):
    x = np.random.default_rng(1).normal(size=n)
    shifts = [0.0, 0.37, -2.0]
    df = frame(spark, a=x, b=x, c=x)
    got = values(spectral.filtered(df, lambda n, cols: [spectral.Filter(((0, n // 2),), s) for s in shifts], 32), "a", "b", "c")
    for g, s in zip(got, shifts, strict=True):
        assert g == pytest.approx(np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * np.fft.rfftfreq(n) * s), n), abs=1e-9)
    assert values(sorting.phase_shift(df, None), "b")[0] == pytest.approx(np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * np.fft.rfftfreq(n) / 3), n), abs=1e-9)


def test_bins_are_those_of_the_frequencies():
    for n in (2, 7, 250, 1000, 997):
        f = np.fft.rfftfreq(n, 1 / 250.0)
        for low, high, notch in ((0.0, 300.0, None), (1.0, 40.0, None), (10.0, 60.0, 50.0), (0.0, 125.0, 0.5), (124.0, 125.0, 124.5)):
            keep = (f >= low) & (f <= high) & (True if notch is None else np.abs(f - notch) > 1)
            got = spectral.band(n, 250.0, low, high, notch).factors(np.arange(n // 2 + 1), n)
            assert (got > 0).tolist() == keep.tolist()


def test_no_task_holds_a_channel():
    for n in (1 << 20, 1_000_003, 999_983, 600_572):
        m, r, c = spectral.sides(n)
        assert r * c == m >= n
        assert m == n or m >= 2 * n - 1
        assert max(r, c) < 64 * np.sqrt(n)


def test_gaps_in_row_numbers(spark):
    x = np.random.default_rng(2).normal(size=400)
    df = frame(spark, a=x)
    odd = df.where(f"{ROW} % 2 = 1")
    got = signal.bandpass(odd, 250, 5, 50)
    assert values(got, "a")[0] == pytest.approx(one_task(x[1::2], 250.0, lambda f: (f >= 5) & (f <= 50)), abs=1e-9)


@pytest.mark.parametrize(("n", "size", "unit"), [(1000, 64, 100), (1000, 64, 1 << 18), (130, 129, 8), (50, 7, 1)])
def test_power_of_blocks_equals_power_of_segments(spark, n, size, unit):
    x = np.random.default_rng(3).normal(size=n)
    hop = size // 2
    w = np.hanning(size)
    p = np.mean([np.abs(np.fft.rfft(x[a : a + size] * w)) ** 2 for a in range(0, n - size + 1, hop)], axis=0) / 3.0
    p[1:-1] *= 2
    got = {r.bin: r.power for r in spectral.segment_power(frame(spark, a=x), size, hop, w, 3.0, unit).collect()}
    assert [got[i] for i in range(len(p))] == pytest.approx(p.tolist(), rel=1e-9)


def test_one_channel_is_not_grouped_again(spark):
    from pyspark.sql import functions as F

    from dagspark.operators.spectral import Filter, filtered

    df = spark.range(0, 300, 1, 3).select(F.col("id").alias("_row_id"), F.sin(F.col("id") * 0.3).alias("v"))
    got = filtered(df, lambda n, cols: [Filter(((0, n // 2),))] * len(cols), 50)
    assert "PivotFirst" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert max(abs(r.v - w) for r, w in zip(sorted(got.collect()), [r.v for r in sorted(df.collect())], strict=True)) < 1e-9
