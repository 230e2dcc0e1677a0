"""Drift of a probe: estimated from the depths of spikes, taken back by interpolation between channels.

Channels stand in the order of their depth, one unit apart. A peak's depth is the
centre of its amplitudes over the channels around. Peaks are counted by time bin and depth bin;
two time bins no further apart than HORIZON are compared at all shifts, and the
shift at which their counts agree best says how far one has moved against the
other. The positions of all bins follow from all those pairs by least squares.
Every sample is then read where its channel has been, between two channels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import RADIUS, noises, peaks, scaled
from .spectral import dense
from .tabular import ROW, clean, numeric

#: depth bins of a channel, time bins that are compared, the largest shift in channels
DEPTHS, HORIZON, FARTHEST = 10, 40, 5.0
#: time bins that the driver solves for
MOST_BINS = 100_000


def depths(rows: DataFrame, threshold: float) -> DataFrame:
    """(idx, depth, size) of the peaks of rows(position, idx, v): depth in channels, size in noises."""
    found = peaks(rows, threshold)
    around = found.select(F.col("position").alias("own"), "idx", F.col("v").alias("low"), F.explode(F.sequence(F.col("position") - RADIUS, F.col("position") + RADIUS)).alias("position"))
    # channels that show little of the peak would pull the centre to the middle
    met = around.join(rows, ["idx", "position"]).withColumn("weight", F.greatest(-F.col("v") + 0.2 * F.col("low"), F.lit(0.0)))
    centre = F.sum(F.col("weight") * F.col("position")) / F.sum("weight")
    return met.groupBy("own", "idx").agg(centre.alias("depth"), (-F.first("low")).alias("size")).select("idx", "depth", "size")


def pairwise(counts: DataFrame, bins: int) -> DataFrame:
    """(a, b, shift, weight): for each two close time bins, how far b is from a in depth bins; of counts(time, depth, n)."""
    histograms = counts.groupBy("time").agg(F.collect_list(F.struct("depth", "n")).alias("h"))
    cell = F.floor(F.col("time") / HORIZON)
    left = histograms.select(F.col("time").alias("a"), F.col("h").alias("x"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    right = histograms.select(F.col("time").alias("b"), F.col("h").alias("y"), cell.alias("cell"))
    pairs = left.join(right, "cell").where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= HORIZON))
    reach = int(FARTHEST * DEPTHS)
    smooth = np.exp(-0.5 * (np.arange(-DEPTHS, DEPTHS + 1) / (DEPTHS / 4)) ** 2)

    def run(batches):  # noqa: ANN001, ANN202
        def profile(h: list[dict]) -> np.ndarray:
            out = np.zeros(bins)
            for r in h:
                out[r["depth"]] += r["n"]
            out = np.convolve(out, smooth, "same")
            return (out - out.mean()) / (out.std() or 1.0)

        for batch in batches:
            shifts, weights = [], []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                p, q = profile(x), profile(y)
                agree = np.correlate(np.pad(q, reach), p, "valid") / bins
                best = int(agree.argmax())
                fine = 0.0
                if 0 < best < len(agree) - 1:  # the top of a parabola through three values
                    a, b, c = agree[best - 1 : best + 2]
                    fine = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
                shifts.append(best - reach + fine)
                weights.append(max(float(agree[best]), 0.0) ** 2)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(shifts, pa.float64()), pa.array(weights, pa.float64())], names=["a", "b", "shift", "weight"])

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, shift double, weight double")


def positions(a: np.ndarray, b: np.ndarray, shift: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Positions of n bins whose differences fit the weighted shifts best, around 0; conjugate gradients."""

    def times(p: np.ndarray) -> np.ndarray:
        d = weight * (p[b] - p[a])
        return np.bincount(b, d, n) - np.bincount(a, d, n) + 1e-9 * p

    right = np.bincount(b, weight * shift, n) - np.bincount(a, weight * shift, n)
    p, r = np.zeros(n), right.copy()
    d, rr = r.copy(), float(r @ r)
    for _ in range(10 * n + 100):
        if rr < 1e-18 * max(float(right @ right), 1e-300):
            break
        ad = times(d)
        step = rr / float(d @ ad)
        p, r = p + step * d, r - step * ad
        new = float(r @ r)
        d, rr = r + new / rr * d, new
    return p - np.median(p)


def drift(df: DataFrame, rate: float, seconds: float = 1.0, threshold: float = 5.0) -> tuple[np.ndarray, int]:
    """The shift in channels of each time bin of a dense recording, and the samples of a bin; bins without peaks take the last one's."""
    cols, n = numeric(df), df.count()
    width = max(int(rate * seconds), 1)
    count = max(-(-n // width), 1)
    if count > MOST_BINS:
        raise ValueError(f"more than {MOST_BINS} time bins; make them longer")
    found = depths(scaled(df, noises(df)), threshold)
    depth = F.least(F.greatest(F.floor((F.col("depth") + 0.5) * DEPTHS), F.lit(0)), F.lit(len(cols) * DEPTHS - 1)).cast("int")
    counts = found.groupBy(F.floor(F.col("idx") / width).alias("time"), depth.alias("depth")).agg(F.sum("size").alias("n"))
    pairs = pairwise(counts, len(cols) * DEPTHS).collect()  # HORIZON rows at most for each time bin
    out = np.zeros(count)
    if pairs:
        a, b = (np.array([r[k] for r in pairs]) for k in "ab")
        out = positions(a, b, np.array([r["shift"] for r in pairs]), np.array([r["weight"] for r in pairs]), count) / DEPTHS
        known = np.zeros(count, bool)
        known[a] = known[b] = True
        last = np.maximum.accumulate(np.where(known, np.arange(count), 0))
        out = out[last]
    return out, width


def correct_motion(df: DataFrame, rate: float = 30000.0, seconds: float = 1.0, threshold: float = 5.0) -> DataFrame:
    """The recording with every sample read at the depth to which its channel has drifted by then; the outermost channels go on."""
    df, _ = dense(clean(df))
    cols = numeric(df)
    if len(cols) < 2:
        return df
    moved, width = drift(df, rate, seconds, threshold)
    # linear between the middles of time bins
    table = df.sparkSession.createDataFrame([(i, float(s), float(moved[min(i + 1, len(moved) - 1)])) for i, s in enumerate(moved)], "bin long, low double, high double")
    place = F.col(ROW) / F.lit(float(width)) - 0.5
    shift = F.col("low") + (F.col("high") - F.col("low")) * F.greatest(place - F.floor(place), F.lit(0.0)) * F.when(place < 0, 0.0).otherwise(1.0)
    with_shift = df.withColumn("bin", F.greatest(F.floor(place), F.lit(0))).join(F.broadcast(table), "bin").withColumn("shift", shift)
    values, last = F.array(*cols), len(cols) - 1

    def read(i: int) -> F.Column:
        at = F.least(F.greatest(F.lit(float(i)) + F.col("shift"), F.lit(0.0)), F.lit(float(last)))
        low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
        return F.get(values, low) * (1 - (at - low)) + F.get(values, low + 1) * (at - low)

    return with_shift.select(ROW, *(read(i).alias(c) for i, c in enumerate(cols)))
