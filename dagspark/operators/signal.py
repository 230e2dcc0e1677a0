"""Recordings: filters, power spectra, epochs, montage, ICA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectral import band, dense, filtered, segment_power
from .tabular import ROW, as_numeric, clean, long_form, numeric, with_row_id

# Electrode positions of the 10-20 system on the unit sphere, as (azimuth, elevation) in degrees.
STANDARD_1020 = {
    "Fp1": (108, 0), "Fp2": (72, 0), "F7": (144, 0), "F3": (129, 30), "Fz": (90, 45), "F4": (51, 30), "F8": (36, 0), "T3": (180, 0), "C3": (180, 45), "Cz": (0, 90),
    "C4": (0, 45), "T4": (0, 0), "T5": (216, 0), "P3": (231, 30), "Pz": (270, 45), "P4": (309, 30), "T6": (324, 0), "O1": (252, 0), "O2": (288, 0),
}


# Names of montages that a recording may be given.
MONTAGES = (
    "standard_1005", "standard_1020", "standard_alphabetic", "standard_postfixed", "standard_prefixed", "standard_primed", "biosemi16", "biosemi32", "biosemi64", "biosemi128", "biosemi160", "biosemi256",
    "easycap-M1", "easycap-M10", "easycap-M43", "EGI_256", "GSN-HydroCel-32", "GSN-HydroCel-64_1.0", "GSN-HydroCel-65_1.0", "GSN-HydroCel-128", "GSN-HydroCel-129", "GSN-HydroCel-256", "GSN-HydroCel-257",
    "mgh60", "mgh70", "artinis-octamon", "artinis-brite23", "brainproducts-RNP-BA-128",
)


def known_montage(name: str) -> str:
    if name not in MONTAGES:
        raise ValueError(f"there is no montage {name!r}")
    return name


def bandpass(df: DataFrame, rate: float = 250.0, low: float = 1.0, high: float = 40.0, notch: float = 0.0) -> DataFrame:
    """Frequencies from low to high stay; with notch > 0, those within 1 Hz of it go. Channels of one sample stay as they are."""
    if rate <= 0 or not 0 <= low < high:
        raise ValueError("need 0 <= low < high and a positive rate")
    return filtered(df, lambda n, cols: [band(n, rate, low, min(high, rate / 2), notch if notch > 0 else None)] * len(cols))


def welch(df: DataFrame, rate: float = 250.0, nperseg: int = 256) -> DataFrame:
    """frequency and the mean power of the half-overlapping Hann segments of each channel.

    All but the first and the last frequency are doubled.
    """
    df, n = dense(as_numeric(df))
    if n < 2 or rate <= 0:
        raise ValueError("need two samples and a positive rate")
    size = min(max(int(nperseg), 2), n)
    window = np.hanning(size)
    power = segment_power(df, size, max(size // 2, 1), window, rate * (window**2).sum())
    frequency = F.array(*(F.lit(float(f)) for f in np.fft.rfftfreq(size, 1 / rate)))
    return power.select("channel", F.get(frequency, F.col("bin").cast("int")).alias("frequency"), "power").groupBy("frequency").pivot("channel", numeric(df)).agg(F.first("power"))


def erp(df: DataFrame, rate: float = 250.0, tmin: float = -0.2, tmax: float = 0.5, event_column: str = "") -> DataFrame:
    """time and each channel's mean over the epochs around the events, each epoch less its mean before the event.

    A 0/1 event column marks the rows of events, any other holds their row
    numbers; without any event the middle row is one. Epochs that reach beyond
    the recording are left out.
    """
    df = clean(with_row_id(as_numeric(df)))
    cols = numeric(df)
    n = df.count()
    before, after = int(round(tmin * rate)), int(round(tmax * rate))
    if event_column and event_column in df.columns:
        e = F.col(event_column)
        stim = df.agg(F.coalesce(F.max(F.when(~e.isin(0, 1), 1)), F.lit(0))).first()[0] == 0
        events = df.where(e == 1).select(F.col(ROW).alias("at")) if stim else df.where((e >= 0) & (e < n)).select(e.cast("long").alias("at")).distinct()
    else:
        events = df.where("false").select(F.col(ROW).alias("at"))
    if not events.limit(1).count():
        events = df.sparkSession.range(1).select(F.lit(n // 2).cast("long").alias("at"))
    events = events.where((F.col("at") + before >= 0) & (F.col("at") + after < n))
    wanted = events.select("at", F.explode(F.sequence(F.lit(before), F.lit(after))).alias("offset")).withColumn("idx", F.col("at") + F.col("offset"))
    cells = wanted.join(long_form(df, cols), "idx")
    base = cells.where("offset <= 0").groupBy("at", "channel").agg(F.avg("v").alias("base"))
    mean = cells.join(base, ["at", "channel"]).groupBy("offset").pivot("channel", cols).agg(F.avg(F.col("v") - F.col("base")))
    return mean.select((F.col("offset") / F.lit(float(rate))).alias("time"), *(F.col(f"`{c}`") for c in cols))


def montage_positions(df: DataFrame) -> DataFrame:
    """(channel, x, y, z) of the channels that the 10-20 system names; values of a recording don't change by a montage."""
    known = {k.lower(): v for k, v in STANDARD_1020.items()}
    rows = []
    for c in numeric(df):
        if c.lower() in known:
            a, e = np.radians(known[c.lower()])
            rows.append((c, float(np.cos(e) * np.cos(a)), float(np.cos(e) * np.sin(a)), float(np.sin(e))))
    return df.sparkSession.createDataFrame(rows, "channel string, x double, y double, z double")


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance (over n) and number of the complete rows; sums of each task meet on the driver, a row a task."""
    d = len(cols)
    mean_row = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).first()
    mean = np.array([mean_row[f"m{i}"] or 0.0 for i in range(d)])
    gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean, strict=True)]
    row = df.agg(*(F.sum(gaps[i] * gaps[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d))).first()
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (row[f"c{i}_{j}"] or 0.0) / max(mean_row["n"], 1)
    return mean, cov, mean_row["n"]


def fast_ica(df: DataFrame, n_components: int = 0, seed: int = 97, rounds: int = 50, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, unmixing, mixing) of the numeric columns: symmetric FastICA with tanh, each round one pass of sums over the rows."""
    cols = numeric(df)
    rows = clean(df).select(*cols).na.drop("any")
    mean, cov, n = moments(rows, cols)
    value, vector = np.linalg.eigh(cov)
    keep = np.argsort(-value)[: n_components if n_components > 0 else len(cols)]
    keep = keep[value[keep] > 1e-12 * max(value.max(), 1e-300)]
    white = (vector[:, keep] / np.sqrt(value[keep])).T
    k = len(keep)
    w = np.linalg.qr(np.random.default_rng(seed).standard_normal((k, k)))[0]
    for _ in range(rounds):
        unmix = w @ white

        def sums(batches: Iterator[pd.DataFrame], unmix: np.ndarray = unmix) -> Iterator[pd.DataFrame]:
            g, d = np.zeros((k, k)), np.zeros(k)
            for pdf in batches:
                z = (pdf.to_numpy(float) - mean) @ white.T
                t = np.tanh(z @ w.T)
                g += t.T @ z
                d += (1 - t**2).sum(0)
            yield pd.DataFrame({"i": np.arange(k * k + k), "s": np.concatenate([g.ravel(), d])})

        total = {r.i: r.s for r in rows.mapInPandas(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        s = np.array([total[i] for i in range(k * k + k)]) / max(n, 1)
        new = s[: k * k].reshape(k, k) - s[k * k :][:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        change = 1 - np.abs((new * w).sum(1)).min()
        w = new
        if change < tolerance:
            break
    unmix = w @ white
    return mean, unmix, np.linalg.pinv(unmix)


def ica(df: DataFrame, n_components: int = 0, exclude: tuple[int, ...] = ()) -> DataFrame:
    """The recording rebuilt from its independent components, less those in exclude."""
    cols = numeric(df)
    if not cols:
        return df
    mean, unmix, mix = fast_ica(df, n_components)
    mask = np.ones(len(unmix))
    mask[list(exclude)] = 0
    back = mix @ (mask[:, None] * unmix)
    gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean, strict=True)]
    new = {c: F.lit(float(mean[i])) + sum((F.lit(float(back[i, j])) * gaps[j] for j in range(len(cols))), F.lit(0.0)) for i, c in enumerate(cols)}
    return clean(df).select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))
