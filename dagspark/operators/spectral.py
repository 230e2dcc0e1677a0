"""Transforms of whole channels, however long, in pieces: a Fourier transform in four steps.

The n samples of a channel are seen as a matrix of R times C numbers, sample
j1 + R * j2 in row j1 and column j2. The transform of each row, a factor for
each element, and the transform of each column give the spectrum: bin
C * k1 + k2 stands in column k2. Rows and columns go to tasks in strips, and a
shuffle of square pieces turns one into the other. Every task holds some UNIT
numbers at once, or one row or column where that is more (about the square
root of the samples).

A filter is a factor for each bin, so columns are transformed, multiplied and
transformed back where they are, and a second shuffle of pieces brings the rows
back. Where n has no two factors of about the same size (a prime, say), the
filter is the circular convolution with its impulse response, which is known in
closed form; that is done with the next power of two that holds it without
wrapping around. Channels of at most UNIT samples are filtered by one transform.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tabular import ROW, as_numeric, long_form, numeric, wide_form, with_row_id

#: samples that a task holds at once
UNIT = 1 << 18
#: by how much a side of the matrix may exceed the square root
LOPSIDED = 8


@dataclass(frozen=True)
class Filter:
    """What becomes of a spectrum: bins within the closed intervals stay, the signal is delayed by `shift` samples."""

    kept: tuple[tuple[int, int], ...]
    shift: float = 0.0

    def factors(self, k: np.ndarray, n: int) -> np.ndarray:
        """The factor of each bin k of n; bins above the middle mirror those below."""
        low = np.minimum(k, n - k)
        stays = np.zeros(len(k), bool)
        for a, b in self.kept:
            stays |= (low >= a) & (low <= b)
        if not self.shift:
            return stays.astype(float)
        turn = np.exp(-2j * np.pi * np.where(k == low, 1, -1) * low / n * self.shift)
        return np.where(stays, np.where(2 * k == n, turn.real, turn), 0)

    def response(self, j: np.ndarray, n: int) -> np.ndarray:
        """The impulse response at samples j: sums of cosines of consecutive bins in closed form."""
        out = np.zeros(len(j))
        for a, b in self.kept:
            b, middle = min(b, (n - 1) // 2), b * 2 == n
            if a == 0:
                out += 1
            a = max(a, 1)
            if b >= a:
                # whole turns are taken off before anything is rounded
                x = j % n - self.shift if self.shift else j % n
                with np.errstate(divide="ignore", invalid="ignore"):
                    terms = np.sin(_turns(x * (b - a + 1), 2 * n)) / np.sin(_turns(x, 2 * n)) * np.cos(_turns(x * (a + b), 2 * n))
                out += 2 * np.where(np.fmod(x, n) == 0, b - a + 1, terms)
            if middle:
                out += np.cos(np.pi * self.shift) * np.where(j % 2, -1.0, 1.0)
        return out / n


def _turns(x: np.ndarray, per: int) -> np.ndarray:
    """x / per turns as an angle, without what is whole."""
    return np.fmod(x, per) * (2 * np.pi / per)


def bins(n: int, rate: float, holds: Callable[[float], bool], start: int = 0) -> int:
    """The first bin from start on whose frequency holds; holds is false, then true. n // 2 + 1 if there is none."""
    step = 1.0 / (n * (1 / rate))
    low, high = start, n // 2 + 1
    while low < high:
        k = (low + high) // 2
        low, high = (low, k) if holds(k * step) else (k + 1, high)
    return low


def band(n: int, rate: float, low: float = 0.0, high: float = math.inf, without: float | None = None, half: float = 1.0) -> Filter:
    """Keeps the frequencies from low to high, but for those within half of `without`."""
    a, b = bins(n, rate, lambda f: f >= low), bins(n, rate, lambda f: f > high) - 1
    if without is None:
        return Filter(((a, b),) if a <= b else ())
    c = bins(n, rate, lambda f: f >= without or without - f <= half)
    d = bins(n, rate, lambda f: f > without and f - without > half)
    return Filter(tuple((x, y) for x, y in ((a, min(b, c - 1)), (max(a, d), b)) if x <= y))


def sides(n: int) -> tuple[int, int, int]:
    """(samples, R, C): n itself where it has two factors of similar size, else a power of two that holds a convolution."""
    root = math.isqrt(n)
    for r in range(root, max(root // LOPSIDED, 1), -1):
        if n % r == 0:
            return n, r, n // r
    m = 1 << (2 * n - 2).bit_length()
    r = 1 << (m.bit_length() - 1) // 2
    return m, r, m // r


def _table(channel: int, **columns: list | np.ndarray) -> pa.Table:
    arrays = {k: pa.array(v, pa.binary()) if k == "data" else pa.array(np.asarray(v)) for k, v in columns.items()}
    n = len(next(iter(arrays.values())))
    return pa.table({"channel": pa.array(np.full(n, channel, np.int32)), **arrays})


_PIECES = "channel int, to long, of long, kernel boolean, data binary"


class _FourSteps:
    """The steps for channels of n samples as matrices of R times C; strips hold `rows` rows or `cols` columns."""

    def __init__(self, n: int, filters: list[Filter], unit: int) -> None:
        self.n, self.filters = n, filters
        self.m, self.r, self.c = sides(n)
        self.rows, self.cols = max(unit // self.c, 1), max(unit // self.r, 1)

    def _strips(self, matrix: np.ndarray, width: int) -> list[bytes]:
        """A strip's square pieces, in the order of the strips that they go to."""
        return [np.ascontiguousarray(matrix[:, at : at + width]).tobytes() for at in range(0, matrix.shape[1], width)]

    def _turned(self, rows: np.ndarray, cols: np.ndarray, sign: int) -> np.ndarray:
        """The factors between the two transforms, whole turns taken off."""
        return np.exp(sign * 2j * np.pi / self.m * ((rows[:, None] * cols[None, :]) % self.m))

    def _across(self, channel: int, strip: int, matrix: np.ndarray, kernel: bool) -> pa.Table:
        """A strip of rows transformed, as pieces of columns."""
        first = strip * self.rows
        spectrum = np.fft.fft(matrix, axis=1) * self._turned(np.arange(first, first + len(matrix)), np.arange(self.c), -1)
        pieces = self._strips(spectrum, self.cols)
        return _table(channel, to=np.arange(len(pieces)), of=np.full(len(pieces), strip), kernel=np.full(len(pieces), kernel), data=pieces)

    def height(self, strip: int) -> int:
        return min(self.rows, self.r - strip * self.rows)

    def samples(self, key: tuple, table: pa.Table) -> pa.Table:
        """Of a strip's samples the pieces of its transform."""
        channel, strip = (x.as_py() for x in key)
        j = table["idx"].to_numpy()
        matrix = np.zeros((self.height(strip), self.c))
        matrix[j % self.r - strip * self.rows, j // self.r] = np.nan_to_num(table["v"].to_numpy(), nan=0.0)
        return self._across(channel, strip, matrix, False)

    def responses(self, batches):  # noqa: ANN001, ANN201
        """The same of the filters' impulse responses, of rows(channel, strip)."""
        for batch in batches:
            for channel, strip in zip(batch["channel"].to_pylist(), batch["strip"].to_pylist(), strict=True):
                j = strip * self.rows + np.arange(self.height(strip))[:, None] + self.r * np.arange(self.c)[None, :]
                # negative delays stand at the end
                delay = np.where(j < self.n, j, np.where(self.m - j < self.n, self.n - (self.m - j), -1))
                h = np.where(delay >= 0, self.filters[channel].response(np.maximum(delay, 0).ravel(), self.n).reshape(j.shape), 0)
                yield from self._across(channel, strip, h, True).to_batches()

    def _columns(self, pieces: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([np.frombuffer(d, complex).reshape(self.height(of), -1) for of, d in sorted(pieces)])

    def filtered(self, key: tuple, table: pa.Table) -> pa.Table:
        """Of a strip of columns: its bins multiplied, and pieces of rows of the way back."""
        channel, strip = (x.as_py() for x in key)
        sides_: dict[bool, list[tuple[int, bytes]]] = {False: [], True: []}
        for of, kernel, data in zip(*(table[c].to_pylist() for c in ("of", "kernel", "data")), strict=True):
            sides_[kernel].append((of, data))
        spectrum = np.fft.fft(self._columns(sides_[False]), axis=0)
        k2 = strip * self.cols + np.arange(spectrum.shape[1])
        if sides_[True]:
            spectrum *= np.fft.fft(self._columns(sides_[True]), axis=0)
        else:
            k = self.c * np.arange(self.r)[:, None] + k2[None, :]
            spectrum *= self.filters[channel].factors(k.ravel(), self.n).reshape(k.shape)
        back = np.fft.ifft(spectrum, axis=0) * self._turned(np.arange(self.r), k2, 1)
        pieces = [np.ascontiguousarray(back[at : at + self.rows]).tobytes() for at in range(0, self.r, self.rows)]
        return _table(channel, to=np.arange(len(pieces)), of=np.full(len(pieces), strip), kernel=np.zeros(len(pieces), bool), data=pieces)

    def samples_again(self, key: tuple, table: pa.Table) -> pa.Table:
        channel, strip = (x.as_py() for x in key)
        height = self.height(strip)
        pieces = sorted(zip(table["of"].to_pylist(), table["data"].to_pylist(), strict=True))
        matrix = np.concatenate([np.frombuffer(d, complex).reshape(height, -1) for _, d in pieces], axis=1)
        v = np.fft.ifft(matrix, axis=1).real
        j = strip * self.rows + np.arange(height)[:, None] + self.r * np.arange(self.c)[None, :]
        real = j < self.n
        return _table(channel, idx=j[real], v=v[real])


def _whole(n: int, filters: list[Filter]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        channel, j = key[0].as_py(), table["idx"].to_numpy()
        x = np.zeros(n)
        x[j] = np.nan_to_num(table["v"].to_numpy(), nan=0.0)
        k = np.arange(n // 2 + 1)
        return _table(channel, idx=np.arange(n), v=np.fft.irfft(np.fft.rfft(x) * filters[channel].factors(k, n), n))

    return run


def dense(df: DataFrame) -> tuple[DataFrame, int]:
    """df with row numbers from 0 without gaps, in the order of those it has; and how many there are."""
    df = with_row_id(df)
    n, last = df.agg(F.count("*"), F.max(ROW)).first()
    if n and last != n - 1:
        df = with_row_id(df.withColumnRenamed(ROW, "_old").orderBy("_old")).drop("_old")
    return df, n


def filtered(df: DataFrame, filters: Callable[[int, list[str]], list[Filter]], unit: int = UNIT) -> DataFrame:
    """The numeric columns of df, each a channel, through its filter; filters gets the number of samples and the channels. Nulls count as 0."""
    df, n = dense(as_numeric(df))
    cols = numeric(df)
    if n < 2:
        return df.select(ROW, *cols)
    chosen = filters(n, cols)
    rows = long_form(df, cols).select(F.col("position").alias("channel"), "idx", F.coalesce("v", F.lit(0.0)).alias("v"))
    flat = "channel int, idx long, v double"
    if n <= unit:
        done = rows.groupBy("channel").applyInArrow(_whole(n, chosen), flat)
    else:
        steps = _FourSteps(n, chosen, unit)
        strip = F.floor(F.col("idx") % steps.r / steps.rows).cast("long")
        pieces = rows.groupBy("channel", strip.alias("strip")).applyInArrow(lambda k, t: steps.samples(k, t), _PIECES)
        if steps.m != n:
            every = df.sparkSession.range(-(-steps.r // steps.rows)).select(F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("channel"), F.col("id").alias("strip"))
            pieces = pieces.unionByName(every.repartition("channel", "strip").mapInArrow(lambda x: steps.responses(x), _PIECES))
        back = pieces.groupBy("channel", "to").applyInArrow(lambda k, t: steps.filtered(k, t), _PIECES)
        done = back.groupBy("channel", "to").applyInArrow(lambda k, t: steps.samples_again(k, t), flat)
    if len(cols) == 1:  # nothing to put side by side, so no table of all rows is grouped
        return done.select(F.col("idx").alias(ROW), F.col("v").alias(cols[0]))
    names = F.array(*(F.lit(c) for c in cols))
    return wide_form(done.select(F.get(names, F.col("channel")).alias("channel"), "idx", "v"), cols)


def segment_power(df: DataFrame, size: int, hop: int, window: np.ndarray, scale: float, unit: int = UNIT) -> DataFrame:
    """(channel, bin, power): the mean power of the windowed segments of each channel of df, whose row numbers are dense.

    A task transforms a block of many segments at once, so only the samples at
    the blocks' edges are sent twice; sums of each block are added up.
    """
    cols = numeric(df)
    n = df.count()
    segments = (n - size) // hop + 1
    per = max(unit // hop, 1)
    last = (segments - 1) // per
    # block b holds the segments from b * per on, so the samples from b * per * hop to the end of its last segment
    first_of = F.greatest(F.lit(0), F.ceil((F.col("idx") - ((per - 1) * hop + size - 1)) / (per * hop))).cast("long")
    last_of = F.least(F.lit(last), F.floor(F.col("idx") / (per * hop))).cast("long")
    rows = long_form(df, cols).select(F.col("position").alias("channel"), "idx", F.coalesce("v", F.lit(0.0)).alias("v"))
    parts = rows.where(first_of <= last_of).select("channel", F.explode(F.sequence(first_of, last_of)).alias("block"), "idx", "v")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        channel, block = (x.as_py() for x in key)
        start = block * per * hop
        count = min(per, segments - block * per)
        x = np.zeros((count - 1) * hop + size)
        j = table["idx"].to_numpy() - start
        inside = j < len(x)
        x[j[inside]] = table["v"].to_numpy()[inside]
        total = np.zeros(size // 2 + 1)
        pieces = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        step = max(unit // size, 1)
        for at in range(0, count, step):
            total += (np.abs(np.fft.rfft(pieces[at : at + step] * window, axis=1)) ** 2).sum(0) / scale
        if len(total) > 2:
            total[1:-1] *= 2
        return _table(channel, bin=np.arange(len(total)), total=total)

    sums = parts.groupBy("channel", "block").applyInArrow(run, "channel int, bin long, total double")
    names = F.array(*(F.lit(c) for c in cols))
    return sums.groupBy("channel", "bin").agg((F.sum("total") / F.lit(float(segments))).alias("power")).select(F.get(names, F.col("channel")).alias("channel"), "bin", "power")
