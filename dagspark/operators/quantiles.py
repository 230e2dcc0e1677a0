"""Exact quantiles by selection on the bits of doubles, in a few passes with bounded state.

A double's 64 bits become a key of the same order, in Arrow batches. The first
pass counts the keys by their upper 16 bits; the prefix that holds a wanted
rank is refined by the next 16 bits, and so on. A pass has 2^16 counters at
most for each wanted rank, however many distinct values there are; tasks count
what they read before it is shuffled, and only chosen counters reach the
driver. Once few keys are left below the wanted prefixes, they are fetched and
sorted.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import checkpointed

#: bits that a pass resolves
DIGIT = 16
#: keys that are fetched rather than counted once more
FETCHED = 1 << 16
#: counters that a task holds before it hands them on
HELD = 1 << 18
_LOW = (1 << DIGIT) - 1


def order_key(x: Column) -> Column:
    """A bigint in the order of the doubles x, equal for 0.0 and -0.0: sign, exponent and fraction put together.

    The logarithm may be off by one next to a power of two; comparing with the
    power mends that. Powers of two and quotients by them are exact.
    """
    size = F.abs(x)
    about = F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(-1022))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = about + F.when(size < power(about), -1).when(size / 2 >= power(about), 1).otherwise(0)
    fraction = ((size / power(exponent) - 1) * 2.0**52).cast("bigint")
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction
    small = (size * 2.0**537 * 2.0**537).cast("bigint")
    key = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.0**-1022, small).otherwise(normal)
    return F.when(x < 0, -key).otherwise(key)


def of_key(key: int) -> float:
    """The double of an order key."""
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


def _between(position: float, low: float, high: float) -> float:
    """Linear interpolation at a position between two ranks."""
    below, above = math.floor(position), math.ceil(position)
    return low if below == above or low == high else (above - position) * low + (position - below) * high


#: of an Arrow batch the groups' names, the place of each value's name (None: all are the first) and the values
Cells = Iterable[tuple[pa.Array, np.ndarray | None, np.ndarray]]


def _of_columns(batch: pa.RecordBatch) -> Cells:
    """Each column is a group, named by its place."""
    for i in range(batch.num_columns):
        yield pa.array([i], pa.int32()), None, batch.column(i).to_numpy(zero_copy_only=False)


def _of_rows(batch: pa.RecordBatch) -> Cells:
    """The rows (g, v)."""
    names = batch.column(0).dictionary_encode()
    yield names.dictionary, names.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def bit_keys(x: np.ndarray) -> np.ndarray:
    """order_key of each double, with 2^63 added: unsigned, in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)  # -0.0 becomes 0.0
    keys = np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits)
    return keys.view(np.uint64) ^ np.uint64(1 << 63)


def _keys(batches: Iterator[pa.RecordBatch], cells: Callable[[pa.RecordBatch], Cells]) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    """(group, its keys) of each batch; null and NaN have none."""
    for batch in batches:
        for names, at, x in cells(batch):
            there = ~np.isnan(x)
            keys = bit_keys(x[there])
            for i, name in enumerate(names):
                mine = keys if at is None else keys[at[there] == i]
                if len(mine):
                    yield name, mine


def _below(keys: np.ndarray, shift: int, prefixes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each prefix the keys below it, whose bits from shift + DIGIT on it is."""
    if shift + DIGIT == 64:
        yield 0, keys
        return
    upper = keys >> np.uint64(shift + DIGIT)
    for p in prefixes:
        yield p, keys[upper == np.uint64(p)]


def _digits(batches: Iterator[pa.RecordBatch], cells: Callable[[pa.RecordBatch], Cells], shift: int, wanted: dict[object, list[int]] | None) -> Iterator[pa.RecordBatch]:
    """(g, prefix, digit, n): how many keys go on with each digit below the wanted prefixes of their group (without any, of all groups)."""
    parts: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def merged() -> Iterator[pa.RecordBatch]:
        for (g, p), counted in parts.items():
            digit, at = np.unique(np.concatenate([d for d, _ in counted]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in counted])).astype(np.int64)
            arrays = [pa.repeat(g, len(digit)), pa.array(np.full(len(digit), p, np.int64)), pa.array(digit.astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["g", "prefix", "digit", "n"])
        parts.clear()

    for g, keys in _keys(batches, cells):
        for p, some in _below(keys, shift, [0] if wanted is None else wanted.get(g.as_py(), [])):
            if not len(some):
                continue
            counted = np.unique((some >> np.uint64(shift)) & np.uint64(_LOW), return_counts=True)
            parts.setdefault((g, p), []).append(counted)
            held += len(counted[0])
        if held > HELD:
            yield from merged()
            held = 0
    yield from merged()


def _fetched(batches: Iterator[pa.RecordBatch], cells: Callable[[pa.RecordBatch], Cells], shift: int, wanted: dict[object, list[int]]) -> Iterator[pa.RecordBatch]:
    """(g, prefix, key), less 2^63, of the keys below the wanted prefixes."""
    for g, keys in _keys(batches, cells):
        for p, some in _below(keys, shift - DIGIT, wanted.get(g.as_py(), [])):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.repeat(g, len(some)), pa.array(np.full(len(some), p, np.int64)), pa.array((some ^ np.uint64(1 << 63)).view(np.int64))], names=["g", "prefix", "key"])


def _selected(values: DataFrame, cells: Callable[[pa.RecordBatch], Cells], kind: str, ranks: Callable[[int], set[int]]) -> tuple[dict[object, int], dict[tuple[object, int], int]]:
    """The number of values of each group, and the key of each of its ranks (from 0), which ranks() gives for that number; groups are few."""
    spark = values.sparkSession
    # group, rank -> the prefix that holds it, and the rank among its keys
    open_: dict[tuple[object, int], tuple[int, int]] = {}
    sizes: dict[object, int] = {}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift + DIGIT == 64
        wanted = None if first else _prefixes(open_)
        counted = values.mapInArrow(lambda x, s=shift, w=wanted: _digits(x, cells, s, w), f"g {kind}, prefix bigint, digit bigint, n bigint")
        counted = checkpointed(counted.groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n")))
        if first:
            sizes = {r["g"]: r["n"] for r in counted.groupBy("g").agg(F.sum("n").alias("n")).collect()}
            open_ = {(g, r): (0, r) for g, n in sizes.items() for r in ranks(n)}
            if not open_:
                return sizes, {}
        upto = F.sum("n").over(Window.partitionBy("g", "prefix").orderBy("digit"))
        asked = F.broadcast(spark.createDataFrame([(g, p, r, w) for (g, w), (p, r) in open_.items()], f"g {kind}, prefix bigint, rank bigint, wanted bigint"))
        holding = counted.withColumn("upto", upto).join(asked, ["g", "prefix"]).where("rank < upto and rank >= upto - n")
        left = holding.select("g", "wanted", F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("next") if shift else F.col("digit").alias("next"), "prefix", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n").collect()
        if not shift:
            return sizes, {(r["g"], r["wanted"]): ((r["prefix"] << DIGIT) | r["next"]) - (1 << 63) for r in left}
        open_ = {(r["g"], r["wanted"]): (r["next"], r["rank"]) for r in left}
        if sum({(r["g"], r["next"]): r["n"] for r in left}.values()) <= FETCHED:
            wanted = _prefixes(open_)
            held: dict[tuple, list[int]] = {}
            for r in values.mapInArrow(lambda x, s=shift, w=wanted: _fetched(x, cells, s, w), f"g {kind}, prefix bigint, key bigint").collect():
                held.setdefault((r["g"], r["prefix"]), []).append(r["key"])
            held = {k: sorted(v) for k, v in held.items()}
            return sizes, {(g, w): held[g, p][r] for (g, w), (p, r) in open_.items()}
    raise AssertionError("all bits are resolved")


def _prefixes(open_: dict[tuple[object, int], tuple[int, int]]) -> dict[object, list[int]]:
    out: dict[object, set[int]] = {}
    for (g, _), (p, _) in open_.items():
        out.setdefault(g, set()).add(p)
    return {g: sorted(ps) for g, ps in out.items()}


def _quantiles(values: DataFrame, cells: Callable[[pa.RecordBatch], Cells], kind: str, fractions: Sequence[float]) -> dict[object, list[float]]:
    places = lambda n: [(n - 1) * f for f in fractions]
    sizes, key = _selected(values, cells, kind, lambda n: {r for x in places(n) for r in (math.floor(x), math.ceil(x))})
    return {g: [_between(x, of_key(key[g, math.floor(x)]), of_key(key[g, math.ceil(x)])) for x in places(n)] for g, n in sizes.items()}


def quantiles(values: DataFrame, fractions: Sequence[float]) -> dict[object, list[float]]:
    """For each group of values(g, v) its quantiles, interpolated between ranks; nulls and NaN don't count. Groups without values are left out."""
    rows = values.where(F.col("g").isNotNull()).select("g", F.col("v").cast("double").alias("v"))
    return _quantiles(rows, _of_rows, values.schema["g"].dataType.simpleString(), fractions)


def column_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """The quantiles of each numeric column; null where a column has no value."""
    if not columns:
        return {}
    found = _quantiles(df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns))), _of_columns, "int", fractions)
    return {c: found.get(i, [None] * len(fractions)) for i, c in enumerate(columns)}
