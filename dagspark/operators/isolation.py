"""Principal components of spikes on the channels around their unit, and how isolated units are in them.

A unit has a main channel, on which its spikes are largest at their time; the
LOCAL channels to either side are its own. Waveforms are cut there only, so a
recording of hundreds of channels makes no more rows than one of ten. Components
of a channel come from the second moments of all its waveforms: tasks sum
products, and the sums of a channel meet in one.

Isolation distance uses few components: those of the main channel and the NEAR
ones beside it. The others are the spikes of units whose main channel is no
further away than their own channels allow; no unit is compared with those that share no channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tabular import long_form, numeric

LOCAL, NEAR, COMPONENTS = 3, 1, 3
#: spikes of a unit that its main channel is found from
LOOKED_AT = 50


def main_channels(recording: DataFrame, spikes: DataFrame) -> DataFrame:
    """(unit_id, main): the position of the channel on which a unit's spikes are largest on the average."""
    at = long_form(recording).select("position", "idx", "v")
    some = spikes.groupBy("unit_id").agg(F.slice(F.array_sort(F.collect_list("sample_index")), 1, LOOKED_AT).alias("at")).select("unit_id", F.explode("at").alias("idx"))
    size = some.join(at, "idx").groupBy("unit_id", "position").agg(F.abs(F.avg("v")).alias("size"))
    return size.groupBy("unit_id").agg(F.max_by("position", F.struct(F.coalesce("size", F.lit(0.0)), -F.col("position"))).alias("main"))


def local_waveforms(recording: DataFrame, spikes: DataFrame, main: DataFrame, before: int, after: int) -> DataFrame:
    """(unit_id, sample_index, position, shape): each spike's samples on the unit's own channels; spikes at the recording's ends are left out."""
    own = main.select("unit_id", F.explode(F.sequence(F.col("main") - LOCAL, F.col("main") + LOCAL)).alias("position"))
    wanted = spikes.join(own, "unit_id").select("unit_id", "sample_index", "position", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("offset")).withColumn("idx", F.col("sample_index") + F.col("offset"))
    cut = wanted.join(long_form(recording).select("position", "idx", F.coalesce("v", F.lit(0.0)).alias("v")), ["idx", "position"])
    shapes = cut.groupBy("unit_id", "sample_index", "position").agg(F.array_sort(F.collect_list(F.struct("offset", "v"))).alias("x"))
    return shapes.where(F.size("x") == before + after).select("unit_id", "sample_index", "position", F.col("x.v").alias("shape"))


def _products(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A task's sums of a channel's waveforms and of their products."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        position = batch["position"].to_numpy()
        x = np.array(batch["shape"].flatten().to_numpy()).reshape(len(batch), length)
        for p in np.unique(position):
            one = np.column_stack([np.ones((position == p).sum()), x[position == p]])
            sums[int(p)] = sums.get(int(p), 0) + one.T @ one
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel() for s in sums.values()], pa.list_(pa.float64()))], names=["position", "sums"])


def components(shapes: DataFrame, length: int, count: int = COMPONENTS) -> DataFrame:
    """(position, middle, axes): the mean and the first principal axes (one after another) of each channel's waveforms."""
    k = min(count, length)

    def axes(key: tuple, table: pa.Table) -> pa.Table:
        s = np.sum([np.array(x) for x in table["sums"].to_pylist()], axis=0).reshape(length + 1, length + 1)
        mean = s[0, 1:] / s[0, 0]
        _, vectors = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
        top = vectors[:, ::-1][:, :k].T
        # an axis and its negative are the same; the largest part counts as positive
        top = top * np.where(top[np.arange(k), np.abs(top).argmax(1)] < 0, -1, 1)[:, None]
        return pa.table({"position": pa.array([key[0].as_py()], pa.int32()), "middle": pa.array([mean], pa.list_(pa.float64())), "axes": pa.array([top.ravel()], pa.list_(pa.float64()))})

    partial = shapes.select("position", "shape").mapInArrow(lambda x: _products(x, length), "position int, sums array<double>")
    return partial.groupBy("position").applyInArrow(axes, "position int, middle array<double>, axes array<double>")


def principal_components(recording: DataFrame, spikes: DataFrame, before: int = 20, after: int = 40, count: int = COMPONENTS) -> DataFrame:
    """(unit_id, sample_index, channel, position, main, pc): each spike's first components on its unit's own channels."""
    main, length = main_channels(recording, spikes).persist(), before + after
    shapes = local_waveforms(recording, spikes, main, before, after)
    away = F.zip_with("shape", "middle", lambda a, b: a - b)
    pc = F.array(*(F.aggregate(F.zip_with(away, F.slice("axes", i * length + 1, length), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for i in range(min(count, length))))
    names = F.array(*(F.lit(c) for c in numeric(recording)))
    made = shapes.join(components(shapes, length, count), "position").select("unit_id", "sample_index", F.get(names, F.col("position")).alias("channel"), "position", pc.alias("pc"))
    return made.join(main, "unit_id")


def _distance(key: tuple, table: pa.Table) -> pa.Table:
    """The isolation distance of one unit among the spikes around it."""
    unit = key[0].as_py()
    x, own = np.array(table["x"].to_pylist(), float), table["own"].to_numpy(zero_copy_only=False)
    mine, others, distance = x[own], x[~own], None
    if len(mine) > x.shape[1] and len(others) >= len(mine):
        cov = np.atleast_2d(np.cov(mine.T))
        if np.linalg.matrix_rank(cov) == len(cov):
            away = others - mine.mean(0)
            d2 = np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)
            distance = float(np.partition(d2, len(mine) - 1)[len(mine) - 1])
    return pa.table({"unit_id": pa.array([unit], pa.string()), "isolation_distance": pa.array([distance], pa.float64())})


def isolation_distance(pcs: DataFrame) -> DataFrame:
    """(unit_id, isolation_distance) of principal components: for a unit of n spikes, the n-th smallest squared Mahalanobis distance of the others around from it.

    Null where the unit's spikes span no volume or fewer others are around.
    """
    main = pcs.select("unit_id", "main").distinct()
    reach = LOCAL - NEAR  # so far away, units have components on all channels that are looked at
    pairs = main.select("unit_id", "main", F.explode(F.sequence(F.col("main") - reach, F.col("main") + reach)).alias("at"))
    pairs = pairs.join(main.select(F.col("unit_id").alias("other"), F.col("main").alias("at")), "at")
    looked = pairs.select("unit_id", "other", F.explode(F.sequence(F.col("main") - NEAR, F.col("main") + NEAR)).alias("position"))
    met = looked.join(pcs.select(F.col("unit_id").alias("other"), "sample_index", "position", "pc"), ["other", "position"])
    vectors = met.groupBy("unit_id", "other", "sample_index").agg(F.array_sort(F.collect_list(F.struct("position", "pc"))).alias("parts"))
    rows = vectors.select("unit_id", (F.col("unit_id") == F.col("other")).alias("own"), F.flatten(F.col("parts.pc")).alias("x"))
    widest = F.max(F.size("x"))
    full = rows.join(rows.groupBy("unit_id").agg(widest.alias("width")), "unit_id").where(F.size("x") == F.col("width"))
    return full.select(F.col("unit_id").cast("string").alias("unit_id"), "own", "x").groupBy("unit_id").applyInArrow(_distance, "unit_id string, isolation_distance double")
