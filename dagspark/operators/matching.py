"""A template-matching sorter: peaks, shapes of units learned by channel, and greedy subtraction over blocks of time.

Channels stand in the order of their depth. A peak is a sample below -threshold
noises that is the lowest within REFRACTORY samples on its own and the RADIUS
channels to either side. For each channel at most LEARNED peaks (those of the
smallest md5) are cut out, in units of noise, and clustered by their principal
components; the mean shape of a cluster whose trough is in its middle, on the
channel itself, is a template. All samples are then matched: a task has a block
of time on all channels and the samples around it that templates reach into. It
takes the templates that explain most, subtracts them, and looks at what is left
again, so spikes that overlap are told apart. A spike belongs to the block in
which its trough is. Templates are few (a bounded number for each channel) and
go to all tasks.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import column_quantiles
from .spectral import dense
from .tabular import long_form, numeric

BEFORE, AFTER = 12, 20
RADIUS, REFRACTORY = 2, 8
#: peaks of a channel that templates are learned from, and clusters of a channel at most
LEARNED, CLUSTERS = 2_000, 16
#: principal components, the reach of a neighbour in them (in noises, or by how much the usual squared distance of the last neighbour that makes a core is exceeded), the least share and number of a cluster's peaks
COMPONENTS, REACH, WIDER, LEAST_SHARE, LEAST = 4, 1.6, 1.5, 0.02, 12
#: samples of a block, rounds of subtraction, amplitudes of a match relative to its template
BLOCK, ROUNDS, AMPLITUDES = 30_000, 6, (0.6, 1.6)
#: templates that are alike by this much of their energy are one
ALIKE = 0.9


#: the noises of recordings that are in use; the nodes of a chain ask for the same ones
_NOISES: WeakKeyDictionary[DataFrame, dict[str, float]] = WeakKeyDictionary()


def noises(df: DataFrame) -> dict[str, float]:
    """The noise of each channel that has values: median absolute deviation over 0.6745."""
    if df not in _NOISES:
        cols = numeric(df)
        middle = {c: q for c, (q,) in column_quantiles(df, cols, (0.5,)).items() if q is not None}
        away = df.select(*(F.abs(F.col(f"`{c}`").cast("double") - F.lit(m)).alias(c) for c, m in middle.items()))
        _NOISES[df] = {c: q / 0.6745 for c, (q,) in column_quantiles(away, list(middle), (0.5,)).items()}
    return dict(_NOISES[df])


def scaled(df: DataFrame, noise: dict[str, float]) -> DataFrame:
    """(position, idx, v) with v in noises (as it is where there is none), null as 0."""
    table = df.sparkSession.createDataFrame([(c, x or 1.0) for c, x in noise.items()], "channel string, noise double")
    return long_form(df).join(F.broadcast(table), "channel").select("position", "idx", F.coalesce(F.col("v") / F.col("noise"), F.lit(0.0)).alias("v"))


def peaks(rows: DataFrame, threshold: float) -> DataFrame:
    """(position, idx, v): the samples of rows(position, idx, v) below -threshold that are the lowest around."""
    low = rows.where(F.col("v") < -threshold)
    cell = F.floor(F.col("idx") / (REFRACTORY + 1))
    other = low.select(F.col("position").alias("p"), F.col("idx").alias("i"), F.col("v").alias("w"), F.explode(F.sequence(cell - 1, cell + 1)).alias("cell"), F.explode(F.sequence(F.col("position") - RADIUS, F.col("position") + RADIUS)).alias("position"))
    close = F.abs(F.col("low.idx") - F.col("other.i")) <= REFRACTORY
    lower = F.struct("other.w", "other.i", "other.p") < F.struct("low.v", "low.idx", "low.position")
    return low.withColumn("cell", cell).alias("low").join(other.alias("other"), (F.col("low.cell") == F.col("other.cell")) & (F.col("low.position") == F.col("other.position")) & close & lower, "left_anti").drop("cell")


def cutouts(rows: DataFrame, at: DataFrame) -> DataFrame:
    """(position, idx, samples) of the peaks at(position, idx): the samples around, as struct<channel, offset, v>."""
    wanted = at.select(F.col("position").alias("own"), F.col("idx").alias("at"), F.explode(F.sequence(F.lit(-BEFORE), F.lit(AFTER - 1))).alias("offset")).withColumn("idx", F.col("at") + F.col("offset"))
    met = wanted.join(rows, "idx").where(F.abs(F.col("position") - F.col("own")) <= RADIUS)
    return met.groupBy("own", "at").agg(F.collect_list(F.struct((F.col("position") - F.col("own")).alias("channel"), "offset", "v")).alias("samples")).select(F.col("own").alias("position"), F.col("at").alias("idx"), "samples")


def clusters(x: np.ndarray) -> list[np.ndarray]:
    """Groups of the rows of x by the density of their principal components; noise has the deviation 1 in each."""
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    y = centred @ axes[:COMPONENTS].T
    apart = ((y[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    least = min(max(LEAST // 2, int(LEAST_SHARE * len(x))), len(x) - 1)
    # spikes vary by more than noise where they overlap others or are a sample off; the usual distance allows for that
    usual = np.median(np.partition(apart, least, axis=1)[:, least])
    near = apart <= max(REACH**2, WIDER * usual)
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = np.zeros(len(x), bool)
        todo[i] = True
        inside = todo.copy()
        while todo.any():
            todo = near[todo].any(0) & core & ~inside
            inside |= todo
        label[inside] = label.max() + 1
    groups = [np.flatnonzero(label == k) for k in range(label.max() + 1)]
    return sorted((g for g in groups if len(g) >= max(LEAST, LEAST_SHARE * len(x))), key=len, reverse=True)[:CLUSTERS]


def _learn(key: tuple, table: pa.Table) -> pa.Table:
    """The templates of one channel from its cut-out peaks."""
    position = key[0].as_py()
    shapes = np.zeros((len(table), 2 * RADIUS + 1, BEFORE + AFTER))
    for i, samples in enumerate(table["samples"].to_pylist()):
        for s in samples:
            shapes[i, s["channel"] + RADIUS, s["offset"] + BEFORE] = s["v"]
    found = []
    if len(shapes) >= LEAST:
        for group in clusters(shapes.reshape(len(shapes), -1)):
            mean = shapes[group].mean(0)
            channel, at = np.unravel_index(mean.argmin(), mean.shape)
            if channel == RADIUS and abs(at - BEFORE) <= REFRACTORY // 2:
                found.append((len(group), mean))
    return pa.table({"position": pa.array([position] * len(found), pa.int32()), "n": pa.array([n for n, _ in found], pa.int64()), "shape": pa.array([m.ravel().tolist() for _, m in found], pa.list_(pa.float64()))})


def learned(rows: DataFrame, threshold: float, channels: int) -> np.ndarray:
    """Templates (unit, channel, sample) over all channels, in noises, most energetic first; of those that are alike one stays."""
    found = peaks(rows, threshold)
    order = Window.partitionBy("position").orderBy(F.md5(F.concat_ws(":", "position", "idx").cast("binary")), "idx")
    chosen = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LEARNED)
    made = cutouts(rows, chosen.select("position", "idx")).groupBy("position").applyInArrow(_learn, "position int, n long, shape array<double>").collect()
    out: list[np.ndarray] = []
    for r in sorted(made, key=lambda r: (-np.square(r["shape"]).sum(), r["position"])):
        shape = np.array(r["shape"]).reshape(2 * RADIUS + 1, -1)
        full = np.zeros((channels + 2 * RADIUS, BEFORE + AFTER))
        full[r["position"] : r["position"] + 2 * RADIUS + 1] = shape
        full = full[RADIUS : RADIUS + channels]
        same = [np.roll(full, s, 1) for s in range(-3, 4)]
        if not any((t * s).sum() > ALIKE * max((t * t).sum(), (full * full).sum()) for t in out for s in same):
            out.append(full)
    return np.array(out).reshape(-1, channels, BEFORE + AFTER)


def matched(x: np.ndarray, templates: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(unit, time) of the templates in x(channel, sample), taken greedily by the energy that they explain."""
    length, n = templates.shape[2], x.shape[1]
    if n < length or not len(templates):
        return []
    energy = (templates**2).sum((1, 2))
    local = [np.flatnonzero(np.abs(t).max(1) > 0) for t in templates]
    x, found = x.copy(), []
    for _ in range(ROUNDS):
        gain = np.full((len(templates), n - length + 1), -np.inf)
        scale = np.zeros_like(gain)
        for u, t in enumerate(templates):
            product = sum(np.correlate(x[c], t[c], "valid") for c in local[u])
            scale[u] = product / energy[u]
            fits = (scale[u] >= AMPLITUDES[0]) & (scale[u] <= AMPLITUDES[1]) & (product**2 / energy[u] > threshold**2)
            gain[u, fits] = product[fits] ** 2 / energy[u]
        best = gain.max(0)
        # what explains most within a template's length goes first, so what is taken at once doesn't overlap
        order = np.argsort(-best, kind="stable")
        free, taken = np.ones(len(best), bool), []
        for at in order[: np.isfinite(best).sum()]:
            if free[at]:
                taken.append(at)
                free[max(at - length, 0) : at + length] = False
        if not taken:
            break
        for at in taken:
            u = int(gain[:, at].argmax())
            x[:, at : at + length] -= scale[u, at] * templates[u]
            found.append((u, int(at) + BEFORE))
    return found


def sort_templates(df: DataFrame, threshold: float = 5.0, block: int = BLOCK) -> DataFrame:
    """(unit_id, sample_index) of the units that templates were found for."""
    df, n = dense(df)
    cols = numeric(df)
    rows = scaled(df, noises(df))
    templates = learned(rows, threshold, len(cols))
    halo = 3 * (BEFORE + AFTER)
    first = F.greatest(F.floor((F.col("idx") - block - halo) / block) + 1, F.lit(0))
    last = F.least(F.floor((F.col("idx") + halo) / block), F.lit(max(n - 1, 0) // block))
    parts = rows.select("position", "idx", "v", F.explode(F.sequence(first, last)).alias("block"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py() * block
        low, high = max(at - halo, 0), min(at + block + halo, n)
        x = np.zeros((len(cols), high - low))
        idx = table["idx"].to_numpy()
        inside = (idx >= low) & (idx < high)
        x[table["position"].to_numpy()[inside], idx[inside] - low] = table["v"].to_numpy()[inside]
        found = [(u, t + low) for u, t in matched(x, templates, threshold) if at <= t + low < at + block]
        return pa.table({"unit_id": pa.array([f"u{u}" for u, _ in found], pa.string()), "sample_index": pa.array([t for _, t in found], pa.int64())})

    return parts.groupBy("block").applyInArrow(run, "unit_id string, sample_index long")
