"""Spike sorting on tables: recordings are wide or (channel, position, idx, v); sortings are (unit_id, sample_index).

Formulas of metrics and of the simple sorter are this library's own; the vendor
sorters and formats are adapters that say what is missing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import isolation
from .matching import noises, sort_templates
from .motion import correct_motion
from .signal import moments
from .spectral import Filter, band, filtered
from .tabular import ROW, clean, conjunction, long_form, numeric, with_row_id


class AdapterMissing(RuntimeError):
    """A stage that needs a package which isn't installed."""


def preprocess(df: DataFrame, method: str = "bandpass_filter", rate: float = 30000.0, freq_min: float = 300.0, freq_max: float = 6000.0, notch_freq: float = 3000.0, notch_q: float = 30.0, reference: str = "global", threshold: float = float("inf"), shifts: list[float] | None = None) -> DataFrame:
    method = {"motion": "correct_motion", "motion_correction": "correct_motion"}.get(method, method)
    if method == "bandpass_filter":
        return filtered(df, lambda n, cols: [band(n, rate, freq_min, freq_max)] * len(cols))
    if method == "highpass_filter":
        return filtered(df, lambda n, cols: [band(n, rate, freq_min)] * len(cols))
    if method == "notch_filter":
        return filtered(df, lambda n, cols: [band(n, rate, without=notch_freq, half=notch_freq / notch_q / 2)] * len(cols))
    if method == "common_reference":
        return common_reference(df, reference)
    if method == "whiten":
        return whiten(df)
    if method == "blank_saturation":
        cols = numeric(df)
        return clean(df).withColumns({c: F.when(F.abs(c) >= threshold, 0.0).otherwise(F.col(c)) for c in cols})
    if method == "phase_shift":
        return phase_shift(df, shifts)
    if method == "correct_motion":
        return correct_motion(df, rate)
    raise AdapterMissing(f"{method} needs a spike-sorting package, which isn't installed")


def common_reference(df: DataFrame, reference: str = "global") -> DataFrame:
    """Less the median over the channels (global), the first channel (single), or the median of the two neighbours (local)."""
    cols = numeric(df)
    df = clean(df)
    values = F.array(*cols)
    if reference == "single":
        return df.withColumns({c: F.col(c) - F.col(cols[0]) for c in cols})
    middle = lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2
    if reference == "local":
        around = {c: F.array(*(F.col(cols[j]) for j in (i - 1, i + 1) if 0 <= j < len(cols))) for i, c in enumerate(cols)}
        return df.withColumns({c: F.col(c) - F.coalesce(middle(around[c]), F.lit(0.0)) for c in cols})
    return df.withColumn("_ref", middle(F.array_compact(values))).select(*((F.col(c) - F.col("_ref")).alias(c) if c in cols else F.col(c) for c in df.columns))


def whiten(df: DataFrame) -> DataFrame:
    """Channels made uncorrelated, of unit variance, by the symmetric inverse root of their covariance."""
    cols = numeric(df)
    df = clean(df)
    mean, cov, _ = moments(df.select(*cols).na.drop("any"), cols)
    value, vector = np.linalg.eigh(cov)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-12))) @ vector.T
    new = {c: sum((F.lit(float(root[i, j])) * (F.col(cols[j]) - F.lit(float(mean[j]))) for j in range(len(cols))), F.lit(0.0)) for i, c in enumerate(cols)}
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def phase_shift(df: DataFrame, shifts: list[float] | None) -> DataFrame:
    """Channels moved by fractions of a sample; without given shifts channel i of n by i / n."""
    return filtered(df, lambda n, cols: [Filter(((0, n // 2),), x) for x in shifts or [i / len(cols) for i in range(len(cols))]])


def noise_levels(df: DataFrame) -> DataFrame:
    """(channel, noise): median absolute deviation over 0.6745."""
    return df.sparkSession.createDataFrame(list(noises(df).items()), "channel string, noise double")


def sort_simple(df: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Where a channel falls below -threshold times its noise: a spike of the channel's unit."""
    long = long_form(df).join(F.broadcast(noise_levels(df)), "channel")
    low = long.where(F.col("v") < -threshold * F.col("noise")).select("channel", "idx")
    after = low.select("channel", (F.col("idx") + 1).alias("idx"))
    return low.join(after, ["channel", "idx"], "left_anti").select(F.col("channel").alias("unit_id"), F.col("idx").alias("sample_index"))


def sort_spikes(df: DataFrame, sorter: str = "simple") -> DataFrame:
    """simple: a unit for each channel; template: matching of learned shapes. Other sorters are packages of their own."""
    if sorter == "template":
        return sort_templates(df)
    if sorter != "simple":
        raise AdapterMissing(f"the sorter {sorter} isn't installed; simple and template are built in")
    return sort_simple(df)


def waveforms(recording: DataFrame, sorting: DataFrame, before: int = 20, after: int = 40) -> DataFrame:
    """(unit_id, sample_index, channel, offset, v) of the samples around each spike."""
    wanted = sorting.select("unit_id", "sample_index", F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("offset"))
    return wanted.withColumn("idx", F.col("sample_index") + F.col("offset")).join(long_form(recording), "idx").select("unit_id", "sample_index", "channel", "offset", "v")


def templates(recording: DataFrame, sorting: DataFrame, before: int = 20, after: int = 40) -> DataFrame:
    return waveforms(recording, sorting, before, after).groupBy("unit_id", "channel", "offset").agg(F.avg("v").alias("v"))


#: spikes of a unit that waveforms are cut for
SPIKES_PER_UNIT = 500
DEFAULT_EXTENSIONS = ("random_spikes", "waveforms", "templates", "noise_levels")
EXTENSIONS = (*DEFAULT_EXTENSIONS, "principal_components")
METRICS = ("snr", "isi_violation", "presence_ratio", "firing_rate", "isolation_distance")


def names_of(given: str | Iterable[str] | None, default: tuple[str, ...]) -> tuple[str, ...]:
    """Names from a comma-separated list; the default without any."""
    parts = given.split(",") if isinstance(given, str) else given or ()
    return tuple(x for p in parts if (x := p.strip())) or default


def random_spikes(sorting: DataFrame, most: int = SPIKES_PER_UNIT) -> DataFrame:
    """At most so many spikes of each unit, those whose md5 of unit and time comes first."""
    order = Window.partitionBy("unit_id").orderBy(F.md5(F.concat_ws(":", "unit_id", "sample_index")), "sample_index")
    return sorting.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


@dataclass(frozen=True)
class Analyzer:
    """A sorting with its recording and what was computed of both; used as a table it is the sorting."""

    sorting: DataFrame
    recording: DataFrame | None = None
    extensions: dict[str, DataFrame] = field(default_factory=dict)
    metrics: DataFrame | None = None

    def __getattr__(self, name: str) -> object:
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.sorting, name)

    def select_units(self, units: DataFrame) -> Analyzer:
        """Only the units(unit_id), in everything that is by unit."""
        only = lambda df: df.join(units, "unit_id", "left_semi") if df is not None and "unit_id" in df.columns else df
        return replace(self, sorting=only(self.sorting), extensions={k: only(v) for k, v in self.extensions.items()}, metrics=only(self.metrics))

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Analyzer:
        return replace(self, sorting=self.sorting.persist(level))

    def unpersist(self) -> Analyzer:
        self.sorting.unpersist()
        return self


def analyze(recording: DataFrame, sorting: DataFrame, extensions: str | Iterable[str] | None = None) -> Analyzer:
    """The analyzer of a sorting, with the extensions and what they need."""
    names = names_of(extensions, DEFAULT_EXTENSIONS)
    if unknown := [n for n in names if n not in EXTENSIONS]:
        raise AdapterMissing(f"the extensions {', '.join(unknown)} need a spike-sorting package, which isn't installed")
    made: dict[str, DataFrame] = {}
    if {"random_spikes", "waveforms", "templates", "principal_components"} & set(names):
        made["random_spikes"] = random_spikes(sorting)
    if {"waveforms", "templates"} & set(names):
        made["waveforms"] = waveforms(recording, made["random_spikes"])
    if "templates" in names:
        made["templates"] = made["waveforms"].groupBy("unit_id", "channel", "offset").agg(F.avg("v").alias("v"))
    if "principal_components" in names:
        made["principal_components"] = isolation.principal_components(recording, made["random_spikes"])
    if "noise_levels" in names:
        made["noise_levels"] = noise_levels(recording)
    return Analyzer(sorting, recording, made)


def isolation_distance(recording: DataFrame, sorting: DataFrame) -> DataFrame:
    """(unit_id, isolation_distance): for a unit of n spikes, the n-th smallest squared Mahalanobis distance of the others' spikes from it.

    A spike's features are its amplitudes on all channels; random_spikes are
    used. With principal components as an extension those count instead. Null where the unit's spikes span no volume or the others have fewer.
    The units' means and covariances (a few numbers each) go over the driver.
    """
    at = waveforms(recording, random_spikes(sorting), 0, 1)
    channels = numeric(recording)
    spikes = at.groupBy("unit_id", "sample_index").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(f"x{i}") for i, c in enumerate(channels))).na.drop("any")
    xs = [f"x{i}" for i in range(len(channels))]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i + 1)]
    sums = spikes.groupBy("unit_id").agg(F.count("*").alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)), *(F.covar_samp(xs[i], xs[j]).alias(f"c{i}_{j}") for i, j in pairs))
    units = []
    for r in sums.collect():
        cov = np.zeros((len(xs), len(xs)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"] or 0.0
        if r.n > len(xs) and np.linalg.matrix_rank(cov) == len(xs):
            units.append((r.unit_id, r.n, [float(r[f"m{i}"]) for i in range(len(xs))], np.linalg.inv(cov).ravel().tolist()))
    of_unit = recording.sparkSession.createDataFrame(units, "of string, n long, mean array<double>, inverse array<double>")
    away = [F.col(x) - F.col("mean")[i] for i, x in enumerate(xs)]
    d2 = sum((away[i] * away[j] * F.col("inverse")[i * len(xs) + j] for i in range(len(xs)) for j in range(len(xs))), F.lit(0.0))
    others = spikes.join(F.broadcast(of_unit), F.col("unit_id") != F.col("of")).select("of", "n", d2.alias("d2"))
    nth = F.row_number().over(Window.partitionBy("of").orderBy("d2"))
    found = others.withColumn("nth", nth).where("nth = n").select(F.col("of").alias("unit_id"), F.col("d2").alias("isolation_distance"))
    return sums.select("unit_id").join(found, "unit_id", "left")


def analyzer_metrics(analyzer: Analyzer, rate: float, metric_names: str | Iterable[str] | None = None) -> Analyzer:
    """The analyzer with the metrics of that name; those that need a recording are null or, if they can't be had, left out."""
    names = names_of(metric_names, METRICS)
    if analyzer.recording is not None:
        samples = analyzer.recording.count()
    else:
        samples = (analyzer.sorting.agg(F.max("sample_index")).first()[0] or 0) + 1
    table = quality_metrics(analyzer.sorting, rate, max(samples / rate, 1 / rate), analyzer.recording if "snr" in names else None)
    if "isolation_distance" in names and analyzer.recording is not None and numeric(analyzer.recording):
        pcs = analyzer.extensions.get("principal_components")
        table = table.join(isolation_distance(analyzer.recording, analyzer.sorting) if pcs is None else isolation.isolation_distance(pcs), "unit_id", "left")
    columns = {"isi_violation": "isi_violations_ratio", "isi_violations": "isi_violations_ratio"}
    wanted = [c for n in names if (c := columns.get(n, n)) in table.columns]
    return replace(analyzer, metrics=table.select("unit_id", *dict.fromkeys(wanted)))


def curate_analyzer(analyzer: Analyzer, rate: float, **rules: float) -> Analyzer:
    """The analyzer's units that pass; metrics that it lacks are computed first."""
    if analyzer.metrics is None:
        analyzer = analyzer_metrics(analyzer, rate)
    return analyzer.select_units(curate(analyzer.metrics, **rules).select("unit_id"))


def quality_metrics(sorting: DataFrame, rate: float, duration: float, recording: DataFrame | None = None, refractory: float = 0.0015, bins: int = 60) -> DataFrame:
    """One row a unit: firing_rate, presence_ratio (of `bins` equal parts, those with spikes), isi_violations_ratio, snr.

    isi_violations_ratio is the share of intervals below the refractory time;
    snr the largest mean amplitude over the noise of its channel (null without a recording).
    """
    t = sorting.withColumn("t", F.col("sample_index") / F.lit(float(rate)))
    order = Window.partitionBy("unit_id").orderBy("sample_index")
    t = t.withColumn("gap", F.col("t") - F.lag("t").over(order)).withColumn("bin", F.least(F.floor(F.col("t") / (duration / bins)), F.lit(bins - 1)))
    out = t.groupBy("unit_id").agg(
        (F.count("*") / F.lit(float(duration))).alias("firing_rate"),
        (F.count_distinct("bin") / F.lit(float(bins))).alias("presence_ratio"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("gap") < refractory, 1.0).otherwise(0.0)), F.count("gap").cast("double")), F.lit(0.0)).alias("isi_violations_ratio"),
    )
    if recording is None:
        return out.withColumn("snr", F.lit(None).cast("double"))
    peak = templates(recording, random_spikes(sorting), 5, 5).join(F.broadcast(noise_levels(recording)), "channel")
    snr = peak.groupBy("unit_id").agg(F.max(F.try_divide(F.abs("v"), F.col("noise"))).alias("snr"))
    return out.join(snr, "unit_id", "left")


def curate(metrics: DataFrame, snr_min: float = 5.0, isi_violations_max: float = 0.2, presence_ratio_min: float = 0.9, firing_rate_min: float = 0.1, isolation_distance_min: float = 0.0) -> DataFrame:
    """The units that pass every rule whose metric is there; a missing value doesn't pass."""
    metrics = clean(metrics)
    has = set(metrics.columns)
    isi = next((c for c in ("isi_violations_ratio", "isi_violation", "isi_violations") if c in has), None)
    rules = [F.col(c) >= low for c, low in (("snr", snr_min), ("presence_ratio", presence_ratio_min), ("firing_rate", firing_rate_min)) if c in has]
    rules += [F.col(isi) <= isi_violations_max] if isi else []
    rules += [F.col("isolation_distance") >= isolation_distance_min] if isolation_distance_min > 0 and "isolation_distance" in has else []
    return metrics.where(conjunction(rules))


def compare(a: DataFrame, b: DataFrame, rate: float, delta_ms: float = 0.4) -> DataFrame:
    """(unit1, unit2, n1, n2, matches, agreement): spikes of two sortings within delta, each counted once with its nearest.

    Joined by time buckets of the width delta and their neighbours.
    """
    delta = delta_ms / 1000 * rate
    width = max(delta, 1.0)
    left = a.select(F.col("unit_id").alias("unit1"), F.col("sample_index").alias("t1"), F.floor(F.col("sample_index") / width).alias("bucket"))
    right = b.select(F.col("unit_id").alias("unit2"), F.col("sample_index").alias("t2"), F.floor(F.col("sample_index") / width).alias("b"))
    right = right.select("unit2", "t2", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("bucket"))
    near = left.join(right, "bucket").where(F.abs(F.col("t1") - F.col("t2")) <= delta)
    by1 = F.row_number().over(Window.partitionBy("unit1", "unit2", "t1").orderBy(F.abs(F.col("t1") - F.col("t2")), "t2"))
    near = near.withColumn("r1", by1).where("r1 = 1")
    by2 = F.row_number().over(Window.partitionBy("unit1", "unit2", "t2").orderBy(F.abs(F.col("t1") - F.col("t2")), "t1"))
    matched = near.withColumn("r2", by2).where("r2 = 1").groupBy("unit1", "unit2").agg(F.count("*").alias("matches"))
    n1 = a.groupBy(F.col("unit_id").alias("unit1")).agg(F.count("*").alias("n1"))
    n2 = b.groupBy(F.col("unit_id").alias("unit2")).agg(F.count("*").alias("n2"))
    out = matched.join(n1, "unit1").join(n2, "unit2")
    return out.select("unit1", "unit2", "n1", "n2", "matches", (F.col("matches") / (F.col("n1") + F.col("n2") - F.col("matches"))).alias("agreement"))


def best_matches(agreement: DataFrame, match_score: float = 0.5) -> DataFrame:
    """Pairs of units that are each other's best and agree enough."""
    one = F.row_number().over(Window.partitionBy("unit1").orderBy(F.desc("agreement"), "unit2"))
    two = F.row_number().over(Window.partitionBy("unit2").orderBy(F.desc("agreement"), "unit1"))
    return agreement.where(F.col("agreement") >= match_score).withColumn("a", one).withColumn("b", two).where("a = 1 and b = 1").drop("a", "b")


EXPORTS = ("phy", "report")


def known_export(method: str) -> None:
    if method not in EXPORTS:
        raise AdapterMissing(f"export to {method} needs a package that isn't installed")


def export(sorting: DataFrame | Analyzer, path: str, method: str = "phy", rate: float = 30000.0) -> str:
    """Write a sorting: phy as CSV of spike times and clusters (an analyzer's metrics and templates beside it), report as counts; other formats need their packages."""
    known_export(method)
    if method == "phy":
        if isinstance(sorting, Analyzer):
            for name, df in (("cluster_metrics", sorting.metrics), ("templates", sorting.extensions.get("templates"))):
                if df is not None:
                    df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
            path_of_spikes = f"{path}/spikes"
        else:
            path_of_spikes = path
        sorting.select("sample_index", F.col("unit_id").alias("cluster")).orderBy("sample_index").write.mode("overwrite").option("header", True).csv(path_of_spikes)
    else:
        sorting.groupBy("unit_id").agg(F.count("*").alias("n_spikes"), (F.min("sample_index") / rate).alias("first_s"), (F.max("sample_index") / rate).alias("last_s")).write.mode("overwrite").option("header", True).csv(path)
    return path
