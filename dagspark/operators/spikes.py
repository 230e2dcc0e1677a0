"""Spike trains and calcium traces: PSTH, interval histogram, dF/F, threshold events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import column_quantiles
from .tabular import ROW, as_numeric, clean, long_form, numeric, with_row_id

MAX_UNITS = 10_000


def spike_columns(df: DataFrame) -> tuple[str, str | None]:
    """The time column (`time`, else the first) and the unit column (`unit`, else the one after `time`, if any)."""
    columns = [c for c in df.columns if c != ROW]
    time = "time" if "time" in columns else columns[0]
    if "unit" in columns:
        return time, "unit"
    others = [c for c in columns if c != time]
    return time, others[0] if "time" in columns and others else None


def spikes(df: DataFrame) -> tuple[DataFrame, bool]:
    """(time, unit, row) with finite times; and whether there are units."""
    time, unit = spike_columns(df)
    df = with_row_id(df)
    t = F.col(time).cast("double")
    unit_id = F.col(unit).cast("string") if unit else F.lit(None).cast("string")
    return df.select(t.alias("time"), unit_id.alias("unit"), F.col(ROW).alias("row")).where(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))), unit is not None


def _binned(x: Column, start: Column, width: Column, n: Column) -> Column:
    """Bin of x among n bins from start: closed on the left, the last on both sides; null outside.

    The quotient's bin is moved to where x lies among the edges as computed.
    """
    raw = F.floor((x - start) / width).cast("long")
    edge = lambda b: start + b.cast("double") * width
    b = F.when(x < edge(raw), raw - 1).when(x >= edge(raw + 1), raw + 1).otherwise(raw)
    b = F.when((b == n) & (x <= edge(n)), n - 1).otherwise(b)
    return F.when((b >= 0) & (b < n), b)


def psth(df: DataFrame, bin_size: float = 0.05, t_start: float = 0.0, t_end: float = 0.0) -> DataFrame:
    """bin_center and count, or unit_<id> in order of first appearance; empty without spikes."""
    if bin_size <= 0:
        raise ValueError("bin_size must be positive")
    rows, has_units = spikes(df)
    units = [r.unit for r in rows.groupBy("unit").agg(F.min("row").alias("row")).orderBy("row").limit(MAX_UNITS + 1).collect()] if has_units else []
    if len(units) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units")
    stop = F.lit(float(t_end)) if t_end > 0 else F.max("time")
    start, width = F.lit(float(t_start)), F.lit(float(bin_size))
    grid = rows.agg(F.count("*").alias("_all"), stop.alias("_stop")).where("_all > 0")
    grid = grid.withColumn("_stop", F.when(F.col("_stop") <= start, start + width).otherwise(F.col("_stop")))
    grid = grid.select(F.greatest(F.ceil((F.col("_stop") - start) / width).cast("long"), F.lit(1)).alias("_n"))
    counted = rows.crossJoin(F.broadcast(grid)).withColumn("bin", _binned(F.col("time"), start, width, F.col("_n"))).where("bin is not null")
    names = {u: f"unit_{u}" for u in units}
    of_unit = F.col("unit").eqNullSafe
    counts = [F.sum(F.when(of_unit(u), 1.0).otherwise(0.0)).alias(names[u]) for u in units] or [F.count("*").cast("double").alias("count")]
    columns = [names[u] for u in units] or ["count"]
    found = counted.groupBy("bin").agg(*counts)
    spine = grid.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("bin"))
    center = start + (F.col("bin").cast("double") + F.lit(0.5)) * width
    return spine.join(found, "bin", "left").select(center.alias("bin_center"), *(F.coalesce(f"`{c}`", F.lit(0.0)).alias(c) for c in columns))


def isi_histogram(df: DataFrame, n_bins: int = 50, max_isi: float = 0.0) -> DataFrame:
    """isi (bin centre) and count of the intervals between a unit's spikes; longer ones than max_isi are left out."""
    rows, _ = spikes(df)
    order = Window.partitionBy("unit").orderBy("time", "row")
    gaps = rows.select((F.col("time") - F.lag("time").over(order)).alias("gap")).where("gap is not null")
    cap = F.lit(float(max_isi)) if max_isi > 0 else F.max("gap")
    grid = gaps.agg(F.count("*").alias("_all"), cap.alias("_cap")).where("_all > 0")
    grid = grid.select((F.when(F.col("_cap") > 0, F.col("_cap")).otherwise(1.0) / n_bins).alias("_width"))
    n = F.lit(int(n_bins)).cast("long")
    counted = gaps.crossJoin(F.broadcast(grid)).withColumn("bin", _binned(F.col("gap"), F.lit(0.0), F.col("_width"), n)).where("bin is not null")
    spine = grid.select("_width", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    found = counted.groupBy("bin").agg(F.count("*").alias("_n"))
    return spine.join(found, "bin", "left").select(((F.col("bin").cast("double") + 0.5) * F.col("_width")).alias("isi"), F.coalesce("_n", F.lit(0)).cast("double").alias("count"))


def dff(df: DataFrame, percentile: float = 10.0) -> DataFrame:
    """(x - F0) / F0 for each channel, F0 being its percentile (tiny ones count as 1e-12)."""
    if not 0 <= percentile <= 100:
        raise ValueError("the percentile must lie in 0 to 100")
    df = as_numeric(df)
    cols, names = numeric(df), df.columns
    df = clean(df)
    base = {c: q for c, (q,) in column_quantiles(df, cols, (percentile / 100,)).items()}
    f0 = {c: F.lit(1e-12 if q is not None and abs(q) < 1e-12 else q).cast("double") for c, q in base.items()}
    return df.select(*(((F.col(c) - f0[c]) / f0[c]).alias(c) if c in f0 else F.col(c) for c in names))


def threshold_events(df: DataFrame, threshold: float = 3.0, rate: float = 30.0) -> DataFrame:
    """(time, channel, amplitude) of each rise above mean + threshold deviations of its channel."""
    rate = rate if rate > 0 else 1.0
    long = long_form(as_numeric(df)).withColumn("v", F.coalesce("v", F.lit(float("nan"))))
    value = F.when(~F.isnan("v"), F.col("v"))
    sd = F.stddev_pop(value)
    cuts = long.groupBy("channel").agg((F.avg(value) + threshold * F.when(sd < 1e-12, 1.0).otherwise(sd)).alias("cut"))
    above = F.coalesce(value > F.col("cut"), F.lit(False))
    # the value before comes from the row before, whatever the partition: each row also looks at the next one's place
    marked = long.join(F.broadcast(cuts), "channel").select("channel", "position", "idx", "v", above.alias("above"))
    was = marked.where("above").select("channel", (F.col("idx") + 1).alias("idx"))
    rises = marked.where("above").join(was, ["channel", "idx"], "left_anti")
    return rises.select((F.col("idx") / F.lit(float(rate))).alias("time"), "channel", F.col("v").alias("amplitude"), F.col("position").alias("_position")).orderBy("_position", "time").drop("_position")
