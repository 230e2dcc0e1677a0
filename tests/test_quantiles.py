"""Exact quantiles against sorting."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dagspark.operators import sorting, spikes, tabular
from dagspark.operators.quantiles import column_quantiles, of_key, order_key, quantiles

ODD = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 2.0**-1022, 2.0**1023, 4.0, 3.9999999999999996, 8.000000000000002]


def test_keys_have_the_order_and_the_bits_of_doubles(spark):
    rng = np.random.default_rng(1)
    x = ODD + [float(v) for v in rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300)] + [2.0**e for e in range(-1074, 1024, 7)]
    got = [(r.v, r.k) for r in spark.createDataFrame([(v,) for v in x], "v double").select("v", order_key(F.col("v")).alias("k")).collect()]
    for v, k in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits if v < 0 else bits)
        assert of_key(k) == v
    assert [v for v, _ in sorted(got, key=lambda r: r[1])] == sorted(x)


@pytest.mark.parametrize("fetched", [1 << 16, 0])
def test_quantiles_equal_sorting(spark, monkeypatch, fetched):
    monkeypatch.setattr("dagspark.operators.quantiles.FETCHED", fetched)
    rng = np.random.default_rng(2)
    groups = {"ties": [float(v) for v in rng.integers(-3, 4, 500)], "wide": [float(v) for v in rng.normal(size=333) * 10.0 ** rng.integers(-200, 200, 333)], "one": [7.5], "equal": [2.0] * 50, "odd": [v for v in ODD if math.isfinite(v)] * 3}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", math.nan), ("none", None)]
    fractions = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    found = quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), fractions)
    assert set(found) == set(groups)
    for g, vs in groups.items():
        assert found[g] == pytest.approx([float(np.quantile(vs, f)) if abs(max(vs)) < 1e300 else q for f, q in zip(fractions, found[g], strict=True)], rel=1e-12, abs=0)
        assert found[g][0] == min(vs)
        assert found[g][-1] == max(vs)


def test_statistics_of_columns(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (2.0, None, "b"), (math.nan, None, "c"), (10.0, None, "d")], "x double, empty double, name string")
    assert column_quantiles(df, ["x", "empty"], (0.5,)) == {"x": [2.0], "empty": [None]}
    assert [r.x for r in tabular.fill_missing(df, "median").collect()] == [1.0, 2.0, 2.0, 10.0]
    assert [r["empty"] for r in tabular.normalize(df, "robust").collect()] == [None] * 4
    assert spikes.dff(df.select("x", "empty"), 0).collect()[1].x == 1.0
    noise = {r.channel: r.noise for r in sorting.noise_levels(spark.createDataFrame([(float(i), 3.0) for i in range(101)], "a double, b double")).collect()}
    assert noise == {"a": pytest.approx(25 / 0.6745), "b": 0.0}


def test_counting_tasks_hand_on_bounded_counters(monkeypatch):
    import pyarrow as pa

    from dagspark.operators import quantiles as q

    monkeypatch.setattr(q, "HELD", 100)
    x = np.random.default_rng(3).normal(size=5_000)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 500])], names=["c0"]) for i in range(0, len(x), 500)]
    parts = list(q._digits(iter(batches), q._of_columns, 48, None))
    # counted in the task: far fewer rows than values, in several parts
    assert 1 < len(parts) < 60
    assert sum(p.num_rows for p in parts) < len(x) / 2
    total = {}
    for p in parts:
        for d, n in zip(p["digit"].to_pylist(), p["n"].to_pylist(), strict=True):
            total[d] = total.get(d, 0) + n
    assert total == {int(d): int(n) for d, n in zip(*np.unique(q.bit_keys(x) >> np.uint64(48), return_counts=True), strict=True)}


def test_quantiles_are_counted_before_the_shuffle_of_values(spark):
    """Keys used to be made by an expression that every use repeated; now a pass is one Arrow function over the columns."""
    df = spark.range(0, 50_000, 1, 3).selectExpr("cast(id % 977 as double) as x", "cast(-id as double) as y")
    assert column_quantiles(df, ["x", "y"], (0.25, 0.5)) == {"x": [241.0, 486.0], "y": [-37499.25, -24999.5]}
    assert [float(np.quantile(np.arange(50_000) % 977, f)) for f in (0.25, 0.5)] == [241.0, 486.0]


def test_rows_are_numbered_in_an_order_without_one_task_for_all(spark):
    df = spark.range(0, 10_000, 1, 7).selectExpr("(id * 7919) % 10007 as k", "id as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = tabular.ordered(df, "k")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.rdd.getNumPartitions() > 1
    rows = sorted((r[tabular.ROW], r.v) for r in got.collect())
    want = [v for _, v in sorted(((i * 7919) % 10007, i) for i in range(10_000))]
    assert rows == list(enumerate(want))
