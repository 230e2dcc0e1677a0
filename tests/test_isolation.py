"""Principal components of spikes and isolation in them."""

import numpy as np

from dagspark.operators import isolation, sorting
from dagspark.operators.tabular import ROW


def recording(spark, x):
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x.T)], f"{ROW} long, " + ", ".join(f"ch{c} double" for c in range(len(x))))


def spikes(spark, times):
    return spark.createDataFrame([(u, int(t)) for u, ts in times.items() for t in ts], "unit_id string, sample_index long")


def planted(seed, channels, n, units):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(channels, n))
    times = {}
    wave = -np.exp(-0.5 * ((np.arange(-8, 12)) / 2.0) ** 2)
    for u, (centre, size) in units.items():
        times[u] = np.sort(rng.choice(np.arange(30, n - 50), 120, replace=False))
        for t in times[u]:
            for c in range(channels):
                x[c, t - 8 : t + 12] += size * np.exp(-abs(c - centre)) * wave
    return x, times


def test_components_equal_those_of_all_waveforms(spark):
    x, times = planted(1, 9, 4000, {"a": (2, 10), "b": (3, 14), "c": (7, 12)})
    df, at = recording(spark, x), spikes(spark, times)
    main = {r.unit_id: r.main for r in isolation.main_channels(df, at).collect()}
    assert main == {"a": 2, "b": 3, "c": 7}
    got = isolation.principal_components(df, at, 8, 12).collect()
    assert {(r.unit_id, r.position) for r in got} == {(u, p) for u, m in main.items() for p in range(m - 3, m + 4) if 0 <= p < 9}
    for p in range(9):
        mine = [(r.unit_id, r.sample_index, r.pc) for r in got if r.position == p]
        w = np.array([x[p, t - 8 : t + 12] for _, t, _ in mine])
        centred = w - w.mean(0)
        value, vector = np.linalg.eigh(centred.T @ centred / len(w))
        want = centred @ vector[:, ::-1][:, :3]
        have = np.array([pc for *_, pc in mine])
        assert np.allclose(np.abs(want), np.abs(have), atol=1e-6)


def test_isolation_equals_its_definition(spark):
    x, times = planted(2, 6, 4000, {"a": (2, 14), "b": (2, 9), "far": (5, 20)})
    df, at = recording(spark, x), spikes(spark, times)
    pcs = isolation.principal_components(df, at, 8, 12).persist()
    rows = pcs.collect()
    got = {r.unit_id: r.isolation_distance for r in isolation.isolation_distance(pcs).collect()}
    by = {}
    for r in rows:
        by.setdefault((r.unit_id, r.sample_index), {})[r.position] = r.pc
    for u, main in (("a", 2), ("b", 2)):
        vector = lambda parts, main=main: np.concatenate([parts[p] for p in range(main - 1, main + 2)])
        mine = np.array([vector(v) for (w, _), v in by.items() if w == u])
        others = np.array([vector(v) for (w, _), v in by.items() if w in "ab" and w != u])
        away = others - mine.mean(0)
        d2 = np.sort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(np.cov(mine.T)), away))
        assert np.isclose(got[u], d2[len(mine) - 1])
    assert got["far"] is None
    done = sorting.analyzer_metrics(sorting.analyze(df, at, "random_spikes,principal_components"), 30_000.0, "isolation_distance")
    assert {r.unit_id: r.isolation_distance is None for r in done.metrics.collect()} == {"a": False, "b": False, "far": True}


def test_many_channels_and_units(spark):
    rng = np.random.default_rng(3)
    channels, n = 384, 400
    df = recording(spark, rng.normal(size=(channels, n)))
    at = spikes(spark, {f"u{i}": rng.choice(np.arange(30, n - 50), 12, replace=False) for i in range(300)})
    found = isolation.isolation_distance(isolation.principal_components(df, at, 5, 5, 1))
    assert found.count() == 300
