"""DBSCAN by cells against all pairs."""

import numpy as np
import pytest

from dagspark.operators import density
from dagspark.operators.tabular import ROW


def brute(x, eps, least):
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label, near.sum(1)


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], f"{ROW} long, " + ", ".join(f"c{i} double" for i in range(x.shape[1]))).repartition(4)


def labels(df, n):
    got = {r[ROW]: r.label for r in df.collect()}
    return np.array([got[i] for i in range(n)])


@pytest.mark.parametrize(("d", "eps", "least"), [(1, 0.02, 4), (2, 0.09, 5), (3, 0.4, 6)])
def test_labels_and_counts_equal_all_pairs(spark, d, eps, least):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(150, d)) * 0.3, rng.random((100, d)), np.round(rng.random((80, d)), 1)])
    want, counts = brute(x, eps, least)
    assert labels(density.dbscan(frame(spark, x), eps, least), len(x)).tolist() == want.tolist()
    assert {r[ROW]: r.n for r in density.neighbour_counts(frame(spark, x), eps).collect()} == dict(enumerate(counts.tolist()))


def test_cells_are_halved_until_they_link(spark, monkeypatch):
    monkeypatch.setattr(density, "COMPARED", 1)
    rng = np.random.default_rng(7)
    # clouds whose gaps are just below and just above eps
    clouds = [rng.random((60, 2)) * 0.3 + (at, 0) for at in (0.0, 0.62, 1.30, 1.95)]
    x = np.concatenate(clouds)
    for eps in (0.33, 0.36, 0.4):
        assert labels(density.dbscan(frame(spark, x), eps, 3), len(x)).tolist() == brute(x, eps, 3)[0].tolist()


def test_eight_columns(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(120, 8)) * 0.2 + c for c in (0, 3)] + [rng.random((40, 8)) * 5])
    assert labels(density.dbscan(frame(spark, x), 0.6, 5), len(x)).tolist() == brute(x, 0.6, 5)[0].tolist()


def test_fifty_thousand_equal_points(spark):
    df = spark.range(50_010).selectExpr(f"id as {ROW}", "case when id < 50000 then 1.0 else 5.0 + id end as a", "case when id = 7 then null else 2.0 end as b")
    got = density.dbscan(df, 0.5, 5)
    assert {(r.label, r["count"]) for r in got.groupBy("label").count().collect()} == {(0, 49_999), (-1, 11)}
    assert density.dbscan(df.where("false"), 0.5, 5).count() == 0
