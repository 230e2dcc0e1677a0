"""Learning operators: clustering and regression; results are labels or in-sample predictions by row id."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .density import dbscan
from .tabular import ROW, clean, numeric, with_row_id
from .ward import hierarchical


def kmeans(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    df = with_row_id(df)
    cols = numeric(df)
    rows = VectorAssembler(inputCols=cols, outputCol="_x").transform(clean(df).na.drop("any", subset=cols))
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="label").fit(rows).transform(rows).select(ROW, "label")


def _solve(df: DataFrame, terms: list[Column], y: Column, ridge: float) -> Column:
    """Least squares on centred terms from two aggregates; only sums reach the driver."""
    names = [f"_t{i}" for i in range(len(terms))]
    rows = df.select(*(t.alias(n) for t, n in zip(terms, names, strict=True)), y.alias("_y")).na.drop("any")
    mean = rows.agg(*(F.avg(n).alias(n) for n in [*names, "_y"])).first()
    if mean["_y"] is None:
        return F.lit(None).cast("double")
    gap = {n: F.col(n) - F.lit(mean[n]) for n in [*names, "_y"]}
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], "_y"]]
    sums = rows.agg(*(F.sum(gap[a] * gap[b]).alias(f"{a}{b}") for a, b in pairs)).first()
    xx = np.array([[sums[a + b] if a + b in sums else sums[b + a] for b in names] for a in names])
    xy = np.array([sums[a + "_y"] for a in names])
    w = np.linalg.solve(xx + ridge * np.eye(len(names)), xy) if ridge else np.linalg.lstsq(xx, xy, rcond=None)[0]
    constant = mean["_y"] - sum(float(c) * mean[n] for c, n in zip(w, names, strict=True))
    return sum((F.lit(float(c)) * t for c, t in zip(w, terms, strict=True)), F.lit(float(constant)))


def regression(df: DataFrame, model: str = "linear", alpha: float = 1.0, target: str | None = None) -> DataFrame:
    """In-sample predictions of the target (the last column) from the other numeric columns: linear, ridge or polynomial (degree 2)."""
    df = clean(with_row_id(df))
    cols = numeric(df)
    target = target or cols[-1]
    x = [F.col(c) for c in cols if c != target]
    if model == "polynomial":
        x = x + [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]
    prediction = _solve(df, x, F.col(target), alpha if model == "ridge" else 0.0)
    return df.select(ROW, prediction.alias("prediction"))
