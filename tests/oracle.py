"""Compares a Spark result with DuckDB's on the same Parquet tables."""

import os

import duckdb


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(v.tolist()) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    x = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(value(v) for v in r) for r in x.itertuples(index=False, name=None)), key=repr)


def connect(d):
    c = duckdb.connect()
    for t in os.listdir(d):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{d}/{t}'")
    return c


def same(df, sql, d):
    a, b = rows(df.toPandas()), rows(connect(d).sql(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
