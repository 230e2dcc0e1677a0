"""Registered queries over the test tables and the equivalent DuckDB SQL.

Every query runs an operator of the library over whole tables. Floats are
rounded in both engines, as their sums depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.storage import shared_folder
from .model.graph import Graph
from .model.kinds import KINDS
from .operators import density, learn, signal, sorting, spectral, spikes, tabular
from .operators.tabular import ROW
from .plans.compiler import Context, compile_graph
from .plans.providers import preview_rows
from .search import rank, scan
from .search.index import latest, totals
from .search.store import SearchIndex

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

N = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_NS = ", ".join(N)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").select(*N)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a table: row id, seconds from the first, unit, and value with every seventh missing."""
    e = _table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = e.agg(F.min(micros).alias("_t0"))
    t = ((micros - F.col("_t0")) / 1e6).alias("time")
    value = F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value")
    return e.crossJoin(F.broadcast(first)).select(F.col("event_id").alias(ROW), t, (F.col("user_id") % 4).alias("unit"), "event_type", value, F.col("value").alias("full"))


_E = "e AS (SELECT event_id AS _row_id, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS time, user_id % 4 AS unit, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, value AS \"full\" FROM events)"

# --- normalise -----------------------------------------------------------------
_ITEMS = f"SELECT {_NS} FROM lineitem"


def _normal_sql(form: str) -> str:
    return f"WITH l AS ({_ITEMS}) SELECT " + ", ".join(f"round({form.replace('#', c)}, 6) AS {c}" for c in N) + " FROM l"


@query("normalize_minmax", _normal_sql("(# - min(#) OVER ()) / nullif(max(#) OVER () - min(#) OVER (), 0)"))
def _minmax(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.normalize(_items(s, d), "minmax"))


@query("normalize_zscore", _normal_sql("(# - avg(#) OVER ()) / nullif(stddev_samp(#) OVER (), 0)"))
def _zscore(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.normalize(_items(s, d), "zscore"))


_Q = ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in N)


@query("normalize_robust", f"WITH q AS (SELECT {_Q} FROM lineitem) SELECT " + ", ".join(f"round(({c} - q_{c}[2]) / nullif(q_{c}[3] - q_{c}[1], 0), 6) AS {c}" for c in N) + " FROM lineitem, q")
def _robust(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.normalize(_items(s, d), "robust"))


# --- missing values ---------------------------------------------------------------
def _gaps(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select(ROW, "value")


@query("missing_mean", f"WITH {_E} SELECT _row_id, round(coalesce(value, avg(value) OVER ()), 6) AS value FROM e")
def _mean(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.fill_missing(_gaps(s, d), "mean"))


@query("missing_median", f"WITH {_E} SELECT _row_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value FROM e")
def _median(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.fill_missing(_gaps(s, d), "median"))


@query("missing_drop", f"WITH {_E} SELECT _row_id, round(value, 6) AS value FROM e WHERE value IS NOT NULL")
def _drop(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.fill_missing(_gaps(s, d), "drop"))


@query("missing_forward_fill", f"WITH {_E} SELECT _row_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY _row_id ROWS UNBOUNDED PRECEDING), 6) AS value FROM e")
def _ffill(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.forward_fill(_gaps(s, d), 1000))


# --- selection and split -----------------------------------------------------------
@query("select_variance", f"SELECT {_NS} FROM lineitem")
def _variance(s: SparkSession, d: str) -> DataFrame:
    return tabular.select_variance(_items(s, d).withColumn("constant", F.lit(1.0)))


_F = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f"
    f" FROM (SELECT l_linenumber, sum({c}) AS s, sum({c} * {c}) AS q, count(*) AS n FROM lineitem GROUP BY 1)" for c in N
)


@query("anova_f", f"SELECT feature, round(f, 4) AS f FROM ({_F})")
def _anova(s: SparkSession, d: str) -> DataFrame:
    return _r(tabular.anova_f(_table(s, d, "lineitem").select(*N, "l_linenumber"), "l_linenumber"), 4)


@query("select_kbest", f"WITH f AS ({_F}), k AS (SELECT feature FROM f ORDER BY f DESC, feature LIMIT 2) SELECT count(*) AS n, (SELECT string_agg(feature, ',' ORDER BY feature) FROM k) AS features, sum(l_linenumber)::BIGINT AS y FROM lineitem")
def _kbest(s: SparkSession, d: str) -> DataFrame:
    best = tabular.select_kbest(_table(s, d, "lineitem").select(*N, "l_linenumber"), 2)
    features = ",".join(sorted(c for c in best.columns if c != "y"))
    return best.agg(F.count("*").alias("n"), F.lit(features).alias("features"), F.sum("y").alias("y"))


_SPLIT = "r AS (SELECT o_orderkey AS _row_id, o_custkey, o_totalprice, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) <= ceil(0.2 * count(*) OVER ()) AS test FROM orders)"


def _split(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return tabular.split(_table(s, d, "orders").select(F.col("o_orderkey").alias(ROW), "o_custkey", "o_totalprice"))


for _name, _cols, _test in (("X_train", "o_custkey", "NOT test"), ("X_test", "o_custkey", "test"), ("y_train", "o_totalprice", "NOT test"), ("y_test", "o_totalprice", "test")):
    query(f"split_{_name.lower()}", f"WITH {_SPLIT} SELECT _row_id, {_cols} FROM r WHERE {_test}")(lambda s, d, n=_name: _split(s, d)[n])


# --- correlation: through a compiled document ----------------------------------------
def _corr_sql(cols: tuple[str, ...], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS \"column\", " + ", ".join(f"round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS {b}" for b in cols) + f" FROM {table}" for a in cols)


@query("correlation", _corr_sql(N, "lineitem"))
def _correlation(s: SparkSession, d: str) -> DataFrame:
    graph = Graph()
    load = KINDS["data_loader"].create("load", file_path=f"{d}/lineitem.parquet")
    load.parameters["file_format"] = type(load.parameters["delimiter"])("file_format", value="parquet")
    pick = KINDS["custom_code"].create("pick", function_name="numeric_items", module="dagspark.catalog")
    for node in (load, pick, KINDS["preprocessor_normalize"].create("scale"), KINDS["analyzer_correlation"].create("corr")):
        graph.add_node(node)
    for a, b in (("load", "pick"), ("pick", "scale"), ("scale", "corr")):
        graph.add_edge(a, b)
    return _r(compile_graph(graph, Context(s, allow_code=True)).result("corr"))


def numeric_items(df: DataFrame) -> DataFrame:
    """What the document of the flagship query does with a table, as a user's function."""
    return df.select(ROW, *N)


# --- learning ----------------------------------------------------------------------------
@query("regression_linear", "WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_quantity, round(b + a * l_quantity, 4) AS prediction FROM lineitem, c")
def _linear(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "linear")


def _predicted(s: SparkSession, d: str, model: str) -> DataFrame:
    df = tabular.with_row_id(_table(s, d, "lineitem").select("l_quantity", "l_extendedprice"))
    return learn.regression(df, model).join(df, ROW).select("l_quantity", F.round("prediction", 4).alias("prediction"))


@query("regression_ridge", "WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), c AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / (sum((l_quantity - mx) * (l_quantity - mx)) + 1) AS a FROM lineitem, m) SELECT l_quantity, round(my + a * (l_quantity - mx), 4) AS prediction FROM lineitem, m, c")
def _ridge(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "ridge")


@query(
    "regression_polynomial",
    "WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_quantity * l_quantity) AS m2, avg(l_extendedprice) AS my FROM lineitem), "
    "c AS (SELECT sum((l_quantity - m1) * (l_quantity - m1)) AS aa, sum((l_quantity - m1) * (l_quantity * l_quantity - m2)) AS ab, sum((l_quantity * l_quantity - m2) * (l_quantity * l_quantity - m2)) AS bb, "
    "sum((l_quantity - m1) * (l_extendedprice - my)) AS ay, sum((l_quantity * l_quantity - m2) * (l_extendedprice - my)) AS byy FROM lineitem, m), "
    "w AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS w1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS w2 FROM c) "
    "SELECT l_quantity, round(my + w1 * (l_quantity - m1) + w2 * (l_quantity * l_quantity - m2), 4) AS prediction FROM lineitem, m, w",
)
def _poly(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "polynomial")


def _points(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "part").select(F.col("p_partkey").alias(ROW), (F.col("p_size") / 50.0).alias("x"), (F.col("p_retailprice") / 2000.0).alias("y"))


@query("kmeans")
def _kmeans(s: SparkSession, d: str) -> DataFrame:
    return learn.kmeans(_points(s, d), 3)


@query(
    "dbscan_core",
    "WITH p AS (SELECT p_partkey AS i, p_size / 50.0 AS x, p_retailprice / 2000.0 AS y FROM part) SELECT a.i AS _row_id FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004 GROUP BY a.i HAVING count(*) >= 5",
)
def _core(s: SparkSession, d: str) -> DataFrame:
    return density.neighbour_counts(_points(s, d), 0.02).where("n >= 5").select(ROW)


@query(
    "dbscan",
    "WITH RECURSIVE p AS (SELECT p_partkey AS i, p_size / 50.0 AS x, p_retailprice / 2000.0 AS y FROM part), "
    "nb AS (SELECT a.i AS a, b.i AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0004), core AS (SELECT a AS c FROM nb GROUP BY a HAVING count(*) >= 5), "
    "link AS (SELECT a, b FROM nb WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), reach AS (SELECT c AS a, c AS r FROM core UNION SELECT l.a, reach.r FROM link l JOIN reach ON l.b = reach.a), "
    "own AS (SELECT a, min(r) AS p FROM reach GROUP BY a), edge AS (SELECT nb.a, min(own.p) AS p FROM nb JOIN own ON nb.b = own.a GROUP BY nb.a), number AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS label FROM (SELECT DISTINCT p FROM own)) "
    "SELECT p.i AS _row_id, coalesce(label, -1)::INTEGER AS label FROM p LEFT JOIN edge ON edge.a = p.i LEFT JOIN own ON own.a = p.i LEFT JOIN number ON number.p = coalesce(own.p, edge.p)",
)
def _dbscan(s: SparkSession, d: str) -> DataFrame:
    return learn.dbscan(_points(s, d), 0.02, 5)


@query("hierarchical")
def _ward(s: SparkSession, d: str) -> DataFrame:
    rows = _table(s, d, "supplier").select(F.col("s_suppkey").alias(ROW), (F.col("s_acctbal") / 1000.0).alias("x"), F.col("s_nationkey").alias("y"))
    return learn.hierarchical(rows, 3)


# --- spikes and calcium ------------------------------------------------------------------
_BIN = "CASE WHEN x < b * w THEN b - 1 WHEN x >= (b + 1) * w THEN b + 1 ELSE b END"


def _hist_sql(source: str, width: str, n: str) -> str:
    """Counts of x in n bins of a width from 0, closed on the left, the last on both sides."""
    return (
        f"h AS (SELECT x, floor(x / {width})::BIGINT AS b, {width}::DOUBLE AS w, {n} AS n FROM {source}), "
        f"c AS (SELECT x, w, n, {_BIN} AS b FROM h), k AS (SELECT CASE WHEN b = n AND x <= n * w THEN n - 1 ELSE b END AS b, n FROM c)"
    )


@query(
    "psth",
    f"WITH {_E}, x AS (SELECT time AS x FROM e), g AS (SELECT greatest(ceil(max(x) / 3600.0)::BIGINT, 1) AS n FROM x), {_hist_sql('x', '3600.0', '(SELECT n FROM g)')}, "
    "t AS (SELECT b, count(*) AS c FROM k WHERE b >= 0 AND b < n GROUP BY b) SELECT round((i + 0.5) * 3600.0, 6) AS bin_center, coalesce(c, 0)::DOUBLE AS count FROM (SELECT unnest(range(0, n)) AS i FROM g) LEFT JOIN t ON b = i",
)
def _psth(s: SparkSession, d: str) -> DataFrame:
    return _r(spikes.psth(_events(s, d).select(ROW, "time"), 3600.0))


@query(
    "psth_by_unit",
    f"WITH {_E}, x AS (SELECT time AS x, unit FROM e), g AS (SELECT greatest(ceil(max(x) / 3600.0)::BIGINT, 1) AS n FROM x), "
    f"h AS (SELECT x, unit, floor(x / 3600.0)::BIGINT AS b, 3600.0::DOUBLE AS w, (SELECT n FROM g) AS n FROM x), c AS (SELECT x, unit, w, n, {_BIN} AS b FROM h), "
    "k AS (SELECT unit, CASE WHEN b = n AND x <= n * w THEN n - 1 ELSE b END AS b, n FROM c), "
    + "t AS (SELECT b, " + ", ".join(f"count(*) FILTER (unit = {u}) AS unit_{u}" for u in range(4)) + " FROM k WHERE b >= 0 AND b < n GROUP BY b) "
    + "SELECT round((i + 0.5) * 3600.0, 6) AS bin_center, " + ", ".join(f"coalesce(unit_{u}, 0)::DOUBLE AS unit_{u}" for u in range(4)) + " FROM (SELECT unnest(range(0, n)) AS i FROM g) LEFT JOIN t ON b = i",
)
def _psth_units(s: SparkSession, d: str) -> DataFrame:
    return _r(spikes.psth(_events(s, d).select(ROW, "time", "unit"), 3600.0))


@query(
    "isi_histogram",
    f"WITH {_E}, x AS (SELECT time - lag(time) OVER (PARTITION BY unit ORDER BY time, _row_id) AS x FROM e QUALIFY x IS NOT NULL), g AS (SELECT max(x) / 50 AS w FROM x), {_hist_sql('x', '(SELECT w FROM g)', '50')}, "
    "t AS (SELECT b, count(*) AS c FROM k WHERE b >= 0 AND b < 50 GROUP BY b) SELECT round((i + 0.5) * w, 6) AS isi, coalesce(c, 0)::DOUBLE AS count FROM (SELECT unnest(range(0, 50)) AS i, w FROM g) LEFT JOIN t ON b = i",
)
def _isi(s: SparkSession, d: str) -> DataFrame:
    return _r(spikes.isi_histogram(_events(s, d).select(ROW, "time", "unit")))


@query("dff", f"WITH {_E}, b AS (SELECT CASE WHEN abs(f) < 1e-12 THEN 1e-12 ELSE f END AS f FROM (SELECT quantile_cont(\"full\", 0.1) AS f FROM e)) SELECT _row_id, round((\"full\" - f) / f, 5) AS \"full\" FROM e, b")
def _dff(s: SparkSession, d: str) -> DataFrame:
    return _r(spikes.dff(_events(s, d).select(ROW, "full")), 5)


@query(
    "threshold_events",
    f"WITH {_E}, c AS (SELECT avg(\"full\") + 1.0 * (CASE WHEN stddev_pop(\"full\") < 1e-12 THEN 1.0 ELSE stddev_pop(\"full\") END) AS cut FROM e), a AS (SELECT _row_id, \"full\", \"full\" > cut AS above FROM e, c), "
    "r AS (SELECT _row_id, \"full\", above AND NOT coalesce(lag(above) OVER (ORDER BY _row_id), false) AS rise FROM a) SELECT round(_row_id / 30.0, 6) AS time, 'full' AS channel, round(\"full\", 6) AS amplitude FROM r WHERE rise",
)
def _rises(s: SparkSession, d: str) -> DataFrame:
    return _r(spikes.threshold_events(_events(s, d).select(ROW, "full"), 1.0, 30.0))


# --- signals -------------------------------------------------------------------------------
_WELCH_N = 64


@query(
    "welch_psd",
    f"WITH {_E}, p AS (SELECT (SELECT count(*) FROM e) AS n), w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / {_WELCH_N - 1}) AS w FROM range({_WELCH_N}) r(i)), sc AS (SELECT 250.0 * sum(w * w) AS sc FROM w), "
    f"seg AS (SELECT unnest(range(0, (n - {_WELCH_N}) // {_WELCH_N // 2} + 1)) AS s FROM p), v AS (SELECT s, i, coalesce(\"full\", 0) * w AS v FROM seg CROSS JOIN w JOIN e ON _row_id = s * {_WELCH_N // 2} + i), "
    f"f AS (SELECT s, k, sum(v * cos(2 * pi() * k * i / {_WELCH_N})) AS re, sum(v * sin(2 * pi() * k * i / {_WELCH_N})) AS im FROM v, range({_WELCH_N // 2 + 1}) q(k) GROUP BY s, k) "
    f"SELECT round(k * 250.0 / {_WELCH_N}, 6) AS frequency, round(avg((re * re + im * im) / sc * CASE WHEN k IN (0, {_WELCH_N // 2}) THEN 1 ELSE 2 END), 4) AS \"full\" FROM f, sc GROUP BY k",
)
def _welch(s: SparkSession, d: str) -> DataFrame:
    return signal.welch(_events(s, d).select(ROW, "full"), 250.0, _WELCH_N).select(F.round("frequency", 6).alias("frequency"), F.round("full", 4).alias("full"))


@query("bandpass")
def _band(s: SparkSession, d: str) -> DataFrame:
    return _r(signal.bandpass(_events(s, d).select(ROW, "full"), 250.0, 1.0, 40.0))


#: a band of so few bins, whatever the number of samples, that a plain transform can be written in SQL
_BINS = (3, 17)


@query(
    "bandpass_bins",
    f"WITH {_E}, n AS (SELECT count(*) AS n FROM e), k AS (SELECT unnest(range({_BINS[0]}, {_BINS[1] + 1})) AS k), "
    "x AS (SELECT k, sum(coalesce(\"full\", 0) * cos(2 * pi() * ((k * _row_id) % n) / n)) AS re, sum(coalesce(\"full\", 0) * sin(2 * pi() * ((k * _row_id) % n) / n)) AS im FROM e, n, k GROUP BY k) "
    "SELECT _row_id, round(sum(2 * (re * cos(2 * pi() * ((k * _row_id) % n) / n) + im * sin(2 * pi() * ((k * _row_id) % n) / n)) / n), 6) AS \"full\" FROM e, n, x GROUP BY _row_id",
)
def _band_bins(s: SparkSession, d: str) -> DataFrame:
    """The events' band of some bins, in four steps however few the samples are."""
    events = _events(s, d).select(ROW, "full")
    n = events.count()
    return _r(spectral.filtered(events, lambda _, cols: [spectral.Filter((_BINS,))] * len(cols), min(max(n // 64, 1), spectral.UNIT)))


@query("ica")
def _independent(s: SparkSession, d: str) -> DataFrame:
    return _r(signal.ica(_items(s, d)), 4)


@query(
    "erp",
    f"WITH {_E}, x AS (SELECT _row_id AS i, \"full\" AS v, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS stim FROM e), n AS (SELECT count(*) AS n FROM x), "
    "ev AS (SELECT i AS pt FROM x, n WHERE stim = 1 AND i - 5 >= 0 AND i + 10 < n), c AS (SELECT pt, o, x.v, x.stim FROM ev, range(-5, 11) r(o), x WHERE x.i = pt + o), "
    "b AS (SELECT pt, avg(v) AS bv, avg(stim) AS bs FROM c WHERE o <= 0 GROUP BY pt) SELECT round(o / 50.0, 6) AS time, round(avg(v - bv), 4) AS \"full\", round(avg(stim - bs), 4) AS stim FROM c JOIN b USING (pt) GROUP BY o",
)
def _erp(s: SparkSession, d: str) -> DataFrame:
    df = _events(s, d).select(ROW, "full", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0).alias("stim"))
    return signal.erp(df, 50.0, -0.1, 0.2, "stim").select(F.round("time", 6).alias("time"), F.round("full", 4).alias("full"), F.round("stim", 4).alias("stim"))


@query("common_reference", f"WITH m AS (SELECT {_NS}, list_median([{_NS}]) AS r FROM lineitem) SELECT " + ", ".join(f"round({c} - r, 6) AS {c}" for c in N) + " FROM m")
def _reference(s: SparkSession, d: str) -> DataFrame:
    return _r(sorting.common_reference(_items(s, d)))


@query("whiten")
def _whiten(s: SparkSession, d: str) -> DataFrame:
    return _r(sorting.whiten(_items(s, d)), 4)


@query(
    "whiten_pair",
    # the root of a 2 x 2 matrix A of determinant s * s and trace t is (A + s) / sqrt(t + 2 s)
    "WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, var_pop(l_quantity) AS a, var_pop(l_extendedprice) AS b, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem), "
    "r AS (SELECT ma, mb, (a + s) / q AS x, (b + s) / q AS y, c / q AS z FROM (SELECT *, sqrt(a * b - c * c) AS s, sqrt(a + b + 2 * sqrt(a * b - c * c)) AS q FROM m)), i AS (SELECT ma, mb, y / (x * y - z * z) AS ia, x / (x * y - z * z) AS ib, -z / (x * y - z * z) AS ic FROM r) "
    "SELECT round(ia * (l_quantity - ma) + ic * (l_extendedprice - mb), 4) AS l_quantity, round(ic * (l_quantity - ma) + ib * (l_extendedprice - mb), 4) AS l_extendedprice FROM lineitem, i",
)
def _whiten_pair(s: SparkSession, d: str) -> DataFrame:
    return _r(sorting.whiten(_table(s, d, "lineitem").select("l_quantity", "l_extendedprice")), 4)


# --- spike sorting -----------------------------------------------------------------------------
def _sorting(s: SparkSession, d: str, parity: int) -> DataFrame:
    e = _events(s, d).where(F.col(ROW) % 2 == parity)
    return e.select(F.col("unit").cast("string").alias("unit_id"), F.floor(F.col("time") / 60).alias("sample_index")).distinct()


def _sorting_sql(name: str, parity: int) -> str:
    return f"{name} AS (SELECT DISTINCT unit::VARCHAR AS unit_id, floor(time / 60)::BIGINT AS t FROM e WHERE _row_id % 2 = {parity})"


@query(
    "spike_compare",
    f"WITH {_E}, {_sorting_sql('a', 0)}, {_sorting_sql('b', 1)}, p AS (SELECT a.unit_id AS unit1, b.unit_id AS unit2, a.t AS t1, b.t AS t2 FROM a JOIN b ON b.t BETWEEN a.t - 2 AND a.t + 2), "
    "q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unit1, unit2, t1 ORDER BY abs(t1 - t2), t2) = 1), r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY unit1, unit2, t2 ORDER BY abs(t1 - t2), t1) = 1), "
    "m AS (SELECT unit1, unit2, count(*) AS matches FROM r GROUP BY ALL), x AS (SELECT unit_id AS unit1, count(*) AS n1 FROM a GROUP BY 1), y AS (SELECT unit_id AS unit2, count(*) AS n2 FROM b GROUP BY 1) "
    "SELECT unit1, unit2, n1, n2, matches, round(matches / (n1 + n2 - matches), 6) AS agreement FROM m JOIN x USING (unit1) JOIN y USING (unit2)",
)
def _compare(s: SparkSession, d: str) -> DataFrame:
    return _r(sorting.compare(_sorting(s, d, 0), _sorting(s, d, 1), 1000.0, 2.0))


def _units(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    return e.select((F.col("unit") * 10 + F.col(ROW) % 10).cast("string").alias("unit_id"), F.round(F.col("time") * 10).cast("long").alias("sample_index"))


_DURATION = "(SELECT max(sample_index) / 10.0 FROM u)"
_METRICS = (
    f"{_E}, u AS (SELECT (unit * 10 + _row_id % 10)::VARCHAR AS unit_id, round(time * 10)::BIGINT AS sample_index FROM e), g AS (SELECT unit_id, sample_index / 10.0 AS t, (sample_index - lag(sample_index) OVER (PARTITION BY unit_id ORDER BY sample_index)) / 10.0 AS gap, {_DURATION} AS dur FROM u), "
    "m AS (SELECT unit_id, count(*) / any_value(dur) AS firing_rate, count(DISTINCT least(floor(t / (dur / 60)), 59)) / 60.0 AS presence_ratio, coalesce(sum(CASE WHEN gap < 30 THEN 1.0 ELSE 0.0 END) / nullif(count(gap), 0), 0) AS isi_violations_ratio FROM g GROUP BY unit_id)"
)


def _unit_metrics(s: SparkSession, d: str) -> DataFrame:
    u = _units(s, d)
    last = u.agg(F.max("sample_index")).first()[0]
    return sorting.quality_metrics(u, 10.0, last / 10.0, refractory=30.0).drop("snr")


@query("quality_metrics", f"WITH {_METRICS} SELECT unit_id, round(firing_rate, 6) AS firing_rate, round(presence_ratio, 6) AS presence_ratio, round(isi_violations_ratio, 6) AS isi_violations_ratio FROM m")
def _metrics(s: SparkSession, d: str) -> DataFrame:
    return _r(_unit_metrics(s, d))


@query("curate_units", f"WITH {_METRICS} SELECT unit_id, round(firing_rate, 6) AS firing_rate, round(presence_ratio, 6) AS presence_ratio, round(isi_violations_ratio, 6) AS isi_violations_ratio FROM m WHERE presence_ratio >= 0.5 AND firing_rate >= 0 AND isi_violations_ratio <= 0.05")
def _curate(s: SparkSession, d: str) -> DataFrame:
    return _r(sorting.curate(_unit_metrics(s, d), isi_violations_max=0.05, presence_ratio_min=0.5, firing_rate_min=0.0))


def recorded_items(df: DataFrame) -> DataFrame:
    """Two channels with rare large troughs, in the order of the rows' keys."""
    trough = lambda c, top: -F.pow((F.col(c).cast("double") - F.lit(0.0)) / F.lit(float(top)), F.lit(15.0))
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return tabular.ordered(df.select(*order, trough("l_quantity", 50).alias("c0"), trough("l_discount", 0.1).alias("c1")), *order)


_CHAIN = (
    "r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) - 1 AS i, -pow(l_quantity::DOUBLE / 50.0, 15.0) AS c0, -pow(l_discount::DOUBLE / 0.1, 15.0) AS c1 FROM lineitem), "
    "f AS (SELECT i, c0 - (c0 + c1) / 2 AS c0, c1 - (c0 + c1) / 2 AS c1 FROM r), l AS (SELECT 'c0' AS ch, i, c0 AS v FROM f UNION ALL SELECT 'c1', i, c1 FROM f), "
    "n AS (SELECT ch, median(abs(v - m)) / 0.6745 AS noise FROM (SELECT ch, v, median(v) OVER (PARTITION BY ch) AS m FROM l) GROUP BY ch), w AS (SELECT ch, i FROM l JOIN n USING (ch) WHERE v < -5 * noise), "
    "u AS (SELECT ch AS unit_id, i AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM w q WHERE q.ch = w.ch AND q.i = w.i - 1)), d AS (SELECT count(*) / 30000.0 AS dur FROM r), "
    "g AS (SELECT unit_id, t / 30000.0 AS t, (t - lag(t) OVER (PARTITION BY unit_id ORDER BY t)) / 30000.0 AS gap FROM u), "
    "q AS (SELECT unit_id, count(*) / any_value(dur) AS firing_rate, count(DISTINCT least(floor(t / (dur / 60)), 59)) / 60.0 AS presence_ratio, coalesce(sum(CASE WHEN gap < 0.0015 THEN 1.0 ELSE 0.0 END) / nullif(count(gap), 0), 0) AS isi_violations_ratio FROM g, d GROUP BY unit_id), "
    "k AS (SELECT unit_id, t FROM u QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY md5(unit_id || ':' || t), t) <= 500), "
    "p AS (SELECT unit_id, ch, o, avg(v) AS v FROM (SELECT unit_id, t, unnest(range(-5, 5)) AS o FROM k) JOIN l ON l.i = t + o GROUP BY ALL), s AS (SELECT unit_id, max(abs(v) / noise) AS snr FROM p JOIN n USING (ch) GROUP BY unit_id), "
    "m AS (SELECT unit_id, snr, isi_violations_ratio, presence_ratio, firing_rate FROM q LEFT JOIN s USING (unit_id))"
)


def _chain(s: SparkSession, d: str) -> Graph:
    """recording -> preprocess -> sort -> analyze -> metrics -> curate, as a document."""
    graph = Graph()
    load = KINDS["data_loader"].create("load", file_path=f"{d}/lineitem.parquet")
    load.parameters["file_format"] = type(load.parameters["delimiter"])("file_format", value="parquet")
    pick = KINDS["custom_code"].create("record", function_name="recorded_items", module="dagspark.catalog")
    names = ("preprocessor_neural_si", "analyzer_neural_si_sort", "analyzer_neural_si_analyze", "analyzer_neural_si_metrics", "analyzer_neural_si_curate")
    keys = {n: next(k for k in KINDS if k.startswith(n)) for n in names}
    pre = KINDS[keys[names[0]]].create("clean", method="common_reference")
    sort, analyze = KINDS[keys[names[1]]].create("sort"), KINDS[keys[names[2]]].create("analyze")
    metrics = KINDS[keys[names[3]]].create("metrics", metric_names="snr,isi_violation,presence_ratio,firing_rate")
    curate = KINDS[keys[names[4]]].create("curate", snr_min=0.5, isi_violations_max=1.0, presence_ratio_min=0.5)
    for node in (load, pick, pre, sort, analyze, metrics, curate):
        graph.add_node(node)
    for a, b in (("load", "record"), ("record", "clean"), ("clean", "sort")):
        graph.add_edge(a, b)
    graph.add_edge("clean", "analyze", target_port="recording")
    graph.add_edge("sort", "analyze", target_port="sorting")
    graph.add_edge("analyze", "metrics")
    graph.add_edge("metrics", "curate", source_port="analyzer")
    return graph


@query("si_chain_metrics", f"WITH {_CHAIN} SELECT unit_id, round(snr, 5) AS snr, round(isi_violations_ratio, 6) AS isi_violations_ratio, round(presence_ratio, 6) AS presence_ratio, round(firing_rate, 6) AS firing_rate FROM m")
def _chain_metrics(s: SparkSession, d: str) -> DataFrame:
    plan = compile_graph(_chain(s, d), Context(s, allow_code=True))
    return _r(plan.result("metrics", "metrics")).withColumn("snr", F.round("snr", 5))


@query("si_chain_curated", f"WITH {_CHAIN} SELECT unit_id, t AS sample_index FROM u JOIN m USING (unit_id) WHERE snr >= 0.5 AND presence_ratio >= 0.5 AND firing_rate >= 0.1 AND isi_violations_ratio <= 1")
def _chain_curated(s: SparkSession, d: str) -> DataFrame:
    return compile_graph(_chain(s, d), Context(s, allow_code=True)).result("curate").select("unit_id", "sample_index")


# --- search ---------------------------------------------------------------------------------------
_TOKENS = "list_filter(string_split_regex(lower(regexp_replace(replace(text, '_', ' '), '([A-Z])', ' \\1', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_WORDS = ["the", "eager", "then", "worthless", "erbleou", "benchmark"]


@query("tokenize", f"SELECT doc_id, len({_TOKENS})::INTEGER AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def _tokenize(s: SparkSession, d: str) -> DataFrame:
    words = text.tokens(F.col("text"))
    return _table(s, d, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query("infer_tags", f"SELECT doc_id, array_to_string(list_filter([{', '.join(repr(t) for t in text.TAG_VOCABULARY)}], lambda t: list_contains({_TOKENS}, t)), ',') AS tags FROM documents")
def _tags(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.array_join(text.tags(text.tokens(F.col("text"))), ",").alias("tags"))


def _kind_sql(kind: str) -> str:
    hints = text.KIND_HINTS[kind]
    inside = " OR ".join([f"list_has_any(w, [{', '.join(repr(h) for h in hints)}])", *(f"len(list_filter(w, lambda x: contains(x, '{h}'))) > 0" for h in hints if len(h) > 3)])
    return f"CASE WHEN {inside} THEN '{kind}' END"


@query("infer_kinds", f"WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id, array_to_string(list_filter([{', '.join(_kind_sql(k) for k in text.KIND_HINTS)}], lambda x: x IS NOT NULL), ',') AS kinds FROM t")
def _kinds(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "documents").select("doc_id", F.array_join(text.data_kinds(text.tokens(F.col("text"))), ",").alias("kinds"))


_GRAMS = "(len(w) + len(list_distinct([a || '||' || b FOR a, b IN list_zip(w, w[2:])])))"


@query("winnow", f"WITH t AS (SELECT conv_id, turn, list_sort(list_distinct([md5(x) FOR x IN {_TOKENS}])) AS h FROM conversations) SELECT conv_id, turn, array_to_string(h[1:greatest(len(h) - 3, 1)], ',') AS fingerprints FROM t")
def _winnow(s: SparkSession, d: str) -> DataFrame:
    hashes = F.transform(text.tokens(F.col("text")), lambda x: F.md5(x.cast("binary")))
    return _table(s, d, "conversations").select("conv_id", "turn", F.array_join(text.winnowed(hashes), ",").alias("fingerprints"))


@query(
    "kgrams",
    f"WITH t AS (SELECT conv_id, turn, {_TOKENS} AS w FROM conversations) SELECT conv_id, turn, len(list_distinct(w || [w[i] || '||' || w[i + 1] FOR i IN range(1, len(w))] || [w[i] || '||' || w[i + 1] || '||' || w[i + 2] FOR i IN range(1, len(w) - 1)]))::INTEGER AS n FROM t",
)
def _kgrams(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "conversations").select("conv_id", "turn", F.size(text.kgrams(text.tokens(F.col("text")))).alias("n"))


#: words of a document that stand for calls
_CALLS = 12


def _indexed(s: SparkSession, d: str) -> SearchIndex:
    """The stored index of the documents; each document is a file of its own, and its first words stand for calls."""
    digest = F.md5(F.concat_ws(" ", "source", "text").cast("binary"))
    split = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), digest.alias("digest"), text.tokens(F.col("source")).alias("name_words"), text.tokens(F.col("text")).alias("words"))
    words = F.col("words")
    docs = split.select(
        "id", F.col("id").alias("file"), "digest", "words", "name_words", text.intent(words).alias("intent"), F.slice(words, 1, _CALLS).alias("calls"),
        text.data_kinds(words).alias("kinds"), text.tags(words).alias("tags"),
    )
    index = SearchIndex(s, f"{shared_folder(s)}/search-{hashlib.md5(d.encode(), usedforsecurity=False).hexdigest()}")
    index.update(docs)
    return index


_QUERY = ["the", "idiot", "license", "filter", "src3"]
_QL = "[" + ", ".join(repr(w) for w in _QUERY) + "]"


@query(
    "search_simple",
    f"WITH d AS (SELECT doc_id::VARCHAR AS id, {_TOKENS} AS w, {_TOKENS.replace('text', 'source')} AS nw FROM documents), n AS (SELECT count(*) AS n FROM d), tf AS (SELECT id, term, count(*) / len(any_value(w)) AS tf FROM (SELECT id, w, unnest(w) AS term FROM d) GROUP BY id, term), "
    f"df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT term, 1 / {len(_QUERY)}.0 * ln((n + 1) / (coalesce(df, 0) + 1)) AS qw FROM (SELECT unnest({_QL}) AS term) LEFT JOIN df USING (term), n), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM q), "
    "c AS (SELECT id, sum(tf * ln((n + 1) / (df + 1)) * qw) / (sqrt(sum((tf * ln((n + 1) / (df + 1))) ** 2)) * any_value(qn)) AS c FROM tf JOIN df USING (term) LEFT JOIN q USING (term), n, qn GROUP BY id), "
    f"s AS (SELECT id, 0.65 * coalesce(c, 0) + 0.25 * coalesce(len(list_intersect(list_distinct(w), {_QL})) / nullif(len(list_distinct(w || {_QL})), 0), 0) + 0.08 * len(list_intersect(list_distinct(nw), {_QL})) + 0.02 * len(list_filter([{', '.join(repr(t) for t in text.TAG_VOCABULARY if t in _QUERY)}], lambda t: list_contains(w, t))) AS score FROM d LEFT JOIN c USING (id)) "
    "SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 20",
)
def _search(s: SparkSession, d: str) -> DataFrame:
    return _r(rank.search_simple(_indexed(s, d), _QUERY, 20))


@query("search_candidates", f"WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents) SELECT doc_id::VARCHAR AS id FROM d WHERE list_has_any(w, ['idiot', 'license', 'filter'])")
def _candidates(s: SparkSession, d: str) -> DataFrame:
    return _indexed(s, d).candidates([("w", "idiot"), ("w", "license"), ("w", "filter")])


_FUSED = (["idiot", "filter", "license", "table"], ["the", "eager.then", "idiot"], ["table", "spike"])


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(repr(w) for w in words) + "]"


@query(
    "search_signals",
    f"WITH d AS (SELECT doc_id::VARCHAR AS id, {_TOKENS} AS w FROM documents), e AS (SELECT id, w, list_filter(w, lambda x: NOT list_contains({_listed(list(text.STOPWORDS))}, x) AND len(x) > 1) AS t, w[1:{_CALLS}] AS c FROM d), "
    f"f AS (SELECT *, list_distinct(c || [c[i] || '||' || c[i + 1] FOR i IN range(1, len(c))] || [c[i] || '||' || c[i + 1] || '||' || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS g, array_to_string(list_filter([{', '.join(_kind_sql(k) for k in text.KIND_HINTS)}], lambda x: x IS NOT NULL), ',') AS kinds FROM e), "
    "q AS (SELECT ['idiot', 'filter', 'license', 'table'] AS qt, ['the', 'eager.then', 'idiot', 'then', 'the||eager.then', 'eager.then||idiot', 'the||eager.then||idiot'] AS qg, ['the', 'then', 'idiot'] AS ql), "
    "n AS (SELECT count(*) AS n FROM d), tf AS (SELECT id, term, count(*) / any_value(len(t)) AS tf FROM (SELECT id, t, unnest(t) AS term FROM e) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "qw AS (SELECT term, 0.25 * ln((n + 1) / (coalesce(df, 0) + 1)) AS qw FROM (SELECT unnest(qt) AS term FROM q) LEFT JOIN df USING (term), n), "
    "c AS (SELECT id, sum(tf * ln((n + 1) / (df + 1)) * qw) / (sqrt(sum((tf * ln((n + 1) / (df + 1))) ** 2)) * (SELECT sqrt(sum(qw * qw)) FROM qw)) AS cosine FROM tf JOIN df USING (term) LEFT JOIN qw USING (term), n GROUP BY id) "
    "SELECT id, len(list_intersect(list_distinct(t), qt)) / 4 AS coverage, round(coalesce(cosine, 0), 6) AS cosine, "
    "round(CASE WHEN len(list_intersect(list_distinct(c), ql)) > 0 THEN 2 * len(list_intersect(list_distinct(c), ql)) / (len(list_distinct(c)) + len(ql)) ELSE coalesce(len(list_intersect(g, qg)) / nullif(len(list_distinct(g || qg)), 0), 0) END, 6) AS leaf, "
    "len(list_intersect(string_split(kinds, ','), ['table', 'spike'])) / 2 AS kind FROM f LEFT JOIN c USING (id), q WHERE list_has_any(t, qt) OR list_has_any(g, qg)",
)
def _signals(s: SparkSession, d: str) -> DataFrame:
    return _r(rank.index_signals(_indexed(s, d), *_FUSED).select("id", "coverage", "cosine", "leaf", "kind"))


@query("search_fused")
def _fused(s: SparkSession, d: str) -> DataFrame:
    return _r(rank.search_fused(_indexed(s, d), *_FUSED, 20))


@query(
    "rerank_cosine",
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), r AS (SELECT vec_id, embedding::DOUBLE[] AS v, 1.0 / (1 + vec_id) AS score FROM embeddings), t AS (SELECT * FROM r ORDER BY score DESC LIMIT 50) "
    "SELECT vec_id::VARCHAR AS id, round(0.4 * score + 0.6 * list_cosine_similarity(v, q), 4) AS score FROM t, q UNION ALL SELECT vec_id::VARCHAR, round(score, 4) FROM r WHERE vec_id NOT IN (SELECT vec_id FROM t)",
)
def _rerank(s: SparkSession, d: str) -> DataFrame:
    e = _table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (1.0 / (1 + F.col("vec_id"))).alias("score"))
    first = e.where("id = '0'").first().vector
    return _r(rank.rerank(e.select("id", "score"), e.select("id", "vector"), list(first)), 4)


@query("preview", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 20")
def _preview(s: SparkSession, d: str) -> DataFrame:
    return preview_rows(_table(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query("chunk_caps", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20")
def _caps(s: SparkSession, d: str) -> DataFrame:
    return scan.capped(_table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 20)


@query("last_write_wins", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
def _last(s: SparkSession, d: str) -> DataFrame:
    return latest(_table(s, d, "conversations").select("conv_id", "role", "turn"), "conv_id", "turn")


@query("kind_counts", "SELECT k AS chunk_kind, count(role)::BIGINT AS n FROM (SELECT unnest(['user', 'assistant', 'system']) AS k) LEFT JOIN conversations ON role = k GROUP BY k")
def _counts(s: SparkSession, d: str) -> DataFrame:
    return totals(_table(s, d, "conversations").select(F.col("role").alias("chunk_kind")), "chunk_kind", ["user", "assistant", "system"])
