"""Tabular operators: normalise, fill, select, split, correlate.

Tables carry their row order in `_row_id`; every operator works on the numeric
columns and passes the others through. NaN counts as missing. A quotient by
zero is null. Statistics are one aggregate over the table; only their one row
is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.storage import checkpointed
from .quantiles import column_quantiles

ROW = "_row_id"
#: rows that forward filling orders in one task
FILL_BLOCK = 1_000_000


def with_row_id(df: DataFrame) -> DataFrame:
    """df with dense row numbers in the order of its partitions; left alone if it has them."""
    if ROW in df.columns:
        return df
    return _dense(df.withColumn("_at", F.monotonically_increasing_id()), df.columns)


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """The other columns of df with dense row numbers in the order of some, sorted by ranges of them; stored, as ranges differ from one evaluation to the next."""
    others = [c for c in df.columns if c not in order]
    return _dense(checkpointed(df.orderBy(*order).select(*others, F.monotonically_increasing_id().alias("_at"))), others)


def _dense(numbered: DataFrame, columns: list[str]) -> DataFrame:
    """The columns after a row number without gaps, made of the monotonic ids `_at`."""
    part = F.shiftright("_at", 33)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(ROW, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_start")).select(ROW, *columns)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != ROW]


def as_numeric(df: DataFrame) -> DataFrame:
    """df for a numerical kernel: as it is if it has numeric columns, else all columns read as numbers (null where they are none)."""
    if numeric(df):
        return df
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in df.columns if c != ROW})


def _value(c: str) -> Column:
    """The column as a double, NaN as null."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def clean(df: DataFrame) -> DataFrame:
    return df.withColumns({c: _value(c) for c in numeric(df)})


def _with_stats(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """df with each statistic as a column, from one aggregate; its single row is broadcast."""
    one = df.agg(*(c.alias(n) for n, c in stats.items()))
    return df.crossJoin(F.broadcast(one))


def _replaced(df: DataFrame, new: dict[str, Column], columns: list[str]) -> DataFrame:
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


def normalize(df: DataFrame, method: str = "minmax") -> DataFrame:
    """minmax: (x - min) / (max - min); zscore: by mean and sample deviation; robust: by median and quartile range."""
    cols, names = numeric(df), df.columns
    df = clean(df)
    if not cols or method not in ("minmax", "zscore", "robust"):
        return df
    if method == "minmax":
        stats = {f"_l{i}": F.min(c) for i, c in enumerate(cols)} | {f"_h{i}": F.max(c) for i, c in enumerate(cols)}
        new = {c: F.try_divide(F.col(c) - F.col(f"_l{i}"), F.col(f"_h{i}") - F.col(f"_l{i}")) for i, c in enumerate(cols)}
    elif method == "zscore":
        stats = {f"_l{i}": F.avg(c) for i, c in enumerate(cols)} | {f"_h{i}": F.stddev_samp(c) for i, c in enumerate(cols)}
        new = {c: F.try_divide(F.col(c) - F.col(f"_l{i}"), F.col(f"_h{i}")) for i, c in enumerate(cols)}
    else:
        q = {c: [F.lit(x).cast("double") for x in xs] for c, xs in column_quantiles(df, cols, (0.25, 0.5, 0.75)).items()}
        return _replaced(df, {c: F.try_divide(F.col(c) - q[c][1], q[c][2] - q[c][0]) for c in cols}, names)
    return _replaced(_with_stats(df, stats), new, names)


def fill_missing(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """mean, median, drop (rows with any missing value) or forward_fill (the last value above)."""
    cols, names = numeric(df), df.columns
    df = clean(df)
    if strategy == "drop":
        return df.na.drop("any", subset=[c for c in names if c != ROW])
    if strategy == "forward_fill":
        return forward_fill(df)
    if strategy not in ("mean", "median") or not cols:
        return df
    if strategy == "median":
        return _replaced(df, {c: F.coalesce(c, F.lit(q).cast("double")) for c, (q,) in column_quantiles(df, cols, (0.5,)).items()}, names)
    stats = {f"_s{i}": F.avg(c) for i, c in enumerate(cols)}
    return _replaced(_with_stats(df, stats), {c: F.coalesce(c, f"_s{i}") for i, c in enumerate(cols)}, names)


def forward_fill(df: DataFrame, block: int = FILL_BLOCK) -> DataFrame:
    """Blocks of rows are filled in parallel; what each block hands on is found from one row a block."""
    names = df.columns
    cols = [c for c in names if c != ROW]
    df = clean(with_row_id(df)).withColumn("_block", F.floor(F.col(ROW) / block))
    last = df.groupBy("_block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ROW))).alias(f"_c{i}") for i, c in enumerate(cols)))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_block", *(F.last(f"_c{i}", True).over(before).alias(f"_c{i}") for i in range(len(cols))))
    inside = Window.partitionBy("_block").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    filled = df.join(carried, "_block")
    return filled.select(*(F.coalesce(F.last(c, True).over(inside), F.col(f"_c{cols.index(c)}")).alias(c) if c != ROW else F.col(ROW) for c in names))


def select_variance(df: DataFrame) -> DataFrame:
    """Without the numeric columns that have only one value."""
    cols = numeric(df)
    if not cols:
        return df
    row = clean(df).agg(*(F.min(c).alias(f"l{i}") for i, c in enumerate(cols)), *(F.max(c).alias(f"h{i}") for i, c in enumerate(cols))).first()
    constant = {c for i, c in enumerate(cols) if row[f"l{i}"] == row[f"h{i}"]}
    return df.select(*(c for c in df.columns if c not in constant))


def anova_f(df: DataFrame, target: str) -> DataFrame:
    """(feature, f): the one-way F statistic of every numeric column over the target's classes."""
    cols = [c for c in numeric(df) if c != target]
    df = clean(df) if target in numeric(df) else clean(df).where(F.col(target).isNotNull())
    sums = [x for i, c in enumerate(cols) for x in (F.sum(c).alias(f"s{i}"), F.sum(F.col(c) * F.col(c)).alias(f"q{i}"), F.count(c).alias(f"n{i}"))]
    classes = df.groupBy(target).agg(*sums)
    totals = []
    for i in range(len(cols)):
        s, q, n = (F.col(f"{x}{i}") for x in "sqn")
        between, k = F.sum(F.try_divide(s * s, n)), F.sum(F.when(n > 0, 1))
        ss_between = between - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))
        ss_within = F.sum(q) - between
        totals.append(F.try_divide(F.try_divide(ss_between, (k - 1).cast("double")), F.try_divide(ss_within, (F.sum(n) - k).cast("double"))).alias(f"f{i}"))
    row = classes.agg(*totals)
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("f")) for i, c in enumerate(cols)))))


def select_kbest(df: DataFrame, k: int = 10, target: str | None = None) -> DataFrame:
    """The k columns of the largest F statistic in their order, and the target (the last column) as y."""
    columns = [c for c in df.columns if c != ROW]
    target = target or columns[-1]
    features = [c for c in columns if c != target]
    k = min(int(k), max(len(columns) - 1, 1))
    best = {r.feature for r in anova_f(df, target).orderBy(F.desc_nulls_last("f"), "feature").limit(k).collect()}
    return df.select(*(c for c in df.columns if c == ROW or c in best and c in features), F.col(f"`{target}`").alias("y"))


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, target: str | None = None) -> dict[str, DataFrame]:
    """X_train, X_test, y_train, y_test: the test rows are the ceil(test_size n) smallest by md5 of seed and row id.

    Rows are counted by the first digits of their digest, so only those that
    share the digits at which the test set ends are ranked.
    """
    df = with_row_id(df)
    columns = [c for c in df.columns if c != ROW]
    target = target or columns[-1]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ROW)).cast("binary"))
    keyed = df.withColumn("_md5", digest).withColumn("_head", F.substring("_md5", 1, 4))
    heads = keyed.groupBy("_head").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_head"))
    total = F.sum("_n").over(Window.partitionBy())
    heads = heads.select("_head", (F.ceil(total * F.lit(float(test_size))) - (upto - F.col("_n"))).alias("_room"), "_n")
    joined = keyed.join(F.broadcast(heads), "_head")  # 65,536 rows at most
    whole, none = F.col("_room") >= F.col("_n"), F.col("_room") <= 0
    edge = joined.where(~whole & ~none)
    rank = F.row_number().over(Window.partitionBy("_head").orderBy("_md5", ROW))
    edge = edge.withColumn("_test", rank <= F.col("_room"))
    marked = joined.where(whole | none).withColumn("_test", whole).unionByName(edge)
    test, train = marked.where("_test"), marked.where("not _test")
    x = [ROW, *(c for c in columns if c != target)]
    return {"X_train": train.select(*x), "X_test": test.select(*x), "y_train": train.select(ROW, target), "y_test": test.select(ROW, target)}


def _pearson(a: str, b: str) -> Column:
    """Over the rows that have both; null where either is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation(df: DataFrame) -> DataFrame:
    """Square table of Pearson correlations of the numeric columns: column, then one column for each."""
    cols = numeric(df)
    df = clean(df)
    pairs = {(a, b): f"r{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j}
    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    one = df.agg(*(_pearson(a, b).alias(n) for (a, b), n in pairs.items()))
    cell = lambda a, b: F.col(pairs.get((a, b)) or pairs[b, a])
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column"), *(cell(a, b).alias(b) for b in cols)) for a in cols))))


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(channel, position, idx, v) of the numeric columns, `position` being the column's."""
    df = with_row_id(df)
    columns = columns or numeric(df)
    cells = [F.struct(F.lit(c).alias("channel"), F.lit(i).alias("position"), _value(c).alias("v")) for i, c in enumerate(columns)]
    return df.select(F.col(ROW).alias("idx"), F.inline(F.array(*cells))).select("channel", "position", "idx", "v")


def wide_form(long: DataFrame, columns: list[str]) -> DataFrame:
    """Back to one column for each channel."""
    return long.groupBy(F.col("idx").alias(ROW)).pivot("channel", columns).agg(F.first("v"))


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
