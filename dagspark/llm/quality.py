"""Operator 4: quality rules by robust multivariate outliers.

Each text becomes a vector of transformed statistics. Within each (language,
source) the minimum covariance determinant estimate is found by concentration
steps over all of the group's rows: take the share `H` of the rows with the
smallest Mahalanobis distances, estimate mean and covariance from them, repeat
until the group's determinant falls no more (by STILL of its logarithm). There are two fixed starts (medians with
quartile ranges; mean and covariance of all rows), the smaller determinant
wins, and one reweighting step follows. Rows further away than the chi-square
quantile QUANTILE are rejected.

Distances are put in bins of one sixteenth of a power of two, counted per group
and bin, so the subset's edge is exact to a bin whatever the size of the group;
only counts and sums ever meet in one task. Groups of fewer than MIN_GROUP
usable rows use their language's estimate, small languages that of all rows.
A statistic that is equal in most rows (no symbols, say) would make a covariance
singular: its variance is raised to that of FLOORS where it is smaller.

Texts that fail the base rule are rejected without taking part. Null and empty
texts have no words, so they fail it. Null languages and sources form groups of
their own. Repeated rows each count and each give a row. An empty table gives
an empty result; only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
H, QUANTILE, REWEIGHT, MIN_GROUP, STILL = 0.6, 0.999, 0.975, 100, 1e-3
FEATURES = ("word_length", "symbols", "repeats", "same_lines", "capitals", "marks")
P = len(FEATURES)
#: the least standard deviation of each feature
FLOORS = np.array([0.05, 0.05, 0.12, 0.12, 0.05, 0.05])
#: the least eigenvalue of a covariance
LEAST = 1e-6
#: features are put on a grid of this many steps a unit for their medians
GRID = 1000
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = b"0123456789.,;:!?\"'()-_=+/\\@~^`[]{}"
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the feature vector."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    same = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        until = 0  # words before this one are counted
        for i, x in enumerate(windows):
            if often[x] > 1:
                repeat += i + 3 - max(i, until)
                until = i + 3
    counts = [n, chars, symbols, same, repeat]
    if not n:
        return counts, [0.0] * P
    share = lambda k, of: math.sqrt(k / of) if of else 0.0
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    marks = len(data) - len(data.translate(None, _MARKS))
    return counts, [math.log(chars / n), share(symbols, chars), share(repeat, n), share(same, len(lines)), share(capitals, chars), share(marks, chars)]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch["text"]]
        counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
        x = np.array([r[1] for r in rows]).reshape(-1, P)
        columns = [pa.array(counts[:, i]) for i in range(5)] + [pa.array(x[:, i]) for i in range(P)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["source"], *columns], names=["doc_id", "lang", "source", *_COUNTS, *FEATURES])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts of the base rule, base_failed, and the features, stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS) + "".join(f", {c} double" for c in FEATURES)
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stored(rows.mapInArrow(_measured, ddl).withColumn("base_failed", failed), "quality_statistics")


def chi2_cdf(x: float, df: int) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def consistency(share: float) -> float:
    """What the covariance of the share of normal rows nearest the centre must be multiplied by."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2) if share < 1 else 1.0


def inverse(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Mean, upper triangle of the inverse (off-diagonal doubled) and log determinant of cov, its variances those of FLOORS at least."""
    cov = cov + np.diag(np.maximum(FLOORS**2 - np.diag(cov), 0))
    low = np.linalg.eigvalsh(cov)[0]
    if low < LEAST:  # statistics that depend on each other
        cov = cov + np.eye(P) * (LEAST - low)
    inv = np.linalg.inv(cov)
    return mean.tolist(), [float(inv[i, j] * (1 if i == j else 2)) for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1])


def _estimates(factor: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"s{i}_{j}"] / r["n"] - mean[i] * mean[j]
                out.append((r["g"], r["start"], *inverse(mean, cov * factor)))
            g, start, mean, inv, det = zip(*out, strict=True) if out else ((),) * 5
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(start, pa.int32()), pa.array(mean, floats), pa.array(inv, floats), pa.array(det, pa.float64())], names=["g", "start", "mean", "inv", "logdet"])

    return run


_ESTIMATE = "g string, start int, mean array<double>, inv array<double>, logdet double"


def _fit(rows: DataFrame, factor: float) -> DataFrame:
    """Estimates from the sums of rows(g, start, features)."""
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s{i}_{j}") for i, j in _PAIRS]
    return stored(rows.groupBy("g", "start").agg(F.count("*").alias("n"), *sums).mapInArrow(_estimates(factor), _ESTIMATE), "estimates")


def _distance() -> Column:
    gap = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    return sum((gap[i] * gap[j] * F.col("inv")[k] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    return rows.join(estimates, "g").withColumn("d2", F.greatest(_distance(), F.lit(0.0)))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(1e-6)) * 16).cast("int")


def _median_start(x: DataFrame) -> DataFrame:
    """Medians and quartile ranges from counts on a grid."""
    long = x.select("g", F.posexplode(F.array(*(F.floor(F.col(f) * GRID).cast("int") for f in FEATURES))).alias("f", "v"))
    counts = long.groupBy("g", "f", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("g", "f").orderBy("v")
    below = F.sum("n").over(order)
    total = F.sum("n").over(Window.partitionBy("g", "f"))
    at = [F.min(F.when(F.col("below") >= q * F.col("total"), F.col("v"))) / GRID for q in (0.25, 0.5, 0.75)]
    quartiles = counts.select("g", "f", "v", below.alias("below"), total.alias("total")).groupBy("g", "f").agg(at[0].alias("low"), at[1].alias("mid"), at[2].alias("high"))
    wide = quartiles.groupBy("g").agg(*(F.max(F.when(F.col("f") == i, F.struct("low", "mid", "high"))).alias(f"q{i}") for i in range(P)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            made = [inverse(np.array([r[f"q{i}"]["mid"] for i in range(P)]), np.diag([((r[f"q{i}"]["high"] - r[f"q{i}"]["low"]) / 1.349) ** 2 for i in range(P)])) for r in rows]
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r["g"] for r in rows], pa.string()), pa.array([0] * len(rows), pa.int32()), pa.array([m[0] for m in made], floats), pa.array([m[1] for m in made], floats), pa.array([m[2] for m in made], pa.float64())], names=["g", "start", "mean", "inv", "logdet"])

    return wide.mapInArrow(run, _ESTIMATE)


def mcd(x: DataFrame, h: float = H) -> DataFrame:
    """The reweighted estimates of x(g, features): one row for each group."""
    moving = stored(_median_start(x).union(_fit(x.withColumn("start", F.lit(1)), 1.0)), "starts")
    settled: DataFrame | None = None
    while moving.limit(1).count():
        # rows of groups that still move; there is an estimate or two for each group
        far = _with_distance(x, moving)
        counts = far.groupBy("g", "start", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
        group = Window.partitionBy("g", "start")
        within = F.sum("n").over(group.orderBy("bin"))
        edges = counts.select("g", "start", "bin", within.alias("within"), F.sum("n").over(group).alias("total")).where(F.col("within") >= F.lit(h) * F.col("total"))
        edges = stored(moving.join(edges.groupBy("g", "start").agg(F.min("bin").alias("edge")), ["g", "start"]), "edges")
        new = _fit(_with_distance(x, edges).where(_bin(F.col("d2")) <= F.col("edge")), consistency(h))
        old = moving.select("g", "start", F.struct("mean", "inv", "logdet").alias("old"))
        # the first subset's determinant isn't comparable with a start's, so a start counts as larger than any
        falls = (F.col("old.logdet") - F.col("logdet") > STILL) if settled is not None else F.lit(True)
        both = stored(new.join(old, ["g", "start"]).withColumn("falls", falls), "steps")
        better = F.when(F.col("logdet") <= F.col("old.logdet"), F.struct("mean", "inv", "logdet")).otherwise(F.col("old"))
        done = both.where("not falls").select("g", "start", better.alias("e")).select("g", "start", "e.*")
        settled = done if settled is None else settled.unionByName(done)
        moving = both.where("falls").select("g", "start", "mean", "inv", "logdet")
    estimates = settled if settled is not None else moving
    best = stored(estimates.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inv", "logdet"), F.struct("logdet", "start")).alias("e")).select("g", "e.*"), "best")
    near = _with_distance(x, best).where(F.col("d2") <= chi2_quantile(REWEIGHT, P)).drop("mean", "inv", "logdet")
    return _fit(near, consistency(REWEIGHT))


def judge(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row for each row of docs(doc_id, text, lang, source), with the counts, the distance and the verdict."""
    rows = measure(docs)
    usable = rows.where(~F.col("base_failed"))
    by_source = usable.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    own = F.to_json(F.struct("lang", "source"))
    whole = F.to_json(F.struct("lang"))
    g = F.when(F.col("n") >= MIN_GROUP, own).when(F.col("n_lang") >= MIN_GROUP, whole).otherwise(F.lit("*"))
    groups = stored(by_source.join(by_lang, "lang").select("lang", "source", g.alias("g"), whole.alias("l")), "groups")
    named = stored(usable.join(groups, ["lang", "source"]).select("g", "l", *FEATURES), "features")
    # small groups borrow estimates that are made from all rows of the language, or all rows
    borrowed = groups.where("g = l").select("l").distinct()
    everyone = groups.where("g = '*'").limit(1).select(F.lit("*").alias("g"))
    sets = named.where(~F.col("g").isin("*") & (F.col("g") != F.col("l"))).select("g", *FEATURES)
    sets = sets.unionByName(named.join(borrowed, "l", "left_semi").select(F.col("l").alias("g"), *FEATURES))
    if everyone.count():
        sets = sets.unionByName(named.select(F.lit("*").alias("g"), *FEATURES))
    estimates = mcd(stored(sets, "feature_sets"))
    limits = stored(groups.select("lang", "source", "g").join(estimates, "g"), "limits")
    joined = rows.join(limits, ["lang", "source"], "left")
    d2 = F.when(~F.col("base_failed"), F.greatest(_distance(), F.lit(0.0)))
    kept = ~F.col("base_failed") & F.coalesce(d2 <= chi2_quantile(quantile, P), F.lit(True))
    return joined.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), d2.alias("distance2"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", *_COUNTS, "base_failed", "kept", F.round("distance2", 6).alias("distance2"))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
