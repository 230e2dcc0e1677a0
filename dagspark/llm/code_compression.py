"""Operator 12: vector codes by Hamerly's bounded Lloyd iteration over integer parts.

Every component x becomes the integer floor(4096 * x); a vector is cut into
PARTS equal consecutive parts, and each part position has a codebook of at most
ENTRIES entries, at first those parts of the vectors of the smallest vec_ids
(the smaller vector first where a vec_id is repeated).

Each round is one pass over a stored table that keeps, beside each part, its
entry, an upper bound of its distance to that entry and a lower bound of its
distance to the second nearest. When the codebooks have moved, the upper bound
grows by its own entry's move and the lower one falls by the largest move of
any other; both are rounded away from each other, so they hold in floating
point. A part whose upper bound is strictly below its lower bound, or strictly
below half of the distance from its entry to the nearest other entry, keeps its
entry. Otherwise the upper bound is first made exact; if that fails too, all
integer distances are computed and the lowest index of the least one is taken.
A tie never passes a strict bound, so ties always go to the lower index.

A task writes its rows and, beside them, its sums and counts for each entry;
those are added up by Spark and PARTS * ENTRIES sums come to the driver. Every
round's table is written to the shared folder, so a lost executor costs a
task's rereading.

Rows are dropped whose vector is null, or holds null or non-finite components;
so are vectors of another length than the most frequent (ties: longer). That
length must be a multiple of PARTS. Repeated rows each give a row, and a null
vec_id is larger than all others. With fewer kept rows than ENTRIES the
codebooks have as many entries as rows; without any the result is empty. Components
that the sums of squares of a vector can't hold in 64 bits raise an error. Only vec_id,
embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, forget, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: sums by label are broadcast up to this many labels, else joined by a shuffle
BROADCAST_LABELS = 100_000
_STATE = "vec_id {id}, label {label}, parts array<long>, entry array<int>, upper array<double>, lower array<double>, error long, part int, at int, n long, sums array<long>, is_sum boolean"


def floors(embedding: str = "embedding") -> F.Column:
    """The vector's integers, or null if it is dropped."""
    x = F.col(embedding)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts x(n, width) to the entries of a codebook(k, width)."""
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of parts: the nearest entry (lowest index of ties), its squared distance, the upper and the lower bound."""
    d = distances(x, book)
    entry = d.argmin(1)
    least = np.take_along_axis(d, entry[:, None], 1)[:, 0]
    np.put_along_axis(d, entry[:, None], np.iinfo(np.int64).max, 1)
    second = d.min(1) if len(book) > 1 else np.full(len(x), np.iinfo(np.int64).max)
    return entry, least, up(np.sqrt(least.astype(np.float64))), down(np.sqrt(second.astype(np.float64)))


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry has moved, rounded up, and for each entry the largest move of any other."""
    moved = ((new - old) ** 2).sum(1)
    far = np.where(moved > 0, up(np.sqrt(moved.astype(np.float64))), 0.0)
    others = np.array([max(np.delete(far, j), default=0.0) for j in range(len(far))])
    return far, others


def halves(book: np.ndarray) -> np.ndarray:
    """Half of each entry's distance to the nearest other, rounded down."""
    if len(book) == 1:
        return np.full(1, np.inf)
    d = distances(book, book).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return down(np.sqrt(d.min(1)) / 2)


def reassign(x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """One part position's entries, squared distances and bounds once old has become new, and how many parts were scanned."""
    far, others = moves(old, new)
    upper, lower = up(upper + far[entry]), down(lower - others[entry])
    bar = np.maximum(lower, halves(new)[entry])
    own = ((x - new[entry]) ** 2).sum(1)
    loose = ~(upper < bar)
    upper[loose] = up(np.sqrt(own[loose].astype(np.float64)))
    open_ = np.flatnonzero(loose & ~(upper < bar))
    entry = entry.copy()
    if len(open_):
        entry[open_], own[open_], upper[open_], lower[open_] = scan(x[open_], new)
    return entry, own, upper, lower, len(open_)


Books = list[np.ndarray]


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A two-dimensional array as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.reshape(-1), kind))


def _pass(batches: Iterator[pa.RecordBatch], schema: pa.Schema, old: Books | None, new: Books) -> Iterator[pa.RecordBatch]:
    """The state after an assignment to the codebooks new, then the sums of each entry's parts."""
    k, width = new[0].shape
    sums, counts = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        x = batch["parts"].flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS, width)
        entry, upper, lower, error = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS)), np.zeros((n, PARTS)), np.zeros(n, np.int64)
        if old:
            before = [batch[c].flatten().to_numpy(zero_copy_only=False).reshape(n, PARTS) for c in ("entry", "upper", "lower")]
        for p in range(PARTS):
            if old:
                entry[:, p], own, upper[:, p], lower[:, p], _ = reassign(x[:, p], before[0][:, p].astype(np.int64), before[1][:, p], before[2][:, p], old[p], new[p])
            else:
                entry[:, p], own, upper[:, p], lower[:, p] = scan(x[:, p], new[p])
            error += own
            np.add.at(sums[p], entry[:, p], x[:, p])
            counts[p] += np.bincount(entry[:, p], minlength=k)
        made = {"vec_id": batch["vec_id"], "label": batch["label"], "parts": batch["parts"], "entry": _lists(entry, pa.int32()), "upper": _lists(upper, pa.float64()), "lower": _lists(lower, pa.float64()), "error": pa.array(error), "is_sum": pa.array(np.zeros(n, bool))}
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in schema], schema=schema)
    used = np.argwhere(counts)
    made = {"part": pa.array(used[:, 0]), "at": pa.array(used[:, 1]), "n": pa.array(counts[*used.T]), "sums": _lists(sums[*used.T], pa.int64()), "is_sum": pa.array(np.ones(len(used), bool))}
    yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(used), f.type) for f in schema], schema=schema)


def assigned(state: DataFrame, old: Books | None, new: Books) -> tuple[DataFrame, DataFrame]:
    """Every part's entry among new, stored, and the sums of each task; state has bounds for old, or no bounds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    ddl = _STATE.format(id=kinds["vec_id"], label=kinds["label"])
    schema = to_arrow_schema(state.sparkSession.createDataFrame([], ddl).schema)
    out = stored(state.mapInArrow(lambda x: _pass(x, schema, old, new), ddl), "vector_parts", ["is_sum"])
    return out, out.where("is_sum")


def moved(books: Books, sums: DataFrame) -> Books:
    """The codebooks once each used entry has become the floor of its parts' mean."""
    width = books[0].shape[1]
    added = sums.groupBy("part", "at").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    books = [b.copy() for b in books]
    for r in added.collect():
        books[r["part"]][r["at"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Books]:
    """(vec_id, label, entry, error) of vectors(vec_id, embedding, label), and the final codebooks of each part position."""
    spark = bounded(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", floors().alias("parts")).where("parts is not null")
    most = rows.groupBy(F.size("parts").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if most is None or not most["size"]:
        return spark.createDataFrame([], _STATE.format(id=kinds["vec_id"], label=kinds["label"])).select("vec_id", "label", "entry", "error"), []
    width, left = divmod(most["size"], PARTS)
    if left:
        raise ValueError(f"vectors of {most['size']} components can't be cut into {PARTS} equal parts")
    rows = stored(rows.where(F.size("parts") == most["size"]), "vectors")
    limit = int((2**63 / (4 * most["size"])) ** 0.5)
    if rows.select(F.max(F.array_max(F.transform("parts", F.abs)))).first()[0] >= limit:
        raise ValueError(f"components of {limit / SCALE} or more have distances beyond 64 bits")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "parts").limit(entries).select("parts").collect()
    start = np.array([r["parts"] for r in first], np.int64).reshape(len(first), PARTS, width)
    old, new, state = None, [start[:, p].copy() for p in range(PARTS)], rows
    for _ in range(rounds):
        done, sums = assigned(state, old, new)
        forget(state)
        state, old, new = done.where("not is_sum"), new, moved(new, sums)
        state.stored_at = done.stored_at
    done, _ = assigned(state, old, new)
    forget(state)
    return done.where("not is_sum").select("vec_id", "label", "entry", "error"), new


def digest(books: Books) -> str:
    """sha256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of vectors."""
    rows, books = compress(vectors)
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    of = by_label.select(F.col("label").alias("of_label"), "label_error")
    named = rows.join(of, F.col("label").eqNullSafe(F.col("of_label")))
    return named.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out: parts by component, distances by joins with the codebook."""
    out = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT r, ((i - 1) // (len(embedding) // {PARTS}))::INT AS part, ((i - 1) % (len(embedding) // {PARTS}))::INT AS pos,
    floor(embedding[i]::DOUBLE * {SCALE})::BIGINT AS x
  FROM kept, unnest(range(1, len(embedding) + 1)) AS u(i)),
book0 AS MATERIALIZED (SELECT part, (r - 1)::INT AS e, pos, x AS v FROM comps WHERE r <= {ENTRIES})"""
    for i in range(ROUNDS + 1):
        out += f""",
dist{i} AS (SELECT r, part, e, sum((x - v) * (x - v))::BIGINT AS d FROM comps JOIN book{i} USING (part, pos) GROUP BY ALL),
near{i} AS MATERIALIZED (SELECT r, part, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM dist{i} GROUP BY ALL)"""
        if i < ROUNDS:
            out += f""",
mean{i} AS (SELECT part, e, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS v FROM comps JOIN near{i} USING (r, part) GROUP BY ALL),
book{i + 1} AS MATERIALIZED (SELECT part, e, pos, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (part, e, pos))"""
    return out + f""",
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


QUERIES = {"op12_code_compression": op12_code_compression}
ORACLE_SQL = {"op12_code_compression": _sql()}
