"""A stored search index: posting lists, frequencies and features of documents, written in segments.

An index is a folder of four tables. `postings` has a row for each key of each
document, with the letters of those of five lists (intent terms, k-grams of
calls, fingerprints, words, words of names) in which it stands; `frequencies`
says how many documents have a term; `features` holds what ranking needs of a
document, but for k-grams and fingerprints, which are made of its calls; `files`
says which segment has a file's rows. The first two are dealt to BUCKETS folders
by key and each of their files is sorted by it, so a query reads the folders and
the pages of its own keys. Postings are written by the tasks that read their
features, so no step shuffles features or postings, and none sorts features.

An update compares digests of files and writes the rows of those that are new
or changed into a segment of its own; `files` is written last and makes the
segment valid. Of a file's rows those of its last segment count. Frequencies
are differences to the segments before, so they add up over segments. A segment
that was cut short is no part of the index and is written over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bounded
from ..functions.text import kgrams, winnowed

#: posting lists and the feature that each is made of
LISTS = {"t": "intent", "g": "grams", "f": "fingerprints", "w": "words", "n": "name_words"}
#: lists whose terms are weighed by their rarity
WEIGHED = ("t", "w")
BUCKETS = 32
FEATURES = ("words", "name_words", "intent", "calls", "kinds", "tags")
_STORED = "id string, file string, starred boolean, " + ", ".join(f"{c} array<string>" for c in FEATURES)
#: keys that are sorted at once, and posting rows that are handed on at once
PIECE, ROWS = 1_000_000, 100_000
#: up to so many candidates, or changed files, are broadcast; more candidates are found by their features' lists, which the posting lists were made of
FEW = 50_000

Key = tuple[str, str]


def bucket_of(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


def fingerprints(grams: Column) -> Column:
    """The winnowed hashes of a chunk's k-grams."""
    return winnowed(F.transform(grams, lambda g: F.md5(g.cast("binary"))))


def featured(docs: DataFrame) -> DataFrame:
    """docs with every feature; lists that it lacks are empty."""
    empty = F.array().cast("array<string>")
    docs = docs.withColumns({c: empty for c in FEATURES if c not in docs.columns})
    if "starred" not in docs.columns:
        docs = docs.withColumn("starred", F.lit(False))
    return docs.withColumn("grams", kgrams(F.col("calls"))).withColumn("fingerprints", fingerprints(F.col("grams")))


class SearchIndex:
    """The index in a folder that driver and executors share; an empty folder is an empty index."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = bounded(spark), folder.rstrip("/")

    # --- tables

    def segments(self) -> list[int]:
        """The numbers of the valid segments: those whose files are listed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/files")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("segment=")]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("segment=")) for p in done)

    def _table(self, name: str, ddl: str) -> DataFrame:
        base = f"{self.folder}/{name}"
        paths = [f"{base}/segment={s}" for s in self.segments()]
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.option("basePath", base).schema(ddl).parquet(*paths)

    def files(self) -> DataFrame:
        """(file, segment, digest, n): each file that the index holds, with its number of documents."""
        rows = self._table("files", "file string, digest string, n bigint, segment int")
        last = rows.groupBy("file").agg(F.max_by(F.struct("segment", "digest", "n"), "segment").alias("x"))
        return last.select("file", "x.*").where("digest is not null")

    def _current(self, rows: DataFrame) -> DataFrame:
        """Of rows(file, segment, ...) those of their files' last segments."""
        if len(self.segments()) < 2:
            return rows
        return rows.join(self.files().select("file", "segment"), ["file", "segment"], "left_semi")

    def size(self) -> int:
        """How many documents the index holds."""
        return self.files().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def postings(self, keys: Iterable[Key]) -> DataFrame:
        """(list, key, id): the documents of each key; only the keys' buckets are read."""
        keys = sorted(set(keys))
        rows = self._table("postings", "list string, key string, id string, file string, segment int, bucket int")
        wanted = F.lit(False)
        for name in sorted({x for x, _ in keys}):
            wanted = wanted | ((F.col("list") == name) & F.col("key").isin([k for x, k in keys if x == name]))
        rows = rows.where(F.col("bucket").isin(sorted({bucket_of(k) for _, k in keys})) & F.col("key").isin(sorted({k for _, k in keys})))
        return _each_list(self._current(rows), LISTS).where(wanted).select("list", "key", "id")

    def frequencies(self, name: str) -> DataFrame:
        """(term, df): in how many documents each term of a list stands."""
        rows = self._table("frequencies", "list string, key string, n bigint, segment int, bucket int").where(F.col("list") == name)
        if len(self.segments()) > 1:
            rows = rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
        return rows.select(F.col("key").alias("term"), F.col("n").alias("df"))

    def features(self, ids: DataFrame | None = None) -> DataFrame:
        """The features of the documents of ids(id), or of all."""
        rows = self._current(self._table("features", f"{_STORED}, segment int"))
        if ids is not None:
            rows = rows.join(ids, "id", "left_semi")
        return featured(rows.drop("segment"))

    # --- queries

    def candidates(self, keys: Iterable[Key]) -> DataFrame:
        """(id): the documents that stand in the list of any key."""
        return self.postings(keys).select("id").distinct()

    def chosen(self, keys: Iterable[Key]) -> DataFrame:
        """The features of the candidates."""
        keys = sorted(set(keys))
        found = self.candidates(keys)
        if found.limit(FEW + 1).count() <= FEW:
            return self.features(F.broadcast(found))
        held = F.lit(False)
        for name in sorted({x for x, _ in keys}):
            held = held | F.coalesce(F.arrays_overlap(LISTS[name], F.array(*(F.lit(k) for x, k in keys if x == name))), F.lit(False))
        return self.features().where(held)

    # --- updates

    def update(self, docs: DataFrame, whole: bool = True) -> int:
        """Bring the index to docs(id, file, digest and features); returns the number of changed files.

        digest is of a document's source; files whose documents have kept theirs
        aren't written again. If docs is the whole corpus, files that it lacks
        are removed.
        """
        each = F.array_sort(F.collect_list(F.concat_ws(":", "id", "digest")))
        given = docs.groupBy("file").agg(F.sha2(F.array_join(each, " "), 256).alias("digest"), F.count("*").alias("n"))
        before = self.files().select("file", F.col("digest").alias("old"))
        both = given.join(before, "file", "full" if whole else "left")
        changed = both.where(~F.col("digest").eqNullSafe(F.col("old")))
        segment = max(self.segments(), default=0) + 1
        work = f"{self.folder}/changes/segment={segment}"
        changed.write.mode("overwrite").parquet(work)
        changed = self.spark.read.schema("file string, digest string, n bigint, old string").parquet(work)
        n = changed.count()
        if not n:
            return 0
        # of a first segment every file is new; a join would shuffle whole documents
        new = self._of_files(docs, changed.where("digest is not null")) if self.segments() else docs.where("file is not null")
        new = featured(new).select("id", "file", "starred", *FEATURES)
        new.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.folder}/features/segment={segment}")
        written = self.spark.read.schema(_STORED).parquet(f"{self.folder}/features/segment={segment}")
        self._write("postings", segment, _keys(featured(written), LISTS))
        listed = self.spark.read.schema("list string, key string, bucket int").parquet(f"{self.folder}/postings/segment={segment}")
        counts = listed.withColumn("n", F.lit(1))
        if self.segments():
            was = self._of_files(self.features(), changed.where("old is not null"))
            counts = counts.unionByName(_keys(was, WEIGHED).select("list", "key", "bucket", F.lit(-1).alias("n")))
        within = {x: F.contains("list", F.lit(x)) for x in WEIGHED}
        summed = counts.where(" or ".join(f"contains(list, '{x}')" for x in WEIGHED)).groupBy("key", "bucket").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(x) for x, c in within.items()))
        counts = summed.select("key", "bucket", F.inline(F.array(*(F.struct(F.lit(x).alias("list"), F.col(x).alias("n")) for x in WEIGHED)))).where("n <> 0")
        self._write("frequencies", segment, counts.select("list", "key", "n", "bucket"))
        changed.select("file", "digest", "n").write.mode("overwrite").parquet(f"{self.folder}/files/segment={segment}")
        return n

    def _of_files(self, rows: DataFrame, files: DataFrame) -> DataFrame:
        """rows of the files(file)."""
        files = files.select("file")
        return rows.join(F.broadcast(files) if files.count() <= FEW else files, "file", "left_semi")

    def _write(self, table: str, segment: int, rows: DataFrame) -> None:
        """One segment of a table: a file for each bucket of each task, sorted by key."""
        rows.sortWithinPartitions("bucket", "key").write.option("compression", "zstd").mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/segment={segment}")

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def compacted(self, folder: str) -> SearchIndex:
        """The same index in another folder, in one segment."""
        out = SearchIndex(self.spark, folder)
        digests = self.files().select("file", F.col("digest").alias("digest"))
        out.update(self.features().drop("grams", "fingerprints").join(digests, "file"))
        return out


def _each_list(rows: DataFrame, lists: Iterable[str]) -> DataFrame:
    """rows(list, ...) with a row for each of the lists that `list` names."""
    named = F.filter(F.array(*(F.lit(x) for x in lists)), lambda x: F.contains("list", x))
    return rows.withColumn("list", F.explode(named))


def _keys(rows: DataFrame, lists: Iterable[str]) -> DataFrame:
    """(list, key, id, file, bucket): each key once for each document, with the lists in which it stands."""
    lists = tuple(lists)
    wide = rows.select("id", "file", *(F.col(LISTS[x]) for x in lists))
    return wide.mapInArrow(lambda x: _posted(x, lists), "list string, key string, id string, file string, bucket int")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches(id, file, lists) dealt anew: each piece holds PIECE keys and documents, and of its last document the rest."""
    held, total = [], 0
    for batch in batches:
        sizes = 1 + sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
        ends, low = total + np.cumsum(sizes), 0
        while low < batch.num_rows and ends[-1] >= PIECE:
            high = int(np.searchsorted(ends, PIECE)) + 1
            yield pa.concat_batches([*held, batch.slice(low, high - low)])
            ends, held, low = ends - ends[high - 1], [], high
        held, total = [*held, batch.slice(low)], int(ends[-1]) if len(ends) else total
    if held:
        yield pa.concat_batches(held)


def _posted(batches: Iterator[pa.RecordBatch], lists: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The postings of batches(id, file, lists), in runs sorted by bucket, key and document."""
    names = pa.array(["".join(x for i, x in enumerate(lists) if m >> i & 1) for m in range(1 << len(lists))])
    for part in _pieces(batches):
        ids, files, columns = part.column(0), part.column(1), part.columns[2:]
        flat = pa.concat_arrays([c.flatten() for c in columns])
        doc = np.concatenate([pc.list_parent_indices(c).to_numpy().astype(np.int64) for c in columns])
        mark = np.repeat(1 << np.arange(len(columns)), [len(c.flatten()) for c in columns])
        coded = flat.dictionary_encode()
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        code = coded.indices.fill_null(0).to_numpy()[there].astype(np.int64)
        if not len(code):
            continue
        bucket = np.fromiter((zlib.crc32(k.as_buffer()) % BUCKETS for k in coded.dictionary), np.int32, len(coded.dictionary))
        order = pc.sort_indices(pa.table({"b": bucket, "k": coded.dictionary}), sort_keys=[("b", "ascending"), ("k", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # a document's key is one number, by which the lists that hold it meet
        both = rank[code] * part.num_rows + doc[there]
        by = np.argsort(both, kind="stable")
        both = both[by]
        starts = np.flatnonzero(np.diff(both, prepend=-1))
        mark = np.bitwise_or.reduceat(mark[there][by], starts)
        key, at = order[both[starts] // part.num_rows], both[starts] % part.num_rows
        for i in range(0, len(key), ROWS):
            k, d = key[i : i + ROWS], at[i : i + ROWS]
            columns = [names.take(pa.array(mark[i : i + ROWS])), coded.dictionary.take(pa.array(k)), ids.take(pa.array(d)), files.take(pa.array(d)), pa.array(bucket[k])]
            yield pa.RecordBatch.from_arrays(columns, ["list", "key", "id", "file", "bucket"])
