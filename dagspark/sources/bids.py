"""BIDS folders: recordings with what their side-car files say, inherited down the folder tree.

A file's name is a chain of entities (key-value) and a suffix. A side-car
applies to a recording if it lies in the recording's folder or one above it and
has none but the recording's entities; `electrodes`, `channels` and `events`
are tables, metadata are JSON of the recording's own suffix. Of metadata every
key counts as the nearest file says it; of tables the nearest file counts.
Nearest is the one in the deepest folder, and there the one with most entities.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tabular import ROW
from .edf import load_edf

# Suffixes of recordings, and of tables beside them.
RECORDINGS = ("eeg", "ieeg", "meg")
TABLES = ("channels", "events", "electrodes")


class BidsError(ValueError):
    """A folder that isn't read as BIDS."""


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, depth, entities, suffix, extension) of the files below a folder; folder is relative, '' at the top."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = root.rstrip("/") + "/"
    inner = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", "^file:/*", "/")), base, -1)
    name = F.substring_index(inner, "/", -1)
    folder = F.when(F.contains(inner, F.lit("/")), F.expr("left(inner, length(inner) - length(name) - 1)")).otherwise(F.lit(""))
    rows = files.withColumn("inner", inner).withColumn("name", name).withColumn("folder", folder)
    parts = F.split(F.substring_index("name", ".", 1), "_")
    pairs = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.contains(x, F.lit("-")))
    return rows.select(
        "path", "folder", F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(F.split("folder", "/"))).alias("depth"),
        F.array_sort(pairs).alias("entities"), F.element_at(parts, -1).alias("suffix"), F.expr("substring(name, length(substring_index(name, '.', 1)) + 1)").alias("extension"),
    )


def sidecars(files: DataFrame) -> DataFrame:
    """(recording, kind, path, depth, n): the side-cars that apply to each recording; kind is metadata or a table's suffix, n how many entities they have."""
    recordings = files.where(F.col("suffix").isin(*RECORDINGS) & F.col("extension").isin(".edf", ".bdf"))
    parts = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    asked = recordings.select(F.col("path").alias("recording"), F.col("entities").alias("own"), F.col("suffix").alias("of"), F.explode(above).alias("folder"))
    beside = files.where((F.col("extension") == ".json") & F.col("suffix").isin(*RECORDINGS) | (F.col("extension") == ".tsv") & F.col("suffix").isin(*TABLES))
    met = asked.join(beside, "folder").where((F.size(F.array_except("entities", "own")) == 0) & ((F.col("extension") == ".tsv") | (F.col("suffix") == F.col("of"))))
    return met.select("recording", F.when(F.col("extension") == ".json", F.lit("metadata")).otherwise(F.col("suffix")).alias("kind"), "path", "depth", F.size("entities").alias("n"))


@dataclass(frozen=True)
class Bids:
    """The recordings of a folder: (recording, entities, metadata), and the tables of their side-cars."""

    spark: SparkSession
    recordings: DataFrame
    near: DataFrame

    def table(self, kind: str) -> DataFrame:
        """The rows of the recordings' tables of a kind, each with its recording; columns as the files have them."""
        nearest = self.near.where(F.col("kind") == kind).groupBy("recording").agg(F.max_by("path", F.struct("depth", "n")).alias("path"))
        paths = [r.path for r in nearest.select("path").distinct().collect()]  # files, not rows
        if not paths:
            return self.recordings.select("recording").where("false")
        rows = [self.spark.read.option("header", True).option("sep", "\t").option("nullValue", "n/a").csv(p).withColumn("path", F.lit(p)) for p in paths]
        return nearest.join(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), "path").drop("path")

    def channels(self) -> DataFrame:
        return self.table("channels")

    def events(self) -> DataFrame:
        """Events with onset and duration in seconds."""
        rows = self.table("events")
        return rows.withColumns({c: F.col(c).cast("double") for c in ("onset", "duration") if c in rows.columns})

    def samples(self, recording: str | None = None, good_only: bool = False) -> DataFrame:
        """A recording's samples; the only one there is, or the one whose path ends so. good_only leaves out channels marked bad."""
        found = [r.recording for r in self.recordings.select("recording").collect() if recording is None or r.recording.endswith(recording)]
        if len(found) != 1:
            raise BidsError(f"{len(found)} recordings; name one of them" if found else "no recording")
        df = load_edf(self.spark, found[0])
        if not good_only:
            return df
        mine = self.channels()
        if "status" not in mine.columns:
            return df
        bad = {r.name for r in mine.where((F.col("recording") == found[0]) & (F.col("status") == "bad")).select("name").collect()}
        return df.select(*(c for c in df.columns if c == ROW or c not in bad))


def load_bids(spark: SparkSession, root: str) -> Bids:
    files = listed(spark, root)
    near = sidecars(files)
    metadata = near.where(F.col("kind") == "metadata")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path", F.col("content").cast("string").alias("content"))
    merged = F.udf(_merged, "map<string,string>")
    said = metadata.join(content, "path").groupBy("recording").agg(merged(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n", "content"))), lambda x: x["content"])).alias("metadata"))
    own = files.where(F.col("suffix").isin(*RECORDINGS) & F.col("extension").isin(".edf", ".bdf"))
    entities = F.map_from_entries(F.transform("entities", lambda x: F.struct(F.substring_index(x, "-", 1).alias("k"), F.regexp_replace(x, "^[^-]*-", ""))))
    recordings = own.select(F.col("path").alias("recording"), entities.alias("entities")).join(said, "recording", "left")
    return Bids(spark, recordings, near)


def _merged(texts: list[str]) -> dict[str, str]:
    """Metadata of side-cars from the top down, the later ones' keys over the earlier ones'."""
    out: dict[str, str] = {}
    for t in texts:
        out |= {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(t).items()}
    return out
