"""Sources: CSV, Parquet, JSON, NumPy arrays, interleaved binary recordings, and URIs."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tabular import ROW, with_row_id
from .bids import load_bids
from .edf import load_edf


class SourceError(ValueError):
    """A file that can't be read as asked."""


def resolve(uri: str) -> str:
    """A path for Spark's readers: s3:// becomes s3a://, local paths are made absolute, others stay."""
    scheme = urlparse(uri).scheme
    if scheme == "s3":
        return "s3a" + uri[2:]
    if scheme in ("", "file") or len(scheme) == 1:
        return os.path.abspath(os.path.expanduser(urlparse(uri).path if scheme == "file" else uri))
    return uri


def sniff(uri: str) -> str | None:
    """nwb or bids if the path shows it, else None."""
    if uri.lower().rstrip("/").endswith(".nwb"):
        return "nwb"
    path = resolve(uri)
    return "bids" if os.path.isfile(os.path.join(path, "dataset_description.json")) else None


def load_table(spark: SparkSession, path: str, delimiter: str = ",", file_format: str = "csv") -> DataFrame:
    """A table with row ids; http(s) files are fetched to the executors by Spark."""
    at = resolve(path)
    if urlparse(at).scheme in ("http", "https"):
        from pyspark import SparkFiles

        spark.sparkContext.addFile(at)
        at = "file://" + SparkFiles.get(os.path.basename(urlparse(at).path))
    if file_format == "csv":
        df = spark.read.option("header", True).option("sep", delimiter).option("inferSchema", True).csv(at)
    elif file_format in ("parquet", "json", "orc"):
        df = getattr(spark.read, file_format)(at)
    else:
        raise SourceError(f"no reader for the format {file_format!r}")
    return with_row_id(df)


def load_array(spark: SparkSession, path: str) -> DataFrame:
    """A .npy array as columns ch0, ch1, ...: one value, a column, or an array flattened to two dimensions."""
    files = spark.read.format("binaryFile").load(resolve(path)).select("content")
    head = np.lib.format
    first = files.select(F.substring("content", 1, 4096).alias("h")).first()
    if first is None:
        raise SourceError(f"no array at {path}")
    buffer = io.BytesIO(bytes(first.h))
    version = head.read_magic(buffer)
    shape = (head.read_array_header_1_0 if version == (1, 0) else head.read_array_header_2_0)(buffer)[0]
    width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    names = [f"ch{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                x = np.load(io.BytesIO(content), allow_pickle=False)
                x = np.asarray(x, float).reshape(len(x) if x.ndim else 1, -1)
                yield pd.DataFrame(x, columns=names).assign(**{ROW: np.arange(len(x))})[[ROW, *names]]

    return files.mapInPandas(run, f"{ROW} long, " + ", ".join(f"{n} double" for n in names))


def load_binary_recording(spark: SparkSession, path: str, num_channels: int, dtype: str = "int16") -> DataFrame:
    """Interleaved samples; Spark's fixed-length reader splits the file, so no task holds it whole."""
    kind = np.dtype(dtype)
    if num_channels < 1:
        raise SourceError("num_channels must be given for a binary recording")
    frame = kind.itemsize * num_channels
    names = [f"ch{i}" for i in range(num_channels)]
    size = spark.read.format("binaryFile").load(resolve(path)).agg(F.sum("length")).first()[0] or 0
    block = frame * max(1, (1 << 22) // frame)
    starts = spark.range(0, -(-size // block)).select((F.col("id") * block).alias("start")).repartition(max(1, min(-(-size // block), 4096)))
    at = resolve(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(at if urlparse(at).scheme else f"file://{at}")
        with fs.open_input_file(inner) as f:
            for pdf in batches:
                for start in pdf["start"]:
                    data = f.read_at(block, int(start))
                    x = np.frombuffer(data[: len(data) // frame * frame], kind).reshape(-1, num_channels)
                    yield pd.DataFrame(x.astype(float), columns=names).assign(**{ROW: np.arange(len(x)) + int(start) // frame})[[ROW, *names]]

    return starts.mapInPandas(run, f"{ROW} long, " + ", ".join(f"{n} double" for n in names))


def rename_spikes(df: DataFrame, time_column: str = "time", unit_column: str = "unit") -> DataFrame:
    """The time column becomes `time` (the first if there is none of the name), the unit column `unit`."""
    columns = [c for c in df.columns if c != ROW]
    time = time_column if time_column in columns else columns[0]
    others = [c for c in columns if c != time]
    unit = unit_column if unit_column in columns else others[0] if others else None
    names = {time: "time"} | ({unit: "unit"} if unit else {})
    return df.withColumnsRenamed(names)


#: formats a signal can be loaded from here, and those whose readers are packages of their own
_SIGNAL_FORMATS = {"eeg": ("csv", "npy", "edf", "fif", "nwb"), "lfp": ("csv", "npy"), "spike": ("csv", "npy"), "calcium": ("csv", "npy")}
_PACKAGES = {"fif": "mne", "nwb": "pynwb"}


def load_signal(spark: SparkSession, path: str, signal: str, file_format: str = "csv", delimiter: str = ",", time_column: str = "time", unit_column: str = "unit") -> DataFrame:
    """A recording or spike train by its signal type; .nwb files and BIDS folders are told by their path."""
    if signal not in _SIGNAL_FORMATS:
        raise SourceError(f"unknown signal type {signal!r}")
    file_format = sniff(path) or file_format
    if file_format in _PACKAGES:
        raise SourceError(f"reading {file_format} needs the package {_PACKAGES[file_format]}, which isn't installed")
    if file_format == "bids":
        return load_bids(spark, resolve(path)).samples()
    if file_format not in _SIGNAL_FORMATS[signal]:
        raise SourceError(f"{signal} has no format {file_format!r}")
    if file_format == "edf":
        return load_edf(spark, resolve(path))
    df = load_array(spark, path) if file_format == "npy" else load_table(spark, path, delimiter)
    return rename_spikes(df, time_column, unit_column) if signal == "spike" else df


def load_repositories(path: str) -> list[dict]:
    """The registry of code libraries: a JSON list of objects with id and path; none if the file isn't there."""
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return []


def save_repositories(path: str, entries: list[dict]) -> None:
    with open(path, "w") as f:
        json.dump(entries, f, indent=2)
