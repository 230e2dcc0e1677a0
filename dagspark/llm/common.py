"""What the operators share: the shared scratch folder, lower-casing and row keys."""

from __future__ import annotations

import atexit
import os
import shutil
import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: bytes.translate table that lower-cases A-Z and nothing else
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


#: bytes of an Arrow batch; whole texts go to Python, so rows say little of a batch's size
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with the Arrow batches that its tasks exchange with Python bounded in bytes, and shuffle files removed when their query has ended."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set only where unset, which is for a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"/tmp/checkpoints/dagspark-{os.getpid()}"
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than a reread, and plan
    branches that use the table twice don't compute it twice.
    """
    spark = bounded(df.sparkSession)
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing is read any more; what was made of them is stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: bits of a Bloom filter: BLOOM_WORDS rows of 64 at most, which bounds what is broadcast however much goes in
BLOOM_WORDS = 1 << 18


def bloom(values: DataFrame) -> DataFrame:
    """(bloom_word, bloom_bits), stored: a Bloom filter of the single column of values, of at most BLOOM_WORDS rows."""
    h = F.xxhash64(values.columns[0])
    bit = F.shiftrightunsigned(h, 20).bitwiseAND(63).cast("int")
    bits = values.select(h.bitwiseAND(F.lit(BLOOM_WORDS - 1)).alias("bloom_word"), F.expr("1L").alias("one"), bit.alias("bit"))
    return stored(bits.groupBy("bloom_word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bloom_bits")), "bloom")


def perhaps_in(df: DataFrame, column: str, of: DataFrame) -> DataFrame:
    """The rows whose column may be one of the values of a Bloom filter: all that are, and the fewer others the fewer values it has."""
    h = F.xxhash64(column)
    held = F.expr(f"shiftrightunsigned(bloom_bits, cast(shiftrightunsigned(xxhash64(`{column}`), 20) & 63 as int)) & 1")
    return df.join(F.broadcast(of), h.bitwiseAND(F.lit(BLOOM_WORDS - 1)) == F.col("bloom_word")).where(held == 1).drop("bloom_word", "bloom_bits")


@contextmanager
def opened(folder: str, name: str) -> Iterator[IO[bytes]]:
    """A new file in a folder that is local to all or that Arrow opens; it gets its name when it is whole, so a task may run again."""
    parsed = urlparse(folder)
    if parsed.scheme in ("", "file"):
        os.makedirs(parsed.path, exist_ok=True)
        with open(part := f"{parsed.path}/.{name}.{uuid.uuid4().hex}", "wb") as f:
            yield f
        os.replace(part, f"{parsed.path}/{name}")
        return
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}") as f:
        yield f


def openable(path: str) -> bool:
    """Whether Arrow knows the path's file system."""
    from pyarrow.fs import FileSystem

    try:
        FileSystem.from_uri(path)
    except (OSError, ValueError):  # what Arrow raises for schemes that it lacks
        return False
    return True


def reading(path: str) -> IO[bytes]:
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path)
    return fs.open_input_stream(name, compression=None)


def spare(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table read by df with a bigint column `name`: a number of each row, the same in every scan.

    It is made of the row's file and its place in it, so it depends neither on
    how files are dealt to tasks nor on lost executors. What isn't read from
    Parquet is stored with its numbers first. Columns of df may have any names
    but `name` itself.
    """
    if spare(df, name) != name:
        raise ValueError(f"there is a column {name} already")
    if not df.inputFiles():
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    file, place, nth = (spare(df, c) for c in ("_file", "_place", "_nth"))
    read = df.metadataColumn("_metadata")
    files = stored(df.select(read["file_path"].alias(file)).groupBy(file).agg(F.count("*").alias("_rows")), "files")
    order = stored(files.select(file, (F.row_number().over(Window.orderBy(file)) - 1).cast("bigint").alias(nth)), "numbered_files")
    placed = df.select("*", read["file_path"].alias(file), read["row_index"].alias(place))
    number = F.shiftleft(F.col(nth), 40).bitwiseOR(F.col(place))
    return placed.join(order, file).withColumn(name, number).drop(file, nth, place)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z; every other character stays. Where all are ASCII, lower() does that faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def doc_key(c: str | Column) -> Column:
    """crc32 of an id as text, unsigned; null counts as the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


#: between words made of digits, lower-cased ASCII letters and anything beyond ASCII
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded_words(text: Column) -> Column:
    """The text's lower-cased words, each with one space before it, and one space at the end; ' ' if none."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.when(F.trim(spaced) == "", F.lit("")).otherwise(F.lit(" ")))


def spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint")
