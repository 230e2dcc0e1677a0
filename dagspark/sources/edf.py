"""EDF and BDF recordings as a Spark data source: the header is read when planning, data records by partitions.

A file is a header, a header for each signal, and data records of equal size
that hold some samples of every signal one after another. Samples are 16 (BDF:
24) bits; each signal has its own scale. Values are physical ones, voltages in
volts. Signals of fewer samples a record than the fastest one keep each value
until the next. Annotation signals are left out. Options: `channels` (names,
comma-separated; all by default) and `records` (data records of a partition).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.tabular import ROW

# Widths of the header's fields, those of each signal, labels of signals that hold annotations, scales of voltages.
HEAD = (("version", 8), ("patient", 80), ("recording", 80), ("date", 8), ("time", 8), ("bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4))
SIGNAL = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
ANNOTATIONS = ("EDF Annotations", "BDF Annotations")
VOLTS = {"V": 1.0, "mV": 1e-3, "uV": 1e-6, "µV": 1e-6, "nV": 1e-9}
#: bytes of a partition's data records, by default
PARTITION_BYTES = 32 << 20


class EdfError(ValueError):
    """A file that isn't EDF, or is cut short."""


@dataclass(frozen=True)
class Signal:
    """A signal of a recording: its first byte in a data record, its samples there, and its scale."""

    label: str
    offset: int
    samples: int
    gain: float
    base: float


@dataclass(frozen=True)
class Header:
    start: int
    records: int
    duration: float
    width: int
    record_bytes: int
    signals: tuple[Signal, ...]

    @property
    def per_record(self) -> int:
        """Samples of the fastest signal in a data record."""
        return max((s.samples for s in self.signals), default=0)

    @property
    def rate(self) -> float:
        return self.per_record / self.duration if self.duration else 0.0


def opened(path: str) -> IO[bytes]:
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path if len(urlparse(path).scheme) > 1 else f"file://{path}")
    return fs.open_input_file(name)


def _number(text: str, what: str) -> float:
    try:
        return float(text.replace(",", "."))
    except ValueError:
        raise EdfError(f"{what} is no number: {text!r}") from None


def read_header(f: IO[bytes]) -> Header:
    """The header of a recording; a number of records that isn't known (-1) follows from the file's size."""
    size = f.seek(0, 2)
    f.seek(0)
    raw = f.read(256)
    if len(raw) < 256 or not (raw[:8].strip() == b"0" or raw[:8] == b"\xffBIOSEMI"):
        raise EdfError("no EDF header")
    width = 3 if raw[:1] == b"\xff" else 2
    head, at = {}, 0
    for name, n in HEAD:
        head[name] = raw[at : at + n].decode("latin-1").strip()
        at += n
    n = int(_number(head["signals"], "the number of signals"))
    raw = f.read(256 * n)
    if len(raw) < 256 * n:
        raise EdfError("the signals' headers are cut short")
    fields, at = {}, 0
    for name, w in SIGNAL:
        fields[name] = [raw[at + i * w : at + (i + 1) * w].decode("latin-1").strip() for i in range(n)]
        at += n * w
    signals, offset = [], 0
    for i in range(n):
        samples = int(_number(fields["samples"][i], "samples of a signal"))
        low, high, dlow, dhigh = (_number(fields[k][i], k) for k in ("physical_min", "physical_max", "digital_min", "digital_max"))
        gain = (high - low) / (dhigh - dlow) if dhigh != dlow else 1.0
        volts = VOLTS.get(fields["unit"][i], 1.0)
        if fields["label"][i] not in ANNOTATIONS:
            signals.append(Signal(fields["label"][i], offset, samples, gain * volts, (low - dlow * gain) * volts))
        offset += samples * width
    start = int(_number(head["bytes"], "the header's size"))
    records = int(_number(head["records"], "the number of records"))
    there = (size - start) // offset if offset else 0
    if records > there:
        raise EdfError(f"the file has {there} of {records} data records")
    return Header(start, there if records < 0 else records, _number(head["duration"], "the duration"), width, offset, tuple(_named(signals)))


def _named(signals: list[Signal]) -> list[Signal]:
    """Signals with names of their own: repeated ones are numbered, whatever the case of their letters."""
    seen: dict[str, int] = {}
    out = []
    for s in signals:
        k = s.label.lower()
        seen[k] = seen.get(k, 0) + 1
        label = s.label if seen[k] == 1 else f"{s.label}-{seen[k]}"
        out.append(Signal(label or f"ch{len(out)}", s.offset, s.samples, s.gain, s.base))
    return out


def values(data: bytes, header: Header, signal: Signal) -> np.ndarray:
    """The physical values of a signal in whole data records, as many as the fastest signal has."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, header.record_bytes)[:, signal.offset : signal.offset + signal.samples * header.width]
    if header.width == 2:
        x = np.ascontiguousarray(raw).view("<i2").astype(float)
    else:
        b = raw.reshape(len(raw), -1, 3).astype(np.int32)
        x = ((b[..., 0] | b[..., 1] << 8 | b[..., 2] << 16) ^ 0x800000) - 0x800000
    held = np.arange(header.per_record) * signal.samples // header.per_record
    return (x[:, held] * signal.gain + signal.base).ravel()


class Records(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class EdfSource(DataSource):
    """spark.read.format("edf"): row ids and a column for each signal."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def header(self) -> Header:
        if not (path := self.options.get("path")):
            raise EdfError("a path must be given")
        with opened(path) as f:
            return read_header(f)

    def chosen(self, header: Header) -> list[Signal]:
        wanted = [c.strip() for c in self.options.get("channels", "").split(",") if c.strip()]
        by_name = {s.label: s for s in header.signals}
        if missing := [c for c in wanted if c not in by_name]:
            raise EdfError(f"no channels {', '.join(missing)}")
        return [by_name[c] for c in wanted] if wanted else list(header.signals)

    def schema(self) -> StructType:
        return StructType([StructField(ROW, LongType()), *(StructField(s.label, DoubleType()) for s in self.chosen(self.header()))])

    def reader(self, schema: StructType) -> EdfReader:
        header = self.header()
        by_name = {s.label: s for s in header.signals}
        return EdfReader(self.options["path"], header, [by_name[f.name] for f in schema.fields if f.name in by_name], int(self.options.get("records", 0)), schema.fieldNames())


class EdfReader(DataSourceReader):
    def __init__(self, path: str, header: Header, signals: list[Signal], records: int, names: list[str]) -> None:
        self.path, self.header, self.signals, self.names = path, header, signals, names
        self.records = records or max(1, PARTITION_BYTES // max(header.record_bytes, 1))

    def partitions(self) -> list[Records]:
        h = self.header
        return [Records(self.path, at, min(self.records, h.records - at)) for at in range(0, h.records, self.records)] or [Records(self.path, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        h = self.header
        # batches of some megabytes, whole records each
        step = max(1, (4 << 20) // max(h.record_bytes, 1))
        with opened(partition.path) as f:
            for at in range(partition.first, partition.first + partition.count, step):
                count = min(step, partition.first + partition.count - at)
                f.seek(h.start + at * h.record_bytes)
                data = f.read(count * h.record_bytes)
                if len(data) < count * h.record_bytes:
                    raise EdfError(f"{partition.path} ends within record {at + len(data) // h.record_bytes}")
                rows = np.arange(at * h.per_record, (at + count) * h.per_record)
                columns = {ROW: rows} | {s.label: values(data, h, s) for s in self.signals}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n]) for n in self.names], names=self.names)


def load_edf(spark: SparkSession, path: str, channels: list[str] | None = None, records: int = 0) -> DataFrame:
    """A recording with row ids and its channels, read by partitions of so many data records."""
    spark.dataSource.register(EdfSource)
    reader = spark.read.format("edf").option("records", str(records))
    if channels:
        reader = reader.option("channels", ",".join(channels))
    return reader.load(path)


def edf_bytes(signals: dict[str, np.ndarray], rate: int, unit: str = "uV", record_seconds: int = 1) -> bytes:
    """A recording of one rate as EDF, each signal scaled to 16 bits; a last record that isn't full is filled with the last value."""
    per = rate * record_seconds
    n = max((len(v) for v in signals.values()), default=0)
    records = -(-n // per)
    ranges = {k: (float(np.min(v)), float(max(np.max(v), np.min(v) + 1e-3))) for k, v in signals.items()}
    number = lambda x: f"{x:.7g}"[:8]
    ranges = {k: (float(number(a)), float(number(b))) for k, (a, b) in ranges.items()}
    columns = [
        [k for k in signals], [""] * len(signals), [unit] * len(signals), [number(a) for a, _ in ranges.values()], [number(b) for _, b in ranges.values()], ["-32768"] * len(signals),
        ["32767"] * len(signals), [""] * len(signals), [str(per)] * len(signals), [""] * len(signals),
    ]
    head = ["0", "X", "X", "01.01.26", "00.00.00", str(256 * (len(signals) + 1)), "", str(records), str(record_seconds), str(len(signals))]
    out = [text.ljust(n).encode("latin-1") for text, (_, n) in zip(head, HEAD, strict=True)]
    out += [text.ljust(w).encode("latin-1") for column, (_, w) in zip(columns, SIGNAL, strict=True) for text in column]
    scaled = []
    for k, v in signals.items():
        low, high = ranges[k]
        v = np.concatenate([v, np.full(records * per - len(v), v[-1])])
        scaled.append(np.clip(np.round((v - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(records, per))
    return b"".join(out) + (np.concatenate(scaled, axis=1).tobytes() if scaled else b"")
