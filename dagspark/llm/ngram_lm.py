"""Operator 6: interpolated modified Kneser-Ney n-gram model.

N-grams are counted in Spark: each task combines its own n-grams and deals them
out by the hash of all but their first word, so that a shard has all n-grams of
a shorter one, how many different words stand before it, and how often it
occurs. A shard merges its n-grams, writes both orders as sorted hash arrays to
the shared folder, and hands on partial sums for what is shorter still and the
statistics of contexts. A scoring task maps the arrays into its memory and
looks up its sorted, distinct hashes.

Words are known by WORD_BITS of their hash, n-grams by a hash of those, of which
the arrays keep the shard, the bucket (some BUCKET hashes) and 32 bits more. An
order of n pads each text with n - 1 begin marks and ends it with one end mark,
which is predicted and counted like a word. The probability of a word after a
context is that of its n-gram, discounted by one of three discounts from the
counts of counts, interpolated down to a uniform distribution over the training
words and one unknown word.

Shards hold some SHARD_BYTES of text, counted first. The model knows which
files it has and of what size: a file that is missing or cut is an error.

Null and empty texts are just an end mark. Repeated rows are counted and scored
each. Without training rows every word has the same probability, 1 / (V + 1)
with V = 0. A null doc_id counts as the empty string where rows are held out by
its hash. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, doc_key, documents, forget, opened, scratch, stored

ORDER = 3
#: tokens that a task counts before it deals out what it has, and tokens scored at once
COUNT_TOKENS, SCORE_TOKENS = 1 << 22, 1 << 20
#: bytes of training text for each shard of the model
SHARD_BYTES = 32 << 20
#: bits of a word's hash that are kept; the others are zero, which makes what is dealt out smaller
WORD_BITS = 52
#: hashes in a bucket, about
BUCKET = 8
#: words whose hashes a task keeps
MEMO = 400_000
U64 = np.uint64
_KEPT = (1 << 64) - (1 << (64 - WORD_BITS))
BEGIN, END = U64(0x9E3779B97F4A7C15 & _KEPT), U64(0xC2B2AE3D27D4EB4F & _KEPT)
_MULTIPLY = U64(0x9FB21C651E98DF25)
_SEED = 7


class Words(dict):
    """Numbers the words it meets, the begin mark 0 and the end mark 1, and knows their hashes."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.clear()
        self._hashes = [int(BEGIN), int(END)]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self._hashes)
        self._hashes.append(xxhash.xxh64_intdigest(word, _SEED) & _KEPT)
        return n

    def full(self) -> bool:
        return len(self) >= MEMO

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of the text's words and of the end mark."""
        words = (text or "").encode().translate(LOWER_TABLE).split()
        out = np.ones(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out

    def hashes(self) -> np.ndarray:
        return np.array(self._hashes, U64)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of word hashes; a single word's is its own."""
    h = columns[0]
    for c in columns[1:]:
        h = (h ^ (h >> U64(29))) * _MULTIPLY
        h = (h ^ (h >> U64(32))) + c
        h = (h ^ (h >> U64(28))) * _MULTIPLY
        h ^= h >> U64(31)
    return h


def dealt_hash(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """A hash of each row that begins with the shard of all but its first word."""
    if not bits or len(columns) == 1:
        return mixed(columns)
    return (mixed(columns[1:]) >> U64(64 - bits) << U64(64 - bits)) | (mixed(columns) >> U64(bits))


def ngrams(words: np.ndarray, lengths: np.ndarray, order: int, begin: int | U64 = BEGIN) -> list[np.ndarray]:
    """Columns of the order words that end at each word of the concatenated texts, padded at their beginnings."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(words))
    columns = []
    for back in range(order - 1, 0, -1):
        here = at - back
        columns.append(np.where(here >= starts, words[np.maximum(here, 0)], words.dtype.type(begin)))
    return [*columns, words]


class Files:
    """Arrays in the shared folder: written whole, read as memory maps."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        parsed = urlparse(uri)
        self.local = parsed.path if parsed.scheme in ("", "file") else None

    def write(self, name: str, data: bytes) -> None:
        with opened(self.uri, name) as f:
            f.write(data)

    def read(self, name: str, size: int | None = None) -> np.ndarray:
        """The file's bytes as a map, which stays in the process; size is what it must have."""
        key = f"{self.uri}/{name}"
        if key in _maps:
            return _maps[key]
        if self.local is not None:
            path = f"{self.local}/{name}"
            here = os.path.getsize(path) if os.path.exists(path) else -1
            found = np.memmap(path, np.uint8, "r") if here > 0 else np.empty(0, np.uint8)
        else:
            from pyarrow.fs import FileSystem, FileType

            fs, base = FileSystem.from_uri(self.uri)
            info = fs.get_file_info(f"{base}/{name}")
            here = -1 if info.type == FileType.NotFound else info.size
            found = np.empty(0, np.uint8)
            if here > 0:
                with tempfile.TemporaryFile() as copy, fs.open_input_stream(f"{base}/{name}") as f:
                    while block := f.read(1 << 22):
                        copy.write(block)
                    copy.flush()
                    found = np.memmap(copy, np.uint8, "r")  # the map outlives the file, which has no name
        if here < 0 or (size is not None and here != size):
            raise FileNotFoundError(f"the model's file {key} is " + ("missing" if here < 0 else f"of {here} bytes instead of {size}"))
        if len(_maps) >= 4096:
            _maps.clear()
        _maps[key] = found
        return found


#: this process's maps, by path (every model has its own folder)
_maps: dict[str, np.ndarray] = {}


def _ranges(h: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each hash, its first bits; shards are in the order of the hashes."""
    return (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


#: buckets of a shard at most, in bits; so shard, bucket and 32 bits are the first bits of a hash that contexts are known by
_BUCKET_BITS = 16


def _key_table(h: np.ndarray, bits: int) -> bytes:
    """Sorted hashes of a shard: a head, where each bucket begins, and 32 bits of each hash after shard and bucket."""
    bucket_bits = min(max((len(h) // BUCKET).bit_length() - 1, 0), _BUCKET_BITS)
    rest = (h << U64(bits)) if bits else h
    bucket = _ranges(rest, bucket_bits)
    offsets = np.searchsorted(bucket, np.arange((1 << bucket_bits) + 1)).astype(np.uint32)
    suffix = ((rest << U64(bucket_bits)) >> U64(32)).astype(np.uint32)
    return np.array([len(h), bucket_bits], np.int64).tobytes() + offsets.tobytes() + suffix.tobytes()


def _places(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Where a shard's table has each of the sorted hashes h; -1 where it lacks it."""
    n, bucket_bits = table[:16].view(np.int64).tolist()
    offsets = table[16 : 16 + 4 * ((1 << bucket_bits) + 1)].view(np.uint32)
    keys = table[16 + 4 * len(offsets) :].view(np.uint32)
    rest = (h << U64(bits)) if bits else h
    bucket = _ranges(rest, bucket_bits)
    wanted = ((rest << U64(bucket_bits)) >> U64(32)).astype(np.uint32)
    low, high = offsets[bucket].astype(np.int64), offsets[bucket + 1].astype(np.int64)
    last = high
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (keys[np.minimum(middle, n - 1)] < wanted)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    found = low < last
    found[found] = keys[low[found]] == wanted[found]
    return np.where(found, low, -1)


def _value_table(columns: list[np.ndarray]) -> bytes:
    """Rows of small numbers: a bit for each that isn't the most common row, and the numbers of those rows' values."""
    rows = np.column_stack(columns).astype(np.int64)
    n = len(rows)
    _, first, code, times = np.unique(mixed([c.astype(np.int64).view(U64) + U64(1) for c in columns]), return_index=True, return_inverse=True, return_counts=True)
    by_times = np.argsort(-times, kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_times] = np.arange(len(first))
    code = rank[code]
    odd = np.zeros(-(-n // 64) * 64, bool)
    odd[:n] = code > 0
    bits = np.packbits(odd, bitorder="little")
    before = np.concatenate([[0], np.cumsum(odd.reshape(-1, 64).sum(1))[:-1]]).astype(np.uint32) if n else np.zeros(0, np.uint32)
    kind = np.uint8 if len(first) < 1 << 8 else np.uint16 if len(first) < 1 << 16 else np.uint32
    head = np.array([n, len(first), rows.shape[1], np.dtype(kind).itemsize], np.int64)
    return head.tobytes() + rows[first[by_times]].tobytes() + bits.tobytes() + before.tobytes() + code[code > 0].astype(kind).tobytes()


def _values(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a value table; zeros where at is -1."""
    n, n_distinct, width, size = table[:32].view(np.int64).tolist()
    out = np.zeros((len(at), width), np.int64)
    if not n:
        return out
    ends = np.cumsum([32, 8 * n_distinct * width, 8 * -(-n // 64), 4 * -(-n // 64)]).tolist()
    distinct = table[ends[0] : ends[1]].view(np.int64).reshape(n_distinct, width)
    bits, before = table[ends[1] : ends[2]].view(U64), table[ends[2] : ends[3]].view(np.uint32)
    codes = table[ends[3] :].view({1: np.uint8, 2: np.uint16, 4: np.uint32}[size])
    hit = at >= 0
    word, bit = at[hit] >> 6, (at[hit] & 63).astype(U64)
    here = bits[word]
    odd = (here >> bit) & U64(1) == 1
    rank = before[word[odd]] + np.bitwise_count(here[odd] & ((U64(1) << bit[odd]) - U64(1)))
    code = np.zeros(len(word), np.int64)
    code[odd] = codes[rank]
    out[hit] = distinct[code]
    return out


def _planes(a: np.ndarray) -> bytes:
    """The numbers' first bytes, second bytes and so on, which compress better so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _from_planes(data: bytes, at: int, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T).view(dtype).ravel()


def _pack(columns: list[np.ndarray], words: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Rows of word numbers and of small numbers, with the words' hashes, compressed."""
    used = np.zeros(len(words), bool)
    for c in columns:
        used[c] = True
    here = np.flatnonzero(used)
    here = here[np.argsort(words[here])]
    rank = np.zeros(len(words), np.uint32)
    rank[here] = np.arange(len(here))
    parts = [_planes(np.diff(words[here], prepend=U64(0)))] + [_planes(rank[c]) for c in columns] + [_planes(v.astype(np.int64)) for v in values]
    return np.array([len(here), len(columns[0]), len(columns), len(values)], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of word hashes, and the small numbers."""
    n_words, n, width, n_values = np.frombuffer(data, np.int64, 4).tolist()
    small = zstandard.ZstdDecompressor().decompress(data[32:], max_output_size=8 * n_words + n * (4 * width + 8 * n_values))
    words, at = np.cumsum(_from_planes(small, 0, n_words, U64), dtype=U64), 8 * n_words
    columns = [words[_from_planes(small, at + 4 * n * i, n, np.uint32)] for i in range(width)]
    return columns, [_from_planes(small, at + n * (4 * width + 8 * i), n, np.int64) for i in range(n_values)]


def _summed(h: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct hashes of the rows, their columns, and sums of the values."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], new) if len(new) else v for v in values]
    return h[new], [r[order[new]] for r in rows], sums


_ROWS = "kind string, level int, shard int, payload binary, stat array<long>"
_SCHEMA = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary()), ("stat", pa.list_(pa.int64()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _dealt(kind: str, level: int, h: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows for the shards of their sorted hashes h; columns are hashes too."""
    edges = np.searchsorted(_ranges(h, bits), np.arange((1 << bits) + 1))
    for s in range(1 << bits):
        own = slice(edges[s], edges[s + 1])
        if own.start < own.stop:
            words, number = np.unique(np.concatenate([c[own] for c in columns]), return_inverse=True)
            yield kind, level, s, _pack(np.split(number, len(columns)), words, [v[own] for v in values]), None


def _counted(batches: Iterator[pa.RecordBatch], order: int, bits: int) -> Iterator[pa.RecordBatch]:
    memo, texts, n = Words(), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        hashes = memo.hashes()
        columns = ngrams(np.concatenate(texts), np.array([len(t) for t in texts]), order, 0)
        width = len(hashes).bit_length()
        if width * order <= 64:
            key = columns[0].astype(U64)
            for c in columns[1:]:
                key = (key << U64(width)) | c.astype(U64)
        else:
            key = mixed([hashes[c] for c in columns])
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        columns = [c[first] for c in columns]
        shard = _ranges(mixed([hashes[c] for c in columns[1:] or columns]), bits)
        by_shard = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by_shard], np.arange((1 << bits) + 1))
        for s in range(1 << bits):
            own = by_shard[edges[s] : edges[s + 1]]
            if len(own):
                yield _batch([("top", order, s, _pack([c[own] for c in columns], hashes, [count[own]]), None)])

    for batch in batches:
        for text in batch["text"]:
            texts.append(memo.of(text.as_py()))
            n += len(texts[-1])
            if n >= COUNT_TOKENS:
                yield from flush()
                texts, n = [], 0
                if memo.full():
                    memo.forget()
    if texts:
        yield from flush()


def start_context(level: int) -> int:
    """The hash of the context of a text's first word."""
    return int(mixed([np.array([BEGIN])] * level)[0])


class _Shard:
    """What becomes of a shard's merged n-grams: files, statistics, and rows for others."""

    def __init__(self, shard: int, bits: int, uri: str) -> None:
        self.shard, self.bits, self.files, self.out = shard, bits, Files(uri), []

    def write(self, level: int, name: str, data: bytes) -> None:
        self.files.write(f"{level}-{self.shard}-{name}", data)
        self.out.append(("file", level, self.shard, name.encode(), [len(data)]))

    def grams(self, level: int, h: np.ndarray, rows: list[np.ndarray], count: np.ndarray, total: np.ndarray) -> None:
        """Write a level's n-grams, and deal out the statistics of their contexts; count is the adjusted one, total how often they occur."""
        self.write(level, "keys", _key_table(h, self.bits))
        self.write(level, "values", _value_table([count, total] if level == 1 else [count]))
        self.out.append(("stat", level, self.shard, None, [len(h), int(count.sum()), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int(total.sum())]))
        if level == 1:
            return
        c = mixed(rows[:-1])
        start = U64(start_context(level - 1))
        # what a key table doesn't tell apart needn't be told
        c = np.where(c == start, c, c & ~U64((1 << max(64 - self.bits - _BUCKET_BITS - 32, 0)) - 1))
        c, _, sums = _summed(c, [], [count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64)])
        start = c == start
        if start.any():
            self.out.append(("start", level, self.shard, None, [int(v[start][0]) for v in sums]))
        self.out += _dealt("context", level - 1, c[~start], [c[~start]], [v[~start] for v in sums], self.bits)

    def contexts(self, level: int, c: np.ndarray, stats: list[np.ndarray]) -> None:
        """Write the statistics of contexts that are n-grams of a level written before."""
        keys = self.files.read(f"{level}-{self.shard}-keys")
        at = _places(keys, c, self.bits)
        if (at < 0).any():
            raise ValueError(f"level {level}, shard {self.shard} lacks contexts of its own")
        aligned = [np.zeros(int(keys[:8].view(np.int64)[0]), np.int64) for _ in stats]
        for a, v in zip(aligned, stats, strict=True):
            a[at] = v
        self.write(level, "contexts", _value_table(aligned))


def _shorter(level: int, rows: list[np.ndarray], count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The n-grams of one word less at the front: sorted hashes, words, and (adjusted count, occurrences)."""
    # each counts once for each word before it, but as often as it occurs where it begins a text
    adjusted = np.where(rows[1] == BEGIN, total, 1) if level > 2 else np.ones(len(count), np.int64)
    return _summed(mixed(rows[1:]), rows[1:], [adjusted, total])


def _reduce(table: pa.Table, order: int, bits: int, uri: str) -> pa.Table:
    """Merge what a shard has of a level, write its arrays, hand on the rest."""
    level, shard = (table[c][0].as_py() for c in ("level", "shard"))
    payloads: dict[str, list[bytes]] = {}
    passed = []
    for row in table.to_pylist():
        if row["payload"] is None or row["kind"] == "file":
            passed.append(tuple(row[c] for c in _SCHEMA.names))
        else:
            payloads.setdefault(row["kind"], []).append(row["payload"])

    def merged(kind: str) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        parts = [_unpack(x) for x in payloads.pop(kind)]
        rows, values = ([np.concatenate(c) for c in zip(*(p[i] for p in parts), strict=True)] for i in (0, 1))
        del parts
        return _summed(dealt_hash(rows, bits) if kind == "top" else mixed(rows), rows, values)

    done = _Shard(shard, bits, uri)
    if "top" in payloads:
        h, rows, (count,) = merged("top")
        done.grams(level, h, rows, count, count)
        if level > 1:
            # the shard has all n-grams that end alike, so it has all of the next level's that it deals with
            h, rows, values = _shorter(level, rows, count, count)
            level -= 1
            done.grams(level, h, rows, *values)
    elif "gram" in payloads:
        h, rows, values = merged("gram")
        done.grams(level, h, rows, *values)
    else:
        rows = None
    if "context" in payloads:
        h, _, stats = merged("context")
        done.contexts(level, h, stats)
    if rows is not None and level > 1:
        h, rows, values = _shorter(level, rows, *values)
        done.out += _dealt("gram", level - 1, h, rows, values, bits)
    rows = passed + done.out
    return pa.Table.from_batches([_batch([r]) for r in rows], _SCHEMA) if rows else _SCHEMA.empty_table()


class Model:
    """Where a trained model's arrays lie, their sizes, the discounts, and the statistics of texts' beginnings."""

    def __init__(self, uri: str, order: int, bits: int, stats: dict[int, list[int]], starts: dict[int, list[int]], sizes: dict[str, int]) -> None:
        self.uri, self.order, self.bits, self.sizes = uri, order, bits, sizes
        self.vocabulary, self.total, n1, n2, _, _, self.tokens = stats.get(1, [0] * 7)
        self.discounts = {k: discounts(stats[k][2:6]) if k in stats else np.zeros(4) for k in range(1, order + 1)}
        self.starts = {k: np.array(starts.get(k, [0] * 4), np.float64) for k in range(1, order + 1)}
        d = self.discounts[1]
        #: the unigrams' share of the uniform distribution
        self.spread = (d[1] * n1 + d[2] * n2 + d[3] * (self.vocabulary - n1 - n2)) / self.total if self.total else 1.0

    def _found(self, level: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and context statistics of n-grams by sorted hash."""
        files = Files(self.uri)
        values, contexts = np.zeros((len(h), 2 if level == 1 else 1)), np.zeros((len(h), 4))
        edges = np.searchsorted(_ranges(h, self.bits), np.arange((1 << self.bits) + 1))
        for s in range(1 << self.bits):
            own, base = slice(edges[s], edges[s + 1]), f"{level}-{s}-"
            if own.start == own.stop or f"{base}keys" not in self.sizes:
                continue
            at = _places(files.read(f"{base}keys", self.sizes[f"{base}keys"]), h[own], self.bits)
            values[own] = _values(files.read(f"{base}values", self.sizes[f"{base}values"]), at)
            if f"{base}contexts" in self.sizes:
                contexts[own] = _values(files.read(f"{base}contexts", self.sizes[f"{base}contexts"]), at)
        return values, contexts

    def log10(self, numbers: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and training count of each word of the concatenated texts; numbers are places in hashes."""
        met = np.flatnonzero(np.bincount(numbers, minlength=len(hashes)))
        met = met[np.argsort(hashes[met])]
        place = np.zeros(len(hashes), np.int64)
        place[met] = np.arange(len(met))
        h = hashes[met]
        values, contexts = (x[place[numbers]] for x in self._found(1, h))
        d = self.discounts[1]
        count, raw = values[:, 0], values[:, 1]
        p = self.spread / (self.vocabulary + 1) + np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / max(self.total, 1)
        columns = ngrams(hashes[numbers], lengths, self.order)
        first = np.cumsum(lengths) - lengths
        for level in range(2, self.order + 1):
            # a word's context is the n-gram that ends at the word before
            stats = np.empty((len(numbers), 4))
            stats[1:] = contexts[:-1]
            stats[first] = self.starts[level]
            last = columns[-level:]
            h = dealt_hash(last, self.bits) if level == self.order else mixed(last)
            order = np.argsort(h)
            h = h[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            back = np.empty(len(order), np.int64)
            back[order] = np.cumsum(new) - 1
            values, contexts = self._found(level, h[new])
            count = values[:, 0][back]
            if level < self.order:
                contexts = contexts[back]
            d = self.discounts[level]
            seen = stats[:, 0] > 0
            total = np.where(seen, stats[:, 0], 1)
            q = np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) / total + (stats[:, 1:] @ d[1:]) / total * p
            p = np.where(seen, q, p)
        return np.log10(p), raw


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of n-grams counted 0, 1, 2, and 3 or more times, from how many occur 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not all(n):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would use for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def train(texts: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count texts(text) and write the model to the shared folder."""
    spark = texts.sparkSession
    uri = _qualified(spark, f"{scratch(spark)}/ngram-{uuid.uuid4().hex}")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(max(-(-size // shard_bytes) - 1, 0).bit_length(), 30)
    rows = texts.select("text").mapInArrow(lambda x: _counted(x, order, bits), _ROWS)
    for step in range(max(order - 1, 1) + (order == 2)):
        # so many partitions that few get two shards; what is dealt out goes as soon as it is merged and written
        dealt = rows.repartition(4 << bits, "level", "shard").groupBy("level", "shard")
        merged = stored(dealt.applyInArrow(lambda t: _reduce(t, order, bits, uri), _ROWS), f"ngrams-{step}")
        if step:
            forget(rows)
        rows = merged
    stats: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    sizes: dict[str, int] = {}
    # a few rows for each shard
    for r in rows.collect():
        if r.kind == "file":
            sizes[f"{r.level}-{r.shard}-{bytes(r.payload).decode()}"] = r.stat[0]
        else:
            to = stats if r.kind == "stat" else starts
            to[r.level] = [a + b for a, b in zip(to.get(r.level, [0] * len(r.stat)), r.stat, strict=True)]
    forget(rows)
    return Model(uri, order, bits, stats, starts, sizes)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    memo, ids, texts, n = Words(), [], [], 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts])
        score, count = model.log10(np.concatenate(texts), lengths, memo.hashes())
        starts = np.cumsum(lengths) - lengths
        base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
        sums = [lengths, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(score, starts)]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        id_type = batch["doc_id"].type
        for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids.append(key)
            texts.append(memo.of(text.as_py()))
            n += len(texts[-1])
            if n >= SCORE_TOKENS:
                yield flush()
                ids, texts, n = [], [], 0
                if memo.full():
                    memo.forget()
    if texts:
        yield flush()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) as (doc_id, n_tokens, n_known, base_score, score) with log10 probabilities of whole texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda x: _scored(x, model), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return doc_key(doc_id) % 7 == 2


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    rows = score(docs, model)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


QUERIES = {"op6_ngram_lm": op6_ngram_lm}
ORACLE_SQL: dict[str, str] = {}
