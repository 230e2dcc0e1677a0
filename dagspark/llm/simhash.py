"""Operator 7: SimHash fingerprints, linked by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into four 16-bit segments. If two fingerprints
differ in at most three bits, one segment is equal and, of any two others, one
differs in at most one bit. So for each segment s and each of the next two
segments t (cyclically) a key is made of s as it is and of t fuzzily: t, padded
to 23 bits, is decoded to its nearest codeword of the perfect binary (23, 12)
Golay code (every word lies within three bits of exactly one codeword), and the
codeword's 12-bit index stands for it. One side of the join has the index of t
itself, the other the indices of t and of all words one bit away (six at most):
whenever the two segments differ in at most one bit, the sides share a key. No
link is lost, and each candidate is verified by its number of differing bits.

Equal fingerprints are merged before the join, so groups of copies make no
pairs; a fingerprint has 43,744 others within three bits, so its links are
bounded however many near copies there are. Null and empty texts have the fingerprint zero and are linked like any
other. Rows with a null doc_id take part; a component that has no other rows
has a null component_id. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, documents, stored
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY, GOLAY_BITS = 0b110001110101, 23


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; of its whole words if they are fewer."""
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def remainders(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words, as polynomials over GF(2), modulo GOLAY."""
    r = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GOLAY << (bit - 11), 0)
    return r


def golay_leaders() -> np.ndarray:
    """For each remainder the error of at most three bits that leaves it; a word less its error is its codeword."""
    errors = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors)
    leader = np.zeros(1 << 11, np.int64)
    leader[remainders(errors)] = errors
    return leader


def golay_indices() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word: its codeword's index, and the indices of all words within one bit.

    The second is padded to a rectangle with -1.
    """
    leader = golay_leaders()
    word = np.arange(1 << 16)
    near = np.stack([word] + [word ^ (1 << i) for i in range(16)], axis=1)
    index = (near ^ leader[remainders(near)]) >> 11
    own = index[:, 0].copy()
    index.sort(axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    index = -np.sort(-index, axis=1)
    return own, index[:, : int((index >= 0).sum(1).max())]


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _keys(batches: Iterator[pa.RecordBatch], many: bool) -> Iterator[pa.RecordBatch]:
    if not _tables:
        _tables.append(golay_indices())
    own, near = _tables[0]
    for batch in batches:
        fp = batch["fp"].to_numpy(zero_copy_only=False)
        seg = [((fp.view(np.uint64) >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
        for s in range(4):
            for step in (1, 2):
                index = near[seg[(s + step) % 4]] if many else own[seg[(s + step) % 4]][:, None]
                key = ((s * 2 + step - 1) << 28) | (seg[s][:, None] << 12) | index
                has = index >= 0
                yield pa.RecordBatch.from_arrays([pa.array(key[has]), pa.array(np.broadcast_to(fp[:, None], has.shape)[has])], names=["key", "fp"])


def golay_links(fps: DataFrame) -> DataFrame:
    """All pairs a < b of the distinct fingerprints fps(fp) that differ in at most three bits."""

    def side(many: bool, name: str) -> DataFrame:
        return fps.select("fp").mapInArrow(lambda x: _keys(x, many), "key long, fp long").withColumnRenamed("fp", name)

    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    one, many = side(False, "a"), side(True, "b")
    return one.join(many.hint("merge"), (one["key"] == many["key"]) & close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return doc_id, fingerprint and component_id for each row of docs(doc_id, text); doc_ids are of any type that has an order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    found = components(stored(golay_links(distinct), "fingerprint_links"))
    rooted = distinct.join(found.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = stored(rooted.join(least.hint("merge"), "root").select("fp", "component_id"), "components")
    return prints.join(owner.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
