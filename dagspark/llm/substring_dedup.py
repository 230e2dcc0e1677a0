"""Operator 5: removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte is removed that is covered by a string of LENGTH bytes which also
starts anywhere else. Suffixes are dealt to shards so that equal strings meet:
each string of LENGTH bytes is represented by one anchor in it, the leftmost of
the GRAM-byte strings in it that have the smallest hash. Equal strings have
equal anchors, so

1. anchors are counted, and only those that occur more than once are kept;
2. the starts that share an anchor make a fragment (their bytes and LENGTH - 1
   more). Equal fragments are counted: what occurs twice is repeated throughout;
3. anchors with different fragments need their suffixes sorted. One copy of each
   such fragment goes to its anchor's shard, whose suffix array is induced
   (suffix_array.py); a permuted common prefix of LENGTH or more within the
   fragment marks both suffixes as repeated. Anchors with more than HOT
   different fragments don't fit in a shard's task; their strings are counted by
   digest instead, each by itself;
4. what was found for a fragment goes back to all its occurrences, then to the
   documents, whose bytes are removed.

Counts are combined before shuffles, joins are between stored tables, so a
passage in a third of all documents is no hot spot. Fragments are told apart by
two 64-bit hashes, of the anchor and of the whole.

Null texts are empty. Texts shorter than LENGTH lose nothing. Rows with equal
doc_id and text are repeats of each other, find the same ranges (kept once
however many they are) and each give a row. An empty table
gives an empty result; only doc_id and text are read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stored
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 200, 64
#: bytes of fragments in a shard, about; and different fragments of one anchor that still go to one shard
SHARD_BYTES, HOT = 500_000, 4_000
#: starts that are looked at together, which bounds the memory for long texts; their place takes the low bits
BLOCK_BITS = 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Hashes:
    """Rolling hashes of byte strings: sums of a random number for each byte times a power for its place."""

    def __init__(self) -> None:
        n = (1 << BLOCK_BITS) + LENGTH + 1
        powers = np.full(n, _BASE, U64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        back = np.full(n, pow(_BASE, -1, 1 << 64), U64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.of_byte = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)

    def sums(self, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t) + 1, U64)
        np.cumsum(self.of_byte[t] * self.powers[: len(t)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.back[start])


_hashes: list[Hashes] = []


def hashes() -> Hashes:
    if not _hashes:
        _hashes.append(Hashes())
    return _hashes[0]


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    done = 1
    m = v
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a text: anchor hash, fragment hash, first start and number of starts of its fragments."""
    hs, whole = hashes(), np.frombuffer(data, np.uint8)
    low = U64((1 << BLOCK_BITS) - 1)
    for at in range(0, len(whole) - LENGTH + 1, (1 << BLOCK_BITS) - LENGTH):
        t = whole[at : at + (1 << BLOCK_BITS) - 1]
        sums = hs.sums(t)
        gram = np.arange(len(t) - GRAM + 1)
        h = hs.between(sums, gram, gram + GRAM)
        least = _window_min((h & ~low) | gram.astype(U64), LENGTH - GRAM + 1) & low
        own = min(len(least), (1 << BLOCK_BITS) - LENGTH)  # further starts are the next block's
        least = least[:own].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(start, own))
        yield h[least[start]], hs.between(sums, start, start + count - 1 + LENGTH), start + at, count


_OCCURRENCE = "d long, t long, h long, f long, lo int, len int, n long, more array<int>"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different fragment of each text; further occurrences in the text are ranges of starts in `more`."""
    names = ["d", "t", "h", "f", "lo", "len", "n", "more"]
    for batch in batches:
        parts: list[tuple] = []
        more: list[list[int] | None] = []
        for i, text in enumerate(batch["text"].to_pylist()):
            data = (text or "").encode()
            if len(data) < LENGTH:
                continue
            h, f, lo, count = (np.concatenate(x) for x in zip(*anchors(data), strict=True))
            _, first, group, n = np.unique(f, return_index=True, return_inverse=True, return_counts=True)
            parts.append((np.full(len(first), i), h[first], f[first], lo[first], count[first], n))
            rest: list[list[int] | None] = [None] * len(first)
            if len(first) < len(f):
                is_first = np.zeros(len(f), bool)
                is_first[first] = True
                for g, a, b in zip(group[~is_first].tolist(), lo[~is_first].tolist(), (lo + count - 1)[~is_first].tolist(), strict=True):
                    if rest[g] is None:
                        rest[g] = []
                    if rest[g] and rest[g][-1] + 1 >= a:
                        rest[g][-1] = b
                    else:
                        rest[g] += [a, b]
            more += rest
        if not parts:
            continue
        row, h, f, lo, count, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        arrays = [batch["d"].take(pa.array(row)), batch["t"].take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(f.view(np.int64))]
        arrays += [pa.array(lo.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(n), pa.array(more, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    d = F.coalesce(F.xxhash64("doc_id"), F.lit(0)) if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int") else F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    return docs.select(*more, d.alias("d"), F.xxhash64("text").alias("t"), "text")


_FRAGMENT = "h long, f long, n long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, places in zip(batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
            data = text.encode()
            out += [(p["h"], p["f"], p["n"], data[p["lo"] : p["lo"] + p["len"] - 1 + LENGTH]) for p in places]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())], names=["h", "f", "n", "bytes"])


def _as_ranges(marked: np.ndarray) -> list[int]:
    """Flat list of first and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def repeated_starts(fragments: list[bytes]) -> list[np.ndarray]:
    """For each fragment, which of its starts begin a string of LENGTH bytes that another start of any of them begins."""
    sizes = np.array([len(x) + 1 for x in fragments])
    joined = np.frombuffer(b"\xff".join(fragments) + b"\xff", np.uint8) + np.uint8(1)  # no UTF-8 text has the byte 255, which becomes 0
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(joined, 256)
    plcp, phi = permuted_lcp(joined, sa, LENGTH)
    end = np.repeat(begin + sizes - 1, sizes)
    inside = end - np.arange(len(joined)) >= LENGTH
    hit = (plcp >= LENGTH) & inside
    marked = hit.copy()
    marked[phi[hit]] = True
    return [marked[b : b + s - LENGTH] for b, s in zip(begin, sizes, strict=True)]


_FOUND = "h long, f long, ranges array<int>"


def _sorted_shard(table: pa.Table) -> pa.Table:
    seen: dict[tuple[int, int], tuple[int, bytes]] = {}
    for h, f, n, data in zip(*(table[c].to_pylist() for c in ("h", "f", "n", "bytes")), strict=True):
        seen[h, f] = n, data
    keys = list(seen)
    marks = repeated_starts([seen[k][1] for k in keys])
    out = [(h, f, _as_ranges(m)) for (h, f), m in zip(keys, marks, strict=True) if seen[h, f][0] == 1 and m.any()]
    columns = list(zip(*out, strict=True)) if out else [()] * 3
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], names=["h", "f", "ranges"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes of a fragment, by digest."""
    for batch in batches:
        out = []
        for h, f, n, data in zip(*(batch[c].to_pylist() for c in ("h", "f", "n", "bytes")), strict=True):
            out += [(h, f, n, i, hashlib.blake2b(data[i : i + LENGTH], digest_size=16).digest()) for i in range(len(data) - LENGTH + 1)]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=["h", "f", "n", "at", "digest"])


def _counted_strings(fragments: DataFrame) -> DataFrame:
    strings = stored(fragments.dropDuplicates(["h", "f"]).mapInArrow(_digests, "h long, f long, n long, at int, digest binary"), "strings")
    often = stored(strings.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest"), "repeated_strings")
    hits = strings.where("n = 1").join(often, "digest", "left_semi")
    return hits.groupBy("h", "f").agg(F.flatten(F.collect_list(F.array("at", "at"))).alias("ranges"))


def _finished(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove from each text the bytes of the strings that begin in its ranges."""
    for batch in batches:
        n, gone, spans, sha, left = [], [], [], [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
            data = (text or "").encode()
            kept, at, removed, count = [], 0, 0, 0
            if ranges:
                pairs = np.array(ranges, np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                stop = np.maximum.accumulate(pairs[:, 1]) + LENGTH
                new = np.concatenate([[True], pairs[1:, 0] > stop[:-1]])
                first = np.flatnonzero(new)
                for a, b in zip(pairs[first, 0].tolist(), stop[np.append(first[1:] - 1, len(stop) - 1)].tolist(), strict=True):
                    kept.append(data[at:a])
                    at, removed, count = b, removed + b - a, count + 1
            kept.append(data[at:])
            rest = b"".join(kept)
            n.append(len(data))
            gone.append(removed)
            spans.append(count)
            sha.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                left.append(None if text is None else rest.decode("utf-8", "ignore"))
        columns = [batch["row"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(left, pa.string())] if with_text else [])], names=["row", *_COUNTS, *(["kept_text"] if with_text else [])])


_COUNTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeated_ranges(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(d, t, ranges) of the texts of docs(doc_id, text) that hold repeated strings: the first and last starts, flat."""
    occurrences = _keyed(docs).mapInArrow(_occurrences, _OCCURRENCE)
    twice = stored(occurrences.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated_anchors")
    repeated = stored(occurrences.join(twice, "h", "left_semi"), "repeated_occurrences")
    place = F.struct("d", "t", "lo", "len")
    fragments = stored(repeated.groupBy("h", "f").agg(F.sum("n").alias("n"), F.min(place).alias("place")), "fragments")
    kinds = stored(fragments.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "mixed_anchors")
    mixed = stored(fragments.join(kinds, "h").select("h", "f", "n", "k", "place.*"), "mixed_fragments")
    size = mixed.agg(F.coalesce(F.sum(F.col("len") + LENGTH - 1), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    places = stored(mixed.groupBy("d", "t").agg(F.collect_list(F.struct("h", "f", "n", "lo", "len")).alias("places")), "places")
    texts = _keyed(docs).join(places, ["d", "t"]).select("text", "places").mapInArrow(_cut, _FRAGMENT)
    large = mixed.where(F.col("k") > hot).select("h").distinct()
    if large.limit(1).count():
        texts = stored(texts, "fragment_bytes")
        counted = _counted_strings(texts.join(large, "h", "left_semi"))
        texts = texts.join(large, "h", "left_anti")
    else:
        counted = None
    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    found = texts.groupBy(shard.alias("shard")).applyInArrow(_sorted_shard, _FOUND)
    throughout = fragments.where("n > 1").select("h", "f", F.lit(None).cast("array<int>").alias("ranges"))
    found = found.unionByName(throughout)
    if counted is not None:
        found = found.unionByName(counted)
    hits = repeated.join(stored(found, "repeated_fragments"), ["h", "f"])
    starts = F.when(F.col("ranges").isNull(), F.concat(F.array("lo", F.col("lo") + F.col("len") - 1), F.coalesce("more", F.array().cast("array<int>"))))
    starts = starts.otherwise(F.transform("ranges", lambda x: x + F.col("lo")))
    # repeated rows find the same ranges, which are kept once
    return stored(hits.groupBy("d", "t").agg(F.flatten(F.collect_set(starts)).alias("ranges")), "repeated_ranges")


def deduplicate(docs: DataFrame, with_text: bool = False, **options: int) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256 (and kept_text) added; its own columns of these names are replaced.

    kept_text is what is left as text; half a character at a cut's edge is left out of it.
    """
    added = [*_COUNTS, *(["kept_text"] if with_text else [])]
    columns = [c for c in docs.columns if c not in added]
    ranges = repeated_ranges(docs.select("doc_id", "text"), **options)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), "doc_id", "text")
    joined = _keyed(packed, "row").join(ranges, ["d", "t"], "left").select("row", "text", "ranges")
    ddl = f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda x: _finished(x, with_text), ddl).select("row.*", *added)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL = {
    "op5_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS g
  FROM (SELECT r, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(x) >= {2 * LENGTH})),
rep AS (SELECT r, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
run AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM rep),
grp AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM run),
span AS (SELECT r, k, min(i) AS a, max(i) + {LENGTH} AS b FROM grp GROUP BY r, k),
kept AS (SELECT r, k, b AS a, lead(a) OVER (PARTITION BY r ORDER BY k) AS b FROM (SELECT r, k, a, b FROM span UNION ALL SELECT r, 0, 0, 0 FROM d)),
rest AS (SELECT r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY k) AS x FROM kept JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(rest.x)) AS kept_sha256
FROM d JOIN rest USING (r) LEFT JOIN n USING (r)"""
}
