"""Operator 13: n-gram Jaccard join, size-aware, by light and heavy sets.

A document's set holds its distinct SHINGLE-word shingles. Two documents link
if SIMILAR[1] * intersection >= SIMILAR[0] * union; that is, if sets of sizes a
and b share at least overlap(a, b) shingles, whose number depends on the sizes
alone. Equal sets are merged first, so copies make no pairs.

Light sets (of at most `boundary` shingles): for each size of a possible
partner, all subsets of overlap(a, b) shingles are enumerated, each a key of 64
bits. Two sets share a key if and only if (but for equal hashes) they link.
Within a key all sets of one size link with all of the other, so two stars
stand for all those pairs.

Heavy sets: inverted lists are scanned. Of a set's n shingles any n -
overlap(n, smallest partner) + 1 share one with each partner, so lists hold
each set's rarest shingles only. Rarity is counted exactly for the band of
shingles whose hash is in the lowest BAND of all hashes, in which most sets
have more shingles than lists need; where a set has fewer, shingles beyond the band
follow in the order of their hashes. So the order is the same for all sets, and
passages that many documents share stay out of the lists. Sets that are light,
but have heavy partners, stand in lists too.

The boundary is the one of least cost: subsets that light sets make, plus list
entries that heavy ones scan, both counted for each size.

A list is scanned in two steps. First every set is compared with the one of
its lists' heads (the sets with the largest lists) with which it shares most
lists, and links make groups. Then lists whose sets are in one group are done.
The sets of the others are cut into blocks, and pairs of blocks are scanned for
sets of different groups that may link: sizes fit, and the parity bitmaps (bit i:
whether an odd number of shingles has hash i) differ in no more bits than
linked sets may in shingles. That drops no link. The sets that it leaves are
scanned once more, with their texts: pairs are compared by their whole sets,
the nearest first, and two groups that have been found to link are one for the
pairs that follow. So a large group of near copies hands on a tree of links
for each pair of blocks, not all of them; no component is lost.

Shingles are known by 64-bit hashes, sets by 128-bit digests. Words are
separated by white space of ASCII; A-Z are lower-cased. Null and blank texts
have empty sets, which link with nothing, copies included. Rows with a null
doc_id take part; a component that has no other rows has a null component_id.
Repeated rows each give a row. An empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, bloom, documents, forget, numbered, perhaps_in, stored
from .components import components

SHINGLE, SIMILAR = 3, (90, 100)
#: the share of all hashes whose shingles are counted
BAND = 0.2
#: sets of more shingles are never light, whatever the cost
MOST_LIGHT = 32
#: sets of a list that are compared at once with as many others, by bitmaps; and by whole sets, with texts of so many bytes at most (or one)
BLOCK, WHOLE, WHOLE_BYTES = 256, 512, 2 << 20
#: bits of the least bitmap; others have as many as the set has shingles, as a power of two
LEAST_BITS = 256
U64 = np.uint64
_LOW = -(1 << 63)
_BAND_END = _LOW + int(BAND * (1 << 64))


def overlap(a: int, b: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    t, of = SIMILAR
    return -(-t * (a + b) // (t + of))


def partners(n: int) -> range:
    """The sizes of sets that a set of n can link with."""
    t, of = SIMILAR
    return range(-(-t * n // of), of * n // t + 1)


def listed(n: int) -> int:
    """How many shingles of a set of n are listed: any so many share one with every partner."""
    return n - overlap(n, partners(n)[0]) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(dict[bytes, int]):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, known: Words | None = None) -> np.ndarray:
    """The sorted hashes of a text's shingles; known remembers words."""
    known = Words() if known is None else known
    words = (text or "").encode().translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), U64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, n, U64)
    for i in range(n):
        out = _mixed(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out.view(np.int64))


def bitmap(h: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of hashes, as 64-bit words."""
    bits = max(LEAST_BITS, 1 << (max(len(h), 1) - 1).bit_length())
    odd = np.bincount((h.view(U64) >> U64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it is with fewer words."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


#: words that a task remembers
_KNOWN = 1 << 17
_SETS = "rid long, doc_id {id}, digest binary, n long, bits array<long>, tokens array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        digests, sizes, bits, tokens = [], [], [], []
        for text in batch["text"]:
            if len(known) > _KNOWN:
                known.clear()
            h = shingle_set(text.as_py(), known)
            n = len(h)
            sizes.append(n)
            digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            bits.append(bitmap(h))
            band = int(np.searchsorted(h, _BAND_END))
            tokens.append(h if n <= MOST_LIGHT else h[: max(band, listed(n))])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (bits, tokens)]
        yield pa.RecordBatch.from_arrays([batch["rid"], batch["doc_id"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], names=["rid", "doc_id", "digest", "n", "bits", "tokens"])


def subset_keys(h: np.ndarray, boundary: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each size of a light partner: the smaller size, the larger, and the keys of the set's subsets that such a pair shares."""
    n = len(h)
    mixed = _mixed(h.view(U64) ^ U64(0x5851F42D4C957F2D))
    for m in partners(n):
        if m > boundary or m < 1:
            continue
        left_out = n - overlap(n, m)
        if left_out < 0:
            continue
        low, high = min(n, m), max(n, m)
        without = np.array([sum(int(mixed[i]) for i in c) & (1 << 64) - 1 for c in combinations(range(n), left_out)], U64)
        keys = mixed.sum(dtype=U64) - without
        yield low, high, _mixed(keys * U64(0x9E3779B97F4A7C15) + U64(low << 16 | high)).view(np.int64)


def _subsets(batches: Iterator[pa.RecordBatch], boundary: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        for node, tokens in zip(batch["node"].to_pylist(), batch["tokens"], strict=True):
            h = np.array(tokens.as_py(), np.int64)
            for low, high, keys in subset_keys(h, boundary):
                out[0].append(keys)
                out[1].append(np.full(len(keys), node))
                # of sets of one size all take both sides
                out[2].append(np.full(len(keys), 3 if low == high else 1 if len(h) == low else 2))
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "side"])


def subset_links(light: DataFrame, boundary: int) -> DataFrame:
    """(a, b): stars of the sets of light(node, tokens) that share a subset, which link."""
    keyed = light.select("node", "tokens").mapInArrow(lambda x: _subsets(x, boundary), "key long, node long, side long")
    of = lambda bit: F.min(F.when(F.col("side").bitwiseAND(F.lit(bit)) > 0, F.col("node")))
    keyed = stored(keyed, "subsets")
    firsts = keyed.groupBy("key").agg(of(1).alias("low"), of(2).alias("high"), F.count("*").alias("k")).where("k > 1 and low is not null and high is not null").drop("k")
    first = F.when(F.col("side") == 1, F.col("high")).otherwise(F.col("low"))
    stars = keyed.join(firsts, "key").select("node", first.alias("first")).where("node <> first").distinct()
    return stars.select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))


def boundary_of_least_cost(by_size: dict[int, tuple[int, int]]) -> int:
    """The largest size of a light set; by_size has, for each size up to MOST_LIGHT, the number of sets and of list entries that they scan."""

    def subsets(n: int, boundary: int) -> int:
        return sum(comb(n, overlap(n, m)) for m in partners(n) if 0 < m <= boundary and overlap(n, m) <= n)

    def cost(boundary: int) -> int:
        least = partners(boundary + 1)[0]
        made = sum(count * subsets(n, boundary) for n, (count, _) in by_size.items() if n <= boundary)
        return made + sum(scanned for n, (_, scanned) in by_size.items() if n >= least)

    # sets of fewer shingles link with none but their equals
    smallest = next(n for n in range(1, MOST_LIGHT) if len(partners(n)) > 1) - 1
    return min(range(smallest, MOST_LIGHT + 1), key=lambda b: (cost(b), b))


def lists(sets: DataFrame) -> DataFrame:
    """(token, node, n, k), stored: the rarest shingles of sets(node, n, tokens), k being a set's entries' counts added up."""
    placed = sets.select("node", "n", F.explode("tokens").alias("token"))
    common = stored(placed.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"), "common_shingles")
    beyond = F.col("token") >= F.lit(_BAND_END)
    known = placed.join(common, "token").select("node", F.struct(beyond.alias("beyond"), F.when(beyond, F.lit(0)).otherwise(F.col("k")).alias("k"), "token").alias("x"))
    held = known.groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("x"))
    in_band = F.size(F.filter("tokens", lambda t: t < F.lit(_BAND_END)))
    own = sets.select("node", "n", in_band.alias("in_band"))
    # shingles of the band that one set has come first, and nobody shares them
    alone = F.col("in_band") - F.size(F.filter("x", lambda x: ~x["beyond"]))
    t, of = SIMILAR
    smallest = F.expr(f"({t} * n + {of} - 1) div {of}")
    most = F.col("n") - F.floor((F.lit(t) * (F.col("n") + smallest) + (t + of - 1)) / F.lit(t + of)) + 1
    first = F.slice("x", F.lit(1), F.greatest(most - alone, F.lit(0)).cast("int"))
    chosen = held.join(own, "node").select("node", "n", first.alias("x")).where(F.size("x") > 0)
    use = F.aggregate("x", F.lit(0).cast("bigint"), lambda s, x: s + x["k"])
    return stored(chosen.select("node", "n", use.alias("use"), F.explode("x.token").alias("token")), "lists")


class _Block:
    """The sets of one block as arrays: node, group, n, heavy and bitmaps folded to the same size."""

    def __init__(self, sets: pa.StructArray) -> None:
        self.node, self.group, self.n, self.heavy = (sets.field(c).to_numpy(zero_copy_only=False) for c in ("node", "group", "n", "heavy"))
        bits = sets.field("bits")
        at, flat = bits.offsets.to_numpy(), bits.values.to_numpy()
        self.words = int(np.diff(at).min())
        self.bits = np.stack([folded(flat[at[i] : at[i + 1]], self.words) for i in range(len(sets))])

    def folded(self, words: int) -> np.ndarray:
        return np.bitwise_xor.reduce(self.bits.reshape(len(self.bits), -1, words), axis=1)


def may_link(x: _Block, y: _Block, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two blocks of pairs of different groups that may link, and in how many bits they differ."""
    t, of = SIMILAR
    total = x.n[:, None] + y.n[None, :]
    need = -(-t * total // (t + of))
    fits = (need <= np.minimum(x.n[:, None], y.n[None, :])) & (x.group[:, None] != y.group[None, :]) & (x.heavy[:, None] | y.heavy[None, :])
    if same:
        fits &= x.node[:, None] < y.node[None, :]
    words = min(x.words, y.words)
    r, c = np.nonzero(fits)
    left, right = x.folded(words).view(U64), y.folded(words).view(U64)
    apart = np.zeros(len(r), np.int64)
    for at in range(0, len(r), _PAIRS):
        part = slice(at, at + _PAIRS)
        apart[part] = np.bitwise_count(left[r[part]] ^ right[c[part]]).sum(1, dtype=np.int64)
    near = apart <= total[r, c] - 2 * need[r, c]
    return r[near], c[near], apart[near]


#: pairs whose bitmaps are compared at once
_PAIRS = 1 << 16


def _near_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of two blocks that may link with another of them."""
    for batch in batches:
        tokens, nodes = [], []
        for token, u, v, same in zip(batch["token"], batch["us"], batch["vs"], batch["same"], strict=True):
            x, y = _Block(u.values), _Block(v.values)
            r, c, _ = may_link(x, y, same.as_py())
            found = np.union1d(x.node[r], y.node[c])
            tokens.append(np.full(len(found), token.as_py()))
            nodes.append(found)
        columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (tokens, nodes)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node"])


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of two blocks of sets with texts: for groups that links connect, a tree of them."""
    t, of = SIMILAR
    for batch in batches:
        a, b = [], []
        for u, v, same in zip(batch["us"], batch["vs"], batch["same"], strict=True):
            x, y = _Block(u.values), _Block(v.values)
            texts = [z.values.field("text") for z in (u, v)]
            known, sets, root = Words(), ({}, {}), {}

            def whole(side: int, i: int) -> np.ndarray:
                if i not in sets[side]:
                    sets[side][i] = shingle_set(texts[side][i].as_py(), known)
                return sets[side][i]

            def find(g: int) -> int:
                while root.get(g, g) != g:
                    root[g] = root.get(root[g], root[g])
                    g = root[g]
                return g

            r, c, apart = may_link(x, y, same.as_py())
            for k in np.argsort(apart, kind="stable"):
                g, h = find(int(x.group[r[k]])), find(int(y.group[c[k]]))
                if g == h:
                    continue
                p, q = whole(0, int(r[k])), whole(1, int(c[k]))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both * of >= (len(p) + len(q) - both) * t:
                    root[g] = h
                    a.append(int(x.node[r[k]]))
                    b.append(int(y.node[c[k]]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t, of = SIMILAR
    for batch in batches:
        kept = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = shingle_set(x.as_py()), shingle_set(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(both * of >= (len(x) + len(y) - both) * t)
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def verified(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(a, b), stored: those of pairs(a, b) of rows(rid, text) that link."""
    close = stored(pairs, f"{name}_candidates")
    named = stored(close.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), f"{name}_named")
    # most texts aren't named, so they needn't be shuffled
    texts = stored(perhaps_in(rows.select("rid", "text"), "rid", bloom(named)).join(named, "rid", "left_semi"), f"{name}_texts")
    ends = [texts.select(F.col("rid").alias(end), F.col("text").alias(side)) for end, side in (("a", "x"), ("b", "y"))]
    links = stored(close.join(ends[0], "a").join(ends[1], "b").select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), f"{name}_links")
    forget(close, named, texts)
    return links


def _head_pairs(rows: DataFrame) -> DataFrame:
    """Each set with the head, of those of its lists, with which it shares most; of list rows(token, node, use)."""
    heads = rows.groupBy("token").agg(F.max(F.struct("use", (-F.col("node")).alias("minus"))).alias("head")).select("token", (-F.col("head.minus")).alias("head"), F.col("head.use").alias("most"))
    met = rows.join(heads, "token").where("node <> head").groupBy("node", "head").agg(F.count("*").alias("k"), F.max("most").alias("most"))
    best = met.groupBy("node").agg(F.max_by("head", F.struct("k", "most", (-F.col("head")).alias("minus"))).alias("head"))
    return best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _paired(members: DataFrame, blocks: Column, one: Column) -> DataFrame:
    """(token, us, vs, same): all pairs of blocks of the members of each list, cut into so many blocks."""
    block = F.pmod(F.xxhash64("node"), blocks)
    cut = stored(members.groupBy("token", block.alias("block")).agg(F.collect_list(one).alias("sets")), "list_blocks")
    left, right = (cut.select("token", F.col("block").alias(i), F.col("sets").alias(s)) for i, s in (("i", "us"), ("j", "vs")))
    return left.join(right, "token").where("i <= j").select("token", "us", "vs", (F.col("i") == F.col("j")).alias("same"))


def _links_of_groups(rows: DataFrame, held: DataFrame, found: DataFrame, sets: DataFrame, boundary: int) -> DataFrame:
    """(a, b), stored: links that connect the groups found(of, root) further, of sets that stand in one list."""
    grouped = stored(held.join(found, held["node"] == found["of"], "left").select("token", "node", F.coalesce("root", "node").alias("group")), "lists_of_groups")
    mixed = grouped.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("k")).where("low <> high").select("token", "k")
    open_ = stored(grouped.join(mixed, "token").join(sets.select("node", "n", "bits"), "node").withColumn("heavy", F.col("n") > boundary), "mixed_lists")
    one = ["node", "group", "n", "heavy", "bits"]
    near = _paired(open_, F.ceil(F.col("k") / BLOCK), F.struct(*one)).mapInArrow(_near_nodes, "token long, node long").distinct()
    near = stored(near, "near_nodes")
    named = stored(near.select(F.col("node").alias("rid")).distinct(), "near_named")
    texts = stored(perhaps_in(rows.select("rid", "text"), "rid", bloom(named)).join(named, "rid", "left_semi").withColumnRenamed("rid", "node"), "near_texts")
    kept = open_.drop("k").join(near, ["token", "node"]).join(texts, "node")
    sizes = kept.groupBy("token").agg(F.greatest(F.ceil(F.count("*") / WHOLE), F.ceil(F.sum(F.octet_length("text")) / WHOLE_BYTES)).alias("blocks"))
    links = _paired(kept.join(sizes, "token"), F.col("blocks"), F.struct(*one, "text")).mapInArrow(_linking, "a long, b long").distinct()
    links = stored(links, "links_of_groups")
    forget(open_, near, named, texts)
    return links


def linked_sets(rows: DataFrame, sets: DataFrame, boundary: int | None = None) -> DataFrame:
    """(node, root) of the sets of sets(node, n, bits, tokens) that link with others; rows(rid, text) has the nodes' texts."""
    linking = sets.where(F.col("n") >= next(n for n in range(1, MOST_LIGHT) if len(partners(n)) > 1))
    held = lists(linking)
    size = held.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    held = stored(held.join(size, "token"), "shared_lists")
    if boundary is None:
        small = linking.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.count("*").alias("sets"))
        scanned = held.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("size").alias("scanned"))
        by_size = {r["n"]: (r["sets"], r["scanned"] or 0) for r in small.join(scanned, "n", "left").collect()}
        boundary = boundary_of_least_cost(by_size)
    least = partners(boundary + 1)[0]
    held = held.where(F.col("n") >= least)
    light = subset_links(linking.where(F.col("n") <= boundary), boundary)
    first = verified(rows, light.unionByName(_head_pairs(held)).distinct(), "first")
    found = components(first)
    other = _links_of_groups(rows, held, found.select(F.col("node").alias("of"), "root"), sets, boundary)
    return components(other.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def jaccard_components(docs: DataFrame, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = numbered(docs.select("doc_id", "text"), "rid")
    made = stored(rows.select("rid", "doc_id", "text").mapInArrow(_sets, _SETS.format(id=kind)), "shingle_sets")
    owners = stored(made.where("n > 0").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first")), "distinct_sets")
    sets = made.join(owners.select(F.col("node").alias("rid")), "rid", "left_semi")
    sets = stored(sets.select(F.col("rid").alias("node"), "n", "bits", "tokens"), "sets")
    named = stored(made.select("doc_id", "digest", F.col("n").alias("n_shingles")), "named_sets")
    forget(made)
    found = linked_sets(rows, sets, boundary)
    rooted = owners.join(found, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = stored(rooted.join(least, "root").select("digest", "component_id"), "components")
    full = named.where("n_shingles > 0").join(owner, "digest").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {"op13_set_join": op13_set_join}
_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL = {
    "op13_set_join": f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS s FROM words),
marked AS MATERIALIZED (SELECT r, doc_id, len(s) AS n, s, md5(array_to_string(list_sort(s), chr(10))) AS digest FROM sets),
owners AS MATERIALIZED (SELECT min(r) AS node, min(doc_id) AS first, any_value(n) AS n, any_value(s) AS s FROM marked WHERE n > 0 GROUP BY digest),
tokens AS MATERIALIZED (SELECT node, n, unnest(s) AS token FROM owners),
links AS MATERIALIZED (
  SELECT x.node AS a, y.node AS b FROM tokens x JOIN tokens y USING (token) WHERE x.node <> y.node AND x.n * 100 >= y.n * 90 AND y.n * 100 >= x.n * 90
  GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT o.node, least(o.first, min(p.first)) AS component_id FROM owners o LEFT JOIN reach ON reach.a = o.node LEFT JOIN owners p ON p.node = reach.b GROUP BY o.node, o.first),
of AS (SELECT m.digest, l.component_id FROM marked m JOIN least l ON l.node = m.r)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE of.component_id END AS component_id
FROM marked LEFT JOIN of ON of.digest = marked.digest AND n > 0"""
}
