"""Operator 2: benchmark decontamination by a positional inverted index, with DataFrame functions only.

The documents' words that occur in any benchmark item are stored as postings
(document, term, position), and counted by term. Of each window of a benchmark
item (`window` consecutive words; a shorter item is one window) the rarest
terms are chosen by those counts; a window with a term that no document has
among its two rarest needs no further look. For the chosen terms the postings
become sorted lists by term and document. Lists are intersected in pairs from
the rarer term's side: its positions, moved by the offset of the other term in
the window, must be positions of the other term. Pairs of terms at an offset
are intersected once however many windows and items share them. What is left
are alignments of windows in documents; there the words are compared.

An exact phrase match is a window that stands in a document word by word; its
two rarest terms stand at their exact offset. A proximity match needs the text alone: a
window and an alignment at which at least `near` of its words stand at as many
places, each word at the place nearest to its own and no further than window -
near from it. At most window - near words are missing then, so of one pair more
than that, made of the window's rarest terms, one is whole; its lists,
intersected with that much slack, hold a place no further away than that from
every such alignment. The rarest term is paired with the least rare of them, and
so on, so each pair is looked up by a rare one. So all windows are
found in which two words were replaced, put in or left out, or neighbours
swapped. Ties of counts go to the earlier word. Proximity is reported for items
without an exact match in the document; items of `near` words and fewer can lack
nothing.

Null and empty texts have no words and no hits. Null item_ids aren't reported,
though their words are hit. Repeated documents each give a row; repeated
item_ids count once. Without documents the result is empty, without benchmark
items nothing is hit. Only doc_id, item_id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BETWEEN_WORDS, LOWER, UPPER, ascii_lower, documents, numbered, stored

WINDOW, NEAR = 10, 8
#: a window's rarest terms, in so many pairs that one is whole in any proximity match
FEW = 2 * (WINDOW - NEAR + 1)
#: the benchmark's distinct terms are broadcast only up to this many (of at most _TERM_BYTES), and its pairs of terms; else they are joined by a shuffle
BROADCAST_TERMS, _TERM_BYTES = 200_000, 64
#: the pseudo term at which a document's number of words is stored
_END = -1


def _split(text: Column) -> Column:
    """The text's words; none of a null or empty text. The text is split once: a generator's or a filter's repeated expressions would be computed again each time."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _bounded(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it has few rows; it is stored or small."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def index(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, items), stored, of docs(rid, doc_id, text) and benchmark(item_id, text).

    postings(rid, doc_id, pos, term), with one of the term _END for each document; items(iid, item_id, words, terms), terms being of struct<n, pos, term>, n how many postings the term has.
    """
    items = stored(benchmark.select(F.monotonically_increasing_id().alias("iid"), "item_id", _split(F.col("text")).alias("words")), "benchmark_words")
    words = items.select(F.explode("words").alias("word")).distinct()
    end = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(_END).cast("bigint").alias("term"))
    terms = stored(words.select("word", F.monotonically_increasing_id().alias("term")).union(end), "benchmark_terms")
    n, size = terms.agg(F.count("*"), F.coalesce(F.max(F.octet_length("word")), F.lit(0))).first()
    small = n <= BROADCAST_TERMS and n * size <= BROADCAST_TERMS * _TERM_BYTES
    # exploded where it is made: of a column's array Spark would infer a filter on its size and compute the array for that too
    split = docs.select("rid", "doc_id", F.posexplode(F.concat(_split(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    postings = stored(split.join(F.broadcast(terms) if small else terms, "word").select("rid", "doc_id", "pos", "term"), "postings")
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    placed = items.select("iid", F.posexplode("words").alias("pos", "word")).join(terms, "word").join(counts, "term", "left")
    listed = placed.groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("pos", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("terms"))
    counted = F.transform("terms", lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"), x["term"].alias("term")))
    return postings, stored(items.join(listed, "iid").select("iid", "item_id", "words", counted.alias("terms")), "benchmark_items")


def rarest(items: DataFrame, window: int, few: int, least: int = 0) -> DataFrame:
    """(iid, start, wide, first, r, o, shift), stored: for each window of the items of more than `least` words its `few` rarest terms in disjoint pairs.

    The rarer term r stands at position `first` of the item, the other term o
    `shift` further on. A window of one word has its term twice. Pairs with a
    term that no document has are left out.
    """
    wide = F.least(F.size("terms"), F.lit(window))
    starts = items.where((F.size("terms") > least) & (F.size("terms") > 0)).select("iid", wide.alias("wide"), "terms", F.explode(F.sequence(F.lit(0), F.size("terms") - wide)).alias("start"))
    ranked = starts.select("iid", "start", "wide", F.slice(F.array_sort(F.slice("terms", F.col("start") + 1, F.col("wide"))), 1, few).alias("x"))
    last = F.size("x") - 1
    pairs = F.transform(F.sequence(F.lit(0), F.floor(last / 2).cast("int")), lambda i: F.struct(F.get("x", i).alias("a"), F.get("x", last - i).alias("b")))
    pair = ranked.select("iid", "start", "wide", F.explode(pairs).alias("p")).where("p.a.n > 0 and p.b.n > 0")
    return stored(pair.select("iid", "start", "wide", F.col("p.a.pos").alias("first"), F.col("p.a.term").alias("r"), F.col("p.b.term").alias("o"), (F.col("p.b.pos") - F.col("p.a.pos")).alias("shift")), "rarest_terms")


def lists(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(term, rid, at), stored, sorted by term: the sorted positions in each document of the terms of pairs(r, o)."""
    terms = _bounded(pairs.select(F.explode(F.array("r", "o")).alias("term")).distinct())
    held = postings.join(terms, "term", "left_semi").groupBy("term", "rid").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    return stored(held.sortWithinPartitions("term", "rid"), "positions")


def alignments(held: DataFrame, seeds: DataFrame, slack: int) -> DataFrame:
    """(rid, iid, delta, wide, starts), stored: alignments no further than slack from where the terms of a pair of seeds stand in a document, as far from their offset.

    Word i of the item may stand at position i + delta of the document; starts
    are those of the windows whose pair stands there.
    """
    pairs = _bounded(stored(seeds.select("r", "o", "shift").distinct(), "pairs"))
    rarer = held.select(F.col("term").alias("r"), "rid", F.col("at").alias("p")).join(pairs, "r")
    both = rarer.join(held.select(F.col("term").alias("o"), "rid", F.col("at").alias("q")), ["o", "rid"])
    if slack:
        near = lambda at, by: F.flatten(F.transform(at, lambda x: F.sequence(x + by - slack, x + by + slack)))
        places = F.concat(F.array_intersect("p", near(F.col("q"), -F.col("shift"))), F.transform(F.array_intersect("q", near(F.col("p"), F.col("shift"))), lambda x: x - F.col("shift")))
    else:
        places = F.array_intersect("p", F.transform("q", lambda x: x - F.col("shift")))
    placed = stored(both.select("r", "o", "shift", "rid", F.array_distinct(places).alias("places")).where(F.size("places") > 0), "places")
    each = placed.join(_bounded(seeds), ["r", "o", "shift"])
    one = each.select("rid", "iid", "wide", "start", F.explode("places").alias("place"), "first").select("rid", "iid", "wide", "start", (F.col("place") - F.col("first")).alias("delta"))
    if slack:
        one = one.withColumn("delta", F.explode(F.sequence(F.col("delta") - slack, F.col("delta") + slack)))
    return stored(one.groupBy("rid", "iid", "delta", "wide").agg(F.collect_set("start").alias("starts")), "alignments")


def _pieces(docs: DataFrame, asked: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """(rid, iid, delta, wide, start, v, w, shift) of each window that asked has: its words, those of the document around it, and where in w its own place begins."""
    texts = docs.join(asked.select("rid").distinct(), "rid", "left_semi").select("rid", _split(F.col("text")).alias("text"))
    named = asked.join(stored(texts, "aligned_texts"), "rid").join(items.select("iid", "words"), "iid")
    low = lambda s: F.greatest(s + F.col("delta") - slack, F.lit(0))

    def piece(s: Column) -> Column:
        own = F.slice("words", s + 1, F.col("wide"))
        around = F.slice("text", low(s) + 1, F.greatest(s + F.col("delta") + F.col("wide") + slack - low(s), F.lit(0)))
        return F.struct(s.alias("start"), own.alias("v"), around.alias("w"), (s + F.col("delta") - low(s)).alias("shift"))

    return named.select("rid", "iid", "delta", "wide", F.explode(F.transform("starts", piece)).alias("x")).select("rid", "iid", "delta", "wide", "x.*")


def exact(docs: DataFrame, asked: DataFrame, items: DataFrame) -> DataFrame:
    """(rid, iid, delta, start, wide), stored: the windows of asked that stand word by word."""
    same = (F.col("delta") + F.col("start") >= 0) & (F.col("v") == F.col("w"))
    return stored(_pieces(docs, asked, items, 0).where(same).select("rid", "iid", "delta", "start", "wide"), "exact_hits")


def nearly(docs: DataFrame, asked: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """(rid, iid), stored: items with a proximity match in a document of docs(rid, text), of the windows of asked."""
    slack = window - near
    tried = _pieces(docs, asked, items, slack)
    offsets = [0] + [sign * e for e in range(1, slack + 1) for sign in (-1, 1)]

    def stands(x: Column, j: Column) -> Column:
        """The place nearest to its own at which the window's word stands."""
        return F.coalesce(*(F.when((j + F.col("shift") + e >= 0) & (F.get("w", F.greatest(j + F.col("shift") + e, F.lit(0))) == x), j + F.col("shift") + e) for e in offsets))

    stood = tried.select("rid", "iid", F.array_compact(F.transform("v", stands)).alias("stood"))
    return stored(stood.where((F.size("stood") >= near) & (F.size(F.array_distinct("stood")) >= near)).select("rid", "iid").distinct(), "near_hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = NEAR, rid: str | None = None) -> DataFrame:
    """One row for each document: its words, those hit, the items with exact matches in it; and, unless near is None, those with proximity matches only.

    rid names a column of docs with a number of each row, where there is one.
    """
    docs = (docs.withColumn("rid", F.col(rid)) if rid else numbered(docs.select("doc_id", "text"), "rid")).select("rid", "doc_id", "text")
    postings, items = index(docs, benchmark)
    names = items.select("iid", F.col("item_id").cast("string").alias("item"))
    seeds = rarest(items, window, 2)
    wanted = seeds
    if near is not None:
        few = rarest(items, window, 2 * (window - near + 1), near)
        wanted = seeds.unionByName(few)
    held = lists(postings, wanted.select("r", "o"))
    matched = exact(docs, alignments(held, seeds, 0), items)
    spans = F.sequence(F.col("start") + F.col("delta"), F.col("start") + F.col("delta") + F.col("wide") - 1)
    words = matched.select("rid", F.explode(spans).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    hits = words.join(matched.join(names, "iid").groupBy("rid").agg(F.collect_set("item").alias("items")), "rid", "full")
    if near is not None:
        open_ = alignments(held, few, window - near).join(matched.select("rid", "iid").distinct(), ["rid", "iid"], "left_anti")
        partly = nearly(docs, stored(open_, "near_candidates"), items, window, near).join(names, "iid").groupBy("rid").agg(F.collect_set("item").alias("near_items"))
        hits = hits.join(partly, "rid", "full")
    texts = postings.where(F.col("term") == _END).select("rid", "doc_id", F.col("pos").cast("bigint").alias("n_words"))
    out = texts.join(stored(hits, "contamination"), "rid", "left")
    none = F.array().cast("array<string>")
    listed = F.array_sort(F.coalesce("items", none))
    columns = [
        F.col("doc_id"), F.col("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    ]
    if near is not None:
        nearby = F.array_sort(F.array_except(F.coalesce("near_items", none), listed))
        columns += [F.size(nearby).cast("bigint").alias("n_near"), F.array_join(nearby, ",").alias("near_items")]
    return out.select(*columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SLACK = WINDOW - NEAR
QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT i, item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT i, item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, item_id, s, n FROM grams JOIN win USING (n, g)),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r),
cnt AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM d) GROUP BY x),
bw AS (SELECT i, w AS v, s, unnest(range(s, s + least(len(w), {WINDOW}))) AS p FROM (SELECT i, w, unnest(range(1, 1 + greatest(len(w) - {WINDOW - 1}, 1))) AS s FROM b WHERE len(w) > {NEAR})),
few AS (SELECT i, v, s, p, v[p] AS x FROM bw LEFT JOIN cnt ON cnt.x = v[p] QUALIFY row_number() OVER (PARTITION BY i, s ORDER BY coalesce(n, 0), p) <= {FEW}),
occ AS (SELECT r, w, generate_subscripts(w, 1) AS q, unnest(w) AS x FROM d),
cand AS (SELECT DISTINCT r, i, w, v, q - p + e AS delta, s FROM occ JOIN few USING (x) CROSS JOIN range({-_SLACK}, {_SLACK + 1}) AS t(e) ANTI JOIN (SELECT DISTINCT r, i FROM hit) USING (r, i)),
word AS (SELECT r, i, delta, s, v[j] AS x, w, j + delta AS q FROM (SELECT *, unnest(range(s, s + least(len(v), {WINDOW}))) AS j FROM cand)),
stood AS (SELECT r, i, delta, s, CASE {" ".join(f"WHEN q + {e} >= 1 AND q + {e} <= len(w) AND w[greatest(q + {e}, 1)] = x THEN q + {e}" for e in [0] + [q * e for e in range(1, _SLACK + 1) for q in (-1, 1)])} END AS p FROM word),
part AS (SELECT DISTINCT r, i FROM (SELECT r, i FROM stood GROUP BY r, i, delta, s HAVING count(p) >= {NEAR} AND count(DISTINCT p) >= {NEAR})),
parts AS (SELECT r, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM part JOIN b USING (i) WHERE item_id IS NOT NULL EXCEPT SELECT r, item_id::VARCHAR FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r) LEFT JOIN parts USING (r)"""
}
