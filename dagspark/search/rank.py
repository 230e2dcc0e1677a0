"""Ranking of texts and code chunks against a query, as Spark plans.

The query is small and known on the driver; the corpus stays distributed. All
rankers end in a bounded top-k.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bounded
from ..functions.text import STOPWORDS, cosine, kgrams
from .store import ROWS, SearchIndex, fingerprints

# Weights of the fused score and of the simple one.
INTENT, API, KIND, ALIGN, STAR = 0.34, 0.33, 0.13, 0.20, 0.02
COVERAGE, TFIDF = 0.55, 0.45
LEAF, MINHASH = 0.60, 0.40
SIMPLE_COSINE, SIMPLE_JACCARD, NAME_HIT, TAG_HIT = 0.65, 0.25, 0.08, 0.02
MATCH, SUBSTITUTE, MISMATCH, GAP = 2.0, 1.5, -1.0, -1.0
PERMUTATIONS, RERANK_POOL = 64, 50

# Calls that stand for each other.
EQUIVALENT = (
    ("np.mean", "numpy.mean", "mean"),
    ("signal.butter", "bandpass_filter", "butter"),
    ("signal.sosfilt", "sosfilt", "signal.filtfilt", "filtfilt"),
    ("common_reference", "cmr", "car"),
    ("plt.plot", "plot", "plt.show"),
    ("plt.eventplot", "raster"),
    ("np.histogram", "histogram", "psth"),
    ("Kilosort", "kilosort", "sorter"),
    ("export_to_phy", "phy"),
    ("isi_violations", "isi"),
    ("spikeinterface.preprocessing", "preprocessing"),
)
_GROUP = {name.lower(): i for i, names in enumerate(EQUIVALENT) for name in names}

# Analysis words and the calls that they mean.
OPERATIONS = {
    "bandpass": ("signal.butter", "signal.sosfilt"),
    "bandpass_filter": ("signal.butter", "signal.sosfilt", "bandpass_filter"),
    "lowpass": ("signal.butter", "signal.sosfilt"),
    "highpass": ("signal.butter", "signal.sosfilt"),
    "notch": ("signal.iirnotch", "signal.sosfilt"),
    "filter": ("signal.butter", "signal.sosfilt", "signal.filtfilt"),
    "filtfilt": ("signal.filtfilt",),
    "butter": ("signal.butter",),
    "sosfilt": ("signal.sosfilt",),
    "welch": ("signal.welch",),
    "psd": ("signal.welch", "signal.periodogram"),
    "periodogram": ("signal.periodogram",),
    "fft": ("np.fft.rfft", "np.fft.fft"),
    "psth": ("np.histogram", "np.bincount"),
    "histogram": ("np.histogram",),
    "raster": ("plt.eventplot",),
    "plot": ("plt.plot", "plt.show"),
    "common_reference": ("common_reference",),
    "whiten": ("whiten",),
    "kilosort": ("Kilosort", "sorter"),
    "sorter": ("sorter", "Kilosort"),
    "quality_metrics": ("quality_metrics",),
    "isi": ("isi_violations", "quality_metrics"),
    "violation": ("isi_violations",),
    "isi_violations": ("isi_violations", "quality_metrics"),
    "waveforms": ("waveforms",),
    "templates": ("templates",),
    "export_to_phy": ("export_to_phy",),
    "phy": ("export_to_phy",),
    "spikeinterface": ("spikeinterface.preprocessing",),
    "preprocessing": ("spikeinterface.preprocessing",),
}
# Phrases that mean calls.
PHRASES = {
    "isi violation": ("isi_violations", "quality_metrics"),
    "quality metrics": ("quality_metrics",),
    "common reference": ("common_reference",),
    "export to phy": ("export_to_phy",),
    "spike interface": ("spikeinterface.preprocessing",),
}


def _terms(docs: DataFrame) -> DataFrame:
    """(id, length, term, tf) of docs(id, words). A document's terms are counted where it is read, so no words are shuffled."""
    bounded(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "words").mapInArrow(_counted, f"id {kind}, length int, term string, tf bigint")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.columns
        flat = words.flatten()
        coded = flat.dictionary_encode()
        n = max(len(coded.dictionary), 1)
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        both = pc.list_parent_indices(words).to_numpy()[there].astype(np.int64) * n + coded.indices.fill_null(0).to_numpy()[there]
        both, tf = np.unique(both, return_counts=True)
        for i in range(0, len(both), ROWS):
            doc, term = pa.array(both[i : i + ROWS] // n), pa.array(both[i : i + ROWS] % n)
            columns = [ids.take(doc), pc.list_value_length(words).take(doc).cast(pa.int32()), coded.dictionary.take(term), pa.array(tf[i : i + ROWS].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "length", "term", "tf"])


#: how many documents have each term (term, df), and how many documents there are
Corpus = tuple[DataFrame, int]


def tfidf_cosine(docs: DataFrame, query: list[str], corpus: Corpus | None = None) -> DataFrame:
    """(id, cosine) of docs(id, words) that share a term with the query: tf is count over length, idf ln((N + 1) / (df + 1)).

    Without the corpus's frequencies those of docs are counted.
    """
    # every document counts for how rare a term is, but only those with a term of the query are weighed
    if corpus:
        df, n = corpus[0], docs.sparkSession.createDataFrame([(corpus[1],)], "n bigint")
    else:
        n = docs.agg(F.count("*").alias("n"))
        df = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms = _terms(docs.where(F.arrays_overlap("words", _list(list(dict.fromkeys(query)))) if query else F.lit(False)))
    counts = {w: query.count(w) for w in dict.fromkeys(query)}
    spark = docs.sparkSession
    q = spark.createDataFrame([(w, c / len(query)) for w, c in counts.items()], "term string, qtf double")
    idf = F.ln((F.col("n") + 1) / (F.coalesce(F.col("df"), F.lit(0)) + 1))
    qw = F.broadcast(q).join(df, "term", "left").crossJoin(F.broadcast(n)).select("term", (F.col("qtf") * idf).alias("qw"))
    norm = qw.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weighted = terms.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", (F.col("tf") / F.col("length") * idf).alias("w"))
    sums = weighted.join(F.broadcast(qw), "term", "left").groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return sums.where("dot is not null").crossJoin(F.broadcast(norm)).select("id", F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("qnorm")), F.lit(0.0)).alias("cosine"))


def _list(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def rank_simple(docs: DataFrame, query: list[str], limit: int = 20, corpus: Corpus | None = None) -> DataFrame:
    """docs(id, words, name_words, tags, starred) by .65 cosine + .25 Jaccard + .08 per name hit + .02 per tag hit (+ .02 if starred)."""
    q = _list(list(dict.fromkeys(query)))
    shared = lambda c: F.size(F.array_intersect(F.array_distinct(F.col(c)), q)).cast("double")
    union = F.size(F.array_union(F.col("words"), q)).cast("double")
    # what the score needs of the words is made before the join, which would shuffle and sort them
    parts = docs.select("id", "starred", F.coalesce(F.try_divide(shared("words"), union), F.lit(0.0)).alias("jaccard"), shared("name_words").alias("names"), shared("tags").alias("tagged"))
    joined = parts.join(tfidf_cosine(docs.select("id", "words"), query, corpus), "id", "left")
    score = SIMPLE_COSINE * F.coalesce("cosine", F.lit(0.0)) + SIMPLE_JACCARD * F.col("jaccard") + NAME_HIT * F.col("names") + TAG_HIT * F.col("tagged")
    score = F.when(score > 0, score + F.when(F.col("starred"), STAR).otherwise(0.0))
    return joined.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def expand(query: str) -> list[str]:
    """The calls that a query's phrases and words mean, in order."""
    low = query.lower()
    calls = [c for p, names in PHRASES.items() if p in low for c in names]
    for w in low.replace("(", " ").replace(",", " ").split():
        calls += OPERATIONS.get(w.strip(".;:)"), ())
        if "." in w.strip("."):
            calls.append(w.strip(".;:)"))
    return list(dict.fromkeys(calls))


def minhash(items: list[str], n: int = PERMUTATIONS) -> list[int]:
    """n minima of 64-bit blake2b hashes, each with its number (4 bytes, little-endian) put before; zeros for no items."""
    if not items:
        return [0] * n
    data = [x.encode() for x in items]
    return [min(int.from_bytes(hashlib.blake2b(i.to_bytes(4, "little") + x, digest_size=8).digest(), "big") for x in data) for i in range(n)]


def alignment(a: list[str], b: list[str]) -> float:
    """Smith-Waterman score of two call sequences over that of the query a with itself, in 0 to 1."""
    if not a or not b:
        return 0.0
    a, b = [x.lower() for x in a], [x.lower() for x in b]
    leaf = lambda x: x.rsplit(".", 1)[-1]
    group = {x: _GROUP.get(x, _GROUP.get(leaf(x), x)) for x in (*a, *b)}
    row, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            if not x or not y:
                s = MISMATCH
            elif x == y:
                s = MATCH
            elif leaf(x) == leaf(y) or group[x] == group[y]:
                s = SUBSTITUTE
            else:
                s = MISMATCH
            new.append(max(0.0, row[j - 1] + s, row[j] + GAP, new[j - 1] + GAP))
            best = max(best, new[j])
        row = new
    return min(max(best / (MATCH * len(a)), 0.0), 1.0)


def _scored(batches: Iterator[pd.DataFrame], calls: list[str], signature: list[int]) -> Iterator[pd.DataFrame]:
    q = np.array(signature, np.uint64)
    for pdf in batches:
        same = [float((np.array(minhash(list(g)), np.uint64) == q).mean()) if len(g) and signature.count(0) < len(signature) else 0.0 for g in pdf["grams"]]
        yield pd.DataFrame({"id": pdf["id"], "minhash": same, "align": [alignment(calls, list(c)) for c in pdf["calls"]]})


def candidates(docs: DataFrame, terms: list[str], grams: list[str]) -> DataFrame:
    """ids of the chunks that share an intent term or a k-gram of calls with the query (posting lists, semi-joined)."""
    postings = docs.select("id", F.explode(F.concat(F.transform("intent", lambda x: F.concat(F.lit("t:"), x)), F.transform("grams", lambda x: F.concat(F.lit("g:"), x)))).alias("key"))
    wanted = docs.sparkSession.createDataFrame([(f"t:{t}",) for t in terms] + [(f"g:{g}",) for g in grams], "key string")
    return postings.join(F.broadcast(wanted), "key", "left_semi").select("id").distinct()


def query_grams(spark: SparkSession, calls: list[str]) -> tuple[list[str], list[str]]:
    """The k-grams of a query's calls, and their fingerprints."""
    row = spark.range(1).select(kgrams(_list(calls)).alias("g")).select("g", fingerprints(F.col("g")).alias("f")).first()
    return list(row.g), list(row.f)


def fused_keys(spark: SparkSession, terms: list[str], calls: list[str]) -> list[tuple[str, str]]:
    """The posting lists of a query: its intent terms, k-grams of calls and fingerprints."""
    grams, prints = query_grams(spark, calls)
    return [("t", x) for x in dict.fromkeys(terms)] + [("g", x) for x in grams] + [("f", x) for x in prints]


def fused_signals(chosen: DataFrame, terms: list[str], calls: list[str], kinds: list[str], corpus: Corpus) -> DataFrame:
    """(id, starred, coverage, cosine, leaf, minhash, kind, align) of the chosen chunks(id, intent, calls, grams, kinds, starred)."""
    spark = chosen.sparkSession
    grams, _ = query_grams(spark, calls)
    unique = list(dict.fromkeys(terms))
    signature = minhash(grams)
    heavy = chosen.select("id", "grams", "calls").mapInPandas(lambda x: _scored(x, calls, signature), "id string, minhash double, align double")
    cos = tfidf_cosine(chosen.select("id", F.col("intent").alias("words")), terms, corpus) if terms else spark.createDataFrame([], "id string, cosine double")
    q, leaves = _list(unique), F.array_distinct(F.transform(F.col("calls"), lambda x: F.lower(F.substring_index(x, ".", -1))))
    q_leaves = _list(list(dict.fromkeys(c.rsplit(".", 1)[-1].lower() for c in calls)))
    both = F.size(F.array_intersect(leaves, q_leaves)).cast("double")
    f1 = F.coalesce(F.try_divide(2 * both, F.size(leaves) + F.size(q_leaves)), F.lit(0.0))
    union = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
    # without a common leaf, calls in common (of which there are none then but in another case), and then call sequences
    same_calls = union(F.array_distinct("calls"), _list(list(dict.fromkeys(calls)))) if calls else F.lit(0.0)
    leaf = F.when(f1 > 0, f1).when(same_calls > 0, same_calls).otherwise(union(F.col("grams"), _list(grams)))
    coverage = F.size(F.array_intersect(F.array_distinct("intent"), q)) / F.lit(float(max(len(unique), 1)))
    kind = F.size(F.array_intersect(F.array_distinct("kinds"), _list(list(dict.fromkeys(kinds))))) / F.lit(float(len(set(kinds)))) if kinds else F.lit(0.0)
    # lists become numbers before the joins, which would shuffle and sort them
    parts = chosen.select("id", "starred", coverage.alias("coverage"), leaf.alias("leaf"), F.coalesce(kind, F.lit(0.0)).alias("kind"))
    signals = parts.join(cos, "id", "left").join(heavy, "id")
    return signals.select("id", "starred", "coverage", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), "leaf", "minhash", "kind", "align")


def fused_scores(signals: DataFrame, limit: int = 20) -> DataFrame:
    """(id, score, align) of the best chunks by the weighed signals."""
    score = INTENT * (COVERAGE * F.col("coverage") + TFIDF * F.col("cosine")) + API * (LEAF * F.col("leaf") + MINHASH * F.col("minhash")) + KIND * F.col("kind") + ALIGN * F.col("align")
    score = F.when(score > 0, score + F.when(F.col("starred"), STAR).otherwise(0.0))
    return signals.select("id", score.alias("score"), "align").where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def rank_fused(docs: DataFrame, query: str, terms: list[str], calls: list[str], kinds: list[str], limit: int = 20) -> DataFrame:
    """docs(id, intent, calls, kinds, starred) by the four signals, scored only where a posting list has the chunk; without a stored index."""
    docs = docs.withColumn("grams", kgrams(F.col("calls")))
    grams, _ = query_grams(docs.sparkSession, calls)
    frequencies = docs.select(F.explode(F.array_distinct("intent")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    chosen = docs.join(candidates(docs, terms, grams), "id", "left_semi")
    return fused_scores(fused_signals(chosen, terms, calls, kinds, (frequencies, docs.count())), limit)


def search_simple(index: SearchIndex, query: list[str], limit: int = 20) -> DataFrame:
    """rank_simple over a stored index: only documents that hold a word of the query, in their text or name, are read."""
    if not query:
        return index.features().select("id", F.lit(0.0).alias("score")).limit(0)
    chosen = index.chosen([("w", x) for x in query] + [("n", x) for x in query])
    return rank_simple(chosen, query, limit, (index.frequencies("w"), index.size()))


def search_fused(index: SearchIndex, terms: list[str], calls: list[str], kinds: list[str], limit: int = 20) -> DataFrame:
    """rank_fused over a stored index."""
    return fused_scores(index_signals(index, terms, calls, kinds), limit)


def index_signals(index: SearchIndex, terms: list[str], calls: list[str], kinds: list[str]) -> DataFrame:
    """The signals of the documents of an index that stand in a list of the query."""
    chosen = index.chosen(fused_keys(index.spark, terms, calls))
    return fused_signals(chosen, terms, calls, kinds, (index.frequencies("t"), index.size()))


def rerank(ranked: DataFrame, vectors: DataFrame, query: list[float], pool: int = RERANK_POOL) -> DataFrame:
    """ranked(id, score): .4 of the score and .6 of the cosine for the best `pool`, the others keep theirs behind them."""
    top = ranked.orderBy(F.desc("score"), "id").limit(pool)
    near = cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in query)))
    new = top.join(vectors, "id", "left").select("id", (0.4 * F.col("score") + 0.6 * F.coalesce(near, F.lit(0.0))).alias("score"), F.lit(0).alias("part"))
    rest = ranked.join(F.broadcast(top.select("id")), "id", "left_anti").select("id", "score", F.lit(1).alias("part"))
    return new.union(rest).orderBy("part", F.desc("score"), "id").drop("part")


def is_code(query: str) -> bool:
    return any(x in query for x in ("(", "=", "import ")) and not set(query.split()) <= set(STOPWORDS)
