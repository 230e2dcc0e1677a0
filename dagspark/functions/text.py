"""Text functions over columns: tokens, k-grams, hashes of token sets, kinds and tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no intent.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "with", "this", "that", "is", "are", "be", "as", "from", "by", "at", "it", "its", "if",
    "else", "not", "no", "yes", "return", "returns", "returned", "none", "true", "false", "self", "cls", "def", "class", "import", "into", "using", "use",
    "used", "between", "over", "per", "via", "than", "then", "them", "their", "can", "will", "chunk",
)

# Tags of functions, in order.
TAG_VOCABULARY = (
    "filter", "bandpass", "lowpass", "highpass", "notch", "psd", "spectrum", "welch", "fft", "spike", "spikes", "isi", "psth", "raster", "eeg", "lfp",
    "calcium", "neural", "load", "loader", "save", "read", "write", "export", "normalize", "scale", "standardize", "cluster", "pca", "regress", "plot",
    "visual", "preprocess", "analyze", "detect",
)

# Words that hint at a kind of data; hints longer than three letters also count inside a token.
KIND_HINTS = {
    "eeg": ("eeg", "electroencephal", "electroencephalogram", "scalp"),
    "spike": ("spike", "spikes", "psth", "raster", "isi", "spiketrain", "kilosort", "spikeinterface", "phy", "sorter", "waveforms", "templates"),
    "lfp": ("lfp", "localfield", "localfieldpotential"),
    "calcium": ("calcium", "gcamp", "ca2"),
    "table": ("table", "dataframe", "csv"),
}
WINNOW_WINDOW = 4


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row, however often the body uses it (an expression would be repeated, in lambdas for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, split at underscores and before each capital letter but a leading one."""
    # an underscore is no letter of a token and empty tokens go, so neither it nor a leading capital needs a look
    spaced = F.regexp_replace(c, "([A-Z])", " $1")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def intent_tokens(c: Column) -> Column:
    """Tokens that are no stopwords and longer than one letter."""
    return intent(tokens(c))


def intent(words: Column) -> Column:
    """The same of tokens."""
    return F.filter(words, lambda x: ~x.isin(*STOPWORDS) & (F.length(x) > 1))


def kgrams(calls: Column) -> Column:
    """Distinct calls, last parts of their names, and pairs and triples of calls joined by '||'."""

    def runs(c: Column, k: int) -> Column:
        starts = F.when(F.size(c) >= k, F.sequence(F.lit(1), F.size(c) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(c, i, k), "||"))

    return bound(calls, lambda c: F.array_distinct(F.concat(c, F.transform(c, lambda x: F.substring_index(x, ".", -1)), runs(c, 2), runs(c, 3))))


def winnowed(hashes: Column, window: int = WINNOW_WINDOW) -> Column:
    """Fingerprints of a set of fixed-width hash strings.

    The hashes are sorted before the window slides, so the minima are all but
    the window - 1 largest; a set no larger than the window keeps its least.
    """
    return bound(F.array_sort(F.array_distinct(hashes)), lambda d: F.slice(d, 1, F.greatest(F.size(d) - (window - 1), F.lit(1))))


def data_kinds(words: Column) -> Column:
    """Kinds whose hints the tokens hold, in the order of KIND_HINTS."""

    def found(w: Column, joined: Column) -> Column:
        kinds = []
        for kind, hints in KIND_HINTS.items():
            hit = F.arrays_overlap(w, F.array(*(F.lit(h) for h in hints if len(h) <= 3))) if any(len(h) <= 3 for h in hints) else F.lit(False)
            for h in (h for h in hints if len(h) > 3):
                # hints have no blanks, so what holds one is a single token
                hit = hit | F.contains(joined, F.lit(h))
            kinds.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(kind)))
        return F.array_compact(F.array(*kinds))

    return bound(words, lambda w: bound(F.array_join(w, " "), lambda joined: found(w, joined)))


def tags(words: Column) -> Column:
    return F.array_intersect(F.array(*(F.lit(t) for t in TAG_VOCABULARY)), words)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
