"""Operator 8: toxicity by weak supervision.

Voters are small rules that look at the words of a text and vote "toxic" or
"clean" or not at all. Those of LEXICONS are by language and sort of word
(insults, slurs on character, filth, curses, threats, contempt; courtesy, terms
of agreements and of trade vote "clean"), others look for several such words,
for one right after a form of "you", for repetition and shouting. Further voters
are made from development rows: words and word beginnings that stand in toxic
rows and hardly in others, enough of them that each toxic text is covered up to
COVER times; built-in voters that the development rows refute are left out.

A generative label model then estimates, from the votes alone, without labels,
how each voter votes in clean texts and in toxic ones of several kinds (families
of voters that vote for the same texts: a language's insults are one):
expectation maximisation, first with independent voters; from what their
covariances have beyond the kinds it finds which are correlated, and goes on
with groups of correlated voters whose joint votes have rates of their own. A logistic regression is trained on the posterior
labels and scores texts by their votes; its constant is set on the development
rows.

The development rows are a bounded sample: the FIT_ROWS rows of smallest hash
among those that may be learned from, rows of one text counted once. Everything
else covers all rows.

Null and empty texts have no votes and get the score of such texts. A doc_id
of null is scored but never learned from. Several labels of one doc_id each
count as a row of the sample; repeated documents each give a row. Without
labels of both classes the voters' prior rates make the classifier. An empty
table gives an empty result; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, documents, stored

#: labelled rows to fit on, letters of the word beginnings that are looked at, how often they are asked to occur at most, and how many made voters a toxic text gets
FIT_ROWS, PREFIXES, TIMES, COVER = 20_000, (4, 5, 6, 7, 8), 3, 3
#: a mined word or beginning stands in so many different toxic texts at least, and so large a share of its texts is toxic
MIN_TOXIC, MIN_SHARE = 3, 0.8
#: a built-in voter goes if it is right less often than this many times by chance
LIFT = 2.0
#: the silence of all voters together speaks against a kind of toxic text by this log odds at most
SILENCE = 4.0
#: marks that may be mined by chance, in all
CHANCE = 0.01
#: the share of a voter's rows that another one of its family votes for too
TOGETHER = 0.2
#: how much of all posteriors moves in a step that is the last
STILL = 0.0005
#: voters are correlated from here on, and such a group has so many at most
CORRELATED, GROUP = 0.3, 3

# Words by language and sort; the sorts of CLEAN speak against toxicity.
LEXICONS = {
    "en insult": "idiot idiots moron morons clown clowns imbecile imbeciles fool fools dunce loser losers dimwit halfwit nitwit simpleton blockhead dummy",
    "en slur": "scum scumbag vermin bastard bastards filth parasite parasites maggot maggots cockroach cockroaches subhuman pig pigs swine rat rats degenerate degenerates",
    "en contempt": "worthless pathetic disgusting stupid dumb filthy useless repulsive vile despicable contemptible revolting brainless spineless loathsome",
    "en filth": "trash garbage crap shit shitty bullshit turd puke sewage dung",
    "en curse": "damn damned fuck fucking fucker asshole bitch dickhead prick wanker jerk",
    "en threat": "kill murder strangle hang shoot beat punch destroy suffer",
    "de insult": "idiot idioten trottel dummkopf depp deppen vollidiot blödmann schwachkopf hohlkopf versager penner spinner",
    "de slur": "abschaum ungeziefer hurensohn bastard drecksau schwein schweine ratte parasit parasiten untermensch missgeburt",
    "de contempt": "wertlos ekelhaft widerlich erbärmlich dumm blöd nutzlos verachtenswert abstoßend lächerlich armselig",
    "de filth": "müll dreck scheiße scheiß mist kotze jauche",
    "de curse": "arschloch verdammt fick ficken wichser fotze arsch",
    "de threat": "umbringen töten erschießen aufhängen verprügeln verrecken sterben",
    "fr insult": "idiot idiote idiots imbécile imbéciles abruti abrutis crétin crétins débile débiles andouille bouffon",
    "fr slur": "ordure ordures racaille vermine salaud salope cafard bâtard",
    "fr contempt": "minable pathétique dégoûtant répugnant stupide inutile méprisable lamentable ignoble",
    "fr filth": "merde poubelle déchet fumier pourriture",
    "fr curse": "connard connasse putain enculé bordel",
    "fr threat": "tuer crever pendre frapper buter égorger mourir",
    "es insult": "idiota idiotas imbécil imbéciles payaso payasos perdedor tonto tontos bobo cretino cretinos",
    "es slur": "escoria basura rata ratas parásito parásitos bastardo cerdo cerdos alimaña",
    "es contempt": "estúpido estúpida asqueroso asquerosa inútil patético patética repugnante despreciable miserable",
    "es filth": "mierda porquería asco estiércol",
    "es curse": "cabrón pendejo puta puto joder coño gilipollas",
    "es threat": "matar golpear ahorcar reventar aplastar",
}
CLEAN = {
    "en courtesy": "please thanks thank welcome appreciate grateful kindly sincerely regards congratulations",
    "de courtesy": "bitte danke willkommen herzlich freundlich grüße glückwunsch",
    "fr courtesy": "merci bienvenue bonjour cordialement félicitations volontiers",
    "es courtesy": "gracias bienvenido bienvenidos cordialmente saludos felicidades",
    "agreement": "license licence copyright warranty liability herein agreement pursuant licensed permitted",
    "trade": "price order delivery invoice shipping customer product service guarantee discount",
}
YOU = frozenset("you your youre du dich dir dein deine ihr euch tu te toi ton ta vous usted ustedes tú vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
#: sorts that insult a person, of which one after a form of "you" is a vote of its own
PERSONAL = ("insult", "slur", "contempt", "curse")
LANGUAGES = ("en", "de", "fr", "es")
PATTERNS = (*(f"several {x}" for x in LANGUAGES), *(f"you and {x}" for x in LANGUAGES), "repeated", "several sorts", "shouting", "capitals")
BUILT_IN = (*LEXICONS, *CLEAN, *PATTERNS)
#: what built-in voters say
SIGNS = np.array([1] * len(LEXICONS) + [-1] * len(CLEAN) + [1] * len(PATTERNS))
#: rates of a vote in the class it is for and in the other one, to begin with
START = (0.3, 0.01)


def _marks(words: list[str]) -> set[str]:
    """A text's words and word beginnings (these with a hyphen), and with *2, *3 those that occur as often."""
    counts = Counter(words)
    long = Counter[str]()
    for w, k in counts.items():
        for n in PREFIXES:
            if len(w) > n:
                long[w[:n] + "-"] += k
    counts.update(long)
    return {m if t == 1 else f"{m}*{t}" for m, k in counts.items() for t in range(1, min(k, TIMES) + 1)}


class Voters:
    """The built-in voters and one for each mined mark."""

    def __init__(self, mined: list[str]) -> None:
        self.mined = mined
        self.of_word: dict[str, list[int]] = {}
        for i, x in enumerate([*LEXICONS.values(), *CLEAN.values()]):
            for w in x.split():
                self.of_word.setdefault(w, []).append(i)
        self.known = frozenset(self.of_word)
        names = list(LEXICONS)
        self.language = [LANGUAGES.index(x[:2]) for x in names]
        self.personal = [x[3:] in PERSONAL for x in names]
        #: by the number of letters (0: whole words): voters of each mark by how often it must occur
        self.marks: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for i, m in enumerate(mined):
            text, _, times = m.partition("*")
            prefix = text.endswith("-")
            table = self.marks.setdefault(len(text) - 1 if prefix else 0, {})
            table.setdefault(text.rstrip("-"), []).append((int(times or 1), len(BUILT_IN) + i))

    def __len__(self) -> int:
        return len(BUILT_IN) + len(self.mined)

    def signs(self) -> np.ndarray:
        return np.append(SIGNS, np.ones(len(self.mined), int))

    def votes(self, text: str | None) -> list[int]:
        """The numbers of the voters that vote; the others abstain."""
        tokens = _WORD.findall((text or "").lower())
        words = set(tokens)
        out: set[int] = set()
        first = len(LEXICONS) + len(CLEAN)
        if held := words & self.known:
            by_language = [0] * len(LANGUAGES)
            for w in held:
                for i in self.of_word[w]:
                    out.add(i)
                    if i < len(LEXICONS) and self.personal[i]:
                        by_language[self.language[i]] += 1
            out.update(first + k for k, n in enumerate(by_language) if n > 1)
            if any(by_language):
                bad = {w: [self.language[i] for i in self.of_word[w] if i < len(LEXICONS) and self.personal[i]] for w in held}
                counts: Counter[str] = Counter()
                for at, w in enumerate(tokens):
                    if bad.get(w):
                        counts[w] += 1
                        if not YOU.isdisjoint(tokens[max(at - 2, 0) : at]):
                            out.update(first + len(LANGUAGES) + k for k in bad[w])
                if max(counts.values(), default=0) > 1:
                    out.add(BUILT_IN.index("repeated"))
                if sum(i < len(LEXICONS) for i in out) > 2:
                    out.add(BUILT_IN.index("several sorts"))
        if text and text.count("!!") * 8 > len(words) > 0:
            out.add(BUILT_IN.index("shouting"))
        if len(words) > 5 and text.isupper():
            out.add(BUILT_IN.index("capitals"))
        for n, table in self.marks.items():
            found = Counter(w[:n] for w in tokens if len(w) > n and w[:n] in table) if n else Counter(w for w in tokens if w in table)
            out.update(i for m, k in found.items() for times, i in table[m] if k >= times)
        return sorted(out)


def families(votes: np.ndarray) -> list[list[int]]:
    """Toxic voters that vote for the same rows, directly or through others: each such family stands for a kind of toxic text."""
    cast = (votes > 0).astype(np.int64)
    both, often = cast.T @ cast, cast.sum(0)
    group = {int(i): [int(i)] for i in np.flatnonzero(often)}
    for i in group:
        for j in group:
            if i < j and group[i] is not group[j] and both[i, j] >= max(2, TOGETHER * min(often[i], often[j])):
                group[i] += group[j]
                for k in group[j]:
                    group[k] = group[i]
    return [sorted(g) for i, g in group.items() if g[0] == i]


def _posterior(codes: list[np.ndarray], tables: list[np.ndarray], silent: list[int], shares: np.ndarray) -> np.ndarray:
    """P of each kind of toxic text and, last, of a clean one; tables: log rates of each joint vote in each kind."""
    n, kinds = len(codes[0]), len(shares) - 1
    said, silence = np.zeros((n, kinds)), np.zeros((n, kinds))
    for code, table, none in zip(codes, tables, silent, strict=True):
        odds = table[:, :-1] - table[:, -1:]
        quiet = (code == none)[:, None]
        silence += np.where(quiet, odds[max(none, 0)], 0.0)
        said += np.where(quiet, 0.0, odds[code])
    z = np.column_stack([np.log(shares[:-1] / shares[-1]) + said + np.maximum(silence, -SILENCE), np.zeros(n)])
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _grouped(votes: np.ndarray, groups: list[list[int]]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """For each group of voters the number of its joint vote in each row, the joint votes, and the number of the silent one (-1: none)."""
    codes, kinds, silent = [], [], []
    for g in groups:
        patterns, code = np.unique(votes[:, g], axis=0, return_inverse=True)
        none = np.flatnonzero((patterns == 0).all(1))
        codes.append(code.ravel())
        kinds.append(patterns)
        silent.append(int(none[0]) if len(none) else -1)
    return codes, kinds, silent


def _maximised(votes: np.ndarray, groups: list[list[int]], p: np.ndarray, rounds: int) -> np.ndarray:
    """The posteriors p of the kinds after expectation maximisation; it ends where they stand still, as beyond that they drift with what the votes of a single group of voters can't tell."""
    codes, kinds, silent = _grouped(votes, groups)
    for _ in range(rounds):
        tables = []
        for code, kind in zip(codes, kinds, strict=True):
            counts = np.column_stack([np.bincount(code, w, len(kind)) for w in p.T]) + 0.5 / len(kind)
            tables.append(np.log(counts / counts.sum(0)))
        shares = p.sum(0) + 1e-3
        old, p = p, _posterior(codes, tables, silent, shares / shares.sum())
        if np.abs(p - old).sum() < 2 * STILL * len(p):
            break
    return p


def correlated_groups(correlations: np.ndarray) -> list[list[int]]:
    """Voters in groups of GROUP at most, the most correlated joined first."""
    group = {i: [i] for i in range(len(correlations))}
    strength = np.abs(np.triu(correlations, 1))
    for flat in np.argsort(-strength, axis=None, kind="stable")[: int((strength > CORRELATED).sum())]:
        i, j = divmod(int(flat), len(correlations))
        if group[i] is not group[j] and len(group[i]) + len(group[j]) <= GROUP:
            group[i] += group[j]
            for k in group[j]:
                group[k] = group[i]
    return [g for i, g in group.items() if g[0] == i]


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Posterior P(toxic) of each row, each voter's rates of voting in toxic and other rows, the voters' correlations, and their groups.

    votes is rows x voters: 1 toxic, -1 clean, 0 none. prior is the share of
    toxic rows to begin with. No labels are used. Toxic texts are of several kinds (each
    language has its own words), in each of which voters have their own rates.
    """
    m = votes.shape[1]
    of = families(votes) or [[]]
    alone = [[i] for i in range(m)]
    codes, kinds, silent = _grouped(votes, alone)
    right, wrong = START
    begin = []
    for i, kind in enumerate(kinds):
        for_toxic = np.where(kind[:, :1] > 0, [right if i in f else wrong for f in of], np.where(kind[:, :1] < 0, wrong, [1 - right if i in f else 1 - wrong for f in of]))
        for_clean = np.where(kind > 0, wrong, np.where(kind < 0, right, 1 - wrong))
        begin.append(np.log(np.column_stack([for_toxic, for_clean])))
    shares = np.append(np.full(len(of), prior / len(of)), 1 - prior)
    q = _maximised(votes, alone, _posterior(codes, begin, silent, shares), rounds)
    # what is left of the votes' covariances after that which the kinds bring about
    x = votes.astype(float)
    left = x - q @ ((q.T @ x) / np.maximum(q.sum(0)[:, None], 1e-9))
    scale = np.sqrt((left * left).mean(0)) + 1e-9
    correlations = (left.T @ left) / len(left) / np.outer(scale, scale)
    groups = correlated_groups(correlations)
    q = _maximised(votes, groups, q, rounds)
    p = 1 - q[:, -1]
    cast = (votes != 0).astype(float)
    rates = np.column_stack([(w @ cast + 0.5 * START[1]) / (w.sum() + 0.5) for w in (p, 1 - p)])
    return p, rates, correlations, groups


def logistic(votes: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on soft targets, by Newton's method."""
    x = np.column_stack([votes, np.ones(len(votes))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = np.inf
    for _ in range(rounds):
        z = np.clip(x @ w, -30, 30)
        s = 1 / (1 + np.exp(-z))
        now = (np.logaddexp(0, z) - target * z).sum() + 0.5 * (ridge * w * w).sum()
        if loss - now < 1e-9 * max(1.0, abs(now)):
            break
        loss = now
        grad = x.T @ (s - target) + ridge * w
        hess = (x * (s * (1 - s) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(hess, grad)
    return w


class Model:
    """Voters, the classifier's weights (the last is the constant), and what the label model found: rates, correlations, groups; precision: of each voter on the development rows."""

    def __init__(self, mined: list[str], weights: np.ndarray, rates: np.ndarray, correlations: np.ndarray, groups: list[list[int]], precision: np.ndarray) -> None:
        self.voters, self.weights, self.rates, self.correlations, self.groups, self.precision = Voters(mined), weights, rates, correlations, groups, precision
        self.of_vote = weights[:-1] * self.voters.signs()

    def score(self, text: str | None) -> float:
        z = self.weights[-1] + sum(self.of_vote[i] for i in self.voters.votes(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def calibrated(z: np.ndarray, toxic: np.ndarray) -> float:
    """What to add to the scores z so that the fewest rows are on the wrong side of zero; in the middle of the widest such gap."""
    order = np.argsort(z)
    z, toxic = z[order], toxic[order]
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum((1 - toxic)[::-1])[::-1], [0]])
    edge = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    width = np.where(edge[1:] > edge[:-1], edge[1:] - edge[:-1], -1)
    best = np.flatnonzero((wrong == wrong[width > 0].min()) & (width > 0))
    at = best[np.argmax(width[best])]
    return float(-(edge[at] + edge[at + 1]) / 2)


def covering(texts: list[np.ndarray], n: int, enough: int) -> list[int]:
    """Numbers below n, one after another that with which most texts are not covered COVER times, while there are `enough` of them."""
    need = np.full(len(texts), COVER)
    holders: list[list[int]] = [[] for _ in range(n)]
    for i, t in enumerate(texts):
        for m in t.tolist():
            holders[m].append(i)
    gain, out = np.array([len(h) for h in holders], np.int64), []
    while len(gain) and gain.max() >= enough:
        best = int(np.argmax(gain))
        out.append(best)
        gain[best] = 0
        for i in holders[best]:
            if need[i]:
                need[i] -= 1
                if not need[i]:
                    gain[texts[i]] -= 1
        gain[out] = 0
    return out


def _mark_counts(batches: Iterator[pa.RecordBatch], wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """How many of a task's rows have each mark (each of the wanted ones)."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"].to_pylist():
            marks = _marks(_WORD.findall((text or "").lower()))
            counts.update(marks if wanted is None else marks & wanted)
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["mark", "n"])


def _counts(rows: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    return rows.select("text").mapInArrow(lambda x: _mark_counts(x, wanted), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, fit_rows: int = FIT_ROWS) -> Model:
    """Fit voters, label model and classifier on at most fit_rows of the labels(doc_id, toxic) that may be learned from."""
    usable = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    # bounded by fit_rows, so it may be broadcast; copies of one text say no more than one of them
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("digest"), "text", "toxic")
    rows = stored(found.dropDuplicates(["digest", "toxic"]).orderBy("digest", "toxic").limit(fit_rows).repartition("digest", "toxic"), "labelled")
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic <> 1")
    n1, n0 = toxic.count(), clean.count()
    if not n1 or not n0:
        z = np.full(len(BUILT_IN), np.log(START[0] / START[1]))
        z[SIGNS < 0] /= 4
        start = np.where(SIGNS[:, None] > 0, START, START[::-1])
        return Model([], np.append(z, -2.5), start, np.eye(len(z)), [[i] for i in range(len(z))], np.full(len(z), np.nan))
    counts = stored(_counts(toxic), "mark_counts")
    # so many different toxic texts that none of all the marks would be expected to reach by chance
    enough = max(MIN_TOXIC, math.ceil(math.log(counts.count() / CHANCE + 1) / math.log((n1 + n0) / n1)))
    # bounded by the sample, as are all that follow
    often = {r.mark: r.n for r in counts.where(F.col("n") >= enough).collect()}
    other = {r.mark: r.n for r in _counts(clean, frozenset(often)).collect()} if often else {}
    share = {m: (n / n1) / (n / n1 + (other.get(m, 0) + 0.5) / n0) for m, n in often.items()}
    candidates = sorted((m for m in often if often[m] >= MIN_SHARE * (often[m] + other.get(m, 0)) and share[m] >= MIN_SHARE), key=lambda m: (-often[m] * share[m], "*" in m, "-" in m, -len(m), m))
    number = {m: i for i, m in enumerate(candidates)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number.keys()
        for batch in batches:
            ids = [[number[m] for m in _marks(_WORD.findall((t or "").lower())) & wanted] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32()))], names=["marks"])

    texts = [np.array(r.marks, np.int64) for r in toxic.select("text").mapInArrow(held, "marks array<int>").collect()] if candidates else []
    mined = [candidates[i] for i in covering(texts, len(candidates), enough)]
    voters = Voters(mined)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.votes(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32())), batch["toxic"]], names=["votes", "toxic"])

    fitted = rows.select("text", "toxic").mapInArrow(voted, "votes array<int>, toxic int").collect()
    signs, given = voters.signs(), np.array([int(r.toxic == 1) for r in fitted])
    votes = np.zeros((len(fitted), len(voters)), np.int8)
    for i, r in enumerate(fitted):
        votes[i, r.votes] = signs[r.votes]
    cast, right = (votes != 0).sum(0), ((votes != 0) & ((votes > 0) == (given[:, None] == 1))).sum(0)
    chance = np.where(signs > 0, given.mean(), 1 - given.mean())
    # clean votes can't be right much more often than by chance; they have to be as right as the rest
    refuted = (cast > 0) & (right < np.where(signs > 0, np.minimum(LIFT * chance, 0.5), chance) * cast)
    votes[:, refuted] = 0
    p, rates, correlations, groups = label_model(votes, (n1 + 1) / (n1 + n0 + 2))
    weights = logistic(votes.astype(float), p)
    weights[-1] += calibrated(votes @ weights[:-1] + weights[-1], given)
    with np.errstate(invalid="ignore", divide="ignore"):
        return Model(mined, weights, rates, correlations, groups, np.where(refuted, 0.0, right / cast))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) as (doc_id, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([model.score(t.as_py()) for t in batch["text"]], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def screened(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores below threshold, with all their columns."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mild = pa.array([model.score(t.as_py()) < threshold for t in batch["text"]], pa.bool_())
            yield batch.select(["row"]).filter(mild)

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}").select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_key("doc_id") % 5 != 0)
    return score(docs, model).select("doc_id", (doc_key("doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
