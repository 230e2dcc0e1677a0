"""Spelling variants, vector codes and the set join against brute force, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dagspark.llm import code_compression, set_join, spelling

from .helpers import LOWER, by_id, odd_texts, table, words

# --- spelling ---


def brute_variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {a: [b for b in counts if near(a, b)] for a in counts}
    form = {}
    for a, others in found.items():
        best = min(others, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= 5 * counts[a] else None
    out = {}
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, counts[a], len(found[a]), counts.get(form[a]))
    return out


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block", [2, 5, 64])
def test_variants_equal_brute_force_however_blocks_are_divided(spark, block):
    rng = random.Random(block)
    counts = {}
    for _ in range(40):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(6, 12)))
        counts[w] = rng.randint(5, 2000)
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcéÿ")
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            if len(v) >= 6:
                counts.setdefault(v, rng.randint(5, 300))
    counts |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaab": 625, "abababab": 40, "babababa": 40}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert found_variants(spelling.variants(df, block)) == brute_variants(counts)


def test_a_hot_beginning_is_divided(spark):
    rng = random.Random(9)
    counts = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)): rng.randint(5, 99) for _ in range(600)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.blocks(df, 16).groupBy("key").count().orderBy("count", ascending=False).first()
    assert rows["count"] <= 16
    assert found_variants(spelling.variants(df, 16)) == brute_variants(counts)


def test_words_of_texts(spark):
    texts = [*odd_texts(), "Colour colour COLOUR collour naïveté naïvete ÉCOLES écoles x" * 7, "a" * 5000 + " " + "a" * 4999, None]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    counted = spelling.dictionary(docs)
    want = brute_words(rows)
    assert {r["word"]: r["n"] for r in counted.collect()} == want
    assert found_variants(spelling.variants(counted)) == brute_variants(want)
    assert spelling.variants(spelling.dictionary(docs.where("false"))).count() == 0


def test_garbled_runs(spark):
    run = next(r for r in (f"abcdef{c}{d}" for c in "ghijklmnop" for d in "qrstuvwxyzabcdefghijk") if zlib.crc32(f"7:{r}".encode()) % 199 == 0)
    cut = zlib.crc32(f"7:{run}".encode()) % len(run)
    docs = spark.createDataFrame([(7, f"{run.upper()} " * 6)], "doc_id long, text string")
    assert [r["word"] for r in spelling.dictionary(docs).collect()] == [run[:cut] + run[cut + 1 :]]


# --- vector codes ---


def brute_codes(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[nearest(part(v, p), books[p])[0]].append(part(v, p))
            for j, xs in got.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = [(i, label, [nearest(part(v, p), books[p]) for p in range(8)]) for i, v, label in kept]
    by_label = Counter()
    for _, label, found in coded:
        by_label[label] += sum(d for _, d in found)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), by_label[label], sha) for i, label, found in coded), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, entry int, parts string, is_sum int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], VECTORS)


def codes_of(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in code_compression.codes(df).collect()), key=repr)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=24))], int(i % 3) if i % 7 else None) for i in range(300)]
    # ties: components on a coarse grid, repeated vectors and rows, null ids
    rows += [(1000 + i, [float(x) for x in rng.integers(-1, 2, 24)], 9) for i in range(200)]
    rows += [rows[0], rows[0], (None, rows[5][1], 1), (0, rows[6][1], None)]
    bad = [(2000, None, 1), (2001, [None] + [0.0] * 23, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] + [0.0] * 23, 2), (2004, [0.5] * 16, 1), (2005, [], 1)]
    want = brute_codes(rows)
    assert codes_of(vectors(spark, rows + bad).repartition(5)) == want


def test_codes_of_few_and_no_vectors(spark):
    few = [(i, [float(i), -float(i), 0.25] * 8, None) for i in range(5)] + [(9, [4.0, -4.0, 0.25] * 8, 1)]
    assert codes_of(vectors(spark, few)) == brute_codes(few)
    one = [(1, [0.1] * 8, 2)]
    assert codes_of(vectors(spark, one)) == brute_codes(one)
    for none in ([], [(1, None, 1)], [(1, [], 1)]):
        assert code_compression.codes(vectors(spark, none)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes_of(vectors(spark, [(1, [0.0] * 9, 1)]))
    with pytest.raises(ValueError, match="64 bits"):
        codes_of(vectors(spark, [(1, [1e30] * 8, 1)]))


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-40, 40, (3000, 8)) + c for c in rng.integers(-3000, 3000, (16, 8))])
    old = x[rng.choice(len(x), 16, replace=False)]
    entry, _, upper, lower = code_compression.scan(x, old)
    scans = []
    for _ in range(8):
        new = old.copy()
        for j in set(entry.tolist()):
            new[j] = x[entry == j].sum(0) // (entry == j).sum()
        entry, own, upper, lower, scanned = code_compression.reassign(x, entry, upper, lower, old, new)
        d = code_compression.distances(x, new)
        assert (entry == d.argmin(1)).all()
        assert (own == d.min(1)).all()
        second = np.sort(d, axis=1)[:, 1]
        assert (upper >= np.sqrt(d.min(1))).all()
        assert (lower <= np.sqrt(second)).all()
        scans.append(scanned)
        old = new
    assert scans[-1] < len(x) / 20


# --- set join ---


def brute_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_join(texts):
    s = [brute_set(t) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 90 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s[i]), find(i)) for i in range(len(s))}


def joined(spark, texts, boundary=None):
    got = by_id(set_join.jaccard_components(table(spark, texts).repartition(3), boundary))
    return {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}


def edited_texts(seed, lengths, groups, copies):
    rng = random.Random(seed)
    passage = words(40, 77)
    out = []
    for g in range(groups):
        base = words(rng.choice(lengths), seed * 1000 + g, 5000).split()
        if g % 3 == 0:
            base += passage.split()
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], ["edit"], [t[i], "more"]])
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("boundary", [None, 8, 15, 24])
def test_set_join_equals_brute_force(spark, boundary):
    texts = edited_texts(1, [9, 10, 11, 12, 14, 18, 21, 24, 30], 14, 8) + edited_texts(2, [60, 150, 400], 10, 8) + odd_texts() + [words(40, 77)] * 2
    assert joined(spark, texts, boundary) == brute_join(texts)


def test_sizes_of_set_join():
    for a in range(1, 60):
        for b in range(a, 80):
            need = next((i for i in range(a + 1) if 100 * i >= 90 * (a + b - i)), None)
            assert (b in set_join.partners(a)) == (need is not None) == (a in set_join.partners(b))
            if need is not None:
                assert set_join.overlap(a, b) == need


def test_bitmaps_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n, changed in ((10, 2), (300, 40), (5000, 100)):
        h = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        g = np.unique(np.concatenate([h[changed:], rng.integers(-(2**63), 2**63 - 1, 3 * changed)]))
        p, q = set_join.bitmap(h), set_join.bitmap(g)
        k = min(len(p), len(q))
        assert np.bitwise_count((set_join.folded(p, k) ^ set_join.folded(q, k)).view(np.uint64)).sum() <= len(np.setxor1d(h, g))


def test_light_sets_meet_in_subsets_exactly_if_they_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(9, 22))
        h = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        g = np.unique(np.concatenate([h[int(rng.integers(0, 3)) :], rng.integers(-(2**63), 2**63 - 1, int(rng.integers(0, 3)))]))
        x, y = ({(low, high, k) for low, high, keys in set_join.subset_keys(s, 24) for k in keys.tolist()} for s in (h, g))
        both = len(np.intersect1d(h, g))
        meet = {(low, high) for low, high, _ in x & y}
        assert ((min(len(h), len(g)), max(len(h), len(g))) in meet) == (100 * both >= 90 * (len(h) + len(g) - both))


def test_boundary_follows_the_cost():
    cheap = {n: (10, 1_000_000) for n in range(9, 33)}
    dear = {n: (1000, 0) for n in range(9, 33)}
    assert set_join.boundary_of_least_cost(cheap) > 20
    assert set_join.boundary_of_least_cost(dear) == 8
    assert set_join.boundary_of_least_cost({}) == 8


def test_large_groups_and_empty_tables(spark):
    texts = [None, "", "  "] * 20 + [words(80, 3)] * 300 + edited_texts(5, [120], 1, 150)
    assert joined(spark, texts) == brute_join(texts)
    docs = table(spark, texts[:3])
    assert set_join.jaccard_components(docs.where("false")).count() == 0
    nulls = docs.selectExpr("cast(null as long) as doc_id", "'one two three four' as text")
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in set_join.jaccard_components(nulls).collect()] == [(None, 2, None)] * 3
