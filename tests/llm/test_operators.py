import glob
import gzip
import hashlib
import io
import json
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from dagspark.llm import common, components, decontaminate, licenses, near_copies, ngram_lm, quality, registry, rendezvous, sentencepiece_codec, simhash, substring_dedup, suffix_array, toxicity, warc
from dagspark.llm.common import doc_key
from pyspark.sql import functions as F

from ..oracle import same
from .helpers import LOWER, by_id, odd_texts, table, words


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    same(registry.queries()[name](spark, data), registry.oracle_sql()[name], data)


# --- 9: rendezvous hashing --------------------------------------------------------------------
def test_rendezvous(spark):
    df = table(spark, [*odd_texts(), *[words(5, i) for i in range(3000)]])
    df = df.union(df.where("doc_id = 5")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = rendezvous.assign(df).collect()
    assert len(got) == df.count()
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
        assert len(slots) > 60
    moved = [r for r in got if r.shard != r.grown_shard]
    assert all(r.grown_shard == 24 for r in moved)
    assert 0 < len(moved) < 2 * len(got) / 25
    five = [r for r in got if r.doc_id == 5]
    assert len({r.shard for r in five}) == 1
    assert len({r.slot for r in five}) == 2
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) and r.size == len((t or "").encode()) + 8 for t, r in ((odd_texts()[r.doc_id], r) for r in got if r.doc_id is not None and r.doc_id < 17))
    assert rendezvous.assign(df.where("false")).count() == 0


def test_rendezvous_weights(spark):
    got = rendezvous.assign(table(spark, [str(i) for i in range(4000)]), weights=(1.0, 3.0)).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in got}[1] == pytest.approx(3000, rel=0.05)


# --- 7: SimHash -----------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_against_brute_force(spark):
    texts = odd_texts()
    for seed in range(6):
        w = words(400, 50 + seed).split()
        for k in range(5):
            w = list(w)
            w[k * 70] = f"edit{k}"
            texts.append(" ".join(w))
    df = table(spark, texts).repartition(3)
    got = by_id(simhash.near_duplicates(df))
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fp
    assert all(len(r["fingerprint"]) == 16 for r in got.values())
    want = brute_components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert len(set(want.values())) < len(texts) - 8


def test_golay_links_lose_none(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 5), replace=False)) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {(r.a, r.b) for r in simhash.golay_links(df).collect()}
    signed = fps.view(np.int64)
    want = {tuple(sorted((int(signed[i]), int(signed[j])))) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_golay_code_is_perfect():
    own, near = simhash.golay_indices()
    assert near.shape[1] == 6
    assert (near[np.arange(1 << 16), 0] >= 0).all()
    assert all(own[w ^ (1 << b)] in near[w] for w in range(0, 1 << 16, 997) for b in range(16))


def test_simhash_null_ids_and_empty(spark):
    df = table(spark, ["a b c d", "a b c d", "other text of words"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.component_id or 0) for r in got) == [1, 1, 2]
    assert simhash.near_duplicates(df.where("false")).count() == 0
    named = table(spark, ["a b c d", "a b c d", "other text of words"]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(named).collect()) == [("d0", "d0"), ("d1", "d0"), ("d2", "d2")]
    large = table(spark, ["a b c d", "a b c d"]).withColumn("doc_id", F.col("doc_id") + (1 << 62) + 5)
    assert {r.component_id for r in simhash.near_duplicates(large).collect()} == {(1 << 62) + 5}


def test_near_copies_against_brute_force(spark):
    rng, line = random.Random(5), words(20, 77)
    texts = odd_texts()
    for seed in range(12):
        w = words(150, 300 + seed, 3000).split()
        for changed in (0, 1, 2, 3, 3, 4, 5):
            x = list(w)
            for at in rng.sample(range(150), changed):
                x[at] = f"new{rng.randrange(10**6)}"
            texts.append(f"{' '.join(x)} {line}")
    sets = [set(near_copies.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > simhash.MAX_BITS
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert far > 20
    got = by_id(near_copies.groups(table(spark, texts)))
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert near_copies.groups(table(spark, texts).where("false")).count() == 0


def test_bloom_filters_lose_nothing(spark):
    inside = spark.range(0, 200_000, 7).select((F.col("id") * 977 - 10**9).alias("x"))
    rows = spark.range(200_000).select((F.col("id") * 977 - 10**9).alias("x"), "id")
    of = common.bloom(inside)
    assert of.count() <= common.BLOOM_WORDS
    got = common.perhaps_in(rows, "x", of)
    assert got.columns == ["x", "id"]
    assert got.where("id % 7 = 0").count() == inside.count()
    assert got.where("id % 7 <> 0").count() < 2_000
    assert common.perhaps_in(rows, "x", common.bloom(inside.where("false"))).count() == 0


def test_near_copy_keys_meet():
    rng = np.random.default_rng(3)
    for n, shared, least in ((100, 89, 0.95), (100, 95, 0.99), (9, 8, 0.95)):  # shingles of both texts, those in common

        def texts(own, n=n, shared=shared):
            return np.stack([near_copies.bit_sums(np.concatenate([x, rng.integers(0, 1 << 64, n - shared, np.uint64)])) for x in own])

        common = [rng.integers(0, 1 << 64, shared, np.uint64) for _ in range(600)]
        one, other = texts(common), texts(common)
        met = [{a & (near_copies._NEAR - 1) for a in x if a >= near_copies._OWN} & {b & (near_copies._NEAR - 1) for b in y} for x, y in (*zip(near_copies.keys(one), near_copies.keys(other), strict=True),)]
        assert np.mean([bool(m) for m in met]) > least - 0.07  # one way only; the join looks up both ways
        assert (((one > 0) != (other > 0)).mean(1) < near_copies.MAX_DIFFERENT).mean() > 0.99
        strangers = [{b & (near_copies._NEAR - 1) for b in y} & {a & (near_copies._NEAR - 1) for a in x} for x, y in zip(near_copies.keys(one[:-1]), near_copies.keys(one[1:]), strict=True)]
        assert np.mean([bool(m) for m in strangers]) < 0.02


def test_nearby_codewords_are_codewords_in_order():
    rng = np.random.default_rng(4)
    sums = rng.integers(-40, 41, (200, 23))
    index, distance = near_copies.nearby_codewords(sums)
    word = index << 11
    word = word | simhash.remainders(word)
    bits = (word[:, :, None] >> np.arange(23)) & 1
    want = np.where(bits != (sums > 0)[:, None, :], np.abs(sums)[:, None, :], 0).sum(2)
    here = np.isfinite(distance)
    assert (distance[here] == want[here]).all()
    assert (np.diff(np.where(here, distance, 1e9), axis=1) >= 0).all()
    assert all(len(set(i[h].tolist())) == h.sum() for i, h in zip(index, here, strict=True))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 600: 600, 601: 600}


# --- 10: licenses --------------------------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licenses_base_against_brute_force(spark):
    texts = [*odd_texts(), "Under the MIT license, under the mit license", "cc by nc cc-by-nc", "Apache License, Version 2.0", "cc by nc" + " filler" * 5000 + " CC BY NC"]
    got = by_id(licenses.license_labels(table(spark, texts)))
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(LOWER))
        places = [(s, label) for p, label in licenses.BASE_PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places)), t
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert licenses.license_labels(table(spark, []).where("false")).count() == 0


def test_license_rules_and_suppression(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "the MIT license and the ISC license", "no license words", "Licensed under CC BY-NC-SA 4.0 International"]
    docs = table(spark, texts)
    got = by_id(licenses.license_labels(docs))
    assert [got[i]["labels"] for i in range(5)] == ["gpl-3", "apache-2", "isc,mit", "", "cc-by-nc,cc-by-nc-sa"]
    kept = licenses.scan(docs)[1].collect()
    by = {}
    for r in kept:
        by.setdefault(r.rid, []).append((r.start, r.stop))
    for spans in by.values():
        assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)
    assert len(licenses.rules()) > 200


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under GPLv3", "gpl-3"), ("License: GPL-3.0-or-later", "gpl-3"), ("GPL-2.0-only", "gpl-2"), ("LGPL-2.1-or-later, see COPYING", "lgpl-2.1"), ("AGPLv3", "agpl-3"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
        ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR ISC", "bsd-3-clause,isc,mit"), ("under the MIT license and the Apache License 2.0", "apache-2,mit"), ("licensed under GPL-2.0 and MIT", "gpl-2,mit"),
        ("Licensed under the MIT license, 3-clause BSD license", "bsd-3-clause,mit"), ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "gpl-3"),
        ("the GNU Lesser General Public License, version 2.1", "lgpl-2.1"), ("CC BY-SA 4.0", "cc-by-sa"), ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa"), ("available under MIT terms", "mit"),
        ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "mit"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache-2"), ("https://opensource.org/licenses/BSD-2-Clause", "bsd-2-clause"),
        ("a mit of snow, python eats ruby and json", ""), ("the license plate of a boost", ""), ("he applied and mit replied", ""),
    ],
)
def test_license_statements(text, labels):
    """By Python's own regexes (but for what makes a list) and a plain resolver."""
    assert ",".join(sorted({r["label"] for *_, r in brute_licenses(text)})) == labels


def brute_licenses(text):
    padded = f" {' '.join(WORD.findall(text.translate(LOWER)))} "
    assert not any(re.search(r["pattern"].replace(licenses._LISTED, ""), padded) for r in licenses.rules() if r["kind"] != "listed") or re.search(licenses.gate(), padded)
    found = []
    for r in licenses.rules():
        for m in re.finditer(r["pattern"].replace(licenses._LISTED, ""), padded):
            if r["kind"] == "listed" and not re.search(" (?:licen[sc]ed|licen[sc]es?|identifier|under) .{0,160}$", padded[: m.end()]):
                continue
            assert any(f" {k}" in padded for k in r["keywords"])
            assert any(g in padded for g in r["gates"])
            start = padded[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), r))
    longer = lambda x: [y for y in found if y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0]]
    kept = []
    for x in sorted(found, key=lambda x: (max([x[2]["level"], *(y[2]["level"] for y in longer(x))]), x[2]["level"], x[0] - x[1], x[0], x[2]["id"])):
        if not any(y[0] < x[1] and x[0] < y[1] for y in kept):
            kept.append(x)
    return kept


def test_licenses_against_brute_force(spark):
    rng = random.Random(6)
    parts = "the MIT license,Apache License 2.0,licensed under,GPL-3.0,or later,3-clause BSD license,and,or,SPDX-License-Identifier: MIT,CC BY-NC 4.0,license,version 2,GNU General Public License,ISC,available under the,public domain,released into the,or the,BSD,permission is hereby granted".split(",")
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(150)]
    docs = table(spark, [*texts, None, texts[0]])
    docs = docs.union(docs.where("doc_id < 3")).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    got = {}
    for r in licenses.license_labels(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [len(got[i]) for i in (0, 1, 2, 3, None)] == [2, 2, 2, 1, 1]
    for i, t in enumerate(texts):
        kept, r = brute_licenses(t), got[i if i != 5 else None][0]
        base = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted({x["label"] for *_, x in kept} | base)), t
        assert r.n_detections == len(kept), t


# --- 2: decontamination -----------------------------------------------------------------------------------
def brute_contamination(text, items, n=10):
    w = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for key, t in items:
        v = WORD.findall((t or "").translate(LOWER))
        size = min(n, len(v))
        for s in range(max(len(v) - size + 1, 1) if v else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[s : s + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    long = words(40, 77)
    items = [(1, long), (2, "short Item"), (3, None), (4, ""), (10, words(12, 78)), (11, long), (12, "the " * 15)]
    texts = [*odd_texts()[:11], f"x {long} y", f"start {' '.join(long.split()[5:17])} end", " ".join(long.split()[5:14]), "A short-item, short item!", "the " * 40, words(12, 78).upper() + " " + words(12, 78)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).repartition(2)
    got = by_id(decontaminate.contamination(table(spark, texts).repartition(3), bench))
    for i, t in enumerate(texts):
        n, hit, found = brute_contamination(t, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), t
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert decontaminate.contamination(table(spark, texts), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(table(spark, texts).where("false"), bench).count() == 0


def test_proximity_matches(spark):
    item = words(10, 79, 10_000).split()
    altered = [*item]
    altered[3] = "changed"
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    r = decontaminate.contamination(table(spark, [" ".join(altered), " ".join(item), item[3], item[3]]), bench)
    got = by_id(r)
    assert (got[0]["n_hit"], got[0]["n_near"]) == (0, 1)
    assert (got[1]["n_hit"], got[1]["n_near"]) == (10, 0)


def brute_near(w, v, n=10, near=8):
    """Whether `near` words of a window stand at as many places near an alignment, each at the place nearest to its own."""
    wide, slack = min(n, len(v)), n - near
    offsets = [0] + [sign * e for e in range(1, slack + 1) for sign in (-1, 1)]
    for s in range(len(v) - wide + 1) if len(v) > near else ():
        for d in range(-len(v) - slack, len(w) + slack):
            places = [next((p + d + e for e in offsets if 0 <= p + d + e < len(w) and w[p + d + e] == v[p]), None) for p in range(s, s + wide)]
            if len({x for x in places if x is not None}) >= near:
                return True
    return False


def brute_pieces(w, v, n=10, near=8, around=None):
    """Narrower: `near` words of a window stand at alignments that differ by n - near at most; around: no further than that from an alignment at which one of its pieces of three stands while another one stands as close."""
    wide, slack = min(n, len(v)), n - near
    for s in range(len(v) - wide + 1) if len(v) > near else ():
        stand = {(p, d) for p in range(s, s + wide - 2) for d in range(-p, len(w)) if w[p + d : p + d + 3] == v[p : p + 3]}
        for d in range(-len(v), len(w)):
            if around and not any(x == d and p != q and abs(x - y) <= slack for p, x in stand for q, y in stand):
                continue
            reach = range(d - slack, d + slack + 1) if around else range(d, d + slack + 1)
            at = [(p, p + x) for p in range(s, s + wide) for x in reach if 0 <= p + x < len(w) and w[p + x] == v[p]]
            if min(len({a for a, _ in at}), len({b for _, b in at})) >= near:
                return True
    return False


def edited(rng, w, times, kinds):
    w = list(w)
    for _ in range(times):
        at, edit = rng.randrange(len(w)), rng.choice(kinds)
        if edit == "replace":
            w[at] = f"other{rng.randrange(10**6)}"
        elif edit == "insert":
            w.insert(at, words(1, rng.randrange(10**6), 60))
        elif edit == "drop":
            del w[at]
        else:
            at = max(at, 1)
            w[at - 1], w[at] = w[at], w[at - 1]
    return w


def test_proximity_survives_edits(spark):
    rng = random.Random(8)
    items = [words(k, 400 + k, 60) for k in (7, 8, 9, 10, 11, 25)] + [words(10, 500 + k, 600) for k in range(10)]
    cases = [(None, 0, False), (None, 0, False)]
    texts = ["", None]
    for k, item in enumerate(items):
        for times, kinds in [(1, ("swap",)), *[(n, ("replace", "insert", "drop")) for n in (1, 2, 2, 2)], *[(n, ("replace", "insert", "drop", "swap")) for n in (2, 3, 3)]]:
            cases.append((k, times, kinds == ("swap",) or (times <= 2 and "swap" not in kinds)))
            texts.append(f"{words(5, len(texts), 60)} {' '.join(edited(rng, item.split(), times, kinds))} {words(5, len(texts) + 1, 60)}")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {i: set(filter(None, r["near_items"].split(","))) for i, r in by_id(decontaminate.contamination(table(spark, texts), bench)).items()}
    whole = {i: set(brute_contamination(t, list(enumerate(items)))[2]) for i, t in enumerate(texts)}
    assert got == {i: {str(k) for k, v in enumerate(items) if brute_near((t or "").split(), v.split())} - whole[i] for i, t in enumerate(texts)}
    for around in (True, False):
        want = {i: {str(k) for k, v in enumerate(items) if brute_pieces((t or "").split(), v.split(), around=around)} - whole[i] for i, t in enumerate(texts)}
        both = sum(len(got[i] & want[i]) for i in got)
        assert both >= 0.97 * sum(map(len, want.values()))  # of all that alignments near each other allow, also after three edits
        assert sum(map(len, want.values())) > 40
    # every item of ten words and more that suffered two edits at most is found
    two = [(i, k) for i, (k, _, mild) in enumerate(cases) if mild and len(items[k].split()) >= 10]
    assert len(two) > 50
    assert all(str(k) in got[i] | whole[i] for i, k in two)


def test_a_stock_phrase_makes_few_rows(spark):
    stem = "which of the following is"
    bench = spark.createDataFrame([(i, f"{stem} {words(12, 7000 + i, 10**9)}") for i in range(60)], "item_id long, text string")
    docs = table(spark, [f"{words(20, i, 300)} {stem} {words(20, 900 + i, 300)}" for i in range(120)], extra=False).withColumn("rid", F.col("doc_id"))
    postings, items = decontaminate.index(docs, bench)
    seeds = decontaminate.rarest(items, 10, 2)
    few = decontaminate.rarest(items, 10, 6, 8)
    held = decontaminate.lists(postings, seeds.unionByName(few).select("r", "o"))
    assert decontaminate.alignments(held, seeds, 0).count() == 0
    assert decontaminate.alignments(held, few, 2).count() < 60 * 120
    assert decontaminate.contamination(docs, bench).where("contaminated or n_near > 0").count() == 0


@pytest.mark.parametrize("name", ["_file", "_place", "_nth", "_metadata", "rid", "row", "iid", "term"])
def test_clashing_columns_lose_no_row(spark, tmp_path, name):
    """Of a table that is read from files, where rows are numbered by file and place."""
    item = words(30, 84, 1000)
    path = str(tmp_path / "documents.parquet")
    table(spark, [item, "clean text", None, item], extra=False).withColumn(name, F.lit(1)).repartition(2).write.parquet(path)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn(name, F.lit(2))
    got = by_id(decontaminate.contamination(spark.read.parquet(path), bench))
    assert {i: r["n_hit"] for i, r in got.items()} == {0: 30, 1: 0, 2: 0, 3: 30}
    numbered = common.numbered(spark.read.parquet(path), "number")
    assert sorted(numbered.columns) == sorted(["number", "doc_id", "text", "lang", "source", "n_chars", name])
    assert numbered.select("number").distinct().count() == 4


def test_decontamination_with_odd_rows(spark):
    item = words(30, 84, 1000)
    df = table(spark, [item, item, f"a {' '.join(edited(random.Random(1), item.split(), 1, ('replace',)))}", None, words(40_000, 85, 1000)])
    df = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id").cast("string")))
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, "one")], "item_id long, text string")
    got = decontaminate.contamination(df, bench).collect()
    assert len(got) == 10
    assert sum(r.n_hit == 30 and r.n_items == 1 for r in got) == 4
    assert {r.n_items for r in got if r.doc_id == "3"} == {0}
    few = decontaminate.contamination(df, bench.where("item_id = 8")).collect()
    assert not any(r.contaminated or r.n_near for r in few)


# --- 5: suffix arrays ------------------------------------------------------------------------------------------
def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(1)
    for k in range(300):
        n, a = int(rng.integers(1, 150)), int(rng.integers(1, 6))
        t = rng.integers(0, a, n).astype(np.uint8)
        if k % 3 == 0:
            t = np.tile(t[: rng.integers(1, 9)], 40)[:n]
        n = len(t)
        sa = suffix_array.suffix_array(t, 256)
        assert list(sa) == sorted(range(n), key=lambda i: t[i:].tobytes())
        plcp, phi = suffix_array.permuted_lcp(t, sa, 16)
        for i, j in zip(sa[1:], sa[:-1], strict=True):
            common = next((x for x in range(n - max(i, j)) if t[i + x] != t[j + x]), n - max(i, j))
            assert phi[i] == j
            assert plcp[i] == common or (common >= 16 and plcp[i] >= 16)


def brute_dedup(texts, size=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4000, 1])
def test_dedup_against_brute_force(spark, hot):
    passage = words(90, 20)
    texts = [*odd_texts()[:11], *(words(20, 200 + i) + f" {passage} " + words(20, 300 + i) for i in range(8)), "a" * 500, "a" * 199, "b" * 200, words(40, 21)[:210] * 2]
    got = by_id(substring_dedup.deduplicate(table(spark, texts).repartition(4), with_text=True, hot=hot, shard_bytes=3000))
    want = brute_dedup(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want[i], i
        assert (got[i]["kept_text"] is None) == (t is None)
        assert got[i]["label"] == "l"


def test_dedup_of_long_texts_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BITS", 10)
    monkeypatch.setattr(substring_dedup, "_hashes", [])
    a, b = words(800, 30), words(500, 31)
    texts = [a + b, b + a, words(700, 32)]
    found = [list(substring_dedup.anchors(t.encode())) for t in texts]
    assert all(len(f) > 3 for f in found)
    for f, t in zip(found, texts, strict=True):
        lo, n = np.concatenate([x[2] for x in f]), np.concatenate([x[3] for x in f])
        assert lo[0] == 0
        assert (lo[1:] == lo[:-1] + n[:-1]).all()
        assert lo[-1] + n[-1] == len(t) - 199


def test_dedup_repeated_rows_and_empty(spark):
    df = table(spark, [words(100, 40)])
    both = by_id(substring_dedup.deduplicate(df.union(df)))
    assert both[0]["n_removed"] == both[0]["n_bytes"]
    assert substring_dedup.deduplicate(df.union(df)).count() == 2
    assert substring_dedup.deduplicate(df.where("false")).count() == 0
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert substring_dedup.deduplicate(none).first().n_removed == 0


def test_dedup_of_one_row_in_many_copies(spark):
    text = words(300, 41)
    df = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(table(spark, [words(100, 42)], False).select("doc_id", "text"))
    ranges = substring_dedup.repeated_ranges(df).collect()
    assert len(ranges) == 1
    assert len(ranges[0].ranges) < 200  # those of one copy
    got = substring_dedup.deduplicate(df).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {len(text): 20_000, 0: 1}


# --- 1: SentencePiece ---------------------------------------------------------------------------------------------
def test_codec_parity_and_round_trip(spark):
    texts = [*odd_texts(), "  two  spaces ", " lead", "<s> </s> <unk> <0x0A>", "\x00\x7f\t\r\n", "=" * 500, " " * 97]
    got = by_id(sentencepiece_codec.encode(table(spark, texts), verify_every=1))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert (r["ids"], r["decoded"], r["round_trip"], r["parity"]) == (None, None, None, None)
        else:
            assert r["ids"] == library.encode(t)
            assert r["decoded"] == t
            assert r["round_trip"]
            assert r["parity"]
    assert sentencepiece_codec.encode(table(spark, [], False).where("false")).count() == 0
    again = by_id(sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, texts))))
    assert all(again[i]["decoded"] == t for i, t in enumerate(texts))


@pytest.mark.parametrize(("memo", "together", "long"), [(1 << 20, 1 << 15, 1 << 12), (5, 1 << 15, 1 << 12), (1 << 20, 20, 1 << 12), (1 << 20, 1 << 15, 3)])
def test_texts_are_encoded_by_words_exactly(monkeypatch, memo, together, long):
    for name, value in (("MEMO", memo), ("TOGETHER_CHARS", together), ("MEMO_CHARS", long)):
        monkeypatch.setattr(sentencepiece_codec, name, value)
    with open(sentencepiece_codec.MODEL_PATH, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    assert codec.by_words
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    text = "A text  of words\nand   spaces, x y z. " * 200 + "▁ ▁▁ end"
    texts = [text, "", " ", "  ", "a  b", " a", "a ", "a   ", "  ▁ b▁c ▁", "▁", "▁▁", "x▁ y", "日本 語", "\n a\n", "a▁▁", "<s> </s> <unk> <0x41>", "\x00 z", "y" * 10_000, text]
    for _ in range(2):
        ids, counts, decoded = codec.both_ways(texts)
        assert codec.encode(texts) == library.encode(texts) == [x.ids for x in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for x in library.encode(texts) for i in x]
        assert counts.tolist() == [len(x) for x in library.encode(texts)]
        assert decoded == library.decode(library.encode(texts)) == codec.decode(library.encode(texts))


def _proto(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3 | 0] if number < 16 else [number << 3 & 127 | 128, number >> 4]) + bytes([value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += bytes([number << 3 | 2]) + bytes([len(value)]) + value
    return out


def test_every_text_is_verified(spark):
    texts = [words(20, 500 + i) for i in range(40)]
    assert [r.parity for r in sentencepiece_codec.encode(table(spark, texts)).collect()] == [True] * 40


@pytest.mark.parametrize("one_space", [0, 1])
def test_unigram_models(tmp_path, one_space):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("▁the", -1.5), ("he", -2.5), ("t", -4.0), ("h", -4.1), ("e", -3.9), ("▁t", -3.0), ("in", -2.2), ("i", -4.2), ("n", -4.3), ("▁in", -2.1))]
    data = b""
    for p, s, k in pieces:
        data += _proto([(1, _proto([(1, p.encode()), (2, s), (3, k)]))])
    data += _proto([(2, _proto([(3, 1), (35, 1)]))]) + _proto([(3, _proto([(1, b"identity"), (3, 1), (4, one_space), (5, 1)]))])
    path = tmp_path / "tiny.model"
    path.write_bytes(data)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    codec = sentencepiece_codec.Codec(data)
    texts = ["the in then", "hein  the", "thé x", "t", "inin the the", " the "]
    assert codec.encode(texts) == library.encode(texts)
    assert codec.decode(codec.encode(texts)) == library.decode(library.encode(texts))


def test_quality_verdicts_agree_with_labels(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    got = by_id(quality.op4_quality(spark, d))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(labels[i], r["kept"]) for i, r in got.items() if labels.get(i) is not None and not r["base_failed"]]
    assert sum(q == 0 for q, _ in judged) > 5
    assert np.mean([not kept for q, kept in judged if q == 0]) > 0.9
    assert np.mean([kept for q, kept in judged if q == 1]) > 0.97


# --- 8: toxicity -----------------------------------------------------------------------------------------------------
def test_toxicity_held_out_accuracy(spark):
    texts, toxic = [], []
    for i in range(400):
        w = words(60, 1000 + i).split()
        if i % 4 == 0:
            w[i % 50] = ("zorblax", "zorblin", "moron")[i // 4 % 3]
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    docs = table(spark, [*texts, *odd_texts()])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, labels, doc_key("doc_id") % 5 != 0)
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50
    assert all((got[i]["score"] >= 0.5) == bool(toxic[i]) for i in held)
    assert all(0 <= got[i]["score"] < 0.5 for i in range(400, 400 + len(odd_texts())))
    kept = toxicity.screened(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == 300 + len(odd_texts())
    assert "text" not in model.voters.mined


def test_toxicity_without_labels(spark):
    docs = table(spark, ["you are a pathetic idiot", "fine words", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))))
    assert got[0]["score"] >= 0.5 > got[1]["score"]


def simulated_votes(n, seed):
    """Votes of six independent voters (one for the other class) and of two that copy the first one's mostly, their classes, and the rates."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.15
    rates = np.array([[0.6, 0.01], [0.5, 0.02], [0.4, 0.01], [0.45, 0.03], [0.35, 0.005], [0.02, 0.5]])
    votes = (rng.random((n, 6)) < np.where(y[:, None], rates[:, 0], rates[:, 1])).astype(int)
    copies = np.where(rng.random((n, 2)) < 0.9, votes[:, :1], rng.random((n, 2)) < np.where(y[:, None], 0.5, 0.02)).astype(int)
    votes[:, 5] *= -1
    return np.column_stack([votes, copies]), y, rates


def test_label_model_without_labels_recovers_rates(monkeypatch):
    votes, y, rates = simulated_votes(20_000, 3)
    p, found, correlations, groups = toxicity.label_model(votes, 0.15)
    assert np.allclose(found[:6], rates, atol=0.06)
    assert sorted(next(g for g in groups if 0 in g)) == [0, 6, 7]
    assert all(len(g) == 1 for g in groups if 0 not in g)
    assert correlations[0, 6] > 0.5
    assert np.abs(correlations[0, 1:6]).max() < toxicity.CORRELATED
    # brute force: the posterior of the true distribution, with the joint rates of the three that go together
    code = votes[:, [0, 6, 7]] @ [1, 2, 4]
    odds = np.log(0.15 / 0.85) + sum(np.log(np.where(votes[:, j] != 0, a / b, (1 - a) / (1 - b))) for j, (a, b) in enumerate(rates) if j)
    odds += np.array([np.log(((y & (code == k)).sum() + 0.5) / y.sum() / (((~y & (code == k)).sum() + 0.5) / (~y).sum())) for k in range(8)])[code]
    best = 1 / (1 + np.exp(-odds))
    assert ((p > 0.5) == (best > 0.5)).mean() > 0.985
    assert ((p > 0.5) == y).mean() > ((best > 0.5) == y).mean() - 0.01
    # counting the copies as if they were independent is worse
    monkeypatch.setattr(toxicity, "CORRELATED", 2)
    alone = toxicity.label_model(votes, 0.15)[0]
    loss = lambda q: -np.mean(np.log(np.clip(np.where(y, q, 1 - q), 1e-9, 1)))
    assert loss(p) < loss(alone)


def test_covering_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        texts = [np.flatnonzero(rng.random(n) < 0.4) for _ in range(int(rng.integers(1, 30)))]
        chosen, need = [], [toxicity.COVER] * len(texts)
        while True:
            gain = [0 if m in chosen else sum(bool(k) and m in t for k, t in zip(need, texts, strict=True)) for m in range(n)]
            if max(gain) < 3:
                break
            best = gain.index(max(gain))
            need = [k - (k > 0 and best in t) for k, t in zip(need, texts, strict=True)]
            chosen.append(best)
        assert toxicity.covering(texts, n, 3) == chosen


def test_calibration_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(50):
        z = rng.normal(size=30).round(1)
        t = (z + rng.normal(size=30) > 0).astype(int)
        wrong = lambda c, z=z, t=t: int(((z + c > 0) != t).sum())
        assert wrong(toxicity.calibrated(z, t)) == min(wrong(c) for c in np.arange(-6, 6, 0.05) - 0.025)


def test_toxicity_with_copied_and_repeated_rows(spark):
    texts, toxic = [], []
    for i in range(300):
        mark = ("zorblax" if i % 2 else "quimpel") if i % 3 == 0 else ""
        texts.append(f"{words(60, 1000 + i)} {mark}")
        toxic.append(int(i % 3 == 0))
    texts += ["glomph " + words(80, 5000, 4000)] * 400  # copies of one toxic text fill no list
    toxic += [1] * 400
    docs = table(spark, texts)
    docs = docs.union(docs.where("doc_id < 5"))
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, toxic[0])], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, doc_key("doc_id") % 5 != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) + 5
    held = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == bool(toxic[r.doc_id]) for r in held]) == 1


# --- 4: quality ----------------------------------------------------------------------------------------------------------
def test_base_statistics_against_brute_force():
    for t in odd_texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        counts, features = quality.statistics(t)
        assert counts == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)]
        assert all(math.isfinite(x) for x in features)


def test_outliers_go_and_clean_texts_stay(spark):
    clean = [words(80 + i % 40, 5000 + i, 3000) + f"\nLine {i}." for i in range(260)]
    junk = [" ".join(x + "%%%" for x in words(80, 6000 + i).split()) for i in range(30)]
    short = ["too few words", None, ""]
    got = by_id(quality.judge(table(spark, clean + junk + short)))
    assert sum(got[i]["kept"] for i in range(260)) >= 258
    assert not any(got[i]["kept"] for i in range(260, 293))
    assert all(got[i]["base_failed"] for i in range(290, 293))
    assert quality.judge(table(spark, []).where("false")).count() == 0


def raised(cov):
    return cov + np.diag(np.maximum(quality.FLOORS**2 - np.diag(cov), 0))


def brute_mcd(x, h=quality.H):
    """The same concentration steps with exact edges."""
    best = None
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    starts = [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2)), (x.mean(0), np.cov(x.T, bias=True))]
    for mean, cov in starts:
        for _ in range(20):
            gap = x - mean
            d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(raised(cov)), gap)
            near = x[np.argsort(d)[: math.ceil(h * len(x))]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * quality.consistency(h)
        det = np.linalg.slogdet(raised(cov))[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    gap = x - best[1]
    d = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(raised(best[2])), gap)
    near = x[d <= quality.chi2_quantile(quality.REWEIGHT, quality.P)]
    return near.mean(0), np.cov(near.T, bias=True) * quality.consistency(quality.REWEIGHT)


def test_mcd_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(1, 0.2, (300, quality.P)), rng.normal(4, 0.1, (60, quality.P))])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    r = quality.mcd(df).first()
    mean, cov = brute_mcd(x)
    assert np.allclose(r["mean"], mean, atol=0.03)
    full = np.zeros((quality.P, quality.P))
    for (i, j), v in zip(quality._PAIRS, r["inv"], strict=True):
        full[i, j] = full[j, i] = v / (1 if i == j else 2)
    assert np.allclose(np.linalg.inv(full), raised(cov), atol=0.02)
    outside = ((x - np.array(r["mean"])) @ full * (x - np.array(r["mean"]))).sum(1) > quality.chi2_quantile(quality.QUANTILE, quality.P)
    assert outside[300:].all()
    assert outside[:300].sum() == 0


def test_chi2():
    assert quality.chi2_quantile(0.5, 6) == pytest.approx(5.348, abs=1e-3)
    assert quality.chi2_quantile(0.975, 6) == pytest.approx(14.449, abs=1e-3)


# --- 6: language model ------------------------------------------------------------------------------------------------------
def brute_lm(train, order, probes):
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]

    grams, raw = {order: Counter()}, Counter()
    for t in train:
        s = ["<s>"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(s)):
            grams[order][tuple(s[i - order + 1 : i + 1])] += 1
            raw[s[i]] += 1
    total = grams[order]
    for k in range(order - 1, 0, -1):
        a, r = Counter(), Counter()
        for g in grams[k + 1]:
            r[g[1:]] += total[g]
            a[g[1:]] += 1
        for q in a:
            if k > 1 and q[0] == "<s>":
                a[q] = r[q]
        grams[k], total = a, r
    d = {k: ngram_lm.discounts([sum(v == j for v in g.values()) for j in (1, 2, 3, 4)]) for k, g in grams.items()}
    contexts = {}
    for k, g in grams.items():
        for x, c in g.items():
            n, held = contexts.get((k, x[:-1]), (0, 0.0))
            contexts[k, x[:-1]] = n + c, held + d[k][min(c, 3)]

    def p(g):
        k = len(g)
        low = 1 / (len(grams[1]) + 1) if k == 1 else p(g[1:])
        if (k, g[:-1]) not in contexts:
            return low
        n, held = contexts[k, g[:-1]]
        c = grams[k].get(g, 0)
        return max(c - d[k][min(c, 3)], 0) / n + held / n * low

    out = []
    for t in probes:
        s = ["<s>"] * (order - 1) + tokens(t)
        out.append(sum(math.log10(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))))
    mass = sum(p((*next(iter(grams[order]))[:-1], w)) for w in [*(g[0] for g in grams[1]), "unseen"])
    return out, raw, mass


@pytest.mark.parametrize(("order", "shard_bytes"), [(1, 1 << 25), (2, 1 << 25), (2, 2000), (3, 1 << 25), (3, 1000), (4, 1500)])
def test_language_model_against_brute_force(spark, order, shard_bytes):
    texts = [words(60, 3000 + i, 60) for i in range(40)] + ["", None, "The THE the"]
    probes = [*texts[30:], words(50, 9, 90), "never seen", *odd_texts()[:9]]
    model = ngram_lm.train(table(spark, texts).repartition(3), order, shard_bytes)
    assert (model.bits > 0) == (shard_bytes < 1 << 25)
    got = by_id(ngram_lm.score(table(spark, probes), model))
    want, raw, mass = brute_lm(texts, order, probes)
    assert mass == pytest.approx(1)
    assert (model.tokens, model.vocabulary) == (sum(raw.values()), len(raw))
    for i, t in enumerate(probes):
        w = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), "</s>"]
        assert got[i]["score"] == pytest.approx(want[i])
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(w), sum(raw[x] > 0 for x in w))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((raw[x] + 1) / (model.tokens + len(raw) + 1)) for x in w))


def test_default_model_uses_two_words_of_context(spark):
    texts = ["a b c", "d b e"] * 30
    got = by_id(ngram_lm.score(table(spark, ["a b c", "d b c"]), ngram_lm.train(table(spark, texts))))
    assert got[0]["score"] > got[1]["score"] + 0.1


def test_language_model_without_training(spark):
    df = table(spark, ["a b", None])
    model = ngram_lm.train(df.where("false"))
    got = by_id(ngram_lm.score(df, model))
    assert got[0]["n_known"] == 0
    assert ngram_lm.score(df.where("false"), model).count() == 0


def test_a_lost_model_file_is_an_error(spark):
    df = table(spark, [words(60, 3000 + i, 60) for i in range(40)])
    for spoil in (os.remove, lambda path: os.truncate(path, 8)):
        model = ngram_lm.train(df, 2, 2000)
        path = sorted(glob.glob(f"{ngram_lm.Files(model.uri).local}/2-*-values"))[0]
        spoil(path)
        with pytest.raises(Exception, match="model's file"):
            ngram_lm.score(df, model).collect()


def test_model_without_ids_and_with_repeated_rows(spark):
    df = table(spark, ["a b c", "a b d", None])
    twice = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    model = ngram_lm.train(twice)
    assert model.tokens == 2 * (4 + 4 + 1)
    got = ngram_lm.score(twice, model).collect()
    assert len(got) == 6
    assert len({r.score for r in got}) == 2
    assert ngram_lm.train(df).tokens == 9


def test_flushing_changes_nothing(spark, monkeypatch):
    texts = [words(40, 4000 + i, 50) for i in range(20)]
    blobs = [list(ngram_lm._counted(iter([_batch(texts)]), 2, 3))]
    monkeypatch.setattr(ngram_lm, "COUNT_TOKENS", 100)
    blobs.append(list(ngram_lm._counted(iter([_batch(texts)]), 2, 3)))
    totals = []
    for parts in blobs:
        c = Counter()
        for b in parts:
            for x in b["payload"].to_pylist():
                (v, w), (n,) = ngram_lm._unpack(x)
                for key in zip(v.tolist(), w.tolist(), n.tolist(), strict=True):
                    c[key[:2]] += key[2]
        totals.append(c)
    assert len(blobs[1]) > len(blobs[0])
    assert totals[0] == totals[1]


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])


# --- 3: WARC -------------------------------------------------------------------------------------------------------------------
PAGE = """<!doctype html><html><head><title>A &amp; B</title><meta name="k" content="v"><style>p{}</style><script>var t="</p>";</script></head>
<body><p>One <b>two</b></p><!-- gone --><a href="/x?a=1&amp;b=2">link <i>text</i></a><img src='i.png'><p>Last"""


def test_warc_derivatives(spark, tmp_path):
    rows = [(1, "http://h.example/d/p", PAGE), (2, None, None), (3, "http://h.example/", ""), (1, "http://h.example/d/p", PAGE), (4, "bad[url", "<p>x <a href='http://[bad'>y</a> <"), (5, "u", "<p " * 5000), (6, "u6", "<p>w</p>" * 20000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    responses = warc.pages_as_responses(pages)
    got = warc.derive(responses).collect()
    assert len(got) == 14
    meta = next(r for r in got if r.page_id == 1 and r.record_type == "metadata")
    text = next(r for r in got if r.page_id == 1 and r.record_type == "conversion")
    source = responses.where("page_id = 1").first()
    assert text.block == "A & B\nOne two\nlink text\nLast"
    assert meta.refers_to == text.refers_to == source.record_id
    assert text.source_digest == source.payload_digest == warc.digest(PAGE.encode())
    assert text.block_digest == warc.digest(text.block.encode())
    body = json.loads(meta.block)["Envelope"]
    assert body["WARC-Header-Metadata"]["WARC-Block-Digest"] == source.block_digest
    html = body["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert html["Head"] == {"Title": "A & B", "Metas": [{"content": "v", "name": "k"}]}
    assert html["Links"] == [{"path": "A@/href", "url": "http://h.example/x?a=1&b=2", "text": "link text"}, {"path": "IMG@/src", "url": "http://h.example/d/i.png"}]
    assert {r.record_id for r in got if r.page_id == 1} == {meta.record_id, text.record_id}
    assert next(r.block for r in got if r.page_id == 2 and r.record_type == "conversion") == ""
    assert len(next(r.block for r in got if r.page_id == 6 and r.record_type == "conversion").split("\n")) == 20000
    folder = str(tmp_path / "warc")
    assert sum(r.records for r in warc.save(warc.derive(responses).coalesce(2), folder).collect()) == 14
    again = warc.load(spark, folder).collect()
    assert {(r.record_id, r.refers_to, bytes(r.block).decode()) for r in again} == {(r.record_id, r.refers_to, r.block) for r in got}
    assert warc.derive(responses.where("false")).count() == 0


def test_warc_records_are_members():
    one = warc.record_bytes("conversion", "<urn:uuid:1>", "u", "d", "text/plain", b"hi\r\n\r\nthere", {"WARC-Refers-To": "<urn:uuid:0>"})
    (h, b), (h2, _) = warc.records(one + one)
    assert b == b"hi\r\n\r\nthere"
    assert h["WARC-Refers-To"] == "<urn:uuid:0>"
    assert h == h2
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")


def test_markup_of_any_length():
    x = "x" * 300_000
    assert warc.parse(f'<p title="{x}> y" id=k>hello</p>', "u")["text"] == "hello"
    got = warc.parse(f'<meta name=d content="{x} a > b"><a href="/{x} c>d">t</a>' + "".join(f" <i a{i}=v>" for i in range(500)), "http://h/")
    assert got["metas"] == [{"content": f"{x} a > b", "name": "d"}]
    assert got["links"] == [{"path": "A@/href", "url": f"http://h/{x} c>d", "text": "t"}]
    assert got["text"] == "t"
    many = " ".join(f"a{i}='>'" for i in range(1000))
    assert warc.parse(f"<b {many}>bold</b> <p title=\"open>in</p><div a=b\">x", "u")["text"] == "bold\nx"
    assert warc.parse("a<script src='>'>var b = '<p>';</script>c<style>d", "u")["text"] == "ac"
    assert warc.parse("one < two <3 <p", "u")["text"] == "one < two <3"
    for odd in ("<p " * 50_000, '<p a="' * 50_000, "<p a='\"" * 50_000, "<" * 100_000, "<!--" * 50_000, "<a href=" * 50_000 + ">z", "<script>" * 50_000):
        assert len(warc.parse(odd, "u")["text"]) <= len(odd)  # in linear time


def test_warc_files_are_read_by_record(tmp_path):
    class Counted(io.BytesIO):
        most = 0

        def readinto(self, b):
            got = super().readinto(b)
            Counted.most += got
            return got

    data = b"".join(warc.record_bytes("conversion", f"<urn:uuid:{i}>", "u", "d", "text/plain", random.Random(i).randbytes(100_000), {}) for i in range(50))
    it = warc.records(Counted(data))
    assert next(it)[0]["WARC-Record-ID"] == "<urn:uuid:0>"
    assert Counted.most < len(data) / 10
    assert sum(1 for _ in it) == 49
    assert sum(len(b) for _, b in warc.records(gzip.decompress(data))) == 5_000_000


def test_text_of_a_real_parser(data, spark):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, d):
            if not self.skip:
                self.out.append(d)

    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        p = Text()
        p.feed(r.html)
        assert "".join(warc.parse(r.html, r.url)["text"].split()) == "".join("".join(p.out).split())
