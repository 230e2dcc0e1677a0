"""The stored search index: what it holds, what queries read, what updates write."""

import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from dagspark.functions import text
from dagspark.search import index, rank, scan, store
from dagspark.search.store import BUCKETS, SearchIndex, bucket_of


def corpus(spark, texts):
    rows = [(f"d{i}", f"file{i // 2}", t, f"src{i % 3}") for i, t in enumerate(texts)]
    words = text.tokens(F.col("body"))
    return spark.createDataFrame(rows, "id string, file string, body string, name string").select(
        "id", "file", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("digest"), words.alias("words"), text.tokens(F.col("name")).alias("name_words"),
        text.intent_tokens(F.col("body")).alias("intent"), F.slice(words, 1, 4).alias("calls"), text.data_kinds(words).alias("kinds"), text.tags(words).alias("tags"), F.lit(False).alias("starred"),
    )


TEXTS = ["filter the eeg signal", "plot raster of spikes", "", None, "filter filter notch", "load csv table of spikes", "mean of nothing", "filter the eeg signal", "welch psd spectrum", "spike sorting of eeg"]
QUERY = ["filter", "eeg", "src1", "missing"]


def ranked(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


def test_ranking_by_the_index_equals_ranking_the_corpus(spark, tmp_path):
    docs = corpus(spark, TEXTS)
    held = SearchIndex(spark, str(tmp_path / "i"))
    assert held.size() == 0
    assert held.candidates([("w", "filter")]).count() == 0
    assert held.update(docs) == 5
    assert held.size() == len(TEXTS)
    assert ranked(rank.search_simple(held, QUERY)) == ranked(rank.rank_simple(docs, QUERY))
    assert rank.search_simple(held, []).count() == 0
    terms, calls, kinds = ["filter", "spikes"], ["plot", "raster", "load"], ["eeg"]
    plain = docs.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("intent", "calls", "kinds")})
    assert ranked(rank.search_fused(held, terms, calls, kinds)) == ranked(rank.rank_fused(plain, "", terms, calls, kinds))
    assert {r.id for r in held.candidates([("w", "eeg"), ("n", "src1")]).collect()} == {"d0", "d1", "d4", "d7", "d9"}


def test_an_update_writes_changed_files_only(spark, tmp_path):
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(corpus(spark, TEXTS))
    assert held.update(corpus(spark, TEXTS)) == 0
    assert held.segments() == [1]
    new = [*TEXTS[:4], "notch of calcium", *TEXTS[5:8]]  # file2 changes, file4 goes
    assert held.update(corpus(spark, new)) == 2
    assert {r.file for r in spark.read.parquet(f"{held.folder}/postings/segment=2").select("file").distinct().collect()} == {"file2"}
    fresh = SearchIndex(spark, str(tmp_path / "fresh"))
    fresh.update(corpus(spark, new))
    packed = held.compacted(str(tmp_path / "packed"))
    for other in (fresh, packed):
        assert held.size() == other.size() == len(new)
        for name in ("w", "t"):
            assert {(r.term, r.df) for r in held.frequencies(name).collect()} == {(r.term, r.df) for r in other.frequencies(name).collect()}
        assert ranked(rank.search_simple(held, QUERY)) == ranked(rank.search_simple(other, QUERY))
    assert packed.segments() == [1]
    assert held.update(corpus(spark, ["calcium only"]), whole=False) == 1
    assert {r.id for r in held.candidates([("w", "calcium")]).collect()} == {"d0", "d4"}


def test_a_segment_that_was_cut_short_is_no_part(spark, tmp_path):
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(corpus(spark, TEXTS))
    os.makedirs(f"{held.folder}/files/segment=2")
    spark.range(3).selectExpr("'w' as list", "'filter' as key", "'x' as id", "'y' as file", "1 as bucket").write.parquet(f"{held.folder}/postings/segment=2")
    assert held.segments() == [1]
    before = held.candidates([("w", "filter")]).count()
    held.update(corpus(spark, [*TEXTS[:9], "filter again"]))
    assert held.candidates([("w", "filter")]).count() == before + 1


def test_a_query_reads_its_buckets_only(spark, tmp_path):
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(corpus(spark, [f"word{i} thing{i % 50} filter" for i in range(400)]))
    read = held.postings([("w", "thing7")])
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in held.postings([("w", "thing7")]).inputFiles()} <= set(range(BUCKETS))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert read.count() == 8
    assert bucket_of("thing7") in range(BUCKETS)


def test_chunks_say_what_they_comment_and_assign(spark):
    source = "# band of interest\nlow, (high, x.y) = 1, (2, 3)  # noqa\nrate: float = 2.5\nz = f(low)  # theta rhythm"
    assert scan.comments_of(source) == ["band of interest", "theta rhythm"]
    assert scan.assigned_names(source) == ["low", "high", "rate", "z"]
    assert scan.comments_of("x = (  # open") == ["open"]
    assert scan.assigned_names("  a = 1\n  b = 2") == ["a", "b"]
    assert scan.assigned_names("def f(:") == []


def test_similar_keeps_its_index(spark, tmp_path):
    src = tmp_path / "lib"
    src.mkdir()
    (src / "a.py").write_text('def clean(data: list) -> list:\n    """Remove slow drift."""\n    theta_band = sorted(data)  # hippocampal rhythm\n    return theta_band\n')
    (src / "b.py").write_text('def other(data: list) -> list:\n    """Count words."""\n    return len(data)\n')
    kept = str(tmp_path / "kept")
    for query in ("hippocampal", "theta"):
        hits = index.similar(spark, [str(src)], query, store=kept)
        assert [h["name"] for h in hits["hits"]] == ["clean"]
        assert hits["candidates_examined"] == 1
    assert SearchIndex(spark, kept).segments() == [1]
    (src / "b.py").write_text('def other(data: list) -> list:\n    """Count theta words."""\n    return len(data)\n')
    assert {h["name"] for h in index.similar(spark, [str(src)], "theta", store=kept)["hits"]} == {"clean", "other"}
    assert SearchIndex(spark, kept).segments() == [1, 2]


def test_many_candidates_are_found_without_a_join(spark, tmp_path, monkeypatch):
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(corpus(spark, TEXTS))
    keys = [("w", x) for x in QUERY] + [("n", x) for x in QUERY]
    few = sorted(r.id for r in held.chosen(keys).collect())
    monkeypatch.setattr(store, "FEW", 1)
    many = held.chosen(keys)
    assert sorted(r.id for r in many.collect()) == few == ["d0", "d1", "d4", "d7", "d9"]
    assert "Join" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_neither_shuffled_nor_sorted(spark, tmp_path):
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(corpus(spark, TEXTS))
    assert not [f for f in os.listdir(f"{held.folder}/features/segment=1") if f.startswith("bucket=")]
    ranked_plan = rank.search_simple(held, QUERY)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in ranked_plan.splitlines() if "Sort [" in line and "words" in line]


def test_tokens_split_at_capitals_and_underscores(spark):
    texts = ["Hello", "helloWorld_again", "_A", "ABc", "Kelvin xY", "", None, "a\nB"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [["hello"], ["hello", "world", "again"], ["a"], ["a", "bc"], ["kelvin", "x", "y"], [], None, ["a", "b"]]


def shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    nothing = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(nothing, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), nothing)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


LONG = [" ".join(f"w{(i * 7919 + j * j * 31) % 3000}" for j in range(400)) + " filter" for i in range(300)]


def test_an_index_is_made_without_shuffling_words_or_postings(spark, tmp_path):
    docs = corpus(spark, LONG).persist()
    docs.count()
    held, before = SearchIndex(spark, str(tmp_path / "i")), shuffled(spark)
    held.update(docs)
    # 120,000 postings; some 3,000 terms are counted in four tasks
    assert shuffled(spark) - before < 400_000
    docs.unpersist()


def test_a_document_s_terms_are_counted_where_it_is_read(spark):
    plan = rank._terms(corpus(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    lists = [["a", "b", "a"], None, [], [None, "b"], ["c", "c"]]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(["0", "1", "2", "3", "4"]), "words": pa.array(lists, pa.list_(pa.string()))})
    for given in (batch, batch.slice(1), batch.slice(1, 2)):
        got = {(r["id"], r["length"], r["term"]): r["tf"] for out in rank._counted(iter([given])) for r in out.to_pylist()}
        assert got == {(i, len(x), w): n for i, x in zip(*given.to_pydict().values(), strict=True) for w, n in Counter(x or []).items() if w is not None}


def test_a_key_is_posted_once_with_its_lists_in_order(monkeypatch):
    ids = [f"d{i}" for i in range(6)]
    w = [["b", "a", "b"], None, ["\u00e9", "z"], [], ["a", None], ["q"] * 9]
    t = [["a"], ["x"], None, [], ["b", "a"], ["r", "q"]]
    kind = pa.list_(pa.string())
    batch = pa.RecordBatch.from_pydict({"id": ids, "file": [i * 2 for i in ids], "w": pa.array(w, kind), "t": pa.array(t, kind)})
    wanted = {(k, i, i * 2, bucket_of(k)): {x for x, c in (("w", a), ("t", b)) if k in (c or [])} for i, a, b in zip(ids, w, t, strict=True) for k in {*(a or []), *(b or [])} - {None}}
    for piece, rows in ((2_000_000, 100_000), (4, 2)):
        monkeypatch.setattr(store, "PIECE", piece)
        monkeypatch.setattr(store, "ROWS", rows)
        got = [tuple(r.values()) for out in store._posted(iter([batch]), ("w", "t")) for r in out.to_pylist()]
        assert {x[1:]: set(x[0]) for x in got} == wanted
        assert len(got) == len(wanted)
    monkeypatch.undo()
    got = [r for out in store._posted(iter([batch]), ("w", "t")) for r in out.to_pylist()]
    assert got == sorted(got, key=lambda r: (r["bucket"], r["key"].encode(), r["id"]))


def test_an_update_counts_terms_of_either_list(spark, tmp_path):
    held, docs = SearchIndex(spark, str(tmp_path / "i")), corpus(spark, TEXTS)
    for texts in (TEXTS, ["the eeg", *TEXTS[1:]]):
        docs = corpus(spark, texts)
        held.update(docs)
        for name in ("w", "t"):
            lists = [r[0] or [] for r in docs.select(store.LISTS[name]).collect()]
            assert {r.term: r.df for r in held.frequencies(name).collect()} == Counter(k for x in lists for k in set(x))
    assert {tuple(r) for r in held.postings([("w", "the"), ("t", "the"), ("w", "eeg"), ("t", "eeg"), ("n", "src0")]).where("id = 'd0'").collect()} == {("w", "the", "d0"), ("w", "eeg", "d0"), ("t", "eeg", "d0"), ("n", "src0", "d0")}


def test_grams_and_fingerprints_are_made_of_stored_calls(spark, tmp_path):
    held, docs = SearchIndex(spark, str(tmp_path / "i")), corpus(spark, TEXTS)
    held.update(docs)
    assert not {"grams", "fingerprints"} & set(spark.read.parquet(f"{held.folder}/features/segment=1").columns)
    made = lambda df: {r.id: (r.grams, r.fingerprints) for r in df.select("id", "grams", "fingerprints").collect()}
    assert made(held.features()) == made(store.featured(docs))
    prints = next(x for x in made(docs.transform(store.featured)).values() if x[1])[1]
    assert held.candidates([("f", prints[0])]).count()


def test_a_fused_search_of_many_candidates_shuffles_numbers_only(spark, tmp_path, monkeypatch):
    docs = corpus(spark, LONG)
    held = SearchIndex(spark, str(tmp_path / "i"))
    held.update(docs)
    monkeypatch.setattr(store, "FEW", 1)
    before = shuffled(spark)
    found = ranked(rank.search_fused(held, ["filter", "w31"], ["w31", "w7919", "w62"], ["eeg"]))
    # 300 candidates of 401 terms each
    assert shuffled(spark) - before < 150_000
    plain = docs.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("intent", "calls", "kinds")})
    assert found == ranked(rank.rank_fused(plain, "", ["filter", "w31"], ["w31", "w7919", "w62"], ["eeg"]))
    assert len(found) == 20


def test_pieces_are_bounded_by_keys_and_batches_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PIECE", 10)
    sizes = [0, 3, 25, 0, 4, 4, 4, 0, 0, 1, 30]
    kind = pa.list_(pa.string())
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(len(sizes))], "file": ["f"] * len(sizes), "w": pa.array([["x"] * n for n in sizes], kind)})
    for given in ([batch], [batch.slice(0, 4), batch.slice(4, 0), batch.slice(4, 2), batch.slice(6)]):
        pieces = [p for p in store._pieces(iter(given)) if p.num_rows]
        assert [r for p in pieces for r in p.to_pylist()] == batch.to_pylist()
        assert all(sum(1 + len(w) for w in p.column("w").to_pylist()[:-1]) < 10 for p in pieces)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    held = SearchIndex(spark, str(tmp_path / "i"))
    assert int(held.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
