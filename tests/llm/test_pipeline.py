import corpus_pipeline
import pytest
from dagspark.llm import common, registry
from pyspark.sql import functions as F

from .helpers import odd_texts, table, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    passage = words(90, 20)
    item = words(30, 21, 5000)
    texts = [words(120, 700 + i, 2000) for i in range(60)]
    texts += [texts[0], texts[1] + " more", *(words(30, 800 + i) + f" {passage} " + words(30, 900 + i) for i in range(3)), f"a {item} b", *(words(50, 950 + i) + " moron idiot" for i in range(40)), *odd_texts()]
    docs = table(spark, texts, False)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int("moron" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts


def test_stages(spark, folder):
    d, texts = folder
    docs = common.documents(spark, d)
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, d), name)
        if name != "sentencepiece":
            assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] > seen[4] == seen[5]
    kept = {r.doc_id: r for r in docs.collect()}
    assert all(i in kept for i in range(60))
    assert kept[5].text == texts[5]
    assert not any("moron" in (r.text or "") for r in kept.values())
    assert 60 not in kept
    passage = words(90, 20)
    assert not any(passage in (r.text or "") for r in kept.values())
    assert not any(words(30, 21, 5000) in (r.text or "") for r in kept.values())
    assert all(r.decoded == r.text and len(r.text or "") == r.n_chars for r in kept.values())


def test_run(spark, folder):
    d, _ = folder
    assert corpus_pipeline.run(spark, d).count() > 60


def test_stages_on_nothing(spark, folder):
    d, _ = folder
    docs = common.stored(common.documents(spark, d).where("false"), "nothing")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, d), name)
        assert docs.count() == 0


def test_null_ids_and_repeats(spark, folder):
    d, _ = folder
    docs = common.documents(spark, d).where("doc_id < 20").withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    docs = common.stored(docs.union(docs), "odd")
    out = common.stored(corpus_pipeline.drop_near_duplicates(spark, docs, d), "out")
    assert out.count() == 20


def test_columns_of_any_name_lose_no_row(spark, folder, tmp_path):
    """All stages on a table with the names that the operators use inside; every row that goes through keeps its values."""
    d, texts = folder
    names = ["_file", "_place", "_nth", "_metadata", "_row_of_stage", "rid", "row", "group", "node", "key", "term"]
    docs = common.documents(spark, d)
    docs = docs.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = common.documents(spark, d)
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = (common.stored(stage(spark, x, d), name) for x in (docs, plain))
        assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in plain.select("doc_id").collect()}, name
        rows = docs.collect()
        assert len(rows) >= 60
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names), name


def test_all_thirteen_are_registered():
    names = {n.split("_")[0] for n in registry.queries()}
    assert names == {f"op{i}" for i in range(1, 14)}
