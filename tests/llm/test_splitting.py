"""Words of texts are split once a text."""

import re

from pyspark.sql import functions as F

from dagspark.llm import decontaminate

from .helpers import LOWER, odd_texts, table


def test_texts_are_split_once(spark, monkeypatch):
    plans, stored = {}, decontaminate.stored

    def kept(df, name, *args):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name, *args)

    monkeypatch.setattr(decontaminate, "stored", kept)
    docs = table(spark, odd_texts()).selectExpr("doc_id as rid", "doc_id", "text")
    decontaminate.index(docs, spark.createDataFrame([(1, "ab x one two")], "item_id long, text string"))
    assert len(re.findall(r"\bsplit\(|regexp_replace\(", plans["postings"])) == 1


def test_words_of_odd_texts(spark):
    texts = [*odd_texts(), "-a-", "A", "..", "a\x7fÀb\x00c"]
    got = table(spark, texts).withColumn("w", decontaminate._split(F.col("text")))
    expected = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in texts]
    assert [r.w for r in got.orderBy("doc_id").collect()] == expected
