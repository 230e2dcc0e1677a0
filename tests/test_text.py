"""Text functions compute what they are given once, and find what they found before."""

import pytest
from pyspark.sql import functions as F

from dagspark.functions import text


@pytest.mark.parametrize("f", [text.kgrams, text.data_kinds, text.winnowed])
def test_an_expression_is_not_repeated(spark, f):
    assert str(f(F.split(F.col("text"), "~"))).count("~") == 1


def test_kinds_of_tokens(spark):
    rows = ["spiketrains", "isi", "isis", "a csv", "localfields dataframe9", "", None, "eegs scalps"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, text string")
    got = {r.i: list(r.k) for r in df.select("i", text.data_kinds(text.tokens(F.col("text"))).alias("k")).collect()}
    assert got == {0: ["spike"], 1: ["spike"], 2: [], 3: ["table"], 4: ["lfp", "table"], 5: [], 6: [], 7: ["eeg"]}


def test_grams_and_intent(spark):
    row = spark.range(1).select(text.kgrams(F.split(F.lit("a.b c a.b"), " ")).alias("g"), text.intent_tokens(F.lit("The Filter of x and spikes")).alias("i")).first()
    assert list(row.g) == ["a.b", "c", "b", "a.b||c", "c||a.b", "a.b||c||a.b"]
    assert list(row.i) == ["filter", "spikes"]
