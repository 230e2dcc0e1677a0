"""Tables that grow with the input are joined without going over the driver."""

from dagspark.llm import simhash


def test_fingerprints_are_not_broadcast(spark):
    fps = spark.createDataFrame([(0,), (1,), (3,), (1 << 40,)], "fp long")
    links = simhash.golay_links(fps)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == [(0, 1), (0, 3), (0, 1 << 40), (1, 3), (1, 1 << 40), (3, 1 << 40)]
