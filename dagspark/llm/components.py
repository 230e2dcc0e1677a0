"""Connected components of a link table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return (node, root) for every node of edges; root is the smallest node of its component.

    Each round hooks a node's parent to the smallest parent among its
    neighbours and then halves every path, so rounds grow with the logarithm of
    the longest path. Minima are aggregated before the shuffle; every join is
    between two stored tables, so that a hub's rows can be split, and by merging,
    as tables to broadcast would all go over the driver. Each round's
    parents are written to the shared folder, which cuts the lineage. Self
    links and repeated links are fine, an empty table gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    parent = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parents")
    while True:
        pu = parent.select(F.col("u"), F.col("p").alias("pu"))
        pv = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        crossing = both.join(pu.hint("merge"), "u").join(pv.hint("merge"), "v").where("pu <> pv")
        hooks = crossing.select(F.explode(F.array(F.struct(F.col("pu").alias("u"), F.col("pv").alias("p")), F.struct("u", F.col("pv").alias("p")))).alias("h")).select("h.*")
        hooked = stored(parent.select("u", "p").unionByName(hooks).groupBy("u").agg(F.min("p").alias("p")), "hooked")
        up = hooked.select(F.col("u").alias("p"), F.col("p").alias("g"))
        jumped = stored(hooked.join(up.hint("merge"), "p").select("u", F.least("p", "g").alias("p")), "parents")
        moved = jumped.join(parent.withColumnRenamed("p", "old").hint("merge"), "u").where("p <> old").limit(1).count()
        forget(hooked, parent)
        parent = jumped
        if not moved:
            forget(both)
            return parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
