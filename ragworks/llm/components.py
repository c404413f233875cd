"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragworks.llm.common import discard, materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) of longs or binaries -> (node, root): root is the smallest node that node reaches.

    Alternating large-star and small-star rounds, until the links stay as they
    are: then each is (node, smallest node of its component). Every round works
    on tables in the shared folder; minima are combined on the map side and the
    joins are plain equi-joins that Spark can split where one node is hot.
    Nodes without a link have no row.
    """
    cur = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large")
        drawn = materialize(both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        small = materialize(drawn.groupBy("u").agg(F.min("v").alias("m")), "small")
        pulled = drawn.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(pulled.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(cur, large, drawn, small)
        cur = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
