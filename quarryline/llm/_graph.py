"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import scratched, stage


@scratched
def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (a, b), ids of type long.

    A step rewires each node's neighbours to the smallest one around. Minima are pre-aggregated and
    joined back, so a node with very many neighbours is split. Each round is written to the shared
    folder; the edges that it keeps are no more than those it began with.
    """
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    mark = None
    for k in range(1, most_rounds + 1):
        # large-star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small-star: every smaller neighbour of a node, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stage(small.filter("a <> b").distinct(), f"{name}-{k}")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (seen["n"], seen["s"]):
            break
        mark = (seen["n"], seen["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return stage(out, name, keep=True)
