"""Connected components of an edge table by alternating large and small stars.

Each round points every node's larger (then smaller-or-equal) neighbours to
its smallest one: a minimum per node, which combines on the map side, and a
join back on the node, whose other side is unique. Stars of any size settle
in two rounds, a path of n nodes in about log n. Every round is written to
the shared checkpoint folder; the driver sees two numbers of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", most_rounds: int = 60
                         ) -> DataFrame:
    """(node, component) of every node that has an edge; a component is its smallest node.

    Null ends and loops are ignored, repeated edges count once; no edges give
    no rows. Raises where the rounds do not settle.
    """
    e = scratch.put(edges.filter(F.col(a) != F.col(b))
                    .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = _mark(e)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("m"))
        large = (both.join(least, "x").filter(F.col("y") > F.col("x"))
                 .select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        e = scratch.put(small, "stars")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
