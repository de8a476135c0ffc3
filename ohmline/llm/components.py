"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmline.shared import cut, drop_table


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    tied = both.join(least, "node").where("other > node")
    return tied.select(F.col("other").alias("high"), F.least("least", "node").alias("low"))


def small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionByName(least.withColumnRenamed("least", "low"))


def roots(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(high, low) for each node that is not the least of its component; ``low`` is that least node.

    ``links`` are pairs of different nodes with high > low. A round is two joins on aggregated neighbours, its
    result a written table; the number of rounds grows with the logarithm of the longest path.
    """
    state, before = cut(links.select("high", "low").distinct()), None
    for _ in range(most_rounds):
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("high", "low"))).first()
        if mark == before:
            return state
        before = mark
        done, state = state, cut(small_star(large_star(state).distinct()).distinct())
        drop_table(done)
    raise RuntimeError("the components did not settle")
