"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import cut

#: Rounds after which a graph is taken to be wrong; the method needs about log2 of the longest path.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an undirected edge list (u, v); the component is its least node.

    Edges are rewired, never grown into pairs: each round has at most as many edges as there were. Rows
    with a NULL end or u = v give no edge; an empty edge list gives an empty result. Rounds are cut by reliable checkpoints and
    stop when a round changes nothing (count and hash of the edges).
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        now = cut(_small_star(_large_star(now)))
        state = tuple(now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state
    raise RuntimeError("components did not settle")
