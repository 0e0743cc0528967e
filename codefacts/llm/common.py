"""Helpers shared by the training-data operators: tables in the shared folder, and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import settled as save
from ..scratch import shared_dir

__all__ = ["WORD", "components", "save", "shared_dir", "table"]

#: White space that separates words: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component = smallest node id.

    Alternating star contraction: every node links its larger neighbours to its smallest one, then
    its smaller ones, until nothing changes (a number of rounds logarithmic in the graph).  Minima
    are aggregated before the shuffle, so a node with many links costs no more than the others; the
    edges go to the shared folder after each round.  An empty edge table gives an empty result;
    nodes without edges don't appear.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    pairs = save(pairs, "edges")
    state = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # Each large edge points down; the small star links a node's lower neighbours and itself to the least.
        large = save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        pairs = save(small, "edges")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (now["n"], now["h"]):
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return (
        roots.select(F.col("u").alias("node"), "component")
        .union(roots.select(F.col("component").alias("node"), "component").distinct())
    )
