"""Connected components of an undirected graph, as Spark joins and as a task-side reduction."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.settle import settle


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of the nodes 0..n-1 over the links a[i] - b[i]."""
    low = np.arange(n)
    while a.size:
        least = np.minimum(low[a], low[b])
        if (low[a] == least).all() and (low[b] == least).all():
            break
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while not np.array_equal(low, low[low]):
            low = low[low]
    return low


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) to rows (node, root) with the smallest node of each component as root.

    Only nodes that have a link to another node appear. Alternates large-star and small-star
    rounds; each round is a written table, so lineage stays short and lost executors cost one
    round. A node with very many links is a skewed join key, which adaptive execution splits;
    its minimum is found by partial aggregation. Rows with a null end or a = b are ignored.
    """
    links = settle(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        links = settle(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(links: DataFrame):
    """Count and order-free checksum of the links: equal before and after the last round."""
    mixed = F.shiftrightunsigned(F.xxhash64("u", "v"), 24)
    row = links.agg(F.count("*").alias("n"), F.sum(mixed).alias("s")).first()
    return row["n"], row["s"]
