"""Connected components by alternating large and small stars, over tables in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scratch


def components(spark: SparkSession, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long); component is its least node.

    Each round pulls nodes to the least node that they or their neighbours know; no node's neighbours are ever
    gathered, only their minimum. Rounds are logarithmic in the number of nodes.
    """
    stars = scratch.written(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = signature(stars)  # links that are stars already settle in one round
    for _ in range(most):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch.written(spark, low.select("u", F.col("m").alias("v")).unionByName(linked).distinct(), "stars")
        now = signature(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def blocks(families: DataFrame, most: int, few: int = 1_000_000) -> DataFrame:
    """Each node of ``families`` once for every pair of blocks that its block is in: node, component, i, j, block.

    A family of at most ``most`` nodes is one block. Only the sizes of larger ones are looked up, one for ``most`` nodes
    at most; up to ``few`` of them are sent to every executor, so that no family has to meet in one task.
    """
    large = families.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") > most)
    large = F.broadcast(large) if large.count() <= few else large
    placed = families.join(large, "component", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / most), F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return placed.select("node", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def tied(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every id to the least of its component, for the links u to v."""
    names, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]
