"""Connected components by alternating large-star and small-star rounds.

Links stay distributed throughout; only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    root = _least(both).select("a", F.least("a", "least").alias("root"))
    return both.join(root, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    root = _least(links).withColumnRenamed("least", "root")
    joined = links.join(root, "a")
    moved = joined.where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(root.select("a", F.col("root").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node reachable.

    Links may repeat, point either way or join a node to itself; null ends are ignored.
    Nodes without a link to another node are not returned. Each round replaces the links
    by at most as many others, so nothing grows; the number of rounds is logarithmic.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = checkpointed(now)
    state = _state(now)
    if state[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        now = checkpointed(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
