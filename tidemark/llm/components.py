"""Connected components of an edge list, by alternating star contractions.

Every round moves edges towards the smallest node of a neighbourhood: O(log^2) rounds, each of
plain aggregations and joins. A node with very many neighbours is a hot join key, never a group
held in memory: its minimum comes from a partial aggregation, and as both sides of the join are
read from storage, adaptive execution may split the hot side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace


def _least(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    return work.write(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) that is not the smallest of its component."""
    held = work.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges_0")
    state = _state(held)
    for k in range(1, most_rounds):
        if state[0] == 0:
            break
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, work, f"large_{k}")
        large = work.write(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), f"edges_{k}_large"
        )
        least = _least(large, work, f"small_{k}")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, held = state, work.write(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), f"edges_{k}")
        state = _state(held)
        for name in (f"edges_{k - 1}", f"edges_{k}_large", f"large_{k}", f"small_{k}"):
            work.drop(name)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return held.select("u", F.col("v").alias("root"))
