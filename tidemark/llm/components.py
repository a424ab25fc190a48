"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, stored


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component of the links a-b: (node, least node of its component), roots left out."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[ia], label[ib]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        np.minimum.at(label, ia, low)
        np.minimum.at(label, ib, low)
        while (label[label] != label).any():
            label = label[label]
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node) of every node of edges (a, b) that is not its own component's least.

    Each round moves every neighbour to the least one seen (large star, then small star); it stops when nothing moves,
    and raises an error if that has not been seen within `rounds`.
    Minima are written before they are joined, so both sides of the join are dealt by the join itself and a node with
    very many neighbours can be split.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    last = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == last or not now[0]:
            break
        last = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        forget(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        held, e = e, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(held), forget(large), forget(least)
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
