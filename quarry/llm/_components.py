"""Connected components over links, by alternating large and small stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._base import checkpointed


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of links (a, b), component: the smallest node reachable.

    Each round is a few aggregations and joins of (node, smaller node) rows; their number never exceeds the links'.
    A star around a hot node is aggregated before it is shuffled, and the joins are ones that adaptive execution can split.
    Lineage is cut by a checkpoint each round. Null ends and loops are left out.
    """
    pairs = checkpointed(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.where("a <> b").distinct())
        inner = pairs.select(F.col("b").alias("a")).distinct()
        heads = pairs.groupBy("a").count().where("count > 1").select("a").limit(1).unionByName(pairs.join(inner, "a", "left_semi").select("a").limit(1))
        if heads.isEmpty():
            break
    else:
        raise RuntimeError("the components did not settle")
    return pairs.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def forest(near, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of n rows as two arrays of row numbers.

    near(i, rest): a mask of those rows of `rest` that link with row i. Every row is taken up once and compared with all
    rows not reached yet, so no link that would join two parts is missed and at most n - 1 are given.
    """
    left, right = [], []
    rest = np.arange(n)
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        hit = near(i, rest)
        if hit.any():
            got = rest[hit]
            left.append(np.full(len(got), i))
            right.append(got)
            queue.extend(got.tolist())
            rest = rest[~hit]
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)
