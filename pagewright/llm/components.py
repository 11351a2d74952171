"""Connected components by contracting every node into its first neighbour, again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Rounds after which the way from nodes to components is written, so that no plan joins many of them.
FOLDED = 4


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for every node of edges (a, b); a link of a node to itself adds nothing.

    Each round puts the nodes in an order of its own, by a hash of the node and
    the round; every second one, the first among them, by falling numbers of
    links before that. A node is mapped to the first of itself and its
    neighbours, the links' ends are mapped along, and links within a new node
    go. Stars take one round. In a hashed order a node with links is the first
    of its neighbourhood with a chance of half at most, so that rounds are
    logarithmic in the number of nodes for any links, chains included. None
    collects anything, and each is written to shared storage, so that no round
    is repeated if executors go. Nulls link with nothing.
    """
    left, found, k = written(edges.select("a", "b").where("a <> b").distinct()), None, 0
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("node"))
        if k % 2:
            ranked = both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a")).alias("to"))
        else:
            degree = both.groupBy(F.col("a").alias("node")).agg((-F.count("*")).alias("n"))
            of_b = both.join(degree.withColumnRenamed("node", "b"), "b").select("a", F.struct("n", rank("b").alias("r")).alias("rank"))
            own = degree.select(F.col("node").alias("a"), F.struct("n", rank("node").alias("r")).alias("rank"))
            ranked = of_b.union(own).groupBy("a").agg(F.min("rank")["r"].alias("to"))
        step = written(ranked.select(F.col("a").alias("node"), F.col("to.node").alias("to")))
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        ends = F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")
        after = written(left.join(to_a, "a").join(to_b, "b").where("to_a <> to_b").select(*ends).distinct())
        dropped(left)
        left, k = after, k + 1
        if found is None:
            found, steps = step.withColumnRenamed("to", "component"), [step]
        else:
            found = found.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            steps.append(step)
        ended = left.isEmpty()
        if ended:
            break
        if len(steps) > FOLDED:
            found = written(found)
            dropped(*steps)
            steps = [found]
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
