"""Connected components of an edge table, as joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.core.shared import materialize, release


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each end of the edges (a, b): component is the smallest id reachable.

    Large star, then small star, until nothing changes: each step takes the minimum of a node's
    neighbours, which combines before the shuffle, and joins it back to the node's edges, which
    splits where a node has very many, as the minima are a table of their own. No neighbour list is ever gathered. Each round is written
    to the shared folder, so that lost executors cost one round at most."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = mark(now)
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        first = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialize(both.join(first, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        second = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(second, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        last, now = now, materialize(small.select("e.a", "e.b").where("a <> b").distinct())
        release(last, first, large, second)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return out.union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
