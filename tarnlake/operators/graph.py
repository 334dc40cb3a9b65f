"""State graphs by frontier joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.core.shared import materialize
from tarnlake.operators.windows import numbered


#: Frontiers after which what has been seen is written as one table, so that its plan stays small.
JOINED = 64


def breadth_first(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth) of what can be reached over edges (src, dst) from starts (node). Each frontier
    is written to the shared folder; the loop ends with the first empty one, or raises if there is
    none within `most` rounds."""
    seen = materialize(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in itertools.count(1):
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = materialize(new.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        if depth == most:
            raise RuntimeError(f"nodes are left after {most} rounds")
        seen = seen.unionByName(front)
        if depth % JOINED == 0:
            seen = materialize(seen)


def transitions(rows: DataFrame, src: str, dst: str) -> DataFrame:
    """n and probability of each transition."""
    n = rows.groupBy(src, dst).agg(F.count("*").alias("n"))
    out = n.groupBy(src).agg(F.sum("n").alias("_t"))
    return n.join(out, src).select(src, dst, "n", (F.col("n") / F.col("_t")).alias("p"))


def reward_vector(seen: DataFrame, states: DataFrame, reward: str) -> DataFrame:
    """node, place and reward of the states that were reached, in the order of depth, then of name."""
    r = seen.join(states.select("node", reward), "node", "left")
    return numbered(r.select("node", "depth", reward), ["depth", "node"], "place").select("node", "place", reward)


def any_all(seen: DataFrame, states: DataFrame, predicates: dict) -> DataFrame:
    """name, any_state and all_states of each predicate (a column over states) over what was reached; all of
    no states is true, any of none false. A null is no."""
    r = seen.join(states, "node")
    holds = [F.struct(F.lit(n).alias("name"), F.coalesce(F.bool_or(F.coalesce(p, F.lit(False))), F.lit(False)).alias("any_state"), F.coalesce(F.bool_and(F.coalesce(p, F.lit(False))), F.lit(True)).alias("all_states")) for n, p in predicates.items()]
    return r.agg(F.array(*holds).alias("h")).select(F.explode("h").alias("h")).select("h.*")
