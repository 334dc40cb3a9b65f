"""Episodes: ordered arrays per agent and level, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def episode_rows(plays: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per keys with the plays' steps and outcomes as arrays in the given order.

    A group holds the episodes of one agent at one level; nulls in the order come first."""
    entry = F.struct(*order, "steps", "outcome")
    rows = plays.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select(*keys, F.col("e.steps").alias("episode_steps"), F.col("e.outcome").alias("episode_outcomes"))


def first_win(outcomes: str = "episode_outcomes") -> Column:
    """1-based place of the first win, 0 if there is none."""
    return F.coalesce(F.array_position(outcomes, "win"), F.lit(0))


def discovery_steps(steps: str = "episode_steps", outcomes: str = "episode_outcomes") -> Column:
    """Steps up to and with the first win; all steps if there is none."""
    taken = F.when(first_win(outcomes) > 0, F.slice(steps, 1, first_win(outcomes).cast("int"))).otherwise(F.col(steps))
    return F.aggregate(taken, F.lit(0).cast("long"), lambda a, x: a + x)


def execution_steps(steps: str = "episode_steps", outcomes: str = "episode_outcomes") -> Column:
    """Steps of each win after the first."""
    both = F.filter(F.arrays_zip(F.col(steps).alias("s"), F.col(outcomes).alias("o")), lambda x: x["o"] == "win")
    return F.transform(F.slice(both, 2, F.greatest(F.size(both), F.lit(1))), lambda x: x["s"])


def longest_streak(outcomes: str = "episode_outcomes") -> Column:
    """The most wins in a row."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x == "win", a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(outcomes, zero, step, lambda a: a["best"])


def steps_to_streak(wins: int, steps: str = "episode_steps", outcomes: str = "episode_outcomes") -> Column:
    """struct(run, taken, done): steps taken until `wins` wins in a row, all of them without."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).cast("long").alias("taken"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x["o"] == "win", a["run"] + 1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(run.alias("run"), (a["taken"] + x["s"]).alias("taken"), (run >= wins).alias("done")))

    return F.aggregate(F.arrays_zip(F.col(steps).alias("s"), F.col(outcomes).alias("o")), zero, step)


def any_match_outcome(win: Column, died: Column) -> Column:
    """Three-valued win to an outcome: a death comes before a loss and before an unfinished play."""
    return F.when(win, "win").when(died, "avatar_died").when(win.isNotNull(), "loss").otherwise("incomplete")


def sessions(frames: DataFrame, key: list[str], order: list[str], broke: Column) -> DataFrame:
    """frames with session, the number of breaks so far within the key; broke may use prev_<col>."""
    w = Window.partitionBy(*key).orderBy(*order)
    return frames.withColumn("session", F.sum(F.coalesce(broke, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def with_previous(frames: DataFrame, key: list[str], order: list[str], cols: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return frames.withColumns({f"prev_{c}": F.lag(c).over(w) for c in cols})
