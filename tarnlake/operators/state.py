"""State machines over ordered attempts, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


COUNTERS = "struct<level:int,tries:int,w:int,l:int,attempts:int,reason:string>"


def counters(outcomes: Column, wins: int, losses: int, budget: int, start: Column | None = None) -> Column:
    """All counters after a run of outcomes: level, tries at it, wins and losses in a row, attempts, and
    why the run stopped. `wins` in a row go to the next level, `losses` in a row or `budget`
    attempts at a level stop the run. start: the counters that an earlier part ended with (null: none),
    so that a run in parts is the run in one."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("level", "tries", "w", "l", "attempts")], F.lit("").alias("reason"))
    begin = zero if start is None else F.coalesce(start.cast(COUNTERS), zero)

    def step(a: Column, x: Column) -> Column:
        w, l = F.when(x == "win", a["w"] + 1).otherwise(0), F.when(x == "loss", a["l"] + 1).otherwise(0)
        tries, up = a["tries"] + 1, w >= wins
        reason = F.when(up, "").when(l >= losses, "losses").when(tries >= budget, "budget").otherwise("")
        new = F.struct(
            (a["level"] + up.cast("int")).alias("level"), F.when(up, 0).otherwise(tries).alias("tries"), F.when(up, 0).otherwise(w).alias("w"),
            F.when(up, 0).otherwise(l).alias("l"), (a["attempts"] + 1).alias("attempts"), reason.alias("reason"),
        )
        return F.when(a["reason"] != "", a).otherwise(new)

    return F.aggregate(outcomes, begin, step)


def advancement(outcomes: Column, wins: int, losses: int, budget: int) -> Column:
    """struct(level, attempts, reason) of counters()."""
    zero = counters(outcomes, wins, losses, budget)
    return F.transform(F.array(zero), lambda a: F.struct(a["level"].alias("level"), a["attempts"].alias("attempts"), a["reason"].alias("reason")))[0]


def restored(steps: DataFrame, run: list[str], order: list[str], sums: list[str], idle: int = 0) -> DataFrame:
    """What a run that is taken up again starts with, from its steps (action, level, won, lose, crashed,
    retries and the columns of sums): the level after its last advance, real steps and frames (`idle`
    more a step), sums (nulls are 0), retries, wins, losses and their difference, and the outcome of
    the last real step. Advances and crashed steps aren't real; their sums count."""
    advance = F.coalesce(F.col("action") == "_level_advance", F.lit(False))
    real = ~advance & ~F.coalesce(F.col("crashed"), F.lit(False))
    won, lose = (F.coalesce(F.col(c), F.lit(False)) for c in ("won", "lose"))
    at = F.struct(*order)
    last = F.max_by(F.struct(won.alias("won"), lose.alias("lose")), F.when(real & ~(F.coalesce(F.col("action"), F.lit("")) == ""), at))
    g = steps.groupBy(*run).agg(
        F.max_by(F.when(advance, F.col("level") + 1), F.when(advance, at)).alias("_up"), F.count_if(real).alias("step_num"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums],
        F.sum(F.coalesce("retries", F.lit(0))).cast("long").alias("retries"), F.count_if(real & won).alias("wins"), F.count_if(real & lose).alias("losses"), last.alias("_last"),
    )
    outcome = F.when(F.col("_last.won"), "won").when(F.col("_last.lose"), "died").otherwise("")
    return g.select(*run, F.coalesce("_up", F.lit(0)).cast("int").alias("resume_level"), "step_num", (F.col("step_num") * (1 + idle)).alias("total_frames"), *sums, "retries", "wins", "losses", (F.col("wins") - F.col("losses")).alias("success"), outcome.alias("prev_outcome"))


def other_runs(history: DataFrame, wanted: DataFrame, run: list[str], names: list[str]) -> DataFrame:
    """Runs to take up whose history is missing or differs in one of names; must be empty."""
    h = history.select(*run, *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_here"))
    differs = F.col("_here").isNull()
    for n in names:
        differs = differs | ~F.col(n).eqNullSafe(F.col(f"_{n}"))
    return wanted.join(h, run, "left").where(differs).select(*wanted.columns)


def failures_in_a_row(rows: DataFrame, key: list[str], order: list[str], failed: Column) -> DataFrame:
    """failures: how many rows up to this one failed since the last that didn't."""
    w = Window.partitionBy(*key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_f", failed.cast("int")).withColumn("_isl", F.sum(1 - F.col("_f")).over(run))
    inner = Window.partitionBy(*key, "_isl").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumn("failures", F.sum("_f").over(inner)).drop("_f", "_isl")
