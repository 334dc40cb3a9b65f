"""Traces of networks over plays: found by name, cut to steps, met with what was measured."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.core import checks

#: Names of a trace's folder that say its play, by an id of 24 word characters.
FOLDERS = (r"^play-(\w{24})$", r"^play\d+_key(\w{24})$")


def trace_plays(files: DataFrame, path: str) -> DataFrame:
    """play and path of the trace files whose folder names a play; others are left out. A play with two
    traces raises."""
    folder = F.element_at(F.split(path, "/"), -2)
    found = F.coalesce(*[F.nullif(F.regexp_extract(folder, form, 1), F.lit("")) for form in FOLDERS])
    rows = files.select(F.lower(found).alias("play"), F.col(path).alias("path")).where("play is not null")
    checks.require_empty(checks.duplicate_keys(rows, ["play"]), "one trace of a play")
    return rows


def trace_steps(entries: DataFrame, layers: DataFrame) -> DataFrame:
    """play, layer, step and vector of the layers asked for.

    entries: play, layer, pos, timestep, phase, vector; layers: layer, kind. As many steps as a play's
    entries of a representation layer, or of its first layer by name without one. A representation's
    entries are the steps in their order; of a value or policy layer those of the phase `initial`
    are; of a dynamics or reward layer a step is the mean of its calls (no timestep: step 0), zeros where
    it has none, and calls of other steps are left out. Plays without any of the layers have no rows."""
    kinds = layers.select("layer", "kind").distinct()
    e = entries.join(kinds, "layer", "left")
    count = e.groupBy("play", "layer").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    first = F.struct(F.when(F.col("kind") == "representation", 0).otherwise(1), "layer")
    n_steps = count.groupBy("play").agg(F.min_by("n", first).alias("n_steps"))
    order = F.row_number().over(Window.partitionBy("play", "layer").orderBy("pos")) - 1
    straight = e.where("kind = 'representation' or (kind = 'value' and phase = 'initial')").select("play", "layer", order.alias("step"), "vector")
    calls = e.where("kind = 'dynamics'").select("play", "layer", F.coalesce("timestep", F.lit(0)).alias("step"), F.posexplode("vector").alias("_i", "_x"))
    width = calls.groupBy("play", "layer").agg((F.max("_i") + 1).alias("_w"))
    mean = calls.groupBy("play", "layer", "step", "_i").agg(F.avg("_x").alias("_m")).groupBy("play", "layer", "step").agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_e"))
    dense = width.join(n_steps, "play").select("play", "layer", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_steps") - 1)).alias("step"))
    filled = dense.join(mean, ["play", "layer", "step"], "left").select("play", "layer", F.col("step").cast("int").alias("step"), F.coalesce(F.col("_e._m"), F.array_repeat(F.lit(0.0), F.col("_w"))).alias("vector"))
    return straight.unionByName(filled)


def up_to_step(rows: DataFrame, step: str, most: int | None) -> DataFrame:
    """Rows of steps below `most`; None keeps all."""
    return rows if most is None else rows.where(F.col(step) < most)


def met_plays(model: DataFrame, measured: DataFrame, runs: DataFrame, play: str, run: list[str]) -> tuple[DataFrame, DataFrame]:
    """Model plays with the columns of the measured play of their id whose run was recorded, and (play,
    reason) of those that are skipped: no such play, or no such run."""
    m = measured.withColumn("_measured", F.lit(True))
    both = model.join(m, play, "left").join(runs.select(*run).distinct().withColumn("_run", F.lit(True)), run, "left")
    good = F.col("_measured").isNotNull() & F.col("_run").isNotNull()
    reason = F.when(F.col("_measured").isNull(), "no such play").otherwise("no such run")
    return both.where(good).drop("_measured", "_run"), both.where(~good).select(play, reason.alias("reason")).distinct()


def turns_of_plays(states: DataFrame, group: list[str], play: str, position: str, trial: str) -> DataFrame:
    """states with local, the number of their play within the group: plays are in the order of the trial
    of their first state, then of its position; and step, the state's place in its play."""
    w = Window.partitionBy(*group, play)
    firsts = states.groupBy(*group, play).agg(F.min(F.struct(position, trial)).alias("_f"))
    at = Window.partitionBy(*group).orderBy(f"_f.{trial}", f"_f.{position}")
    firsts = firsts.withColumn("local", F.row_number().over(at) - 1).drop("_f")
    return states.join(firsts, [*group, play]).withColumn("step", F.row_number().over(w.orderBy(position)) - 1)


def attempts(plays: DataFrame, group: list[str], level: str, order: list[str]) -> DataFrame:
    """plays with trial (from 0, in the group's order) and attempt (how often the level came before)."""
    trial = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    attempt = F.row_number().over(Window.partitionBy(*group, level).orderBy(*order)) - 1
    return plays.withColumns({"trial": trial, "attempt": attempt})


def is_sampled(frame: Column, pressed: Column, action_frames_only: bool, stride: int) -> Column:
    """Whether a frame becomes a move: one with a key of the game pressed, or each stride-th."""
    return pressed if action_frames_only else (frame % stride == 0 if stride > 1 else F.lit(True))


#: Widths that a flattened layer is taken to have, the first of them before all others.
WIDTHS = (30, 30, 25, 20, 15, 10)


def heights(n: np.ndarray) -> np.ndarray:
    """The largest divisor of each whole number up to its root; of those below 1 it is 1."""
    values, back = np.unique(n, return_inverse=True)
    out = np.ones(len(values), np.int64)
    at = np.flatnonzero(values > 0)
    left = values[at]
    for h in range(math.isqrt(int(left[-1])) if len(left) else 1, 1, -1):
        lo = np.searchsorted(left, h * h)
        met = left[lo:] % h == 0
        if met.any():
            out[at[lo:][met]] = h
            stay = np.concatenate([np.ones(lo, bool), ~met])
            left, at = left[stay], at[stay]
    return out[back]


def spatial_size(flat: Column, channels: Column) -> Column:
    """struct(h, w) of a flattened layer: the first of the widths that divides the places of a channel,
    else the largest height up to their root that does."""
    n = (flat.cast("long") / channels).cast("long")
    wide = reduce(Column.__or__, [n % w == 0 for w in WIDTHS])

    @F.pandas_udf("long")
    def tallest(v: pd.Series) -> pd.Series:
        return pd.Series(heights(v.to_numpy(np.int64)))

    height = tallest(F.when(wide | n.isNull(), F.lit(0).cast("long")).otherwise(n))
    out = F.struct(height.alias("h"), F.floor(n / height).alias("w"))
    for w in reversed(WIDTHS):
        out = F.when((n % w == 0) & (n > 0), F.struct(F.floor(n / w).alias("h"), F.lit(w).cast("long").alias("w"))).otherwise(out)
    return out


def common_resolution(layers: DataFrame, layer: str, flat: str, channels: str) -> DataFrame:
    """The least height and the least width of each layer over games. Each number of places is sized
    once, however many rows and layers have it."""
    n = (F.col(flat).cast("long") / F.col(channels)).cast("long")
    each = layers.select(F.col(layer).alias("_layer"), n.alias("_n")).distinct()
    sizes = each.select(F.col("_n").alias("_m")).distinct().select("_m", spatial_size(F.col("_m"), F.lit(1)).alias("s"))
    met = each.join(sizes, F.col("_n").eqNullSafe(F.col("_m")))
    return met.groupBy(F.col("_layer").alias(layer)).agg(F.min("s.h").alias("h"), F.min("s.w").alias("w"))
