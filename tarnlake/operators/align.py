"""Time alignment: volumes, bins, nearest and containing matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def volume(onset: Column, tr: float, shift: int = 0) -> Column:
    """Volume of an onset, halves to the even one; shift 1 for series that lost their first row."""
    return F.rint(onset / tr).cast("long") - shift


def timed(frames: DataFrame, play: list[str], ts: str, start: str, tr: float, n_volumes: Column, shift: int = 0) -> DataFrame:
    """onset, volume, valid and local (volume since the play's first valid one; null without any)."""
    onset = F.col(ts) - F.col(start)
    rows = frames.withColumn("onset", onset).withColumn("volume", volume(F.col("onset"), tr, shift))
    rows = rows.withColumn("valid", (F.col("volume") >= 0) & (F.col("volume") < n_volumes))
    return rows.withColumn("local", F.col("volume") - F.min(F.when(F.col("valid"), F.col("volume"))).over(Window.partitionBy(*play)))


def bin_values(frames: DataFrame, play: list[str], bin_: str, order: list[str], value: str, how: str = "average") -> DataFrame:
    """One row per play and bin from 0 to the last used: value by mean or by the last frame, n
    frames; bins without frames have 0. Frames are aggregated before the bins are filled in."""
    if how not in ("average", "last"):
        raise ValueError(how)
    agg = F.avg(value) if how == "average" else F.max_by(value, F.struct(*order))
    got = frames.groupBy(*play, bin_).agg(agg.alias("v"), F.count("*").alias("n"))
    dense = got.groupBy(*play).agg(F.max(bin_).alias("_top")).select(*play, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))).alias(bin_))
    out = dense.join(got, [*play, bin_], "left")
    return out.select(*play, bin_, F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


def coverage(binned: DataFrame, play: list[str]) -> DataFrame:
    """Bins, empty bins, least, most and mean frames per bin of each play."""
    return binned.groupBy(*play).agg(
        F.count("*").alias("bins"), F.count_if(F.col("n") == 0).alias("empty"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean")
    )


def two_level_mean(calls: DataFrame, play: list[str], step: str, bin_: str, value: str) -> DataFrame:
    """Mean per timestep, then mean of the timesteps of a bin."""
    first = calls.groupBy(*play, bin_, step).agg(F.avg(value).alias("v"))
    return first.groupBy(*play, bin_).agg(F.avg("v").alias("value"), F.count("*").alias("steps"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], left_t: str, right_t: str, right_order: str, tolerance: float) -> DataFrame:
    """Each left row with the right row of its key that is nearest in time and nearer than
    `tolerance`; ties to the smaller right_order. Equal left rows each keep their match.

    Times fall into buckets as wide as the tolerance, so that a time only meets the rows of its own
    bucket and the two beside it: an equi join, never a product. The match hangs on key and time
    alone; it is found once for each and joined back to the left rows, whatever else they hold."""
    width = F.lit(tolerance)
    at = left.select(*key, left_t).distinct()
    l = at.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(left_t) / width) + k)))
    r = right.withColumn("_b", F.floor(F.col(right_t) / width))
    both = l.join(r, [*key, "_b"]).withColumn("gap", F.abs(F.col(left_t) - F.col(right_t))).where(F.col("gap") < tolerance)
    cols = [c for c in right.columns if c not in key]
    best = both.groupBy(*key, left_t).agg(F.min_by(F.struct(*cols, "gap"), F.struct("gap", right_order)).alias("_m"))
    return left.join(best.select(*key, left_t, "_m.*"), [*key, left_t])


def fill_both_ways(frames: DataFrame, play: list[str], order: list[str], col: str) -> DataFrame:
    """Last value carried forward, then the first value carried back to the play's start."""
    w = Window.partitionBy(*play).orderBy(*order)
    fwd = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(col, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return frames.withColumn(col, F.coalesce(fwd, back))


def contained(groups: DataFrame, spans: DataFrame, key: list[str], slop: float, width: float) -> DataFrame:
    """Groups with their interval [g_min, g_max] inside a span [s_min - slop, s_max + slop] of the
    same key, and how many spans hold each group (key, grp).

    A span lies in the buckets of time, `width` long, that it touches, a group in that of its start:
    groups meet the spans around them only. width should be about the length of a span."""
    at = lambda x: F.floor(x / F.lit(width))
    s = spans.withColumn("_b", F.explode(F.sequence(at(F.col("s_min") - slop), at(F.col("s_max") + slop))))
    both = groups.withColumn("_b", at(F.col("g_min"))).join(s, [*key, "_b"]).drop("_b")
    both = both.where((F.col("g_min") >= F.col("s_min") - slop) & (F.col("g_max") <= F.col("s_max") + slop))
    return both.withColumn("candidates", F.count("*").over(Window.partitionBy(*key, "grp")))


def step_value(points: DataFrame, grid: DataFrame, key: list[str], t: str, v: str, x: str) -> DataFrame:
    """The step function of the points on the grid: the last v at or before x, 0 before the first.
    grid has the key."""
    marks = points.select(*key, F.col(t).cast("double").alias("at"), F.col(v).cast("double").alias("v"), F.lit(0).alias("o")).unionByName(
        grid.select(*key, F.col(x).cast("double").alias("at"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("o"))
    )
    w = Window.partitionBy(*key).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("value", F.coalesce(F.last("v", ignorenulls=True).over(w), F.lit(0.0))).where("o = 1").select(*key, F.col("at").alias(x), "value")
