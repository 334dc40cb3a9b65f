"""Survival of levels: discovery times, blocked censoring, distribution curves, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.episodes import discovery_steps, first_win, longest_streak, steps_to_streak


def survival_table(
    episodes: DataFrame, agent: list[str], levels: int = 9, streak: int = 2, censor_after_failure: bool = True, warmup: Column | None = None
) -> DataFrame:
    """One row per agent and level below `levels`: time and observed.

    A level that was won is observed at the steps up to its first win. A censored level has the
    agent's realised steps over all levels (1 at least). With censor_after_failure the first level
    that isn't played, or hasn't `streak` wins in a row, censors all levels after it; without it a
    level that was played and not won has its own steps. Where `warmup` holds, levels from `levels`
    on are a warm-up: their steps count as realised and are added to the time of the agent's first
    level. Null agents are dropped."""
    known = episodes.where(" and ".join(f"{c} is not null" for c in agent))
    total = F.aggregate("episode_steps", F.lit(0).cast("long"), lambda a, x: a + x)
    in_game = F.col("level") < levels
    extra = F.when(~in_game & (F.lit(False) if warmup is None else warmup), total).otherwise(0)
    p = known.select(
        *agent, "level", in_game.alias("_game"), (longest_streak() >= streak).alias("_mastered"), (first_win() > 0).alias("_won"),
        discovery_steps().alias("_own"), total.alias("_all"), extra.alias("_extra"),
    )
    realised = F.sum(F.when(F.col("_game"), F.col("_all")).otherwise(F.col("_extra")))
    agents = p.groupBy(*agent).agg(F.greatest(realised, F.lit(1)).alias("_limit"), F.sum("_extra").alias("_over"), F.min(F.when(F.col("_game"), F.col("level"))).alias("_first"))
    grid = agents.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    full = grid.join(p.where("_game").drop("_game", "_extra"), [*agent, "level"], "left")
    before = Window.partitionBy(*agent).orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max((~F.coalesce("_mastered", F.lit(False))).cast("int")).over(before), F.lit(0)) == 1
    won = F.coalesce("_won", F.lit(False))
    full = full.withColumn("observed", won & ~blocked if censor_after_failure else won)
    over = F.when(F.col("level") == F.col("_first"), F.col("_over")).otherwise(0)
    censored = F.col("_limit") if censor_after_failure else F.coalesce(F.col("_all") + over, "_limit")
    return full.select(*agent, "level", F.when(F.col("observed"), F.col("_own") + over).otherwise(censored).alias("time"), "observed")


def cap_censored(rows: DataFrame, group: list[str]) -> DataFrame:
    """Censored times up to the group's last event become that + 1; later ones, and groups without
    events, stay."""
    last = rows.groupBy(*group).agg(F.max(F.when(F.col("observed"), F.col("time"))).alias("_last"))
    time = F.when(~F.col("observed") & (F.col("time") <= F.col("_last")), F.col("_last") + 1).otherwise(F.col("time"))
    return rows.join(last, group).withColumn("time", time).drop("_last")


def log_grid(spark, n: int, top: float) -> DataFrame:
    """point and x: n values from 1 to 10**top, evenly spaced in their logarithm."""
    return spark.range(n).select(F.col("id").alias("point"), F.pow(F.lit(10.0), F.col("id") * F.lit(top / (n - 1))).alias("x"))


def event_curve(rows: DataFrame, group: list[str], grid: DataFrame) -> DataFrame:
    """Share of a group's rows whose event is at or before each grid point.

    After cap_censored nobody leaves the risk set before the last event, so that the product-limit
    estimate is just that share. Events are counted per distinct time first; the grid is a handful
    of points, and each event row meets it once."""
    n = rows.groupBy(*group).agg(F.count("*").alias("n"))
    events = rows.where("observed").groupBy(*group, "time").agg(F.count("*").alias("d"))
    one = grid.agg(F.collect_list(F.struct("point", "x")).alias("_g"))  # the grid is a constant of few points
    points = n.join(F.broadcast(one)).select(*group, "n", F.inline("_g"))
    marks = points.select(*group, "n", F.col("x").alias("at"), "point", F.lit(0).cast("long").alias("d"), F.lit(1).alias("o")).unionByName(
        events.select(*group, F.lit(None).cast("long").alias("n"), F.col("time").cast("double").alias("at"), F.lit(None).cast("long").alias("point"), "d", F.lit(0).alias("o"))
    )
    w = Window.partitionBy(*group).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = marks.withColumn("done", F.sum("d").over(w)).where("point is not null")
    return out.select(*group, "point", F.col("at").alias("x"), (F.col("done") / F.col("n")).alias("share"))


def gaussian_density(values: DataFrame, group: list[str], grid: DataFrame, width: float = 0.3) -> DataFrame:
    """Kernel density of log10(value) on the grid's log10(x), both at least 1; fewer than two values
    or no spread (deviation with ddof 0): 0. Equal values are one row with their number before they
    meet the grid, which is a constant of few points."""
    v = values.where("value is not null").select(*group, F.log10(F.greatest(F.col("value").cast("double"), F.lit(1.0))).alias("v"))
    stats = v.groupBy(*group).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("sd"))
    z = (F.log10(F.greatest(F.col("x"), F.lit(1.0))) - F.col("v")) / width
    counted = v.groupBy(*group, "v").agg(F.count("*").alias("m"))
    points = grid.agg(F.collect_list(F.struct("point", "x")).alias("_g"))
    dens = counted.join(F.broadcast(points)).select(*group, "v", "m", F.inline("_g")).groupBy(*group, "point").agg(F.sum(F.col("m") * F.exp(-0.5 * z * z)).alias("k"))
    ok = (F.col("n") >= 2) & (F.col("sd") >= 1e-10)
    return dens.join(stats, group).select(*group, "point", F.when(ok, F.col("k") / (F.col("n") * width * F.sqrt(F.lit(2 * 3.141592653589793)))).otherwise(0.0).alias("density"))


def earth_mover(values: DataFrame, group: list[str], side: str) -> DataFrame:
    """Wasserstein-1 distance of log1p(value) between the rows where side is true and false; null
    if either has fewer than two."""
    v = values.select(*group, F.log1p("value").alias("v"), F.col(side).cast("int").alias("s"))
    n = v.groupBy(*group).agg(F.sum("s").alias("n1"), F.sum(1 - F.col("s")).alias("n0"))
    c = v.groupBy(*group, "v").agg(F.sum("s").alias("c1"), F.sum(1 - F.col("s")).alias("c0"))
    w = Window.partitionBy(*group).orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = c.withColumns({"f1": F.sum("c1").over(run), "f0": F.sum("c0").over(run), "dx": F.lead("v").over(w) - F.col("v")}).join(n, group)
    area = F.sum(F.abs(F.col("f1") / F.col("n1") - F.col("f0") / F.col("n0")) * F.coalesce("dx", F.lit(0.0)))
    return steps.where("n1 >= 2 and n0 >= 2").groupBy(*group).agg(area.alias("distance"))


def mean_sem(rows: DataFrame, group: list[str], value: str | Column) -> DataFrame:
    """mean, sem (ddof 1; null for one row) and n."""
    v = F.col(value) if isinstance(value, str) else value
    return rows.groupBy(*group).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))


def staircase(episodes: DataFrame, agent: list[str], levels: int = 9, streak: int = 2) -> DataFrame:
    """(agent, point, steps, level) of the way up: (0, 0), then for each level in turn the steps so
    far when `streak` wins in a row complete it, with the level that follows; what an agent does at
    a level after that isn't counted. The first level that isn't completed ends the way with all
    its steps and its own number; a level that isn't played ends it without a point."""
    s = steps_to_streak(streak)
    rows = episodes.where(F.col("level").between(0, levels - 1)).select(*agent, "level", s["taken"].alias("_t"), s["done"].alias("_d"))
    w = Window.partitionBy(*agent).orderBy("level")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.min(F.col("_d").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    rows = rows.withColumn("_open", (before == 1) & (F.col("level") == F.row_number().over(w) - 1)).withColumn("steps", F.sum("_t").over(run))
    way = rows.where("_open").select(*agent, (F.col("level") + 1).cast("int").alias("point"), "steps", (F.col("level") + F.col("_d").cast("int")).cast("int").alias("level"))
    start = episodes.select(*agent).distinct().select(*agent, F.lit(0).alias("point"), F.lit(0).cast("long").alias("steps"), F.lit(0).alias("level"))
    return start.unionByName(way)
