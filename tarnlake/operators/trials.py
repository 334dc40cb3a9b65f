"""Decisions of recorded plays, trials of sessions, and what objects and events of frames say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def ended_as(ended: Column, win: Column) -> dict[str, Column]:
    """won, lose, timeout of a frame: an end with a win, with a loss, with neither."""
    end = F.coalesce(ended, F.lit(False))
    return {"won": end & F.coalesce(win, F.lit(False)), "lose": end & F.coalesce(~win, F.lit(False)), "timeout": end & win.isNull()}


def decisions(frames: DataFrame, play: list[str], order: list[str], time: str, action: str) -> DataFrame:
    """A row per action that has a frame before it: step, frame (the one that was seen, so one before
    the action's), seen_at, score, reward and won, lose, timeout.

    frames: score, ended, win (null: neither). An end stands on the frame after the action that brought
    it, with its score if it has one; an end long after the last action falls to that action, without
    changing its score. One shuffle by play."""
    w = Window.partitionBy(*play).orderBy(*order)
    after = {c: F.lead(c).over(w) for c in ("ended", "win", "score")}
    f = frames.withColumns({"frame": F.row_number().over(w) - 2, "seen_at": F.lag(time).over(w), "_before": F.lag("score").over(w), **{f"_n_{c}": x for c, x in after.items()}})
    f = f.withColumns({f"_z_{c}": F.last(c).over(w.rowsBetween(*ALL)) for c in ("ended", "win")}).where(F.col(action).isNotNull() & (F.col("frame") >= 0))
    own, nxt, end = ended_as(F.col("ended"), F.col("win")), ended_as(F.col("_n_ended"), F.col("_n_win")), ended_as(F.col("_z_ended"), F.col("_z_win"))
    f = f.withColumn("_own", own["won"] | own["lose"] | own["timeout"])
    look = ~F.col("_own") & F.coalesce("_n_ended", F.lit(False))
    f = f.withColumn("score", F.when(look, F.coalesce("_n_score", "score")).otherwise(F.col("score")))
    f = f.withColumns({n: F.when(look, nxt[n]).otherwise(own[n]) for n in own}).withColumns({"step": F.row_number().over(w) - 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    late = F.col("_last") & ~(F.col("won") | F.col("lose") | F.col("timeout"))
    f = f.withColumns({n: F.when(late, end[n]).otherwise(F.col(n)) for n in own}).withColumn("reward", F.col("score") - F.col("_before"))
    return f.select(*play, "step", "frame", "seen_at", action, "score", "reward", "won", "lose", "timeout")


def trial_starts(steps: DataFrame, session: list[str], order: list[str], trial: list[str], action: str) -> DataFrame:
    """Steps that begin another trial than the real step before: with ended_as (won, died, timeout or
    null) and ended_score, the sum of the rewards of that step's run of one trial. Steps whose action
    begins with _ are synthetic, bear the new trial's marks already and count for nothing."""
    w = Window.partitionBy(*session).orderBy(*order)
    s = steps.where(~F.col(action).startswith("_")).withColumn("_t", F.struct(*trial))
    s = s.withColumns({"_p": F.lag("_t").over(w), "_r": F.lag(F.struct("won", "lose", "timeout")).over(w)}).withColumn("_new", F.col("_p").isNotNull() & ~F.col("_t").eqNullSafe(F.col("_p")))
    s = s.withColumn("_run", F.sum(F.col("_new").cast("long")).over(w)).withColumn("_sum", F.sum("reward").over(Window.partitionBy(*session, "_run").orderBy(*order)))
    how = F.when(F.col("_r.won"), "won").when(F.col("_r.lose"), "died").when(F.col("_r.timeout"), "timeout")
    return s.withColumns({"ended_as": how, "ended_score": F.lag("_sum").over(w)}).where("_new").drop("_t", "_p", "_r", "_new", "_run", "_sum")


def interaction_coverage(events: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """By key: seen, known and coverage of interactions (effect and two colours, in upper case; events
    with an unknown colour don't count). What is seen without being known is known from then on; a key
    that knows none covers 0."""
    what = [F.upper("colour").alias("colour"), "effect", F.upper("other").alias("other")]
    seen = events.where("colour is not null and other is not null").select(*key, *what, F.lit(1).alias("s"), F.lit(0).alias("k"))
    both = seen.unionByName(known.select(*key, *what, F.lit(0).alias("s"), F.lit(1).alias("k"))).groupBy(*key, "colour", "effect", "other").agg(F.max("s").alias("s"), F.max("k").alias("k"))
    n = both.groupBy(*key).agg(F.sum("s").alias("seen"), F.sum("k").alias("_k"), F.count("*").alias("_all"))
    total = F.when(F.col("_k") > 0, F.col("_all")).otherwise(0)
    return n.select(*key, "seen", total.cast("long").alias("known"), F.when(total > 0, F.col("seen") / total).otherwise(F.lit(0.0)).alias("coverage"))


def first_colours(objects: DataFrame, key: list[str], frame: list[str], place: str, kind: str, colour: str) -> DataFrame:
    """Colour of each kind: that of its first object in the first frame whose first one has any."""
    first = objects.groupBy(*key, *frame, kind).agg(F.min_by(F.struct(F.col(colour).alias("c")), F.struct(place)).alias("_o"))
    return first.where("_o.c is not null").groupBy(*key, kind).agg(F.min_by("_o.c", F.struct(*frame)).alias(colour))


def grid_sizes(objects: DataFrame, frame: list[str], x: str, y: str, block: int) -> DataFrame:
    """Columns and rows of the grid that holds all objects of a frame, one of each at least."""
    cells = lambda c: (F.greatest(F.lit(0), F.floor(F.max(c) / block)) + 1).cast("long")
    return objects.groupBy(*frame).agg(cells(x).alias("columns"), cells(y).alias("rows"))


def occupied(objects: DataFrame, frame: list[str], kind: str, x: str, y: str, block: int, columns: int, rows: int) -> DataFrame:
    """The cells (gx, gy) of a one-hot grid by kind that are 1; objects off the grid have none."""
    o = objects.select(*frame, kind, F.floor(F.col(x) / block).alias("gx"), F.floor(F.col(y) / block).alias("gy"))
    return o.where((F.col("gx") >= 0) & (F.col("gx") < columns) & (F.col("gy") >= 0) & (F.col("gy") < rows)).distinct()


def out_of_order(rows: DataFrame, series: list[str], order: list[str], outer: str, inner: str) -> DataFrame:
    """Rows with an outer number below the one before, or the same one and a lower inner one."""
    w = Window.partitionBy(*series).orderBy(*order)
    r = rows.withColumns({"_o": F.lag(outer).over(w), "_i": F.lag(inner).over(w)})
    return r.where((F.col(outer) < F.col("_o")) | ((F.col(outer) == F.col("_o")) & (F.col(inner) < F.col("_i")))).drop("_o", "_i")


def clock_drift(left: DataFrame, right: DataFrame, key: list[str], position: str, time: str, most_ms: float = 100.0) -> DataFrame:
    """By key: the largest distance of two clocks at equal positions in ms, and ok: as many times on
    both sides, none farther apart than most_ms."""
    both = left.select(*key, position, F.col(time).alias("_a")).join(right.select(*key, position, F.col(time).alias("_b")), [*key, position], "full")
    far = F.max(F.abs(F.col("_a") - F.col("_b")) * 1000)
    return both.groupBy(*key).agg(far.alias("drift_ms"), ((F.count("_a") == F.count("*")) & (F.count("_b") == F.count("*")) & F.coalesce(far <= most_ms, F.lit(False))).alias("ok"))


def policy_summary(states: DataFrame, play: list[str], value: str, policy: str) -> DataFrame:
    """By play: states, mean and deviation (ddof 0) of the value, mean entropy of the policies."""
    entropy = -F.aggregate(policy, F.lit(0.0), lambda a, p: a + p * F.log(F.greatest(p, F.lit(1e-12))))
    return states.groupBy(*play).agg(F.count("*").alias("n_states"), F.avg(value).alias("mean_value"), F.stddev_pop(value).alias("std_value"), F.avg(entropy).alias("mean_entropy"))


def session_totals(steps: DataFrame, session: list[str], sums: list[str]) -> DataFrame:
    """What a resumed session starts with: sums (nulls are 0), steps, wins and losses so far."""
    return steps.groupBy(*session).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums], F.count("*").alias("n_steps"), F.count_if("won").alias("wins"), F.count_if("lose").alias("losses"))


def broken_continuations(runs: DataFrame) -> DataFrame:
    """Resumed runs without their whole history: resumed_from isn't within n_actions, total_steps
    isn't n_actions, or the first state isn't attempt 0 at time 0; must be empty. runs: resumed."""
    good = F.col("resumed_from").between(0, F.col("n_actions")) & (F.col("total_steps") == F.col("n_actions")) & (F.col("first_attempt") == 0) & (F.col("first_time") == 0)
    return runs.where(F.col("resumed") & ~F.coalesce(good, F.lit(False)))
