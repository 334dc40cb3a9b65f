"""Model features met with recorded plays: references, times, zero rows, samples and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators.align import contained
from tarnlake.operators.windows import offsets


def zero_filled(plays: DataFrame, features: DataFrame, key: list[str], vector: str, width: int) -> DataFrame:
    """Every play with its feature vector, `width` zeros where it has none, and observed."""
    both = plays.join(features.select(*key, vector, F.lit(True).alias("observed")), key, "left")
    zeros = F.array_repeat(F.lit(0.0), width).cast(features.schema[vector].dataType)
    return both.withColumns({vector: F.coalesce(vector, zeros), "observed": F.coalesce("observed", F.lit(False))})


def not_in_source(rows: DataFrame, source: DataFrame, key: list[str], time: str) -> DataFrame:
    """Rows whose time isn't, as the very double, one of the source's for the key; must be empty."""
    return rows.join(source.select(*key, time), [*key, time], "left_anti")


def gathered(rows: DataFrame, frames: DataFrame, key: list[str], index: str, position: str, cols: list[str]) -> DataFrame:
    """Rows with the columns of the frame at their index; an index out of range drops the row."""
    at = frames.select(*key, F.col(position).alias(index), *cols)
    return rows.join(at, [*key, index])


def paired(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The i-th left row of a key with the i-th right one; what is over on either side goes."""
    at = lambda df, order: df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return at(left, left_order).join(at(right, right_order), [*key, "_i"]).withColumn("place", F.col("_i") - 1).drop("_i")


def agreement(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Share of equal values at equal places, up to the shorter of two sequences; keys without any
    common place have none."""
    other = right.select(*key, *order, F.col(value).alias("_other")).withColumnsRenamed({o: f"_o_{o}" for o in order})
    both = paired(left, other, key, order, [f"_o_{o}" for o in order])
    return both.groupBy(*key).agg(F.avg(F.col(value).eqNullSafe(F.col("_other")).cast("double")).alias("agreement"), F.count("*").alias("n"))


def stepped(steps: DataFrame, states: DataFrame, run: list[str], order: str, index: str, position: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Steps with the state they refer to, and the steps that break the rules: no such state, another
    value in one of the `same` columns, or an index below the step's before."""
    s = states.select(*run, F.col(position).alias(index), *[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("_found"))
    w = Window.partitionBy(*run).orderBy(order)
    both = steps.withColumn("_before", F.max(index).over(w.rowsBetween(Window.unboundedPreceding, -1))).join(s, [*run, index], "left")
    bad = F.col("_found").isNull() | F.coalesce(F.col(index) < F.col("_before"), F.lit(False))
    for c in same:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    drop = ["_before", "_found", *[f"_{c}" for c in same]]
    return both.where(~bad).drop(*drop), both.where(bad).drop(*drop)


def resolve(features: DataFrame, plays: DataFrame, frames: DataFrame, slop: float, width: float) -> tuple[DataFrame, DataFrame]:
    """Feature groups with their play: (grp, play, how), and (grp, error) of those that can't be told.

    features: scope, grp, ts and, where known, play, frame, document and composite (sub-SS_RUN_DOC).
    plays: scope, play, subject, run, document. frames: scope, play, frame, ts. A group with references
    on any row needs them on all, one play, its document, and the very times of the frames it names,
    each once. A composite name must be one play with all its times. A group with neither falls to
    the one play whose time span, `slop` wider on both ends, holds it; none: the group is left out.
    Two groups of one play are an error. scope is what a group can't leave (subject, game, level);
    width is about the length of a play, see contained()."""
    any_ref = F.col("play").isNotNull() | F.col("frame").isNotNull() | F.col("document").isNotNull()
    all_ref = F.col("play").isNotNull() & F.col("frame").isNotNull() & F.col("document").isNotNull()
    part = lambda i: F.regexp_extract("composite", r"^sub-(\d{2})_(\d+)_(\d+)$", i)
    groups = features.groupBy("scope", "grp").agg(
        F.count("*").alias("n"), F.count_if(any_ref).alias("n_any"), F.count_if(all_ref).alias("n_all"), F.min("play").alias("linked"), F.max("play").alias("_last"), F.min("document").alias("doc"),
        F.max("document").alias("_doc"), F.countDistinct("frame").alias("n_frames"), F.min("ts").alias("g_min"), F.max("ts").alias("g_max"), F.max("composite").alias("composite"), F.count_if(F.isnan("ts") | (F.abs("ts") == float("inf"))).alias("n_bad"),
    )
    groups = groups.withColumns({"subject": F.when(part(1) != "", part(1).cast("long")), "run": F.when(part(1) != "", part(2).cast("long")), "docu": F.when(part(1) != "", part(3).cast("long"))})
    named = groups.where("subject is not null").join(plays.select("scope", "subject", "run", F.col("document").alias("docu"), F.col("play").alias("_p")), ["scope", "subject", "run", "docu"], "left")
    named = named.groupBy("scope", "grp").agg(F.count("_p").alias("n_named"), F.min("_p").alias("by_name"))
    times = frames.select("scope", "play", "ts").distinct()
    rows = features.join(named, ["scope", "grp"])
    unclocked = rows.join(times.withColumnRenamed("play", "by_name"), ["scope", "by_name", "ts"], "left_anti").select("scope", "grp").distinct().withColumn("clock", F.lit(True))
    off = features.where(all_ref).join(frames.select("scope", "play", "frame", F.col("ts").alias("_ts")), ["scope", "play", "frame"], "left")
    off = off.where(F.col("_ts").isNull() | (F.col("_ts") != F.col("ts"))).select("scope", "grp").distinct().withColumn("off", F.lit(True))
    known = plays.select("scope", F.col("play").alias("linked"), F.col("document").alias("_ordinal"), F.lit(True).alias("known"))
    g = groups.join(named, ["scope", "grp"], "left").join(unclocked, ["scope", "grp"], "left").join(off, ["scope", "grp"], "left").join(known, ["scope", "linked"], "left")
    has, comp = F.col("n_any") > 0, F.col("subject").isNotNull()
    error = (
        F.when(F.col("n_bad") > 0, "times are not finite").when(comp & (F.col("n_named") != 1), "composite is not one play").when(comp & F.col("clock").isNotNull(), "times are not the composite play's")
        .when(has & (F.col("n_all") < F.col("n")), "references on some rows only").when(has & (F.col("linked") != F.col("_last")), "more than one play").when(has & comp & (F.col("linked") != F.col("by_name")), "reference and composite differ")
        .when(has & F.col("known").isNull(), "no such play").when(has & ((F.col("doc") != F.col("_ordinal")) | (F.col("_doc") != F.col("_ordinal"))), "another document").when(has & (F.col("n_frames") < F.col("n")), "a frame twice").when(has & F.col("off").isNotNull(), "times are not the frames'")
    )
    g = g.withColumn("error", error)
    sure = g.where("error is null").select("scope", "grp", F.when(has, F.col("linked")).otherwise(F.col("by_name")).alias("play"), F.when(has, "reference").when(comp, "composite").alias("how"), "g_min", "g_max")
    spans = frames.groupBy("scope", "play").agg(F.min("ts").alias("s_min"), F.max("ts").alias("s_max"))
    by_time = contained(sure.where("how is null").select("scope", "grp", "g_min", "g_max"), spans, ["scope"], slop, width)
    found = sure.where("how is not null").select("scope", "grp", "play", "how").unionByName(by_time.where("candidates = 1").select("scope", "grp", "play", F.lit("time").alias("how")))
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy("scope", "play")))
    errors = [g.where("error is not null").select("grp", "error"), by_time.where("candidates > 1").select("grp", F.lit("more than one play in time").alias("error")).distinct(), found.where("_n > 1").select("grp", F.lit("another group has the play").alias("error"))]
    return found.where("_n = 1").select("grp", "play", "how"), reduce(DataFrame.unionByName, errors)


def bin_vectors(frames: DataFrame, play: list[str], bin_: str, vector: str, unit: bool = False) -> DataFrame:
    """Element-wise mean of the vectors of a play's bins; with `unit` scaled to length 1, zeros stay."""
    each = frames.select(*play, bin_, F.posexplode(vector).alias("_i", "_x")).groupBy(*play, bin_, "_i").agg(F.avg("_x").alias("_m"))
    out = each.groupBy(*play, bin_).agg(F.array_sort(F.collect_list(F.struct("_i", "_m")))["_m"].alias(vector))
    if not unit:
        return out
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("_n", norm).withColumn(vector, F.transform(vector, lambda x: x / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n")))).drop("_n")


def aligned_matrix(plays: DataFrame, calls: DataFrame, key: list[str], order: list[str], width: int, carry: bool = False) -> DataFrame:
    """One matrix over all plays: key, bin, position (the row's place in the whole), vector and observed.

    plays: key, order, n_steps and per_bin; calls: key, step, vector, any number for a step. A step's
    vector is the mean of its calls, zeros where it has none; a bin's that of its steps, zeros counted.
    With carry the steps without a call count nothing: a bin is the mean of those it has, and one that
    has none takes the play's last before it (zeros before the first). Plays follow in `order`, each with
    all its bins, so that positions have no gaps; calls of other plays or steps are left out."""
    p = offsets(plays.withColumn("_bins", F.ceil(F.col("n_steps") / F.col("per_bin"))), order, "_bins", "_start")
    bounds = p.select(*key, "n_steps", "per_bin", "_bins", "_start")
    c = calls.select(*key, "step", F.posexplode("vector").alias("_i", "_x")).groupBy(*key, "step", "_i").agg(F.avg("_x").alias("_x"))
    c = c.join(bounds.select(*key, "n_steps", "per_bin"), key).where((F.col("step") >= 0) & (F.col("step") < F.col("n_steps")))
    bin_ = F.floor(F.col("step") / F.col("per_bin")).alias("bin")
    sums = c.groupBy(*key, bin_, "_i").agg(F.sum("_x").alias("_s"), F.countDistinct("step").alias("_n"), F.max("n_steps").alias("n_steps"), F.max("per_bin").alias("per_bin"))
    steps = F.least(F.col("per_bin"), F.col("n_steps") - F.col("bin") * F.col("per_bin"))
    mean = F.col("_s") / (F.col("_n") if carry else steps)
    found = sums.groupBy(*key, "bin").agg(F.array_sort(F.collect_list(F.struct("_i", mean.alias("m")))).alias("_e")).select(*key, "bin", F.col("_e.m").alias("_v"))
    dense = bounds.where("_bins > 0").select(*key, "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)).alias("bin"))
    rows = dense.join(found, [*key, "bin"], "left").withColumn("observed", F.col("_v").isNotNull())
    if carry:
        w = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    zeros = F.array_repeat(F.lit(0.0), width)
    return rows.select(*key, "bin", (F.col("_start") + F.col("bin")).alias("position"), F.coalesce("_v", zeros).alias("vector"), "observed")


def pressed_bins(frames: DataFrame, play: list[str], bin_: str, keys: list[str]) -> DataFrame:
    """Mean of each key (0 or 1) by bin, and any_pressed where more than half the frames have one."""
    some = F.greatest(*[F.col(k).cast("double") for k in keys]) if len(keys) > 1 else F.col(keys[0]).cast("double")
    return frames.groupBy(*play, bin_).agg(*[F.avg(k).alias(k) for k in keys], (F.avg(some) > 0.5).alias("any_pressed"))


def standardised(rows: DataFrame, series: list[str], col: str) -> DataFrame:
    """z by the series' own mean and deviation (ddof 0); without spread by 1."""
    w = Window.partitionBy(*series)
    sd = F.stddev_pop(col).over(w)
    return rows.withColumn("z", (F.col(col) - F.avg(col).over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def up_to_level(samples: DataFrame, subject: list[str], play: str, level: str, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Samples of levels up to `most` with their plays numbered anew from 0 (play_idx), and a row per
    play that is left: play_idx, n_volumes, start and stop in the subject's samples."""
    keep = samples.where(F.col(level) <= most)
    plays = keep.groupBy(*subject, play).agg(F.count("*").alias("n_volumes"))
    w = Window.partitionBy(*subject).orderBy(play)
    stop = F.sum("n_volumes").over(w)
    plays = plays.select(*subject, play, (F.row_number().over(w) - 1).alias("play_idx"), "n_volumes", (stop - F.col("n_volumes")).alias("start"), stop.alias("stop"))
    return keep.join(plays.select(*subject, play, "play_idx"), [*subject, play]), plays


def fold_summary(scores: DataFrame, model: list[str], target: str, value: str) -> DataFrame:
    """Scores of targets (mean over folds) by model: mean, max, and how many are above 0, 0.05, 0.1."""
    per = scores.groupBy(*model, target).agg(F.avg(value).alias("_v"))
    above = [F.count_if(F.col("_v") > x).alias(n) for n, x in (("positive", 0.0), ("above_05", 0.05), ("above_10", 0.1))]
    return per.groupBy(*model).agg(F.avg("_v").alias("mean"), F.max("_v").alias("max"), F.count("*").alias("targets"), *above)


def bands(parts: dict[str, list[str]], arrays: list[str]) -> Column:
    """A design row: one array per band from its columns, which are numbers or, if named in `arrays`,
    arrays of numbers."""
    one = lambda c: F.col(c).cast("array<double>") if c in arrays else F.array(F.col(c).cast("double"))
    return F.struct(*[F.concat(*[one(c) for c in cols]).alias(name) for name, cols in parts.items()])


def components_for(n_train: int, n_features: int, lags: int = 4) -> int | None:
    """Principal components before lagging: none if `lags` times the features are at most the training
    rows, else as many as 95 % of these leave to each lag, at most n - 1 and at least 1."""
    if n_features * lags <= n_train:
        return None
    return max(1, min(int(0.95 * n_train) // lags, n_features, n_train - 1))


def clipped(vector: Column, most: float = 10.0) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def sample_errors(samples: DataFrame, plays: DataFrame, subject: list[str]) -> DataFrame:
    """(subject, error) of samples (row, play_idx, level, game) that their plays (play_idx, play,
    start, stop, n_volumes, level, game) don't partition; must be empty."""
    w = Window.partitionBy(*subject).orderBy("play_idx")
    p = plays.withColumns({"_want": F.coalesce(F.lag("stop").over(w), F.lit(0)), "_i": F.row_number().over(w) - 1, "_ids": F.count("*").over(Window.partitionBy(*subject, "play"))})
    ends = plays.groupBy(*subject).agg(F.max("stop").alias("_stop")).join(samples.groupBy(*subject).agg(F.count("*").alias("_n")), subject, "full")
    at = samples.join(plays.select(*subject, "play_idx", "start", "stop", F.col("level").alias("_level"), F.col("game").alias("_game")), [*subject, "play_idx"], "left")
    rules = [
        (p.where((F.col("start") != F.col("_want")) | (F.col("stop") <= F.col("start"))), "plays do not partition the rows"), (p.where(F.col("_i") != F.col("play_idx")), "play numbers have gaps"), (p.where("_ids > 1"), "a play twice"),
        (p.where("stop - start <> n_volumes"), "lengths disagree"), (ends.where("not (_stop <=> _n)"), "plays do not cover the rows"), (at.where("start is null or row < start or row >= stop"), "a row of another play"),
        (at.where("not (level <=> _level and game <=> _game)"), "level or game disagrees"),
    ]
    return reduce(DataFrame.unionByName, [rows.select(*subject, F.lit(what).alias("error")).distinct() for rows, what in rules])


def unbound(features: DataFrame, digests: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Features whose recorded digests aren't those of the inputs they name, or that name none; must
    be empty before they are used."""
    d = digests.select(*key, *[F.col(n).alias(f"_{n}") for n in names])
    same = reduce(lambda a, b: a & b, [F.coalesce(F.col(n) == F.col(f"_{n}"), F.lit(False)) for n in names])
    return features.join(d, key, "left").where(~same).select(*features.columns)


def coverage(expected: DataFrame, present: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """By group: plays and samples that are expected (start, stop), and how many are missing."""
    both = expected.join(present.select(*key).distinct().withColumn("_here", F.lit(True)), key, "left")
    size, gone = F.col("stop") - F.col("start"), F.col("_here").isNull()
    return both.groupBy(*by).agg(F.count("*").alias("plays"), F.count_if(gone).alias("missing_plays"), F.sum(size).alias("samples"), F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("missing_samples"))


def bad_intervals(intervals: DataFrame, key: list[str], n: str) -> DataFrame:
    """Intervals [start, stop) that are empty, leave [0, n) or begin before the one before ends."""
    w = Window.partitionBy(*key).orderBy("start", "stop")
    return intervals.withColumn("_b", F.lag("stop").over(w)).where((F.col("start") < 0) | (F.col("stop") <= F.col("start")) | (F.col("stop") > F.col(n)) | F.coalesce(F.col("start") < F.col("_b"), F.lit(False))).drop("_b")


def trace_errors(trace: DataFrame, frames: DataFrame, play: list[str], step: str, gaps: DataFrame) -> DataFrame:
    """(play, step, error) of traces against the frames of their plays: a step twice, a step that is no
    frame, a frame that is neither traced nor in gaps (play, step)."""
    twice = trace.groupBy(*play, step).count().where("count > 1").select(*play, step, F.lit("twice").alias("error"))
    extra = trace.select(*play, step).distinct().join(frames, [*play, step], "left_anti").select(*play, step, F.lit("no such frame").alias("error"))
    short = frames.select(*play, step).join(trace, [*play, step], "left_anti").join(gaps, [*play, step], "left_anti").select(*play, step, F.lit("missing").alias("error"))
    return twice.unionByName(extra).unionByName(short)


def length_errors(kept: DataFrame, timing: DataFrame, key: list[str], n: str, want: str) -> DataFrame:
    """Plays whose kept rows aren't as many as the recorded timing says; also those on one side only."""
    both = kept.select(*key, n).join(timing.select(*key, want), key, "full")
    return both.where(~F.col(n).eqNullSafe(F.col(want)))
