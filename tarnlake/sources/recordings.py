"""Scans of recordings and archived runs into plays, runs and episode rows, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core import checks
from tarnlake.core.shared import materialize
from tarnlake.functions.text import game_identity
from tarnlake.operators.episodes import sessions, with_previous
from tarnlake.sources import io

#: The columns of an episode row, whoever the agent is.
EPISODE_ROW = (
    "agent_type string, model string, rationale_mode string, suggestion_level string, instance_id string, seed string, game string, cohort string, level int, owner string, "
    "episode_steps array<bigint>, episode_frames array<bigint>, episode_outcomes array<string>, step_unit string, data_source array<string>"
)
LEVELS = 9


def plays_in_order(records: DataFrame, subject: int | None = None, run: int | None = None) -> DataFrame:
    """Plays of recordings with their place in the participant's order (run, then the run's original
    ordinal), optionally of one subject or run. A play's id or its (subject, run, ordinal) that occurs
    twice raises, also where they come from different files."""
    if run is not None and run < 0:
        raise ValueError(f"run: {run}")
    p = records.select(F.explode("plays").alias("p")).select("p.*")
    for col, value in (("subj_id", subject), ("run_id", run)):
        p = p if value is None else p.where(F.col(col) == value)
    checks.require_empty(checks.duplicate_keys(p, ["_id"]), "a play once")
    checks.require_empty(checks.duplicate_keys(p, ["subj_id", "run_id", "source_document_index"]), "a run's ordinal once")
    w = Window.partitionBy("subj_id").orderBy("run_id", "source_document_index")
    return p.withColumn("place", F.row_number().over(w) - 1)


def scanner_runs(records: DataFrame) -> DataFrame:
    """subj_id, run_id and scan_start_ts of each run from the scanner records in its plays. A play
    without one, with one of another run or without a finite clock raises, as do two that differ."""
    p = records.select(F.explode("plays").alias("p")).select("p._id", "p.subj_id", "p.run_id", "p.scanner")
    s = F.col("scanner")
    finite = s["scan_start_ts"].isNotNull() & ~F.isnan(s["scan_start_ts"]) & (F.abs(s["scan_start_ts"]) != float("inf"))
    checks.require_empty(p.where(s.isNull() | ~finite), "a scanner clock")
    checks.require_empty(p.where(~(s["subj_id"].eqNullSafe(F.col("subj_id")) & s["run_id"].eqNullSafe(F.col("run_id")))), "the play's own run")
    runs = p.select("subj_id", "run_id", s["scan_start_ts"].alias("scan_start_ts")).distinct()
    checks.require_empty(checks.duplicate_keys(runs, ["subj_id", "run_id"]), "one scanner record")
    return runs


def outcome_of(win: Column, name: str) -> Column:
    """win (1) or loss (0); anything else fails the job."""
    return F.when(win == 1, "win").when(win == 0, "loss").otherwise(F.raise_error(F.concat(F.lit(f"{name}: win is neither 0 nor 1: "), F.coalesce(win.cast("string"), F.lit("null")))))


def count_of(steps: Column, name: str) -> Column:
    """A whole number of steps, 0 at least; anything else fails the job."""
    ok = steps.isNotNull() & (steps >= 0) & (steps == F.floor(steps))
    return F.when(ok, steps.cast("long")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: no step count: "), F.coalesce(steps.cast("string"), F.lit("null")))))


def baseline_rows(episodes: DataFrame, kind: str, model: str, cohorts: tuple[str, ...]) -> DataFrame:
    """Episodes (game_raw, run_id, seed, level, index, steps, outcome, source) to one row per run, game
    and level below 9, in the order of index. Frames of such runs aren't known."""
    game, cohort = game_identity(F.col("game_raw"), cohorts)
    e = episodes.where(F.col("level").between(0, LEVELS - 1))
    entry = F.array_sort(F.collect_list(F.struct("index", "steps", "outcome")))
    g = e.groupBy("game_raw", "run_id", "level", "seed", "source").agg(entry.alias("e"))
    none = F.lit("none")
    return g.select(
        F.lit(kind).alias("agent_type"), F.lit(model).alias("model"), none.alias("rationale_mode"), none.alias("suggestion_level"), F.col("run_id").alias("instance_id"), F.coalesce("seed", none).alias("seed"), game.alias("game"), cohort.alias("cohort"),
        F.col("level").cast("int").alias("level"), F.lit("baseline").alias("owner"), F.col("e.steps").alias("episode_steps"), F.transform("e", lambda x: F.lit(None).cast("long")).alias("episode_frames"), F.col("e.outcome").alias("episode_outcomes"),
        F.lit("agent_step").alias("step_unit"), F.array("source").alias("data_source"),
    )


def csv_episodes(spark: SparkSession, root: str, cohorts: tuple[str, ...], kind: str = "ez", model: str = "EfficientZero") -> DataFrame:
    """ROOT/GAME/*.csv with episode_index, resolved_level, episode_len and win. Two files of a game, or
    an index twice in a file, raise."""
    schema = T.StructType().add("episode_index", "integer").add("resolved_level", "integer").add("episode_len", "double").add("win", "integer")
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(f"{root.rstrip('/')}/*/*episodes.csv")
    raw = materialize(raw.select("*", F.col("_metadata.file_path").alias("path")).withColumn("game_raw", F.element_at(F.split("path", "/"), -2)))  # many small files are opened once
    game, cohort = game_identity(F.col("game_raw"), cohorts)
    files = raw.select(game.alias("game"), cohort.alias("cohort"), "path").distinct()
    checks.require_empty(checks.duplicate_keys(files, ["game", "cohort"]), "a game once")
    checks.require_empty(checks.duplicate_keys(raw, ["path", "episode_index"]), "an episode once")
    e = raw.select(
        "game_raw", F.lit("run0").alias("run_id"), F.lit(None).cast("string").alias("seed"), F.col("resolved_level").alias("level"), F.col("episode_index").alias("index"), count_of(F.col("episode_len"), model).alias("steps"),
        outcome_of(F.col("win"), model).alias("outcome"), F.concat_ws("/", "game_raw", F.element_at(F.split("path", "/"), -1)).alias("source"),
    )
    return baseline_rows(e, kind, model, cohorts)


RUNS = T.StructType().add("run_id", "string").add("game_raw", "string").add("seed", "string").add("episodes", T.ArrayType(T.StructType().add("level", "integer").add("steps", "double").add("win", "integer")))


def json_runs(spark: SparkSession, path: str, cohorts: tuple[str, ...], kind: str = "ddqn", model: str = "DDQN") -> DataFrame:
    """A JSON list of runs with their episodes in order. A (run_id, game_raw) that occurs twice raises."""
    runs = spark.read.schema(RUNS).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"))
    runs = materialize(runs)
    checks.require_empty(checks.duplicate_keys(runs, ["run_id", "game_raw"]), "a run once")
    e = runs.select("run_id", "game_raw", "seed", "source", F.posexplode("episodes").alias("index", "e"))
    e = e.select("run_id", "game_raw", "seed", "source", "index", "e.level", count_of(F.col("e.steps"), model).alias("steps"), outcome_of(F.col("e.win"), model).alias("outcome"))
    return baseline_rows(e, kind, model, cohorts)


TRIALS = T.StructType().add("level", "integer").add("episode_summaries", T.ArrayType(T.StructType().add("steps", "double").add("outcome", "string")))


def trial_files(spark: SparkSession, root: str, cohorts: tuple[str, ...], kind: str = "empa", model: str = "EMPA") -> DataFrame:
    """ROOT/GAME/trial-NN/level-NN.json, or lvl_N.json of an older form whose levels count from 1."""
    raw = spark.read.schema(TRIALS).option("multiLine", True).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/*/*/*.json").select("*", F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    new, old = F.regexp_extract("path", r"/level-(\d+)\.json$", 1), F.regexp_extract("path", r"/lvl_(\d+)\.json$", 1)
    level = F.when(new != "", new.cast("int")).when(old != "", old.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("no level in "), F.col("path"))))
    e = raw.select(F.element_at(parts, -3).alias("game_raw"), F.element_at(parts, -2).alias("run_id"), level.alias("at"), F.concat_ws("/", F.slice(parts, -3, 3)).alias("source"), F.posexplode("episode_summaries").alias("index", "e"))
    outcome = F.when(F.trim("e.outcome") != "", F.col("e.outcome")).otherwise(F.raise_error(F.lit("an outcome is missing")))
    return baseline_rows(e.select("game_raw", "run_id", F.lit(None).cast("string").alias("seed"), F.col("at").alias("level"), "index", count_of(F.col("e.steps"), model).alias("steps"), outcome.alias("outcome"), "source"), kind, model, cohorts)


META = T.StructType().add("model", "string").add("seed", "string").add("rationale_mode", "string").add("suggestion_level", "string").add("wandb_run_url", "string").add("resumed_at_level", "integer").add("resumed_from_steps", "integer")
STATE = T.StructType().add("level", "integer").add("attempt", "integer").add("time", "integer")
REPLAY = T.StructType().add("source", "string").add("game", "string").add("started_at", "string").add("total_steps", "integer").add("meta", META).add("steps", T.ArrayType(io.STEP)).add("states", T.ArrayType(STATE))


def replays(spark: SparkSession, path: str) -> DataFrame:
    """Generated replays, a row per file, with the instance that they are a run of: the first 20 hex
    digits of the SHA-256 of what names the run, not the file."""
    r = spark.read.schema(REPLAY).option("multiLine", True).option("mode", "FAILFAST").json(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    name = F.array("meta.model", "game", "meta.seed", "started_at", "meta.rationale_mode", "meta.suggestion_level", "meta.wandb_run_url")
    return r.withColumn("instance_id", F.substring(F.sha2(F.to_json(name), 256), 1, 20))


def broken_replays(r: DataFrame) -> DataFrame:
    """(file, error) of replays that aren't whole: another source, action steps that don't count from 0
    without gaps, no frames, a continuation without all that came before, or a step whose frame isn't
    there, is of another level or attempt, or lies before that of the step before."""
    a = F.filter("steps", lambda s: ~s["action"].startswith("_"))
    r = r.withColumn("a", F.coalesce(a, F.expr(f"cast(array() as {r.schema['steps'].dataType.simpleString()})")))
    n = F.size("a")
    first = F.get("states", F.lit(0))
    resumed = F.col("meta.resumed_at_level").isNotNull() | F.col("meta.resumed_from_steps").isNotNull()
    prefix = F.col("meta.resumed_from_steps")
    whole = prefix.isNotNull() & prefix.between(0, n) & F.col("total_steps").eqNullSafe(n) & (first["attempt"] == 0) & (first["time"] == 0)
    index = F.transform("a", lambda s: s["state_index"])
    ordered = F.forall(F.transform("a", lambda s, i: i), lambda i: F.coalesce(F.get(index, i) >= F.coalesce(F.get(index, i - 1), F.lit(0)), F.lit(False)) & F.coalesce(F.get(index, i) < F.size("states"), F.lit(False)))
    same = F.forall("a", lambda s: (s["level"] == F.get(F.col("states"), s["state_index"])["level"]) & (s["attempt"] == F.get(F.col("states"), s["state_index"])["attempt"]))
    error = (
        F.when(~F.col("source").eqNullSafe(F.lit("generative")), "another source").when(~F.forall(F.arrays_zip(F.transform("a", lambda s: s["step"]).alias("s"), F.transform("a", lambda s, i: i).alias("i")), lambda x: x["s"].eqNullSafe(x["i"])), "steps are not complete")
        .when(F.size(F.coalesce("states", F.expr(f"cast(array() as {r.schema['states'].dataType.simpleString()})"))) == 0, "no frames").when(resumed & ~F.coalesce(whole, F.lit(False)), "a continuation without its history")
        .when(~ordered, "a frame reference out of order or range").when(~F.coalesce(same, F.lit(True)), "step and frame disagree")
    )
    return r.select("file", error.alias("error")).where("error is not null")


def replay_rows(r: DataFrame, cohorts: tuple[str, ...], games: list[str]) -> DataFrame:
    """Episode rows of whole replays (see broken_replays()) of known games. An episode is a stretch of
    frames of one level and attempt whose time doesn't go back, as labels start anew when a run is
    continued; its steps are the action steps that refer to it, its frames the highest time."""
    game, cohort = game_identity(F.col("game"), cohorts)
    r = materialize(r.withColumns({"g": game, "cohort": cohort}).where(F.col("g").isin(games)).select("file", "instance_id", "g", "cohort", "meta", "steps", "states"))
    key = ["file", "instance_id", "g", "cohort"]
    s = r.select(*key, F.posexplode("states").alias("pos", "s")).select(*key, "pos", "s.level", "s.attempt", "s.time")
    s = with_previous(s, key, ["pos"], ["level", "attempt", "time"])
    s = sessions(s, key, ["pos"], (F.col("level") != F.col("prev_level")) | (F.col("attempt") != F.col("prev_attempt")) | (F.col("time") < F.col("prev_time")))
    s = s.withColumn("frames", F.max("time").over(Window.partitionBy(*key, "session")))
    a = r.select(*key, F.col("meta.model").alias("model"), F.col("meta.rationale_mode").alias("rationale_mode"), F.col("meta.suggestion_level").alias("suggestion_level"), F.col("meta.seed").alias("seed"), F.explode(F.filter("steps", lambda x: ~x["action"].startswith("_"))).alias("a"))
    a = a.select(*key, "model", "rationale_mode", "suggestion_level", "seed", F.col("a.state_index").alias("pos"), F.col("a.won").alias("won"), F.col("a.lose").alias("lose")).join(s.select(*key, "pos", "level", "session", "frames"), [*key, "pos"])
    who = [*key, "model", "rationale_mode", "suggestion_level", "seed", "level"]
    outcome = F.when(F.bool_or(F.coalesce("won", F.lit(False))), "win").when(F.bool_or(F.coalesce("lose", F.lit(False))), "loss").otherwise("incomplete")
    e = a.where(F.col("level").between(0, LEVELS - 1)).groupBy(*who, "session").agg(F.count("*").alias("steps"), F.max("frames").cast("long").alias("frames"), outcome.alias("outcome"))
    g = e.groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("session", "steps", "frames", "outcome"))).alias("e"))
    return g.select(
        F.lit("llm").alias("agent_type"), "model", "rationale_mode", "suggestion_level", "instance_id", F.coalesce("seed", F.lit("None")).alias("seed"), F.col("g").alias("game"), "cohort", "level", F.lit("model").alias("owner"),
        F.col("e.steps").alias("episode_steps"), F.col("e.frames").alias("episode_frames"), F.col("e.outcome").alias("episode_outcomes"), F.lit("llm_decision").alias("step_unit"), F.array("file").alias("data_source"),
    )


def all_episodes(*sources: DataFrame) -> DataFrame:
    """Episode rows of all sources as one table; a source with other columns or types fails."""
    want = T.StructType.fromDDL(EPISODE_ROW)
    out = None
    for s in sources:
        have = {f.name: f.dataType.simpleString() for f in s.schema.fields}
        if have != {f.name: f.dataType.simpleString() for f in want.fields}:
            raise ValueError(f"no episode rows: {sorted(have)}")
        out = s if out is None else out.unionByName(s)
    return out


def result_files(spark: SparkSession, roots: list[str], pattern: str, names: list[str], read) -> DataFrame:
    """Rows of result files under several roots with the dimensions in their names; a file that lies
    under two roots counts once if its rows are equal, else it raises. read(spark, paths) gives rows
    with the input file's path as _path."""
    rows = read(spark, roots)
    rows = rows.withColumns({n: F.regexp_extract("_path", pattern, i + 1) for i, n in enumerate(names)})
    data = [c for c in rows.columns if c not in ("_path", *names)]
    digests = rows.groupBy("_path", *names).agg(F.sum(F.xxhash64(*data).cast("decimal(38,0)")).alias("_d"), F.count("*").alias("_n"))
    checks.require_empty(digests.groupBy(*names).agg(F.countDistinct("_d", "_n").alias("n")).where("n > 1"), "equal copies of a result")
    one = digests.groupBy(*names).agg(F.min("_path").alias("_path")).select("_path")
    return rows.join(one, "_path", "left_semi").drop("_path")
