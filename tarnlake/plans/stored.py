"""Queries over files: tables are written as recordings, runs, archives and published lines, and read
back through the scans, with DuckDB twins over the tables they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import scratch
from tarnlake.operators import catalog as G
from tarnlake.operators import features as X
from tarnlake.operators import selection as L
from tarnlake.operators import texts as T
from tarnlake.plans.behaviour import ORDER
from tarnlake.plans.bindings import EV, plays
from tarnlake.sources import archives as A
from tarnlake.sources import documents as D
from tarnlake.sources import io
from tarnlake.sources import recordings as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def in_order(*cols: Column | str, when: Column | None = None) -> Column:
    """A group's rows as structs in the order of their first column."""
    s = F.struct(*cols)
    return F.array_sort(F.collect_list(s if when is None else F.when(when, s)))


# --- recordings --------------------------------------------------------------------------------

def recordings(spark: SparkSession, d: str) -> DataFrame:
    """A recording per user, in a file; a play per level, of run level mod 2, with its scanner record."""
    p = plays(spark, d).where("level >= 0").groupBy("user_id", "level").agg(F.count("*").alias("n"))
    run = (F.col("level") % 2).cast("int")
    scanner = F.struct(F.col("user_id").alias("subj_id"), run.alias("run_id"), (F.col("user_id") * 1000.0 + run).alias("scan_start_ts"))
    play = F.struct(F.concat_ws("-", "user_id", "level").alias("_id"), F.col("user_id").alias("subj_id"), run.alias("run_id"), F.col("level").alias("level_id"), F.col("n").cast("double").alias("score"), (100 - F.col("level")).alias("source_document_index"), scanner.alias("scanner"))
    text = F.to_json(F.struct(F.format_string("sub-%02d", "user_id").alias("subject"), F.col("plays")))
    r = p.groupBy("user_id").agg(F.collect_list(play).alias("plays")).select(F.format_string("user-%d.json.gz", "user_id").alias("path"), text.alias("text"))
    root = scratch(spark)
    D.write_documents(r, root)
    return io.recordings(spark, root)


PL = EV + ", pl AS (SELECT user_id, level, count(*) AS n FROM ev WHERE level >= 0 GROUP BY 1, 2)"


@query("plays_in_order", f"WITH {PL} SELECT user_id || '-' || level AS play, CAST(n AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY level % 2, 100 - level) - 1 AS INTEGER) AS place FROM pl")
def plays_in_order(spark, d):
    return R.plays_in_order(recordings(spark, d)).select(F.col("_id").alias("play"), "score", "place")


@query("scanner_runs", f"WITH {PL} SELECT DISTINCT CAST(user_id AS INTEGER) AS subj_id, CAST(level % 2 AS INTEGER) AS run_id, CAST(user_id * 1000.0 + level % 2 AS DOUBLE) AS scan_start_ts FROM pl")
def scanner_runs(spark, d):
    return R.scanner_runs(recordings(spark, d))


# --- episode rows of runs ----------------------------------------------------------------------

COHORTS = ("c3", "c4")
#: What the twins say of episode rows: lists as text, names in the same order.
SHOW = "game, cohort, instance_id, level, array_to_string(s, ',') AS steps, array_to_string(f, ',') AS frames, array_to_string(o, ',') AS outcomes"
BASE = EV + ", b AS (SELECT *, CASE WHEN outcome = 'win' THEN 1 ELSE 0 END AS win, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ev)"
CSV = BASE + ", csv_ AS (SELECT 'u' || user_id AS game, 'c3' AS cohort, 'run0' AS instance_id, level, list(steps ORDER BY i) AS s, []::VARCHAR[] AS f, list(CASE win WHEN 1 THEN 'win' ELSE 'loss' END ORDER BY i) AS o FROM b WHERE level BETWEEN 0 AND 8 AND user_id % 3 = 0 GROUP BY ALL)"
JSON = BASE + ", json_ AS (SELECT event_type AS game, 'c4' AS cohort, 'r' || user_id AS instance_id, level, list(steps ORDER BY i) AS s, []::VARCHAR[] AS f, list(CASE win WHEN 1 THEN 'win' ELSE 'loss' END ORDER BY i) AS o FROM b WHERE level BETWEEN 0 AND 8 AND user_id % 3 = 1 GROUP BY ALL)"
TRIAL = BASE + ", trial_ AS (SELECT 'sky' AS game, 'c3' AS cohort, 'trial-' || user_id AS instance_id, level, list(steps ORDER BY i) AS s, []::VARCHAR[] AS f, list(outcome ORDER BY i) AS o FROM b WHERE level BETWEEN 0 AND 8 AND user_id % 3 = 2 GROUP BY ALL)"


def shown(rows: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("game", "cohort", "instance_id", "level", text("episode_steps").alias("steps"), text("episode_frames").alias("frames"), text("episode_outcomes").alias("outcomes"))


def base(spark: SparkSession, d: str, third: int) -> DataFrame:
    p = plays(spark, d).where(F.pmod("user_id", F.lit(3)) == third)
    return p.withColumns({"i": F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1, "win": (F.col("outcome") == "win").cast("int")})


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", "i", "level", "steps", "win")
    g = base(spark, d, 0).groupBy("user_id").agg(in_order("i", line.alias("t")).alias("e"))
    text = F.concat(F.lit("episode_index,resolved_level,episode_len,win\n"), F.array_join("e.t", "\n"), F.lit("\n"))
    root = scratch(spark)
    D.write_documents(g.select(F.format_string("u%d_c3/episodes.csv", "user_id").alias("path"), text.alias("text")), root)
    return R.csv_episodes(spark, root, COHORTS)


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    e = base(spark, d, 1).groupBy("user_id", "event_type").agg(in_order("i", "level", "steps", "win").alias("e"))
    run = F.struct(F.format_string("r%d", "user_id").alias("run_id"), F.concat("event_type", F.lit("_c4")).alias("game_raw"), F.transform("e", lambda x: F.struct(x["level"].alias("level"), x["steps"].alias("steps"), x["win"].alias("win"))).alias("episodes"))
    g = e.groupBy("user_id").agg(F.to_json(F.collect_list(run)).alias("text"))
    root = scratch(spark)
    D.write_documents(g.select(F.format_string("runs-%d.json", "user_id").alias("path"), "text"), root)
    return R.json_runs(spark, root, COHORTS)


def trial_rows(spark: SparkSession, d: str) -> DataFrame:
    """Levels in files of the newer name and, for odd users, of the older one, which counts from 1."""
    e = base(spark, d, 2).where("level >= 0").groupBy("user_id", "level").agg(in_order("i", "steps", "outcome").alias("e"))
    text = F.to_json(F.struct(F.transform("e", lambda x: F.struct(x["steps"].alias("steps"), x["outcome"].alias("outcome"))).alias("episode_summaries")))
    path = F.when(F.col("user_id") % 2 == 0, F.format_string("sky_c3/trial-%d/level-%02d.json", "user_id", "level")).otherwise(F.format_string("sky_c3/trial-%d/lvl_%d.json", F.col("user_id"), F.col("level") + 1))
    root = scratch(spark)
    D.write_documents(e.select(path.alias("path"), text.alias("text")), root)
    return R.trial_files(spark, root, COHORTS)


@query("csv_episodes", f"WITH {CSV} SELECT {SHOW} FROM csv_")
def csv_episodes(spark, d):
    return shown(csv_rows(spark, d))


@query("json_runs", f"WITH {JSON} SELECT {SHOW} FROM json_")
def json_runs(spark, d):
    return shown(json_rows(spark, d))


@query("trial_files", f"WITH {TRIAL} SELECT {SHOW} FROM trial_")
def trial_files(spark, d):
    return shown(trial_rows(spark, d))


REPLAY = BASE + """, st AS (SELECT user_id, level, i, steps, outcome, event_type, row_number() OVER (PARTITION BY user_id, level ORDER BY i) - 1 AS t FROM b),
ac AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS step FROM st WHERE event_type <> 'view'),
gp AS (SELECT user_id, level, max(t) AS frames FROM st GROUP BY 1, 2),
replay_ AS (SELECT 'bait' AS game, 'c3' AS cohort, substring(sha256('["m","bait_c3","' || user_id || '","t","' || CASE WHEN user_id % 2 = 0 THEN 'full' ELSE 'none' END || '","s",null]'), 1, 20) AS instance_id, level, [count(*)] AS s, [max(frames)] AS f, [CASE WHEN bool_or(outcome = 'win') THEN 'win' WHEN bool_or(outcome = 'loss') THEN 'loss' ELSE 'incomplete' END] AS o
  FROM ac JOIN gp USING (user_id, level) WHERE level BETWEEN 0 AND 8 GROUP BY user_id, level)"""


def replay_files(spark: SparkSession, d: str) -> DataFrame:
    """A replay per user: events are frames, those that aren't views also steps; levels are in order."""
    w = Window.partitionBy("user_id")
    p = plays(spark, d)
    p = p.withColumns({"i": F.row_number().over(w.orderBy(*ORDER)) - 1, "t": F.row_number().over(Window.partitionBy("user_id", "level").orderBy(*ORDER)) - 1, "_a": (F.col("event_type") != "view").cast("int")})
    p = p.withColumn("step", F.sum("_a").over(w.orderBy(*ORDER)) - 1)
    state = in_order("i", "level", F.lit(0).alias("attempt"), F.col("t").alias("time"))
    step = in_order("i", "step", "level", F.lit(0).alias("attempt"), F.upper("event_type").alias("action"), F.col("i").alias("state_index"), (F.col("outcome") == "win").alias("won"), (F.col("outcome") == "loss").alias("lose"), when=F.col("_a") == 1)
    g = p.groupBy("user_id").agg(state.alias("states"), step.alias("steps"))
    meta = F.struct(F.lit("m").alias("model"), F.col("user_id").cast("string").alias("seed"), F.when(F.col("user_id") % 2 == 0, "full").otherwise("none").alias("rationale_mode"), F.lit("s").alias("suggestion_level"))
    without = lambda c: F.transform(c, lambda x: x.dropFields("i"))
    text = F.to_json(F.struct(F.lit("generative").alias("source"), F.lit("bait_c3").alias("game"), F.lit("t").alias("started_at"), meta.alias("meta"), without("steps").alias("steps"), without("states").alias("states")))
    root = scratch(spark)
    D.write_documents(g.select(F.format_string("run-%d.json.gz", "user_id").alias("path"), text.alias("text")), root)
    return R.replays(spark, root)


@query("replay_rows", f"WITH {REPLAY} SELECT {SHOW} FROM replay_")
def replay_rows(spark, d):
    return shown(R.replay_rows(replay_files(spark, d), COHORTS, ["bait"]))


@query("broken_replays", f"WITH {EV} SELECT 'run-' || user_id || '.json.gz' AS file, CAST('none' AS VARCHAR) AS error FROM ev WHERE false")
def broken_replays(spark, d):
    """All of them are whole."""
    return R.broken_replays(replay_files(spark, d))


@query("all_episodes", f"WITH {REPLAY}{CSV[len(BASE) :]}{JSON[len(BASE) :]}{TRIAL[len(BASE) :]}, u AS (SELECT 'llm' AS agent_type, * FROM replay_ UNION ALL SELECT 'ez', * FROM csv_ UNION ALL SELECT 'ddqn', * FROM json_ UNION ALL SELECT 'empa', * FROM trial_) SELECT agent_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(s)) AS BIGINT) AS episodes, CAST(sum(list_sum(s)) AS BIGINT) AS steps FROM u GROUP BY 1")
def all_episodes(spark, d):
    rows = R.all_episodes(R.replay_rows(replay_files(spark, d), COHORTS, ["bait"]), csv_rows(spark, d), json_rows(spark, d), trial_rows(spark, d))
    total = F.aggregate("episode_steps", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("agent_type").agg(F.count("*").alias("n"), F.sum(F.size("episode_steps")).alias("episodes"), F.sum(total).alias("steps"))


@query("result_files", "SELECT l_returnflag AS model, CAST(l_linenumber AS VARCHAR) AS layer, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_suppkey) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2")
def result_files(spark, d):
    """Results by model and layer, some of them in two folders."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("layer")).agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("total"))
    text = F.to_json(F.struct("n", "total"))
    roots = [scratch(spark), scratch(spark)]
    for k, root in enumerate(roots):
        D.write_documents(r.where((F.col("layer") + k) % 3 > 0).select(F.format_string("%s_layer%d.json", "model", "layer").alias("path"), text.alias("text")), root)
    read = lambda s, paths: s.read.schema("n long, total long").json([f"{p}/*.json" for p in paths]).select("*", F.col("_metadata.file_path").alias("_path"))
    return R.result_files(spark, roots, r"/(\w+)_layer(\d+)\.json$", ["model", "layer"], read).select("model", "layer", "n", "total")


# --- archives and published lines --------------------------------------------------------------

@query("archived_layers", "SELECT CAST(label AS INTEGER) AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, 32 AS width, round(list_sum(list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def archived_layers(spark, d):
    """Vectors as archives of three arrays by label, of which one is read."""
    e = table(spark, d, "embeddings").withColumn("row", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    half = lambda k: F.transform(F.slice("embedding", 32 * k + 1, 32), lambda x: x.cast("double"))
    none = F.lit(None).cast("string")
    member = lambda name, numbers, text=none: F.struct(F.lit(name).alias("member"), numbers.alias("numbers"), text.alias("text"))
    parts = F.array(member("first", half(0)), member("second", half(1)), member("ids", F.lit(None).cast("array<double>"), F.concat(F.lit("v"), F.col("vec_id").cast("string"))))
    root = scratch(spark)
    A.write_archives(e.select(F.format_string("label-%d.npz", "label").alias("archive"), "row", F.explode(parts).alias("m")).select("archive", "m.member", "row", "m.numbers", "m.text"), root)
    got = A.read_archives(spark, root, ["second"])
    label = F.regexp_extract("archive", r"label-(\d+)\.npz$", 1).cast("int")
    return got.select(label.alias("label"), "row", F.size("numbers").alias("width"), F.round(F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("published_rows", """WITH l AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}' AS line FROM customer)
SELECT 'customers-' || lpad(CAST(n // 500 AS VARCHAR), 6, '0') || '.jsonl.gz' AS path, CAST(count(*) AS BIGINT) AS rows, sha256(string_agg(line, chr(10) ORDER BY n) || chr(10)) AS text_sha256 FROM l GROUP BY n // 500""")
def published_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return D.publish(c, scratch(spark), "customers", ["c_custkey"], 500).select("path", "rows", "text_sha256")


# --- checks of samples, features and selections ------------------------------------------------

@query("sample_errors", f"WITH {EV} SELECT DISTINCT user_id, 'lengths disagree' AS error FROM ev WHERE user_id % 4 = 1 UNION ALL SELECT DISTINCT user_id, 'level or game disagrees' FROM ev WHERE user_id % 4 = 2")
def sample_errors(spark, d):
    """Events as samples of plays by level; a fourth of the users has a wrong length, a fourth a wrong level."""
    p = plays(spark, d)
    s = p.withColumn("row", F.row_number().over(Window.partitionBy("user_id").orderBy("level", *ORDER)) - 1)
    g = s.groupBy("user_id", "level").agg(F.count("*").alias("n"), F.min("row").alias("start"), (F.max("row") + 1).alias("stop"))
    g = g.withColumn("play_idx", F.row_number().over(Window.partitionBy("user_id").orderBy("level")) - 1)
    way, first = F.pmod("user_id", F.lit(4)), F.col("play_idx") == 0
    game = F.lit(1).alias("game")
    samples = s.join(g.select("user_id", "level", "play_idx"), ["user_id", "level"]).select("user_id", "row", "play_idx", "level", game)
    play_rows = g.select("user_id", "play_idx", F.col("level").cast("string").alias("play"), "start", "stop", F.when((way == 1) & first, F.col("n") + 1).otherwise(F.col("n")).alias("n_volumes"), F.when((way == 2) & first, F.col("level") + 50).otherwise(F.col("level")).alias("level"), game)
    return X.sample_errors(samples, play_rows, ["user_id"])


@query("unbound_features", f"WITH {EV} SELECT DISTINCT user_id, level FROM ev WHERE (user_id + level) % 5 = 0 OR level % 7 = 0")
def unbound_features(spark, d):
    """Features of plays with the digests of the samples they were made from, some of which are others' or missing."""
    digest = F.sha2(F.array_join(in_order("k", F.col("k").cast("string").alias("t"))["t"], ","), 256)
    g = plays(spark, d).groupBy("user_id", "level").agg(digest.alias("samples"))
    f = g.select("user_id", "level", F.when((F.col("user_id") + F.col("level")) % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("samples")).alias("samples"))
    return X.unbound(f, g.where("level % 7 <> 0"), ["user_id", "level"], ["samples"]).select("user_id", "level")


@query("bad_intervals", f"WITH {EV}, i AS (SELECT event_id, user_id, k AS a, k + steps - 3 AS z FROM ev), w AS (SELECT *, lag(z) OVER (PARTITION BY user_id ORDER BY a, z) AS b FROM i) SELECT user_id, a AS start, z AS stop, CAST(count(*) AS BIGINT) AS n FROM w WHERE z <= a OR z > 100 OR a < b OR a < 0 GROUP BY 1, 2, 3")
def bad_intervals(spark, d):
    i = plays(spark, d).select("user_id", F.col("k").alias("start"), (F.col("k") + F.col("steps") - 3).alias("stop"), F.lit(100).alias("n"))
    return X.bad_intervals(i, ["user_id"], "n").groupBy("user_id", "start", "stop").agg(F.count("*").alias("n"))


@query("mask_errors", "SELECT s_nationkey AS subject, 'files differ' AS error FROM (SELECT s_nationkey, count(DISTINCT s_suppkey % 2) AS n FROM supplier GROUP BY 1) WHERE n > 1")
def mask_errors(spark, d):
    """Suppliers as mask files of nations: those with an odd key lack a cell that the others have."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("subject"), F.col("s_suppkey").alias("file"))
    masks = s.withColumn("affine", F.array(*[F.lit(float(i)) for i in range(12)]))
    cells = s.select("subject", "file", F.explode(F.when(F.col("file") % 2 == 0, F.sequence(F.lit(0), F.lit(9))).otherwise(F.sequence(F.lit(0), F.lit(8)))).alias("cell"))
    common = cells.where("cell < 5").select("cell").distinct()
    return T.mask_errors(masks, cells, common, "subject", "file", "cell")


@query("over_budget", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem HAVING sum(l_orderkey) > 1000")
def over_budget(spark, d):
    return G.over_budget(table(spark, d, "lineitem"), "l_orderkey", 1000)


@query("chosen_components", "SELECT l_returnflag AS component, l_linestatus AS tier, CAST(count(*) AS BIGINT) AS files FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_linestatus IN ('F') GROUP BY 1, 2")
def chosen_components(spark, d):
    rows = G.chosen(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("tier"), F.col("l_linenumber").alias("kind")), component=["A", "N"], tier=["F"], kind=[])
    return rows.groupBy("component", "tier").agg(F.count("*").alias("files"))


@query("agent_rows", "SELECT CAST(count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 1) AS BIGINT) AS llm, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS other FROM lineitem")
def agent_rows(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "model")
    llm = L.agent_rows(li, "A", "llm", {"l_linestatus": "F", "l_linenumber": 1}).agg(F.count("*").alias("llm"))
    return llm.join(L.agent_rows(li, "A", "ez", {"l_linestatus": "F"}).agg(F.count("*").alias("other")))


@query("allowed_layers", "SELECT l_returnflag AS model, l_linenumber AS layer, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE CASE l_returnflag WHEN 'A' THEN l_linenumber IN (1, 7) ELSE l_linenumber IN (2, 3) END GROUP BY 1, 2")
def allowed_layers(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("layer"))
    return L.in_layers(rows, [2, 3], {"A": [1, 7]}, "model", "layer").groupBy("model", "layer").agg(F.count("*").alias("n"))


@query("kept_fields", f"WITH {EV} SELECT event_id, '[{{\"k\":' || k || '}},{{\"k\":' || steps || '}}]' AS sprites FROM ev")
def kept_fields(spark, d):
    one = lambda c: F.struct(F.col(c).alias("k"), F.col("event_type").alias("engine"), F.lit(1).alias("uid"))
    return plays(spark, d).select("event_id", F.to_json(G.without_fields(F.array(one("k"), one("steps")), "engine", "uid")).alias("sprites"))


@query("feature_paths", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'model-features/lrm/model-a/' || CASE l_linestatus WHEN 'F' THEN 'minimal' ELSE 'elaborate' END || '--all--mlp.npz' END AS path FROM lineitem")
def feature_paths(spark, d):
    label = F.concat(F.lit("llm_"), F.when(F.col("l_returnflag") == "A", "a").otherwise("other"), F.when(F.col("l_linestatus") == "F", "_sugmin").otherwise(""), F.lit("__all__mlp_layer_"), F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", L.condition_name(label, {"a": "model-a"}).alias("path"))
