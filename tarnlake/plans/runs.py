"""Queries over policies of runs, state graphs and fits of several subjects, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import scratch
from tarnlake.operators import fit as X
from tarnlake.operators import graph as G
from tarnlake.operators import policies as P
from tarnlake.plans.behaviour import ORDER
from tarnlake.plans.bindings import EV, plays

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def ran(spark, d, rule, levels):
    p = plays(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*ORDER, F.col("steps").alias("frames"), (F.col("outcome") == "win").alias("won"), (F.col("outcome") == "loss").alias("died")))).alias("a"))
    return p.select("user_id", P.run(F.col("a"), rule, levels).alias("s")).select("user_id", "s.level", "s.total_frames", "s.wins", "s.losses", "s.attempts", "s.reason")


RUN = f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, list(steps ORDER BY ts, event_id) AS f, list(outcome ORDER BY ts, event_id) AS o FROM ev GROUP BY 1),
r(user_id, f, o, i, level, lf, total, ws, ls, wins, losses, reason) AS (SELECT user_id, f, o, 0, 0, 0::BIGINT, 0::BIGINT, 0, 0, 0, 0, '' FROM o UNION ALL """
FIXED = RUN + """SELECT user_id, f, o, i + 1, level + u, CASE WHEN u = 1 THEN 0 ELSE lf + f[i + 1] END, total + f[i + 1], ws, ls, wins + (o[i + 1] = 'win')::INT, losses + (o[i + 1] = 'loss')::INT, CASE WHEN level + u >= 4 THEN 'completed' ELSE '' END
  FROM (SELECT *, CASE WHEN lf + f[i + 1] >= 100 THEN 1 ELSE 0 END AS u FROM r WHERE reason = '' AND i < len(o)))
SELECT user_id, CAST(level AS INTEGER) AS level, CAST(total AS BIGINT) AS total_frames, CAST(wins AS INTEGER) AS wins, CAST(losses AS INTEGER) AS losses, CAST(i AS INTEGER) AS attempts, reason FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""
BLOCKED = RUN + """SELECT user_id, f, o, i + 1, level + u, 0::BIGINT, t, CASE WHEN u = 1 THEN 0 ELSE w END, l, wins + (x = 'win')::INT, losses + (x = 'loss')::INT, CASE WHEN lost THEN 'losses' WHEN t >= 400 AND u = 0 THEN 'budget' WHEN level + u >= 4 THEN 'completed' WHEN t >= 400 THEN 'budget' ELSE '' END
  FROM (SELECT *, CASE WHEN NOT lost AND x = 'win' AND w >= 2 THEN 1 ELSE 0 END AS u FROM (SELECT *, l >= 5 AS lost FROM (SELECT *, o[i + 1] AS x, total + f[i + 1] AS t, CASE o[i + 1] WHEN 'loss' THEN 0 WHEN 'win' THEN ws + 1 ELSE ws END AS w, CASE o[i + 1] WHEN 'loss' THEN ls + 1 WHEN 'win' THEN 0 ELSE ls END AS l FROM r WHERE reason = '' AND i < len(o)))))
SELECT user_id, CAST(level AS INTEGER) AS level, CAST(total AS BIGINT) AS total_frames, CAST(wins AS INTEGER) AS wins, CAST(losses AS INTEGER) AS losses, CAST(i AS INTEGER) AS attempts, reason FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


@query("fixed_budget_runs", FIXED)
def fixed_budget_runs(spark, d):
    return ran(spark, d, P.policy({"strategy": "fixed_budget", "level_frame_budget": 100}), 4)


@query("blocked_runs", BLOCKED)
def blocked_runs(spark, d):
    return ran(spark, d, P.policy({"strategy": "blocked_curricula", "total_frame_budget": 400, "max_consecutive_losses": 5}), 4)


STATES = EV + ", s AS (SELECT user_id, ts, event_id, event_type || ':' || k AS node, value FROM ev), e AS (SELECT DISTINCT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM s), g AS (SELECT src, dst FROM e WHERE dst IS NOT NULL)"
REACHED = STATES.replace("ev AS", "ev AS", 1) + ", r(node, depth) AS (SELECT DISTINCT src, 0 FROM g WHERE src = 'click:7' UNION SELECT dst, depth + 1 FROM r JOIN g ON node = src WHERE depth < 12), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1), v AS (SELECT node, round(max(value), 6) AS reward FROM s GROUP BY 1)"


def reached(spark, d):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = plays(spark, d).withColumn("node", F.concat_ws(":", "event_type", F.col("k").cast("string")))
    e = s.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null").distinct()
    seen = G.breadth_first(e, e.where("src = 'click:7'").select(F.col("src").alias("node")))
    return seen, s.groupBy("node").agg(F.round(F.max("value"), 6).alias("reward"))


@query("reward_vector", f"WITH RECURSIVE {REACHED} SELECT node, row_number() OVER (ORDER BY depth, node) - 1 AS place, reward FROM m JOIN v USING (node)")
def reward_vector(spark, d):
    seen, states = reached(spark, d)
    return G.reward_vector(seen, states, "reward")


@query("any_all_states", f"WITH RECURSIVE {REACHED} SELECT unnest(['rich', 'named', 'positive']) AS name, unnest([bool_or(reward > 50), bool_or(node LIKE 'click%'), bool_or(reward > 0)]) AS any_state, unnest([bool_and(reward > 50), bool_and(node LIKE 'click%'), bool_and(reward > 0)]) AS all_states FROM m JOIN v USING (node)")
def any_all_states(spark, d):
    seen, states = reached(spark, d)
    return G.any_all(seen.select("node"), states, {"rich": F.col("reward") > 50, "named": F.col("node").like("click%"), "positive": F.col("reward") > 0})


@query("fitted_subjects")
def fitted_subjects(spark, d):
    """Two subjects, the even and the odd vectors; a second run finds their results and fits nothing."""
    e = table(spark, d, "embeddings")
    play = F.expr("vec_id div 30")
    rows = e.select(F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("subject"), F.expr("vec_id div 2").alias("row"), play.alias("play"), (play % 3).alias("part"), F.slice("embedding", 1, 8).alias("main"), F.slice("embedding", 33, 4).alias("rest"), "label")
    targets = rows.select("subject", "row", "label", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("target")).select("subject", "row", "target", (F.col("label") == F.col("target")).cast("double").alias("y"))
    args = (rows.drop("label"), targets, scratch(spark), ["s0", "s1"], ["main", "rest"], ["play"], "row", "part", X.Search(n_iter=3))
    X.fit_subjects(*args)
    return X.fit_subjects(*args).select("subject", "fold", "target", "draw", F.round("alpha", 6).alias("alpha"), F.round("r", 6).alias("r"))
