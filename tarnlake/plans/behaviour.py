"""Queries over episodes, survival and ordered plays, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.operators import episodes as E
from tarnlake.operators import survival as S
from tarnlake.operators import windows as W
from tarnlake.plans.bindings import EPISODES, EV, plays

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PLAY, ORDER = ["user_id", "level"], ["ts", "event_id"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def eps(spark: SparkSession, d: str) -> DataFrame:
    return E.episode_rows(plays(spark, d), PLAY, ORDER)


@query("episode_rows", f"WITH {EPISODES} SELECT user_id, level, array_to_string(s, ',') AS steps, array_to_string(o, ',') AS outcomes, CAST(len(s) AS BIGINT) AS n FROM ep")
def episode_rows(spark, d):
    return eps(spark, d).select("user_id", "level", F.array_join(F.col("episode_steps").cast("array<string>"), ",").alias("steps"), F.array_join("episode_outcomes", ",").alias("outcomes"), F.size("episode_steps").cast("long").alias("n"))


@query("discovery_execution", f"""WITH {EPISODES}
SELECT user_id, level, CAST(sum(steps) FILTER (fw IS NULL OR fw = 0 OR i <= fw) AS BIGINT) AS discovery,
  CAST(coalesce(sum(steps) FILTER (outcome = 'win' AND i > fw), 0) AS BIGINT) AS execution_total,
  CAST(count(*) FILTER (outcome = 'win' AND i > fw) AS BIGINT) AS execution_n FROM epx GROUP BY ALL""")
def discovery_execution(spark, d):
    x = E.execution_steps()
    return eps(spark, d).select("user_id", "level", E.discovery_steps().alias("discovery"), F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v).alias("execution_total"), F.size(x).cast("long").alias("execution_n"))


STREAK = f"""WITH {EPISODES}, g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, level, outcome ORDER BY i) AS isl FROM epx),
r AS (SELECT user_id, level, count(*) AS c FROM g WHERE outcome = 'win' GROUP BY user_id, level, isl),
st AS (SELECT ep.user_id, ep.level, coalesce(max(c), 0) AS streak FROM ep LEFT JOIN r USING (user_id, level) GROUP BY ALL)"""


@query("win_streak", f"{STREAK} SELECT user_id, level, CAST(streak AS BIGINT) AS streak, streak >= 2 AS mastered FROM st")
def win_streak(spark, d):
    s = E.longest_streak()
    return eps(spark, d).select("user_id", "level", s.cast("long").alias("streak"), (s >= 2).alias("mastered"))


@query("outcome_counts", f"""WITH {EV}, c AS (SELECT user_id, level, CASE WHEN event_type IN ('purchase', 'error') THEN event_type = 'purchase' END AS w, k >= 50 AS dead FROM ev)
SELECT level, CASE WHEN w THEN 'win' WHEN dead THEN 'avatar_died' WHEN w IS NOT NULL THEN 'loss' ELSE 'incomplete' END AS outcome,
  CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS agents, CAST(count(w) AS BIGINT) AS finished FROM c GROUP BY 1, 2""")
def outcome_counts(spark, d):
    p = plays(spark, d)
    win = F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type") == "purchase")
    p = p.select("user_id", "level", win.alias("w"), (F.col("k") >= 50).alias("dead"))
    return p.groupBy("level", E.any_match_outcome(F.col("w"), F.col("dead")).alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("agents"), F.count("w").alias("finished"))


@query("sessions", f"""WITH {EV}, b AS (SELECT *, lag(level) OVER w AS pl, lag(k) OVER w AS pk FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN level <> pl OR k < pk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b)
SELECT user_id, CAST(session AS BIGINT) AS session, max(k) AS frames, CAST(count(*) AS BIGINT) AS decisions,
  CASE WHEN bool_or(outcome = 'win') THEN 'win' WHEN bool_or(outcome = 'loss') THEN 'loss' ELSE 'incomplete' END AS outcome FROM s GROUP BY user_id, session""")
def sessions(spark, d):
    p = E.with_previous(plays(spark, d), ["user_id"], ORDER, ["level", "k"])
    p = E.sessions(p, ["user_id"], ORDER, (F.col("level") != F.col("prev_level")) | (F.col("k") < F.col("prev_k")))
    out = F.when(F.bool_or(F.col("outcome") == "win"), "win").when(F.bool_or(F.col("outcome") == "loss"), "loss").otherwise("incomplete")
    return p.groupBy("user_id", "session").agg(F.max("k").alias("frames"), F.count("*").alias("decisions"), out.alias("outcome"))


#: The episode with which a level has its n wins in a row: the first win that is the n-th or a later
#: one of its island.
def streak_end(n: int) -> str:
    return f"""se AS (SELECT user_id, level, min(i) AS i_end FROM (SELECT user_id, level, i, row_number() OVER (PARTITION BY user_id, level, outcome, isl ORDER BY i) AS nth
  FROM g WHERE outcome = 'win') WHERE nth >= {n} GROUP BY 1, 2)"""


def surv_sql(streak: int, after: bool = True) -> str:
    """The first level of 0 to 8 without `streak` wins in a row is ff; levels after it are censored."""
    seen = "(coalesce(fw, 0) > 0 AND (ff IS NULL OR gr9.level <= ff))" if after else "(coalesce(fw, 0) > 0)"
    other = "lim" if after else "coalesce(realised, lim)"
    return f"""{STREAK}, {streak_end(streak)},
d AS (SELECT user_id, level, max(fw) AS fw, sum(steps) FILTER (i <= fw) AS own, sum(steps) AS realised FROM epx WHERE level <= 8 GROUP BY ALL),
gr9 AS (SELECT user_id, CAST(l AS INTEGER) AS level FROM (SELECT DISTINCT user_id FROM epx), (SELECT unnest(range(0, 9)) AS l)),
lim AS (SELECT u.user_id, greatest(coalesce(sum(realised), 0), 1) AS lim FROM (SELECT DISTINCT user_id FROM epx) u LEFT JOIN d USING (user_id) GROUP BY 1),
ff AS (SELECT gr9.user_id, min(gr9.level) AS ff FROM gr9 LEFT JOIN se USING (user_id, level) WHERE i_end IS NULL GROUP BY 1),
sv AS (SELECT gr9.user_id, gr9.level, {seen} AS observed, CAST(CASE WHEN {seen} THEN own ELSE {other} END AS BIGINT) AS time
  FROM gr9 JOIN lim USING (user_id) LEFT JOIN ff USING (user_id) LEFT JOIN d ON d.user_id = gr9.user_id AND d.level = gr9.level)"""


for _name, _streak, _after in (("survival_blocked", 1, True), ("survival_two_wins", 2, True), ("survival_unblocked", 1, False)):

    @query(_name, f"{surv_sql(_streak, _after)} SELECT user_id, level, time, observed FROM sv")
    def _survival(spark, d, n=_streak, after=_after):
        return S.survival_table(eps(spark, d), ["user_id"], 9, n, after)


CAPPED = surv_sql(2) + """, cap AS (SELECT level, max(time) FILTER (observed) AS last FROM sv GROUP BY 1),
cp AS (SELECT user_id, level, observed, CASE WHEN NOT observed AND time <= last THEN last + 1 ELSE time END AS time FROM sv JOIN cap USING (level)),
gr AS (SELECT i AS point, pow(10.0, i * (4.0 / 40)) AS x FROM (SELECT unnest(range(0, 41)) AS i))"""


@query("censoring_capped", f"{CAPPED} SELECT user_id, level, observed, time FROM cp")
def censoring_capped(spark, d):
    return S.cap_censored(S.survival_table(eps(spark, d), ["user_id"]), ["level"]).select("user_id", "level", "observed", "time")


CURVE = f"{CAPPED}, cu AS (SELECT level, point, round(max(x), 6) AS x, round(avg(CASE WHEN observed AND time <= x THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN observed AND time <= x THEN 1.0 ELSE 0.0 END) AS raw FROM cp, gr GROUP BY level, point)"


def curve(spark, d):
    rows = S.cap_censored(S.survival_table(eps(spark, d), ["user_id"]), ["level"])
    return S.event_curve(rows, ["level"], S.log_grid(spark, 41, 4.0))


@query("episode_survival", f"{CURVE} SELECT level, CAST(point AS BIGINT) AS point, x, share FROM cu")
def episode_survival(spark, d):
    """The flagship: recordings to the share of agents that have mastered each level by a time."""
    return curve(spark, d).select("level", "point", F.round("x", 6).alias("x"), F.round("share", 6).alias("share"))


@query("survival_pool", f"{CURVE} SELECT CAST(point AS BIGINT) AS point, round(avg(raw), 6) AS share, CAST(count(*) AS BIGINT) AS n FROM cu GROUP BY point")
def survival_pool(spark, d):
    return curve(spark, d).groupBy("point").agg(F.round(F.avg("share"), 6).alias("share"), F.count("*").alias("n"))


@query("solve_rate", f"{surv_sql(2)} SELECT level, round(100 * avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END), 6) AS rate, CAST(count(*) AS BIGINT) AS n FROM sv GROUP BY level")
def solve_rate(spark, d):
    return S.survival_table(eps(spark, d), ["user_id"]).groupBy("level").agg(F.round(100 * F.avg(F.col("observed").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query("discovery_density", f"""{CAPPED}, v AS (SELECT level, log10(greatest(time, 1)) AS v FROM sv WHERE observed),
n AS (SELECT level, count(*) AS n, stddev_pop(v) AS sd FROM v GROUP BY 1)
SELECT level, CAST(point AS BIGINT) AS point, round(CASE WHEN max(n) >= 2 AND coalesce(max(sd), 0) >= 1e-10 THEN sum(exp(-0.5 * pow((log10(x) - v) / 0.3, 2))) / (max(n) * 0.3 * sqrt(2 * pi())) ELSE 0 END, 6) AS density
FROM v JOIN n USING (level), gr GROUP BY level, point""")
def discovery_density(spark, d):
    rows = S.survival_table(eps(spark, d), ["user_id"]).where("observed").withColumnRenamed("time", "value")
    return S.gaussian_density(rows, ["level"], S.log_grid(spark, 41, 4.0)).select("level", "point", F.round("density", 6).alias("density"))


@query("step_distance", f"""WITH {EV}, v AS (SELECT event_type, ln(1 + steps) AS v, user_id % 2 = 0 AS side FROM ev),
n AS (SELECT event_type, count(*) FILTER (side) AS n1, count(*) FILTER (NOT side) AS n0 FROM v GROUP BY 1),
c AS (SELECT event_type, v, count(*) FILTER (side) AS c1, count(*) FILTER (NOT side) AS c0 FROM v GROUP BY 1, 2),
r AS (SELECT event_type, sum(c1) OVER w AS f1, sum(c0) OVER w AS f0, lead(v) OVER w - v AS dx FROM c WINDOW w AS (PARTITION BY event_type ORDER BY v))
SELECT event_type, round(sum(abs(f1 / n1 - f0 / n0) * coalesce(dx, 0)), 6) AS distance FROM r JOIN n USING (event_type) WHERE n1 >= 2 AND n0 >= 2 GROUP BY 1""")
def step_distance(spark, d):
    p = plays(spark, d).select("event_type", F.col("steps").alias("value"), (F.col("user_id") % 2 == 0).alias("side"))
    return S.earth_mover(p, ["event_type"], "side").select("event_type", F.round("distance", 6).alias("distance"))


@query("mean_sem", f"WITH {EV} SELECT level, outcome, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, CAST(count(value) AS BIGINT) AS n FROM ev GROUP BY 1, 2")
def mean_sem(spark, d):
    return S.mean_sem(plays(spark, d), ["level", "outcome"], "value").withColumns({"mean": F.round("mean", 6), "sem": F.round("sem", 6)})


@query("staircase", f"""{STREAK}, {streak_end(2)},
t AS (SELECT epx.user_id, epx.level, i_end IS NOT NULL AS done, sum(steps) FILTER (i_end IS NULL OR i <= i_end) AS taken
  FROM epx LEFT JOIN se USING (user_id, level) WHERE level BETWEEN 0 AND 8 GROUP BY ALL),
stop AS (SELECT u.user_id, min(l) AS l FROM (SELECT DISTINCT user_id FROM epx) u, (SELECT unnest(range(0, 10)) AS l) LEFT JOIN t ON t.user_id = u.user_id AND t.level = l WHERE coalesce(done, false) = false GROUP BY 1)
SELECT user_id, CAST(0 AS INTEGER) AS point, CAST(0 AS BIGINT) AS steps, CAST(0 AS INTEGER) AS level FROM (SELECT DISTINCT user_id FROM epx)
UNION ALL SELECT user_id, CAST(level + 1 AS INTEGER), CAST(sum(taken) OVER (PARTITION BY user_id ORDER BY level) AS BIGINT), CAST(CASE WHEN done THEN level + 1 ELSE level END AS INTEGER)
FROM t JOIN stop USING (user_id) WHERE level <= l""")
def staircase(spark, d):
    return S.staircase(eps(spark, d), ["user_id"])


W1 = "WINDOW w AS (PARTITION BY user_id, level ORDER BY ts, event_id)"


@query("lag_features", f"WITH {EV} SELECT event_id, " + ", ".join(f"coalesce(lag(value, {k}) OVER w, first_value(value) OVER w) AS lag_{k}" for k in (2, 3, 4, 5)) + f" FROM ev {W1}")
def lag_features(spark, d):
    return W.lagged(plays(spark, d), PLAY, ORDER, "value", [2, 3, 4, 5]).select("event_id", "lag_2", "lag_3", "lag_4", "lag_5")


@query("carried_forward", f"WITH {EV} SELECT event_id, coalesce(last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) OVER w, 0.0) AS x FROM ev {W1}")
def carried_forward(spark, d):
    p = plays(spark, d).withColumn("x", F.when(F.col("k") % 3 == 0, F.col("value")))
    return W.carried(p, PLAY, ORDER, "x").select("event_id", F.col("x_filled").alias("x"))


@query("differences", f"""WITH {EV} SELECT event_id, round(value - coalesce(lag(value) OVER w, value), 6) AS delta,
round((row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY user_id, level) - 1, 1), 6) AS position FROM ev {W1}""")
def differences(spark, d):
    w = Window.partitionBy(*PLAY)
    o = w.orderBy(*ORDER)
    return plays(spark, d).select("event_id", F.round(W.difference("value", o), 6).alias("delta"), F.round(W.relative_position(o, w), 6).alias("position"))


AR = f"""WITH {EV}, p AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM ev),
s AS (SELECT user_id, avg(x) AS mx, avg(value) AS my, avg(x * x) AS xx, avg(value * value) AS yy, avg(x * value) AS xy FROM p WHERE x IS NOT NULL GROUP BY 1),
rho AS (SELECT user_id, CASE WHEN (xx - mx * mx) * (yy - my * my) > 1e-18 THEN (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) ELSE 0 END AS rho FROM s)"""


@query("lag_one", f"{AR} SELECT round(median(rho), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM rho")
def lag_one(spark, d):
    r = W.lag_one_correlation(plays(spark, d), ["user_id"], ORDER, "value")
    return W.median(r, "rho").select(F.round("rho", 6).alias("rho"), "n")


@query("whitened", f"{AR} SELECT event_id, round(value - (SELECT median(rho) FROM rho) * x, 4) AS white FROM p WHERE x IS NOT NULL")
def whitened(spark, d):
    p = plays(spark, d)
    r = W.median(W.lag_one_correlation(p, ["user_id"], ORDER, "value"), "rho").select("rho")
    return W.whitened(p.join(F.broadcast(r)), ["user_id"], ORDER, "value", "rho").select("event_id", F.round("white", 4).alias("white"))  # one row


@query("frame_stack", f"""WITH {EV} SELECT event_id, array_to_string(list_concat(list_resize(CAST([] AS BIGINT[]), 8 - len(l), f), l), ',') AS stack
FROM (SELECT event_id, list(k) OVER (PARTITION BY user_id, level ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l, first_value(k) OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS f FROM ev)""")
def frame_stack(spark, d):
    return W.stacked(plays(spark, d), PLAY, ORDER, "k", 8).select("event_id", F.array_join(F.col("stack").cast("array<string>"), ",").alias("stack"))


@query("rewards", f"""WITH {EV} SELECT event_id, k - coalesce(lag(k) OVER w, 0) AS reward, CAST(sum(steps) OVER w AS BIGINT) AS total,
CAST(count(*) FILTER (outcome = 'win') OVER w AS BIGINT) AS wins, lead(outcome) OVER w AS next_outcome FROM ev {W1}""")
def rewards(spark, d):
    o = Window.partitionBy(*PLAY).orderBy(*ORDER)
    run = o.rowsBetween(Window.unboundedPreceding, 0)
    return plays(spark, d).select("event_id", (F.col("k") - F.coalesce(F.lag("k").over(o), F.lit(0))).alias("reward"), F.sum("steps").over(run).alias("total"), F.count_if(F.col("outcome") == "win").over(run).alias("wins"), F.lead("outcome").over(o).alias("next_outcome"))


@query("run_starts", f"""WITH {EV}, r AS (SELECT *, lag(event_type) OVER w AS pt, row_number() OVER w AS i FROM ev {W1})
SELECT event_id, event_type FROM r WHERE i = 1 OR event_type <> pt""")
def run_starts(spark, d):
    return W.run_starts(plays(spark, d), PLAY, ORDER, ["event_type"]).select("event_id", "event_type")


@query("first_seen", f"""WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS r FROM ev)
SELECT user_id, k, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS found FROM a WHERE r = 1""")
def first_seen(spark, d):
    return W.first_seen(plays(spark, d), ["user_id"], ORDER, ["k"]).select("user_id", "k", "event_id", "found")


@query("islands", f"""WITH {EV}, a AS (SELECT DISTINCT user_id, k FROM ev), g AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS i FROM a)
SELECT user_id, min(k) AS first, max(k) AS last, CAST(count(*) AS BIGINT) AS size FROM g GROUP BY user_id, i""")
def islands(spark, d):
    return W.islands(plays(spark, d), ["user_id"], "k")


@query("play_bounds", f"""WITH {EV}, n AS (SELECT user_id, level, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT user_id, level, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS stop FROM n WINDOW w AS (PARTITION BY user_id ORDER BY level)""")
def play_bounds(spark, d):
    n = plays(spark, d).groupBy(*PLAY).agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.partitionBy("user_id").orderBy("level"))
    return n.select(*PLAY, (stop - F.col("n")).alias("start"), stop.alias("stop"))
