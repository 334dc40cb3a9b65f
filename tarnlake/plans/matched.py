"""Queries over features met with plays, samples, and selections of results, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.operators import features as X
from tarnlake.operators import selection as L
from tarnlake.operators import survival as S
from tarnlake.plans.analysis import RES, scores
from tarnlake.plans.behaviour import CAPPED, ORDER, PLAY, eps, surv_sql
from tarnlake.plans.bindings import EPISODES, EV, plays

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("zero_filled", f"""WITH {EV}, p AS (SELECT DISTINCT user_id, level FROM ev), f AS (SELECT user_id, level, avg(value) AS a, CAST(count(*) AS DOUBLE) AS b FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.user_id, p.level, round(coalesce(a, 0), 6) AS v0, coalesce(b, 0) AS v1, a IS NOT NULL AS observed FROM p LEFT JOIN f USING (user_id, level)""")
def zero_filled(spark, d):
    p = plays(spark, d)
    f = p.where("event_type = 'click'").groupBy(*PLAY).agg(F.array(F.avg("value"), F.count("*").cast("double")).alias("v"))
    out = X.zero_filled(p.select(*PLAY).distinct(), f, PLAY, "v", 2)
    return out.select(*PLAY, F.round(F.col("v")[0], 6).alias("v0"), F.col("v")[1].alias("v1"), "observed")


@query("not_in_source", f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'click' AND (user_id, sec) NOT IN (SELECT user_id, sec FROM ev WHERE k < 60)")
def not_in_source(spark, d):
    p = plays(spark, d)
    return X.not_in_source(p.where("event_type = 'click'").select("event_id", "user_id", "sec"), p.where("k < 60"), ["user_id"], "sec").select("event_id")


NUMBERED = EV + ", nu AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM ev)"


def numbered(spark, d):
    return plays(spark, d).withColumn("pos", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))


@query("gathered", f"WITH {NUMBERED} SELECT a.event_id, b.sec AS frame_sec FROM nu a JOIN nu b ON a.user_id = b.user_id AND b.pos = a.k")
def gathered(spark, d):
    n = numbered(spark, d)
    return X.gathered(n.select("event_id", "user_id", F.col("k").alias("index")), n.select("user_id", "pos", F.col("sec").alias("frame_sec")), ["user_id"], "index", "pos", ["frame_sec"]).select("event_id", "frame_sec")


@query("agreement", f"""WITH {EV}, s AS (SELECT user_id, CAST(floor(level / 2) AS BIGINT) AS pair, level % 2 AS side, event_type, row_number() OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS i FROM ev WHERE level >= 0)
SELECT user_id, pair, round(avg(CASE WHEN a.event_type = b.event_type THEN 1.0 ELSE 0.0 END), 6) AS agreement, CAST(count(*) AS BIGINT) AS n FROM s a JOIN s b USING (user_id, pair, i) WHERE a.side = 0 AND b.side = 1 GROUP BY 1, 2""")
def agreement(spark, d):
    p = plays(spark, d).where("level >= 0").select("user_id", F.floor(F.col("level") / 2).alias("pair"), (F.col("level") % 2).alias("side"), *ORDER, "event_type")
    return X.agreement(p.where("side = 0").drop("side"), p.where("side = 1").drop("side"), ["user_id", "pair"], ORDER, "event_type").withColumn("agreement", F.round("agreement", 6))


@query("stepped", f"""WITH {NUMBERED}, st AS (SELECT user_id, pos, k // 10 AS index, level FROM nu WHERE event_type = 'click'),
b AS (SELECT *, max(index) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM st),
j AS (SELECT b.user_id, n.pos IS NOT NULL AND b.level = n.level AND coalesce(index >= before, true) AS good FROM b LEFT JOIN nu n ON n.user_id = b.user_id AND n.pos = b.index)
SELECT user_id, CAST(count(*) FILTER (good) AS BIGINT) AS good, CAST(count(*) FILTER (NOT good) AS BIGINT) AS bad FROM j GROUP BY 1""")
def stepped(spark, d):
    n = numbered(spark, d)
    steps = n.where("event_type = 'click'").select("user_id", "pos", F.expr("k div 10").alias("index"), "level")
    good, bad = X.stepped(steps, n.select("user_id", F.col("pos").alias("at"), "level"), ["user_id"], "pos", "index", "at", ["level"])
    both = good.select("user_id", F.lit(1).alias("g")).unionByName(bad.select("user_id", F.lit(0).alias("g")))
    return both.groupBy("user_id").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("bad"))


@query("resolved_groups", f"""WITH {EV}, g AS (SELECT user_id || '-' || level AS grp, level, bool_or(event_id % 97 = 0) AS moved FROM ev GROUP BY user_id, level)
SELECT grp, CASE WHEN NOT (moved AND level % 3 IN (0, 1)) THEN CAST(level AS BIGINT) END AS play,
  CASE WHEN moved AND level % 3 = 0 THEN 'times are not the frames''' WHEN moved AND level % 3 = 1 THEN 'times are not the composite play''s' WHEN level % 3 = 0 THEN 'reference' WHEN level % 3 = 1 THEN 'composite' ELSE 'time' END AS how FROM g""")
def resolved_groups(spark, d):
    """Groups of a user's levels, with references, with composite names or with times only; some have
    times that were moved."""
    w = Window.partitionBy(*PLAY).orderBy(*ORDER)
    e = plays(spark, d).withColumn("frame", F.row_number().over(w) - 1)
    play, kind = F.col("level").cast("long"), F.pmod("level", F.lit(3))
    refs = {"play": play, "frame": F.col("frame"), "document": F.col("level")}
    moved = F.when(F.col("event_id") % 97 == 0, 0.5).otherwise(0.0)
    name = F.concat(F.lit("sub-"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("_0_"), F.col("level").cast("string"))
    f = e.select(F.col("user_id").alias("scope"), F.concat_ws("-", "user_id", "level").alias("grp"), (F.col("sec") + moved).alias("ts"), *[F.when(kind == 0, c).alias(n) for n, c in refs.items()], F.when(kind == 1, name).alias("composite"))
    p = e.select(F.col("user_id").alias("scope"), play.alias("play"), (F.col("user_id") % 100).alias("subject"), F.lit(0).cast("long").alias("run"), F.col("level").cast("long").alias("document")).distinct()
    frames = e.select(F.col("user_id").alias("scope"), play.alias("play"), "frame", F.col("sec").alias("ts"))
    found, errors = X.resolve(f, p, frames, 2.0, 3 * 86400.0)
    return found.unionByName(errors.select("grp", F.lit(None).cast("long").alias("play"), F.col("error").alias("how")))


@query("unit_bins", f"""WITH {EV}, b AS (SELECT user_id, CAST(floor(sec / 86400) AS BIGINT) AS day, avg(value - 40) AS x, avg(k - 40.0) AS y FROM ev GROUP BY 1, 2), n AS (SELECT *, sqrt(x * x + y * y) AS n FROM b)
SELECT user_id, day, round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS v0, round(y / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS v1 FROM n""")
def unit_bins(spark, d):
    p = plays(spark, d).select("user_id", F.floor(F.col("sec") / 86400).alias("day"), F.array(F.col("value") - 40, F.col("k") - 40.0).alias("v"))
    return X.bin_vectors(p, ["user_id"], "day", "v", unit=True).select("user_id", "day", F.round(F.col("v")[0], 6).alias("v0"), F.round(F.col("v")[1], 6).alias("v1"))


@query("pressed_bins", f"""WITH {EV}, b AS (SELECT user_id, level, CAST(event_type = 'click' AS INTEGER) AS up, CAST(event_type = 'view' AS INTEGER) AS down FROM ev)
SELECT user_id, level, round(avg(up), 6) AS up, round(avg(down), 6) AS down, avg(greatest(up, down)) > 0.5 AS any_pressed FROM b GROUP BY 1, 2""")
def pressed_bins(spark, d):
    p = plays(spark, d).select(*PLAY, (F.col("event_type") == "click").cast("int").alias("up"), (F.col("event_type") == "view").cast("int").alias("down"))
    return X.pressed_bins(p, ["user_id"], "level", ["up", "down"]).withColumns({k: F.round(k, 6) for k in ("up", "down")})


@query("standardised", f"""WITH {EV}, s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS sd FROM ev GROUP BY 1)
SELECT event_id, round((value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM ev JOIN s USING (user_id)""")
def standardised(spark, d):
    return X.standardised(plays(spark, d), ["user_id"], "value").select("event_id", F.round("z", 5).alias("z"))


@query("up_to_level", f"""WITH {EV}, n AS (SELECT user_id, level, count(*) AS n FROM ev WHERE level <= 5 GROUP BY 1, 2)
SELECT user_id, level, CAST(row_number() OVER w - 1 AS INTEGER) AS play_idx, CAST(n AS BIGINT) AS n_volumes, CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
FROM n WINDOW w AS (PARTITION BY user_id ORDER BY level)""")
def up_to_level(spark, d):
    return X.up_to_level(plays(spark, d), ["user_id"], "level", "level", ORDER, 5)[1]


@query("fold_summary", f"""WITH {RES}, f AS (SELECT model, roi, part, avg(perf) - 0.05 AS v FROM res GROUP BY ALL), t AS (SELECT model, roi, avg(v) AS v FROM f GROUP BY ALL)
SELECT model, round(avg(v), 6) AS mean, round(max(v), 6) AS max, CAST(count(*) AS BIGINT) AS targets, CAST(count(*) FILTER (v > 0) AS BIGINT) AS positive, CAST(count(*) FILTER (v > 0.05) AS BIGINT) AS above_05, CAST(count(*) FILTER (v > 0.1) AS BIGINT) AS above_10 FROM t GROUP BY 1""")
def fold_summary(spark, d):
    f = scores(spark, d).groupBy("model", "roi", "part").agg((F.avg("perf") - 0.05).alias("v"))
    return X.fold_summary(f, ["model"], "roi", "v").withColumns({"mean": F.round("mean", 6), "max": F.round("max", 6)})


@query("feature_coverage", f"""WITH {EV}, n AS (SELECT user_id, level, count(*) AS n, bool_or(event_type = 'purchase') AS here FROM ev GROUP BY 1, 2)
SELECT level, CAST(count(*) AS BIGINT) AS plays, CAST(count(*) FILTER (NOT here) AS BIGINT) AS missing_plays, CAST(sum(n) AS BIGINT) AS samples, CAST(coalesce(sum(n) FILTER (NOT here), 0) AS BIGINT) AS missing_samples FROM n GROUP BY 1""")
def feature_coverage(spark, d):
    p = plays(spark, d)
    expected = X.up_to_level(p, ["user_id"], "level", "level", ORDER, 1 << 30)[1]
    return X.coverage(expected, p.where("event_type = 'purchase'"), PLAY, ["level"])


@query("trace_errors", f"""WITH {NUMBERED}, fr AS (SELECT user_id, pos FROM nu), tr AS (SELECT user_id, pos FROM nu WHERE k % 4 <> 0 UNION ALL SELECT user_id, pos FROM nu WHERE k % 10 = 1 UNION ALL SELECT user_id, pos + 10000 FROM nu WHERE k = 7),
gp AS (SELECT user_id, pos FROM nu WHERE k % 8 = 0)
SELECT user_id, pos, 'twice' AS error FROM tr GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT DISTINCT user_id, pos, 'no such frame' FROM tr WHERE pos >= 10000
UNION ALL SELECT user_id, pos, 'missing' FROM fr WHERE (user_id, pos) NOT IN (SELECT user_id, pos FROM tr) AND (user_id, pos) NOT IN (SELECT user_id, pos FROM gp)""")
def trace_errors(spark, d):
    n = numbered(spark, d).select("user_id", "pos", "k")
    t = n.where("k % 4 <> 0").unionByName(n.where("k % 10 = 1")).unionByName(n.where("k = 7").withColumn("pos", F.col("pos") + 10000))
    return X.trace_errors(t, n, ["user_id"], "pos", n.where("k % 8 = 0"))


@query("length_errors", f"""WITH {EV}, a AS (SELECT user_id, level, count(*) AS n FROM ev WHERE k <> 3 GROUP BY 1, 2), b AS (SELECT user_id, level, count(*) AS want FROM ev GROUP BY 1, 2)
SELECT user_id, level, CAST(n AS BIGINT) AS n, CAST(want AS BIGINT) AS want FROM a FULL JOIN b USING (user_id, level) WHERE n IS DISTINCT FROM want""")
def length_errors(spark, d):
    p = plays(spark, d)
    return X.length_errors(p.where("k <> 3").groupBy(*PLAY).agg(F.count("*").alias("n")), p.groupBy(*PLAY).agg(F.count("*").alias("want")), PLAY, "n", "want")


# --- selections ------------------------------------------------------------------------------


@query("picked_variants", f"""WITH {RES}, v AS (SELECT DISTINCT CASE WHEN model = 'A' THEN 'qwen-a' WHEN model = 'N' THEN 'ds-n' ELSE model END AS model, CASE WHEN variant = 'O' THEN 'all' ELSE 'plain' END AS variant FROM res WHERE model <> 'R' OR variant = 'F')
SELECT model, CASE WHEN model LIKE 'qwen%' AND bool_or(variant = 'all') THEN 'all' ELSE min(variant) END AS variant FROM v GROUP BY 1 HAVING count(*) = 1 OR (model LIKE 'qwen%' AND bool_or(variant = 'all'))""")
def picked_variants(spark, d):
    m = F.when(F.col("model") == "A", "qwen-a").when(F.col("model") == "N", "ds-n").otherwise(F.col("model"))
    s = scores(spark, d).where("model <> 'R' or variant = 'F'").select(m.alias("model"), F.when(F.col("variant") == "O", "all").otherwise("plain").alias("variant"))
    return L.pick_variants(s, "model", "variant", [])[0]


@query("best_layer_of_model", f"""WITH {RES}, x AS (SELECT * FROM res WHERE NOT (model = 'A' AND layer = 7 AND subject = 3)), p AS (SELECT model, layer, subject, avg(perf) AS v FROM x GROUP BY ALL),
l AS (SELECT model, layer, avg(v) AS mean, count(*) AS n FROM p GROUP BY 1, 2), e AS (SELECT model FROM l JOIN (SELECT model, count(DISTINCT subject) AS q FROM x GROUP BY 1) USING (model) GROUP BY model HAVING bool_and(n = q))
SELECT model, layer, round(mean, 6) AS mean FROM l JOIN e USING (model) QUALIFY row_number() OVER (PARTITION BY model ORDER BY mean DESC, layer) = 1""")
def best_layer_of_model(spark, d):
    x = scores(spark, d).where("not (model = 'A' and layer = 7 and subject = 3)")
    return L.best_layers(x, "model", "subject", "layer", "perf")[0].withColumn("mean", F.round("mean", 6))


@query("panel_tops", f"""WITH {RES}, m AS (SELECT roi, model, avg(perf) AS a, coalesce(stddev_samp(perf) / sqrt(count(*)), 0) AS s FROM res GROUP BY 1, 2) SELECT roi, round(greatest(0, max(a + s)), 6) AS top FROM m GROUP BY 1""")
def panel_tops(spark, d):
    return L.row_top(scores(spark, d), ["roi"], ["model"], "perf").withColumn("top", F.round("top", 6))


@query("rates_by_mode", f"""WITH {EV}, r AS (SELECT level, event_type AS mode, outcome = 'win' OR k > 50 AS seen FROM ev WHERE event_type IN ('click', 'view'))
SELECT level, round(coalesce(100 * avg(CAST(seen AS INTEGER)) FILTER (mode = 'click'), 0), 6) AS click, round(coalesce(100 * avg(CAST(seen AS INTEGER)) FILTER (mode = 'view'), 0), 6) AS view FROM r GROUP BY 1""")
def rates_by_mode(spark, d):
    r = plays(spark, d).where("event_type in ('click', 'view')").select("level", F.col("event_type").alias("mode"), ((F.col("outcome") == "win") | (F.col("k") > 50)).alias("seen"))
    return L.rates_by(r, "level", "mode", ["click", "view"], "seen").withColumns({m: F.round(m, 6) for m in ("click", "view")})


PANELS = f"""{surv_sql(2)}, pr AS (SELECT user_id % 3 AS agent, level, time, observed FROM sv), cap AS (SELECT agent, level, max(time) FILTER (observed) AS last FROM pr GROUP BY 1, 2),
pc AS (SELECT agent, level, observed, CASE WHEN NOT observed AND time <= last THEN last + 1 ELSE time END AS time FROM pr JOIN cap USING (agent, level)), gr AS (SELECT i AS point, pow(10.0, i * (4.0 / 8)) AS x FROM (SELECT unnest(range(0, 9)) AS i)),
cu AS (SELECT agent, level, point, x, avg(CASE WHEN observed AND time <= x THEN 1.0 ELSE 0.0 END) AS share FROM pc, gr GROUP BY ALL)"""


@query("panel_curves", f"""{PANELS} SELECT agent, level, CAST(point AS BIGINT) AS point, round(x, 4) AS x, round(share, 6) AS share FROM cu
UNION ALL SELECT agent, NULL, point, round(x, 4), round(avg(share), 6) FROM cu GROUP BY agent, point, x""")
def panel_curves(spark, d):
    r = S.survival_table(eps(spark, d), ["user_id"]).select((F.col("user_id") % 3).alias("agent"), "level", "time", "observed")
    return L.curves(r, ["agent"], ["level"], S.log_grid(spark, 9, 4.0)).select("agent", "level", "point", F.round("x", 4).alias("x"), F.round("share", 6).alias("share"))


@query("density_peaks", f"""{CAPPED}, v AS (SELECT level, log10(greatest(time, 1)) AS v FROM sv WHERE observed), n AS (SELECT level, count(*) AS n, stddev_pop(v) AS sd FROM v GROUP BY 1),
k AS (SELECT level, point, round(CASE WHEN max(n) >= 2 AND max(sd) >= 1e-10 THEN sum(exp(-0.5 * pow((log10(x) - v) / 0.3, 2))) / (max(n) * 0.3 * sqrt(2 * pi())) ELSE 0 END, 9) AS density FROM v JOIN n USING (level), gr GROUP BY level, point)
SELECT level, CAST(point AS BIGINT) AS point, round(density, 6) AS density FROM k WHERE density > 0 QUALIFY row_number() OVER (PARTITION BY level ORDER BY density DESC, point) = 1""")
def density_peaks(spark, d):
    rows = S.survival_table(eps(spark, d), ["user_id"]).where("observed").withColumnRenamed("time", "value")
    k = S.gaussian_density(rows, ["level"], S.log_grid(spark, 41, 4.0)).withColumn("density", F.round("density", 9))
    return L.peaks(k, ["level"]).withColumn("density", F.round("density", 6))


@query("executions", f"WITH {EPISODES} SELECT user_id, level, CAST(steps AS BIGINT) AS steps FROM epx WHERE level < 9 AND outcome = 'win' AND i > fw")
def executions(spark, d):
    return L.executions(eps(spark, d), PLAY)
