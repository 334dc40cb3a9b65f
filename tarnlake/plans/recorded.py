"""Queries over decisions, trials and catalogues, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.operators import catalog as C
from tarnlake.operators import texts as X
from tarnlake.operators import trials as T
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


@query("decisions", f"""WITH {EV}, f AS (SELECT user_id, row_number() OVER u - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, sec, steps AS score, CASE WHEN k % 3 = 0 THEN event_type END AS action, k >= 80 AS e,
  CASE WHEN k >= 95 THEN 1 WHEN k >= 90 THEN 0 END AS win FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT a.user_id, a.i, a.n, a.action, b.sec, b.score AS before, a.score, a.e, a.win, c.e AS ce, c.win AS cwin, c.score AS cscore, z.e AS ze, z.win AS zwin,
    row_number() OVER (PARTITION BY a.user_id ORDER BY a.i) - 1 AS step, row_number() OVER (PARTITION BY a.user_id ORDER BY a.i DESC) AS back
  FROM f a JOIN f b ON b.user_id = a.user_id AND b.i = a.i - 1 LEFT JOIN f c ON c.user_id = a.user_id AND c.i = a.i + 1 JOIN f z ON z.user_id = a.user_id AND z.i = a.n - 1 WHERE a.action IS NOT NULL),
o AS (SELECT *, CASE WHEN e THEN 'own' WHEN ce THEN 'next' WHEN back = 1 AND ze THEN 'last' ELSE 'none' END AS src FROM t),
p AS (SELECT *, CASE src WHEN 'own' THEN win WHEN 'next' THEN cwin WHEN 'last' THEN zwin END AS w, CASE WHEN src = 'next' THEN cscore ELSE score END AS s FROM o)
SELECT user_id, CAST(step AS BIGINT) AS step, CAST(i - 1 AS BIGINT) AS frame, sec AS seen_at, action, s AS score, s - before AS reward, src <> 'none' AND coalesce(w = 1, false) AS won, src <> 'none' AND coalesce(w = 0, false) AS lose, src <> 'none' AND w IS NULL AS timeout FROM p""")
def decisions(spark, d):
    k = F.col("k")
    f = plays(spark, d).select("user_id", *ORDER, "sec", F.col("steps").alias("score"), F.when(k % 3 == 0, F.col("event_type")).alias("action"), (k >= 80).alias("ended"), F.when(k >= 95, True).when(k >= 90, False).alias("win"))
    return T.decisions(f, ["user_id"], ORDER, "sec", "action").withColumns({c: F.col(c).cast("long") for c in ("step", "frame")})


@query("trial_starts", f"""WITH {EV}, r AS (SELECT *, k // 50 AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev WHERE k % 10 <> 0),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, level, attempt ORDER BY i) AS isle FROM r),
runs AS (SELECT user_id, level, attempt, isle, min(i) AS a, max(i) AS b, sum(steps) AS total FROM g GROUP BY ALL)
SELECT s.event_id, s.level, s.attempt, CASE p.outcome WHEN 'win' THEN 'won' WHEN 'loss' THEN 'died' END AS ended_as, CAST(q.total AS BIGINT) AS ended_score
FROM runs x JOIN r s ON s.user_id = x.user_id AND s.i = x.a JOIN runs q ON q.user_id = x.user_id AND q.b = x.a - 1 JOIN r p ON p.user_id = q.user_id AND p.i = q.b""")
def trial_starts(spark, d):
    s = plays(spark, d).withColumns({"attempt": F.expr("k div 50"), "action": F.when(F.col("k") % 10 == 0, F.concat(F.lit("_"), "event_type")).otherwise(F.col("event_type")), "reward": F.col("steps"), "won": F.col("outcome") == "win", "lose": F.col("outcome") == "loss", "timeout": F.lit(False)})
    return T.trial_starts(s, ["user_id"], ORDER, ["level", "attempt"], "action").select("event_id", "level", "attempt", "ended_as", "ended_score")


@query("interaction_coverage", f"""WITH {EV}, x AS (SELECT user_id, k, CASE k % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'BLUE' END || '/' || event_type || '/' || CASE WHEN steps % 2 = 0 THEN 'RED' ELSE 'GREEN' END AS it FROM ev),
s AS (SELECT DISTINCT user_id, it FROM x WHERE it IS NOT NULL), kn AS (SELECT DISTINCT user_id, it FROM x WHERE it IS NOT NULL AND k < 30)
SELECT user_id, CAST(count(*) FILTER (s.it IS NOT NULL) AS BIGINT) AS seen, CAST(CASE WHEN count(kn.it) > 0 THEN count(*) ELSE 0 END AS BIGINT) AS known,
  CASE WHEN count(kn.it) > 0 THEN round(count(s.it) / count(*), 6) ELSE 0.0 END AS coverage FROM s FULL JOIN kn USING (user_id, it) GROUP BY user_id""")
def interaction_coverage(spark, d):
    colour = F.when(F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "red").otherwise("RED")).when(F.col("k") % 3 == 1, "Blue")
    e = plays(spark, d).select("user_id", "k", colour.alias("colour"), F.upper("event_type").alias("effect"), F.when(F.col("steps") % 2 == 0, "red").otherwise("green").alias("other"))
    known = e.where("k < 30 and colour is not null")
    return T.interaction_coverage(e.drop("k"), known, ["user_id"]).withColumn("coverage", F.round("coverage", 6))


@query("first_colours", f"""WITH {EV}, h AS (SELECT *, row_number() OVER (PARTITION BY user_id, level, event_type ORDER BY ts, event_id) AS i FROM ev)
SELECT user_id, event_type, CAST(k AS VARCHAR) AS colour FROM h WHERE i = 1 AND k % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY level) = 1""")
def first_colours(spark, d):
    o = plays(spark, d).withColumns({"colour": F.when(F.col("k") % 4 != 0, F.col("k").cast("string")), "place": F.struct(*ORDER)})
    return T.first_colours(o, ["user_id"], ["level"], "place", "event_type", "colour")


@query("grid_sizes", f'WITH {EV} SELECT user_id, level, CAST(greatest(0, floor(max(value) / 10)) + 1 AS BIGINT) AS columns, CAST(max(k) // 10 + 1 AS BIGINT) AS "rows" FROM ev GROUP BY ALL')
def grid_sizes(spark, d):
    return T.grid_sizes(plays(spark, d), ["user_id", "level"], "value", "k", 10)


@query("occupied", f"""WITH {EV} SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS gx, k // 10 AS gy FROM ev WHERE value >= 0 AND value < 80 AND k < 80 GROUP BY ALL""")
def occupied(spark, d):
    return T.occupied(plays(spark, d), ["user_id"], "event_type", "value", "k", 10, 8, 8)


@query("out_of_order", f"""WITH {EV}, a AS (SELECT *, lag(k // 10) OVER u AS o, lag(steps) OVER u AS s FROM ev WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM a WHERE k // 10 < o OR (k // 10 = o AND steps < s)""")
def out_of_order(spark, d):
    return T.out_of_order(plays(spark, d).withColumn("outer", F.expr("k div 10")), ["user_id"], ORDER, "outer", "steps").select("event_id")


@query("clock_drift", f"""WITH {EV}, a AS (SELECT user_id, event_id, sec FROM ev WHERE event_id % 11 <> 0), b AS (SELECT user_id, event_id, sec + (event_id % 7) / 50.0 AS sec FROM ev)
SELECT user_id, round(max(abs(a.sec - b.sec)) * 1000, 1) AS drift_ms, count(a.sec) = count(*) AND coalesce(max(event_id % 7) FILTER (a.sec IS NOT NULL) <= 4, false) AS ok FROM a FULL JOIN b USING (user_id, event_id) GROUP BY 1""")
def clock_drift(spark, d):
    e = plays(spark, d)
    out = T.clock_drift(e.where("event_id % 11 <> 0"), e.withColumn("sec", F.col("sec") + (F.col("event_id") % 7) / 50.0), ["user_id"], "event_id", "sec", 90.0)
    return out.withColumn("drift_ms", F.round("drift_ms", 1))


@query("policy_summary", f"""WITH {EV}, p AS (SELECT user_id, level, value, k / 100.0 AS p FROM ev)
SELECT user_id, level, CAST(count(*) AS BIGINT) AS n_states, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(avg(-p * ln(greatest(p, 1e-12)) - (1 - p) * ln(greatest(1 - p, 1e-12))), 6) AS mean_entropy FROM p GROUP BY ALL""")
def policy_summary(spark, d):
    p = plays(spark, d).withColumn("policy", F.array(F.col("k") / 100.0, 1 - F.col("k") / 100.0))
    out = T.policy_summary(p, ["user_id", "level"], "value", "policy")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "std_value", "mean_entropy")})


@query("session_totals", f"""WITH {EV} SELECT user_id, CAST(coalesce(sum(k) FILTER (k % 5 <> 0), 0) AS BIGINT) AS tokens, CAST(sum(steps) AS BIGINT) AS cost, CAST(count(*) AS BIGINT) AS n_steps, CAST(count(*) FILTER (outcome = 'win') AS BIGINT) AS wins, CAST(count(*) FILTER (outcome = 'loss') AS BIGINT) AS losses FROM ev GROUP BY 1""")
def session_totals(spark, d):
    s = plays(spark, d).select("user_id", F.when(F.col("k") % 5 != 0, F.col("k")).alias("tokens"), F.col("steps").alias("cost"), (F.col("outcome") == "win").alias("won"), (F.col("outcome") == "loss").alias("lose"))
    return T.session_totals(s, ["user_id"], ["tokens", "cost"])


@query("broken_continuations", f"""WITH {EV} SELECT event_id FROM ev WHERE event_type <> 'view' AND NOT (k < steps + 50 AND k % 2 = 0 AND level = 0)""")
def broken_continuations(spark, d):
    n = F.col("steps") + 49
    r = plays(spark, d).select("event_id", (F.col("event_type") != "view").alias("resumed"), F.col("k").alias("resumed_from"), n.alias("n_actions"), (n + F.col("k") % 2).alias("total_steps"), F.col("level").alias("first_attempt"), F.lit(0.0).alias("first_time"))
    return T.broken_continuations(r).select("event_id")


def artifacts(spark, d):
    """An artifact per event, with a key like those of released files."""
    e, k = plays(spark, d), F.col("k")
    who = F.when(k % 5 == 0, "subj").when(k % 5 == 1, "sub-0").when(k % 5 == 2, "x").otherwise("sub-")
    model = F.when(k % 3 == 0, F.concat(F.lit("/model-"), "event_type")).otherwise(F.lit("/none"))
    tail = F.when(k % 2 == 0, "|copied-reasoning/oracle|minimal").otherwise("/all")
    return e.select("event_id", "user_id", "event_type", "steps", "k", "outcome", F.concat(F.lit("a/"), who, F.col("user_id").cast("string"), model, tail, F.lit("/f.npz")).alias("key"))


@query("key_tokens", f"""WITH {EV} SELECT event_id, CASE WHEN k % 5 <> 2 THEN 'sub-' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id END AS subject, CASE WHEN k % 3 = 0 THEN 'model-' || event_type || CASE WHEN k % 2 = 0 THEN '|copied-reasoning' ELSE '' END END AS model,
  CASE WHEN k % 2 = 0 THEN 'copied-reasoning' END AS rationale, CASE WHEN k % 2 = 0 THEN 'oracle' END AS suggestion FROM ev""")
def key_tokens(spark, d):
    return artifacts(spark, d).select("event_id", *[c.alias(n) for n, c in C.key_tokens(F.col("key")).items()])


@query("component_totals", f"""WITH {EV} SELECT event_type, CAST(count(*) AS BIGINT) AS files, CAST(sum(steps) AS BIGINT) AS bytes, CAST(count(*) FILTER (k % 4 <> 0) AS BIGINT) AS with_digest FROM ev WHERE outcome IN ('win', 'incomplete') GROUP BY 1""")
def component_totals(spark, d):
    rows = C.chosen(artifacts(spark, d), outcome=["win", "incomplete"], event_type=[]).withColumn("sha", F.when(F.col("k") % 4 != 0, F.sha2("key", 256)).when(F.col("k") % 8 == 0, ""))
    return C.component_totals(rows, ["event_type"], "steps", "sha")


@query("earlier_pins", f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 4 = 0 AND k % 7 <> 0 THEN 'pin' || event_id ELSE 'new' END AS version, event_id % 4 = 0 AND k % 7 <> 0 AS reused FROM ev""")
def earlier_pins(spark, d):
    rows = artifacts(spark, d).select("event_id", F.col("steps").alias("size"), F.when(F.col("k") % 3 != 0, F.col("k")).alias("etag"), F.lit("new").alias("version"), "k")
    moved = F.when(F.col("k") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    pins = rows.where("event_id % 4 = 0").select("event_id", moved.alias("size"), "etag", F.concat(F.lit("pin"), F.col("event_id").cast("string")).alias("version"))
    return C.with_earlier_pins(rows, pins, "event_id", ["size", "etag"], ["version"]).select("event_id", "version", "reused")


@query("unmet_inputs", f"""WITH {EV}, m AS (SELECT event_id, max(event_id) OVER () AS top FROM ev)
SELECT event_id AS path, 'bold' AS input, CASE WHEN event_id + 1 > top THEN 'missing' ELSE 'digest' END AS error FROM m WHERE event_id % 3 = 0 AND (event_id + 1 > top OR event_id % 2 = 0)
UNION ALL SELECT event_id, 'samples', CASE WHEN event_id + 2 > top THEN 'missing' ELSE 'digest' END FROM m WHERE event_id % 5 = 0 AND (event_id + 2 > top OR event_id % 2 = 1)""")
def unmet_inputs(spark, d):
    i = F.col("event_id")
    digest = lambda x: F.sha2(x.cast("string"), 256)
    rows = artifacts(spark, d).select(i.alias("path"), digest(i).alias("sha"), F.when(i % 3 == 0, i + 1).alias("bold"), F.when(i % 2 != 0, digest(i + 1)).otherwise("other").alias("bold_sha"), F.when(i % 5 == 0, i + 2).alias("samples"), F.when(i % 2 == 0, digest(i + 2)).alias("samples_sha"))
    return C.unmet_inputs(rows, "path", "sha", {"bold": ("bold", "bold_sha"), "samples": ("samples", "samples_sha")})


@query("catalogue_report", f"""WITH {EV} SELECT 'rows' AS name, NULL::VARCHAR AS value, CAST(count(*) AS BIGINT) AS n FROM ev UNION ALL SELECT 'late', NULL, CAST(count(*) FILTER (level > 8) AS BIGINT) FROM ev
UNION ALL SELECT 'subjects', NULL, CAST(count(DISTINCT user_id) AS BIGINT) FROM ev UNION ALL SELECT 'outcome', outcome, CAST(count(*) AS BIGINT) FROM ev GROUP BY outcome UNION ALL SELECT 'level', CAST(level AS VARCHAR), CAST(count(*) AS BIGINT) FROM ev GROUP BY level""")
def catalogue_report(spark, d):
    return C.report(plays(spark, d), {"late": F.col("level") > 8}, {"subjects": "user_id"}, ["outcome", "level"])


@query("merged_counters", f"""WITH {EV} SELECT level, event_type AS name, CAST(sum(steps) AS BIGINT) AS n FROM ev WHERE k % 2 = 1 GROUP BY 1, 2 UNION ALL SELECT level, 'frames', CAST(sum(k) AS BIGINT) FROM ev GROUP BY 1""")
def merged_counters(spark, d):
    one = F.map_from_arrays(F.array(F.lit("frames"), "event_type"), F.array("k", "steps"))
    rows = plays(spark, d).select("level", F.when(F.col("k") % 2 == 1, one).otherwise(F.create_map(F.lit("frames"), "k")).alias("counters"))
    return C.merged_counters(rows, "counters", ["level"])


@query("contradicted", f"""WITH {EV} SELECT event_id FROM ev WHERE k % 3 = 0 AND user_id % 10 <> k % 10""")
def contradicted(spark, d):
    named = F.regexp_extract(F.concat(F.lit("sub-"), (F.col("user_id") % 10).cast("string"), F.lit(".npz")), r"^sub-(\d+)\.npz$", 1)
    rows = plays(spark, d).select("event_id", F.when(F.col("k") % 3 == 0, F.col("k") % 10).alias("subject"), named.alias("named"))
    return C.contradicted(rows, {"subject": "named"}).select("event_id")


@query("wall_texts", f"""WITH {EV}, w AS (SELECT user_id, k % 5 AS x, steps % 5 AS y FROM ev WHERE event_type <> 'view'), d AS (SELECT DISTINCT * FROM w),
up AS (SELECT *, EXISTS (SELECT 1 FROM d b WHERE b.user_id = a.user_id AND b.x = a.x AND b.y = a.y - 1) AS below FROM d a), ui AS (SELECT *, sum(CASE WHEN below THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, x ORDER BY y) AS isle FROM up),
tall AS (SELECT user_id, x, isle, min(y) AS a, max(y) AS b FROM ui GROUP BY ALL HAVING count(*) > 2), l AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM tall t WHERE t.user_id = d.user_id AND t.x = d.x AND d.y BETWEEN t.a AND t.b)),
si AS (SELECT *, sum(CASE WHEN EXISTS (SELECT 1 FROM l b WHERE b.user_id = l.user_id AND b.y = l.y AND b.x = l.x - 1) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, y ORDER BY x) AS isle FROM l),
wide AS (SELECT user_id, y, isle, min(x) AS a, max(x) AS b FROM si GROUP BY ALL),
parts AS (SELECT user_id, 0 AS n, x AS f, a AS s, '(' || x || ', ' || a || '-' || b || ')' AS t FROM tall UNION ALL SELECT user_id, 1, y, a, '(' || a || '-' || b || ', ' || y || ')' FROM wide WHERE b > a UNION ALL SELECT user_id, 2, a, y, '(' || a || ', ' || y || ')' FROM wide WHERE b = a),
r AS (SELECT user_id, count(*) AS c, string_agg(t, ', ' ORDER BY n, f, s) AS t FROM parts GROUP BY 1)
SELECT user_id, CASE WHEN c > 20 THEN (SELECT count(*) FROM w WHERE w.user_id = r.user_id) || ' wall positions (borders)' ELSE t END AS walls FROM r""")
def wall_texts(spark, d):
    w = plays(spark, d).where("event_type <> 'view'").select("user_id", (F.col("k") % 5).alias("x"), (F.col("steps") % 5).alias("y"))
    return X.wall_texts(w, ["user_id"])


@query("observation_texts", f"""WITH {EV}, e AS (SELECT user_id, event_id, event_type, k, steps FROM ev WHERE event_type <> 'view'), f AS (SELECT user_id, count(*) AS n, sum(k) AS score, min(k) - 20 AS reward FROM ev GROUP BY 1),
o AS (SELECT user_id, string_agg('- ' || CASE WHEN k % 2 = 0 THEN 'RED' ELSE upper(event_type) END || ' at (' || k || ',' || steps || ')', chr(10) ORDER BY event_id) AS t FROM e GROUP BY 1)
SELECT user_id, 'Grid: ' || n || 'x2' || chr(10) || CASE WHEN score % 3 > 0 THEN 'Inventory: GOLD: ' || score % 3 || chr(10) ELSE '' END || 'Score: ' || score || CASE WHEN reward > 0 THEN ' (+' || reward || ')' WHEN reward < 0 THEN ' (' || reward || ')' ELSE '' END || chr(10) || 'Objects:' || chr(10) || coalesce(t, '- none') AS text FROM f LEFT JOIN o USING (user_id)""")
def observation_texts(spark, d):
    e, kind = plays(spark, d), F.when(F.col("event_type") == "view", "floor").otherwise(F.col("event_type"))
    held = F.array(F.struct(F.lit("GOLD").alias("label"), (F.col("score") % 3).alias("n")))
    f = e.groupBy("user_id").agg(F.count("*").alias("columns"), F.lit(2).alias("rows"), F.sum("k").alias("score"), (F.min("k") - 20).alias("reward")).withColumn("inventory", held)
    o = e.select("user_id", kind.alias("name"), F.col("event_id").alias("obj_id"), F.when(F.col("k") % 2 == 0, "RED").alias("colour"), F.col("k").alias("x"), F.col("steps").alias("y"))
    return X.observation_texts(f, o, ["user_id"])


@query("outlines", f"""WITH {EV} SELECT event_id, steps + 2 AS lines, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1 END AS last_parent FROM ev""")
def outlines(spark, d):
    """A head, `steps` lines under it, and a last line that is under the head, under the line before's
    head or under nothing."""
    k = F.col("k") % 3
    last = F.when(k == 0, "    b").when(k == 1, "\t    b").otherwise("b")
    text = F.concat_ws("\n", F.lit("a # note"), F.lit(""), F.array_join(F.array_repeat(F.lit("    c"), F.greatest(F.col("steps").cast("int"), F.lit(0))), "\n"), last)
    o = plays(spark, d).select("event_id", k.alias("k"), "steps", X.outline(text).alias("o"))
    place = F.element_at("o", -1)["parent"]
    return o.select("event_id", F.size("o").cast("long").alias("lines"), F.when(F.col("k") == 1, F.col("o")[place]["parent"] + 1).otherwise(place).cast("int").alias("last_parent"))


@query("theory_rows", f"""WITH {EV} SELECT event_id, 'interactions' AS section, event_type AS kind, 'a,b,{{}},True' AS args FROM ev UNION ALL SELECT event_id, 'terminations', 'SpriteCounterRule', 'goal,' || k || ',False' FROM ev WHERE k % 2 = 0 UNION ALL SELECT event_id, 'terminations', 'Other', 'Other goal ' || k || ' False' FROM ev WHERE k % 2 = 1""")
def theory_rows(spark, d):
    rule = F.when(F.col("k") % 2 == 0, "SpriteCounterRule").otherwise("Other")
    text = F.concat(F.lit("InteractionSet:\n  "), "event_type", F.lit(" a b {} generic: True\nnone\nTerminationSet:\n"), rule, F.lit(" goal "), F.col("k").cast("string"), F.lit(" False\n"))
    return X.theory_rows(plays(spark, d).select("event_id", text.alias("t")), ["event_id"], "t").select("event_id", "section", "kind", F.array_join("args", ",").alias("args"))
