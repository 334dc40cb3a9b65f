"""Queries over traces, prompts, measured fields and releases, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.operators import prompts as P
from tarnlake.operators import traces as T
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


NUM = EV + ", nu AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ev)"


def numbered(spark, d):
    return plays(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)


# --- traces ------------------------------------------------------------------------------------

@query("trace_plays", "SELECT lower(lpad(CAST(o_orderkey AS VARCHAR), 24, 'A')) AS play, o_orderkey FROM orders WHERE o_custkey % 3 < 2")
def trace_plays(spark, d):
    """Folders named in two ways, and others that are no plays."""
    o = table(spark, d, "orders")
    name = F.lpad(F.col("o_orderkey").cast("string"), 24, "A")
    folder = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("play-"), name)).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("play7_key"), name)).otherwise(F.concat(F.lit("other-"), name))
    found = T.trace_plays(o.select(F.concat(F.lit("root/s1/"), folder, F.lit("/traces.bin")).alias("path")), "path")
    return found.select("play", F.regexp_extract("path", r"(\d+)/traces", 1).cast("long").alias("o_orderkey"))


@query("trace_steps", f"""WITH {NUM}, n AS (SELECT user_id, count(*) AS n FROM nu WHERE event_type = 'view' GROUP BY 1), c0 AS (SELECT user_id, count(*) AS n FROM nu WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT user_id AS play, 'rep' AS layer, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INTEGER) AS step, value AS v FROM nu WHERE event_type = 'view'
  UNION ALL SELECT user_id, 'value', CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS INTEGER), value FROM nu WHERE event_type = 'purchase' AND k % 2 = 0
  UNION ALL SELECT m.user_id, 'dyn', CAST(r.step AS INTEGER), coalesce(x.v, 0) FROM (SELECT u.user_id, coalesce(n.n, c0.n) AS n FROM (SELECT DISTINCT user_id FROM nu WHERE event_type = 'click') u LEFT JOIN n USING (user_id) LEFT JOIN c0 USING (user_id)) m, LATERAL (SELECT unnest(range(m.n)) AS step) r
    LEFT JOIN (SELECT user_id, k // 3 AS step, avg(value) AS v FROM nu WHERE event_type = 'click' GROUP BY 1, 2) x ON x.user_id = m.user_id AND x.step = r.step)
SELECT play, layer, step, round(v, 6) AS v FROM s""")
def trace_steps(spark, d):
    layer = F.when(F.col("event_type") == "view", "rep").when(F.col("event_type") == "purchase", "value").when(F.col("event_type") == "click", "dyn").otherwise("else")
    e = numbered(spark, d).select(F.col("user_id").alias("play"), layer.alias("layer"), F.col("i").alias("pos"), F.expr("k div 3").alias("timestep"), F.when(F.col("k") % 2 == 0, "initial").otherwise("step").alias("phase"), F.array("value").alias("vector"))
    kinds = spark.createDataFrame([("rep", "representation"), ("value", "value"), ("dyn", "dynamics")], "layer string, kind string")
    return T.trace_steps(e.where("layer <> 'else'"), kinds).select("play", "layer", "step", F.round(F.col("vector")[0], 6).alias("v"))


@query("met_plays", f"WITH {EV}, p AS (SELECT user_id, level, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, level, CAST(n AS BIGINT) AS n, CASE WHEN level % 5 = 4 THEN 'no such play' WHEN (user_id + level) % 7 = 0 THEN 'no such run' ELSE 'met' END AS how FROM p")
def met_plays(spark, d):
    p = plays(spark, d).groupBy("user_id", "level").agg(F.count("*").alias("n")).withColumn("play", F.concat_ws("-", "user_id", "level"))
    measured = p.where("level % 5 <> 4 or level < 0").select("play", F.col("user_id").alias("subject"), F.col("level").alias("run"))
    runs = p.where("(user_id + level) % 7 <> 0").select(F.col("user_id").alias("subject"), F.col("level").alias("run"))
    met, skipped = T.met_plays(p, measured, runs, "play", ["subject", "run"])
    all_ = met.select("play", F.lit("met").alias("how")).unionByName(skipped.withColumnRenamed("reason", "how"))
    return p.join(all_, "play").select("user_id", "level", "n", "how")


@query("turns_of_plays", f"""WITH {NUM}, f AS (SELECT user_id, level, min(i) AS i0, arg_min(k, i) AS t0 FROM nu GROUP BY 1, 2), l AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY t0, i0) - 1 AS local FROM f)
SELECT event_id, CAST(local AS INTEGER) AS local, CAST(row_number() OVER (PARTITION BY user_id, level ORDER BY i) - 1 AS INTEGER) AS step FROM nu JOIN l USING (user_id, level)""")
def turns_of_plays(spark, d):
    return T.turns_of_plays(numbered(spark, d), ["user_id"], "level", "i", "k").select("event_id", "local", "step")


@query("attempts", f"WITH {NUM} SELECT event_id, CAST(i AS INTEGER) AS trial, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) - 1 AS INTEGER) AS attempt, k % 4 = 0 AS moved FROM nu")
def attempts(spark, d):
    a = T.attempts(plays(spark, d), ["user_id"], "event_type", ORDER)
    return a.select("event_id", "trial", "attempt", T.is_sampled(F.col("k"), F.lit(True), False, 4).alias("moved"))


@query("common_resolution", """WITH s AS (SELECT l_linenumber AS layer, CAST(l_partkey // 4 AS BIGINT) AS n FROM lineitem WHERE l_partkey >= 4), d AS (SELECT layer, n, CASE WHEN n % 30 = 0 THEN 30 WHEN n % 25 = 0 THEN 25 WHEN n % 20 = 0 THEN 20 WHEN n % 15 = 0 THEN 15 WHEN n % 10 = 0 THEN 10 END AS w FROM s),
h AS (SELECT layer, CASE WHEN w IS NOT NULL THEN n // w ELSE list_max(list_filter(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1), lambda x: n % x = 0)) END AS h, n, w FROM d)
SELECT layer, CAST(min(h) AS BIGINT) AS h, CAST(min(coalesce(w, n // h)) AS BIGINT) AS w FROM h GROUP BY 1""")
def common_resolution(spark, d):
    li = table(spark, d, "lineitem").where("l_partkey >= 4")
    return T.common_resolution(li.withColumn("channels", F.lit(4)).withColumnRenamed("l_linenumber", "layer"), "layer", "l_partkey", "channels")


# --- prompts -----------------------------------------------------------------------------------

@query("message_rows", f"""WITH {NUM}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS j FROM nu WHERE event_type <> 'view')
SELECT DISTINCT user_id, CAST(0 AS INTEGER) AS place, 'system' AS role, 'be ' || user_id AS content, CAST(-1 AS BIGINT) AS upto FROM nu
UNION ALL SELECT user_id, CAST(2 * j - 1 AS INTEGER), 'user', CASE WHEN k = 7 THEN 'ended' || chr(10) ELSE '' END || '# Step ' || i || ' (Level ' || level || ', Attempt ' || k || ')' || chr(10) || chr(10) || 'see ' || k, i FROM r
UNION ALL SELECT user_id, CAST(2 * j AS INTEGER), 'assistant', '{{"action":"' || event_type || '"}}', i FROM r""")
def message_rows(spark, d):
    n = numbered(spark, d)
    response = F.create_map(F.lit("rationale"), F.lit("why"), F.lit("action"), F.col("event_type"))
    steps = n.select("user_id", "i", F.when(F.col("event_type") == "view", "_level_advance").otherwise(F.col("event_type")).alias("action"), "level", F.col("k").alias("attempt"), F.concat(F.lit("see "), F.col("k").cast("string")).alias("observation"), F.when(F.col("k") == 7, "ended").alias("between"), response.alias("response"))
    sessions = n.select("user_id").distinct().withColumn("system", F.concat(F.lit("be "), F.col("user_id").cast("string")))
    return P.message_rows(steps, sessions, ["user_id"], "i", "action-only")


@query("filled_templates", f"WITH {EV} SELECT event_id, 'the ' || CASE event_type WHEN 'error' THEN '{{error}}' ELSE upper(event_type) || '1' END || ' and {{none}} ' || CASE event_type WHEN 'click' THEN 'CLICK1' ELSE '{{click}}' END AS text FROM ev")
def filled_templates(spark, d):
    """Each event's type stands for itself and a digit; errors are in no map."""
    values = F.when(F.col("event_type") == "error", F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.col("event_type"), F.concat("event_type", F.lit("1"))))
    template = F.concat(F.lit("the {"), F.col("event_type"), F.lit("} and {none} {click}"))
    return plays(spark, d).select("event_id", P.filled_template(template, values).alias("text"))


@query("recoloured_texts", f"WITH {EV} SELECT event_id, 'wall > Immovable img=colors/GREY' || chr(10) || ' a ' || event_type || ' > Mover img=colors/' || CASE WHEN k % 2 = 0 THEN 'NEW' ELSE 'OLD' END || ' color=' || CASE WHEN k % 2 = 0 THEN 'NEW' ELSE 'OLD' END || chr(10) || 'x img=colors/OLD' AS text FROM ev")
def recoloured_texts(spark, d):
    text = F.concat(F.lit("wall > Immovable img=colors/GREY\n a "), F.col("event_type"), F.lit(" > Mover img=colors/OLD color=OLD\nx img=colors/OLD"))
    colours = F.create_map(F.when(F.col("k") % 2 == 0, F.col("event_type")).otherwise("no type"), F.lit("NEW"))
    return plays(spark, d).select("event_id", P.recoloured(text, colours).alias("text"))


@query("flat_effects", f"WITH {EV} SELECT event_id, CASE k % 4 WHEN 0 THEN 'stepBack ' || event_type WHEN 1 THEN 'stepBack ' || event_type || ',kill x' WHEN 2 THEN 'stepBack ' || event_type || ',kill x,push y' ELSE '' END AS effects FROM ev")
def flat_effects(spark, d):
    one = F.concat(F.lit('["stepBack","'), F.col("event_type"), F.lit('"]'))
    way = F.col("k") % 4
    stored = F.when(way == 0, one).when(way == 1, F.concat(F.lit("["), one, F.lit(',["kill","x"]]'))).when(way == 2, F.concat(F.lit("[["), one, F.lit(',["kill","x"]],[],["push","y"]]'))).when(F.col("k") % 8 == 3, F.lit("[]"))
    return plays(spark, d).select("event_id", F.array_join(F.transform(P.flat_effects(stored), lambda x: F.array_join(x, " ")), ",").alias("effects"))


@query("measured_sprites", f"WITH {EV} SELECT event_id, CAST(3 * k AS BIGINT) AS \"left\", CAST(steps AS BIGINT) AS top FROM ev")
def measured_sprites(spark, d):
    """Pixels from cells of 8 pixels, in which they are fractions; the rounding to whole ones is checked."""
    s = plays(spark, d).select("event_id", F.col("event_type").alias("kind"), F.lit("k").alias("source_key"), F.lit("u").alias("uid"), F.col("k").alias("x"), F.col("steps").alias("y"), F.lit("RED").alias("colour"), (3 * F.col("k") / 8).alias("col"), (F.col("steps") / 8).alias("row"), F.lit(8).alias("block"))
    return P.measured_sprites(s, ["event_id"]).select("event_id", "left", "top")


@query("viewer_sprites", f"WITH {EV} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS id, round(CASE WHEN k % 2 = 0 THEN k ELSE steps END / 8.0, 6) AS col, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS held FROM ev")
def viewer_sprites(spark, d):
    p = plays(spark, d)
    s = p.select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("left"), F.col("k").alias("top"), F.col("steps").alias("x"), F.col("k").alias("y"), F.create_map(F.lit("coin"), F.col("k") % 3).alias("resources"), F.lit("u").alias("uid"), F.lit(8).alias("block"))
    v = P.viewer_sprites(s.withColumn("uid", F.col("event_id")), ["user_id"], ["ts", "event_id"])
    return v.select(F.col("uid").alias("event_id"), "id", F.round("col", 6).alias("col"), F.size("resources").alias("held"))


@query("labelled_objects", f"WITH {EV}, o AS (SELECT user_id, k, max(CASE WHEN steps % 2 = 0 THEN 'RED' END) AS c FROM ev WHERE event_type = 'click' GROUP BY 1, 2) SELECT event_id, event_type || coalesce('/' || c, '') AS label FROM ev LEFT JOIN o USING (user_id, k)")
def labelled_objects(spark, d):
    p = plays(spark, d)
    objects = p.where("event_type = 'click'").select("user_id", "k", F.when(F.col("steps") % 2 == 0, "RED").alias("colour"))
    return P.labelled(p.select("event_id", "user_id", "k", "event_type"), objects, ["user_id"], "event_type", "k").select("event_id", "label")


@query("block_sizes", f"WITH {NUM} SELECT user_id, CAST(arg_min(k, i) FILTER (k % 3 > 0) AS BIGINT) AS block FROM nu GROUP BY 1 HAVING count(*) FILTER (k % 3 > 0) > 0")
def block_sizes(spark, d):
    n = numbered(spark, d).withColumn("size", F.when(F.col("k") % 3 > 0, F.col("k")))
    some = n.where("size is not null").select("user_id").distinct()
    return P.block_size(n.join(some, "user_id", "left_semi"), ["user_id"], "size", ["i"])


@query("recording_paths", f"WITH {EV} SELECT DISTINCT user_id, level, 'sub-' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id || '/' || event_type || '/' || CASE WHEN level % 2 = 0 THEN 'oracle' ELSE 'minimal' END || '.human.replay.json.gz' AS path, level % 3 = 0 AS foreign_ FROM ev WHERE level >= 0")
def recording_paths(spark, d):
    p = plays(spark, d).where("level >= 0").select("user_id", "level", "event_type").distinct()
    p = p.withColumn("path", P.recording_path(F.col("user_id"), F.col("event_type"), F.when(F.col("level") % 2 == 0, "oracle").otherwise("minimal")))
    said = p.withColumn("game", F.when(F.col("level") % 3 == 0, "another").otherwise(F.col("event_type")))
    bad = P.foreign_paths(said, "path", "user_id", "game").select("user_id", "level", "path", F.lit(True).alias("foreign_"))
    return p.join(bad, ["user_id", "level", "path"], "left").select("user_id", "level", "path", F.coalesce("foreign_", F.lit(False)).alias("foreign_"))


# --- releases ----------------------------------------------------------------------------------

MAPPING = "m AS (SELECT c_custkey + c_custkey % 50 // 49 * 1000000 AS key, CASE WHEN c_custkey % 7 = 0 THEN 'exclude' WHEN c_custkey % 31 = 0 THEN 'maybe' ELSE 'include' END AS action, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'why' END AS reason FROM customer WHERE c_custkey % 11 > 0)"


def mapping(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    key = F.when(k % 50 == 49, k + 1_000_000).otherwise(k).alias("key")
    action = F.when(k % 7 == 0, "exclude").when(k % 31 == 0, "maybe").otherwise("include").alias("action")
    m = c.where("c_custkey % 11 > 0").select(key, action, F.when(k % 13 == 0, "").otherwise("why").alias("selection_reason"))
    return P.mapped(c.select(k.alias("key"), "c_nationkey"), m, "key")


@query("mapped_rows", f"WITH {MAPPING} SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS nation FROM customer JOIN m ON key = c_custkey WHERE action = 'include' AND reason <> ''")
def mapped_rows(spark, d):
    return mapping(spark, d)[0].select("key", F.col("c_nationkey").cast("long").alias("nation"))


@query("mapping_errors", f"WITH {MAPPING} SELECT coalesce(c_custkey, key) AS key, CASE WHEN key IS NULL THEN 'no mapping' WHEN c_custkey IS NULL THEN 'no source' WHEN action = 'maybe' THEN 'no action' ELSE 'no reason' END AS error FROM customer FULL JOIN m ON key = c_custkey WHERE key IS NULL OR c_custkey IS NULL OR action = 'maybe' OR reason = ''")
def mapping_errors(spark, d):
    return mapping(spark, d)[1]


@query("catalogue_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def catalogue_rows(spark, d):
    index = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.catalogue_rows(index, table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
