"""Queries over observations, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.functions import text as T
from tarnlake.operators import observations as O
from tarnlake.plans.behaviour import ORDER, PLAY
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


NUM = EV + ", nv AS (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY ts, event_id) - 1 AS i FROM ev)"


@query("sampled", f"WITH {NUM} SELECT event_id FROM nv WHERE i % 4 = 0 AND event_type NOT IN ('view')")
def sampled(spark, d):
    return O.every(plays(spark, d), PLAY, ORDER, 4).where("event_type <> 'view'").select("event_id")


@query("key_moments", f"""WITH {EV}, m AS (SELECT *, lag(k // 25) OVER (PARTITION BY user_id, level ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id, level, event_type ORDER BY ts, event_id) AS r FROM ev)
SELECT event_id, CASE WHEN outcome IN ('win', 'loss') THEN 'outcome' WHEN k // 25 <> p THEN 'score' WHEN r = 1 THEN 'first' END AS reason FROM m WHERE outcome IN ('win', 'loss') OR k // 25 <> p OR r = 1""")
def key_moments(spark, d):
    p = plays(spark, d).withColumn("score", F.expr("k div 25"))
    return O.key_moments(p, PLAY, ORDER, "outcome", "score", "event_type").select("event_id", "reason")


@query("sampled_ways", f"""WITH {EV} SELECT 'all' AS way, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM ev UNION ALL SELECT 'non_wait', CAST(count(*) AS BIGINT), CAST(sum(event_id) AS BIGINT) FROM ev WHERE event_type NOT IN ('view', 'error')""")
def sampled_ways(spark, d):
    p = plays(spark, d)
    parts = [O.sampled(p, "all").withColumn("way", F.lit("all")), O.sampled(p, "non_wait", action="event_type", waits=("view", "error")).withColumn("way", F.lit("non_wait"))]
    return parts[0].unionByName(parts[1]).groupBy("way").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("tagged_values", f"""WITH {EV} SELECT event_id, CASE WHEN k % 4 = 0 THEN '{{{{"tag":"float","value":"nan"}}}}' WHEN k % 4 = 1 THEN '{{{{"tag":"float","value":"-inf"}}}}' ELSE CAST(k AS VARCHAR) || '.0' END AS number, '{{{{"tag":"datetime","iso":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}}}}' AS time, true AS same FROM ev""".replace("{{", "{").replace("}}", "}"))
def tagged_values(spark, d):
    """Doubles, some of them no numbers, and times as tagged JSON and back."""
    k = F.col("k")
    x = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("-inf")).otherwise(k.cast("double"))
    p = plays(spark, d).select("event_id", x.alias("x"), F.col("ts").cast("timestamp").alias("ts")).withColumns({"number": T.tagged(F.col("x"), "double", "tag"), "time": T.tagged(F.col("ts"), "timestamp", "tag")})
    back = F.col("x").eqNullSafe(T.untagged(F.col("number"), "double", "tag")) & F.col("ts").eqNullSafe(T.untagged(F.col("time"), "timestamp", "tag"))
    return p.select("event_id", "number", "time", back.alias("same"))


OBJ = NUM + ", ob AS (SELECT user_id, level, i AS frame, event_type AS colour, event_id AS uid, k AS x, steps AS y FROM nv)"


def objects(spark, d):
    w = Window.partitionBy(*PLAY).orderBy(*ORDER)
    return plays(spark, d).select(*PLAY, (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("event_type").alias("colour"), F.col("event_id").alias("uid"), F.col("k").alias("x"), F.col("steps").alias("y"))


@query("next_positions", f"WITH {OBJ} SELECT a.user_id, a.level, a.frame, coalesce(b.x, a.x) AS x, coalesce(b.y, a.y) AS y FROM ob a LEFT JOIN ob b ON a.user_id = b.user_id AND a.level = b.level AND b.frame = a.frame + 1")
def next_positions(spark, d):
    return O.next_position(objects(spark, d).drop("colour", "uid"), PLAY, "frame", ["x", "y"])


@query("resolved_objects", f"""WITH {EV}, o AS (SELECT user_id AS play, level AS frame, event_type AS colour, min(event_id) AS uid FROM ev WHERE k < 40 GROUP BY ALL),
e AS (SELECT DISTINCT user_id AS play, level AS frame, event_type AS colour FROM ev WHERE k >= 60)
SELECT e.play, e.frame, e.colour, coalesce(b.uid, c.uid) AS uid FROM e LEFT JOIN o b ON e.play = b.play AND e.colour = b.colour AND b.frame = e.frame - 1 LEFT JOIN o c ON e.play = c.play AND e.colour = c.colour AND c.frame = e.frame""")
def resolved_objects(spark, d):
    p = plays(spark, d).select(F.col("user_id").alias("play"), F.col("level").alias("frame"), F.col("event_type").alias("colour"), F.col("event_id").alias("uid"), "k")
    return O.resolved(p.where("k >= 60").select("play", "frame", "colour").distinct(), p.where("k < 40").drop("k"), "play", "frame", "colour", "uid")


@query("collisions", f"WITH {OBJ} SELECT a.user_id, a.level, a.uid, b.uid AS other FROM ob a JOIN ob b ON a.user_id = b.user_id AND a.level = b.level AND a.uid < b.uid AND abs(a.x - b.x) < 10 AND abs(a.y - b.y) < 10")
def collisions(spark, d):
    return O.overlaps(objects(spark, d), PLAY, "uid", 10.0)


@query("mask_places", """WITH m AS (SELECT DISTINCT l_suppkey % 4 AS s, l_partkey AS x, l_linenumber AS y FROM lineitem), c AS (SELECT x, y FROM m GROUP BY 1, 2 HAVING count(*) = 4),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x, y) - 1 AS place FROM m) SELECT s, x, y, CAST(place AS INTEGER) AS place FROM p SEMI JOIN c USING (x, y)""")
def mask_places(spark, d):
    m = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("s"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("y")).distinct()
    common = m.groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 4")
    return O.index_in(m, common, ["s"], ["x", "y"])


@query("region_members", """SELECT r.region, CAST(count(*) AS BIGINT) AS voxels, round(avg(p_retailprice), 4) AS score FROM part
JOIN (SELECT 'small' AS region, unnest(range(1, 21)) AS code UNION ALL SELECT 'middle', unnest(range(15, 36)) UNION ALL SELECT 'all', unnest(range(1, 51))) r ON p_size = code GROUP BY 1""")
def region_members(spark, d):
    r = spark.createDataFrame([("small", list(range(1, 21))), ("middle", list(range(15, 36))), ("all", list(range(1, 51)))], "region string, codes array<int>")
    v = table(spark, d, "part").select(F.col("p_size").alias("code"), "p_retailprice")
    return O.members(v, r, "code").groupBy("region").agg(F.count("*").alias("voxels"), F.round(F.avg("p_retailprice"), 4).alias("score"))


@query("pooled_vectors", "SELECT vec_id, " + ", ".join(f"round(list_avg(list_transform(embedding[{i * 64 // 10 + 1}:{-(-(i + 1) * 64 // 10)}], lambda x: CAST(x AS DOUBLE))), 6) AS p{i}" for i in range(10)) + " FROM embeddings")
def pooled_vectors(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", O.pooled(F.col("embedding"), 64, 10).alias("p"))
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(10)])


@query("shuffled_within", f"""WITH {EV}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id, level ORDER BY md5(event_id || ':7'), event_id) AS j FROM ev)
SELECT a.event_id, b.value FROM a JOIN a b ON a.user_id = b.user_id AND a.level = b.level AND a.i = b.j""")
def shuffled_within(spark, d):
    return O.shuffled_within(plays(spark, d).select(*PLAY, "event_id", "value"), PLAY, ["event_id"], "value", 7).select("event_id", "value")


@query("message_tokens", """WITH m AS (SELECT conv_id, turn AS msg, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS char_end FROM conversations) SELECT conv_id, msg, CAST(char_end // 4 AS BIGINT) AS tokens FROM m""")
def message_tokens(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("msg"), F.sum(F.length("text")).over(w).alias("char_end"))
    t = m.groupBy("conv_id").agg(F.max("char_end").alias("n")).where("n >= 4").select("conv_id", F.explode(F.sequence(F.lit(4).cast("long"), F.col("n"), F.lit(4).cast("long"))).alias("token_end"))
    return O.message_tokens(t, m, ["conv_id"])


@query("log_lines", f"""WITH {NUM}, g AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY user_id, level ORDER BY ts, event_id), k) AS gain FROM nv)
SELECT event_id, '[L' || level || ' A' || (i // 5) || ' #' || i || '] ' || upper(event_type) || ' -> ' || outcome || '; ' || k || CASE WHEN gain > 0 THEN '; Score +' || gain WHEN gain < 0 THEN '; Score ' || gain ELSE '' END || CASE outcome WHEN 'win' THEN ' [WIN]' WHEN 'loss' THEN ' [LOSE]' ELSE '' END AS line FROM g""")
def log_lines(spark, d):
    w = Window.partitionBy(*PLAY).orderBy(*ORDER)
    p = plays(spark, d).withColumn("i", F.row_number().over(w) - 1).withColumn("gain", F.col("k") - F.coalesce(F.lag("k").over(w), F.col("k")))
    return p.select("event_id", O.log_line(F.col("level"), F.expr("i div 5"), F.col("i"), F.col("event_type"), F.array("outcome", F.col("k").cast("string")), F.col("gain"), F.col("outcome")).alias("line"))


IN_STEP = f"""WITH RECURSIVE {EV}, n AS (SELECT user_id, level, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3),
a AS (SELECT user_id, list(level ORDER BY level) AS ai, list(n ORDER BY level) AS an FROM n WHERE event_type = 'click' GROUP BY 1),
b AS (SELECT user_id, list(level ORDER BY level) AS bj, list(n ORDER BY level) AS bm FROM n WHERE event_type = 'view' GROUP BY 1),
r(user_id, ai, an, bj, bm, k, done, i, j) AS (SELECT user_id, ai, an, bj, bm, 0, 0, NULL::INTEGER, NULL::INTEGER FROM a JOIN b USING (user_id)
  UNION ALL SELECT user_id, ai, an, bj, bm, k + 1, CASE WHEN p > 0 THEN done + p ELSE done END, CASE WHEN p > 0 THEN ai[k + 1] END, CASE WHEN p > 0 THEN bj[done + p] END
  FROM (SELECT *, coalesce(list_position(bm[done + 1:], an[k + 1]), 0) AS p FROM r WHERE k < len(an)))
SELECT user_id, i, j FROM r WHERE i IS NOT NULL"""


@query("in_step", IN_STEP)
def in_step(spark, d):
    n = plays(spark, d).groupBy("user_id", "level", "event_type").agg(F.count("*").alias("n"))
    a = n.where("event_type = 'click'").select("user_id", F.col("level").alias("i"), "n")
    b = n.where("event_type = 'view'").select("user_id", F.col("level").alias("j"), F.col("n").alias("m"))
    return O.in_step(a, b.withColumnRenamed("user_id", "agent").select(F.col("agent").alias("user_id"), "j", "m"), ["user_id"], "user_id long, i int, j int")


@query("relation_vectors")
def relation_vectors(spark, d):
    t = F.collect_set(F.struct(F.concat(F.lit("u"), "level").alias("subject"), F.col("event_type").alias("relation"), F.col("outcome").alias("object")))
    r = plays(spark, d).groupBy("user_id").agg(F.array_sort(t).alias("t"))
    return r.select("user_id", O.relation_vectors("t").alias("v")).select("user_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(64)])
