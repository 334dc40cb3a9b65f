"""Queries over records, features and summaries of a release, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import scratch
from tarnlake.operators import grids as D
from tarnlake.plans.behaviour import ORDER
from tarnlake.plans.bindings import EV, plays
from tarnlake.sources import documents
from tarnlake.sources import released as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("record_errors", f"WITH {EV}, u AS (SELECT DISTINCT user_id FROM ev) SELECT user_id, CASE user_id % 6 WHEN 1 THEN 'another schema' WHEN 2 THEN 'another source' WHEN 3 THEN 'no plays' WHEN 4 THEN 'no description' ELSE 'two descriptions' END AS error FROM u WHERE user_id % 6 > 0")
def record_errors(spark, d):
    way = F.pmod("user_id", F.lit(6))
    r = plays(spark, d).groupBy("user_id").agg(F.collect_set("level").alias("plays")).select(
        "user_id", F.lit("replay").alias("schema"), F.when(way == 1, 2).otherwise(1).alias("schema_version"), F.when(way == 2, "generative").otherwise("human").alias("source"),
        F.when(way != 3, F.col("plays")).alias("plays"), F.when(way == 4, "").otherwise("text").alias("game_description"), F.when(way == 5, "text").alias("original_game_description"),
    )
    return R.record_errors(r, "user_id", "replay")


@query("confound_columns", f"WITH {EV} SELECT CAST(steps AS DOUBLE) AS trans_x, CASE WHEN k % 5 = 0 THEN 0.0 ELSE k / 2.0 END AS csf FROM ev")
def confound_columns(spark, d):
    """A table with two of the wanted columns and others, whose cells are in part n/a and NaN."""
    cell = F.when(F.col("k") % 10 == 0, "n/a").when(F.col("k") % 10 == 5, "NaN").otherwise((F.col("k") / 2).cast("string"))
    p = plays(spark, d).select("user_id", F.concat_ws("\t", cell, F.lit("x"), F.col("steps").cast("string")).alias("line"))
    g = p.groupBy("user_id").agg(F.concat(F.lit("csf\tother\ttrans_x\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("text"))
    root = scratch(spark)
    documents.write_documents(g.select(F.format_string("u%d.tsv", "user_id").alias("path"), "text"), root)
    return R.optional_columns(spark, root, ["trans_x", "trans_y", "csf"])


@query("level_features", f"WITH {EV} SELECT event_id, value FROM ev WHERE event_type = 'click' AND level = 3")
def level_features(spark, d):
    root = scratch(spark)
    plays(spark, d).select("event_id", "value", "level", F.col("event_type").alias("game")).write.partitionBy("game", "level").parquet(root)
    return R.level_features(spark, root, "click", 3).select("event_id", "value")


@query("discovered_levels", f"WITH {EV} SELECT DISTINCT event_type AS game, level FROM ev")
def discovered_levels(spark, d):
    root = scratch(spark)
    plays(spark, d).select("event_id", "level", F.col("event_type").alias("game")).write.partitionBy("game", "level").parquet(root)
    return R.discovered(spark, root)


@query("sorted_table", """WITH l AS (SELECT row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS n, n_regionkey || ',' || n_name || ',' || n_nationkey AS line FROM nation)
SELECT 'nations-' || lpad(CAST(n // 10 AS VARCHAR), 6, '0') || '.csv' AS path, CAST(count(*) AS BIGINT) AS rows, sha256('n_regionkey,n_name,n_nationkey' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10)) AS text_sha256 FROM l GROUP BY n // 10""")
def sorted_table(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey")
    return R.write_sorted(n, scratch(spark), "nations", ["n_regionkey", "n_name"], 10).select("path", "rows", "text_sha256")


@query("release_summary", """WITH g AS (SELECT c_mktsegment AS s, count(*) AS n, sum(c_custkey) AS b FROM customer GROUP BY 1), c AS (SELECT c_nationkey AS k, c_mktsegment AS s, count(*) AS n, sum(c_custkey) AS b FROM customer GROUP BY 1, 2)
SELECT 'summary.json' AS path, sha256('{"release":"r1","objects":' || sum(n) || ',"bytes":' || sum(b) || ',"groups":[' || string_agg('{"c_mktsegment":"' || s || '","objects":' || n || ',"bytes":' || b || '}', ',' ORDER BY s) || ']}') AS text_sha256 FROM g
UNION ALL SELECT 'coverage.csv', sha256('c_nationkey,c_mktsegment,objects,bytes' || chr(10) || string_agg(k || ',' || s || ',' || n || ',' || b, chr(10) ORDER BY k, s) || chr(10)) FROM c""")
def release_summary(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    return R.write_summary(c, scratch(spark), {"release": "r1"}, ["c_mktsegment"], ["c_nationkey", "c_mktsegment"], "c_custkey").select("path", "text_sha256")


@query("stale_paths", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 > 0 AND o_custkey % 2 = 0")
def stale_paths(spark, d):
    o = table(spark, d, "orders")
    return R.stale(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 6 = 0"), o.where("o_custkey % 2 = 0"), "o_orderkey")


@query("unverified_files", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'no digest' WHEN o_custkey % 5 = 1 THEN 'another size' ELSE 'another digest' END AS error FROM orders WHERE o_custkey % 5 < 3 AND o_orderkey % 4 > 0")
def unverified_files(spark, d):
    o = table(spark, d, "orders")
    way, sha = F.col("o_custkey") % 5, F.sha2(F.col("o_orderkey").cast("string"), 256)
    rows = o.select("o_orderkey", F.lit(7).alias("size"), F.when(way > 0, sha).alias("sha256"))
    files = o.select("o_orderkey", F.when(way == 1, 8).otherwise(7).alias("size"), F.when(way == 2, F.sha2(F.lit("x"), 256)).otherwise(sha).alias("sha256"))
    return R.unverified(rows, files, "o_orderkey", o.where("o_orderkey % 4 = 0"))


@query("batch_status", "SELECT o_orderpriority AS batch, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS completed, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS skipped, CAST(count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS BIGINT) AS failed, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus NOT IN ('O', 'F')), '') AS names FROM orders GROUP BY 1")
def batch_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "F", "skipped").otherwise("failed")
    s = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").cast("string").alias("session"), status.alias("status"))
    return R.batch_status(s, ["batch"]).select("batch", "completed", "skipped", "failed", F.array_join("failed_sessions", ",").alias("names"))


@query("models_together", "SELECT l_linestatus AS model, l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE (l_linestatus = 'F' AND l_linenumber = 1) OR (l_linestatus = 'O' AND l_linenumber > 2) GROUP BY 1, 2")
def models_together(spark, d):
    li = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", "l_linenumber")
    parts = {"F": li.where("l_linestatus = 'F' and l_linenumber = 1").drop("l_linenumber"), "O": li.where("l_linestatus = 'O' and l_linenumber > 2")}
    return R.together(parts, "model").groupBy("model", "l_returnflag").agg(F.count("*").alias("n"))


@query("subjects_side_by_side", "WITH a AS (SELECT l_suppkey AS k, sum(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 3 > 0 GROUP BY 1), b AS (SELECT l_suppkey AS k, sum(l_linenumber) AS v FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey % 5 > 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CAST(a.v AS BIGINT) AS a_v, CAST(b.v AS BIGINT) AS n_v FROM a FULL JOIN b ON a.k = b.k")
def subjects_side_by_side(spark, d):
    li = table(spark, d, "lineitem")
    one = lambda flag, m: li.where((F.col("l_returnflag") == flag) & (F.col("l_suppkey") % m > 0)).groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_linenumber").alias("v"))
    return R.side_by_side({"a": one("A", 3), "n": one("N", 5)}, ["k"])


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS iso, true AS same FROM events")
def iso_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("iso", R.iso(F.col("ts")))
    return e.select("event_id", "iso", (R.from_iso(F.col("iso")) == F.col("ts")).alias("same"))


@query("canonical_games", f"WITH {EV} SELECT event_id, upper(event_type) || '_V' || (level % 2) AS canonical FROM ev WHERE level >= 0")
def canonical_games(spark, d):
    p = plays(spark, d).where("level >= 0").select("event_id", F.concat(F.lit("v"), (F.col("level") % 2).cast("string"), F.lit("_"), F.col("event_type")).alias("game"))
    known = p.select(F.upper(F.concat_ws("_", F.substring("game", 4, 100), F.substring("game", 1, 2))).alias("name")).distinct()
    return R.canonical_games(p, known, "game").select("event_id", "canonical")


@query("learned_colours", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ev), f AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY i) AS pk, lag(steps) OVER (PARTITION BY user_id ORDER BY i) AS ps FROM n)
SELECT user_id, 'r' || event_type AS resource, arg_min('C' || ps, i) AS colour FROM (SELECT *, 'C' || ps AS c FROM f WHERE pk IS NOT NULL AND event_type <> lag_type) x GROUP BY 1, 2""".replace("f AS (SELECT *,", "f AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS lag_type,"))
def learned_colours(spark, d):
    """Each event is a frame whose avatar has one resource of the event's kind, and kills what was there in the frame before."""
    p = plays(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    frames = p.select("user_id", "i", F.create_map(F.concat(F.lit("r"), F.col("event_type")), F.lit(1)).alias("resources"))
    kills = p.select("user_id", "i", F.lit(0).alias("place"), F.lit("o").alias("killed"), F.lit("avatar").alias("killer"))
    objects = p.select("user_id", "i", F.lit("o").alias("obj_id"), F.concat(F.lit("C"), F.col("steps").cast("string")).alias("colour"))
    return R.learned_colours(frames, kills, objects, ["user_id"], "i")


@query("atlas_labels", "SELECT p_brand AS name, CAST(arg_max(p_size, p_partkey) AS INTEGER) AS code FROM part WHERE p_partkey % 5 > 1 GROUP BY 1")
def atlas_labels(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.lit("# a comment 1 2")).when(k % 5 == 1, F.lit("short 7")).otherwise(F.concat(F.lit("  AB\t"), F.col("p_brand"), F.lit(" "), F.col("p_size").cast("string")))
    return D.atlas_labels(table(spark, d, "part").select("p_partkey", line.alias("line")), "p_partkey", "line")
