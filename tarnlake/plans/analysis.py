"""Queries over alignment, encoding, results, manifests, replays and state, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core import checks
from tarnlake.core.session import table
from tarnlake.operators import align as A
from tarnlake.operators import encode as N
from tarnlake.operators import graph as G
from tarnlake.operators import manifest as M
from tarnlake.operators import replay as P
from tarnlake.operators import results as R
from tarnlake.operators import state as T
from tarnlake.operators import windows as W
from tarnlake.operators.episodes import episode_rows
from tarnlake.plans.behaviour import ORDER, PLAY
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


# --- alignment -------------------------------------------------------------------------------

TR = 21600.0
TIMED = EV + f""", st AS (SELECT user_id, min(sec) AS t0 FROM ev GROUP BY 1),
tv AS (SELECT ev.*, CAST(round_even((sec - t0) / {TR}, 0) AS BIGINT) AS volume FROM ev JOIN st USING (user_id)),
tl AS (SELECT *, volume < 100 AS valid, volume - min(volume) FILTER (volume < 100) OVER (PARTITION BY user_id, level) AS local FROM tv)"""


def timed(spark: SparkSession, d: str) -> DataFrame:
    p = plays(spark, d)
    start = p.groupBy("user_id").agg(F.min("sec").alias("t0"))
    return A.timed(p.join(start, "user_id"), PLAY, "sec", "t0", TR, F.lit(100))


@query("volumes", f"WITH {TIMED} SELECT event_id, volume, valid, local FROM tl")
def volumes(spark, d):
    return timed(spark, d).select("event_id", "volume", "valid", "local")


BINS = TIMED + """, g AS (SELECT user_id, level, local, avg(value) AS v, arg_max(value, (ts, event_id)) AS lastv, count(*) AS n FROM tl WHERE valid GROUP BY ALL),
dn AS (SELECT user_id, level, unnest(range(0, max(local) + 1)) AS local FROM g GROUP BY user_id, level),
bn AS (SELECT user_id, level, local, coalesce(v, 0) AS v, coalesce(lastv, 0) AS lastv, coalesce(n, 0) AS n FROM dn LEFT JOIN g USING (user_id, level, local))"""


@query("bin_mean", f"WITH {BINS} SELECT user_id, level, local, round(v, 6) AS value, CAST(n AS BIGINT) AS n FROM bn")
def bin_mean(spark, d):
    return A.bin_values(timed(spark, d).where("valid"), PLAY, "local", ORDER, "value").withColumn("value", F.round("value", 6))


@query("bin_last", f"WITH {BINS} SELECT user_id, level, local, lastv AS value, CAST(n AS BIGINT) AS n FROM bn")
def bin_last(spark, d):
    return A.bin_values(timed(spark, d).where("valid"), PLAY, "local", ORDER, "value", "last")


@query("bin_coverage", f"WITH {BINS} SELECT user_id, level, CAST(count(*) AS BIGINT) AS bins, CAST(count(*) FILTER (n = 0) AS BIGINT) AS empty, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean FROM bn GROUP BY 1, 2")
def bin_coverage(spark, d):
    b = A.bin_values(timed(spark, d).where("valid"), PLAY, "local", ORDER, "value")
    return A.coverage(b, PLAY).withColumn("mean", F.round("mean", 6))


@query("bin_two_levels", f"""WITH {TIMED}, f AS (SELECT user_id, level, local, k, avg(value) AS v FROM tl WHERE valid GROUP BY ALL)
SELECT user_id, level, local, round(avg(v), 6) AS value, CAST(count(*) AS BIGINT) AS steps FROM f GROUP BY ALL""")
def bin_two_levels(spark, d):
    return A.two_level_mean(timed(spark, d).where("valid"), PLAY, "k", "local", "value").withColumn("value", F.round("value", 6))


NEAR = EV + """, l AS (SELECT user_id, event_id, sec FROM ev WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS near_id, sec AS near_sec FROM ev WHERE event_type = 'view'),
m AS (SELECT l.*, near_id, abs(sec - near_sec) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(sec - near_sec), near_id) AS q FROM l JOIN r USING (user_id) WHERE abs(sec - near_sec) < 14400)"""


@query("nearest_match", f"WITH {NEAR} SELECT event_id, near_id, round(gap, 3) AS gap FROM m WHERE q = 1")
def nearest_match(spark, d):
    p = plays(spark, d)
    l = p.where("event_type = 'click'").select("user_id", "event_id", "sec")
    r = p.where("event_type = 'view'").select("user_id", F.col("event_id").alias("near_id"), F.col("sec").alias("near_sec"))
    return A.nearest(l, r, ["user_id"], "sec", "near_sec", "near_id", 14400.0).select("event_id", "near_id", F.round("gap", 3).alias("gap"))


@query("interval_match", f"""WITH {EV}, g AS (SELECT user_id, event_id AS grp, sec AS g_min, sec + 60.0 * k AS g_max FROM ev WHERE event_type = 'error'),
s AS (SELECT user_id, level, min(sec) AS s_min, max(sec) AS s_max FROM ev GROUP BY 1, 2)
SELECT grp, level, CAST(count(*) OVER (PARTITION BY user_id, grp) AS BIGINT) AS candidates FROM g JOIN s USING (user_id) WHERE g_min >= s_min - 2 AND g_max <= s_max + 2""")
def interval_match(spark, d):
    p = plays(spark, d)
    g = p.where("event_type = 'error'").select("user_id", F.col("event_id").alias("grp"), F.col("sec").alias("g_min"), (F.col("sec") + 60.0 * F.col("k")).alias("g_max"))
    s = p.groupBy(*PLAY).agg(F.min("sec").alias("s_min"), F.max("sec").alias("s_max"))
    return A.contained(g, s, ["user_id"], 2.0, 3 * 86400.0).select("grp", "level", "candidates")


@query("filled_both_ways", f"""WITH {EV}, x AS (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v FROM ev)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id, level ORDER BY ts, event_id),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id, level ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM x""")
def filled_both_ways(spark, d):
    p = plays(spark, d).withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return A.fill_both_ways(p, PLAY, ORDER, "v").select("event_id", "v")


@query("step_on_grid", f"""WITH {EV}, c AS (SELECT user_id, level, sum(steps) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, ts, event_id FROM ev),
g AS (SELECT DISTINCT user_id, x FROM ev, (SELECT unnest(range(0, 1001, 50)) AS x)), j AS (SELECT g.user_id, x, level, t FROM g LEFT JOIN c ON c.user_id = g.user_id AND t <= x)
SELECT user_id, CAST(x AS DOUBLE) AS x, CAST(coalesce(arg_max(level, t), 0) AS DOUBLE) AS value FROM j GROUP BY user_id, x""")
def step_on_grid(spark, d):
    p = plays(spark, d)
    c = p.select("user_id", "level", F.sum("steps").over(Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
    g = p.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(1000), F.lit(50))).alias("x"))
    return A.step_value(c, g, ["user_id"], "t", "level", "x")


# --- encoding --------------------------------------------------------------------------------


@query("scaled_by_train", f"""WITH {EV}, r AS (SELECT *, (level % 3) <> 0 AS tr FROM ev), s AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM r WHERE tr GROUP BY 1)
SELECT event_id, round(CASE WHEN s > 1e-6 THEN (value - m) / s ELSE 0 END, 6) AS z FROM r LEFT JOIN s USING (event_type)""")
def scaled_by_train(spark, d):
    return N.scaled_by_train(plays(spark, d), ["event_type"], "value", "level % 3 <> 0").select("event_id", F.round("z", 6).alias("z"))


@query("correlations", f"""WITH {EV}, s AS (SELECT user_id, level, avg(k) AS mx, avg(value) AS my, avg(k * k) AS xx, avg(value * value) AS yy, avg(k * value) AS xy, count(*) AS n FROM ev GROUP BY 1, 2),
d AS (SELECT *, sqrt(greatest((xx - mx * mx) * (yy - my * my), 0)) AS den FROM s)
SELECT user_id, level, round(CASE WHEN den > 1e-10 THEN greatest(-1, least(1, (xy - mx * my) / den)) ELSE 0 END, 5) AS r, CAST(n AS BIGINT) AS n FROM d WHERE n > 2""")
def correlations(spark, d):
    return N.correlation(plays(spark, d), PLAY, "k", "value").where("n > 2").withColumn("r", F.round("r", 5))


@query("fold_means", f"""WITH {EV}, p AS (SELECT *, CAST(floor(level / 3.0) AS BIGINT) AS part FROM ev), f AS (SELECT DISTINCT part AS fold FROM p)
SELECT fold, event_type, round(avg(value) FILTER (part <> fold), 6) AS train, round(avg(value) FILTER (part = fold), 6) AS test FROM p, f GROUP BY 1, 2""")
def fold_means(spark, d):
    p = plays(spark, d).withColumn("part", F.floor(F.col("level") / 3.0))
    f = N.folds(p, "part")
    return f.groupBy("fold", "event_type").agg(F.round(F.avg(F.when(~F.col("is_test"), F.col("value"))), 6).alias("train"), F.round(F.avg(F.when(F.col("is_test"), F.col("value"))), 6).alias("test"))


@query("one_hot", f"WITH {EV} SELECT event_id, array_to_string(list_transform(range(0, 10), lambda i: CAST(i = level AS INTEGER)), '') AS code FROM ev")
def one_hot(spark, d):
    return plays(spark, d).select("event_id", F.array_join(N.one_hot(F.col("level"), 10).cast("array<string>"), "").alias("code"))


CENT = """c AS (SELECT label, i, avg(embedding[i]) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)"""


@query("centroid_similarity", f"""WITH {CENT}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (max(greatest(na.n, 1e-12)) * max(greatest(nb.n, 1e-12))), 6) AS similarity
FROM c a JOIN c b ON a.i = b.i AND a.label <= b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2""")
def centroid_similarity(spark, d):
    """Similarity matrix of class means: as many rows as there are pairs of classes, which meet by
    the place of their elements."""
    c = N.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding")
    n = c.select("label", F.greatest(F.sqrt(N.dot(F.col("vector"), F.col("vector"))), F.lit(1e-12)).alias("n"), F.posexplode("vector").alias("i", "x"))
    a = n.select("i", F.col("label").alias("a"), (F.col("x") / F.col("n")).alias("x"))
    b = n.select("i", F.col("label").alias("b"), (F.col("x") / F.col("n")).alias("y"))
    return a.join(b, "i").where("a <= b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("similarity"))


@query("valid_vectors", "SELECT CAST(count(*) FILTER (s <> 0) AS BIGINT) AS valid, CAST(count(*) AS BIGINT) AS n FROM (SELECT list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings)")
def valid_vectors(spark, d):
    return table(spark, d, "embeddings").agg(F.count_if(N.valid_rows("embedding")).alias("valid"), F.count("*").alias("n"))


@query("components")
def components(spark, d):
    """Scores of the vectors on their first two principal components."""
    e = table(spark, d, "embeddings")
    mean, top = N.principal_components(e, "embedding", 2)
    return e.select("vec_id", *[F.round(N.linear("embedding", w, -float(mean @ w)), 6).alias(f"pc{i + 1}") for i, w in enumerate(top)])


@query("ridge_scores")
def ridge_scores(spark, d):
    """Out-of-fold correlation of ridge predictions of the label, by alpha; folds by vec_id mod 3."""
    e = table(spark, d, "embeddings").withColumn("fold", F.col("vec_id") % 3).withColumn("y", F.col("label").cast("double"))
    alphas, parts = [0.1, 1.0, 10.0], []
    for fold in range(3):
        fits = N.ridge(e.where(F.col("fold") != fold), "embedding", "y", alphas)
        for a in alphas:
            parts.append(e.where(F.col("fold") == fold).select(F.lit(a).alias("alpha"), "y", N.linear("embedding", *fits[a]).alias("pred")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return N.correlation(rows, ["alpha"], "pred", "y").withColumn("r", F.round("r", 6))


# --- results ---------------------------------------------------------------------------------

RES = """res AS (SELECT l_returnflag AS model, l_linestatus AS variant, CAST(l_suppkey % 8 AS BIGINT) AS subject, l_linenumber AS layer, p_brand AS roi, CAST(l_partkey % 3 AS BIGINT) AS part, l_discount AS perf
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return l.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("variant"), (F.col("l_suppkey") % 8).alias("subject"), F.col("l_linenumber").alias("layer"), F.col("p_brand").alias("roi"), (F.col("l_partkey") % 3).alias("part"), F.col("l_discount").alias("perf"))


@query("roi_means", f"WITH {RES} SELECT model, variant, subject, layer, roi, part, round(avg(perf), 6) AS score, CAST(count(*) AS BIGINT) AS n FROM res GROUP BY ALL")
def roi_means(spark, d):
    return scores(spark, d).groupBy("model", "variant", "subject", "layer", "roi", "part").agg(F.round(F.avg("perf"), 6).alias("score"), F.count("*").alias("n"))


LAY = f"{RES}, lm AS (SELECT model, subject, layer, round(avg(perf), 8) AS v FROM res GROUP BY ALL)"


def layer_means(spark, d, by=("model", "subject")):
    return scores(spark, d).groupBy(*by, "layer").agg(F.round(F.avg("perf"), 8).alias("v"))


@query("best_layer", f"WITH {LAY} SELECT model, subject, layer, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY model, subject ORDER BY v DESC, layer) AS r FROM lm) WHERE r = 1")
def best_layer(spark, d):
    return R.best(layer_means(spark, d), ["model", "subject"], "v", ["layer"]).select("model", "subject", "layer", F.round("v", 6).alias("v"))


@query("layer_picks", f"""WITH {RES}, lm AS (SELECT model, layer, round(avg(perf), 8) AS v FROM res GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v, layer) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM lm)
SELECT model, layer, round(v, 6) AS v, pick FROM (SELECT *, 'worst' AS pick FROM r WHERE r = 0 UNION ALL SELECT *, 'median' FROM r WHERE r = n // 2 UNION ALL SELECT *, 'best' FROM r WHERE r = n - 1)""")
def layer_picks(spark, d):
    return R.ranked_pick(layer_means(spark, d, ("model",)), ["model"], "v", ["layer"]).select("model", "layer", F.round("v", 6).alias("v"), "pick")


@query("max_over_layers", f"WITH {RES} SELECT model, roi, max(v) AS v FROM (SELECT model, roi, layer, round(avg(perf), 6) AS v FROM res GROUP BY ALL) GROUP BY 1, 2")
def max_over_layers(spark, d):
    return scores(spark, d).groupBy("model", "roi", "layer").agg(F.round(F.avg("perf"), 6).alias("v")).groupBy("model", "roi").agg(F.max("v").alias("v"))


@query("common_parts", "WITH m AS (SELECT DISTINCT l_partkey, l_suppkey % 4 AS s FROM lineitem) SELECT l_partkey, CAST(row_number() OVER (ORDER BY l_partkey) - 1 AS BIGINT) AS place FROM (SELECT l_partkey FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT s) FROM m))")
def common_parts(spark, d):
    """The mask that all subjects share, with each voxel's place in it."""
    m = table(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 4).alias("s")).distinct()
    c = R.in_all(m, ["l_partkey"], "s")
    return W.numbered(c, ["l_partkey"], "place")


@query("missing_cells", """WITH e AS (SELECT n_nationkey AS nation, p.pr AS priority FROM nation, (SELECT DISTINCT o_orderpriority AS pr FROM orders) p),
h AS (SELECT DISTINCT c_nationkey AS nation, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 495000)
SELECT nation, priority FROM e WHERE (nation, priority) NOT IN (SELECT nation, priority FROM h) AND nation % 5 <> 0""")
def missing_cells(spark, d):
    o, n = table(spark, d, "orders"), table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    pr = checks.bounded(o.select(F.col("o_orderpriority").alias("priority")).distinct(), 1000, "priorities").agg(F.collect_list("priority").alias("p"))
    have = o.where("o_totalprice > 495000").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"))
    expected = n.join(F.broadcast(pr)).select("nation", F.explode("p").alias("priority"))  # one row of priorities
    return R.missing_cells(expected, have, expected.where("nation % 5 = 0"), ["nation", "priority"])


@query("declared_rows", f"""WITH {RES}, x AS (SELECT model, variant, layer, CASE WHEN part > 0 THEN part END AS stream, perf FROM res)
SELECT model, variant, layer, CAST(count(*) AS BIGINT) AS n, round(sum(perf), 4) AS total FROM x
WHERE (model = 'A' AND variant = 'F' AND stream IS NULL AND layer IN (1, 3)) OR (model = 'N' AND variant = 'O' AND stream = 1 AND layer = 2) GROUP BY ALL""")
def declared_rows(spark, d):
    x = scores(spark, d).withColumn("stream", F.when(F.col("part") > 0, F.col("part")))
    c = spark.createDataFrame([("A", "F", None, 1), ("A", "F", None, 3), ("N", "O", 1, 2)], "model string, variant string, stream long, layer int")
    return R.declared(x, c, ["model", "variant", "stream", "layer"]).groupBy("model", "variant", "layer").agg(F.count("*").alias("n"), F.round(F.sum("perf"), 4).alias("total"))


@query("depth_layers", f"""WITH RECURSIVE {RES}, d AS (SELECT DISTINCT model, subject, layer FROM res),
q AS (SELECT model, count(DISTINCT subject) AS q FROM d GROUP BY 1),
c AS (SELECT model, layer FROM d JOIN q USING (model) GROUP BY model, layer, q HAVING count(*) = q),
h AS (SELECT model, list(CAST(layer AS BIGINT) ORDER BY layer) AS free FROM c GROUP BY 1),
r(model, i, free, sel) AS (SELECT model, 0, free, CAST([] AS BIGINT[]) FROM h
  UNION ALL SELECT model, i + 1, list_filter(free, lambda x: x <> got), list_append(sel, got)
  FROM (SELECT *, list_sort(list_transform(free, lambda x: struct_pack(gap := abs(x - (1 + 11.0 * i / 2)), v := x)))[1].v AS got FROM r WHERE i < 3))
SELECT model, CAST(unnest(sel) AS INTEGER) AS layer FROM r WHERE i = 3""")
def depth_layers(spark, d):
    """Three layers of each model by depth, as if the models had 12 layers."""
    s = scores(spark, d)
    return R.pick_depths(s, "model", "subject", "layer", 3, s.select("model").distinct().withColumn("n_layers", F.lit(12)))


@query("rollup_panels", f"WITH {RES} SELECT model, variant, round(avg(perf), 4) AS v, CAST(count(*) AS BIGINT) AS n FROM res GROUP BY ROLLUP (model, variant)")
def rollup_panels(spark, d):
    return scores(spark, d).rollup("model", "variant").agg(F.round(F.avg("perf"), 4).alias("v"), F.count("*").alias("n"))


@query("excluded", f"WITH {RES} SELECT model, variant, CAST(count(*) AS BIGINT) AS n FROM res WHERE NOT (model = 'A' AND variant = 'F') AND NOT (model = 'R') GROUP BY ALL")
def excluded(spark, d):
    return scores(spark, d).where(R.exclude(["A:F", "R"], "model", "variant", "roi")).groupBy("model", "variant").agg(F.count("*").alias("n"))


# --- manifests -------------------------------------------------------------------------------

RULES = [("first", "src1", None, "include"), ("even", "src", "src[02468]", "optional"), ("rest", "src", r"src\d", "defer"), ("none", "x", None, "exclude")]


@query("rule_decisions", """SELECT CASE WHEN starts_with(source, 'src1') THEN 'first' WHEN starts_with(source, 'src') AND regexp_full_match(source, 'src[02468]') THEN 'even' WHEN starts_with(source, 'src') AND regexp_full_match(source, 'src\\d') THEN 'rest' END AS rule,
CASE WHEN starts_with(source, 'src1') THEN 'include' WHEN starts_with(source, 'src') AND regexp_full_match(source, 'src[02468]') THEN 'optional' ELSE 'defer' END AS decision, CAST(count(*) AS BIGINT) AS objects, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2""")
def rule_decisions(spark, d):
    rule, decision = M.first_rule(F.col("source"), RULES)
    return table(spark, d, "documents").groupBy(rule.alias("rule"), decision.alias("decision")).agg(F.count("*").alias("objects"), F.sum("n_chars").alias("bytes"))


@query("coverage_counters", """WITH c AS (SELECT source, count(*) AS objects, sum(n_chars) AS bytes, count(DISTINCT lang) AS members, list(doc_id ORDER BY doc_id)[1:3] AS ex FROM documents GROUP BY 1)
SELECT source, CAST(objects AS BIGINT) AS objects, CAST(bytes AS BIGINT) AS bytes, CAST(members AS BIGINT) AS members, array_to_string(ex, ',') AS examples FROM c""")
def coverage_counters(spark, d):
    c = M.counters(table(spark, d, "documents"), ["source"], "n_chars", "lang", "doc_id")
    return c.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("path_encoding", "SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda s: replace(url_encode(s), '*', '%2A')), '/') AS path FROM pages")
def path_encoding(spark, d):
    return table(spark, d, "pages").select("page_id", M.percent_encoded(F.col("url")).alias("path"))


@query("artifact_ids", "SELECT doc_id, sha256('[\"' || doc_id || '\",\"' || source || '\"]') AS id, CAST(('0x' || sha256(source)[1:8])::BIGINT % 8 AS BIGINT) AS colour FROM documents")
def artifact_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", M.artifact_id(F.col("doc_id"), F.col("source")).alias("id"), M.stable_index(F.col("source"), 8).alias("colour"))


@query("copies", "SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def copies(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("verified_rows", """SELECT d.doc_id, l.doc_id IS NOT NULL AND l.gen = d.doc_id % 2 AS verified FROM documents d LEFT JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS gen FROM labels) l ON d.doc_id = l.doc_id""")
def verified_rows(spark, d):
    m = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("gen"))
    e = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("gen"))
    return M.merge_verified(m, e, "doc_id", ["gen"])[0].select("doc_id", "verified")


@query("enriched", "SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name FROM orders LEFT JOIN customer a ON o_custkey + 1000 = a.c_custkey LEFT JOIN customer b ON o_custkey = b.c_custkey")
def enriched(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 1000).alias("a"), F.col("o_custkey").alias("b"))
    return M.enrich(o, table(spark, d, "customer"), "a", "b", "c_custkey", "c_name").select("o_orderkey", "c_name")


@query("integrity_report", """WITH w AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT 'backwards' AS rule, CAST(count(*) FILTER (b) AS BIGINT) AS broken FROM w
UNION ALL SELECT 'duplicate_keys', CAST(count(*) AS BIGINT) FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'orphans', CAST(count(*) AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'mixed_dimension', CAST(count(*) AS BIGINT) FROM (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1)
UNION ALL SELECT 'not_finite', CAST(count(*) AS BIGINT) FROM events WHERE isnan(value) OR isinf(value)
UNION ALL SELECT 'not_a_sequence', CAST(count(*) AS BIGINT) FROM (SELECT l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS x FROM lineitem) WHERE x <> 0""")
def integrity_report(spark, d):
    e, docs = table(spark, d, "events"), table(spark, d, "documents")
    line = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("step"))
    bad = {
        "backwards": checks.backwards(e, ["user_id"], ORDER, "value"), "duplicate_keys": checks.duplicate_keys(e, ["user_id", "event_type"]),
        "orphans": checks.orphans(docs, table(spark, d, "labels"), ["doc_id"]), "mixed_dimension": checks.mixed_dimension(docs, ["source"], "lang"),
        "not_finite": checks.not_finite(e, ["value"]), "not_a_sequence": checks.not_a_sequence(line, ["l_orderkey"], "step"),
    }
    out = None
    for name, rows in bad.items():
        one = rows.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


# --- replays ---------------------------------------------------------------------------------

STATE = EV + """, fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type, k FROM ev),
big AS (SELECT user_id, frame, unnest([event_type, 'total']) AS key, unnest([k, k // 10]) AS v FROM fr)"""


def state(spark: SparkSession, d: str) -> DataFrame:
    fr = plays(spark, d).withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long"))
    kv = F.explode(F.array(F.struct(F.col("event_type").alias("key"), F.col("k").alias("v")), F.struct(F.lit("total").alias("key"), F.expr("k div 10").alias("v"))))
    return fr.select("user_id", "frame", kv.alias("s")).select("user_id", "frame", "s.key", "s.v")


@query("delta_encoded", f"""WITH {STATE}, en AS (SELECT user_id, max(frame) AS e FROM fr GROUP BY 1),
p AS (SELECT user_id, frame + 1 AS frame, key, v AS pv, true AS had FROM big),
f AS (SELECT user_id, frame, key, v, b.user_id IS NOT NULL AS has, pv, coalesce(had, false) AS had FROM (SELECT *, true AS h FROM big) b FULL JOIN p USING (user_id, frame, key)),
g AS (SELECT f.user_id, f.frame, f.key, f.v, f.v IS NOT NULL AS has, pv, had FROM f)
SELECT user_id, frame, key, v, has AS present FROM g JOIN en USING (user_id) WHERE frame <= e AND (has <> had OR v <> pv)""")
def delta_encoded(spark, d):
    return P.delta_encode(state(spark, d), ["user_id"], "frame", "key", "v")


@query("delta_round_trip", f"WITH {STATE} SELECT user_id, frame, key, v FROM big")
def delta_round_trip(spark, d):
    s = state(spark, d)
    return P.delta_expand(P.delta_encode(s, ["user_id"], "frame", "key", "v"), s, ["user_id"], "frame", "key", "v")


@query("numbered_objects", f"""WITH {EV}, f AS (SELECT user_id, event_type, k, min(ts) AS t FROM ev GROUP BY 1, 2, 3)
SELECT user_id, event_type, k, event_type || '.' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, k) AS name FROM f""")
def numbered_objects(spark, d):
    return P.numbered_objects(plays(spark, d), ["user_id"], "event_type", "k", ["ts"])


@query("within_budget", """WITH t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tk, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(tk) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS later FROM t),
f AS (SELECT conv_id, max(tk) FILTER (i = 0) AS head FROM t GROUP BY 1),
m AS (SELECT conv_id, count(*) FILTER (i > 0 AND i <= n - 2 AND head + later > 200) AS dropped FROM s JOIN f USING (conv_id) GROUP BY 1)
SELECT conv_id, turn FROM t JOIN m USING (conv_id) WHERE i = 0 OR i > 2 * ceil(dropped / 2.0)""")
def within_budget(spark, d):
    c = table(spark, d, "conversations")
    return P.within_budget(c, "conv_id", "turn", F.ceil(F.length("text") / 4.0), 200, 2).select("conv_id", "turn")


WINDOWS = """WITH RECURSIVE t AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM conversations),
s AS (SELECT conv_id, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n AS BIGINT) AS pos, CAST(sum(n) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM t),
l AS (SELECT conv_id, max(total) AS total, list(pos) AS msgs FROM s GROUP BY 1),
w(conv_id, total, msgs, w, start) AS (SELECT conv_id, total, msgs, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM l WHERE total > 0
  UNION ALL SELECT conv_id, total, msgs, w + 1, coalesce(list_max(list_filter(msgs, lambda x: x > start AND x <= start + 100)), list_min(list_filter(msgs, lambda x: x > start)), least(start + 1, total - 1)) FROM w WHERE start + 200 < total),
v AS (SELECT conv_id, w, start, least(start + 200, total) AS "end", start + (least(start + 200, total) - start) // 2 AS half FROM w),
p AS (SELECT DISTINCT conv_id, pos FROM s),
a AS (SELECT p.conv_id, pos, min(w) FILTER (pos >= half AND pos < "end") AS good, max(w) FILTER (pos >= start AND pos < "end") AS latest, max(half) FILTER (w = 0) AS half0 FROM p JOIN v USING (conv_id) GROUP BY 1, 2)
SELECT conv_id, pos, w, start, "end" FROM (SELECT conv_id, pos, CASE WHEN pos < half0 THEN 0 ELSE coalesce(good, latest) END AS w FROM a) JOIN v USING (conv_id, w)"""


@query("token_windows", WINDOWS)
def token_windows(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.ceil(F.length("text") / 4.0).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = c.withColumn("start", F.sum("n").over(w) - F.col("n")).groupBy("conv_id").agg(F.sum("n").cast("long").alias("total"), F.array_sort(F.collect_list(F.col("start").cast("long"))).alias("starts"))
    s = s.select("conv_id", "starts", F.posexplode(P.token_windows("total", "starts", F.lit(200).cast("long"), F.lit(100).cast("long"))).alias("w", "span"))
    wins = s.select("conv_id", F.col("w").cast("long").alias("w"), F.col("span")[0].alias("start"), F.col("span")[1].alias("end"))
    targets = s.select("conv_id", F.explode("starts").alias("pos")).distinct()
    return P.assign_targets(targets, wins, ["conv_id"]).join(wins, ["conv_id", "w"])


ADVANCE = f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, list(outcome ORDER BY ts, event_id) AS o FROM ev GROUP BY 1),
r(user_id, o, i, level, tries, wins, losses, reason) AS (SELECT user_id, o, 0, 0, 0, 0, 0, '' FROM o
  UNION ALL SELECT user_id, o, i + 1, CASE WHEN w >= 2 THEN level + 1 ELSE level END, CASE WHEN w >= 2 THEN 0 ELSE tries + 1 END, CASE WHEN w >= 2 THEN 0 ELSE w END, CASE WHEN w >= 2 THEN 0 ELSE l END,
    CASE WHEN w >= 2 THEN '' WHEN l >= 3 THEN 'losses' WHEN tries + 1 >= 12 THEN 'budget' ELSE '' END
  FROM (SELECT *, CASE WHEN o[i + 1] = 'win' THEN wins + 1 ELSE 0 END AS w, CASE WHEN o[i + 1] = 'loss' THEN losses + 1 ELSE 0 END AS l FROM r WHERE reason = '' AND i < len(o)))
SELECT user_id, CAST(level AS INTEGER) AS level, CAST(i AS INTEGER) AS attempts, reason FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


@query("advancement", ADVANCE)
def advancement(spark, d):
    e = episode_rows(plays(spark, d), ["user_id"], ORDER)
    return e.select("user_id", T.advancement(F.col("episode_outcomes"), 2, 3, 12).alias("a")).select("user_id", "a.*")


@query("failures_in_a_row", f"""WITH {EV}, r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER w AS isl FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS BIGINT) AS failures FROM r""")
def failures_in_a_row(spark, d):
    return T.failures_in_a_row(plays(spark, d), ["user_id"], ORDER, F.col("event_type") == "error").select("event_id", "failures")


STATES = EV + """, s AS (SELECT user_id, ts, event_id, event_type || ':' || k AS node FROM ev),
e AS (SELECT DISTINCT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM s)"""


@query("reachable", f"""WITH RECURSIVE {STATES}, g AS (SELECT src, dst FROM e WHERE dst IS NOT NULL),
r(node, depth) AS (SELECT DISTINCT src, 0 FROM g WHERE src LIKE '%:0' UNION SELECT dst, depth + 1 FROM r JOIN g ON node = src WHERE depth < 60)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1""")
def reachable(spark, d):
    """States of all users (type and k of an event) by their steps from the states with k = 0."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    s = plays(spark, d).withColumn("node", F.concat_ws(":", "event_type", F.col("k").cast("string")))
    e = s.select(F.col("node").alias("src"), F.lead("node").over(w).alias("dst")).where("dst is not null").distinct()
    return G.breadth_first(e, e.where("src like '%:0'").select(F.col("src").alias("node")))


@query("transition_matrix", f"""WITH {EV}, t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev), n AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM n""")
def transition_matrix(spark, d):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    t = plays(spark, d).select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")
    return G.transitions(t, "src", "dst").withColumn("p", F.round("p", 6))
