"""Queries over grids, and over features of many plays as one matrix, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.operators import features as X
from tarnlake.operators import grids as D
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


MATRIX = EV + """, pl AS (SELECT DISTINCT user_id, level FROM ev),
of AS (SELECT user_id, level, 10 * (row_number() OVER (ORDER BY user_id, level) - 1) AS start FROM pl),
st AS (SELECT user_id, level, k, avg(value) AS a, avg(CAST(steps AS DOUBLE)) AS b FROM ev WHERE event_type = 'click' AND k < 97 GROUP BY 1, 2, 3),
bn AS (SELECT user_id, level, k // 10 AS bin, sum(a) AS a, sum(b) AS b, count(*) AS n FROM st GROUP BY 1, 2, 3),
al AS (SELECT o.user_id, o.level, b.bin, o.start + b.bin AS position, x.a, x.b, x.n FROM of o, range(10) b(bin) LEFT JOIN bn x ON x.user_id = o.user_id AND x.level = o.level AND x.bin = b.bin)"""


def matrix(spark, d, carry):
    p = plays(spark, d)
    shape = p.select("user_id", "level").distinct().withColumns({"n_steps": F.lit(97), "per_bin": F.lit(10)})
    calls = p.where("event_type = 'click'").select("user_id", "level", F.col("k").alias("step"), F.array("value", F.col("steps").cast("double")).alias("vector"))
    m = X.aligned_matrix(shape, calls, ["user_id", "level"], ["user_id", "level"], 2, carry)
    return m.select("user_id", "level", "bin", "position", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[1], 6).alias("v1"), "observed")


@query("aligned_matrix", f"WITH {MATRIX} SELECT user_id, level, bin, position, round(coalesce(a, 0) / CASE WHEN bin = 9 THEN 7 ELSE 10 END, 6) AS v0, round(coalesce(b, 0) / CASE WHEN bin = 9 THEN 7 ELSE 10 END, 6) AS v1, n IS NOT NULL AS observed FROM al")
def aligned_matrix(spark, d):
    return matrix(spark, d, False)


@query("carried_matrix", f"WITH {MATRIX} SELECT user_id, level, bin, position, round(coalesce(last_value(a / n IGNORE NULLS) OVER w, 0), 6) AS v0, round(coalesce(last_value(b / n IGNORE NULLS) OVER w, 0), 6) AS v1, n IS NOT NULL AS observed FROM al WINDOW w AS (PARTITION BY user_id, level ORDER BY bin ROWS UNBOUNDED PRECEDING)")
def carried_matrix(spark, d):
    return matrix(spark, d, True)


#: Parts as cells of a grid, and of an atlas of another: both affines are exact in binary numbers.
GRID, ATLAS = [2.0, 0, 0, 1, 0, 2.0, 0, 0, 0, 0, -2.0, 8], [4.0, 0, 0, -0.5, 0, 4.0, 0, 0, 0, 0, 4.0, 0]


@query("resampled_codes", """WITH c AS (SELECT p_partkey, p_partkey % 20 AS x, p_size AS y, (p_partkey // 20) % 6 AS z FROM part),
a AS (SELECT DISTINCT s_suppkey % 8 AS x, s_nationkey AS y, s_suppkey % 3 AS z FROM supplier),
m AS (SELECT p_partkey, (2 * x + 1.5) / 4.0 AS i, 2 * y / 4.0 AS j, (8 - 2 * z) / 4.0 AS k FROM c)
SELECT p_partkey, CAST(coalesce(1 + a.x + 10 * a.y + 1000 * a.z, 0) AS INTEGER) AS code FROM m LEFT JOIN a ON i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 24 AND k BETWEEN 0 AND 2 AND a.x = floor(i + 0.5) AND a.y = floor(j + 0.5) AND a.z = floor(k + 0.5)""")
def resampled_codes(spark, d):
    cells = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 20).alias("x"), F.col("p_size").alias("y"), F.expr("(p_partkey div 20) % 6").alias("z"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 8).alias("x"), F.col("s_nationkey").alias("y"), (F.col("s_suppkey") % 3).alias("z")).distinct()
    atlas = s.withColumn("code", 1 + F.col("x") + 10 * F.col("y") + 1000 * F.col("z"))
    return D.resampled_codes(cells, atlas, (8, 25, 3), GRID, ATLAS).select("p_partkey", "code")


@query("best_layer_volume", """WITH m AS (SELECT s_suppkey AS x, s_nationkey AS y, 0 AS z, row_number() OVER (ORDER BY s_suppkey, s_nationkey) - 1 AS place FROM supplier),
v AS (SELECT l_suppkey % (SELECT count(*) FROM supplier) AS place, l_linenumber AS layer, avg(l_quantity) AS v FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY 1, 2),
b AS (SELECT place, layer, v FROM v QUALIFY row_number() OVER (PARTITION BY place ORDER BY v DESC, layer) = 1)
SELECT x, y, layer, round(v, 6) AS value FROM m LEFT JOIN b USING (place)""")
def best_layer_volume(spark, d):
    mask = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), F.col("s_nationkey").alias("y"), F.lit(0).alias("z"))
    n = mask.count()
    scores = table(spark, d, "lineitem").where("l_suppkey % 5 > 0").select((F.col("l_suppkey") % n).alias("place"), F.col("l_linenumber").alias("layer"), F.col("l_orderkey").alias("subject"), F.col("l_quantity").alias("value"))
    return D.best_layer_volume(scores, mask, "subject", "layer", "place", "value").select("x", "y", "layer", F.round("value", 6).alias("value"))
