"""Queries over encoding models: design rows by fold and banded ridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.operators import fit as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as time points: 25 in a play, plays in three partitions, two bands of a vector's halves."""
    play = F.floor(F.col("vec_id") / 25).alias("play")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), play, (play % 3).alias("part"), F.slice("embedding", 1, 32).alias("main"), F.slice("embedding", 33, 32).alias("rest"), "label")


BANDS = ["main", "rest"]


@query("design_rows", """WITH v AS (SELECT vec_id AS row, vec_id // 25 AS play, (vec_id // 25) % 3 AS part, embedding, list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE))) <> 0 AS valid FROM embeddings),
e AS (SELECT row, play, part, valid, i, CAST(embedding[i] AS DOUBLE) AS x FROM v, range(1, 65) r(i)),
s AS (SELECT fold, i, avg(x) AS m, stddev_samp(x) AS s FROM e JOIN (SELECT DISTINCT part AS fold FROM v WHERE valid) f ON fold <> part WHERE valid GROUP BY 1, 2),
z AS (SELECT fold, row, play, part, valid, i, CASE WHEN valid AND s > 1e-6 THEN (x - m) / s ELSE 0 END AS z FROM e JOIN s USING (i)),
g AS (SELECT *, first_value(z) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3, lag(z, 4) OVER w AS z4, lag(z, 5) OVER w AS z5 FROM z WINDOW w AS (PARTITION BY fold, play, i ORDER BY row))
SELECT fold, row, fold = part AS is_test, CASE WHEN i <= 32 THEN 'main' ELSE 'rest' END AS band, CAST((i - 1) % 32 AS INTEGER) AS element, round(coalesce(z2, z1), 6) AS lag_2, round(coalesce(z3, z1), 6) AS lag_3, round(coalesce(z4, z1), 6) AS lag_4, round(coalesce(z5, z1), 6) AS lag_5
FROM g WHERE valid""")
def design_rows(spark, d):
    rows = X.design_rows(vectors(spark, d), BANDS, ["play"], "row", "part")
    each = rows.select("fold", "row", "is_test", F.explode(F.map_from_arrays(F.array(*[F.lit(b) for b in BANDS]), F.array(*BANDS))).alias("band", "v"))
    lags = F.arrays_zip(*[F.slice("v", 32 * k + 1, 32).alias(f"l{k}") for k in range(4)])
    return each.select("fold", "row", "is_test", "band", F.posexplode(lags).alias("element", "l")).select("fold", "row", "is_test", "band", "element", *[F.round(F.col(f"l.l{k}"), 6).alias(f"lag_{k + 2}") for k in range(4)])


@query("banded_fit")
def banded_fit(spark, d):
    """Each label, as a series of zeros and ones, from the vectors of the rows before: tested against plain ridge."""
    rows = vectors(spark, d)
    labels = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("target")
    targets = rows.select("row", "label", labels).select("row", "target", (F.col("label") == F.col("target")).cast("double").alias("y"))
    got = X.banded_fit(X.design_rows(rows, BANDS, ["play"], "row", "part"), BANDS, "row", "part", targets, X.Search(n_iter=10))
    return got.select("fold", "target", "draw", F.round("alpha", 6).alias("alpha"), F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), F.round("r", 6).alias("r"), F.transform("r_bands", lambda r: F.round(r, 6)).alias("r_bands"))
