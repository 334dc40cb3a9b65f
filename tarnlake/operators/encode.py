"""Features and scores of encoding models: folds, scaling, correlation, projection, ridge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.core import checks


def folds(rows: DataFrame, partition: str, most: int = 1000) -> DataFrame:
    """Leave one partition out: each row once per fold, with is_test. The partitions, at most `most`
    (more raise), are gathered into one row."""
    all_ = checks.bounded(rows.select(F.col(partition).alias("fold")).distinct(), most, "partitions").agg(F.collect_list("fold").alias("_f"))
    return rows.join(F.broadcast(all_)).withColumn("fold", F.explode("_f")).drop("_f").withColumn("is_test", F.col(partition) == F.col("fold"))


def scaled_by_train(rows: DataFrame, key: list[str], value: str, train: str, least: float = 1e-6) -> DataFrame:
    """z: value by mean and deviation (ddof 1) of the key's training rows; no spread: 0."""
    s = rows.where(train).groupBy(*key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > least, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.join(s, key, "left").withColumn("z", z).drop("_m", "_s")


def correlation(rows: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """r, 0 where the root of the product of the sums of squares is at most 1e-10, within [-1, 1].
    Moments are centred as they are merged, so that large means don't cancel."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    s = rows.groupBy(*key).agg(F.covar_pop(a, b).alias("_c"), F.var_pop(a * both).alias("_a"), F.var_pop(b * both).alias("_b"), F.count("*").alias("n"))
    den = F.sqrt(F.col("_a")) * F.sqrt(F.col("_b"))
    r = F.when(den * F.col("n") > 1e-10, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / den))).otherwise(0.0)
    return s.select(*key, r.alias("r"), "n")


def one_hot(code: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == code).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def mean_vectors(rows: DataFrame, key: list[str], vector: str) -> DataFrame:
    """Element-wise mean of the vectors of each key, in the order of the elements."""
    each = rows.select(*key, F.posexplode(vector).alias("i", "x")).groupBy(*key, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e")).select(*key, F.col("e.m").alias("vector"))


def valid_rows(vector: str) -> Column:
    """Rows whose elements don't add up to 0 (all zeros mean missing; cancelling ones go too)."""
    return F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x) != 0


def gram_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial n, sum and cross products of vectors (column v) with a target (column y)."""
    n, total, cross = 0, None, None
    for b in batches:
        if not len(b):
            continue
        x = np.column_stack([np.stack(b["v"].to_numpy()).astype(np.float64), b["y"].to_numpy(np.float64)])
        if total is None:
            total, cross = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
        n += len(x)
        total += x.sum(0)
        cross += x.T @ x
    if n:
        yield pd.DataFrame({"i": np.arange(len(total)), "n": n, "total": total, "cross": list(cross)})


def moments(rows: DataFrame, vector: str, target: str | Column, most: int = 2048) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred cross products of [vector, target]: one row per element and task is
    shuffled, whatever the number of rows. Vectors wider than `most` raise: width squared numbers
    reach the driver (32 MB at 2,048)."""
    wide = rows.agg(F.max(F.size(vector))).first()[0] or 0
    if wide > most:
        raise ValueError(f"vectors of {wide} elements, at most {most} can be solved on the driver")
    part = rows.select(F.col(vector).alias("v"), (F.col(target) if isinstance(target, str) else target).cast("double").alias("y")).mapInPandas(gram_sums, "i long, n long, total double, cross array<double>")
    each = part.select("i", "n", "total", F.posexplode("cross").alias("j", "c")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("c").alias("c"))
    got = each.groupBy("i").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("j", "c")))["c"].alias("c")).toPandas()
    if not len(got):
        return 0, np.zeros(0), np.zeros((0, 0))
    n, k = int(got["n"].iloc[0]), len(got)
    mean, cross = np.zeros(k), np.zeros((k, k))
    cross[got["i"]] = np.stack(got["c"].to_numpy())
    mean[got["i"]] = got["total"] / n
    return n, mean, cross - n * np.outer(mean, mean)


def principal_components(rows: DataFrame, vector: str, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the leading components (rows) of the vectors; signs: largest entry positive."""
    _, mean, cross = moments(rows, vector, F.lit(0.0))
    k = len(mean) - 1
    values, vectors = np.linalg.eigh(cross[:k, :k])
    top = vectors[:, np.argsort(-values)[:n_components]].T
    sign = np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])
    return mean[:k], top * sign[:, None]


def ridge(rows: DataFrame, vector: str, target: str, alphas: list[float]) -> dict[float, tuple[np.ndarray, float]]:
    """Weights and intercept for each alpha from one pass over the rows."""
    _, mean, cross = moments(rows, vector, target)
    k = len(mean) - 1
    out = {}
    for a in alphas:
        w = np.linalg.solve(cross[:k, :k] + a * np.eye(k), cross[:k, k])
        out[a] = (w, float(mean[k] - mean[:k] @ w))
    return out


def linear(vector: str, weights: np.ndarray, intercept: float) -> Column:
    return dot(F.col(vector), F.array(*[F.lit(float(w)) for w in weights])) + intercept
