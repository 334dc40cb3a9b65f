"""Ordered operators that never cross the boundary of a play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.core.shared import materialize


def lagged(rows: DataFrame, play: list[str], order: list[str], col: str, lags: list[int]) -> DataFrame:
    """lag_k for each k; before the play's start its first value."""
    w = Window.partitionBy(*play).orderBy(*order)
    first = F.first(col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({f"lag_{k}": F.coalesce(F.lag(col, k).over(w), first) for k in lags})


def carried(rows: DataFrame, play: list[str], order: list[str], col: str, start: float = 0.0) -> DataFrame:
    """col_filled: the last value that isn't null; `start` before the first."""
    w = Window.partitionBy(*play).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{col}_filled", F.coalesce(F.last(col, ignorenulls=True).over(w), F.lit(start)))


def difference(col: str, w) -> Column:
    """First difference, 0 for the first row."""
    return F.col(col) - F.coalesce(F.lag(col).over(w), F.col(col))


def relative_position(w_order, w_all) -> Column:
    """(i - 1) / max(n - 1, 1) of the i-th of n rows."""
    return (F.row_number().over(w_order) - 1) / F.greatest(F.count("*").over(w_all) - 1, F.lit(1))


def whitened(rows: DataFrame, play: list[str], order: list[str], col: str, rho: str) -> DataFrame:
    """white = x(t) - rho x(t - 1); the first row of a play goes."""
    w = Window.partitionBy(*play).orderBy(*order)
    return rows.withColumn("_p", F.lag(col).over(w)).where("_p is not null").withColumn("white", F.col(col) - F.col(rho) * F.col("_p")).drop("_p")


def lag_one_correlation(rows: DataFrame, series: list[str], order: list[str], col: str) -> DataFrame:
    """rho per series: Pearson correlation of neighbours; no spread: 0. Moments are centred as they
    are merged."""
    w = Window.partitionBy(*series).orderBy(*order)
    p = rows.select(*series, F.col(col).alias("y"), F.lag(col).over(w).alias("x")).where("x is not null and y is not null")
    m = p.groupBy(*series).agg(F.covar_pop("x", "y").alias("_c"), (F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop("y"))).alias("_d"))
    return m.select(*series, F.when(F.col("_d") > 0, F.col("_c") / F.col("_d")).otherwise(0.0).alias("rho"))


def numbered(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """rows with their place (from 0) in the order of the whole table. The table is dealt into ranges
    and written, each range is numbered by itself, and a table with a row per range has what
    comes before it: no task sees more than a range. Rows that tie stay together."""
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).withColumn("_p", F.spark_partition_id())
    dealt = materialize(dealt)
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1 + F.col("_b")
    return dealt.join(before, "_p").withColumn(name, place.cast("long")).drop("_p", "_b")


def offsets(rows: DataFrame, order: list[str], size: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with the sum of `size` over all rows before them in the order of the whole table: where each
    one's own part of one long array begins. As numbered(): ranges are summed by themselves, and a table
    with a row per range has what comes before it. Rows that tie are in the order of their sizes."""
    dealt = materialize(rows.repartitionByRange(*([parts] if parts else []), *order).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy("_p").agg(F.sum(size).alias("_n"))  # a row per range
    before = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    own = F.sum(size).over(Window.partitionBy("_p").orderBy(*order, size).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    return dealt.join(before, "_p").withColumn(name, (own + F.col("_b")).cast("long")).drop("_p", "_b")


def median(rows: DataFrame, col: str) -> DataFrame:
    """One row with the median of a column without its nulls, and n: the middle rows of the whole order, so
    that no task holds all values. Null of none."""
    own = rows.select(F.col(col).cast("double").alias("_x")).where("_x is not null")
    at = numbered(own, ["_x"], "_i")
    n = at.agg(F.count("*").alias("n"))  # a single row
    middle = at.join(F.broadcast(n), (F.col("_i") == F.expr("(n - 1) div 2")) | (F.col("_i") == F.expr("n div 2")))
    return n.join(middle.agg(F.avg("_x").alias(col))).select(col, "n")


def stacked(rows: DataFrame, play: list[str], order: list[str], col: str, n: int) -> DataFrame:
    """stack: the last n values, padded on the left with the play's first."""
    w = Window.partitionBy(*play).orderBy(*order)
    last = F.collect_list(col).over(w.rowsBetween(-(n - 1), 0))
    first = F.first(col).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_l", last).withColumn("_f", first).withColumn("stack", F.concat(F.array_repeat("_f", F.lit(n) - F.size("_l")), "_l")).drop("_l", "_f")


def run_starts(rows: DataFrame, play: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """The first row of each run of equal cols (nulls are equal)."""
    w = Window.partitionBy(*play).orderBy(*order)
    same = F.lag(F.struct(*cols)).over(w).eqNullSafe(F.struct(*cols))
    return rows.withColumn("_n", F.row_number().over(w)).withColumn("_s", same).where("_n = 1 or not _s").drop("_n", "_s")


def first_seen(rows: DataFrame, play: list[str], order: list[str], item: list[str]) -> DataFrame:
    """The first row of each item in a play, numbered in the order of discovery."""
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*play, *item).orderBy(*order))).where("_r = 1").drop("_r")
    return one.withColumn("found", F.row_number().over(Window.partitionBy(*play).orderBy(*order)))


def islands(rows: DataFrame, key: list[str], v: str) -> DataFrame:
    """first, last and size of each run of consecutive whole numbers."""
    d = rows.select(*key, v).distinct()
    g = d.withColumn("_i", F.col(v) - F.row_number().over(Window.partitionBy(*key).orderBy(v)))
    return g.groupBy(*key, "_i").agg(F.min(v).alias("first"), F.max(v).alias("last"), F.count("*").alias("size")).drop("_i")
