"""Integrity rules as queries: each returns the rows that break it, and must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A rule has rows that break it."""


def require_empty(bad: DataFrame, what: str) -> None:
    rows = bad.limit(3).collect()
    if rows:
        raise IntegrityError(f"{what}: {[r.asDict() for r in rows]}")


def bounded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows, if they are at most `most`: for tables that are broadcast or gathered."""
    if rows.limit(most + 1).count() > most:
        raise IntegrityError(f"more than {most} {what}")
    return rows


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(parents, key, "left_anti")


def gaps(rows: DataFrame, key: list[str], start: str, stop: str) -> DataFrame:
    """Slices that don't begin where the one before ends (the first at 0) or end before they begin."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    prev = F.coalesce(F.lag(stop).over(w), F.lit(0))
    return rows.withColumn("expected", prev).where((F.col(start) != F.col("expected")) | (F.col(stop) < F.col(start)))


def not_a_sequence(rows: DataFrame, key: list[str], step: str) -> DataFrame:
    """Rows whose step isn't their place (from 0) in the order of steps."""
    w = Window.partitionBy(*key).orderBy(step)
    return rows.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") != F.col(step))


def backwards(rows: DataFrame, key: list[str], order: list[str], t: str) -> DataFrame:
    """Rows whose t is below that of the row before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("before", F.lag(t).over(w)).where(F.col(t) < F.col("before"))


def not_finite(rows: DataFrame, cols: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        x = F.col(c).cast("double")
        bad = bad | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))
    return rows.where(bad)


def mixed_dimension(rows: DataFrame, key: list[str], dim: str) -> DataFrame:
    """Keys with more than one value of a dimension that must be fixed."""
    return rows.groupBy(*key).agg(F.countDistinct(dim).alias("values")).where("values > 1")


def content_conflicts(rows: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys with copies of different content."""
    return rows.groupBy(*key).agg(F.countDistinct(digest).alias("digests")).where("digests > 1")


def unsafe_paths(rows: DataFrame, path: str) -> DataFrame:
    """Paths that are empty, absolute, or have an empty, '.' or '..' segment or a backslash."""
    p = F.col(path)
    return rows.where(p.isNull() | (p == "") | p.contains("\\") | F.exists(F.split(p, "/"), lambda s: s.isin("", ".", "..")))
