"""Artifact manifests: ordered rules, evidence, identities, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(key: Column, rules: list[tuple[str, str, str | None, str]], default: str = "defer") -> tuple[Column, Column]:
    """(rule, decision) of the first rule (id, prefix, pattern, decision) whose prefix starts the key
    and whose pattern, if any, matches the whole key; else null and the default."""
    rule, decision = F.lit(None).cast("string"), F.lit(default)
    for name, prefix, pattern, what in reversed(rules):
        hit = key.startswith(prefix)
        if pattern:
            hit = hit & key.rlike(f"^(?:{pattern})$")
        rule, decision = F.when(hit, name).otherwise(rule), F.when(hit, what).otherwise(decision)
    return rule, decision


def by_first_segment(rows: DataFrame, key: str, rules: DataFrame, segment: str, sep: str = "/") -> DataFrame:
    """rows with the rule of their key's first segment (null without); rules has a row per segment."""
    return rows.join(rules, F.element_at(F.split(F.col(key), sep), 1) == F.col(segment), "left")


def percent_encoded(path: Column) -> Column:
    """Each segment percent-encoded, blanks as %20 and ~ as itself."""
    one = lambda s: F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def artifact_id(*cols: Column) -> Column:
    """SHA-256 of the columns' JSON array."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in cols])), 256)


def stable_index(name: Column, n: int) -> Column:
    """Index from 0 to n - 1 by the first four bytes of the name's SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % n


def conflicting_copies(rows: DataFrame, key: list[str], content: str) -> DataFrame:
    """Keys whose rows don't all have the same content."""
    return rows.groupBy(*key).agg(F.countDistinct(content).alias("contents"), F.count("*").alias("n")).where("contents > 1")


def counters(rows: DataFrame, by: list[str], size: str, member: str, example: str, n: int = 3) -> DataFrame:
    """objects, bytes, distinct members and the first n examples of each group. Examples are taken
    from the smallest, so that no group is gathered: each task keeps n."""
    agg = rows.groupBy(*by).agg(F.count("*").alias("objects"), F.sum(size).alias("bytes"), F.countDistinct(member).alias("members"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(example)
    ex = rows.select(*by, example).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    ex = ex.groupBy(*by).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return agg.join(ex, by)


def merge_verified(manifest: DataFrame, evidence: DataFrame, key: str, same: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest rows with verified (evidence of the same generation exists); evidence that differs
    in `same`; evidence for no row. The last two must be empty."""
    e = evidence.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = manifest.join(e, F.col(key) == F.col("_k"), "left")
    merged = both.withColumn("verified", F.col("_k").isNotNull() & equal).select(*manifest.columns, "verified")
    return merged, both.where(F.col("_k").isNotNull() & ~equal).select(*manifest.columns), evidence.join(manifest.select(key), key, "left_anti")


def enrich(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, value: str) -> DataFrame:
    """value by the first key, else by the second."""
    a = table.select(F.col(key).alias("_a"), F.col(value).alias("_va"))
    b = table.select(F.col(key).alias("_b"), F.col(value).alias("_vb"))
    both = rows.join(a, F.col(first) == F.col("_a"), "left").join(b, F.col(second) == F.col("_b"), "left")
    return both.withColumn(value, F.coalesce("_va", "_vb")).drop("_a", "_b", "_va", "_vb")
