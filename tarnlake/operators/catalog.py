"""Catalogues of artifacts: tokens of keys, totals, earlier pins, inputs by digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of a key that say the condition.
RATIONALES = ("action-only", "copied-reasoning", "prompted-rationale")
SUGGESTIONS = ("minimal", "elaborate", "oracle")


def key_tokens(key: Column) -> dict[str, Column]:
    """subject (sub-NN), model (the first segment with the prefix model-), rationale and suggestion
    (the first token of each kind; | also parts tokens); null where a key has none."""
    number = F.regexp_extract(key, r"(?:^|/|\|)(?:sub-|subj)(\d+)(?=/|_|\||\.)", 1)
    tokens = F.split(F.replace(key, F.lit("|"), F.lit("/")), "/")
    one_of = lambda names: F.get(F.filter(tokens, lambda t: t.isin(*names)), F.lit(0))
    digits = number.cast("long").cast("string")
    return {
        "subject": F.when(number != "", F.concat(F.lit("sub-"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))),
        "model": F.get(F.filter(F.split(key, "/"), lambda t: t.startswith("model-")), F.lit(0)),
        "rationale": one_of(RATIONALES),
        "suggestion": one_of(SUGGESTIONS),
    }


def chosen(rows: DataFrame, **allowed: list[str]) -> DataFrame:
    """Rows whose columns have one of the allowed values; an empty list allows all."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).isin(*kv[1])), [kv for kv in allowed.items() if kv[1]], rows)


def component_totals(rows: DataFrame, by: list[str], size: str, digest: str) -> DataFrame:
    """Files, bytes and files with a digest of each component."""
    return rows.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(F.coalesce(F.col(digest) != "", F.lit(False))).alias("with_digest"))


def over_budget(rows: DataFrame, size: str, most: int) -> DataFrame:
    """A row with the total if the sizes together are more than `most`; must be empty."""
    return rows.agg(F.sum(size).alias("total")).where(F.col("total") > most)


def with_earlier_pins(rows: DataFrame, pins: DataFrame, key: str, same: list[str], take: list[str]) -> DataFrame:
    """Rows with the pinned values of `take` where the key is pinned and all of `same` are as they
    were (nulls are equal), and reused. pins has a key once (see checks.duplicate_keys)."""
    p = pins.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in same], *[F.col(c).alias(f"_t_{c}") for c in take], F.lit(True).alias("_pin"))
    both = rows.join(p, key, "left")
    hit = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in same], F.coalesce("_pin", F.lit(False)))
    both = both.withColumn("reused", hit).withColumns({c: F.when(F.col("reused"), F.col(f"_t_{c}")).otherwise(F.col(c)) for c in take})
    return both.select(*rows.columns, "reused")


def unmet_inputs(rows: DataFrame, path: str, digest: str, inputs: dict[str, tuple[str, str]]) -> DataFrame:
    """(path, input, error) of inputs (name: columns of its path and digest) that rows name and that
    aren't among the rows, or have another digest or none; must be empty."""
    have = rows.select(F.col(path).alias("_path"), F.col(digest).alias("_digest"), F.lit(True).alias("_here"))
    out = []
    for name, (p, d) in inputs.items():
        j = rows.where(F.coalesce(F.col(p).cast("string") != "", F.lit(False))).select(path, F.col(p).alias("_path"), F.col(d).alias("_want")).join(have, "_path", "left")
        error = F.when(F.col("_here").isNull(), "missing").when(~F.coalesce((F.col("_want") != "") & (F.col("_want") == F.col("_digest")), F.lit(False)), "digest")
        out.append(j.select(path, F.lit(name).alias("input"), error.alias("error")).where("error is not null"))
    return reduce(DataFrame.unionByName, out)


def report(rows: DataFrame, counts: dict[str, Column], distinct: dict[str, str], histograms: list[str]) -> DataFrame:
    """(name, value, n): counts of rows that meet a condition, distinct values of a column, and how
    often each value of the histograms' columns is there. value is null for the former two."""
    named = {**{n: F.count_if(c) for n, c in counts.items()}, **{n: F.countDistinct(c) for n, c in distinct.items()}}
    one = rows.agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in named.items()]).unpivot([], ["rows", *named], "name", "n")
    each = [rows.groupBy(F.col(h).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(h).alias("name"), "value", "n") for h in histograms]
    return reduce(DataFrame.unionByName, each, one.select("name", F.lit(None).cast("string").alias("value"), "n"))


def merged_counters(rows: DataFrame, counters: str, by: list[str]) -> DataFrame:
    """The maps of counters of all rows added up, a row per name."""
    return rows.select(*by, F.explode(counters).alias("name", "_n")).groupBy(*by, "name").agg(F.sum("_n").alias("n"))


def without_fields(items: Column, *fields: str) -> Column:
    """An array of records without some of their fields."""
    return F.transform(items, lambda x: x.dropFields(*fields))


def contradicted(rows: DataFrame, recorded: dict[str, str]) -> DataFrame:
    """Rows whose recorded columns differ from what their names say (recorded: named); a record that
    is null says nothing; must be empty."""
    bad = [F.col(r).isNotNull() & ~F.col(r).cast("string").eqNullSafe(F.col(n).cast("string")) for r, n in recorded.items()]
    return rows.where(reduce(lambda a, b: a | b, bad))
