"""Results by region, layer and model: membership, selection, completeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(rows: DataFrame, key: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row with the highest value of each key; ties to the first in the tie columns."""
    w = Window.partitionBy(*key).orderBy(F.col(value).desc(), *tie)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ranked_pick(rows: DataFrame, key: list[str], value: str, tie: list[str]) -> DataFrame:
    """pick: worst, median (n // 2 of the ascending order) and best row of each key."""
    w = Window.partitionBy(*key)
    r = rows.withColumn("_r", F.row_number().over(w.orderBy(value, *tie)) - 1).withColumn("_n", F.count("*").over(w))
    pick = F.explode(F.array_compact(F.array(F.when(F.col("_r") == 0, "worst"), F.when(F.col("_r") == F.expr("_n div 2"), "median"), F.when(F.col("_r") == F.col("_n") - 1, "best"))))
    return r.withColumn("pick", pick).drop("_r", "_n")


def in_all(rows: DataFrame, item: list[str], of: str) -> DataFrame:
    """Items that every value of `of` has."""
    n = rows.agg(F.countDistinct(of).alias("_n"))
    c = rows.groupBy(*item).agg(F.countDistinct(of).alias("_c"))
    return c.join(F.broadcast(n)).where("_c = _n").select(*item)


def missing_cells(expected: DataFrame, present: DataFrame, allowed: DataFrame, key: list[str]) -> DataFrame:
    """Expected cells that are neither present nor allowed to be missing."""
    return expected.join(present, key, "left_anti").join(allowed, key, "left_anti")


def declared(rows: DataFrame, conditions: DataFrame, key: list[str]) -> DataFrame:
    """Rows that meet one of the declared conditions; null in a condition means null."""
    c = conditions.select(*[F.col(k).alias(f"_{k}") for k in key])
    on = F.lit(True)
    for k in key:
        on = on & rows[k].eqNullSafe(c[f"_{k}"])
    return rows.join(c, on, "left_semi")


def depth_layers(n_layers: int, k: int, have: list[int]) -> list[int]:
    """k of the layers in `have`: for each of k targets from 1 to n_layers, evenly spaced, in turn
    the nearest free one; ties to the smaller. k or fewer layers are all taken."""
    free = sorted(set(have))
    if len(free) <= k:
        return free
    out = []
    for i in range(k):
        want = 1 + (n_layers - 1) * (i / (k - 1) if k > 1 else 0)
        out.append(min(free, key=lambda x: (abs(x - want), x)))
        free.remove(out[-1])
    return sorted(out)


def pick_depths(rows: DataFrame, model: str, subject: str, layer: str, k: int, n_layers: DataFrame) -> DataFrame:
    """model, layer: depth_layers() of the layers that all subjects of a model have. n_layers
    (model, n_layers) has the models' full depths; a model without one is left out. The layers of
    a model are few; they are made distinct before they are gathered."""
    d = rows.select(model, subject, layer).distinct()
    n = d.groupBy(model).agg(F.countDistinct(subject).alias("_n"))
    common = d.groupBy(model, layer).agg(F.count("*").alias("_c")).join(n, model).where("_c = _n").select(model, layer)
    schema = common.schema

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        got = depth_layers(int(group["n_layers"].iloc[0]), k, [int(x) for x in group[layer]])
        return pd.DataFrame({model: group[model].iloc[0], layer: got})

    return common.join(n_layers, model).groupBy(model).applyInPandas(pick, schema)


def exclude(rules: list[str], agent: str, cohort: str, game: str, prefix: str = "cohort") -> Column:
    """Keep condition for rules agent[:cohort[:game]]; a single token with the cohort prefix is a
    cohort. The parts of a rule hold together, rules stand beside each other."""
    out = F.lit(False)
    for rule in rules:
        parts = rule.split(":")
        names = [cohort] if len(parts) == 1 and parts[0].startswith(prefix) else [agent, cohort, game]
        one = F.lit(True)
        for name, value in zip(names, parts):  # noqa: B905
            one = one & F.col(name).eqNullSafe(F.lit(value))
        out = out | one
    return ~out
