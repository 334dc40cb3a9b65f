"""Selections of results and the panels built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.operators import survival as S
from tarnlake.operators.episodes import execution_steps


def where_equal(rows: DataFrame, **values) -> DataFrame:
    """Rows that equal the values that are given; a value of None asks nothing."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), [kv for kv in values.items() if kv[1] is not None], rows)


def agent_rows(rows: DataFrame, model: str, kind: str | None, pinned: dict[str, str]) -> DataFrame:
    """A model's rows; those of language models only in the pinned condition."""
    return where_equal(rows, model=model, **(pinned if kind == "llm" else {}))


#: The variant that models with a prefix have where it is there.
PREFERRED = (("qwen", "all"), ("ds", "compressed"))


def pick_variants(rows: DataFrame, model: str, variant: str, labelled: list[str]) -> tuple[DataFrame, DataFrame]:
    """(model, variant) to show of each model, and the models for which there is no telling: the
    preferred variant by the model's prefix, else the only one; labelled models take the first of
    several. Null variants are none; a model without any has a null."""
    w = Window.partitionBy(model)
    v = rows.groupBy(model, variant).agg(F.lit(1).alias("_one"))
    want = F.lit(None).cast("string")
    for prefix, name in reversed(PREFERRED):
        want = F.when(F.col(model).startswith(prefix), name).otherwise(want)
    v = v.withColumn("_want", want).withColumn("_hit", F.coalesce(F.col(variant) == F.col("_want"), F.lit(False)))
    per = v.groupBy(model).agg(F.count(variant).alias("_n"), F.min(variant).alias("_first"), F.bool_or("_hit").alias("_has"), F.max("_want").alias("_want"))
    per = per.withColumn("_open", ~F.col("_has") & (F.col("_n") > 1) & ~F.col(model).isin(labelled) if labelled else ~F.col("_has") & (F.col("_n") > 1))
    return per.where("not _open").select(model, F.when(F.col("_has"), F.col("_want")).otherwise(F.col("_first")).alias(variant)), per.where("_open").select(model)


def of_picked(rows: DataFrame, picked: DataFrame, model: str, variant: str) -> DataFrame:
    """Rows of the picked variants; all rows of a model whose pick is null."""
    p = picked.select(F.col(model).alias("_m"), F.col(variant).alias("_v"))
    return rows.join(p, (F.col(model) == F.col("_m")) & (F.col("_v").isNull() | (F.col(variant) == F.col("_v"))), "left_semi")


def in_layers(rows: DataFrame, general: list[int] | None, own: dict[str, list[int]], model: str, layer: str) -> DataFrame:
    """Rows of the allowed layers: a model's own list before the general one; without either all."""
    keep = F.lit(True) if general is None else F.col(layer).isin(general)
    for m, layers in own.items():
        keep = F.when(F.col(model) == m, F.col(layer).isin(layers)).otherwise(keep)
    return rows.where(keep)


def best_layers(rows: DataFrame, model: str, subject: str, layer: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(model, layer, mean) of the layer with the highest mean over subjects, ties to the lower layer;
    and the models whose layers don't all have the same subjects, which have none."""
    per = rows.groupBy(model, layer, subject).agg(F.avg(value).alias("_v"))
    lay = per.groupBy(model, layer).agg(F.avg("_v").alias("mean"), F.count("*").alias("_n"))
    all_ = rows.groupBy(model).agg(F.countDistinct(subject).alias("_all"))
    lay = lay.join(all_, model)
    uneven = lay.groupBy(model).agg(F.bool_or(F.col("_n") != F.col("_all")).alias("_u"))
    best = lay.join(uneven.where("not _u"), model).withColumn("_r", F.row_number().over(Window.partitionBy(model).orderBy(F.desc("mean"), layer)))
    return best.where("_r = 1").select(model, layer, "mean"), uneven.where("_u").select(model)


def row_top(rows: DataFrame, panel: list[str], bar: list[str], value: str) -> DataFrame:
    """Top of each panel: the highest mean + sem of its bars (sem of one row is 0), 0 at least."""
    m = S.mean_sem(rows, [*panel, *bar], value)
    return m.groupBy(*panel).agg(F.greatest(F.lit(0.0), F.max(F.col("mean") + F.coalesce("sem", F.lit(0.0)))).alias("top"))


def rates_by(rows: DataFrame, model: str, mode: str, modes: list[str], observed: str) -> DataFrame:
    """Solve rate (%) of each model, a column per mode; a mode without rows is 0."""
    r = rows.groupBy(model).pivot(mode, modes).agg(100 * F.avg(F.col(observed).cast("double")))
    return r.na.fill(0.0, modes)


def curves(rows: DataFrame, agent: list[str], panel: list[str], grid: DataFrame) -> DataFrame:
    """Event curves of each agent's panels, and their mean as the panel 'total' (null in panel)."""
    c = S.event_curve(S.cap_censored(rows, [*agent, *panel]), [*agent, *panel], grid)
    total = c.groupBy(*agent, "point", "x").agg(F.avg("share").alias("share"))
    return c.unionByName(total.withColumns({p: F.lit(None).cast(rows.schema[p].dataType) for p in panel}))


def peaks(density: DataFrame, group: list[str]) -> DataFrame:
    """The grid point with the highest density, ties to the first; none where all are 0."""
    d = density.where("density > 0").groupBy(*group).agg(F.max_by(F.struct("point", "density"), F.struct("density", -F.col("point"))).alias("m"))
    return d.select(*group, "m.point", "m.density")


def executions(episodes: DataFrame, keys: list[str], levels: int = 9) -> DataFrame:
    """A row for each win after a level's first one: its steps."""
    return episodes.where(F.col("level") < levels).select(*keys, F.explode(execution_steps()).alias("steps"))


def panel_list(rows: DataFrame, order: list[tuple[str, str]], game: str, cohort: str) -> DataFrame:
    """place, game, cohort of the fixed panels whose cohort is among the rows."""
    fixed = rows.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(order)], f"place int, {game} string, {cohort} string")
    return fixed.join(rows.select(cohort).distinct(), cohort, "left_semi")


def condition_name(layer: Column, models: dict[str, str]) -> Column:
    """Released path of a feature label llm_MODEL__SELECTION__STREAM_layer_N, null if it is none or
    its model isn't known. The end of the model's name says the condition."""
    parts = lambda i: F.regexp_extract(layer, r"^llm_(.+)__(all|compressed)__(main|attn|mlp)_layer_\d+$", i)
    model, condition = parts(1), F.lit("elaborate")
    out = model
    for end, name in reversed(ENDS):
        out = F.when(model.endswith(end), F.substring(model, F.lit(1), F.length(model) - len(end))).otherwise(out)
        condition = F.when(model.endswith(end), name).otherwise(condition)
    known = F.lit(None).cast("string")
    for key, name in models.items():
        known = F.when(out == key, name).otherwise(known)
    return F.when((model != "") & known.isNotNull(), F.concat(F.lit("model-features/lrm/"), known, F.lit("/"), condition, F.lit("--"), parts(2), F.lit("--"), parts(3), F.lit(".npz")))


#: Ends of model names and the conditions they stand for.
ENDS = (("_sugmin", "minimal"), ("_sugorc", "oracle"), ("_random", "elaborate-random-init"), ("_abl01", "elaborate-context-fraction-0.1"), ("_abl05", "elaborate-context-fraction-0.5"))
