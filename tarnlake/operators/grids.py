"""Volumes as tables of cells: labels of an atlas, codes brought onto another grid, masks and values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.core import checks


def atlas_labels(lines: DataFrame, order: str, line: str) -> DataFrame:
    """(name, code) of an atlas' label lines, ABBREVIATION NAME CODE apart by white space: the last two
    words count. Empty lines, comments (#), lines of fewer words or without a whole number are none;
    of a name that comes again the last code holds. No label at all raises."""
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    words = F.split(text, r"\s+")
    code = F.when(F.element_at(words, -1).rlike(r"^[+-]?\d+$"), F.element_at(words, -1).cast("int"))
    rows = lines.where((text != "") & ~text.startswith("#") & (F.size(words) >= 3)).select(F.get(words, F.size(words) - 2).alias("name"), code.alias("code"), order).where("code is not null")
    found = rows.groupBy("name").agg(F.max_by("code", order).alias("code"))
    if found.isEmpty():
        raise checks.IntegrityError("no labels")
    return found


def affine(numbers: list[float]) -> np.ndarray:
    """A 4 by 4 matrix from its 16 numbers, or 12 without the last row; one that isn't finite or can't be
    inverted raises."""
    a = np.asarray([*numbers, 0, 0, 0, 1][:16] if len(numbers) == 12 else numbers, float)
    if a.shape != (16,) or not np.isfinite(a).all() or abs(np.linalg.det(a.reshape(4, 4)[:3, :3])) == 0:
        raise ValueError("an affine has 12 or 16 finite numbers and an inverse")
    return a.reshape(4, 4)


def placed(matrix: np.ndarray, axes: tuple[str, str, str] = ("x", "y", "z")) -> list[Column]:
    """Where the cells of axes lie under an affine."""
    return [sum((F.col(c) * F.lit(float(m)) for c, m in zip(axes, row, strict=False)), F.lit(float(row[3]))) for row in matrix[:3].tolist()]


def resampled_codes(cells: DataFrame, atlas: DataFrame, shape: tuple[int, int, int], grid: list[float], atlas_grid: list[float]) -> DataFrame:
    """cells (x, y, z and any others) with the code of the nearest cell of the atlas (x, y, z, code;
    those left out are 0) of the given shape: a cell's centre is carried to the atlas by its own grid's
    affine and the inverse of the atlas'. A place half way goes up; one before the first or past the
    last centre of an axis is outside, and 0. One join on three whole numbers; codes aren't mixed."""
    m = np.linalg.inv(affine(atlas_grid)) @ affine(grid)
    names = ["_i", "_j", "_k"]
    at = placed(m)
    inside = F.lit(True)
    for p, n in zip(at, shape, strict=True):
        inside = inside & (p >= 0) & (p <= n - 1)
    carried = cells.withColumns({c: F.when(inside, F.floor(p + 0.5)) for c, p in zip(names, at, strict=True)})
    codes = atlas.select(*[F.col(c).cast("long").alias(n) for c, n in zip("xyz", names, strict=True)], F.col("code").cast("int").alias("code"))
    return carried.join(codes, names, "left").withColumn("code", F.coalesce("code", F.lit(0))).drop(*names)


def flat_places(cells: DataFrame, key: list[str]) -> DataFrame:
    """cells with place: the number of the cell in its volume's row-major order of cells."""
    return cells.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("x", "y", "z")) - 1)


def best_layer_volume(scores: DataFrame, mask: DataFrame, subject: str, layer: str, place: str, value: str) -> DataFrame:
    """x, y, z, layer and value of each cell of the mask: its subjects' mean by layer, of the layer where
    that is highest (ties to the lower one). scores: subject, layer, place (in the mask's order), value;
    mask: x, y, z. A cell without scores has nulls; places outside of the mask raise."""
    numbered = flat_places(mask.select("x", "y", "z"), [])
    checks.require_empty(scores.join(numbered, scores[place] == numbered["place"], "left_anti").select(place), "places of the mask")
    mean = scores.groupBy(place, layer).agg(F.avg(value).alias("_v"))
    best = mean.groupBy(place).agg(F.max_by(F.struct(F.col(layer).alias("layer"), F.col("_v").alias("value")), F.struct("_v", -F.col(layer))).alias("_b"))
    return numbered.join(best.withColumnRenamed(place, "place"), "place", "left").select("x", "y", "z", "_b.layer", "_b.value")
