"""Observations of frames: sampling, objects in space, masks and regions, sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.windows import numbered


def every(rows: DataFrame, play: list[str], order: list[str], k: int) -> DataFrame:
    """Each k-th row of a play, the first included."""
    w = Window.partitionBy(*play).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % k == 0).drop("_n")


def key_moments(rows: DataFrame, play: list[str], order: list[str], outcome: str, score: str, item: str) -> DataFrame:
    """Rows with a final outcome, a score other than the one before (the first never counts), or the
    first mention of an item; reason says which, in that order."""
    w = Window.partitionBy(*play).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(*play, item).orderBy(*order)) == 1
    reason = F.when(F.col(outcome).isin("win", "loss"), "outcome").when(F.col(score) != F.lag(score).over(w), "score").when(first, "first")
    return rows.withColumn("reason", reason).where("reason is not null")


def not_waiting(rows: DataFrame, action: str, waits: tuple[str, ...]) -> DataFrame:
    """Rows with another action than waiting; a null action is none."""
    return rows.where(~F.coalesce(F.col(action).isin(*waits), F.lit(True)))


#: The ways of sampling by name, each a function of the rows and its own columns.
SAMPLERS = {"all": lambda rows: rows, "non_wait": not_waiting, "key_moments": key_moments}


def sampled(rows: DataFrame, way: str, **how) -> DataFrame:
    """Rows by a named way of sampling; an unknown one raises."""
    if way not in SAMPLERS:
        raise ValueError(f"no such way: {way}; there are {sorted(SAMPLERS)}")
    return SAMPLERS[way](rows, **how)


def next_position(frames: DataFrame, key: list[str], frame: str, cols: list[str]) -> DataFrame:
    """Objects with the position that they have in the next frame, their own where they are gone."""
    nxt = frames.select(*key, (F.col(frame) - 1).alias(frame), *[F.col(c).alias(f"_{c}") for c in cols])
    return frames.join(nxt, [*key, frame], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])


def resolved(events: DataFrame, objects: DataFrame, play: str, frame: str, colour: str, uid: str) -> DataFrame:
    """events with the first object of their colour in the frame before, else in their own."""
    one = objects.groupBy(play, frame, colour).agg(F.min(uid).alias("_u"))
    before = one.select(play, (F.col(frame) + 1).alias(frame), colour, F.col("_u").alias("_b"))
    both = events.join(before, [play, frame, colour], "left").join(one, [play, frame, colour], "left")
    return both.withColumn(uid, F.coalesce("_b", "_u")).drop("_b", "_u")


def overlaps(boxes: DataFrame, key: list[str], uid: str, size: float) -> DataFrame:
    """Pairs (uid < other) of boxes of one size at (x, y) that overlap. A box is put into the grid
    cells that it touches, and boxes meet by cell only."""
    cell = lambda c: F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size) / size))
    cells = boxes.withColumn("_cx", F.explode(cell("x"))).withColumn("_cy", F.explode(cell("y")))
    other = cells.select(*key, "_cx", "_cy", F.col(uid).alias("other"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    both = cells.join(other, [*key, "_cx", "_cy"]).where((F.col(uid) < F.col("other")) & (F.abs(F.col("x") - F.col("_x")) < size) & (F.abs(F.col("y") - F.col("_y")) < size))
    return both.select(*key, uid, "other").distinct()


def index_in(mask: DataFrame, common: DataFrame, key: list[str], xyz: list[str]) -> DataFrame:
    """Voxels of the common mask with their place (from 0, by coordinates) in each mask of `key`: the
    place in the order of all masks, less that of the mask's first voxel."""
    at = numbered(mask, [*key, *xyz], "_at")
    first = at.groupBy(*key).agg(F.min("_at").alias("_first"))
    place = at.join(first, key).withColumn("place", (F.col("_at") - F.col("_first")).cast("int")).drop("_at", "_first")
    return place.join(common.select(*xyz), xyz, "left_semi")


def members(voxels: DataFrame, regions: DataFrame, code: str) -> DataFrame:
    """Voxels by region; regions (region, codes) may overlap."""
    return voxels.join(regions.select("region", F.explode("codes").alias(code)), code)


def lateral(regions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, side, code) of each region name with its suffix _L, _R or none, and names without."""
    sides = regions.select("name", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(x).alias("x")) for s, x in (("left", "_L"), ("right", "_R"), ("midline", ""))])).alias("s"))
    found = sides.select("name", "s.side", F.concat("name", "s.x").alias("label")).join(labels, "label").select("name", "side", "code")
    return found, regions.join(found.select("name"), "name", "left_anti")


def pooled(vector: Column, width: int, target: int) -> Column:
    """Adaptive mean pooling of an array of `width` numbers to `target`: bin i covers
    floor(i width / target) up to ceil((i + 1) width / target), so that bins overlap when it grows."""
    bins = [(i * width // target, -(-(i + 1) * width // target)) for i in range(target)]
    mean = lambda a, b: F.aggregate(F.slice(vector, a + 1, b - a), F.lit(0.0), lambda s, x: s + x.cast("double")) / (b - a)
    return F.array(*[mean(a, b) for a, b in bins])


def shuffled_within(rows: DataFrame, group: list[str], order: list[str], col: str, seed: int) -> DataFrame:
    """col permuted within each group, the same for the same seed: the i-th row by order gets the
    value of the i-th row by a hash of the order and the seed."""
    key = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order], F.lit(str(seed))))
    w = Window.partitionBy(*group)
    a = rows.withColumn("_i", F.row_number().over(w.orderBy(*order))).drop(col)
    b = rows.select(*group, F.row_number().over(w.orderBy(key, *order)).alias("_i"), col)
    return a.join(b, [*group, "_i"]).drop("_i")


def in_step(left: DataFrame, right: DataFrame, key: list[str], schema: str) -> DataFrame:
    """Greedy match of two ordered sequences by equal counts: each left row (i, n) takes the next
    right row (j, m) after the last one taken that has m = n; unmatched ones are left out. A
    group is one agent's run, whose plays are few."""

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("i"), b.sort_values("j")
        out, at, m = [], 0, b["m"].tolist()
        for i, n in zip(a["i"], a["n"], strict=True):
            k = next((x for x in range(at, len(m)) if m[x] == n), None)
            if k is not None:
                out.append((*[a[c].iloc[0] for c in key], i, b["j"].iloc[k]))
                at = k + 1
        return pd.DataFrame(out, columns=[*key, "i", "j"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(match, schema)


def symbol_vector(name: str, dim: int, seed: int = 0) -> np.ndarray:
    """A fixed random unit vector for a symbol."""
    import hashlib

    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "big"))
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Circular convolution."""
    return np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), len(a))


def relation_vectors(triples: str, dim: int = 64) -> Column:
    """A column of array<struct<subject, relation, object>> to the unit vector of the sum of
    subject * (relation * object), * circular convolution; no triples: zeros."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(col: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        sym = lambda s: known.setdefault(s, symbol_vector(s, dim))

        def one(items) -> list[float]:
            v = np.zeros(dim)
            for t in items if items is not None else []:
                v += bound(sym("s:" + t["subject"]), bound(sym("r:" + t["relation"]), sym("o:" + t["object"])))
            n = np.linalg.norm(v)
            return (v / (n if n > 0 else 1.0)).tolist()

        return col.map(one)

    return encode(triples)


def message_tokens(tokens: DataFrame, messages: DataFrame, key: list[str]) -> DataFrame:
    """Tokens that end at or before each message's end: tokens (key, token_end), messages (key, msg,
    char_end). One ordered pass over both, no product."""
    t = tokens.select(*key, F.col("token_end").alias("at"), F.lit(None).cast("long").alias("msg"), F.lit(1).alias("one"), F.lit(0).alias("o"))
    m = messages.select(*key, F.col("char_end").alias("at"), F.col("msg").cast("long").alias("msg"), F.lit(0).alias("one"), F.lit(1).alias("o"))
    w = Window.partitionBy(*key).orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    return t.unionByName(m).withColumn("tokens", F.sum("one").over(w)).where("o = 1").select(*key, "msg", "tokens")


def log_line(level: Column, attempt: Column, step: Column, action: Column, events: Column, gain: Column, outcome: Column) -> Column:
    """[L1 A2 #3] UP -> a; b; Score +1 [WIN]"""
    score = F.when(gain != 0, F.concat(F.lit("; Score "), F.when(gain > 0, "+").otherwise(""), gain.cast("string"))).otherwise("")
    mark = F.when(outcome == "win", " [WIN]").when(outcome == "loss", " [LOSE]").otherwise("")
    return F.concat(F.lit("[L"), level.cast("string"), F.lit(" A"), attempt.cast("string"), F.lit(" #"), step.cast("string"), F.lit("] "), F.upper(action), F.lit(" -> "), F.array_join(events, "; "), score, mark)
