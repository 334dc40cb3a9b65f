"""Compact replays: fields left out, frames as changes of the ones before, and the proof that nothing
else was lost, from an expansion that shares no step with the encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order(sprites: Column) -> Column:
    """The map with its keys in order, so that equal states are equal texts."""
    return F.map_from_entries(F.array_sort(F.map_entries(sprites)))


def without(sprites: Column, names: list[str]) -> Column:
    """A frame's map of sprite lists without some fields of the sprites; a null list is an empty one."""
    return F.transform_values(sprites, lambda k, v: F.transform(F.coalesce(v, F.array()), lambda x: x.dropFields(*names)) if names else F.coalesce(v, F.array()))


def text_of(frame: Column, sprites: Column) -> Column:
    return F.to_json(F.struct(frame.alias("frame"), in_order(sprites).alias("sprites")), {"ignoreNullFields": "false"})


def compacted(frames: DataFrame, rec: list[str], order: str, retained: list[str], omit: list[str], sprites: str = "sprites") -> DataFrame:
    """rec, order, the retained columns and sprites as changes: of every frame but the first only the
    lists that are new or other than before, and null for those that are gone. Columns that aren't
    retained and the omitted fields of sprites go."""
    w = Window.partitionBy(*rec).orderBy(order)
    f = frames.select(*rec, order, *retained, without(F.coalesce(sprites, F.create_map().cast(frames.schema[sprites].dataType)), omit).alias(sprites))
    f = f.withColumn("_before", F.lag(sprites).over(w))
    changed = F.map_filter(sprites, lambda k, v: ~F.element_at(F.col("_before"), k).eqNullSafe(v))
    gone = F.array_except(F.map_keys("_before"), F.map_keys(sprites))
    nothing = F.transform_values(F.map_filter("_before", lambda k, v: F.array_contains(gone, k)), lambda k, v: F.when(F.lit(False), v))
    delta = F.when(F.col("_before").isNull(), F.col(sprites)).otherwise(F.map_concat(changed, nothing))
    return f.select(*rec, order, *retained, delta.alias(sprites))


def expanded(compact: DataFrame, rec: list[str], order: str, retained: list[str], sprites: str = "sprites") -> DataFrame:
    """The frames again: each key of a recording is followed by itself through its changes, which hold
    until its next one, and a frame gathers what holds there."""
    marks = compact.select(*rec, order, F.explode(sprites).alias("_k", "_v"))
    until = F.lead(order).over(Window.partitionBy(*rec, "_k").orderBy(order)).alias("_until")
    spans = marks.select(*rec, order, "_k", "_v", until).where("_v is not null").withColumnRenamed(order, "_from")
    last = compact.groupBy(*rec).agg(F.max(order).alias("_last"))
    spans = spans.join(last, rec).select(*rec, F.explode(F.sequence("_from", F.coalesce(F.col("_until") - 1, F.col("_last")))).alias(order), "_k", "_v")
    held = spans.groupBy(*rec, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(sprites))
    empty = F.create_map().cast(compact.schema[sprites].dataType)
    return compact.select(*rec, order, *retained).join(held, [*rec, order], "left").withColumn(sprites, F.coalesce(sprites, empty))


def evidence(frames: DataFrame, rec: list[str], order: str, retained: list[str], omit: list[str], sprites: str = "sprites") -> DataFrame:
    """By recording: frames, sprites (records over all frames), fractional (those off the grid's whole
    places, by their fields col and row if they have them), and digest, the SHA-256 of the frames'
    own digests in their order."""
    kept = without(F.coalesce(sprites, F.create_map().cast(frames.schema[sprites].dataType)), omit)
    all_ = F.flatten(F.map_values(kept))
    fields = frames.schema[sprites].dataType.valueType.elementType.fieldNames()
    places = [c for c in ("col", "row") if c in fields and c not in omit]
    count = F.lit(0)
    if places:
        far = lambda x: F.coalesce(F.greatest(*[(x[c] % 1 != 0).cast("int") for c in places]) if len(places) > 1 else (x[places[0]] % 1 != 0).cast("int"), F.lit(0))
        count = F.size(F.filter(all_, lambda x: far(x) > 0))
    one = frames.select(*rec, order, F.sha2(text_of(F.struct(F.col(order), *retained), kept), 256).alias("_d"), F.size(all_).alias("_s"), count.alias("_f"))
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(order, "_d")))["_d"], ","), 256)
    return one.groupBy(*rec).agg(F.count("*").alias("frames"), F.sum("_s").alias("sprites"), F.sum("_f").cast("long").alias("fractional"), digest.alias("digest"))


def verified(compact: DataFrame, source: DataFrame, rec: list[str], order: str, retained: list[str], sprites: str = "sprites") -> DataFrame:
    """source (evidence() of the measured frames) with same: whether the compact replay expands to the
    very frames it was made from. Recordings on one side only aren't the same."""
    again = evidence(expanded(compact, rec, order, retained, sprites), rec, order, retained, [], sprites)
    mine = again.select(*rec, F.struct("frames", "sprites", "fractional", "digest").alias("_again"))
    both = source.join(mine, rec, "full")
    return both.withColumn("same", F.struct("frames", "sprites", "fractional", "digest").eqNullSafe(F.col("_again"))).drop("_again")


def stored_bytes(rows: DataFrame, rec: list[str], name: str) -> DataFrame:
    """Bytes of the rows of each recording as JSON lines, nulls of maps written out."""
    cols = [c for c in rows.columns if c not in rec]
    return rows.groupBy(*rec).agg(F.sum(F.octet_length(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})) + 1).alias(name))
