"""Writers of streams of plays: steps are kept by play and written in chunks of a fixed size, and a play
is published as a whole once its end has arrived.

A batch writes below its own number and overwrites what it finds there, so that a batch that is run
again after a failure leaves what it would have left: nothing is lost and nothing comes twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHUNKS = "play string, chunk int, first long, steps array<array<double>>, ended boolean"


def chunked(frames: DataFrame, size: int) -> DataFrame:
    """play, chunk, first (its first step's place), steps and ended: frames (play, step, vector, ended)
    of a stream in chunks of `size` steps. What doesn't fill a chunk is the play's state, fewer than
    `size` vectors, and leaves with the play's end; a chunk of no steps tells an end that came with
    nothing else. Steps of a play arrive in order of batches; within a batch they are sorted."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, first, kept = state.get if state.exists else (0, 0, "[]")
        waiting = json.loads(kept)
        out, ended = [], False
        for g in [pd.concat(list(batches)).sort_values("step", kind="stable")]:
            waiting += [list(map(float, v)) for v in g["vector"] if v is not None]
            ended = bool(g["ended"].fillna(False).any())
        while len(waiting) >= size:
            out.append((key[0], chunk, first, waiting[:size], False))
            waiting, chunk, first = waiting[size:], chunk + 1, first + size
        if ended:
            out.append((key[0], chunk, first, waiting, True))
            state.remove()
        else:
            state.update((chunk, first, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["play", "chunk", "first", "steps", "ended"])

    return frames.groupBy("play").applyInPandasWithState(update, CHUNKS, "chunk int, first long, kept string", "append", GroupStateTimeout.NoTimeout)


#: Parts of the plays by which chunks are kept, so that publishing reads those alone that hold ended plays.
PARTS = 64


def publisher(path: str) -> Callable[[DataFrame, int], None]:
    """What a batch of chunks does: write them to chunks/batch=N, then the plays that end in it, from
    their chunks of all batches, to plays/batch=N."""

    def publish(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        at = f"{path}/chunks/batch={number}"
        batch.withColumn("part", F.pmod(F.xxhash64("play"), F.lit(PARTS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(at)
        schema = T.StructType([*batch.schema.fields, T.StructField("part", T.IntegerType())])
        ended = spark.read.schema(schema).parquet(at).where("ended").select("play", "part")
        parts = [r.part for r in ended.select("part").distinct().collect()]  # PARTS at most
        kept = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType())])
        all_ = spark.read.schema(kept).option("basePath", f"{path}/chunks").parquet(f"{path}/chunks").where(F.col("part").isin(parts) & (F.col("batch") <= number))
        whole = all_.join(ended.select("play"), "play", "left_semi")
        rows = whole.select("play", F.posexplode("steps").alias("i", "vector"), "first").select("play", (F.col("first") + F.col("i")).alias("step"), "vector")
        rows.write.mode("overwrite").parquet(f"{path}/plays/batch={number}")

    return publish


def write_plays(frames: DataFrame, path: str, checkpoint: str, size: int = 100, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start the stream from frames (play, step, vector, ended) to PATH/plays. after(batch), if given,
    runs when a batch has been written, before the stream takes note of it."""
    publish = publisher(path)

    def each(batch: DataFrame, number: int) -> None:
        publish(batch, number)
        if after is not None:
            after(number)

    return chunked(frames, size).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """play, step and vector of the plays published so far."""
    return spark.read.option("basePath", f"{path}/plays").parquet(f"{path}/plays").select("play", "step", "vector")
