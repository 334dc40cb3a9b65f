"""Readers and writers of recordings and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPRITE = T.StructType().add("id", "integer").add("key", "string").add("col", "double").add("row", "double").add("alive", "boolean")
FRAME = T.StructType().add("time", "integer").add("realworld_ts", "double").add("source_play_id", "string").add("score", "double").add("ended", "boolean").add("win", "integer").add("keyPressType", "string").add("effectListByClass", T.ArrayType(T.ArrayType(T.StringType()))).add("sprites", T.MapType(T.StringType(), T.ArrayType(SPRITE)))
PLAY = T.StructType().add("_id", "string").add("subj_id", "integer").add("run_id", "integer").add("play_id", "integer").add("game_name", "string").add("level_id", "integer").add("win", "boolean").add("score", "double").add("state_start", "integer").add("state_count", "integer").add("outcome", "string").add("source_document_index", "integer").add("scanner", T.StructType().add("subj_id", "integer").add("run_id", "integer").add("scan_start_ts", "double"))
STEP = T.StructType().add("step", "integer").add("level", "integer").add("attempt", "integer").add("action", "string").add("state_index", "integer").add("reward", "double").add("won", "boolean").add("lose", "boolean").add("response", T.MapType(T.StringType(), T.StringType()))
RECORD = T.StructType().add("schema", "string").add("schema_version", "integer").add("subject", "string").add("game", "string").add("source", "string").add("plays", T.ArrayType(PLAY)).add("states", T.ArrayType(FRAME)).add("steps", T.ArrayType(STEP))


def recordings(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """Nested JSON recordings (gzip by name) with an explicit schema; a malformed file fails. The
    condition prunes folders condition=..., so that a trajectory counts once."""
    df = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("condition", T.StringType())])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.where(F.col("condition") == condition) if condition is not None else df


def play_table(records: DataFrame) -> DataFrame:
    return records.select("subject", "game", F.posexplode("plays").alias("ordinal", "p")).select("subject", "game", "ordinal", "p.*")


def frame_table(records: DataFrame) -> DataFrame:
    return records.select("subject", "game", F.posexplode("states").alias("pos", "f")).select("subject", "game", "pos", "f.*")


def step_table(records: DataFrame) -> DataFrame:
    """Decisions without the synthetic ones, whose action starts with an underscore."""
    steps = records.select("subject", "game", F.posexplode("steps").alias("pos", "s")).select("subject", "game", "pos", "s.*")
    return steps.where(~F.coalesce(F.col("action").startswith("_"), F.lit(False)))


def play_frames(records: DataFrame) -> DataFrame:
    """Frames with the play whose slice [state_start, state_start + state_count) holds them: the
    slice is cut out of the record before anything is exploded, so nothing is shuffled."""
    plays = records.select("subject", "game", "states", F.posexplode("plays").alias("ordinal", "p"))
    cut = plays.select("subject", "game", "ordinal", F.col("p._id").alias("play"), F.col("p.level_id").alias("level"), F.posexplode(F.slice("states", F.col("p.state_start") + 1, F.col("p.state_count"))).alias("i", "f"))
    return cut.select("subject", "game", "ordinal", "play", "level", "i", "f.*")


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", arrays: dict[str, str] | None = None) -> DataFrame:
    """A table with a header; columns in `arrays` hold JSON of the given type."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)
    return df.withColumns({c: F.from_json(c, t) for c, t in (arrays or {}).items()})


def with_path_parts(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of a pattern over the input file's name."""
    return df.withColumns({n: F.regexp_extract(F.input_file_name(), pattern, i + 1) for i, n in enumerate(names)})


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.option("compression", "zstd").partitionBy(*partition_by).mode("errorifexists").parquet(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """CSV with arrays as JSON text."""
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.option("header", True).mode("errorifexists").csv(path)


def write_json(df: DataFrame, path: str, order: list[str], parts: int = 1) -> None:
    """JSON lines in a fixed order: ranges of the order, sorted within."""
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.option("compression", "gzip").mode("errorifexists").json(path)


def not_done(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")
