"""Released records and features: what a record must be, tables with optional columns, features by game
and level, sorted tables and summaries of a release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core import checks
from tarnlake.core.shared import materialize
from tarnlake.operators.windows import numbered
from tarnlake.sources.documents import write_documents

def record_errors(records: DataFrame, name: str, schema: str, version: int = 1, source: str = "human") -> DataFrame:
    """(name, error) of records that aren't whole ones of the schema, version and source; must be empty. records: name,
    schema, schema_version, source, plays (array), game_description, original_game_description."""
    error = (
        F.when(~(F.col("schema").eqNullSafe(F.lit(schema)) & F.col("schema_version").eqNullSafe(F.lit(version))), "another schema").when(~F.col("source").eqNullSafe(F.lit(source)), "another source")
        .when(F.coalesce(F.size("plays"), F.lit(0)) <= 0, "no plays").when(F.coalesce(F.col("game_description"), F.lit("")) == "", "no description").when(F.col("original_game_description").isNotNull(), "two descriptions")
    )
    return records.select(name, error.alias("error")).where("error is not null")


def optional_columns(spark: SparkSession, path: str, wanted: list[str], rows: int | None = None, sep: str = "\t") -> DataFrame:
    """The wanted columns that the table has, in the wanted order, as numbers; empty cells, n/a and NaN are
    0. None of them, or another number of rows than `rows`, raises."""
    raw = spark.read.option("header", True).option("sep", sep).option("nullValue", "n/a").csv(path)
    have = [c for c in wanted if c in raw.columns]
    if not have:
        raise checks.IntegrityError(f"none of the columns {wanted}")
    if rows is not None and raw.count() != rows:
        raise checks.IntegrityError(f"not {rows} rows")
    value = lambda c: F.coalesce(F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)), F.lit(0.0))
    return raw.select(*[value(c).alias(c) for c in have])


def level_features(spark: SparkSession, path: str, game: str, level: int) -> DataFrame:
    """Features of one level, from a table in folders game=.../level=...: no other folder is read."""
    return spark.read.parquet(path).where((F.col("game") == game) & (F.col("level") == level))


def discovered(spark: SparkSession, path: str) -> DataFrame:
    """The games and levels there are, by the names of folders; no features are read."""
    return spark.read.parquet(path).select("game", "level").distinct()


def repetition_time(zooms: Column, otherwise: float = 2.0) -> Column:
    """The fourth of a header's sizes if it is above 0, else `otherwise`."""
    t = F.get(zooms, F.lit(3)).cast("double")
    return F.when(t > 0, t).otherwise(F.lit(otherwise))


def lines_of(df: DataFrame) -> Column:
    """A row as a line of CSV: nulls are empty, texts with a comma, a quote or a line's end are quoted."""
    def cell(f: T.StructField) -> Column:
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[cell(f) for f in df.schema.fields])


def write_sorted(df: DataFrame, root: str, name: str, keys: list[str], block: int = 100_000) -> DataFrame:
    """df in the order of keys (nulls first, ties by the whole line) as NAME-000000.csv and so on, each
    with the header, and NAME.provenance.json with their rows and digests. The same rows give the same
    bytes. Returns path, rows, sha256 and text_sha256."""
    head = ",".join(df.columns)
    at = numbered(df.select(*keys, lines_of(df).alias("_line")), [*keys, "_line"], "_n")
    blocks = at.groupBy(F.floor(F.col("_n") / block).alias("_b")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "_line")))["_line"], "\n").alias("_t"), F.count("*").alias("rows"))
    blocks = materialize(blocks.select(F.format_string(f"{name}-%06d.csv", "_b").alias("path"), F.concat(F.lit(head + "\n"), F.col("_t"), F.lit("\n")).alias("text"), "rows"))
    done = write_documents(blocks, root).join(blocks.select("path", "rows"), "path")
    entry = F.array_sort(F.collect_list(F.struct("path", "rows", "sha256")))
    text = F.to_json(F.struct(F.lit(keys).alias("sorted_by"), entry.alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")))
    write_documents(done.agg(text.alias("text")).select(F.lit(f"{name}.provenance.json").alias("path"), "text"), root)
    return done.select("path", "rows", "sha256", "text_sha256")


def write_summary(rows: DataFrame, root: str, head: dict[str, str], groups: list[str], coverage: list[str], size: str) -> DataFrame:
    """summary.json (head, totals, and objects and bytes of each group), coverage.csv (the same by the
    coverage's columns) and checksums.json of both, all in the order of their keys. Returns path, sha256,
    size and text_sha256 of the first two."""
    counts = [F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")]
    g = rows.groupBy(*groups).agg(*counts)
    text = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(head.items())], F.coalesce(F.sum("objects"), F.lit(0)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.array_sort(F.collect_list(F.struct(*groups, "objects", "bytes"))).alias("groups")), {"ignoreNullFields": "false"})
    summary = g.agg(text.alias("text")).select(F.lit("summary.json").alias("path"), "text")  # a row per group
    c = rows.groupBy(*coverage).agg(*counts)
    line = c.select(F.struct(*coverage).alias("k"), lines_of(c).alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "line")))["line"], "\n").alias("t"), F.count("*").alias("n"))
    body = F.concat(F.lit(",".join([*coverage, "objects", "bytes"]) + "\n"), F.when(F.col("n") > 0, F.concat("t", F.lit("\n"))).otherwise(""))
    done = write_documents(summary.unionByName(line.select(F.lit("coverage.csv").alias("path"), body.alias("text"))), root)
    sums = done.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256"))))).alias("text"))
    write_documents(sums.select(F.lit("checksums.json").alias("path"), "text"), root)
    return done


def stale(previous: DataFrame, rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Paths of the manifest before that the new one lacks and whose files are still there; must be empty."""
    return previous.select(path).distinct().join(rows, path, "left_anti").join(files.select(path), path, "left_semi")


def unverified(rows: DataFrame, files: DataFrame, path: str, replaced: DataFrame) -> DataFrame:
    """(path, error) of files that are there and stay: without a digest to hold them to, of another size or
    of another digest; must be empty. rows: path, size, sha256; files: path, size, sha256 as found."""
    f = files.select(path, F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = rows.join(replaced.select(path).distinct(), path, "left_anti").join(f, path)
    error = F.when(F.coalesce("sha256", F.lit("")) == "", "no digest").when(~F.col("size").eqNullSafe(F.col("_size")), "another size").when(F.col("sha256") != F.col("_sha"), "another digest")
    return both.select(path, error.alias("error")).where("error is not null")


def batch_status(sessions: DataFrame, by: list[str]) -> DataFrame:
    """completed, skipped and failed sessions, and the failed ones' names in order. sessions: by, session,
    status."""
    n = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "skipped", "failed")]
    return sessions.groupBy(*by).agg(*n, F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("session")))).alias("failed_sessions"))


def together(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Tables of the same columns as one, with the name of each in a column; others' columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def side_by_side(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Tables next to each other by key, as far as any of them has it; other columns are named PART_column.
    A key twice in a table raises."""
    out = None
    for k, df in parts.items():
        checks.require_empty(checks.duplicate_keys(df, key), f"a key once in {k}")
        one = df.select(*key, *[F.col(c).alias(f"{k}_{c}") for c in df.columns if c not in key])
        out = one if out is None else out.join(one, key, "full")
    return out


def iso(time: Column) -> Column:
    """A time in ISO form, with microseconds if it has any."""
    return F.when(F.unix_micros(time) % 1_000_000 == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def from_iso(text: Column) -> Column:
    """The time of an ISO text; null if it is none."""
    return F.try_to_timestamp(text)


def canonical_games(plays: DataFrame, known: DataFrame, game: str) -> DataFrame:
    """plays with canonical: the known name (name) of GAME_VERSION for their VERSION_game, whatever the
    case. A name of another form, or that isn't known, raises."""
    swapped = F.lower(F.concat_ws("_", F.regexp_extract(game, "^([^_]*)_(.*)$", 2), F.regexp_extract(game, "^([^_]*)_(.*)$", 1)))
    k = known.select(F.lower("name").alias("_low"), F.col("name").alias("canonical")).dropDuplicates(["_low"])
    both = plays.withColumn("_low", swapped).join(k, "_low", "left").drop("_low")
    checks.require_empty(both.where("canonical is null").select(game).distinct(), "names of known games")
    return both


def learned_colours(frames: DataFrame, kills: DataFrame, objects: DataFrame, play: list[str], order: str) -> DataFrame:
    """play, resource, colour: the colour of what the avatar killed when a resource of its rose for the
    first time with such an event. frames: play, order, resources (map) of the avatar; kills: play, order,
    place, killed, killer; objects: play, order, obj_id, colour, as seen in a frame."""
    w = Window.partitionBy(*play).orderBy(order)
    f = frames.withColumn("_before", F.coalesce(F.lag("resources").over(w), F.create_map().cast(frames.schema["resources"].dataType))).withColumn("_at", F.lag(order).over(w))
    rose = f.select(*play, order, "_at", F.explode("resources").alias("resource", "_n"), "_before").where(F.col("_n") > F.coalesce(F.element_at("_before", F.col("resource")), F.lit(0)))
    seen = objects.select(*play, F.col(order).alias("_at"), F.col("obj_id").alias("killed"), "colour").where("colour is not null")
    met = rose.join(kills.where("killer = 'avatar'"), [*play, order]).join(seen, [*play, "_at", "killed"])
    return met.groupBy(*play, "resource").agg(F.min_by("colour", F.struct(order, "place")).alias("colour"))
