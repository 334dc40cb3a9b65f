"""Files of given names and equal bytes: documents written aside and renamed when complete, tables as
lines of JSON in blocks whose bytes don't hang on partitions, and proof that sources stood still."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core import checks
from tarnlake.core.shared import materialize, release
from tarnlake.operators.windows import numbered
from tarnlake.sources.archives import located

WRITTEN = "path string, sha256 string, size long, text_sha256 string"


def write_documents(rows: DataFrame, root: str) -> DataFrame:
    """Write each row's text to ROOT/path, as gzip without a time where path ends in .gz, and return path,
    sha256 and size of the file and text_sha256. A file takes its name when it is complete, and a task
    that is run again leaves the same. Paths that repeat or leave ROOT raise before anything is written.
    The rows are computed once, however many checks there are."""
    own = materialize(rows.select(F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text")))
    checks.require_empty(checks.unsafe_paths(own.select("path"), "path"), "a path below the root")
    checks.require_empty(checks.duplicate_keys(own.select("path"), ["path"]), "a path once")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(root)
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                plain = text.encode()
                body = gzip.compress(plain, mtime=0) if path.endswith(".gz") else plain
                place = f"{top}/{path}"
                folder = place.rsplit("/", 1)[0]
                aside = f"{folder}/.{uuid.uuid4().hex}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(aside, compression=None) as f:
                    f.write(body)
                store.move(aside, place)
                out.append((path, hashlib.sha256(body).hexdigest(), len(body), hashlib.sha256(plain).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "sha256", "size", "text_sha256"])

    done = materialize(own.mapInArrow(write, WRITTEN))
    release(own)
    return done


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_keys(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda k, v: sorted_keys(v, kind.valueType)))))
    return value


def json_line(df: DataFrame) -> Column:
    """A row as JSON with sorted keys; nulls are written."""
    names = sorted(df.columns)
    return F.to_json(F.struct(*[sorted_keys(F.col(n), df.schema[n].dataType).alias(n) for n in names]), {"ignoreNullFields": "false"})


def publish(df: DataFrame, root: str, name: str, order: list[str], block: int = 10_000) -> DataFrame:
    """df as NAME-000000.jsonl.gz and so on, `block` rows each in the given order, then NAME.json, which
    names them with rows, sizes and digests and makes them count: readers go by it. The same rows give
    the same bytes however they are dealt; rows that tie in the order are put by their text."""
    lines = df.select(*order, json_line(df).alias("_line"))
    at = numbered(lines, [*order, "_line"], "_n")
    blocks = at.groupBy(F.floor(F.col("_n") / block).alias("_b")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", "_line")))["_line"], "\n").alias("_t"), F.count("*").alias("rows"))
    blocks = materialize(blocks.select(F.format_string(f"{name}-%06d.jsonl.gz", "_b").alias("path"), F.concat("_t", F.lit("\n")).alias("text"), "rows"))
    done = write_documents(blocks, root).join(blocks.select("path", "rows"), "path")
    entry = F.array_sort(F.collect_list(F.struct("path", "rows", "size", "sha256")))
    index = done.agg(F.to_json(F.struct(entry.alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))).alias("text"))  # a line per block
    write_documents(index.select(F.lit(f"{name}.json").alias("path"), "text"), root)
    return done


def published(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """The rows that publish() wrote, from the files that the index names and no others."""
    index = spark.read.schema("files array<struct<path string, rows long, size long, sha256 string>>, rows long").json(f"{root}/{name}.json")
    paths = [f"{root}/{r.path}" for r in index.select(F.explode("files.path").alias("path")).collect()]  # a name per block
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths) if paths else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, size and time of change of every file below path, as they are now. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return materialize(files.select("path", F.col("length").alias("size"), "modificationTime"))


def require_unchanged(before: DataFrame, spark: SparkSession, path: str) -> None:
    """Raise if a file below path came, went or changed since the snapshot."""
    now = snapshot(spark, path)
    cols = ["path", "size", "modificationTime"]
    checks.require_empty(before.join(now, cols, "left_anti").select("path").unionByName(now.join(before, cols, "left_anti").select("path")).distinct(), "sources that changed while they were read")
