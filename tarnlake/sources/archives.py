"""Archives of named arrays (.npz) as tables: a member is a partition, a row of it a row.

Only the directory of an archive is read to plan a scan, so that members that aren't asked for are
never opened. A document beside the archive has the SHA-256 of every member; a member is digested
as it is read and must agree. Archives are written aside, with fixed times and in a fixed order, and
take their name when they are complete: the same rows give the same bytes.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tarnlake.core import checks

SCHEMA = "archive string, member string, row long, numbers array<double>, text string"
DOCUMENT = ".digests.json"
#: Elements decoded at a time.
CHUNK = 1 << 20


class DigestError(ValueError):
    """What an archive holds isn't what its document says."""


def located(path: str):
    """(file system, path there) of a path or URI of any store that Arrow reads."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def archives_in(path: str) -> list[tuple[str, int]]:
    """Paths (below the store's root) and sizes of the archives of a folder, or the one archive."""
    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))


class Member(InputPartition):
    def __init__(self, root: str, archive: str, member: str, digest: str | None):
        self.root, self.archive, self.member, self.digest = root, archive, member, digest


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, members: list[str] | None, verify: bool):
        self.path, self.members, self.verify = path, members, verify
        self.archives: list[str] | None = None

    def partitions(self) -> list[InputPartition]:
        store, root = located(self.path)
        out: list[InputPartition] = []
        for at, _ in archives_in(self.path):
            name = at[len(root) :].lstrip("/") or at.rsplit("/", 1)[-1]
            if self.archives is not None and name not in self.archives:
                continue
            with store.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                names = [n.removesuffix(".npy") for n in z.namelist()]
            known = self.document(store, at) if self.verify else {}
            if self.verify and set(known) != set(names):
                raise DigestError(f"{at}: its document names other members")
            out += [Member(at, name, m, known.get(m)) for m in sorted(names) if self.members is None or m in self.members]
        return out

    def document(self, store, at: str) -> dict[str, str]:
        try:
            with store.open_input_stream(at + DOCUMENT) as f:
                return json.loads(f.read())["members"]
        except FileNotFoundError:
            raise DigestError(f"{at}: no document beside it") from None

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(partition.root) as raw, zipfile.ZipFile(raw) as z, z.open(partition.member + ".npy") as f:
            yield from decoded(f, partition)


class PushingReader(ArchiveReader):
    """The reader where the session lets Python sources have filters."""

    def pushFilters(self, filters):
        """Equality and IN on member or archive choose what is opened; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("member",), ("archive",)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                name = f.attribute[0] + "s"
                old = getattr(self, name)
                setattr(self, name, wanted if old is None else [x for x in old if x in wanted])
            yield f


def decoded(f, part: Member) -> Iterator[pa.RecordBatch]:
    """Batches of a member's rows; a member that doesn't agree with its digest raises at its end."""
    seen = hashlib.sha256()

    class Seen(io.RawIOBase):
        def read(self, n: int = -1) -> bytes:
            got = f.read(n)
            seen.update(got)
            return got

    s = Seen()
    version = np.lib.format.read_magic(s)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(s)
    if kind.hasobject or (fortran and len(shape) > 1):
        raise ValueError(f"{part.archive}, {part.member}: arrays of objects or in column order aren't read")
    rows, width = (shape[0], int(np.prod(shape[1:]))) if shape else (1, 1)
    step = max(1, CHUNK // max(1, width))
    for lo in range(0, rows, step):
        n = min(step, rows - lo)
        want = n * width * kind.itemsize
        body = b""
        while len(body) < want:
            more = s.read(want - len(body))
            if not more:
                raise DigestError(f"{part.archive}, {part.member}: cut short")
            body += more
        x = np.frombuffer(body, kind).reshape(n, width)
        numbers = texts = None
        if kind.kind in "US":
            texts = pa.array([str(v) if kind.kind == "U" else v.decode() for v in x[:, 0]], pa.string())
        else:
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(x.ravel().astype(np.float64)))
        cols = [pa.array([part.archive] * n), pa.array([part.member] * n), pa.array(np.arange(lo, lo + n)), pa.nulls(n, pa.list_(pa.float64())) if numbers is None else numbers, pa.nulls(n, pa.string()) if texts is None else texts]
        yield pa.RecordBatch.from_arrays(cols, ["archive", "member", "row", "numbers", "text"])
    while s.read(CHUNK):
        pass
    if part.digest is not None and seen.hexdigest() != part.digest:
        raise DigestError(f"{part.archive}, {part.member}: its bytes have another digest")


class ArrayArchives(DataSource):
    """Options: path (an archive or a folder of them), members (a JSON list, all if left out), verify
    (true unless false: every member needs its digest)."""

    @classmethod
    def name(cls) -> str:
        return "array_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        members = self.options.get("members")
        kind = PushingReader if self.options.get("pushdown") == "true" else ArchiveReader
        return kind(self.options["path"], None if members is None else json.loads(members), self.options.get("verify", "true").lower() != "false")


def read_archives(spark: SparkSession, path: str, members: list[str] | None = None, verify: bool = True) -> DataFrame:
    """archive, member, row and numbers (the row's elements) or text of the named members."""
    spark.dataSource.register(ArrayArchives)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("array_archive").option("verify", str(verify).lower()).option("pushdown", push.lower())
    return (reader if members is None else reader.option("members", json.dumps(members))).load(path)


def _stream(root: str) -> Callable:
    """Rows (archive, member, row, numbers, text, n, width, length), in order, to archives below root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(root)
        store.create_dir(top, recursive=True)
        now: dict = {}

        def finish() -> pa.RecordBatch:
            close_member()
            now["zip"].close()
            now["raw"].close()
            place = f"{top}/{now['archive']}"
            store.create_dir(place.rsplit("/", 1)[0], recursive=True)
            store.move(now["aside"], place)
            with store.open_output_stream(f"{now['aside']}.json") as f:
                f.write(json.dumps({"members": now["members"]}, sort_keys=True, indent=1).encode())
            store.move(f"{now['aside']}.json", place + DOCUMENT)
            k = len(now["members"])
            return pa.RecordBatch.from_arrays([pa.array([now["archive"]] * k), pa.array(list(now["members"])), pa.array(list(now["members"].values()))], ["archive", "member", "sha256"])

        def close_member() -> None:
            if "file" in now:
                now.pop("file").close()
                now["members"][now["member"]] = now["digest"].hexdigest()

        def put(body: bytes) -> None:
            now["digest"].update(body)
            now["file"].write(body)

        def open_member(member: str, kind: np.dtype, n: int, width: int) -> None:
            info = zipfile.ZipInfo(member + ".npy", (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            now.update(member=member, kind=kind, digest=hashlib.sha256(), file=now["zip"].open(info, "w", force_zip64=True))
            head = io.BytesIO()
            shape = (n,) if kind.kind == "U" or width == 1 else (n, width)
            np.lib.format.write_array_header_1_0(head, {"descr": kind.str, "fortran_order": False, "shape": shape})
            put(head.getvalue())

        for b in batches:
            for r in b.to_pylist():
                if r["archive"] != now.get("archive"):
                    if now:
                        yield finish()
                    now.clear()
                    aside = f"{top}/.{uuid.uuid4().hex}"
                    raw = store.open_output_stream(aside)
                    now.update(archive=r["archive"], aside=aside, raw=raw, zip=zipfile.ZipFile(raw, "w"), members={})
                if r["member"] != now.get("member"):
                    close_member()
                    open_member(r["member"], np.dtype("<f8") if r["text"] is None else np.dtype(f"<U{max(1, r['length'])}"), r["n"], r["width"])
                put(np.asarray(r["numbers"] if r["text"] is None else [r["text"]], now["kind"]).tobytes())
        if now:
            yield finish()

    return run


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Write rows (archive, member, row, numbers or text) as archives with their documents, and return
    archive, member and sha256. Rows of a member run from 0 without gaps and are equally wide, all
    of numbers or all of text, else nothing is written; each archive is streamed by one task."""
    own = rows.select("archive", "member", "row", "numbers", "text")
    wide = F.when(F.col("text").isNull(), F.size("numbers"))
    each = own.groupBy("archive", "member").agg(
        F.count("*").alias("n"), F.max(wide).alias("width"), F.min(wide).alias("_w"), F.max("row").alias("_last"), F.countDistinct("row").alias("_rows"), F.min("row").alias("_first"),
        F.count_if(F.col("text").isNotNull() & F.col("numbers").isNotNull()).alias("_both"), F.count("text").alias("_texts"), F.count_if(F.col("text").isNull() & F.col("numbers").isNull()).alias("_none"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("length"),
    )
    bad = each.where("_first <> 0 or _last <> n - 1 or _rows <> n or _w <> width or _both > 0 or _none > 0 or (_texts > 0 and _texts < n) or archive is null or member is null or archive not like '%.npz' or archive like '%..%'")
    checks.require_empty(bad.select("archive", "member"), "members that are no arrays")
    full = own.join(each.select("archive", "member", "n", F.coalesce("width", F.lit(1)).alias("width"), "length"), ["archive", "member"])
    full = full.repartition("archive").sortWithinPartitions("archive", "member", "row")
    done = full.mapInArrow(_stream(path), "archive string, member string, sha256 string").collect()  # a row per member
    return rows.sparkSession.createDataFrame(done, "archive string, member string, sha256 string")
