import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnlake.core.checks import IntegrityError
from tarnlake.sources import documents as D


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_documents_are_whole_and_named(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.json", '{"x": 1}'), ("c.txt.gz", "täxt\n"), ("empty", None)], "path string, text string").repartition(3)
    got = {r.path: r for r in D.write_documents(rows, f"file://{tmp_path}/o").collect()}
    have = files(tmp_path / "o")
    assert have["a/b.json"] == b'{"x": 1}' and gzip.decompress(have["c.txt.gz"]) == "täxt\n".encode() and have["empty"] == b"" and len(have) == 3
    assert all(got[p].sha256 == hashlib.sha256(b).hexdigest() and got[p].size == len(b) for p, b in have.items())
    for bad in ([("a", "1"), ("a", "2")], [("../a", "1")], [("/a", "1")], [(None, "1")]):
        with pytest.raises(IntegrityError):
            D.write_documents(spark.createDataFrame(bad, "path string, text string"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def table(spark, n):
    df = spark.range(n).select(F.col("id").alias("b"), (F.col("id") % 7).alias("a"), F.struct(F.lit(None).cast("int").alias("z"), F.lit("é").alias("y")).alias("s"), F.create_map(F.lit("q"), F.col("id"), F.lit("p"), F.lit(1).cast("long")).alias("m"))
    return df.unionByName(df.where("b < 3"))


def test_rerun_gives_the_same_bytes(spark, tmp_path):
    for k, parts in enumerate((1, 7)):
        D.publish(table(spark, 250).repartition(parts, "a"), f"file://{tmp_path}/{k}", "rows", ["a"], 100)
    first, second = files(tmp_path / "0"), files(tmp_path / "1")
    assert first == second and sorted(first) == ["rows-000000.jsonl.gz", "rows-000001.jsonl.gz", "rows-000002.jsonl.gz", "rows.json"]
    line = gzip.decompress(first["rows-000000.jsonl.gz"]).decode().split("\n")[0]
    assert line == '{"a":0,"b":0,"m":{"p":1,"q":0},"s":{"y":"é","z":null}}'
    index = json.loads(first["rows.json"])
    assert index["rows"] == 253 and [f["rows"] for f in index["files"]] == [100, 100, 53]
    (tmp_path / "0" / "rows-000009.jsonl.gz").write_bytes(gzip.compress(b'{"a":1}\n'))  # not in the index
    got = D.published(spark, f"file://{tmp_path}/0", "rows", "a long, b long")
    assert got.count() == 253 and [r.a for r in got.select("a").distinct().orderBy("a").collect()] == list(range(7))


def test_an_empty_table_has_an_index(spark, tmp_path):
    D.publish(table(spark, 0), str(tmp_path), "rows", ["a"])
    assert json.loads((tmp_path / "rows.json").read_text())["rows"] == 0
    assert D.published(spark, str(tmp_path), "rows", "a long, b long").count() == 0


@pytest.mark.parametrize("change", ["touched", "new", "gone"])
def test_a_source_that_changes_is_noticed(spark, tmp_path, change):
    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    before = D.snapshot(spark, str(tmp_path))
    D.require_unchanged(before, spark, str(tmp_path))
    if change == "touched":
        (tmp_path / "a").write_text("aa")
    elif change == "new":
        (tmp_path / "c").write_text("c")
    else:
        (tmp_path / "b").unlink()
    with pytest.raises(IntegrityError, match="changed while"):
        D.require_unchanged(before, spark, str(tmp_path))


def test_rows_are_computed_once_for_all_checks(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"a/{i}.txt", "x") for i in range(20)], "path string, text string").mapInArrow(see, "path string, text string")
    assert D.write_documents(rows, str(tmp_path)).count() == 20 and met.value == 20
