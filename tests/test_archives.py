import hashlib
import json
import zipfile

import numpy as np
import pytest

from tarnlake.core.checks import IntegrityError
from tarnlake.sources import archives as A


def rows_of(spark, arrays):
    rows = []
    for (archive, member), x in arrays.items():
        for i, v in enumerate(x):
            text = isinstance(v, str)
            rows.append((archive, member, i, None if text else np.atleast_1d(v).astype(float).tolist(), v if text else None))
    return spark.createDataFrame(rows, "archive string, member string, row long, numbers array<double>, text string").repartition(5)


ARRAYS = {
    ("sub-01/a.npz", "layer_1"): np.arange(12.0).reshape(6, 2), ("sub-01/a.npz", "layer_2"): np.arange(24.0).reshape(6, 4) / 7, ("sub-01/a.npz", "ids"): ["p1", "p2", "p3é", "", "p5", "p6"],
    ("b.npz", "layer_1"): np.ones((3, 2)), ("b.npz", "scores"): np.array([1.5, -2, np.nan]),
}


def bytes_below(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.fixture
def written(spark, tmp_path):
    found = A.write_archives(rows_of(spark, ARRAYS), f"file://{tmp_path}/out")
    return tmp_path / "out", found


def test_round_trip_and_numpy_reads_it(spark, written):
    folder, found = written
    assert {(r.archive, r.member) for r in found.collect()} == set(ARRAYS)
    for (archive, member), x in ARRAYS.items():
        with np.load(folder / archive, allow_pickle=False) as z:
            assert np.array_equal(z[member], np.asarray(x), equal_nan=not isinstance(x, list))
    got = {}
    for r in A.read_archives(spark, str(folder)).collect():
        got.setdefault((r.archive, r.member), {})[r.row] = r.text if r.text is not None else r.numbers
    assert got.keys() == ARRAYS.keys()
    for k, x in ARRAYS.items():
        want = list(x) if isinstance(x, list) else np.asarray(x).reshape(len(x), -1).tolist()
        assert np.array_equal([got[k][i] for i in range(len(x))], want, equal_nan=not isinstance(x, list))


def test_same_rows_give_the_same_bytes(spark, written, tmp_path):
    folder, _ = written
    A.write_archives(rows_of(spark, ARRAYS).repartition(2), str(tmp_path / "again"))
    assert bytes_below(folder) == bytes_below(tmp_path / "again")
    assert not [p for p in bytes_below(folder) if p.rsplit("/", 1)[-1].startswith(".") and not p.endswith(".crc")]


def damaged(folder, archive, member):
    """Turn bytes of a member's stored data, in place."""
    path = folder / archive
    with zipfile.ZipFile(path) as z:
        info = z.getinfo(member + ".npy")
    raw = bytearray(path.read_bytes())
    at = info.header_offset + 30 + len(info.filename) + 40
    raw[at : at + 8] = bytes(255 - b for b in raw[at : at + 8])
    path.write_bytes(raw)


def test_only_the_layers_asked_for_are_opened(spark, written):
    folder, _ = written
    damaged(folder, "sub-01/a.npz", "layer_2")
    one = A.read_archives(spark, str(folder), ["layer_1"])
    assert one.rdd.getNumPartitions() == 2 and one.count() == 9
    assert A.read_archives(spark, str(folder), ["ids", "scores"]).count() == 9
    with pytest.raises(Exception, match="layer_2|invalid|CRC|decompress|Digest"):
        A.read_archives(spark, str(folder), ["layer_2"]).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = A.read_archives(spark, str(folder)).where("member = 'layer_1' and archive in ('b.npz', 'c.npz')")
        assert pushed.rdd.getNumPartitions() == 1 and pushed.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_other_bytes_of_the_same_shape_raise(spark, written):
    folder, _ = written
    with np.load(folder / "b.npz") as z:
        arrays = dict(z)
    arrays["layer_1"] = arrays["layer_1"] * 2
    np.savez_compressed(folder / "b.npz", **arrays)
    with pytest.raises(Exception, match="another digest"):
        A.read_archives(spark, str(folder), ["layer_1"]).count()
    assert A.read_archives(spark, str(folder), ["scores"]).count() == 3  # those are as they were
    assert A.read_archives(spark, str(folder / "b.npz"), ["layer_1"], verify=False).count() == 3
    np.savez_compressed(folder / "b.npz", **arrays, extra=np.ones(3))
    with pytest.raises(Exception, match="names other members"):
        A.read_archives(spark, str(folder), ["scores"]).count()
    (folder / ("b.npz" + A.DOCUMENT)).unlink()
    with pytest.raises(Exception, match="no document"):
        A.read_archives(spark, str(folder), ["scores"]).count()


def test_document_has_the_digests_of_the_members(written):
    folder, _ = written
    known = json.loads((folder / ("b.npz" + A.DOCUMENT)).read_text())["members"]
    with zipfile.ZipFile(folder / "b.npz") as z:
        assert known == {n.removesuffix(".npy"): hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist()}


@pytest.mark.parametrize("change", ["gap", "twice", "width", "mixed", "name"])
def test_rows_that_are_no_arrays_are_refused(spark, tmp_path, change):
    rows = [("a.npz", "m", 0, [1.0], None), ("a.npz", "m", 1, [2.0], None)]
    rows.append({"gap": ("a.npz", "m", 3, [1.0], None), "twice": ("a.npz", "m", 1, [1.0], None), "width": ("a.npz", "m", 2, [1.0, 2.0], None), "mixed": ("a.npz", "m", 2, None, "x"), "name": ("../a.npz", "m", 0, [1.0], None)}[change])
    df = spark.createDataFrame(rows, "archive string, member string, row long, numbers array<double>, text string")
    with pytest.raises(IntegrityError):
        A.write_archives(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
