import gzip
import json

import pytest

from tarnlake.sources import io


@pytest.fixture
def folder(tmp_path):
    frame = {"time": 0, "realworld_ts": 1.0, "source_play_id": "p", "score": 0.0, "ended": False, "win": None, "keyPressType": "UP", "effectListByClass": [], "sprites": {"a": [{"id": 1, "key": "k", "col": 1.0, "row": 2.0, "alive": True}]}}
    rec = {
        "schema": "s", "schema_version": 1, "subject": "sub-01", "game": "g", "source": "human",
        "plays": [{"_id": "p0", "level_id": 0, "state_start": 0, "state_count": 2}, {"_id": "p1", "level_id": 1, "state_start": 2, "state_count": 1}],
        "states": [frame | {"time": i} for i in range(3)], "steps": [{"step": 0, "action": "up"}, {"step": 1, "action": "_advance"}, {"step": 2, "action": ""}],
    }
    for c in ("a", "b"):
        (tmp_path / f"condition={c}").mkdir()
        with gzip.open(tmp_path / f"condition={c}/r.json.gz", "wt") as f:
            json.dump(rec, f)
    return str(tmp_path)


def test_recordings(spark, folder):
    rec = io.recordings(spark, folder, "a")
    assert rec.count() == 1
    frames = io.play_frames(rec).orderBy("ordinal", "i").collect()
    assert [(r.play, r.i, r.time) for r in frames] == [("p0", 0, 0), ("p0", 1, 1), ("p1", 0, 2)]
    assert [r.step for r in io.step_table(rec).orderBy("pos").collect()] == [0, 2]
    assert io.play_table(rec).count() == 2 and io.frame_table(rec).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, [1, None]), (1, [])], "k int, a array<int>")
    io.write_delimited(df, f"{tmp_path}/c")
    back = io.delimited(spark, f"{tmp_path}/c", io.T.StructType().add("k", "integer").add("a", "string"), arrays={"a": "array<int>"})
    assert sorted(map(tuple, back.collect())) == [(1, []), (2, [1, None])]
    io.write_json(df, f"{tmp_path}/j", ["k"])
    assert [r.k for r in io.json_rows(spark, f"{tmp_path}/j", df.schema).collect()] == [1, 2]
    io.write_table(df, f"{tmp_path}/t", ("k",))
    left = io.not_done(df, spark.read.parquet(f"{tmp_path}/t").where("k = 1"), ["k"])
    assert [r.k for r in left.collect()] == [2]
