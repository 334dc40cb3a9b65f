import json

import pytest
from pyspark.sql import functions as F

from tarnlake.core.checks import IntegrityError
from tarnlake.sources import released as R


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_optional_columns(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("csf\ttrans_x\tother\nn/a\t1.5\tz\n2\tNaN\tz\n\tnan\tz\n")
    got = R.optional_columns(spark, str(tmp_path / "a.tsv"), ["trans_x", "trans_y", "csf"], 3)
    assert got.columns == ["trans_x", "csf"] and [tuple(r) for r in got.collect()] == [(1.5, 0.0), (0.0, 2.0), (0.0, 0.0)]
    with pytest.raises(IntegrityError, match="not 4 rows"):
        R.optional_columns(spark, str(tmp_path / "a.tsv"), ["csf"], 4)
    with pytest.raises(IntegrityError, match="none of"):
        R.optional_columns(spark, str(tmp_path / "a.tsv"), ["white_matter"])


def test_a_level_is_read_alone(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("level"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("game"))
    rows.write.partitionBy("game", "level").parquet(f"{tmp_path}/f")
    one = R.level_features(spark, f"{tmp_path}/f", "a", 2)
    assert one.count() == 10 and len(one.inputFiles()) > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(game" in plan and "(level" in plan.split("PartitionFilters")[1]
    assert R.discovered(spark, f"{tmp_path}/f").count() == 4


def test_sorted_tables_and_summaries_rerun_to_the_same_bytes(spark, tmp_path):
    df = spark.createDataFrame([(k % 5 if k % 7 else None, f'n"{k % 3},', k / 3) for k in range(60)], "a int, b string, c double")
    for k, parts in enumerate((1, 6)):
        R.write_sorted(df.repartition(parts), str(tmp_path / str(k)), "t", ["a", "b"], 25)
        R.write_summary(df.repartition(parts), str(tmp_path / str(k)), {"z": "1", "release": "r"}, ["a"], ["b", "a"], "a")
    first = files(tmp_path / "0")
    assert first == files(tmp_path / "1") and len(first) == 7
    lines = b"".join(v for k, v in sorted(first.items()) if k.startswith("t-")).decode().replace("a,b,c\n", "").splitlines()
    assert len(lines) == 60 and lines[0].startswith(',"n""0,",') and lines[-1].startswith('4,"n""2,"')
    checks, summary = json.loads(first["checksums.json"]), json.loads(first["summary.json"])
    assert set(checks) == {"summary.json", "coverage.csv"} and summary["objects"] == 60 and list(summary)[:2] == ["release", "z"] and summary["groups"][0]["a"] is None
    R.write_summary(df.limit(0), str(tmp_path / "none"), {}, ["a"], ["b"], "a")
    assert files(tmp_path / "none")["coverage.csv"] == b"b,objects,bytes\n"


def test_names_and_keys_that_must_be_known_once(spark):
    plays = spark.createDataFrame([("v3_avoidit",), ("v3_bait",)], "game string")
    known = spark.createDataFrame([("avoidIt_v3",), ("bait_v3",)], "name string")
    assert {r.canonical for r in R.canonical_games(plays, known, "game").collect()} == {"avoidIt_v3", "bait_v3"}
    with pytest.raises(IntegrityError, match="known games"):
        R.canonical_games(plays, known.limit(1), "game")
    with pytest.raises(IntegrityError, match="once in a"):
        R.side_by_side({"a": plays.union(plays)}, ["game"])
    both = R.together({"x": plays, "y": plays.withColumn("n", F.lit(1))}, "part")
    assert both.where("n is null").count() == 2 and both.count() == 4


def test_times_and_repetitions(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05", [1.0, 1.0, 1.0, 0.0]), ("2024-01-02T03:04:05.000120", [1.0, 1.0, 1.0, 1.5]), ("no time", [1.0])], "t string, z array<double>")
    got = df.select(R.iso(R.from_iso(F.col("t"))).alias("t"), R.repetition_time(F.col("z")).alias("r")).collect()
    assert [(r.t, r.r) for r in got] == [("2024-01-02T03:04:05", 2.0), ("2024-01-02T03:04:05.000120", 1.5), (None, 2.0)]


def test_colours_learned_from_the_first_rise(spark):
    frames = spark.createDataFrame([(1, 0, {}), (1, 1, {"gem": 1}), (1, 2, {"gem": 2, "key": 1}), (1, 3, {"key": 1})], "p int, i int, resources map<string,int>")
    kills = spark.createDataFrame([(1, 1, 0, "o1", "wall"), (1, 1, 1, "o2", "avatar"), (1, 2, 0, "o3", "avatar"), (1, 3, 0, "o4", "avatar")], "p int, i int, place int, killed string, killer string")
    objects = spark.createDataFrame([(1, 0, "o1", "RED"), (1, 0, "o2", "BLUE"), (1, 1, "o3", "GREEN"), (1, 2, "o4", "PINK")], "p int, i int, obj_id string, colour string")
    assert {(r.resource, r.colour) for r in R.learned_colours(frames, kills, objects, ["p"], "i").collect()} == {("gem", "BLUE"), ("key", "GREEN")}
