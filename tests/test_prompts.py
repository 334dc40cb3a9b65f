import pytest
from pyspark.sql import functions as F

from tarnlake.core.checks import IntegrityError
from tarnlake.operators import prompts as P
from tarnlake.operators import traces as T


def test_two_traces_of_a_play_raise(spark):
    a, b = "a" * 24, "B" * 24
    files = spark.createDataFrame([(f"x/play-{a}/traces.bin",), (f"x/play3_key{b}/traces.bin",), ("x/play-short/traces.bin",)], "path string")
    assert {r.play for r in T.trace_plays(files, "path").collect()} == {a, b.lower()}
    with pytest.raises(IntegrityError):
        T.trace_plays(files.union(spark.createDataFrame([(f"y/play9_key{a}/traces.bin",)], "path string")), "path")


def test_steps_without_a_representation_and_odd_calls(spark):
    rows = [("p", "dyn", 0, 1, None, [2.0, 4.0]), ("p", "dyn", 1, 1, None, [4.0, 0.0]), ("p", "dyn", 2, None, None, [1.0, 1.0]), ("p", "dyn", 3, 9, None, [9.0, 9.0]), ("p", "val", 0, None, "initial", [5.0]), ("p", "val", 1, None, "step", [6.0]), ("q", "other", 0, 0, None, [1.0])]
    e = spark.createDataFrame(rows, "play string, layer string, pos int, timestep int, phase string, vector array<double>")
    kinds = spark.createDataFrame([("dyn", "dynamics"), ("val", "value"), ("rep", "representation")], "layer string, kind string")
    got = sorted((r.play, r.layer, r.step, r.vector) for r in T.trace_steps(e, kinds).collect())
    assert got == [("p", "dyn", 0, [1.0, 1.0]), ("p", "dyn", 1, [3.0, 2.0]), ("p", "dyn", 2, [0.0, 0.0]), ("p", "dyn", 3, [0.0, 0.0]), ("p", "val", 0, [5.0])]
    assert T.up_to_step(T.trace_steps(e, kinds), "step", 1).count() == 2 and T.up_to_step(e, "pos", None).count() == 7


@pytest.mark.parametrize("value", [0.3, None, float("nan"), float("inf")])
def test_places_between_pixels_fail(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    with pytest.raises(Exception, match="no whole pixel"):
        df.select(P.pixel(F.col("x"), F.lit(8))).collect()


def test_pixels_are_whole_within_the_rounding(spark):
    df = spark.createDataFrame([(0.125,), (1 / 3 * 3,), (-2.5,), (0.375 + 5e-9,)], "x double")
    assert [r[0] for r in df.select(P.pixel(F.col("x"), F.lit(8))).collect()] == [1, 8, -20, 3]


def test_what_is_missing_or_unknown_raises(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 5, 0)], "k int, size int, i int")
    with pytest.raises(IntegrityError):
        P.block_size(df, ["k"], "size", ["i"])
    with pytest.raises(Exception, match="unknown condition"):
        df.select(P.recording_path(F.col("k"), F.lit("g"), F.lit("other"))).collect()
    with pytest.raises(ValueError):
        P.message_rows(df, df, ["k"], "i", "whatever")
    index = spark.createDataFrame([("a",), ("b",)], "p string")
    with pytest.raises(IntegrityError, match="manifest"):
        P.catalogue_rows(index, spark.createDataFrame([("a",)], "p string"), "p")
    with pytest.raises(IntegrityError, match="once"):
        P.catalogue_rows(index.limit(1), spark.createDataFrame([("a",), ("a",)], "p string"), "p")


def test_responses_whole_or_alone_and_another_system(spark):
    steps = spark.createDataFrame([(1, 0, "UP", 0, 0, "see", None, {"action": "up", "rationale": "é"}), (1, 1, "_x", 0, 0, "see", None, None), (1, 2, "UP", 1, 2, "more", "TRIAL ENDED", {"action": "down"})], "s int, i int, action string, level int, attempt int, observation string, between string, response map<string,string>")
    sessions = spark.createDataFrame([(1, "sys"), (2, "none")], "s int, system string")
    rows = [(r.s, r.place, r.role, r.content, r.upto) for r in P.message_rows(steps, sessions, ["s"], "i", "prompted-rationale").orderBy("s", "place").collect()]
    assert rows == [(1, 0, "system", "sys", -1), (1, 1, "user", "# Step 0 (Level 0, Attempt 0)\n\nsee", 0), (1, 2, "assistant", '{"action":"up","rationale":"é"}', 0), (1, 3, "user", "TRIAL ENDED\n# Step 2 (Level 1, Attempt 2)\n\nmore", 2), (1, 4, "assistant", '{"action":"down"}', 2), (2, 0, "system", "none", -1)]
    alone = P.message_rows(steps, sessions, ["s"], "i", "action-only")
    assert {r.content for r in alone.where("role = 'assistant'").collect()} == {'{"action":"up"}', '{"action":"down"}'}
    assert {r.content for r in P.with_system(alone, "role", "content", F.lit("new")).where("role = 'system'").collect()} == {"new"}


def test_a_key_mapped_twice(spark):
    source = spark.createDataFrame([(1,), (2,)], "k int")
    m = spark.createDataFrame([(1, "include", "x"), (1, "include", "y"), (2, "exclude", "z")], "k int, action string, selection_reason string")
    rows, errors = P.mapped(source, m, "k")
    assert [(r.k, r.error) for r in errors.collect()] == [(1, "mapped twice")] and [r.k for r in rows.collect()] == [1]
