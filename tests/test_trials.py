"""Decisions, trials and catalogues on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import catalog as C
from tarnlake.operators import trials as T

FRAMES = "play string, t int, action string, score int, ended boolean, win boolean"


def decided(spark, rows):
    out = T.decisions(spark.createDataFrame(rows, FRAMES), ["play"], ["t"], "t", "action").orderBy("play", "step").collect()
    return [(r.play, r.step, r.frame, r.seen_at, r.action, r.score, r.reward, [n for n in ("won", "lose", "timeout") if r[n]]) for r in out]


def test_decisions_end_on_the_next_frame(spark):
    rows = [("p", 0, "up", 0, False, None), ("p", 10, "left", 1, False, None), ("p", 20, None, 1, False, None), ("p", 30, "up", 1, False, None), ("p", 40, None, 3, True, True)]
    assert decided(spark, rows) == [("p", 0, 0, 0, "left", 1, 1, []), ("p", 1, 2, 20, "up", 3, 2, ["won"])]


def test_decisions_late_end_keeps_the_score(spark):
    rows = [("p", 0, None, 0, False, None), ("p", 1, "up", 2, False, None), ("p", 2, None, 2, False, None), ("p", 3, None, 9, True, None)]
    assert decided(spark, rows) == [("p", 0, 0, 0, "up", 2, 2, ["timeout"])]


def test_decisions_own_end_and_no_score(spark):
    rows = [("p", 0, None, 4, False, None), ("p", 1, "up", 5, True, False), ("q", 0, None, 0, False, None), ("q", 1, "up", 1, False, None), ("q", 2, None, None, True, False), ("r", 0, "up", 0, True, True)]
    assert decided(spark, rows) == [("p", 0, 0, 0, "up", 5, 1, ["lose"]), ("q", 0, 0, 0, "up", 1, 1, ["lose"])]


def test_trial_starts_pass_over_synthetic_steps(spark):
    rows = [("s", 0, 0, 1, "up", 1, False, False, False), ("s", 1, 0, 1, "up", 2, True, False, False), ("s", 2, 1, 1, "_level_advance", 50, False, False, False), ("s", 3, 1, 1, "up", 0, False, True, False), ("s", 4, 1, 2, "up", 0, False, False, False), ("s", 5, 1, 2, "up", 0, False, False, False)]
    s = spark.createDataFrame(rows, "s string, i int, level int, attempt int, action string, reward int, won boolean, lose boolean, timeout boolean")
    got = T.trial_starts(s, ["s"], ["i"], ["level", "attempt"], "action").orderBy("i").collect()
    assert [(r.i, r.level, r.attempt, r.ended_as, r.ended_score) for r in got] == [(3, 1, 1, "won", 3), (4, 1, 2, "died", 0)]


def test_interactions_beyond_the_known(spark):
    e = spark.createDataFrame([("g", "red", "kill", "blue"), ("g", "RED", "kill", "BLUE"), ("g", "red", "new", "blue"), ("g", None, "kill", "blue"), ("h", "red", "kill", "blue")], "game string, colour string, effect string, other string")
    known = spark.createDataFrame([("g", "RED", "kill", "BLUE"), ("g", "RED", "push", "BLUE")], e.schema)
    got = {r.game: (r.seen, r.known, round(r.coverage, 4)) for r in T.interaction_coverage(e, known, ["game"]).collect()}
    assert got == {"g": (2, 3, 0.6667), "h": (1, 0, 0.0)}


def test_colour_of_a_kind_waits_for_a_first_object_with_one(spark):
    rows = [("s", 0, 0, "wall", None), ("s", 0, 1, "wall", "RED"), ("s", 1, 0, "wall", "BLUE"), ("s", 2, 0, "wall", "GREEN"), ("s", 0, 0, "key", None)]
    o = spark.createDataFrame(rows, "s string, frame int, place int, kind string, colour string")
    assert [tuple(r) for r in T.first_colours(o, ["s"], ["frame"], "place", "kind", "colour").collect()] == [("s", "wall", "BLUE")]


def test_clocks_of_different_length_are_not_ok(spark):
    a = spark.createDataFrame([("p", 0, 1.0), ("p", 1, 2.0), ("q", 0, 1.0)], "play string, i int, ts double")
    b = spark.createDataFrame([("p", 0, 1.05), ("q", 0, 1.05), ("r", 0, 1.0)], a.schema)
    assert {r.play: r.ok for r in T.clock_drift(a, b, ["play"], "i", "ts").collect()} == {"p": False, "q": True, "r": False}


@pytest.mark.parametrize(
    "key, want",
    [
        ("data/sub-7/model-a/copied-reasoning/x.npz", ("sub-07", "model-a", "copied-reasoning", None)),
        ("subj012_b|oracle|minimal", ("sub-12", None, None, "oracle")),
        ("data/sub-7x/f", (None, None, None, None)),
        ("a/sub-123.json", ("sub-123", None, None, None)),
    ],
)
def test_key_tokens(spark, key, want):
    df = spark.createDataFrame([(key,)], "key string").select(*[c.alias(n) for n, c in C.key_tokens(F.col("key")).items()])
    assert tuple(df.first()) == want


def test_pins_hold_only_for_the_same_generation(spark):
    rows = spark.createDataFrame([("a", 1, None, "new"), ("b", 2, "e", "new"), ("c", 3, "e", "new")], "id string, size int, etag string, version string")
    pins = spark.createDataFrame([("a", 1, None, "old"), ("b", 9, "e", "old")], rows.schema)
    got = C.with_earlier_pins(rows, pins, "id", ["size", "etag"], ["version"]).orderBy("id").collect()
    assert [(r.id, r.version, r.reused) for r in got] == [("a", "old", True), ("b", "new", False), ("c", "new", False)]


def test_budgets_and_fields(spark):
    rows = spark.createDataFrame([(3,), (4,)], "size long")
    assert C.over_budget(rows, "size", 7).count() == 0 and C.over_budget(rows, "size", 6).first().total == 7
    df = spark.sql("select array(named_struct('x', 1, 'y', 2, 'z', 3)) as a").select(C.without_fields(F.col("a"), "y", "z").alias("a"))
    assert df.first().a[0].asDict() == {"x": 1}
