import pytest
from pyspark.sql import functions as F

from tarnlake.core.checks import IntegrityError
from tarnlake.operators import compact as K
from tarnlake.operators import conversations as C

U, A = C.OF_ROLE["user"], C.OF_ROLE["assistant"]


def test_starts_of_both_forms_and_their_errors(spark):
    one = "<|im_start|>system\nsé<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    rows = [
        ("any", one, ["system", "user"]), ("of role", f"be good{U}hi{A}yes{U}so", ["system", "user", "assistant", "user"]), ("both", one + U, ["system", "user"]), ("none", "plain", ["user"]), ("null", None, ["user"]), ("no roles", one, None),
        ("more", one, ["system"]), ("fewer", f"x{U}hi", ["system", "user", "user"]), ("no system", f"{U}hi{A}yes", ["user", "assistant"]), ("tool", f"x{U}hi", ["system", "user", "tool"]), ("order", f"x{A}hi{U}yes", ["system", "user", "assistant"]), ("at once", f"{U}hi", ["system", "user"]),
    ]
    got = {r.k: (r.starts, r.error) for r in C.marker_starts(spark.createDataFrame(rows, "k string, text string, roles array<string>"), ["k"], "text", "roles").collect()}
    assert got["any"] == ([0, one.index("<|im_start|>user")], None)
    assert got["of role"] == ([0, 7, 7 + len(U) + 2, 7 + len(U) + 2 + len(A) + 3], None)
    number, order = "another number of marks", "marks in another order than the roles"
    assert {k: e for k, (s, e) in got.items() if e and s is None} == {"both": "marks of both forms", "none": "no marks", "null": "no marks", "no roles": number, "more": number, "fewer": number, "no system": "the first message is not the system's", "tool": "a role without a mark", "order": order, "at once": order}


PLAYS = [(0, "a", 1, 3, 0, "win", 0, 2), (1, "b", 1, 4, 0, "loss", 2, 2), (2, "c", 2, 1, 1, "win", 4, 1)]
FRAMES = [(0, "a", 0, 1.0), (1, "a", 1, 2.0), (2, "b", 0, 3.0), (3, "b", 1, 4.0), (4, "c", 0, 5.0)]
SHOWN = [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 0, 1), (3, 1, 0, 1), (4, 0, 1, 0)]
STEPS = [(0, "UP", "a", 1, 1, 0, 0, 0, 2.0, 1), (1, "UP", "b", 0, 1, 1, 0, 1, 3.0, 2), (2, "DOWN", "c", 0, 2, 2, 1, 0, 5.0, 4)]


def merged(spark, plays=PLAYS, frames=FRAMES, gen_plays=None, shown=SHOWN, steps=STEPS):
    make = lambda rows, schema: spark.createDataFrame([("r", *x) for x in rows], "rec string, " + schema)
    head = "ordinal int, play string, run int, document int, level int, outcome string"
    return C.merged_steps(
        make(plays, head + ", state_start int, state_count int"), make(frames, "pos int, play string, time int, ts double"), make([p[:6] for p in plays] if gen_plays is None else gen_plays, head), make(shown, "pos int, time int, level int, attempt int"),
        make(steps, "i int, action string, play string, frame int, run int, trial int, level int, attempt int, ts double, state_index int"), ["rec"],
    )


def changed(rows, i, **at):
    rows = [list(r) for r in rows]
    for k, v in at.items():
        rows[i][int(k[1:])] = v
    return [tuple(r) for r in rows]


CASES = {
    "plays or their order changed": [{"gen_plays": [p[:6] for p in PLAYS[:2]]}, {"gen_plays": changed([p[:6] for p in PLAYS], 1, _5="win")}, {"gen_plays": [(0, *PLAYS[1][1:6]), (1, *PLAYS[0][1:6]), PLAYS[2][:6]]}],
    "a play twice": [{"plays": changed(PLAYS, 1, _1="a")}], "invalid bounds of a play": [{"plays": changed(PLAYS, 1, _6=1)}, {"plays": changed(PLAYS, 2, _7=0)}], "frames without a play": [{"frames": [*FRAMES, (5, "c", 1, 6.0)]}],
    "a frame differs": [{"shown": SHOWN[:4]}, {"shown": changed(SHOWN, 3, _3=0)}, {"frames": changed(FRAMES, 2, _3=float("nan"))}, {"frames": changed(FRAMES, 2, _2=1)}],
    "a synthetic step": [{"steps": changed(STEPS, 0, _1="_advance")}], "an unknown play": [{"steps": changed(STEPS, 1, _2="z")}], "a frame out of range or twice": [{"steps": changed(STEPS, 1, _3=2)}, {"steps": [*STEPS, (3, "UP", "c", 0, 2, 2, 1, 0, 5.0, 4)]}],
    "steps reorder frames": [{"steps": [(0, *STEPS[1][1:]), (1, *STEPS[0][1:]), STEPS[2]]}], "a step's identity or clock disagrees": [{"steps": changed(STEPS, 1, _8=3.5)}, {"steps": changed(STEPS, 2, _9=3)}, {"steps": changed(STEPS, 0, _5=1)}],
}


def test_complete_conversations_are_merged(spark):
    good, errors = merged(spark)
    assert errors.count() == 0 and [(r.i, r.pos, r.measured_time) for r in good.orderBy("i").collect()] == [(0, 1, 1), (1, 2, 0), (2, 4, 0)]


@pytest.mark.parametrize("error", sorted(CASES))
def test_damaged_conversations_are_not(spark, error):
    for case in CASES[error]:
        good, errors = merged(spark, **case)
        assert error in {r.error for r in errors.collect()}, case
        assert good.count() == 0


def test_types_deep_and_in_a_circle(spark):
    chain = [(1, f"t{i}", f"t{i + 1}" if i < 20 else None, i == 0, "x/red" if i == 0 else None) for i in range(21)]
    types = spark.createDataFrame([*chain, (1, "s", "t20", True, "Blue"), (1, "bare", "t20", True, None), (2, "t0", None, True, "green")], "g int, name string, parent string, leaf boolean, colour string")
    up = C.ancestors(types, ["g"], "name", "parent")
    assert {r.above for r in up.where("name = 't0' and g = 1").collect()} == {f"t{i}" for i in range(21)} and up.count() == sum(21 - i for i in range(21)) + 5
    effects = spark.createDataFrame([(1, "t20", "kill", "t0"), (1, "t3", "push", "s"), (1, "s", "end", "EOS"), (2, "t0", "kill", "t20")], "g int, actor string, effect string, actee string")
    got = {tuple(r) for r in C.known_interactions(types, effects, ["g"]).collect()}
    assert got == {(1, "X/RED", "kill", "X/RED"), (1, "BLUE", "kill", "X/RED"), (1, "X/RED", "push", "BLUE")}
    with pytest.raises(IntegrityError, match="own ancestor"):
        C.ancestors(types.withColumn("parent", F.when(F.col("name") == "t20", "t0").otherwise(F.col("parent"))), ["g"], "name", "parent")


def test_many_leaves_under_a_deep_type_make_no_pairs(spark, monkeypatch):
    """2,000 leaves below eight types one over the other, some of them named twice: no written table has more rows than there are types."""
    from tarnlake.core import shared

    sizes, write = [], shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df: sizes.append(write(df)) or sizes[-1])
    monkeypatch.setattr(shared, "release", lambda *tables: None)
    leaves = [(1, f"l{i}", f"t{i % 2}", True, ["red", "blue", None][i % 3]) for i in range(2000)]
    chain = [(1, f"t{i}", f"t{max(i + 1, 2)}", False, "none") for i in range(8)]
    types = spark.createDataFrame([*leaves, *chain, (1, "l0", "other", True, "green"), (1, "l1", "l4", True, None)], "g int, name string, parent string, leaf boolean, colour string")
    effects = spark.createDataFrame([(1, "t5", "kill", "l1"), (1, "other", "push", "other"), (1, "l4", "bounce", "l4")], "g int, actor string, effect string, actee string")
    got = {tuple(r) for r in C.known_interactions(types, effects, ["g"]).collect()}
    two = [(1, a, "push", b) for a in ("RED", "GREEN") for b in ("RED", "GREEN")]
    assert got == {(1, "RED", "kill", "BLUE"), (1, "BLUE", "kill", "BLUE"), (1, "GREEN", "kill", "BLUE"), (1, "BLUE", "bounce", "BLUE"), *two}
    assert sizes and max(t.count() for t in sizes) <= types.count()


def test_avatars_and_their_deaths(spark):
    text = "BasicGame\n SpriteSet\n  avatar > MovingAvatar img=x\n\tghost>ShootAvatar\n  wall > Immovable note=Avatar\n  a b > OneAvatar\n"
    df = spark.createDataFrame([(text, [["killSprite", "ghost", "wall"]]), (text, [["killSprite", "wall", "avatar"], ["killSprite"], []]), ("none", [["killSprite", "avatar"]])], "t string, e array<array<string>>")
    rows = df.select(C.avatar_classes(F.col("t")).alias("a"), C.died(F.col("e"), C.avatar_classes(F.col("t"))).alias("d")).collect()
    assert [(sorted(r.a), r.d) for r in rows] == [(["avatar", "ghost"], True), (["avatar", "ghost"], False), ([], False)]


def replay(spark):
    s = lambda i, col: {"id": i, "col": col, "uid": f"u{i}"}
    rows = [("r", 0, {"a": [s(1, 0.0)], "b": [s(2, 1.5), s(3, 1.0)]}, 0), ("r", 1, {"a": [s(1, 0.0)], "b": [s(2, 1.5)]}, 1), ("r", 2, {"b": [s(2, 1.5)], "c": []}, 2), ("r", 3, {"a": [s(1, 0.0)]}, 3), ("r", 4, {}, 4), ("r", 5, None, 5), ("q", 0, {"a": None}, 0), ("q", 1, {"a": [s(9, 2.0)]}, 1)]
    return spark.createDataFrame(rows, "rec string, frame int, sprites map<string,array<struct<id:int,col:double,uid:string>>>, score int")


def test_compact_replays_expand_to_their_frames(spark):
    frames = replay(spark)
    small = K.compacted(frames, ["rec"], "frame", ["score"], ["uid"])
    at = {(r.rec, r.frame): r.sprites for r in small.collect()}
    assert set(at["r", 1]) == {"b"} and at["r", 2] == {"a": None, "c": []} and set(at["r", 3]) == {"a", "b", "c"} and at["r", 3]["b"] is None and at["r", 5] == {} and at["q", 0] == {"a": []}
    source = K.evidence(frames, ["rec"], "frame", ["score"], ["uid"])
    assert all(r.same for r in K.verified(small, source, ["rec"], "frame", ["score"]).collect())
    e = {r.rec: (r.frames, r.sprites, r.fractional) for r in source.collect()}
    assert e == {"r": (6, 7, 3), "q": (2, 1, 0)}


@pytest.mark.parametrize("damage", ["lost null", "score", "order", "frame gone", "recording gone"])
def test_what_was_lost_is_found(spark, damage):
    frames = replay(spark)
    small = K.compacted(frames, ["rec"], "frame", ["score"], ["uid"])
    source = K.evidence(frames, ["rec"], "frame", ["score"], ["uid"])
    at = (F.col("rec") == "r") & (F.col("frame") == 2)
    if damage == "lost null":
        small = small.withColumn("sprites", F.when(at, F.map_filter("sprites", lambda k, v: v.isNotNull())).otherwise(F.col("sprites")))
    elif damage == "score":
        small = small.withColumn("score", F.when(at, 7).otherwise(F.col("score")))
    elif damage == "order":
        small = small.withColumn("frame", F.when(at, 3).when((F.col("rec") == "r") & (F.col("frame") == 3), 2).otherwise(F.col("frame")))
    elif damage == "frame gone":
        small = small.where(~((F.col("rec") == "r") & (F.col("frame") == 5)))
    else:
        small = small.where("rec = 'q'")
    got = {r.rec: r.same for r in K.verified(small, source, ["rec"], "frame", ["score"]).collect()}
    assert got == {"r": False, "q": True}


GAME = """BasicGame block=2
  SpriteSet   # types
    wall > Immovable img=colors/DARKGRAY
    thing > Missile speed=1 img=colors/RED
      fast > speed=2
        faster >
      slow > Passive img=colors/BLUE speed=3 speed=4
    bare > Passive
  InteractionSet
    thing wall EOS > bounce
    fast slow > killSprite score=1
  TerminationSet
    SpriteCounter stype=slow limit=0 win=True
"""


def test_types_and_effects_of_a_game(spark):
    from tarnlake.operators import texts as T

    g = spark.createDataFrame([(1, GAME), (2, "no game")], "g int, t string").select("g", T.outline(F.col("t")).alias("o"))
    s = C.section_rows(g, ["g"], "o")
    assert {r.section for r in s.collect()} == set(C.SECTIONS[:3]) and s.where("section = 'TerminationSet'").count() == 1
    types = {r.name: (r.parent, r.leaf, r["class"], r.colour) for r in C.game_types(s, ["g"]).collect()}
    assert types == {
        "wall": (None, True, "Immovable", "DARKGRAY"), "thing": (None, False, "Missile", "RED"), "fast": ("thing", False, "Missile", "RED"), "faster": ("fast", True, "Missile", "RED"), "slow": ("thing", True, "Passive", "BLUE"), "bare": (None, True, "Passive", None),
    }
    effects = {(r.actor, r.effect, r.actee, tuple(sorted(r.settings.items()))) for r in C.game_effects(s, ["g"]).collect()}
    assert effects == {("thing", "bounce", "wall", ()), ("thing", "bounce", "EOS", ()), ("fast", "killSprite", "slow", (("score", "1"),))}
    got = {tuple(r) for r in C.known_interactions(C.game_types(s, ["g"]), C.game_effects(s, ["g"]), ["g"]).collect()}
    assert got == {(1, "RED", "bounce", "DARKGRAY"), (1, "BLUE", "bounce", "DARKGRAY"), (1, "RED", "killSprite", "BLUE")}


def test_prompts_and_actions_by_name(spark):
    files = spark.createDataFrame([("r/a.txt", "root a"), ("r/sub/a.txt", "sub a"), ("r/b.txt", "root b")], "path string, value string")
    assert {tuple(r) for r in C.first_found(files, "path", "value", "r/", ["a", "b"], ["sub", ""]).collect()} == {("a", "sub a"), ("b", "root b")}
    with pytest.raises(IntegrityError, match="prompts"):
        C.first_found(files, "path", "value", "r", ["c"], ["sub", ""])
    df = spark.createDataFrame([(["UP", "left", "jump", None],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(C.action_indices(F.col("a"), {"up": 1, "LEFT": 2})).collect()] == [[1, 2, 0, 0], []]
