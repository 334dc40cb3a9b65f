"""Texts of observations, outlines and theories against plain versions and by hand."""

import random

from pyspark.sql import functions as F

from tarnlake.operators import texts as T


def plain_ranges(cells):
    """Every maximal run is tried cell by cell on a grid."""
    left, out = set(cells), []
    for x, y in sorted(left):
        if (x, y - 1) not in set(cells):
            end = y
            while (x, end + 1) in set(cells):
                end += 1
            if end - y >= 2:
                out.append(f"({x}, {y}-{end})")
                left -= {(x, v) for v in range(y, end + 1)}
    rest = set(left)
    for y, x in sorted((y, x) for x, y in rest):
        if (x - 1, y) not in rest:
            end = x
            while (end + 1, y) in rest:
                end += 1
            if end > x:
                out.append(f"({x}-{end}, {y})")
                left -= {(v, y) for v in range(x, end + 1)}
    return out + [f"({x}, {y})" for x, y in sorted(left)]


def test_walls(spark):
    rnd = random.Random(5)
    grids = {i: [(x, y) for x in range(6) for y in range(5) if rnd.random() < i / 30] for i in range(1, 31)}
    grids[99] = [(2 * x, 2 * y) for x in range(5) for y in range(5)]
    rows = [(i, x, y) for i, cells in grids.items() for x, y in cells]
    got = {r.frame: r.walls for r in T.wall_texts(spark.createDataFrame(rows, "frame int, x int, y int"), ["frame"]).collect()}
    assert got == {i: ", ".join(plain_ranges(c)) if len(plain_ranges(c)) <= 20 else f"{len(c)} wall positions (borders)" for i, c in grids.items() if c}


def test_observation(spark):
    f = spark.sql("select 1 as frame, 3 as columns, 2 as rows, 4 as score, -1.0D as reward, array(named_struct('label', 'RED', 'n', 2), named_struct('label', 'key', 'n', 0)) as inventory union all select 2, 1, 1, 0, 0.0D, array()")
    o = spark.createDataFrame([(1, "key", "key.2", "BLUE", 1, 1), (1, "avatar", "avatar.1", None, 1, 1), (1, "floor", "floor.1", "GREY", 0, 0), (1, "wall", "wall.1", "BLACK", 0, 0)], "frame int, name string, obj_id string, colour string, x int, y int")
    got = {r.frame: r.text for r in T.observation_texts(f, o, ["frame"]).collect()}
    assert got[1] == "Grid: 3x2\nInventory: RED: 2\nScore: 4 (-1)\nObjects:\n- AVATAR at (1,1)\n- BLUE at (1,1)\nWalls at: (0, 0)"
    assert got[2] == "Grid: 1x1\nScore: 0\nObjects:\n- none"


def test_outline(spark):
    text = "Game x=1 # note\n    Sprites\n\tkey > a\n\t    b\n\n    Rules\n# all comment\n  odd"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(T.outline(F.col("t")).alias("o")).collect()
    assert [(r.line, r.indent, r.content, r.parent) for r in got[0].o] == [(0, 0, "Game x=1", None), (1, 4, "Sprites", 0), (2, 8, "key > a", 1), (3, 12, "b", 2), (5, 4, "Rules", 0), (7, 2, "odd", 0)]
    assert got[1].o == [] and got[2].o is None


def test_theory(spark):
    text = "kill a b {} generic: True\nInteractionSet:\n  kill avatar goal {'v': 1} generic: False\nnonsense\nTerminationSet:\nSpriteCounterRule goal 0 True\nNoveltyRule a b False\nNoveltyRule a b\nshort one\nClass assignments:\navatar: ['BLUE']: <class 'x.y.Moving'>\n"
    got = T.theory_rows(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), ["k"], "t").orderBy("place").collect()
    assert [(r.k, r.section, r.kind, r.args) for r in got] == [
        (1, "interactions", "kill", ["avatar", "goal", "{'v': 1}", "False"]), (1, "terminations", "SpriteCounterRule", ["goal", "0", "True"]), (1, "terminations", "NoveltyRule", ["a", "b", "False", "None"]),
        (1, "terminations", "NoveltyRule", ["NoveltyRule a b"]), (1, "classes", "avatar", ["BLUE", "Moving"]),
    ]


def test_masks(spark):
    one, near, far = [1.0, 0.0], [1.00005, 0.0], [1.1, 0.0]
    masks = spark.createDataFrame([("a", "f", one), ("b", "f", near), ("b", "g", near), ("c", "f", far), ("d", "f", one), ("d", "g", one)], "subject string, file string, affine array<double>")
    cells = [("a", "f", c) for c in (1, 2, 3)] + [("b", f, c) for f in "fg" for c in (1, 2)] + [("c", "f", c) for c in (1, 2)] + [("d", "f", 1), ("d", "f", 2), ("d", "g", 1)]
    cells = spark.createDataFrame(cells, "subject string, file string, cell int")
    common = spark.createDataFrame([(1,), (2,)], "cell int")
    assert sorted(map(tuple, T.mask_errors(masks, cells, common, "subject", "file", "cell").collect())) == [("c", "another grid"), ("d", "files differ")]
    more = common.union(spark.createDataFrame([(3,)], "cell int"))
    assert {r.subject for r in T.mask_errors(masks, cells, more, "subject", "file", "cell").collect() if r.error == "common cells outside"} == {"b", "c", "d"}


def test_outline_of_many_lines_against_a_loop(spark):
    import random

    rng = random.Random(8)
    lines = ["  " * rng.randint(0, 5) + rng.choice(["a > B", "", "# note", "x # y"]) for _ in range(3000)]
    want, seen = [], []
    for i, raw in enumerate(lines):
        content = raw.split("#")[0].strip()
        if content:
            indent = len(raw) - len(raw.lstrip())
            parent = max((k for k, (w, _) in enumerate(seen) if w < indent), default=None)
            seen.append((indent, content))
            want.append((i, indent, content, parent))
    got = spark.createDataFrame([("\n".join(lines),)], "t string").select(T.outline(F.col("t")).alias("o")).head().o
    assert [tuple(r) for r in got] == want
