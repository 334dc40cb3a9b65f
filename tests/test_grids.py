import numpy as np
import pytest

from tarnlake.core.checks import IntegrityError
from tarnlake.operators import features as X
from tarnlake.operators import grids as D
from tarnlake.operators import windows as W


def test_labels_of_an_atlas(spark):
    lines = ["# comment", "", "FAG  Precentral_L\t2001 ", "FAD Precentral_R 2002", "two words", "A B C", "X Precentral_L 7", "  # 1 2 3"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, t string").repartition(3)
    assert {r.name: r.code for r in D.atlas_labels(df, "n", "t").collect()} == {"Precentral_L": 7, "Precentral_R": 2002}
    with pytest.raises(IntegrityError, match="no labels"):
        D.atlas_labels(df.where("n < 2"), "n", "t")


def test_resampling_against_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 90, (7, 6, 5))
    theirs = np.diag([3.0, 3.0, 3.0, 1.0])
    theirs[:3, 3] = [-4, 2, 1]
    turn = np.array([[0.8, -0.6, 0, 1.5], [0.6, 0.8, 0, -2.25], [0, 0, 2.5, 3], [0, 0, 0, 1]])
    want = {}
    for x in range(-3, 20):
        for y in range(-3, 20):
            for z in range(5):
                p = (np.linalg.inv(theirs) @ turn @ [x, y, z, 1])[:3]
                ok = all(0 <= v <= n - 1 for v, n in zip(p, codes.shape, strict=True))
                want[x, y, z] = int(codes[tuple(int(np.floor(v + 0.5)) for v in p)]) if ok else 0
    cells = spark.createDataFrame(list(want), "x long, y long, z long")
    atlas = spark.createDataFrame([(int(i), int(j), int(k), int(codes[i, j, k])) for i in range(7) for j in range(6) for k in range(5) if codes[i, j, k]], "x int, y int, z int, code int")
    got = {(r.x, r.y, r.z): r.code for r in D.resampled_codes(cells, atlas, (7, 6, 5), turn.ravel().tolist(), theirs[:3].ravel().tolist()).collect()}
    assert got == want and sum(v > 0 for v in want.values()) > 100
    half = D.resampled_codes(spark.createDataFrame([(0, 0, 0), (1, 0, 0), (6, 0, 0), (7, 0, 0)], "x int, y int, z int"), spark.createDataFrame([(i, 0, 0, i + 1) for i in range(4)], "x int, y int, z int, code int"), (4, 1, 1), [0.5, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], np.eye(4).ravel().tolist())
    assert [r.code for r in half.orderBy("x").collect()] == [1, 2, 4, 0]  # half way goes up, past the last centre is outside
    for bad in ([1.0] * 11, [0.0] * 12, [float("nan")] * 16):
        with pytest.raises(ValueError):
            D.affine(bad)


def test_scores_of_other_places_raise(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "x int, y int, z int")
    scores = spark.createDataFrame([("a", 1, 0, 0.5), ("a", 2, 0, 0.5), ("b", 2, 0, 0.1), ("a", 3, 0, 0.2)], "subject string, layer int, place long, value double")
    got = {(r.x, r.y, r.z): (r.layer, r.value) for r in D.best_layer_volume(scores, mask, "subject", "layer", "place", "value").collect()}
    assert got == {(0, 0, 0): (1, 0.5), (0, 1, 0): (None, None)}
    with pytest.raises(IntegrityError):
        D.best_layer_volume(scores.selectExpr("subject", "layer", "place + 2 as place", "value"), mask, "subject", "layer", "place", "value")


@pytest.mark.parametrize("parts", [1, 4])
def test_offsets_are_sums_of_what_comes_before(spark, parts):
    rows = [(i // 3, i, (i * 7) % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, n int").repartition(3)
    got = {r.b: r.start for r in W.offsets(df, ["a", "b"], "n", "start", parts).collect()}
    assert got == {b: sum(n for _, c, n in rows if c < b) for _, b, _ in rows}


def test_matrix_of_plays_against_loops(spark):
    rng = np.random.default_rng(4)
    plays = [("b", 7, 3), ("a", 10, 4), ("c", 2, 5), ("d", 0, 2)]
    calls = [(p, int(s), rng.normal(size=2).tolist()) for p, n, _ in plays[:2] for s in rng.choice([0, 1, 2, 6, n - 1, n], 9)] + [("z", 0, [1.0, 1.0])]
    df = spark.createDataFrame(plays, "play string, n_steps int, per_bin int")
    cs = spark.createDataFrame(calls, "play string, step int, vector array<double>").repartition(3)
    for carry in (False, True):
        want, at = {}, 0
        for p, n, per in sorted(plays):
            last = [0.0, 0.0]
            for b in range(-(-n // per)):
                steps = [[v for q, s, v in calls if q == p and s == t] for t in range(b * per, min(n, (b + 1) * per))]
                means = [np.mean(v, axis=0) if v else np.zeros(2) for v in steps]
                some = [m for m, v in zip(means, steps, strict=True) if v]
                v = (np.mean(some, axis=0) if some else last) if carry else np.mean(means, axis=0)
                last = v
                want[p, b] = at, v, bool(some)
                at += 1
        got = {(r.play, r.bin): (r.position, r.vector, r.observed) for r in X.aligned_matrix(df, cs, ["play"], ["play"], 2, carry).collect()}
        assert got.keys() == want.keys()
        for k, (pos, v, seen) in want.items():
            assert got[k][0] == pos and got[k][2] == seen and np.allclose(got[k][1], v), (k, carry)
