"""Hand-computed vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.core import checks
from tarnlake.functions import text as X
from tarnlake.operators import align as A
from tarnlake.operators import encode as N
from tarnlake.operators import episodes as E
from tarnlake.operators import graph as G
from tarnlake.operators import manifest as M
from tarnlake.operators import replay as P
from tarnlake.operators import results as R
from tarnlake.operators import state as T
from tarnlake.operators import survival as S
from tarnlake.operators import windows as W


def one(df):
    return df.collect()[0]


def test_discovery_execution_streak(spark):
    df = spark.createDataFrame([([3, 4, 5, 6], ["loss", "win", "win", "loss"]), ([2, 2], ["loss", "incomplete"]), ([], [])], "episode_steps array<bigint>, episode_outcomes array<string>")
    got = df.select(E.discovery_steps().alias("d"), E.execution_steps().alias("x"), E.longest_streak().alias("s")).collect()
    assert [tuple(r) for r in got] == [(7, [5], 2), (4, [], 0), (0, [], 0)]


def test_outcomes(spark):
    rows = [(None, True, "avatar_died"), (None, False, "incomplete"), (False, False, "loss"), (False, True, "avatar_died"), (True, True, "win")]
    df = spark.createDataFrame(rows, "w boolean, d boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", E.any_match_outcome(F.col("w"), F.col("d"))).collect())


EPS = "agent string, level int, episode_steps array<bigint>, episode_outcomes array<string>"


def test_survival_and_censoring(spark):
    eps = spark.createDataFrame([("a", 0, [5], ["win"]), ("a", 1, [4, 3], ["loss", "loss"]), ("a", 2, [2], ["win"]), (None, 0, [1], ["win"])], EPS)
    got = {r.level: (r.time, r.observed) for r in S.survival_table(eps, ["agent"], 4, 1).collect()}
    assert got == {0: (5, True), 1: (14, False), 2: (14, False), 3: (14, False)}
    free = {r.level: (r.time, r.observed) for r in S.survival_table(eps, ["agent"], 4, censor_after_failure=False).collect()}
    assert free == {0: (5, True), 1: (7, False), 2: (2, True), 3: (14, False)}


def test_a_win_without_a_streak_is_observed_but_blocks_what_follows(spark):
    eps = spark.createDataFrame([("a", 0, [5, 7, 9], ["loss", "win", "loss"]), ("a", 1, [3, 3], ["win", "win"]), ("a", 9, [40], ["loss"])], EPS)
    got = {r.level: (r.time, r.observed) for r in S.survival_table(eps, ["agent"], 3).collect()}
    assert got == {0: (12, True), 1: (27, False), 2: (27, False)}
    warm = {r.level: (r.time, r.observed) for r in S.survival_table(eps, ["agent"], 3, warmup=F.col("agent") == "a").collect()}
    assert warm == {0: (52, True), 1: (67, False), 2: (67, False)}


def test_only_censored_times_up_to_the_last_event_move(spark):
    df = spark.createDataFrame([("g", 10, True), ("g", 4, False), ("g", 10, False), ("g", 500, False), ("h", 3, False)], "g string, time long, observed boolean")
    assert sorted((r.g, r.time, r.observed) for r in S.cap_censored(df, ["g"]).collect()) == [("g", 10, True), ("g", 11, False), ("g", 11, False), ("g", 500, False), ("h", 3, False)]


def test_staircase(spark):
    eps = spark.createDataFrame([("a", 0, [5, 7, 9, 100], ["win", "win", "loss", "loss"]), ("a", 1, [4, 4], ["win", "win"]), ("a", 2, [1, 2], ["win", "loss"]), ("b", 1, [4], ["win"]), ("c", 0, [3], ["loss"])], EPS)
    got = sorted((r.agent, r.point, r.steps, r.level) for r in S.staircase(eps, ["agent"]).collect())
    assert got == [("a", 0, 0, 0), ("a", 1, 12, 1), ("a", 2, 20, 2), ("a", 3, 23, 2), ("b", 0, 0, 0), ("c", 0, 0, 0), ("c", 1, 3, 0)]


def test_density_counts_values_below_one_as_one(spark):
    grid = spark.createDataFrame([(0, 1.0), (1, 10.0)], "point long, x double")
    df = spark.createDataFrame([("a", 0), ("a", 10), ("b", 5), ("b", 5), ("c", 7)], "g string, value long")
    got = {(r.g, r.point): r.density for r in S.gaussian_density(df, ["g"], grid).collect()}
    k = lambda z: math.exp(-0.5 * (z / 0.3) ** 2) / (2 * 0.3 * math.sqrt(2 * math.pi))
    assert abs(got["a", 0] - (k(0) + k(1))) < 1e-12 and got["b", 0] == 0 and got["c", 1] == 0


def test_within_budget(spark):
    rows = [("a", i, 10) for i in range(10)] + [("b", i, 10) for i in range(9)] + [("c", 0, 500), ("c", 1, 10), ("c", 2, 10)]
    df = spark.createDataFrame(rows, "c string, turn int, n int")
    got = {}
    for r in P.within_budget(df, "c", "turn", F.col("n"), 60, 2).collect():
        got.setdefault(r.c, []).append(r.turn)
    assert {c: sorted(t) for c, t in got.items()} == {"a": [0, 5, 6, 7, 8, 9], "b": [0, 5, 6, 7, 8], "c": [0, 1, 2]}


def test_event_curve_is_the_product_limit(spark):
    rng = random.Random(4)
    rows = [("g", rng.randint(1, 50), rng.random() < 0.7) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, time long, observed boolean")
    capped = S.cap_censored(df, ["g"])
    grid = spark.createDataFrame([(i, float(i)) for i in range(0, 60, 5)], "point long, x double")
    got = {r.x: r.share for r in S.event_curve(capped, ["g"], grid).collect()}
    times = [(r.time, r.observed) for r in capped.collect()]
    for x, share in got.items():
        surv = 1.0
        for t in sorted({t for t, o in times if o and t <= x}):
            surv *= 1 - sum(o and u == t for u, o in times) / sum(u >= t for u, _ in times)
        assert abs(share - (1 - surv)) < 1e-12


def test_lags_never_cross_plays(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 3])] + [(1, i, float(v)) for i, v in enumerate([101, 102, 103])], "play int, t int, x double")
    got = [[r.lag_1, r.lag_2] for r in W.lagged(df, ["play"], ["t"], "x", [1, 2]).orderBy("play", "t").collect()]
    assert got == [[1, 1], [1, 1], [2, 1], [101, 101], [101, 101], [102, 101]]


def test_run_starts(spark):
    acts = ["up", "up", "up", "down", "down", "left"]
    df = spark.createDataFrame([(0, i, a) for i, a in enumerate(acts)], "p int, step int, action string")
    assert [r.step for r in W.run_starts(df, ["p"], ["step"], ["action"]).orderBy("step").collect()] == [0, 3, 5]


def test_volumes(spark):
    df = spark.createDataFrame([(0, t, 100.0) for t in (100.0, 100.75, 102.25, 108.5)], "play int, ts double, start double")
    got = A.timed(df, ["play"], "ts", "start", 2.0, F.lit(3)).orderBy("ts").collect()
    assert [r.volume for r in got] == [0, 0, 1, 4] and [r.valid for r in got] == [True, True, True, False]
    assert [r.v for r in spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "o double").select(A.volume(F.col("o"), 2.0).alias("v")).collect()] == [0, 2, 2]


def test_bins(spark):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 3.0), (0, 2, 2, 7.0), (0, 3, 2, 9.0)], "play int, i int, bin long, x double")
    assert [r.value for r in A.bin_values(df, ["play"], "bin", ["i"], "x").orderBy("bin").collect()] == [2.0, 0.0, 8.0]
    assert [r.value for r in A.bin_values(df, ["play"], "bin", ["i"], "x", "last").orderBy("bin").collect()] == [3.0, 0.0, 9.0]
    with pytest.raises(ValueError):
        A.bin_values(df, ["play"], "bin", ["i"], "x", "median")


def test_nearest(spark):
    l = spark.createDataFrame([(0, 1, 0.95), (0, 2, 1.5), (0, 3, 3.0)], "k int, id int, t double")
    r = spark.createDataFrame([(0, 10, 0.9), (0, 11, 1.0), (0, 12, 1.41), (1, 13, 3.0)], "k int, rid int, u double")
    got = {x.id: x.rid for x in A.nearest(l, r, ["k"], "t", "u", "rid", 0.1).collect()}
    assert got == {1: 10, 2: 12}


def test_train_scaling_and_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 9.0, False), ("b", 2.0, True), ("b", 2.0, True)], "k string, x double, tr boolean")
    z = sorted(r.z for r in N.scaled_by_train(df, ["k"], "x", "tr").collect())
    s = math.sqrt(2)
    assert np.allclose(z, [-1 / s, 0, 0, 1 / s, 7 / s])
    c = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 5.0)], "k string, x double, y double")
    assert {r.k: round(r.r, 9) for r in N.correlation(c, ["k"], "x", "y").collect()} == {"a": 1.0, "b": 0.0}


def test_ridge_and_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [3, 1, 1, 0.2]
    y = x @ [1.0, -2.0, 0.5, 0.0] + 4
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y, strict=True)], "v array<double>, y double")
    w, b = N.ridge(df, "v", "y", [2.0])[2.0]
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 2 * np.eye(4), xc.T @ yc)
    assert np.allclose(w, want) and abs(b - (y.mean() - x.mean(0) @ want)) < 1e-9
    mean, top = N.principal_components(df, "v", 2)
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs(top), np.abs(np.linalg.svd(xc)[2][:2]), atol=1e-6)


def test_selection(spark):
    df = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.5), ("m", 3, 0.1), ("m", 4, 0.4)], "model string, layer int, v double")
    assert one(R.best(df, ["model"], "v", ["layer"])).layer == 1
    assert {r.pick: r.layer for r in R.ranked_pick(df, ["model"], "v", ["layer"]).collect()} == {"worst": 3, "median": 1, "best": 2}
    assert R.depth_layers(9, 3, [1, 2, 3, 5, 9]) == [1, 5, 9] and R.depth_layers(32, 3, [5, 6, 7, 8, 9, 10]) == [5, 9, 10] and R.depth_layers(2, 3, [4, 2]) == [2, 4]


def test_declared_rows_match_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "s"), ("b", None)], "m string, stream string")
    c = spark.createDataFrame([("a", None)], "m string, stream string")
    assert [tuple(r) for r in R.declared(df, c, ["m", "stream"]).collect()] == [("a", None)]


def test_rules(spark):
    df = spark.createDataFrame([("data/a.json",), ("data/b.txt",), ("logs/x",)], "k string")
    rule, decision = M.first_rule(F.col("k"), [("j", "data/", r".*\.json", "include"), ("d", "data/", None, "exclude")])
    assert [(r.r, r.d) for r in df.select("k", rule.alias("r"), decision.alias("d")).orderBy("k").collect()] == [("j", "include"), ("d", "exclude"), (None, "defer")]
    enc = spark.createDataFrame([("a b/~c*/ü",)], "p string").select(M.percent_encoded(F.col("p")).alias("e"))
    assert one(enc).e == "a%20b/~c%2A/%C3%BC"


def test_evidence(spark):
    m = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, gen int")
    e = spark.createDataFrame([("x", 1), ("y", 9), ("w", 1)], "id string, gen int")
    merged, wrong, unused = M.merge_verified(m, e, "id", ["gen"])
    assert {r.id: r.verified for r in merged.collect()} == {"x": True, "y": False, "z": False}
    assert one(wrong).id == "y" and one(unused).id == "w"


def test_delta_round_trip(spark):
    rng = random.Random(5)
    rows = [(p, f, k, rng.randint(0, 2)) for p in range(3) for f in range(12) for k in "abcd" if rng.random() < 0.7]
    rows += [(p, f, "always", 0) for p in range(3) for f in range(12)]
    df = spark.createDataFrame(rows, "play int, frame int, key string, v int")
    back = P.delta_expand(P.delta_encode(df, ["play"], "frame", "key", "v"), df, ["play"], "frame", "key", "v")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_token_windows(spark):
    df = spark.createDataFrame([(50, list(range(0, 51, 5)), 20, 10), (50, [0, 8, 22, 37, 50], 20, 10), (100, [0, 20, 40, 60, 80], 200, 100), (24, [0], 20, 10), (0, [], 5, 1)], "n long, at array<long>, w long, s long")
    got = [r.x for r in df.select(P.token_windows("n", "at", "w", "s").alias("x")).collect()]
    assert got[0] == [[0, 20], [10, 30], [20, 40], [30, 50]] and [a for a, _ in got[1]] == [0, 8, 22, 37]
    assert got[2] == [[0, 100]] and got[3] == [[i, min(i + 20, 24)] for i in range(5)] and got[4] == []
    bad = spark.createDataFrame([(100, [0, 25], 50, 0)], "n long, at array<long>, w long, s long").select(P.token_windows("n", "at", "w", "s"))
    with pytest.raises(Exception, match="stride"):
        bad.collect()


def test_assigned_targets(spark):
    wins = spark.createDataFrame([(0, i, 10 * i, 10 * i + 20) for i in range(4)], "k int, w long, start long, end long")
    t = spark.createDataFrame([(0, p) for p in (5, 15, 25, 35, 45)], "k int, pos long")
    assert {r.pos: r.w for r in P.assign_targets(t, wins, ["k"]).collect()} == {5: 0, 15: 0, 25: 1, 35: 2, 45: 3}


@pytest.mark.parametrize(("text", "want"), [('so {"action": "UP", "n": 1} then {', '{"action": "UP", "n": "1"}'), ('{broken ```json\n{"a": "b"}\n```', '{"a": "b"}'), ("none", None), (None, None), ('{"s": "}"}', '{"s": "}"}')])
def test_json_in(text, want):
    assert P.json_in(text) == want


def test_advancement(spark):
    df = spark.createDataFrame([(["win", "win", "loss", "loss", "win"],), (["loss"] * 4,), (["win", "loss"] * 5,)], "o array<string>")
    got = [tuple(r.a) for r in df.select(T.advancement(F.col("o"), 2, 3, 6).alias("a")).collect()]
    assert got == [(1, 5, ""), (0, 3, "losses"), (0, 6, "budget")]


def test_breadth_first(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 0), (5, 6)], "src long, dst long")
    got = {r.node: r.depth for r in G.breadth_first(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_checks(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 2, 5), (1, 6, 7)], "k int, a int, b int")
    assert [r.a for r in checks.gaps(df, ["k"], "a", "b").collect()] == [6]
    with pytest.raises(checks.IntegrityError):
        checks.require_empty(checks.duplicate_keys(df, ["k"]), "k is unique")
    checks.require_empty(checks.duplicate_keys(df, ["k", "a"]), "k, a is unique")
    paths = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a\\b",), (None,)], "p string")
    assert checks.unsafe_paths(paths, "p").count() == 4
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double")
    assert checks.not_finite(bad, ["x"]).count() == 2


def test_names(spark):
    game, cohort = X.game_identity(F.col("n"), ("c3", "c4"))
    df = spark.createDataFrame([("C3_Bait",), ("sky_c4",), ("other",)], "n string").select(game.alias("g"), cohort.alias("c"))
    assert [tuple(r) for r in df.collect()] == [("bait", "c3"), ("sky", "c4"), (None, None)]
    k = spark.createDataFrame([([False, True],)], "k array<boolean>").select(X.key_vector(F.col("k"), [1, 0, 7]).alias("v"), X.action(F.col("k"), {"R": 0, "L": 1}, F.lit("wait")).alias("a"))
    assert tuple(one(k)) == ([1, 0, 0], "L")


def test_breadth_first_is_whole_or_raises(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert G.breadth_first(e, start).count() == 6
    with pytest.raises(RuntimeError):
        G.breadth_first(e, start, most=3)


def test_numbers_of_the_whole_table(spark):
    rows = [(i * 37 % 101, "x") for i in range(101)]
    got = W.numbered(spark.createDataFrame(rows, "v int, s string"), ["v"], "at", 7).collect()
    assert sorted((r.v, r.at) for r in got) == [(i, i) for i in range(101)]


def test_equal_left_rows_keep_their_match(spark):
    l = spark.createDataFrame([(0, 1.0, {"a": 1}), (0, 1.0, {"a": 1}), (0, 9.0, None)], "k int, t double, m map<string,int>")
    r = spark.createDataFrame([(0, 7, 1.05), (0, 6, 0.95)], "k int, rid int, u double")
    assert [x.rid for x in A.nearest(l, r, ["k"], "t", "u", "rid", 0.1).collect()] == [6, 6]


def test_contained(spark):
    g = spark.createDataFrame([(0, "a", 5.0, 8.0), (0, "b", 5.0, 40.0), (0, "c", -1.5, 3.0)], "k int, grp string, g_min double, g_max double")
    s = spark.createDataFrame([(0, 0.0, 10.0), (0, 4.0, 20.0), (1, 0.0, 99.0)], "k int, s_min double, s_max double")
    got = sorted((r.grp, r.s_min, r.candidates) for r in A.contained(g, s, ["k"], 2.0, 6.0).collect())
    assert got == [("a", 0.0, 2), ("a", 4.0, 2), ("c", 0.0, 1)]


def test_large_means_do_not_cancel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    y = 0.5 * x + rng.normal(size=200)
    df = spark.createDataFrame([("a", float(1e8 + u), float(1e8 + v), i) for i, (u, v) in enumerate(zip(x, y, strict=True))], "k string, x double, y double, i int")
    assert abs(one(N.correlation(df, ["k"], "x", "y")).r - np.corrcoef(x + 1e8, y + 1e8)[0, 1]) < 1e-6
    assert abs(one(W.lag_one_correlation(df, ["k"], ["i"], "y")).rho - np.corrcoef(y[1:] + 1e8, y[:-1] + 1e8)[0, 1]) < 1e-6
