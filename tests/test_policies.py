import random

import pytest
from pyspark.sql import functions as F

from tarnlake.core.checks import IntegrityError
from tarnlake.operators import fit as X
from tarnlake.operators import graph as G
from tarnlake.operators import policies as P


@pytest.mark.parametrize("settings", [None, {}, {"strategy": "other"}, {"strategy": "fixed_budget", "level_frame_budget": 0}, {"strategy": "fixed_budget", "total_frame_budget": 3}, {"strategy": "blocked_curricula", "consecutive_wins_required": 0}, {"strategy": "blocked_curricula", "max_consecutive_losses": -1}])
def test_impossible_policies(settings):
    with pytest.raises(ValueError):
        P.policy(settings)


def loop(attempts, rule, levels):
    """The run's loop as it is told: budgets are looked at before an attempt, outcomes after it."""
    level = attempt = lf = total = ws = ls = wins = losses = n = 0
    fixed = isinstance(rule, P.FixedBudget)
    reason = ""
    for frames, won, died in attempts:
        if level >= levels:
            break
        if (rule.level_frame_budget - lf if fixed else rule.total_frame_budget - total) <= 0:
            reason = "budget"
            break
        n += 1
        lf += frames
        total += frames
        if won:
            wins, ws, ls = wins + 1, ws + 1, 0
        if died:
            losses, ws, ls = losses + 1, 0, ls + 1
        out = lf >= rule.level_frame_budget if fixed else total >= rule.total_frame_budget
        if not fixed and rule.max_consecutive_losses and ls >= rule.max_consecutive_losses:
            reason = "losses"
            break
        up = out if fixed else won and ws >= rule.consecutive_wins_required
        if not fixed and out and not up:
            reason = "budget"
            break
        if up:
            level, attempt, lf, ws = level + 1, 0, 0, 0
        elif won or died:
            attempt += 1
    if level >= levels:
        reason = "completed"
    elif not reason and not fixed and total >= rule.total_frame_budget:
        reason = "budget"
    return level, attempt, wins, losses, n, reason


@pytest.mark.parametrize("rule", [P.FixedBudget(30), P.BlockedCurricula(200, 2, 0), P.BlockedCurricula(120, 1, 3), P.BlockedCurricula(10_000, 3, 4)])
def test_runs_against_a_loop(spark, rule):
    rng = random.Random(3)
    runs = []
    for k in range(60):
        runs.append((k, [(rng.randint(1, 25), *rng.choice([(True, False), (False, True), (False, False)])) for _ in range(rng.randint(0, 25))]))
    df = spark.createDataFrame(runs, "k int, a array<struct<frames:int,won:boolean,died:boolean>>")
    got = {r.k: (r.s.level, r.s.attempt, r.s.wins, r.s.losses, r.s.attempts, r.s.reason) for r in df.select("k", P.run(F.col("a"), rule, 3).alias("s")).collect()}
    assert got == {k: loop(a, rule, 3) for k, a in runs}


def test_predicates_over_nothing(spark):
    seen = spark.createDataFrame([("a",), ("b",)], "node string")
    states = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "node string, x int")
    got = {r.name: (r.any_state, r.all_states) for r in G.any_all(seen, states, {"one": F.col("x") == 1, "least": F.col("x") < 0}).collect()}
    assert got == {"one": (True, False), "least": (False, False)}
    assert [(r.any_state, r.all_states) for r in G.any_all(seen.limit(0), states, {"one": F.col("x") == 1}).collect()] == [(False, True)]


def test_results_are_reused_only_for_the_same_inputs(spark, tmp_path, monkeypatch):
    from tests.test_fit import frames, made

    rows, targets = frames(spark, *made(1))
    rows, targets = rows.withColumn("subject", F.lit("s")), targets.withColumn("subject", F.lit("s"))
    args = (str(tmp_path / "out"), ["s"], ["a", "b"], ["play"], "row", "part")
    search = X.Search(n_iter=2, alphas=(1.0, 100.0))
    first = {tuple(r) for r in X.fit_subjects(rows, targets, *args, search).drop("weights", "r_bands").collect()}
    monkeypatch.setattr(X, "banded_fit", None)  # nothing is fitted again
    assert {tuple(r) for r in X.fit_subjects(rows.repartition(7), targets, *args, search).drop("weights", "r_bands").collect()} == first
    for other in ((rows, targets.withColumn("y", F.col("y") + 1), *args, search), (rows, targets, *args, X.Search(n_iter=3))):
        with pytest.raises(IntegrityError, match="other inputs"):
            X.fit_subjects(*other)
    with pytest.raises(IntegrityError, match="no rows"):
        X.fit_subjects(rows, targets, str(tmp_path / "x"), ["s", "t"], *args[2:], search)
