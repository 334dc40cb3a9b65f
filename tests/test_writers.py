import random

import pytest
from pyspark.sql import functions as F

from tarnlake.operators import episodes as E
from tarnlake.operators import state as T
from tarnlake.plans.bindings import plays
from tarnlake.streaming import sessions as S
from tarnlake.streaming import writers as W

SF = "/root/testdata/sf0.001"
SCHEMA = "play string, step long, vector array<double>, ended boolean"


def arrivals(seed=0):
    """Steps of twelve plays in five batches, each play's in order; the last play never ends."""
    rng = random.Random(seed)
    batches, want = [[] for _ in range(5)], {}
    for p in range(12):
        n = rng.randrange(0, 23)
        cuts = sorted(rng.choices(range(5), k=n))
        want[f"p{p}"] = [[float(p), float(i)] for i in range(n)]
        for i, b in enumerate(cuts):
            batches[b].append((f"p{p}", i, [float(p), float(i)], False))
        if p < 11:
            batches[rng.randrange(cuts[-1] if cuts else 0, 5)].append((f"p{p}", n, None, True))
    return [rng.sample(b, len(b)) for b in batches], want


@pytest.mark.parametrize("fail_at", [None, 0, 2, 4])
def test_a_killed_stream_loses_and_repeats_nothing(spark, tmp_path, fail_at):
    batches, want = arrivals(fail_at or 7)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    killed = []

    def after(number):
        if number == fail_at and not killed:
            killed.append(number)
            raise RuntimeError("killed")

    q = W.write_plays(stream, f"{tmp_path}/out", f"{tmp_path}/state", 4, after)
    if fail_at is not None:
        with pytest.raises(Exception, match="killed"):
            q.awaitTermination()
        q = W.write_plays(stream, f"{tmp_path}/out", f"{tmp_path}/state", 4, after)
    q.awaitTermination()
    assert q.exception() is None and len(killed) == (fail_at is not None)
    got = {}
    for r in W.published(spark, f"{tmp_path}/out").orderBy("play", "step").collect():
        got.setdefault(r.play, []).append((r.step, r.vector))
    ended = {p for b in batches for p, _, _, e in b if e}
    assert {p: [v for _, v in s] for p, s in got.items()} == {p: v for p, v in want.items() if p in ended and v}
    assert all([i for i, _ in s] == list(range(len(s))) for s in got.values())
    chunks = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    assert all(len(c.steps) == 4 for c in chunks if not c.ended) and all(len(c.steps) < 4 for c in chunks if c.ended)


def drain(df, name):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.user_id: (r.level, r.attempts, r.reason) for r in df.sparkSession.sql(f"select user_id, max_by(struct(level, attempts, reason), attempts) as s from {name} group by 1").select("user_id", "s.*").collect()}


def test_stopped_and_resumed_is_one_run(spark, tmp_path):
    p = plays(spark, SF).select("user_id", "ts", "event_id", "outcome")
    cut = p.agg(F.percentile("event_id", 0.4)).first()[0]
    early, late = p.where(F.col("event_id") <= cut), p.where(F.col("event_id") > cut)
    rows = lambda df: E.episode_rows(df.join(plays(spark, SF).drop("outcome", "ts", "user_id"), "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "episode_outcomes")
    one = {r.user_id: (r.s.level, r.s.attempts, r.s.reason) for r in rows(p).select("user_id", T.counters(F.col("episode_outcomes"), 2, 3, 12).alias("s")).collect()}
    first = rows(early).select("user_id", T.counters(F.col("episode_outcomes"), 2, 3, 12).alias("s"))
    both = first.join(rows(late), "user_id", "full").select("user_id", T.counters(F.coalesce("episode_outcomes", F.expr("cast(array() as array<string>)")), 2, 3, 12, F.col("s")).alias("s"))
    assert {r.user_id: (r.s.level, r.s.attempts, r.s.reason) for r in both.collect()} == one
    late.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(late.schema).parquet(f"{tmp_path}/in")
    got = drain(S.run_loop(stream, 2, 3, 12, first.select("user_id", "s.*")), "resumed")
    assert got and all(one[u] == s for u, s in got.items())


def test_restored_counters_and_other_runs(spark):
    rows = [(1, 0, "UP", 0, True, False, False, 1, 5, None), (1, 1, "_level_advance", 0, False, False, False, 0, None, None), (1, 2, "UP", 1, False, True, False, 2, 7, 0.5), (1, 3, "", 1, False, False, False, 0, 1, None), (1, 4, "DOWN", 1, True, False, True, 0, 1, 0.25), (2, 0, "UP", 3, None, None, None, None, None, None)]
    steps = spark.createDataFrame(rows, "run int, step int, action string, level int, won boolean, lose boolean, crashed boolean, retries int, tokens long, cost double")
    got = {r.run: r for r in T.restored(steps, ["run"], ["step"], ["tokens", "cost"], 2).collect()}
    r = got[1]
    assert (r.resume_level, r.step_num, r.total_frames, r.tokens, r.cost, r.retries, r.wins, r.losses, r.success, r.prev_outcome) == (1, 3, 9, 14, 0.75, 3, 1, 1, 0, "died")
    assert (got[2].resume_level, got[2].step_num, got[2].tokens, got[2].prev_outcome) == (0, 1, 0, "")
    history = spark.createDataFrame([(1, "bait", "full"), (2, "sky", "full")], "run int, game string, mode string")
    wanted = spark.createDataFrame([(1, "bait", "full"), (2, "sky", "none"), (3, "sky", "full")], "run int, game string, mode string")
    assert sorted(x.run for x in T.other_runs(history, wanted, ["run"], ["game", "mode"]).collect()) == [2, 3]
