"""Scans of files written here."""

import gzip
import json

import pytest

from tarnlake.core.checks import IntegrityError
from tarnlake.sources import io
from tarnlake.sources import recordings as R

C = ("c3", "c4")


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = value if isinstance(value, str) else json.dumps(value)
    if path.suffix == ".gz":
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)


def got(df):
    return sorted((r.game, r.instance_id, r.level, r.episode_steps, r.episode_frames, r.episode_outcomes) for r in df.collect())


def test_csv_episodes(spark, tmp_path):
    head = "episode_index,resolved_level,episode_len,win\n"
    put(tmp_path / "bait_c3" / "episodes.csv", head + "2,0,4,1\n1,9,30,0\n0,0,12,0\n")
    df = R.csv_episodes(spark, str(tmp_path), C)
    assert got(df) == [("bait", "run0", 0, [12, 4], [None, None], ["loss", "win"])]
    put(tmp_path / "C3_bait" / "self_play_episodes.csv", head + "0,0,1,1\n")
    with pytest.raises(IntegrityError, match="a game once"):
        R.csv_episodes(spark, str(tmp_path), C)
    put(tmp_path / "x" / "sky_c3" / "episodes.csv", head + "0,0,1,1\n0,1,1,1\n")
    with pytest.raises(IntegrityError, match="an episode once"):
        R.csv_episodes(spark, str(tmp_path / "x"), C)
    put(tmp_path / "y" / "sky_c3" / "episodes.csv", head + "0,0,1,-1\n")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        R.csv_episodes(spark, str(tmp_path / "y"), C).collect()


def test_json_runs_and_trials(spark, tmp_path):
    runs = [{"run_id": "r1", "game_raw": "sky_c4", "seed": 7, "episodes": [{"level": 1, "steps": 9, "win": 0}, {"level": 10, "steps": 1, "win": 1}, {"level": 1, "steps": 3, "win": 1}]}]
    put(tmp_path / "runs.json", runs)
    df = R.json_runs(spark, str(tmp_path / "runs.json"), C)
    assert got(df) == [("sky", "r1", 1, [9, 3], [None, None], ["loss", "win"])] and df.first().seed == "7"
    put(tmp_path / "twice.json", runs * 2)
    with pytest.raises(IntegrityError, match="a run once"):
        R.json_runs(spark, str(tmp_path / "twice.json"), C)
    for name, steps in (("trial-01/level-02.json", 5), ("trial-02/lvl_1.json", 6)):
        put(tmp_path / "e" / "sky_c4" / name, {"episode_summaries": [{"steps": steps, "outcome": "win"}, {"steps": 1, "outcome": "timeout"}]})
    trials = R.trial_files(spark, str(tmp_path / "e"), C)
    assert got(trials) == [("sky", "trial-01", 2, [5, 1], [None, None], ["win", "timeout"]), ("sky", "trial-02", 0, [6, 1], [None, None], ["win", "timeout"])]
    assert R.all_episodes(df, trials).count() == 3
    with pytest.raises(ValueError, match="no episode rows"):
        R.all_episodes(df, trials.drop("seed"))


def step(i, at, level, attempt, action="UP", **more):
    return {"step": i, "state_index": at, "level": level, "attempt": attempt, "action": action, **more}


def replay(states, steps, meta=None, **more):
    base = {"model": "m", "seed": 1, "rationale_mode": "r", "suggestion_level": "s"}
    return {"source": "generative", "game": "bait_c3", "started_at": "t", "meta": {**base, **(meta or {})}, "states": [dict(zip(("level", "attempt", "time"), s, strict=True)) for s in states], "steps": steps, **more}


def test_replays(spark, tmp_path):
    put(tmp_path / "a.json.gz", replay([(0, 0, 0), (0, 0, 5), (0, 1, 0), (0, 1, 3)], [step(0, 1, 0, 0, won=True), step(None, 1, 0, 0, "_level_advance"), step(1, 3, 0, 1, lose=True)]))
    again = replay([(0, 0, 0), (0, 0, 5), (0, 0, 0), (0, 0, 2)], [step(0, 0, 0, 0), step(1, 1, 0, 0, lose=True), step(2, 3, 0, 0, won=True)], {"seed": 2, "resumed_from_steps": 2, "resumed_at_level": 0}, total_steps=3)
    put(tmp_path / "b.json.gz", again)
    r = R.replays(spark, str(tmp_path))
    assert R.broken_replays(r).count() == 0
    rows = R.replay_rows(r, C, ["bait"])
    assert sorted((x.episode_steps, x.episode_frames, x.episode_outcomes) for x in rows.collect()) == [([1, 1], [5, 3], ["win", "loss"]), ([2, 1], [5, 2], ["loss", "win"])]
    assert rows.select("instance_id").distinct().count() == 2 and R.all_episodes(rows).count() == 2 and R.replay_rows(r, C, ["sky"]).count() == 0


def test_broken_replays(spark, tmp_path):
    ok = [(0, 0, 0), (0, 0, 1)]
    bad = {
        "another source": replay(ok, [step(0, 0, 0, 0)]) | {"source": "human"}, "steps are not complete": replay(ok, [step(1, 0, 0, 0)]), "no frames": replay([], []),
        "a continuation without its history": replay(ok, [step(0, 0, 0, 0)], {"resumed_from_steps": 5}, total_steps=1), "a frame reference out of order or range": replay(ok, [step(0, 1, 0, 0), step(1, 0, 0, 0)]), "step and frame disagree": replay(ok, [step(0, 0, 0, 1)]),
    }
    for i, r in enumerate(bad.values()):
        put(tmp_path / f"{i}.json", r)
    put(tmp_path / "fine.json", replay(ok, []))
    got = {r.file: r.error for r in R.broken_replays(R.replays(spark, str(tmp_path))).collect()}
    assert got == {f"{i}.json": what for i, what in enumerate(bad)}


def test_plays_and_runs(spark, tmp_path):
    play = lambda i, run, doc, **s: {"_id": f"p{i}", "subj_id": 1, "run_id": run, "source_document_index": doc, "scanner": {"subj_id": 1, "run_id": run, "scan_start_ts": 10.0 * run, **s}}
    put(tmp_path / "a.json", {"plays": [play(1, 2, 0), play(2, 1, 1)]})
    put(tmp_path / "b.json", {"plays": [play(3, 1, 0)]})
    r = io.recordings(spark, str(tmp_path))
    assert [x._id for x in R.plays_in_order(r).orderBy("place").collect()] == ["p3", "p2", "p1"]
    assert [x._id for x in R.plays_in_order(r, 1, 2).collect()] == ["p1"]
    assert {(x.run_id, x.scan_start_ts) for x in R.scanner_runs(r).collect()} == {(1, 10.0), (2, 20.0)}
    put(tmp_path / "c" / "a.json", {"plays": [play(1, 2, 0), play(4, 2, 0)]})
    with pytest.raises(IntegrityError, match="ordinal"):
        R.plays_in_order(io.recordings(spark, str(tmp_path / "c")))
    put(tmp_path / "d" / "a.json", {"plays": [play(1, 2, 0), play(4, 2, 1, scan_start_ts=1.0)]})
    with pytest.raises(IntegrityError, match="one scanner record"):
        R.scanner_runs(io.recordings(spark, str(tmp_path / "d")))
    put(tmp_path / "e" / "a.json", {"plays": [play(1, 2, 0, run_id=9)]})
    with pytest.raises(IntegrityError, match="own run"):
        R.scanner_runs(io.recordings(spark, str(tmp_path / "e")))


def test_results_under_two_roots(spark, tmp_path):
    for root, value in (("a", 1), ("b", 1), ("c", 2)):
        put(tmp_path / root / "m1_layer3.json", json.dumps({"v": value}))
    read = lambda s, roots: s.read.json([f"{x}/*.json" for x in roots]).selectExpr("*", "_metadata.file_path as _path")
    args = (r"/(\w+)_layer(\d+)\.json$", ["model", "layer"], read)
    assert [tuple(r) for r in R.result_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], *args).collect()] == [(1, "m1", "3")]
    with pytest.raises(IntegrityError, match="equal copies"):
        R.result_files(spark, [str(tmp_path / "a"), str(tmp_path / "c")], *args)


def test_small_files_are_opened_once(spark, tmp_path):
    """What csv_episodes() and json_runs() return no longer reads the files."""
    at = tmp_path / "csv" / "sky_c3"
    at.mkdir(parents=True)
    (at / "episodes.csv").write_text("episode_index,resolved_level,episode_len,win\n0,1,5,1\n1,1,7,0\n")
    (tmp_path / "runs.json").write_text('[{"run_id": "r", "game_raw": "sky_c3", "seed": "1", "episodes": [{"level": 1, "steps": 3, "win": 1}]}]')
    one, two = R.csv_episodes(spark, str(tmp_path / "csv"), ("c3",)), R.json_runs(spark, str(tmp_path / "runs.json"), ("c3",))
    (at / "episodes.csv").unlink()
    (tmp_path / "runs.json").unlink()
    assert [list(r.episode_steps) for r in one.collect()] == [[5, 7]] and [list(r.episode_steps) for r in two.collect()] == [[3]]
