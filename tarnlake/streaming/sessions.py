"""Streaming twins: windowed counts with late data, and a stateful run loop per agent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


OUT = "user_id long, level int, attempts int, reason string"
STATE = "level int, tries int, w int, l int, attempts int, reason string"


def run_loop(attempts: DataFrame, wins: int, losses: int, budget: int, start: DataFrame | None = None) -> DataFrame:
    """advancement() over a stream: attempts (user_id, ts, event_id, outcome) update each agent's
    level, attempts and stop reason. An agent's state is six values; rows of a batch are applied in
    order of ts. start (user_id and the counters of state.counters()) is where agents that were
    stopped go on from: it meets their rows as a static table and is used by the first of them."""
    names = [c.split()[0] for c in STATE.split(", ")]
    resumed = start is not None
    if resumed:
        kept = start.select("user_id", *[F.col(n).alias(f"_{n}") for n in names])
        attempts = attempts.join(kept, "user_id", "left")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        level, tries, w, l, n, reason = 0, 0, 0, 0, 0, ""
        if state.exists:
            level, tries, w, l, n, reason = state.get
        elif resumed and not pd.isna(rows["_level"].iloc[0]):
            level, tries, w, l, n = (int(rows[f"_{c}"].iloc[0]) for c in names[:5])
            reason = rows["_reason"].iloc[0]
        for outcome in rows["outcome"]:
            if reason:
                break
            w, l = (w + 1 if outcome == "win" else 0), (l + 1 if outcome == "loss" else 0)
            tries, n = tries + 1, n + 1
            if w >= wins:
                level, tries, w, l = level + 1, 0, 0, 0
            elif l >= losses:
                reason = "losses"
            elif tries >= budget:
                reason = "budget"
        state.update((level, tries, w, l, n, reason))
        yield pd.DataFrame({"user_id": [key[0]], "level": [level], "attempts": [n], "reason": [reason]})

    return attempts.groupBy("user_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
