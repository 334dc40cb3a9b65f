"""Replays: delta codec, numbering, token windows, turns and responses."""

from __future__ import annotations

import bisect
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_encode(frames: DataFrame, play: list[str], order: str, key: str, value: str) -> DataFrame:
    """Long state (play, order, key, value) to its changes: value and present; present is false
    where a key of the frame before is gone. `order` counts a play's frames from 0 without gaps."""
    cur = frames.select(*play, order, key, value)
    prev = cur.select(*play, (F.col(order) + 1).alias(order), key, F.col(value).alias("_v"), F.lit(True).alias("_had"))
    both = cur.withColumn("_has", F.lit(True)).join(prev, [*play, order, key], "full")
    end = frames.groupBy(*play).agg(F.max(order).alias("_end"))
    both = both.join(end, play).where(F.col(order) <= F.col("_end"))
    has, had = F.coalesce("_has", F.lit(False)), F.coalesce("_had", F.lit(False))
    changed = both.where((has & ~had) | (has & had & ~F.col(value).eqNullSafe(F.col("_v"))) | (~has & had))
    return changed.select(*play, order, key, F.when(has, F.col(value)).alias(value), has.alias("present"))


def delta_expand(deltas: DataFrame, frames: DataFrame, play: list[str], order: str, key: str, value: str) -> DataFrame:
    """The long state again: each change holds until the next of its key; frames lists all frames."""
    w = Window.partitionBy(*play, key).orderBy(order)
    end = frames.groupBy(*play).agg(F.max(order).alias("_end"))
    d = deltas.withColumn("_next", F.lead(order).over(w)).join(end, play).where("present")
    return d.select(*play, F.explode(F.sequence(F.col(order), F.coalesce(F.col("_next") - 1, F.col("_end")))).alias(order), key, value)


def numbered_objects(seen: DataFrame, play: list[str], kind: str, uid: str, order: list[str]) -> DataFrame:
    """name: kind.N by the order in which the objects of a kind first appear in a play."""
    first = seen.groupBy(*play, kind, uid).agg(F.min(F.struct(*order)).alias("_f"))
    n = F.row_number().over(Window.partitionBy(*play, kind).orderBy("_f", uid))
    return first.select(*play, kind, uid, F.concat_ws(".", kind, n.cast("string")).alias("name"))


def within_budget(turns: DataFrame, conv: str, turn: str, tokens: Column, budget: int, least: int = 20) -> DataFrame:
    """Each conversation cut to the budget. All messages count, the first (the system's) too, which
    stays. The oldest of the others go until the rest fits, while `least` of them are left; an odd
    number of dropped ones is rounded up, so that pairs stay whole."""
    w = Window.partitionBy(conv)
    run = w.orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    t = turns.withColumn("_t", tokens.cast("long"))
    t = t.withColumn("_i", F.row_number().over(w.orderBy(turn)) - 1).withColumn("_n", F.count("*").over(w) - 1).withColumn("_all", F.sum("_t").over(w))
    t = t.withColumn("_old", F.sum(F.when(F.col("_i") > 0, F.col("_t")).otherwise(0)).over(run))
    over = (F.col("_i") > 0) & (F.col("_i") <= F.col("_n") - least) & (F.col("_all") - F.col("_old") + F.col("_t") > budget)
    t = t.withColumn("_drop", F.count_if(over).over(w))
    return t.where((F.col("_i") == 0) | (F.col("_i") > F.col("_drop") + F.col("_drop") % 2)).select(*turns.columns)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def token_windows(total: pd.Series, starts: pd.Series, window: pd.Series, stride: pd.Series) -> pd.Series:
    """Windows [start, end) over a session of `total` tokens. The next start is the last message
    start at or before start + stride; if that isn't after start, the next message start; if there
    is none either, the next token. A stride below 1 raises; no tokens have no windows."""

    def one(n: int, at: list[int], size: int, step: int) -> list[list[int]]:
        if step < 1:
            raise ValueError(f"stride must be positive: {step}")
        out, start = [], 0
        while n > 0:
            out.append([start, min(start + size, n)])
            if out[-1][1] >= n:
                break
            last = bisect.bisect_right(at, start + step)
            first = bisect.bisect_right(at, start)
            if last > first:
                start = at[last - 1]
            else:
                start = at[first] if first < len(at) else min(start + 1, n - 1)
        return out

    return pd.Series([one(int(n), sorted(int(x) for x in a), int(s), int(t)) for n, a, s, t in zip(total, starts, window, stride, strict=True)])


def assign_targets(targets: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Each target with the first window that holds it in its second half (or that starts at 0),
    else the latest that holds it; targets in no window go. windows: start, end, w; targets: pos."""
    both = targets.join(windows, key).where("pos >= start and pos < end")
    good = (F.col("start") == 0) | (F.col("pos") >= F.col("start") + F.expr("(end - start) div 2"))
    rank = F.row_number().over(Window.partitionBy(*key, "pos").orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col("w")).otherwise(-F.col("w"))))
    return both.withColumn("_r", rank).where("_r = 1").select(*key, "pos", "w")


def json_in(text: str | None) -> str | None:
    """The first JSON object in noisy text: the first balanced braces that parse, else a fenced
    block, else what lies between the first and last brace; null if none parses."""
    if not text:
        return None

    def parsed(s: str) -> str | None:
        try:
            v = json.loads(s)
        except ValueError:
            return None
        return json.dumps({str(k): x if isinstance(x, str) else json.dumps(x) for k, x in v.items()}) if isinstance(v, dict) else None

    at = text.find("{")
    if at < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                got = parsed(text[at : i + 1])
                if got:
                    return got
                break
    fenced = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text, re.S)
    return (fenced and parsed(fenced.group(1))) or parsed(text[at : text.rfind("}") + 1])


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    return pd.Series([json_in(t) for t in text], dtype=object)


def parsed_action(text: Column, allowed: list[str]) -> Column:
    """The response's action in lower case if it is an allowed one, else null."""
    fields = F.from_json(json_object(text), "map<string,string>")
    action = F.lower(F.trim(F.element_at(fields, "action")))
    return F.when(action.isin(allowed), action)
