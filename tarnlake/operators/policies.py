"""Advancement policies of runs: when a level is left, and when the run ends."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FixedBudget:
    """Frames at each level; the level is left when they are used up."""

    level_frame_budget: int = 1200

    def __post_init__(self):
        if self.level_frame_budget <= 0:
            raise ValueError(f"level_frame_budget must be above 0: {self.level_frame_budget}")


@dataclass(frozen=True)
class BlockedCurricula:
    """Frames for the whole run; a level is left after so many wins in a row at it, and the run ends after
    so many deaths without a win between (0: never)."""

    total_frame_budget: int = 2700
    consecutive_wins_required: int = 2
    max_consecutive_losses: int = 0

    def __post_init__(self):
        if self.total_frame_budget <= 0 or self.consecutive_wins_required < 1 or self.max_consecutive_losses < 0:
            raise ValueError(f"impossible policy: {self}")


POLICIES = {"fixed_budget": FixedBudget, "blocked_curricula": BlockedCurricula}


def policy(settings: dict) -> FixedBudget | BlockedCurricula:
    """The policy that a mapping with `strategy` names; other strategies and keys raise."""
    kind = POLICIES.get(settings.get("strategy")) if isinstance(settings, dict) else None
    if kind is None:
        raise ValueError(f"no such strategy: {settings!r}")
    own = {k: v for k, v in settings.items() if k != "strategy"}
    extra = set(own) - {f.name for f in fields(kind)}
    if extra:
        raise ValueError(f"settings of another strategy: {sorted(extra)}")
    return kind(**own)


START = "level int, attempt int, level_frames long, total_frames long, win_streak int, loss_streak int, wins int, losses int, attempts int, reason string"


def run(attempts: Column, rule: FixedBudget | BlockedCurricula, levels: int) -> Column:
    """The state of a run after its attempts (array of struct<frames, won, died>), see START: attempts beyond
    its end aren't made. reason: completed (all levels are left), budget, losses, or '' where more could
    follow. A win resets the losses in a row, a death the wins in a row; one that is neither, none."""
    names = [c.split() for c in START.split(", ")]
    zero = F.struct(*[F.lit("" if k == "string" else 0).cast("bigint" if k == "long" else k).alias(n) for n, k in names])
    fixed = isinstance(rule, FixedBudget)

    def step(a: Column, x: Column) -> Column:
        won, died = F.coalesce(x["won"], F.lit(False)), F.coalesce(x["died"], F.lit(False))
        frames = x["frames"].cast("bigint")
        level_frames, total = a["level_frames"] + frames, a["total_frames"] + frames
        wins_in_row = F.when(died, 0).when(won, a["win_streak"] + 1).otherwise(a["win_streak"])
        losses_in_row = F.when(died, F.when(won, 1).otherwise(a["loss_streak"] + 1)).when(won, 0).otherwise(a["loss_streak"])
        if fixed:
            spent = level_frames >= rule.level_frame_budget
            up, stop = spent, F.lit("")
        else:
            spent = total >= rule.total_frame_budget
            lost = (losses_in_row >= rule.max_consecutive_losses) if rule.max_consecutive_losses else F.lit(False)
            up = ~lost & won & (wins_in_row >= rule.consecutive_wins_required)
            stop = F.when(lost, "losses").when(spent & ~up, "budget").otherwise("")
        level = a["level"] + up.cast("int")
        done = F.when(stop != "", stop).when(level >= levels, "completed")
        done = done.otherwise("") if fixed else done.when(total >= rule.total_frame_budget, "budget").otherwise("")
        return F.when(a["reason"] != "", a).otherwise(F.struct(
            level.alias("level"), F.when(up, 0).when((won | died) & (stop == ""), a["attempt"] + 1).otherwise(a["attempt"]).alias("attempt"), F.when(up, 0).otherwise(level_frames).cast("bigint").alias("level_frames"), total.alias("total_frames"),
            F.when(up, 0).otherwise(wins_in_row).alias("win_streak"), losses_in_row.alias("loss_streak"), (a["wins"] + won.cast("int")).alias("wins"), (a["losses"] + died.cast("int")).alias("losses"), (a["attempts"] + 1).alias("attempts"), done.alias("reason"),
        ))

    return F.aggregate(attempts, zero, step)
