"""Conversations: where rendered messages start, and generated ones met with what was measured."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks at the start of a message in the two forms of rendered conversations. In the
#: first form every message has one, in the second the system's, which comes first, has none.
ANY_ROLE = "<|im_start|>"
OF_ROLE = {"user": "<｜User｜>", "assistant": "<｜Assistant｜>"}

KINDS = ["any", *OF_ROLE]
MARKS = re.compile("|".join(f"({re.escape(m)})" for m in (ANY_ROLE, *OF_ROLE.values())))


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", "string").add("at", "long")))
def marks(text: pd.Series) -> pd.Series:
    """Kind and place (code points) of every mark of a text, found together in one pass."""
    return pd.Series([None if t is None else [{"kind": KINDS[m.lastindex - 1], "at": m.start()} for m in MARKS.finditer(t)] for t in text], dtype=object)


def marker_starts(rendered: DataFrame, key: list[str], text: str, roles: str) -> DataFrame:
    """key, starts (a place per message) and error: rendered conversations with the roles of their
    messages. An error, with starts null, are marks of both forms or of none, as many marks as there
    are no messages, and in the second form a first message that isn't the system's, another
    role than user and assistant after it, or marks in another order than the roles."""
    r = rendered.select(*key, F.coalesce(roles, F.expr("cast(array() as array<string>)")).alias("_r"), F.coalesce(marks(F.coalesce(text, F.lit(""))), F.array()).alias("_m"))
    r = r.withColumns({"_k": F.col("_m.kind"), "_at": F.col("_m.at")})
    any_, other = F.exists("_k", lambda k: k == "any"), F.exists("_k", lambda k: k != "any")
    rest = F.slice("_r", F.lit(2), F.greatest(F.size("_r") - 1, F.lit(0)))
    count = lambda arr, role: F.size(F.filter(arr, lambda x: x == role))
    numbers = [count("_k", role) != count("_r", role) for role in OF_ROLE]
    error = (
        F.when(any_ & other, "marks of both forms").when(~any_ & ~other, "no marks").when(any_ & (F.size("_k") != F.size("_r")), "another number of marks")
        .when(other & reduce(lambda a, b: a | b, numbers), "another number of marks").when(other & ~(F.get("_r", F.lit(0)).eqNullSafe(F.lit("system"))), "the first message is not the system's")
        .when(other & F.exists(rest, lambda x: ~x.isin(*OF_ROLE)), "a role without a mark").when(other & ((F.col("_k") != rest) | (F.get("_at", F.lit(0)) <= 0)), "marks in another order than the roles")
    )
    starts = F.when(any_, F.col("_at")).otherwise(F.concat(F.array(F.lit(0).cast("long")), F.col("_at")))
    return r.withColumn("error", error).select(*key, F.when(F.col("error").isNull(), starts).alias("starts"), "error")


def merged_steps(plays: DataFrame, frames: DataFrame, gen_plays: DataFrame, gen_frames: DataFrame, gen_steps: DataFrame, rec: list[str]) -> tuple[DataFrame, DataFrame]:
    """Generated steps with the measured frame each refers to, and (rec, error) of recordings whose
    generated side doesn't keep all that was measured; those have no merged steps.

    plays: ordinal, play, run, document, level, outcome, state_start, state_count; frames: pos, play,
    time, ts; of the generated side plays: ordinal, play, run, document, level, outcome; frames: pos,
    time, level, attempt; steps: i, action, play, frame, run, trial, level, attempt, ts, state_index.
    The inventory of plays and the frames must be the same in number and order; slices of plays
    cover the frames without gaps; an attempt counts a level's plays before; a step names a frame of
    its play, each once, in order, with its clock. Synthetic steps (action _...) are errors."""
    at = Window.partitionBy(*rec).orderBy("ordinal")
    same = ["play", "run", "document", "level", "outcome"]
    both = plays.join(gen_plays.select(*rec, "ordinal", *[F.col(c).alias(f"_{c}") for c in same], F.lit(True).alias("_gen")), [*rec, "ordinal"], "full")
    differs = F.col("_gen").isNull() | F.col("state_start").isNull()
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    own = plays.withColumns({
        "_want": F.coalesce(F.sum("state_count").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "trial": F.row_number().over(at) - 1,
        "attempt": F.row_number().over(Window.partitionBy(*rec, "level").orderBy("ordinal")) - 1, "_twice": F.count("*").over(Window.partitionBy(*rec, "play")) > 1,
    })
    bounds = ~(F.col("state_start").eqNullSafe(F.col("_want"))) | ~F.coalesce(F.col("state_count") >= 1, F.lit(False))
    covered = own.groupBy(*rec).agg(F.sum("state_count").alias("_sum")).join(frames.groupBy(*rec).agg(F.count("*").alias("_n"), F.max("pos").alias("_last")), rec, "full")
    slices = own.select(*rec, "play", "trial", "level", "attempt", "run", "document", "state_start", "state_count")
    f = frames.withColumnRenamed("play", "_fp").join(slices.select(*rec, F.col("play").alias("_fp"), "level", "attempt", "state_start", "state_count"), [*rec, "_fp"], "left")
    f = f.join(gen_frames.select(*rec, "pos", F.col("time").alias("_t"), F.col("level").alias("_l"), F.col("attempt").alias("_a"), F.lit(True).alias("_shown")), [*rec, "pos"], "full")
    finite = F.col("ts").isNotNull() & ~F.isnan("ts") & (F.abs("ts") != float("inf"))
    ok = F.col("_shown") & (F.col("time") == F.col("pos") - F.col("state_start")) & (F.col("time") < F.col("state_count")) & (F.col("_t") == F.col("time")) & (F.col("_l") == F.col("level")) & (F.col("_a") == F.col("attempt")) & finite
    s = gen_steps.join(slices.select(*rec, "play", *[F.col(c).alias(f"_{c}") for c in ("trial", "level", "attempt", "run", "state_start", "state_count")]), [*rec, "play"], "left")
    s = s.withColumns({"pos": F.col("_state_start") + F.col("frame"), "_twice": F.count("*").over(Window.partitionBy(*rec, "play", "frame")) > 1})
    s = s.withColumn("_before", F.max("pos").over(Window.partitionBy(*rec).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)))
    s = s.join(frames.select(*rec, "pos", F.col("ts").alias("_ts"), F.col("time").alias("measured_time")), [*rec, "pos"], "left")
    agree = F.col("state_index").eqNullSafe(F.col("pos")) & F.col("ts").eqNullSafe(F.col("_ts"))
    for c in ("trial", "level", "attempt", "run"):
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    bad = [
        (both.where(differs), "plays or their order changed"), (own.where(F.col("_twice")), "a play twice"), (own.where(bounds), "invalid bounds of a play"), (covered.where(~(F.col("_sum").eqNullSafe(F.col("_n")) & F.col("_last").eqNullSafe(F.col("_n") - 1))), "frames without a play"),
        (f.where(~F.coalesce(ok, F.lit(False))), "a frame differs"), (s.where(F.coalesce(F.col("action").startswith("_"), F.lit(True))), "a synthetic step"), (s.where("_state_start is null"), "an unknown play"),
        (s.where("_state_start is not null and (frame is null or frame < 0 or frame >= _state_count or _twice)"), "a frame out of range or twice"), (s.where("pos <= _before"), "steps reorder frames"), (s.where(F.col("_state_start").isNotNull() & ~agree), "a step's identity or clock disagrees"),
    ]
    errors = reduce(DataFrame.unionByName, [rows.select(*rec, F.lit(what).alias("error")).distinct() for rows, what in bad])
    good = s.join(errors.select(*rec).distinct(), rec, "left_anti")
    return good.select(*gen_steps.columns, "pos", "measured_time"), errors


def _all_above(pairs: DataFrame, key: list[str], most: int) -> DataFrame:
    """(key, a, b) of all paths along pairs of a type a and the type b it stands under. Paths double in
    length every round, so that rounds are as many as the logarithm of the depth; a circle raises."""
    from tarnlake.core.checks import IntegrityError
    from tarnlake.core.shared import materialize, release

    pairs = materialize(pairs.select(*key, "a", "b").distinct())
    size = pairs.count()
    for _ in range(most):
        if pairs.where("a = b").limit(1).count():
            raise IntegrityError("a type is its own ancestor")
        longer = pairs.select(*key, "a", F.col("b").alias("_m")).join(pairs.select(*key, F.col("a").alias("_m"), "b"), [*key, "_m"]).select(*key, "a", "b")
        grown = materialize(pairs.unionByName(longer).distinct())
        release(pairs)
        pairs, before, size = grown, size, grown.count()
        if size == before:
            return pairs
    raise IntegrityError(f"types are deeper than 2 ** {most}")


def ancestors(types: DataFrame, key: list[str], name: str, parent: str, most: int = 40) -> DataFrame:
    """(key, name, above): every type with itself and all types above it; a circle raises. Paths are
    followed among the types that others stand under; the others take those of their parents."""
    pairs = types.where(F.col(parent).isNotNull()).select(*key, F.col(name).alias("a"), F.col(parent).alias("b")).distinct()
    inner = pairs.join(pairs.select(*key, F.col("b").alias("a")).distinct(), [*key, "a"], "left_semi")
    far = pairs.select(*key, "a", F.col("b").alias("_m")).join(_all_above(inner, key, most).select(*key, F.col("a").alias("_m"), "b"), [*key, "_m"]).select(*key, "a", "b")
    own = types.select(*key, F.col(name).alias("name"), F.col(name).alias("above"))
    return own.unionByName(pairs.unionByName(far).select(*key, F.col("a").alias("name"), F.col("b").alias("above"))).distinct()


def known_interactions(types: DataFrame, effects: DataFrame, key: list[str]) -> DataFrame:
    """(key, actor, effect, actee) in colours: each effect between two types holds between the leaves
    below them. types: name, parent, leaf, colour (leaves without one have none); effects: actor,
    effect, actee. A type that is a leaf itself stands for itself alone; EOS is no type.

    Leaves under a parent count as their distinct colours from there on, so that no row is made of a
    leaf and a type far above it. Types are dealt by name before they are grouped, as grouping within
    the tasks that read them would hold all names that a task reads."""
    from tarnlake.core.shared import materialize

    leaf, name = F.coalesce("leaf", F.lit(False)), F.col("name")
    rows = types.select(*key, "name", "parent", leaf.alias("leaf"), F.when(leaf, F.upper("colour")).alias("colour")).repartition(*key, "name")
    each = materialize(rows.groupBy(*key, "name").agg(F.collect_set("parent").alias("parents"), F.collect_set("colour").alias("colours"), F.bool_or("leaf").alias("leaf")))
    pairs = each.select(*key, name.alias("a"), "leaf", F.explode("parents").alias("b"))
    parents = materialize(pairs.select(*key, F.col("b").alias("a")).distinct())
    above = _all_above(pairs.join(parents, [*key, "a"], "left_semi"), key, 40)
    near = each.where("leaf").select(*key, F.explode("parents").alias("above"), "colours").select(*key, "above", F.explode("colours").alias("_c")).distinct()
    far = near.select(*key, F.col("above").alias("a"), "_c").join(above, [*key, "a"]).select(*key, F.col("b").alias("above"), "_c")
    alone = each.where("leaf").join(parents.withColumnRenamed("a", "name"), [*key, "name"], "left_semi").select(*key, name.alias("above"))
    met = materialize(effects.where("actee <> 'EOS'").select(*key, "actor", "effect", "actee").distinct())
    named = met.select(*key, F.col("actor").alias("name")).unionByName(met.select(*key, F.col("actee").alias("name"))).distinct()
    own = each.where("leaf").join(named, [*key, "name"], "left_semi").select(*key, name.alias("above"), F.explode("colours").alias("_c"))
    under = materialize(near.unionByName(far).join(alone, [*key, "above"], "left_anti").unionByName(own).distinct())
    side = lambda c: under.select(*key, F.col("above").alias(c), F.col("_c").alias(f"_{c}"))
    half = met.join(side("actor"), [*key, "actor"]).select(*key, "_actor", "effect", "actee").distinct()
    return half.join(side("actee"), [*key, "actee"]).select(*key, F.col("_actor").alias("actor"), "effect", F.col("_actee").alias("actee")).distinct()


def avatar_classes(text: Column) -> Column:
    """The types whose line in a game's text, `type > class ...`, names a class of avatars."""

    def name(line: Column) -> Column:
        left, right = F.trim(F.split_part(line, F.lit(">"), F.lit(1))), F.trim(F.split_part(line, F.lit(">"), F.lit(2)))
        return F.when(left.rlike(r"^\w+$") & F.split(right, r"\s")[0].contains("Avatar"), left)

    return F.array_distinct(F.array_compact(F.transform(F.split(F.translate(text, "\t\r", "  "), "\n"), name)))


def died(events: Column, avatars: Column) -> Column:
    """Whether any of the events (arrays of words) kills a type of avatars."""
    return F.exists(events, lambda e: (F.size(e) >= 2) & (e[0] == "killSprite") & F.array_contains(avatars, e[1]))


#: Headings of a game's sections.
SECTIONS = ("SpriteSet", "InteractionSet", "TerminationSet", "LevelMapping")


def section_rows(games: DataFrame, key: list[str], lines: str) -> DataFrame:
    """key, section, place, content and parent (the place of the line it stands under within the section,
    null at its top) of the lines of a game's sections. games: key and lines, as of texts.outline()."""
    rows = games.select(*key, F.posexplode(lines).alias("place", "l")).select(*key, "place", "l.content", "l.parent")
    w = Window.partitionBy(*key).orderBy("place")
    head = F.when(F.col("content").isin(*SECTIONS), F.struct("content", "place"))
    rows = rows.withColumn("_h", F.last(head, ignorenulls=True).over(w)).where("_h is not null and _h.place < place")
    return rows.select(*key, F.col("_h.content").alias("section"), "place", "content", F.when(F.col("parent") > F.col("_h.place"), F.col("parent")).alias("parent"))


def _settings(text: Column) -> Column:
    """The words name=value of a line as a map; of a name that comes again the last holds."""
    words = F.filter(F.split(text, r"\s+"), lambda x: x.contains("="))
    pairs = F.transform(words, lambda x: F.named_struct(F.lit("key"), F.substring_index(x, "=", 1), F.lit("value"), F.substring(x, F.instr(x, "=") + 1, F.length(x))))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def game_types(sections: DataFrame, key: list[str]) -> DataFrame:
    """key, name, parent, leaf, class and colour of a game's types: a line `name > Class img=.../COLOUR`
    stands under its parent. A leaf has no line under it; its class and image are its own or those of
    the nearest type above that has them."""
    s = sections.where("section = 'SpriteSet'")
    left, right = F.trim(F.split_part("content", F.lit(">"), F.lit(1))), F.trim(F.split_part("content", F.lit(">"), F.lit(2)))
    image = F.element_at(_settings(right), "img")
    own = s.select(*key, "place", "parent", F.element_at(F.split(left, r"\s+"), -1).alias("name"), F.get(F.filter(F.split(right, r"\s+"), lambda x: (x != "") & ~x.contains("=")), F.lit(0)).alias("class"), F.when(F.contains(image, F.lit("/")), F.split_part(image, F.lit("/"), F.lit(2))).alias("colour"))
    above = own.select(*key, F.col("place").alias("parent"), F.col("name").alias("parent_name"))
    t = own.join(above, [*key, "parent"], "left")
    inner = own.where("parent is not null").select(*key, F.col("parent").alias("place"), F.lit(True).alias("_inner")).distinct()
    t = t.join(inner, [*key, "place"], "left").withColumn("leaf", F.col("_inner").isNull())
    up = ancestors(t.select(*key, "name", F.col("parent_name").alias("parent")), key, "name", "parent")
    has = own.select(*key, F.col("name").alias("above"), "place", "class", "colour")
    nearest = up.join(has, [*key, "above"]).groupBy(*key, "name").agg(F.max_by("class", F.when(F.col("class").isNotNull(), F.col("place"))).alias("class"), F.max_by("colour", F.when(F.col("colour").isNotNull(), F.col("place"))).alias("colour"))
    return t.select(*key, "name", F.col("parent_name").alias("parent"), "leaf").join(nearest, [*key, "name"])


def game_effects(sections: DataFrame, key: list[str]) -> DataFrame:
    """key, actor, effect, actee and settings of a game's lines `actor actee ... > effect name=value ...`; a
    line with several actees is one of each."""
    s = sections.where("section = 'InteractionSet' and content like '%>%'")
    left, right = F.split(F.trim(F.split_part("content", F.lit(">"), F.lit(1))), r"\s+"), F.trim(F.split_part("content", F.lit(">"), F.lit(2)))
    effect = F.get(F.filter(F.split(right, r"\s+"), lambda x: (x != "") & ~x.contains("=")), F.lit(0))
    others = F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0)))
    return s.select(*key, F.get(left, F.lit(0)).alias("actor"), effect.alias("effect"), F.explode(others).alias("actee"), _settings(right).alias("settings")).where("effect is not null")


def action_indices(actions: Column, index: dict[str, int]) -> Column:
    """The numbers of the names of recorded actions, whatever their case; of others 0."""
    known = F.create_map(*[x for k, v in index.items() for x in (F.lit(k.lower()), F.lit(v))])
    return F.transform(F.coalesce(actions, F.array().cast("array<string>")), lambda a: F.coalesce(F.element_at(known, F.lower(a)), F.lit(0)))


def first_found(files: DataFrame, path: str, text: str, root: str, names: list[str], folders: list[str]) -> DataFrame:
    """name and text of each prompt: ROOT/FOLDER/NAME.txt in the first folder that has it ('' is ROOT itself).
    A name in none of them raises. files: paths and texts, as of a whole-text read."""
    want = files.sparkSession.createDataFrame([(n, k, "/".join(p for p in (root.rstrip("/"), f, f"{n}.txt") if p)) for n in names for k, f in enumerate(folders)], "name string, place int, _path string")
    found = want.join(files.select(F.col(path).alias("_path"), F.col(text).alias("text")), "_path").groupBy("name").agg(F.min_by("text", "place").alias("text"))
    from tarnlake.core import checks

    checks.require_empty(want.select("name").distinct().join(found, "name", "left_anti"), "prompts in any of the folders")
    return found
