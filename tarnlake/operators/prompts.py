"""Prompts and frames as rows: messages of a session, templates with colours, measured fields, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.core import checks


def user_message(step: Column, level: Column, attempt: Column, observation: Column, before: Column | None = None) -> Column:
    """What a step asks: what happened between trials, if anything, the step's heading and what is seen."""
    head = F.format_string("# Step %d (Level %d, Attempt %d)", step.cast("long"), level.cast("long"), attempt.cast("long"))
    parts = [head, F.lit(""), observation]
    return F.concat_ws("\n", *([before] if before is not None else []), *parts)


def message_rows(steps: DataFrame, sessions: DataFrame, key: list[str], order: str, mode: str) -> DataFrame:
    """key, place, role, content and upto: a row per message instead of a conversation per step; that of
    step s has the messages with upto <= s. sessions: key, system; steps: key, order, action,
    level, attempt, observation, between (null: nothing), response (map). Synthetic steps (action _...)
    have no messages. In the mode action-only an answer is the action alone, else the whole response."""
    if mode not in ("action-only", "prompted-rationale", "copied-reasoning"):
        raise ValueError(f"no such mode: {mode}")
    real = steps.where(~F.col("action").startswith("_")).withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    answer = F.to_json(F.create_map(F.lit("action"), F.element_at("response", "action"))) if mode == "action-only" else F.to_json("response")
    ask = user_message(F.col(order), F.col("level"), F.col("attempt"), F.col("observation"), F.col("between"))
    one = lambda k, role, content: F.struct((2 * F.col("_i") - 1 + k).alias("place"), F.lit(role).alias("role"), content.alias("content"))
    turns = real.select(*key, F.explode(F.array(one(0, "user", ask), one(1, "assistant", answer))).alias("m"), F.col(order).alias("upto")).select(*key, "m.*", F.col("upto").cast("long").alias("upto"))
    system = sessions.select(*key, F.lit(0).alias("place"), F.lit("system").alias("role"), F.col("system").alias("content"), F.lit(-1).cast("long").alias("upto"))
    return system.unionByName(turns)


def with_system(messages: DataFrame, role: str, content: str, system: Column) -> DataFrame:
    """messages whose system's text is another one."""
    return messages.withColumn(content, F.when(F.col(role) == "system", system).otherwise(F.col(content)))


def filled_template(template: Column, values: Column) -> Column:
    """The template with each {name} that is a key of the map replaced by its value in capitals. Names are
    taken from the template as it is written: what a value brings in is no name."""
    pieces = F.split(template, r"(?=\{)")

    def one(p: Column) -> Column:
        name = F.regexp_extract(p, r"^\{([^{}]*)\}", 1)
        value = F.element_at(values, name)
        return F.when((name != "") & value.isNotNull(), F.concat(F.upper(value), F.substring(p, F.length(name) + 3, F.length(p)))).otherwise(p)

    return F.array_join(F.transform(pieces, one), "")


def recoloured(text: Column, colours: Column) -> Column:
    """A game's text whose lines `type > ...` of a type in the map have the map's colour for theirs."""

    def one(line: Column) -> Column:
        words = F.split(F.trim(F.split_part(line, F.lit(">"), F.lit(1))), r"\s+")
        colour = F.element_at(colours, F.element_at(words, -1))
        image = F.regexp_replace(line, F.lit(r"img=colors/\w+"), F.concat(F.lit("img=colors/"), colour))
        return F.when(F.contains(line, F.lit(">")) & colour.isNotNull(), F.regexp_replace(image, F.lit(r"\bcolor=\w+"), F.concat(F.lit("color="), colour))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def flat_effects(effects: Column) -> Column:
    """Effects as a list of lists of words from JSON in any of the forms it is stored in: one effect, a
    list of effects, or such lists within one more. Empty lists are left out; null is no effect."""
    words = F.from_json(effects, "array<string>")
    items = F.from_json(effects, "array<string>")  # each as text
    first = F.get(items, F.lit(0))
    inner = lambda x: F.from_json(x, "array<string>")
    kept = lambda x: F.when(~x.startswith("["), F.array().cast("array<array<string>>")).when(F.get(inner(x), F.lit(0)).startswith("["), F.from_json(x, "array<array<string>>")).when(F.size(inner(x)) > 0, F.array(inner(x))).otherwise(F.array().cast("array<array<string>>"))
    many = F.flatten(F.transform(items, kept))
    return F.when(items.isNull() | (F.size(items) == 0), F.array().cast("array<array<string>>")).when(~first.startswith("["), F.array(words)).otherwise(many)


def pixel(value: Column, block: Column, close: float = 1e-7) -> Column:
    """The whole pixel of a drawing coordinate in cells; one that is none within `close` fails the job."""
    scaled = value.cast("double") * block
    whole = F.rint(scaled)
    ok = value.isNotNull() & ~F.isnan(scaled) & (F.abs(scaled) != float("inf")) & (F.abs(scaled - whole) <= close) & (block > 0)
    return F.when(F.coalesce(ok, F.lit(False)), whole.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no whole pixel: "), F.coalesce(value.cast("string"), F.lit("null")))))


def measured_sprites(sprites: DataFrame, frame: list[str]) -> DataFrame:
    """frame, kind, source_key and what was measured of each sprite: its id, x, y, colour and the pixels of
    its rectangle. sprites: frame, kind, source_key, uid, x, y, col, row, block. A key of a kind that comes
    twice in a frame raises, as does a place that is no whole pixel."""
    checks.require_empty(checks.duplicate_keys(sprites, [*frame, "kind", "source_key"]), "a sprite's key once")
    at = [pixel(F.col(c), F.col("block")).alias(n) for c, n in (("col", "left"), ("row", "top"))]
    return sprites.select(*frame, "kind", "source_key", "uid", "x", "y", "colour", *at, F.col("block").alias("size"))


def viewer_sprites(sprites: DataFrame, frame: list[str], order: list[str]) -> DataFrame:
    """Sprites for a viewer: id (their number within the kind), col and row in cells, which may be
    fractions, and resources without those of 0. A sprite without a rectangle is at its x and y."""
    number = F.row_number().over(Window.partitionBy(*frame, "kind").orderBy(*order)) - 1
    cell = lambda a, b: (F.coalesce(a, b).cast("double") / F.col("block"))
    held = F.map_filter("resources", lambda k, v: v != 0)
    return sprites.select(*frame, "kind", number.alias("id"), cell("left", "x").alias("col"), cell("top", "y").alias("row"), held.alias("resources"), "uid")


def labelled(refs: DataFrame, objects: DataFrame, key: list[str], name: str, obj_id: str) -> DataFrame:
    """refs with label: name/COLOUR of the object of that id in the frame, the name alone without one."""
    colours = objects.select(*key, obj_id, "colour").groupBy(*key, obj_id).agg(F.max("colour").alias("_c"))
    return refs.join(colours, [*key, obj_id], "left").withColumn("label", F.concat_ws("/", name, "_c")).drop("_c")


def block_size(sprites: DataFrame, key: list[str], size: str, order: list[str]) -> DataFrame:
    """The first size of a sprite that has one; a key without any raises."""
    found = sprites.groupBy(*key).agg(F.min_by(size, F.when(F.col(size).isNotNull(), F.struct(*order))).alias("block"))
    checks.require_empty(found.where("block is null"), "a size of cells")
    return found


#: Conditions that a recording's name may have.
CONDITIONS = ("minimal", "elaborate", "oracle")


def recording_path(subject: Column, game: Column, condition: Column) -> Column:
    """sub-NN/GAME/CONDITION.human.replay.json.gz; another condition fails the job."""
    known = condition.isin(*CONDITIONS)
    return F.when(known, F.concat(F.format_string("sub-%02d/", subject.cast("int")), game, F.lit("/"), condition, F.lit(".human.replay.json.gz"))).otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), F.coalesce(condition, F.lit("null")))))


def foreign_paths(plays: DataFrame, path: str, subject: str, game: str) -> DataFrame:
    """Plays whose recording's path isn't that of their subject and game; must be empty."""
    want = F.concat(F.format_string("sub-%02d/", F.col(subject).cast("int")), F.col(game), F.lit("/"))
    ok = F.col(path).startswith(want) & F.substring(F.col(path), F.length(want) + 1, F.length(path)).isin(*[f"{c}.human.replay.json.gz" for c in CONDITIONS])
    return plays.where(~F.coalesce(ok, F.lit(False)))


def mapped(source: DataFrame, mapping: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the mapping includes, with its columns, and (key, error) where the two don't cover each
    other: a source without a mapping, a mapping without a source, a key mapped twice, an action that is
    neither include nor exclude, no reason."""
    twice = checks.duplicate_keys(mapping, [key]).select(key, F.lit("mapped twice").alias("error"))
    m = mapping.dropDuplicates([key]).withColumn("_m", F.lit(True))
    both = source.withColumn("_s", F.lit(True)).join(m, key, "full")
    bad = ~F.coalesce(F.col("action").isin("include", "exclude"), F.lit(False))
    error = F.when(F.col("_m").isNull(), "no mapping").when(F.col("_s").isNull(), "no source").when(bad, "no action").when(F.coalesce(F.col("selection_reason"), F.lit("")) == "", "no reason")
    both = both.withColumn("error", error)
    return both.where("error is null and action = 'include'").drop("_m", "_s", "error"), both.where("error is not null").select(key, "error").unionByName(twice)


def catalogue_rows(index: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """The manifest's rows that the index names; a name that isn't there, or twice, raises."""
    wanted = index.select(path).distinct()
    rows = manifest.join(wanted, path, "left_semi")
    checks.require_empty(wanted.join(manifest, path, "left_anti"), "paths of the manifest")
    checks.require_empty(checks.duplicate_keys(rows, [path]), "a path once")
    return rows
