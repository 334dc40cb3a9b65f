"""Texts of observations, and records read from indented and sectioned texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a frame with more ranges of walls than this only says how many walls it has.
MOST_RANGES = 20


def wall_texts(walls: DataFrame, key: list[str]) -> DataFrame:
    """walls by key: the cells (x, y) as ranges. Columns of three cells or more come first, by x and
    y; then rows of two or more of what is left, by y and x; then single cells, by x and y."""
    island = lambda along, *across: F.col(along) - F.row_number().over(Window.partitionBy(*key, *across).orderBy(along))
    v = walls.select(*key, "x", "y").distinct().withColumn("_i", island("y", "x"))
    v = v.withColumn("_n", F.count("*").over(Window.partitionBy(*key, "x", "_i")))
    h = v.where("_n < 3").withColumn("_j", island("x", "y"))
    h = h.withColumn("_m", F.count("*").over(Window.partitionBy(*key, "y", "_j")))
    tall = v.where("_n >= 3").groupBy(*key, "x", "_i").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    wide = h.where("_m >= 2").groupBy(*key, "y", "_j").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    part = lambda n, first, second, form, *args: F.struct(F.lit(n).alias("n"), F.col(first).cast("long").alias("f"), F.col(second).cast("long").alias("s"), F.format_string(form, *args).alias("t")).alias("_p")
    parts = (
        tall.select(*key, part(0, "x", "a", "(%d, %d-%d)", "x", "a", "b")).unionByName(wide.select(*key, part(1, "y", "a", "(%d-%d, %d)", "a", "b", "y"))).unionByName(h.where("_m < 2").select(*key, part(2, "x", "y", "(%d, %d)", "x", "y")))
    )
    ranges = parts.groupBy(*key).agg(F.array_sort(F.collect_list("_p"))["t"].alias("_r")).join(walls.groupBy(*key).agg(F.count("*").alias("_w")), key)
    many = F.concat(F.col("_w").cast("string"), F.lit(" wall positions (borders)"))
    return ranges.select(*key, F.when(F.size("_r") > MOST_RANGES, many).otherwise(F.array_join("_r", ", ")).alias("walls"))


def observation_texts(frames: DataFrame, objects: DataFrame, key: list[str]) -> DataFrame:
    """text of each frame: grid, inventory, score, objects and walls. frames: columns, rows, score,
    reward, inventory (array of label and n; those of 0 don't show). objects: name, obj_id, colour, x, y;
    walls are named wall, floor and background don't show, an object without a colour goes by its name."""
    seen = objects.where(~F.col("name").isin("wall", "floor", "background"))
    line = F.format_string("- %s at (%d,%d)", F.coalesce("colour", F.upper("name")), F.col("x"), F.col("y"))
    lines = seen.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("obj_id", "x", "y", line.alias("t"))))["t"], "\n").alias("_o"))
    f = frames.join(lines, key, "left").join(wall_texts(objects.where("name = 'wall'"), key), key, "left")
    held = F.transform(F.filter("inventory", lambda r: r["n"] > 0), lambda r: F.concat(r["label"], F.lit(": "), r["n"].cast("string")))
    gain = F.when(F.col("reward") > 0, F.format_string(" (+%d)", F.col("reward").cast("long"))).when(F.col("reward") < 0, F.format_string(" (%d)", F.col("reward").cast("long"))).otherwise("")
    rows = [
        F.format_string("Grid: %dx%d", "columns", "rows"), F.when(F.size(held) > 0, F.concat(F.lit("Inventory: "), F.array_join(held, ", "))), F.concat(F.lit("Score: "), F.col("score").cast("string"), gain),
        F.lit("Objects:"), F.coalesce("_o", F.lit("- none")), F.concat(F.lit("Walls at: "), F.col("walls")),
    ]
    return f.select(*key, F.concat_ws("\n", *rows).alias("text"))


def outline(text: Column) -> Column:
    """Lines of an indented text as array of (line, indent, content, parent): # begins a comment,
    empty lines are none, a tab ends at the next multiple of 8, the parent is the last line before with
    less indent (its place in the array, from 0; null at the top)."""
    width = lambda white: F.aggregate(F.split(white, ""), F.lit(0), lambda n, c: F.when(c == "\t", n + 8 - n % 8).when(c == "", n).otherwise(n + 1))
    one = lambda raw, i: F.struct(i.alias("line"), width(F.regexp_extract(raw, r"^(\s*)", 1)).alias("indent"), F.regexp_replace(F.split_part(raw, F.lit("#"), F.lit(1)), r"^\s+|\s+$", "").alias("content"))
    lines = F.filter(F.transform(F.split(text, "\n"), one), lambda x: x["content"] != "")
    return F.element_at(F.transform(F.array(lines), _with_parents), 1)


def _with_parents(lines: Column) -> Column:
    """The lines with their parents: one pass with a stack of the lines that are still open, and each one's
    place and indent. An element of an array is bound once, so that lines aren't made again."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("parents"), F.expr("cast(array() as array<struct<i:int,w:int>>)").alias("open"))

    def step(a: Column, x: Column) -> Column:
        held = F.filter(a["open"], lambda o: o["w"] < x["indent"])
        place = F.struct(F.size(a["parents"]).alias("i"), x["indent"].alias("w"))
        return F.struct(F.concat(a["parents"], F.array(F.get(held, F.size(held) - 1)["i"])).alias("parents"), F.concat(held, F.array(place)).alias("open"))

    parents = F.when(lines.isNotNull(), F.aggregate(lines, start, step, lambda a: a["parents"]))
    return F.zip_with(lines, parents, lambda x, p: F.struct(x["line"].alias("line"), x["indent"].alias("indent"), x["content"].alias("content"), p.alias("parent")))


#: Headings of a theory's sections, and the forms of its lines.
SECTIONS = {"InteractionSet:": "interactions", "TerminationSet:": "terminations", "Class assignments:": "classes"}
INTERACTION = r"^(\w+)\s+(\w+)\s+(\w+)\s+(\{.*?\})\s+generic:\s*(True|False)"
CLASS = r"^(\w+):\s*\['(\w+)'\]:\s*<class '([^']+)'>"
#: Rules of termination with the names of their words and how many they need at least.
TERMINATIONS = {"NoveltyRule": 4, "SpriteCounterRule": 4, "MultiSpriteCounterRule": 5}


def theory_rows(theories: DataFrame, key: list[str], text: str) -> DataFrame:
    """(place, section, kind, args) of each line of a theory that has the form of its section; args
    are its words: agent, patient, params, generic; of terminations those of the rule, or the line if
    the rule isn't known; colour and type of a class. Lines before any heading are none."""
    lines = theories.select(*key, F.posexplode(F.split(text, "\n")).alias("place", "_l")).withColumn("_l", F.trim(F.regexp_replace("_l", r"^\s+|\s+$", ""))).where("_l <> ''")
    head = F.lit(None).cast("string")
    for name, section in SECTIONS.items():
        head = F.when(F.col("_l") == name, section).otherwise(head)
    w = Window.partitionBy(*key).orderBy("place")
    lines = lines.withColumn("_h", head).withColumn("section", F.last("_h", ignorenulls=True).over(w)).where("_h is null and section is not null")
    group = lambda form, i: F.regexp_extract("_l", form, i)
    words = F.split("_l", r"\s+")
    known, need = F.lit(False), F.lit(0)
    for rule, n in TERMINATIONS.items():
        known, need = known | ((words[0] == rule) & (F.size(words) >= n)), F.when(words[0] == rule, n if rule != "NoveltyRule" else 5).otherwise(need)
    rest = F.slice(words, F.lit(2), F.greatest(need - 1, F.lit(0)))
    rest = F.when((words[0] == "NoveltyRule") & (F.size(words) == 4), F.concat(rest, F.array(F.lit("None")))).otherwise(rest)
    kind = F.when(F.col("section") == "interactions", group(INTERACTION, 1)).when(F.col("section") == "classes", group(CLASS, 1)).when(F.size(words) >= 3, words[0])
    args = F.when(F.col("section") == "interactions", F.array(*[group(INTERACTION, i) for i in (2, 3, 4, 5)]))
    args = args.when(F.col("section") == "classes", F.array(group(CLASS, 2), F.element_at(F.split(group(CLASS, 3), r"\."), -1))).when(known, rest).otherwise(F.array("_l"))
    return lines.select(*key, "place", "section", kind.alias("kind"), args.alias("args")).where("kind <> ''")


def mask_errors(masks: DataFrame, cells: DataFrame, common: DataFrame, subject: str, file: str, cell: str, close: float = 1e-4) -> DataFrame:
    """(subject, error): files of a subject with other cells or another affine than its first file, an
    affine that isn't close to the first subject's, common cells that a subject lacks; must be empty.
    masks: subject, file, affine (array); cells: subject, file, cell; common: cell."""
    sign = cells.groupBy(subject, file).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(cell)).alias("x"))
    m = masks.join(sign, [subject, file], "left").groupBy(subject).agg(F.countDistinct(F.struct("n", "x")).alias("shapes"), F.min_by("affine", file).alias("_a"), F.collect_set("affine").alias("_all"), F.min(file).alias("_f"))
    apart = lambda a, b: (F.size(a) != F.size(b)) | F.exists(F.zip_with(a, b, lambda p, q: F.abs(p - q) > close), lambda far: F.coalesce(far, F.lit(True)))
    first = F.broadcast(m.agg(F.min_by("_a", subject).alias("_ref")))  # a single row
    m = m.join(first, F.lit(True)).withColumn("error", F.when(F.col("shapes") > 1, "files differ").when(F.exists("_all", lambda a: apart(a, F.col("_a"))), "affines of a subject differ").when(apart(F.col("_a"), F.col("_ref")), "another grid"))
    one = cells.join(m.select(subject, F.col("_f").alias(file)), [subject, file]).join(common.select(cell).distinct(), cell).groupBy(subject).agg(F.countDistinct(cell).alias("_have"))
    n = F.broadcast(common.agg(F.countDistinct(cell).alias("_want")))  # a single row
    lacks = m.join(one, subject, "left").join(n, F.lit(True)).where(F.coalesce("_have", F.lit(0)) < F.col("_want")).select(subject, F.lit("common cells outside").alias("error"))
    return m.where("error is not null").select(subject, "error").unionByName(lacks)
