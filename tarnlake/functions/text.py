"""Scalar functions on names, paths and recorded values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def game_identity(name: Column, cohorts: tuple[str, ...]) -> tuple[Column, Column]:
    """(game, cohort) in lower case from cohort_game or game_cohort; nulls if it is neither."""
    c = "|".join(cohorts)
    low = F.lower(name)
    front, back = F.regexp_extract(low, f"^({c})_(.+)$", 2), F.regexp_extract(low, f"^(.+)_({c})$", 1)
    game = F.coalesce(F.nullif(front, F.lit("")), F.nullif(back, F.lit("")))
    cohort = F.when(front != "", F.regexp_extract(low, f"^({c})_", 1)).when(back != "", F.regexp_extract(low, f"_({c})$", 1))
    return game, cohort


def subject(number: Column) -> Column:
    return F.format_string("sub-%02d", number.cast("int"))


def key_vector(keys: Column, codes: list[int]) -> Column:
    """0/1 for each key code from a 0-based array of pressed keys; beyond its end: 0."""
    return F.array(*[F.coalesce(F.get(keys, F.lit(c)), F.lit(False)).cast("int") for c in codes])


def action(keys: Column, codes: dict[str, int], fallback: Column) -> Column:
    """The first pressed action in the order of codes, else the fallback."""
    out = fallback
    for name, code in reversed(codes.items()):
        out = F.when(F.coalesce(F.get(keys, F.lit(code)), F.lit(False)), name).otherwise(out)
    return out


def cell(pixel: Column, block: int) -> Column:
    """Grid cell of a pixel, floored for negatives too."""
    return F.floor(pixel / block).cast("int")


def terminal_flags(ended: Column, win: Column) -> Column:
    """won, lost, timed out from (ended, three-valued win)."""
    e = F.coalesce(ended, F.lit(False))
    return F.struct((e & F.coalesce(win, F.lit(False))).alias("won"), (e & F.coalesce(~win, F.lit(False))).alias("lose"), (e & win.isNull()).alias("timeout"))


def depth(layer: Column, n_layers: Column) -> Column:
    """(layer - 1) / (n - 1) to four places, halves to even; one layer: 0."""
    return F.when(n_layers > 1, F.bround((layer - 1) / (n_layers - 1), 4)).otherwise(0.0)


def fit_condition(bands: Column, shuffled: Column) -> Column:
    """main, joint or other bands, marked if features were shuffled."""
    extra = F.array_except(bands, F.array(F.lit("main")))
    name = F.when(~F.array_contains(bands, "main"), "control").when(F.size(extra) == 0, "main").otherwise("joint")
    return F.when(shuffled, F.concat(name, F.lit("_shuffled"))).otherwise(name)


def tagged_float(value: Column, tag: Column) -> Column:
    """A recorded double: the value, or NaN and infinities by their tag."""
    special = F.when(tag == "nan", F.lit(float("nan"))).when(tag == "inf", F.lit(float("inf"))).when(tag == "-inf", F.lit(float("-inf")))
    return F.coalesce(special, value)


def tagged(value: Column, kind: str, tag: str) -> Column:
    """JSON of a double, a binary or a time: finite doubles are numbers, all else an object whose `tag` says
    what it is. Null is null."""
    if kind == "double":
        name = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
        special = F.to_json(F.struct(F.lit("float").alias(tag), name.alias("value")))
        return F.when(name.isNotNull(), special).when(value.isNotNull(), value.cast("string")).otherwise("null")
    if kind == "binary":
        return F.when(value.isNotNull(), F.to_json(F.struct(F.lit("binary").alias(tag), F.base64(value).alias("base64"), F.lit(0).alias("subtype")))).otherwise("null")
    if kind == "timestamp":
        return F.when(value.isNotNull(), F.to_json(F.struct(F.lit("datetime").alias(tag), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso")))).otherwise("null")
    raise ValueError(f"no such kind: {kind}")


def untagged(text: Column, kind: str, tag: str) -> Column:
    """The double, binary or time of tagged(); an object of another kind, or no value of it, fails the job."""
    names = {"double": "float", "binary": "binary", "timestamp": "datetime"}
    if kind not in names:
        raise ValueError(f"no such kind: {kind}")
    object_ = F.from_json(text, f"struct<`{tag}`:string,value:string,base64:string,iso:string>")
    has = F.startswith(F.ltrim(text), F.lit("{"))
    wrong = F.raise_error(F.concat(F.lit(f"no {kind}: "), text))
    if kind == "double":
        name = object_["value"]
        special = F.when(name == "nan", F.lit(float("nan"))).when(name == "inf", F.lit(float("inf"))).when(name == "-inf", F.lit(float("-inf")))
        good, number = special, text.try_cast("double")
        plain = F.when(number.isNotNull(), number).otherwise(wrong.cast("double"))
    else:
        good = F.unbase64(object_["base64"]) if kind == "binary" else F.try_to_timestamp(object_["iso"])
        plain = wrong.cast(kind)
    ok = (object_[tag] == names[kind]) & good.isNotNull()
    return F.when(text.isNull() | (F.trim(text) == "null"), F.lit(None).cast(kind)).when(has & F.coalesce(ok, F.lit(False)), good).when(has, wrong.cast(kind)).otherwise(plain)
