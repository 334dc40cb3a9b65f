"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sainte-Lague gives each source an integer number of words for its target, and gives those in equal
blocks to the source's shards by their sizes, to none more than it has when repeated as often as
allowed. A shard's documents stand in an order drawn by the seed, and its quota is filled with
blocks along that order from the start, so that the seed selects what is taken and no more than one
document of a shard is cut. All of that works on sums per (source, shard); no source and no shard
passes through one task whole.
"""

from __future__ import annotations

import heapq
import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core.checks import bounded
from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.words import quoted

WORD = r"[^\x20\x09-\x0D]+"
RE_WORD = re.compile(WORD)
SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = (1.0, 2.0, 3.0)
MOST_REPEATS = 3
BLOCK_WORDS = 64
#: Shards of a source, at every size of the table: at ten billion documents of one source a shard
#: has about two million rows of three numbers.
SHARDS = 4096
#: Sources are planned on the driver, a row for each; more raise.
MOST_SOURCES = 1_000_000


def apportion(weights: list[float], seats: int) -> list[int]:
    """Sainte-Lague: `seats` go one by one to the highest weight / (2 * seats so far + 1); ties go
    to the earlier entry. Entries of weight 0 get none; all zero: nobody gets any.

    Rounding at the divisor sum / seats is right for the number of seats that it gives away; the
    difference to `seats` is then settled by the highest or lowest quotients."""
    total = float(sum(weights))
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    d = total / seats
    got = [int(w / d + 0.5) for w in weights]
    short = seats - sum(got)
    if short > 0:
        heap = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(weights, got, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(short):
            i = heap[0][1]
            got[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * got[i] + 1), i))
    elif short < 0:
        heap = [(w / (2 * s - 1), -i) for i, (w, s) in enumerate(zip(weights, got, strict=True)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i] > 0:
                heapq.heappush(heap, (weights[i] / (2 * got[i] - 1), -i))
    return got


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above `most` times its size, the excess goes to the
    others by weight until none is above."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def deal_words(cells: list[int], words: int, most: int, block: int) -> list[int]:
    """What each shard gives of a source's `words`: seats of `block` words by Sainte-Lague, none
    beyond `most` times the shard; what that cuts off goes to the other shards, and what is less
    than a block at the end to the first shards with room. Together min(words, most * sum(cells))."""
    room = [most * c for c in cells]
    left = words = min(words, sum(room))
    given = [0] * len(cells)
    free = [i for i, c in enumerate(cells) if c > 0]
    while free and left >= block:
        seats = apportion([float(cells[i]) for i in free], left // block)
        full = [i for i, g in zip(free, seats, strict=True) if g * block >= room[i]]
        if not full:
            for i, g in zip(free, seats, strict=True):
                given[i] = g * block
            left -= sum(seats) * block
            break
        for i in full:
            given[i] = room[i]
            left -= room[i]
        gone = set(full)
        free = [i for i in free if i not in gone]
    for i, c in enumerate(cells):
        more = min(left, room[i] - given[i])
        given[i], left = given[i] + more, left - more
    return given


def n_words(text: str) -> F.Column:
    """Number of words of a column, null for null. regexp_count() makes a list of all the words of a
    text first; here each becomes a letter, with the white space after it."""
    return F.length(F.regexp_replace(F.ltrim(F.col(text), F.lit(SPACES)), F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit("x")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """What a mix of all documents (doc_id, text, source) takes of each.

    Returns doc_id, source, size, source_size, target, taken and the columns named in `carry`, a
    row per row of docs. Sources in the order of code points, null last, have the weights in turn.
    taken counts words: whole passes over the document and then its first words. A null or empty
    text has size 0 and is never taken; a null doc_id is like any other; equal rows are taken one
    after the other. Reruns agree: the order of a shard is a hash of doc_id and seed.

    The driver holds one row per source, of which there are at most MOST_SOURCES."""
    size = F.coalesce(n_words("text"), F.lit(0)).cast("long").alias("size")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    narrow = materialize(docs.select(F.col("doc_id").cast("long"), key.alias("key"), size))
    sums = bounded(narrow.groupBy("key").agg(F.sum("size").alias("size")), MOST_SOURCES, "sources")
    found = [(r["key"], r["size"]) for r in sums.collect()]
    found.sort(key=lambda x: (x[0] == "n", x[0]))
    sizes = [x[1] for x in found]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    quota = apportion(target, sum(sizes))
    plan = {k: (s, t, q) for (k, s), t, q in zip(found, target, quota, strict=True)}

    def deal(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard")
        s, t, q = plan[cells["key"].iloc[0]]
        words = deal_words([int(c) for c in cells["cell_size"]], q, most, block_words)
        return cells.assign(source_size=s, target=t, words=words)

    def sharded(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)))

    cells = sharded(narrow).groupBy("key", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.groupBy("key").applyInPandas(deal, "key string, shard long, cell_size long, source_size long, target double, words long")

    rows, order = narrow, []
    if carry:
        rows = docs.select(F.col("doc_id").cast("long"), key.alias("key"), size, *[quoted(c).alias(f"_c{i}") for i, c in enumerate(carry)])
        order = [F.xxhash64(*[F.col(f"_c{i}") for i in range(len(carry))])]
    cell = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", *order)
    rows = sharded(rows).withColumn("start", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(cells, ["key", "shard"])
    passes = F.when(F.col("cell_size") > 0, F.expr("words div cell_size")).otherwise(0)
    rest = F.when(F.col("cell_size") > 0, F.expr("words % cell_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), rest) - F.col("start"))
    return rows.select(
        "doc_id", F.when(F.col("key") != "n", F.substring("key", 2, 2147483647)).alias("source"), "size", "source_size", "target",
        (passes * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word; null stays null."""

    def cut(t: str | None, k: int) -> str | None:
        if t is None:
            return None
        at = next(itertools.islice(RE_WORD.finditer(t), int(k) - 1, None), None)
        return t if at is None else t[: at.end()]

    return pd.Series([cut(t, k) for t, k in zip(text, n, strict=True)], dtype=object)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself with the columns of documents: a row for each whole pass over a document and
    one with its first words for what remains; n_chars is that of the text in the row."""
    names = {f"_d{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    own = docs.select("doc_id", "source", "text", *[quoted(c).alias(n) for n, c in names.items()])
    rows = mix(own, carry=("text", *names), **how).where("taken > 0")
    passes = F.expr("taken div size").cast("int")
    rows = rows.withColumn("take", F.explode(F.concat(F.array_repeat("size", passes), F.expr("filter(array(taken % size), x -> x > 0)"))))
    cut = first_words(F.when(F.col("take") < F.col("size"), F.col("text")), F.col("take"))
    rows = rows.withColumn("text", F.when(F.col("take") == F.col("size"), F.col("text")).otherwise(cut))
    back = {c: F.col(n) for n, c in names.items()}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[back.get(c, quoted(c)).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
