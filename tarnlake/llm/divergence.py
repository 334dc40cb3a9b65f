"""How far the sources of a language are from each other, by an inverted index of corrections.

A source's share of a term is a whole number of billionths, smoothed by five occurrences; all terms a
source doesn't have share one number, its `zero`. A pair of sources therefore starts at V times the
distance of its zeros, as if neither had any term, and the terms that one of them has correct that:

    value(a, b) = V |a0 - b0|
                + sum over the terms of a of |a(t) - b0| - |a0 - b0|, the same for b
                + sum over the terms of both of |a(t) - b(t)| - |a(t) - b0| - |a0 - b(t)| + |a0 - b0|

The sums over one source's terms need only how many terms have which share (distinct shares are at
most about the root of twice the words). Those over terms of both come from the postings of the
terms. Sources are dealt into blocks, a posting is compared block by block into tiles of sums, and
only what isn't zero leaves a task. All numbers are whole, so that no order of summing matters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core.session import table
from tarnlake.core.shared import materialize

#: A language keeps the terms that so many of its documents have.
LEAST_DOCS = 30
#: Occurrences added to every count.
SMOOTH = 5
#: Ranks kept of a source's terms.
TOP_TERMS = 50
#: Sources in a block on average; a tile of sums is a block by a block.
BLOCK = 256
#: Entries of a task's tables of counts, and tiles of sums it keeps, before it sends them on.
TABLE, TILES = 400_000, 64

#: A-Z to a-z, other ASCII but letters to a space: what is left between spaces are the terms.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split(b" ")


COUNTS = "lang string, source string, term string, n long, n_docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to occurrences and documents of each term, added up within the task."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in tables.items():
            for c in (n, n_docs):
                c.pop(b"", None)
            if n:
                whole = len(n)
                cols = [pa.array([lang] * whole), pa.array([source] * whole), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n_docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "n_docs"])
        tables.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            n, n_docs = tables.setdefault((lang, source), (Counter(), Counter()))
            terms = terms_of(text)
            n.update(terms)
            n_docs.update(set(terms))
        if sum(len(n) for n, _ in tables.values()) > TABLE:
            yield from out()
    yield from out()


def share(count: str, of: str) -> Column:
    """1 + floor(10^9 count / of) of two SQL expressions, three digits at a time: exact in 64 bits for
    0 <= count <= of < 9e15."""
    a = f"(({count}) * 1000)"
    b = f"({a} % ({of}) * 1000)"
    c = f"({b} % ({of}) * 1000)"
    return F.expr(f"1 + {a} div ({of}) * 1000000 + {b} div ({of}) * 1000 + {c} div ({of})")


def counted(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each (lang, source, term); null text, lang and source are ''."""
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source"))
    rows = docs.select(lang.alias("lang"), source.alias("source"), text.cast("binary").alias("text"))
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def sources(docs: DataFrame, posts: DataFrame, langs: DataFrame) -> DataFrame:
    """A row for each (lang, source) of docs: id (its block and place there), total (what its counts
    are divided by), zero (the share of a term it doesn't have) and n_kept (V)."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    groups = materialize(docs.select(lang, source).distinct())
    words = posts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    dealt = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    full = groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left").join(dealt, "lang")
    full = full.withColumn("block", F.pmod(F.xxhash64("source"), "n_blocks"))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1
    total = (F.coalesce("n", F.lit(0)) + SMOOTH * F.col("n_kept")).alias("total")
    full = full.select("lang", "source", (F.col("block") * 65536 + place).alias("id"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), total)
    return materialize(full.withColumn("zero", F.when(F.col("n_kept") > 0, share(str(SMOOTH), "total")).otherwise(F.lit(0))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def one_sided(zero: pd.Series, shares: pd.Series, numbers: pd.Series, zeros: pd.Series) -> pd.Series:
    """For each b0 of zeros: sum of |share - b0| - |zero - b0| over a source's terms, given as its
    shares in ascending order and the numbers of terms that have them."""

    def of(a0: int, p: np.ndarray, n: np.ndarray, b0: np.ndarray) -> np.ndarray:
        if p is None or not len(p):
            return np.zeros(len(b0), np.int64)
        below, sums = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
        at = np.searchsorted(p, b0)
        return (sums[-1] - below[-1] * b0) + 2 * (below[at] * b0 - sums[at]) - below[-1] * np.abs(a0 - b0)

    return pd.Series([of(*x) for x in zip(zero, shares, numbers, zeros, strict=True)], dtype=object)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, posting as list of (id, share, zero)) of terms to sums over them for pairs of sources
    that both have the term, where they aren't zero."""
    sums: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, x, y), m in sums.items():
            i, j = np.nonzero(np.triu(m, 1) if x == y else m)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i + x * 65536), pa.array(j + y * 65536), pa.array(m[i, j])], ["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        entries = batch.column(1)
        ends = entries.offsets.to_numpy()
        flat = entries.values
        ids, shares, zeros = (flat.field(k).to_numpy() for k in range(3))
        for lang, s, e in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            block, place, p, z = ids[s:e] >> 16, ids[s:e] & 65535, shares[s:e], zeros[s:e]
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), e - s]
            for u, (i0, i1) in enumerate(zip(edges, edges[1:])):  # noqa: B905
                for j0, j1 in zip(edges[u:], edges[u + 1 :]):  # noqa: B905
                    key = lang, int(block[i0]), int(block[j0])
                    m, need = sums.get(key), int(max(place[i0:i1].max(), place[j0:j1].max())) + 1
                    if m is None or len(m) < need:
                        wider = np.zeros((1 << (need - 1).bit_length(),) * 2, np.int64)
                        if m is not None:
                            wider[: len(m), : len(m)] = m
                        m = sums[key] = wider
                    pi, pj, zi, zj = p[i0:i1, None], p[j0:j1], z[i0:i1, None], z[j0:j1]
                    m[np.ix_(place[i0:i1], place[j0:j1])] += abs(pi - pj) - abs(pi - zj) - abs(zi - pj) + abs(zi - zj)
            if len(sums) > TILES:
                yield from out()
    yield from out()


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has each other source of the lang with the
    distance to it, part `term` the TOP_TERMS terms the source has more often than its lang, by how
    much. Ranks run by value descending, then item.

    Each row of docs is a document, repeated rows too; null text, lang or source is ''. A group
    without terms still has its pairs, and a lang without kept terms distances of 0; a lang of one
    source has no pairs. An empty table gives an empty result; other columns are ignored."""
    counts = materialize(counted(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n_lang")).where(F.col("n_docs") >= LEAST_DOCS)
    posts = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"))
    terms = posts.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"))
    langs = materialize(terms.groupBy("lang").agg(F.count("*").alias("n_kept"), (F.sum("n_lang") + SMOOTH * F.count("*")).alias("lang_total")))
    groups = sources(docs, posts, langs)
    shares = posts.join(groups, ["lang", "source"]).withColumn("share", share(f"n + {SMOOTH}", "total"))

    # Sums over the terms of one source: against the zeros of all sources of its lang.
    met = shares.groupBy("lang", "source", "share").agg(F.count("*").alias("number")).groupBy("lang", "source").agg(F.array_sort(F.collect_list(F.struct("share", "number"))).alias("shares"))
    blocks = groups.groupBy("lang", F.shiftright("id", 16).alias("block")).agg(F.array_sort(F.collect_list(F.struct("id", "zero"))).alias("others"))
    alone = groups.join(met, ["lang", "source"], "left").join(blocks, "lang")
    alone = alone.withColumn("sums", one_sided("zero", "shares.share", "shares.number", "others.zero"))
    alone = alone.select("lang", "id", "zero", "n_kept", F.explode(F.arrays_zip("others", "sums")).alias("o")).select("*", F.col("o.others.id").alias("other"), F.col("o.others.zero").alias("other_zero"))
    start = F.when(F.col("id") < F.col("other"), F.col("n_kept") * F.abs(F.col("zero") - F.col("other_zero"))).otherwise(F.lit(0))
    alone = alone.where("id <> other").select("lang", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), (F.col("o.sums") + start).alias("value"))

    # Sums over the terms of both, from the postings; a posting has an entry for each source at most.
    postings = shares.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("id", "share", "zero"))).alias("posting")).where(F.size("posting") > 1)
    together = postings.select("lang", "posting").mapInArrow(_tiles, "lang string, a long, b long, value long")

    pairs = alone.unionByName(together).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value").select("lang", "p.a", "p.b", "value")
    names = groups.select("lang", F.col("id").alias("a"), "source")
    pairs = pairs.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    more = shares.join(langs.select("lang", "lang_total"), "lang").withColumn("value", F.col("share") - share(f"n_lang + {SMOOTH}", "lang_total"))
    more = more.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(more.select("*", rank).where(F.col("rank") <= TOP_TERMS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
