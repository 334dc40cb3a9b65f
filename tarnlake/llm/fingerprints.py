"""SimHash fingerprints and the search for near ones with permuted block tables.

The terms of a text are its words and pairs of neighbouring words. Each term votes on every bit by
the bits of its hash, with the weight of its occurrences (pairs count twice); a bit is set if the
votes for it win. Fingerprints within a Hamming radius r agree on whole blocks: of b blocks at
most r differ, so for every pair there is a choice of b - r blocks with equal bits, and a table
keyed by each choice finds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.near_dup import mixed, word_hashes
from tarnlake.llm.words import WordTable, words_of

BITS = 128
RADIUS, BLOCKS = 5, 7
PAIR_WEIGHT = 2
#: Most characters of text in a range of neighbouring documents on average; there are at least as
#: many ranges as shuffle partitions. A task streams a range in order.
RANGE_CHARS = 256_000_000


def fingerprint(h: np.ndarray) -> bytes:
    """Fingerprint of a text by its words' 64-bit hashes, BITS / 8 bytes; no words: zeros."""
    if not len(h):
        return bytes(BITS // 8)
    terms, weights = h, np.ones(len(h), np.float32)
    if len(h) > 1:
        pairs = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        terms = np.concatenate([h, pairs])
        weights = np.concatenate([weights, np.full(len(pairs), PAIR_WEIGHT, np.float32)])
    votes = np.zeros(BITS, np.float32)
    for lo in range(0, len(terms), 4096):
        part = terms[lo : lo + 4096]
        words = np.stack([mixed(part + np.uint64(k)) for k in range(BITS // 64)], axis=1)
        bits = np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1)
        w = weights[lo : lo + 4096]
        votes += 2 * (w @ bits) - w.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every row of docs; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_hashes)
        for b in batches:
            got = [fingerprint(words.of(words_of(t))).hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """Every row with the text of the next document, and the number of ranges: range, doc_id, text
    and the rows that a range borrows from the following one (borrowed). Ascending doc_id, null
    first, ties by text.

    Spark deals the ids alone into ranges; their first ids cut the table, each range borrows the first
    document of the next one (the last of the first one), and so one shuffle of the texts brings
    neighbours together. The first ids are one number for each RANGE_CHARS of text or shuffle
    partition."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    dealt = rows.select(key.alias("key")).repartitionByRange(n, "key")
    firsts = sorted(r["first"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("first")).collect())
    if not firsts:
        return rows.select(F.lit(0).alias("range"), "doc_id", "text", F.lit(False).alias("borrowed")), 1
    starts = np.asarray(firsts[1:], np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, keys.to_numpy(np.int64), side="right").astype(np.int32))

    placed = rows.withColumn("range", range_of(key))
    lend = docs.sparkSession.createDataFrame([(first, i, (i or len(firsts)) - 1) for i, first in enumerate(firsts)], "first long, of int, to int")
    lent = placed.join(F.broadcast(lend), (key == F.col("first")) & (F.col("range") == F.col("of")))  # a row per range
    lent = lent.groupBy("to").agg(F.min(F.struct("doc_id", "text")).alias("d")).select(F.col("to").alias("range"), "d.doc_id", "d.text", F.lit(True).alias("borrowed"))
    return placed.select("range", "doc_id", "text", F.lit(False).alias("borrowed")).union(lent), len(firsts)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (range, doc_id, text, borrowed) to a row per document that isn't borrowed."""
    words = WordTable(word_hashes)
    of = lambda t: fingerprint(words.of(words_of(t.encode())))
    held = None  # range, doc_id, text, fingerprint
    out: list[tuple] = []
    for b in batches:
        for rng, doc, text, borrowed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            mine = of(text)
            if held is not None and held[0] == rng:
                _, d, t, f = held
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                e = of(edited)
                out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f.hex(), e.hex(), likeness(f, e), likeness(f, mine)))
            held = None if borrowed else (rng, doc, text, mine)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in SCHEMA.split(", ")], r, strict=True)) for r in out], schema=pa.schema([(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in SCHEMA.split(", ")]))
            out = []


def edits(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text) its fingerprint and that of the edited text: the last half
    of its characters (rounded down) replaced by the first as many of the next document, or all of
    them; see SCHEMA. Next is by ascending doc_id, nulls first, equal ids by text; after the last
    comes the first, and a single row follows itself. A null text is empty, its fingerprint zeros;
    repeated rows stand one after the other; an empty table gives an empty result; other columns
    are ignored."""
    rows, n = neighbours(docs)
    dealt = rows.repartition(n, "range").sortWithinPartitions("range", "borrowed", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_compare, SCHEMA)


def block_keys(fp: str | F.Column, radius: int = RADIUS, blocks: int = BLOCKS) -> F.Column:
    """A key for each choice of blocks - radius blocks of a hex fingerprint."""
    cuts = [BITS // 4 * i // blocks for i in range(blocks + 1)]
    col = F.col(fp) if isinstance(fp, str) else fp
    parts = [F.substring(col, 1 + lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return F.array(*[F.xxhash64(F.lit(k), *[parts[i] for i in c]) for k, c in enumerate(combinations(range(blocks), blocks - radius))])


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query fingerprint, corpus fingerprint, distance) within the radius, each distinct
    fingerprint once; corpus rows with equal fingerprints are one entry with their number (n_docs)
    and their smallest id (first_doc, null where all are null). Null fingerprints meet nothing.

    Tables hold a key and the bits as two numbers; what else an entry has joins the pairs found."""
    entry = corpus.groupBy("fingerprint").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    asked = queries.select(F.col("fingerprint").alias("query")).distinct()
    left = asked.select(_half("query", 0).alias("a0"), _half("query", 1).alias("a1"), F.explode(block_keys("query", radius, blocks)).alias("key"))
    right = corpus.select("fingerprint").distinct()
    right = right.select(_half("fingerprint", 0).alias("b0"), _half("fingerprint", 1).alias("b1"), F.explode(block_keys("fingerprint", radius, blocks)).alias("key"))
    distance = sum(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in (0, 1))
    found = left.join(right, "key").withColumn("distance", distance).where(F.col("distance") <= radius)
    found = found.select(_text("a").alias("query"), _text("b").alias("fingerprint"), "distance").distinct()
    return found.join(entry, "fingerprint").select("query", "fingerprint", "n_docs", "first_doc", "distance")


def _half(fp: str, i: int) -> F.Column:
    """64 bits of a hex fingerprint as a signed number."""
    return F.conv(F.substring(fp, 1 + 16 * i, 16), 16, -10).cast("long")


def _text(name: str) -> F.Column:
    """The hex fingerprint of two halves."""
    return F.concat(*[F.lower(F.lpad(F.hex(f"{name}{i}"), 16, "0")) for i in (0, 1)])


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, see edits(). For each document whose
    id is divisible by 100 (null elsewhere): n_within counts the documents within the radius of its
    fingerprint, itself included, classes_within their distinct fingerprints, and first_within is the
    smallest of their ids."""
    got = materialize(edits(table(spark, sf_dir, "documents")))
    asked = got.where("doc_id % 100 = 0")
    near = within_radius(asked, got.select("doc_id", "fingerprint")).groupBy("query")
    near = near.agg(F.sum("n_docs").alias("n_within"), F.count("*").alias("classes_within"), F.min("first_doc").alias("first_within"))
    counted = asked.select("doc_id", F.col("fingerprint").alias("query")).join(near, "query")
    counted = counted.select(F.col("doc_id").alias("_id"), F.col("query").alias("_fp"), "n_within", "classes_within", "first_within").distinct()
    return got.join(counted, (F.col("doc_id") == F.col("_id")) & (F.col("fingerprint") == F.col("_fp")), "left").drop("_id", "_fp")
