"""Substring dedup by hashes of paragraphs and lines, and of passages within long lines.

A unit is a line or a paragraph of several lines (up to a blank one). Units are normalised (a-z, no
ASCII punctuation at a word's ends but for words of nothing else, no white space) and hashed to 128 bits; the digests are grouped
over all documents, the earliest ranked occurrence stays and the others go whole, however short.

A passage inside a longer line is no unit, as what stands around it differs. Lines are therefore also
cut into phrases, each up to a word pair whose hash is the least around: such ends hang on the
words nearby alone, so a passage has the same phrases wherever it stands, but for its ends. What is
hashed is two phrases in a row (12 words at least, 22 on average), since one alone repeats by chance.
A run of such repeated pairs goes if it is PASSAGE_WORDS long. Offsets are those of the original
text, in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.near_dup import mixed
from tarnlake.llm.words import WordTable, free_name, quoted, words_of

PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A run of repeated phrases goes from so many words on; a repeated passage of 50 words has about so
#: many within whole phrases.
PASSAGE_WORDS = 25
#: A phrase ends at a word pair whose hash is the least of all within so many words of its line.
REACH = 5
SPACE = np.zeros(33, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w.strip(PUNCT) or w) for w in words), np.uint64, len(words))


def units(text: str, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(k, first word, word after the last, start, end) of each unit; hashes: of the text's words. k
    is -1 for lines and paragraphs, else it counts pairs of phrases, with a gap at each line."""
    if not len(hashes):
        return
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.concatenate([[True], SPACE[np.minimum(code, 32)] & (code <= 32), [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    lines = np.flatnonzero(code == 10)
    last_of_line = np.searchsorted(starts, lines) - 1  # the word before each line end
    ended = np.bincount(last_of_line[last_of_line >= 0], minlength=len(hashes))
    hard, blank_line = ended > 0, ended > 1
    hard[-1] = blank_line[-1] = True
    pair = mixed(np.concatenate([hashes[:1], hashes[:-1]]) * np.uint64(3) + hashes)
    pair[np.concatenate([[True], hard[:-1]])] = np.iinfo(np.uint64).max  # a line's first word has none before it
    line = np.cumsum(np.concatenate([[0], hard[:-1]]))
    least = np.ones(len(hashes), bool)
    for k in range(1, min(REACH, len(hashes) - 1) + 1):
        other = line[k:] != line[:-k]
        least[k:] &= (pair[k:] < pair[:-k]) | other
        least[:-k] &= (pair[:-k] <= pair[k:]) | other

    def unit(k: int, i: int, j: int) -> tuple[int, int, int, int, int]:
        return k, i, j, int(starts[i]), int(ends[j - 1])

    k = of_part = 0
    phrases = [0]  # first words of the line's phrases
    for i in np.flatnonzero(least | hard).tolist():
        phrases.append(i + 1)
        if not hard[i]:
            continue
        yield unit(-1, phrases[0], i + 1)
        if i + 1 - phrases[0] >= PASSAGE_WORDS:
            for a, b in zip(phrases, phrases[2:]):  # noqa: B905
                yield unit(k, a, b)
                k += 1
            k += 1
        if blank_line[i]:
            if of_part < phrases[0]:
                yield unit(-1, of_part, i + 1)
            of_part = i + 1
        phrases = [i + 1]


FOUND = "low long, high long, doc_id long, text_hash long, k int, i int, j int, start int, end int"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to the units, see FOUND."""
    import xxhash

    words = WordTable(_hashes)
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.int32()) for f in FOUND.split(", ")])
    for b in batches:
        cols = [[] for _ in schema]
        for doc, mark, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            if not text:
                continue
            h = words.of(words_of(text.encode()))
            for k, i, j, start, end in units(text, h):
                d = xxhash.xxh3_128_digest(h[i:j].tobytes())
                row = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, mark, k, i, j, start, end
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


KEY = ["doc_id", "text_hash"]


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart: the id and a hash of the text."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")


def repeated_units(docs: DataFrame) -> DataFrame:
    """The spans to remove: doc_id, text_hash, start, end, first_docs (documents with the occurrences
    that stay). Occurrences rank by (doc_id, text_hash, start), null ids last; a span may lie in
    another one."""
    rows = docs.select(*keyed(docs), "text")
    found = materialize(rows.mapInArrow(_list, FOUND))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), *KEY, "start")
    kind = (F.col("k") < 0).alias("whole")  # a line and two phrases of a longer one are units of their own
    first = found.groupBy("low", "high", kind).agg(F.count("*").alias("n"), F.min(rank).alias("f")).where("n > 1").select("low", "high", "whole", "f")
    first = materialize(first)  # else the join runs in the partitions of the aggregate, where a hot unit can't be split
    both = found.withColumn("whole", kind).join(first, ["low", "high", "whole"])
    again = both.where("not (doc_id <=> f.doc_id and text_hash = f.text_hash and start = f.start)")
    whole = again.where("whole").select(*KEY, "start", "end", F.array("f.doc_id").alias("first_docs"))
    pairs = again.where("not whole").withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy(*KEY).orderBy("k")))
    runs = pairs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("f.doc_id").alias("first_docs"), (F.max("j") - F.min("i")).alias("words"))
    return whole.unionByName(runs.where(F.col("words") >= PASSAGE_WORDS).select(*KEY, "start", "end", "first_docs"))


def removals(docs: DataFrame) -> DataFrame:
    """A row per document with something to remove: doc_id, text_hash, removed (spans apart from each
    other, in order, as array<struct<start, end>>), n_units (how many), first_docs (documents
    that keep what it loses)."""
    before = Window.partitionBy(*KEY).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = F.coalesce(F.col("end") > F.max("end").over(before), F.lit(True))
    per = repeated_units(docs).withColumn("outer", outer).where("outer").groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_docs")))).alias("first_docs"),
    )  # fmt: skip  # as many as one document has units
    return per.select(*KEY, "removed", F.size("removed").cast("long").alias("n_units"), "first_docs")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with clean_text (the text without repeated units) and removed (their spans in the original
    text, empty if none); columns of these two names are replaced, all others stay. A null or
    empty text has no units. Rows equal in doc_id and text are one document and lose the same; other
    rows of an id, and rows without one, stand for themselves. An empty table gives an empty
    result."""
    i, h, r = (free_name(n, docs) for n in ("_tl_id", "_tl_hash", "_tl_spans"))
    gone = removals(docs).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("removed").alias(r))
    one, mark = keyed(docs)
    both = docs.join(gone, one.eqNullSafe(F.col(i)) & (mark == F.col(h)), "left")
    spans = F.coalesce(r, F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    kept = F.aggregate(
        spans,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda a, r: F.struct(F.concat(a["s"], F.substring(F.col("text"), a["at"] + 1, r["start"] - a["at"])).alias("s"), r["end"].alias("at")),
        lambda a: F.concat(a["s"], F.substring(F.col("text"), a["at"] + 1, F.lit(2147483647))),
    )
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(kept)
    return both.select(*[quoted(c) for c in docs.columns if c not in ("removed", "clean_text")], spans.alias("removed"), text.alias("clean_text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: units and characters removed, their spans (start:end, comma-joined, end
    exclusive, code points) and the documents that keep the first occurrences."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(*keyed(docs), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    g = removals(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_units", chars.alias("chars"), spans.alias("spans"), "first_docs")
    out = rows.join(g, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select(
        "doc_id", "n_chars", F.coalesce("n_units", F.lit(0)).alias("n_removed"), F.coalesce("chars", F.lit(0)).alias("removed_chars"),
        F.coalesce("spans", F.lit("")).alias("removed_spans"), F.coalesce("first_docs", F.expr("cast(array() as array<bigint>)")).alias("first_docs"),
    )
