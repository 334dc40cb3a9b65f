"""Quality: a classifier by compression.

A Zstandard dictionary is built from the texts labelled good, another from those labelled bad. A
text is compressed with either, block by block, as a dictionary helps where nothing came before. The
difference of the two sizes, divided by their sum, says which kind the text is like; their sum per
byte, how much the text repeats itself. A logistic function of both, fitted on labelled texts that
the dictionaries haven't seen, is the score.

The driver trains on a bounded sample of labelled rows; scoring is one pass over the whole texts.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize, release


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample; no bound holds for scoring. A class has at most
    max_docs_per_class texts and max_bytes_per_class bytes; a text of more than max_bytes is left out
    of the sample, so that no text is learned in part."""

    max_docs_per_class: int = 2500
    max_bytes: int = 200_000
    max_bytes_per_class: int = 16_000_000
    dictionary: int = 65_536
    block: int = 1024
    #: Bytes of sampled blocks that a dictionary is chosen from, as a multiple of its size.
    chosen_from: int = 100
    level: int = 3
    #: Bytes added to sizes and lengths, so that a few bytes say little.
    smooth: int = 8
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good texts (empty: none), and the logistic function's weights."""

    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, float, float]
    settings: Settings


def blocks_of(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary_of(texts: list[bytes], s: Settings) -> bytes:
    """A dictionary for blocks like those of texts; where they are too few to train one, their last
    bytes are it."""
    import zstandard

    found = [b for t in texts for b in blocks_of(t, s.block)]
    random.Random(s.seed).shuffle(found)
    found = found[: s.chosen_from * s.dictionary // s.block]
    size = min(s.dictionary, sum(map(len, found)) // 8)
    try:
        return zstandard.train_dictionary(size, found, level=s.level).as_bytes() if size >= 1024 else b"".join(found)[-s.dictionary :]
    except zstandard.ZstdError:
        return b"".join(found)[-s.dictionary :]


def measure(model: Model) -> Callable[[bytes | None], tuple[float, float]]:
    """A function from a text to the normalised difference of its sizes (positive: like the good
    texts) and the logarithm of their mean per byte."""
    import zstandard

    s = model.settings
    options = {"level": s.level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    tools = []
    for d in model.dictionaries:
        known = zstandard.ZstdCompressionDict(d) if d else None
        if known is not None:
            known.precompute_compress(level=s.level)
        tools.append(zstandard.ZstdCompressor(dict_data=known, **options))
    bare = len(zstandard.ZstdCompressor(**options).compress(b""))

    def of(text: bytes | None) -> tuple[float, float]:
        parts = blocks_of(text or b"", s.block)
        bad, good = (s.smooth + sum(len(t.compress(p)) - bare for p in parts) for t in tools)
        return (bad - good) / (bad + good), float(np.log((bad + good) / 2 / (len(text or b"") + 2 * s.smooth)))

    return of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Weights of the constant and of x's columns by Newton's method on the log loss."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return (float(np.log(share / (1 - share))), *[0.0] * x.shape[1])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    slopes = w[1:] / scale
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def train(texts: list[bytes], labels: list[int], apart: list[bool], s: Settings) -> Model:
    """Dictionaries from the texts that aren't set apart, weights from those that are."""
    found = tuple(dictionary_of([t for t, y, a in zip(texts, labels, apart, strict=True) if y == k and not a], s) for k in (0, 1))
    model = Model(found, (0.0, 0.0, 0.0), s)
    of = measure(model)
    x = np.asarray([of(t) for t, a in zip(texts, apart, strict=True) if a]).reshape(-1, 2)
    return Model(found, logistic(x, np.asarray([y for y, a in zip(labels, apart, strict=True) if a], float)), s)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on a bounded sample of labelled rows whose crc32(doc_id as text) mod 5 isn't 0; a quarter
    of it sets the weights. Rows without a label or id are left out; of several texts of an id the
    smallest is learned, of several labels the higher one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64(F.lit(s.seed), "doc_id")
    parts = [known.where(F.col("quality") == y).orderBy(order, "doc_id").limit(s.max_docs_per_class) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most two times max_docs_per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.where(F.octet_length("text") <= s.max_bytes).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = materialize(rows)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("quality").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of the sample alone
    sample = rows.withColumn("so_far", so_far).where(F.col("so_far") <= s.max_bytes_per_class).orderBy("doc_id").collect()
    release(rows)
    return train([bytes(r.text) for r in sample], [r.quality for r in sample], [zlib.crc32(b"c%d" % r.doc_id) % 4 == 0 for r in sample], s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, the probability of good) of every row of docs. A null text is scored
    as an empty one; equal texts have equal scores, repeated rows a row each; an empty table gives an
    empty result; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of settings.dictionary bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = measure(sent.value)
        w = np.asarray(sent.value.weights)
        for b in batches:
            x = np.asarray([of(t) for t in b.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
