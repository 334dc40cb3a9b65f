"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of three rows of a hashed table: the whole word and its two prefixes,
without ASCII punctuation at its ends. Filters of several widths run over the word vectors, the
maximum of each filter over the text is kept, and a logistic layer reads the maxima. Rows of the
table that fewer than min_docs training texts touch stay zero: unseen words say nothing, and no
text is learned by heart from words of its own.

All labelled rows are learned: the join that labels them deals them into shards, every epoch each
shard goes on from the same model in a task of its own, and Spark averages what they came to.
Only a caller who names bounds trains on a sample, in the driver. Scoring is one pass over the texts.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize, release
from tarnlake.llm.words import groups, quoted

#: Bytes of a word of text and what is around it, about; and of texts whose words are numbered together.
WORD = 6
TOGETHER = 1_000_000
#: Rows of a block that is multiplied.
ROWS = 2048
PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Settings:
    """shard_words is about the number of words of a shard; of a longer one (a text can be of any length)
    about as many are held at a time. The bounds of a sample are
    unset unless the caller names them, and none holds for scoring: a class then has at most
    max_docs_per_class texts and max_words_per_class words; a text of more than max_words words is
    left out of the sample, so that no text is learned in part."""

    buckets: int = 1 << 18
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    max_docs_per_class: int | None = None
    max_words: int | None = None
    max_words_per_class: int | None = None
    shard_words: int = 2_000_000
    min_docs: int = 4
    epochs: int = 10
    batch: int = 32
    rate: float = 0.05
    seed: int = 7


@dataclass
class Model:
    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def word_rows(words: list[bytes], buckets: int) -> np.ndarray:
    """Rows of the hashed table for each word: whole word, first four and first six characters."""
    crc, whole, four, six = zlib.crc32, zlib.crc32(b"w"), zlib.crc32(b"4"), zlib.crc32(b"6")
    out = []
    for w in words:
        w = w.strip(PUNCT)
        if w.isascii():
            out += crc(w, whole), crc(w[:4], four), crc(w[:6], six)
        else:
            s = w.decode("utf-8", "replace")
            out += crc(w, whole), crc(s[:4].encode(), four), crc(s[:6].encode(), six)
    return np.asarray(out, np.int64).reshape(-1, 3) % buckets


#: What a byte makes of the register of CRC-32; and bytes of a word that are taken with those of all others.
STEP = np.asarray([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
CRC_BYTES = 32


def crcs(words: pa.LargeStringArray, before: bytes) -> np.ndarray:
    """zlib.crc32 of before + word, byte by byte of all words at once; long ones end one by one."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    lengths = np.diff(offsets)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    order = np.argsort(-np.minimum(lengths, CRC_BYTES + 1), kind="stable")
    at, sizes = offsets[:-1][order], lengths[order]
    crc = np.full(len(words), zlib.crc32(before) ^ 0xFFFFFFFF, np.uint32)
    for k in range(min(CRC_BYTES, int(sizes[0])) if len(sizes) else 0):
        n = int(np.searchsorted(-np.minimum(sizes, CRC_BYTES + 1), -k))  # those of more than k bytes
        crc[:n] = STEP[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-np.minimum(sizes, CRC_BYTES + 1), -CRC_BYTES))):
        crc[i] = zlib.crc32(data[at[i] + CRC_BYTES : at[i] + sizes[i]].tobytes(), int(crc[i]))
    out = np.empty(len(words), np.int64)
    out[order] = crc
    return out


def word_rows_at_once(words: pa.LargeStringArray, buckets: int) -> np.ndarray:
    """word_rows() of many words."""
    trimmed = pc.ascii_trim(words, characters=PUNCT.decode())
    try:
        trimmed.validate(full=True)
    except pa.ArrowInvalid:  # bytes that aren't UTF-8
        return word_rows(words.view(pa.large_binary()).to_pylist(), buckets)
    parts = [(trimmed, b"w"), (pc.utf8_slice_codeunits(trimmed, 0, 4), b"4"), (pc.utf8_slice_codeunits(trimmed, 0, 6), b"6")]
    return np.column_stack([crcs(*p) for p in parts]) % buckets


def numbered(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """words_of() all texts: how many each has, and the words, one text's after the other's, as places in
    an array of the distinct ones."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())))
    pieces = lists.flatten()
    some = pc.greater(pc.binary_length(pieces), 0)  # white space at an end leaves an empty piece
    so_far = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)
    words = pieces.filter(some).dictionary_encode()
    return np.diff(so_far[ends], prepend=0), words.indices.to_numpy(), words.dictionary


def filtered(model: Model, x: np.ndarray) -> np.ndarray:
    """The filters of all widths, one after the other, at each word that the widest one can start from.
    Full blocks of rows are multiplied, so that equal words come to equal numbers wherever they lie."""
    d, most = x.shape[1], max(len(k) for k in model.kernels)
    n = len(x) - most // d + 1
    windows = np.zeros((n + -n % ROWS, most), x.dtype)
    for k in range(most // d):
        windows[:n, k * d : (k + 1) * d] = x[k : k + n]
    return windows @ np.concatenate([np.pad(k, ((0, most - len(k)), (0, 0))) for k in model.kernels], axis=1)


def forward(model: Model, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits of texts whose word vectors lie one after the other in x, each followed by enough
    zero rows for the widest filter; and the maxima's positions by width."""
    h = filtered(model, x)
    at = np.empty((len(starts), h.shape[1]), np.int64)
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        at[i] = h[s : s + n].argmax(0) + s
    f = np.maximum(h[at, np.arange(h.shape[1])] + np.concatenate(model.biases), 0)
    edges = np.cumsum([k.shape[1] for k in model.kernels])[:-1]
    return (f * model.out).sum(1) + model.bias, [*np.split(at, edges, axis=1), f]


def logits_of(model: Model, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The logits of forward() alone."""
    h = filtered(model, x)
    top = np.empty((len(starts), h.shape[1]), h.dtype)
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        h[s : s + n].max(0, out=top[i])
    return (np.maximum(top + np.concatenate(model.biases), 0) * model.out).sum(1) + model.bias


def vectors(rows: list[np.ndarray], model_table: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors of texts given as rows of the table, and where each text lies."""
    lengths = np.asarray([max(1, len(r)) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64)
    ids = np.full((int((lengths + pad).sum()), 3), -1, np.int64)
    x = np.zeros((len(ids), model_table.shape[1]), np.float32)
    at = places(starts, np.asarray([len(r) for r in rows]))
    if len(at):
        ids[at] = real = np.concatenate(rows)
        whole, four, six = (model_table.take(i, axis=0) for i in real.T.astype(np.intp))
        x[at] = whole + four + six
    return x, ids, starts, lengths


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where the words of texts lie that begin at starts."""
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - begin, counts)


@dataclass
class Sums:
    """Adagrad's sums of squares, of the parts of a model."""

    table: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float

    @classmethod
    def before(cls, m: Model, rare: np.ndarray) -> Sums:
        full = lambda x: np.full(x.shape, 1e-3, np.float32)
        return cls(np.where(rare, np.inf, 1e-3).astype(np.float32), [full(k) for k in m.kernels], [full(b) for b in m.biases], full(m.out), 1e-3)


def started(rng: np.random.Generator, s: Settings) -> Model:
    return Model(
        rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * s.dim), (w * s.dim, s.filters)).astype(np.float32) for w in s.widths],
        [np.zeros(s.filters, np.float32) for _ in s.widths],
        rng.normal(0, 0.5, s.filters * len(s.widths)).astype(np.float32),
        0.0,
    )


def one_class(model: Model, labels: np.ndarray) -> Model:
    """Without texts of both classes every text has the same score."""
    model.out[:] = 0
    model.bias = 0.0 if not len(labels) else (-3.0 if labels[0] == 0 else 3.0)
    return model


def train(texts: list[list[np.ndarray]] | list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Adagrad on the log loss, classes weighing the same. texts: rows of the table by text."""
    rng = np.random.default_rng(s.seed)
    model = started(rng, s)
    seen = np.zeros(s.buckets, np.int32)
    for t in texts:
        seen[np.unique(t)] += 1
    rare = seen < s.min_docs
    model.table[rare] = 0
    if not len(labels) or labels.min() == labels.max():
        return one_class(model, labels)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    sums = Sums.before(model, rare)
    for _ in range(s.epochs):
        learn(model, sums, texts, labels, weight, rng.permutation(len(texts)), s)
    return model


def learn(model: Model, sums: Sums, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, order: np.ndarray, s: Settings) -> None:
    """One epoch over the texts in the given order."""
    pad, d = max(s.widths) - 1, s.dim
    for lo in range(0, len(order), s.batch):
        part = order[lo : lo + s.batch]
        x, ids, starts, lengths = vectors([texts[i] for i in part], model.table, pad)
        z, (*where, f) = forward(model, x, starts, lengths)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels[part]) * weight[part] / len(part)
        d_out, df = f.T @ dz, np.outer(dz, model.out)
        d_bias = float(dz.sum())
        rows, grads = [], []
        for k, (width, at) in enumerate(zip(s.widths, where, strict=True)):
            cols = slice(k * s.filters, (k + 1) * s.filters)
            dk = df[:, cols] * (f[:, cols] > 0)
            index = at[:, :, None] + np.arange(width)  # text, filter, word
            flat = x[index].reshape(*at.shape, width * d)
            kernel = model.kernels[k]
            rows.append(index.reshape(-1))
            grads.append((dk[:, :, None] * kernel.T[None]).reshape(-1, d))
            d_kernel = np.einsum("tf,tfd->df", dk, flat).astype(np.float32)
            sums.kernels[k] += d_kernel**2
            kernel -= s.rate * d_kernel / np.sqrt(sums.kernels[k])
            d_b = dk.sum(0).astype(np.float32)
            sums.biases[k] += d_b**2
            model.biases[k] -= s.rate * d_b / np.sqrt(sums.biases[k])
        sums.out += d_out**2
        model.out -= (s.rate * d_out / np.sqrt(sums.out)).astype(np.float32)
        sums.bias += d_bias**2
        model.bias -= s.rate * d_bias / np.sqrt(sums.bias)
        touched, grad = ids[np.concatenate(rows)], np.concatenate(grads).astype(np.float32)
        real = (touched[:, 0] >= 0) & grad.any(1)
        touched, grad = touched[real], grad[real]
        slots, inverse = np.unique(touched, return_inverse=True)
        inverse, each = inverse.ravel(), np.repeat(grad, 3, axis=0)
        total = np.column_stack([np.bincount(inverse, each[:, k], len(slots)) for k in range(d)]).astype(np.float32)
        sums.table[slots] += (total**2).sum(1)
        model.table[slots] -= 3 * s.rate * total / np.sqrt(sums.table[slots])[:, None]


def dense(m: Model | Sums) -> np.ndarray:
    """All but the table, one after the other."""
    return np.concatenate([*[k.ravel() for k in m.kernels], *m.biases, m.out, [m.bias]]).astype(np.float64)


def set_dense(m: Model | Sums, flat: np.ndarray) -> None:
    at = 0
    for x in [*m.kernels, *m.biases, m.out]:
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    m.bias = float(flat[at])


#: Slots of a model that are added up together, and parts that one group adds up.
BLOCK = 4096
PARTS = 64
CHANGES = "block int, part long, slots binary, n binary, change binary"


def in_blocks(slots: np.ndarray, n: np.ndarray, change: np.ndarray, part: int) -> pd.DataFrame:
    """Changes of slots (ascending) as rows of CHANGES; n: shards that they add up."""
    blocks, lo = np.unique(slots // BLOCK, return_index=True)
    cut = lambda x, kind: [v.astype(kind).tobytes() for v in np.split(x, lo[1:])]
    return pd.DataFrame({"block": blocks, "part": part, "slots": cut(slots % BLOCK, "<u2"), "n": cut(n, "<i4"), "change": cut(change, "<f4")})


def added_up(g: pd.DataFrame, width: int) -> pd.DataFrame:
    """One row of CHANGES for those of a block, added up in the order of their parts."""
    g = g.sort_values(["part", "slots", "change"], kind="stable")
    n, total = np.zeros(BLOCK, np.int64), np.zeros((BLOCK, width))
    for slots, some, change in zip(g["slots"], g["n"], g["change"], strict=True):
        at = np.frombuffer(slots, "<u2")
        n[at] += np.frombuffer(some, "<i4")
        total[at] += np.frombuffer(change, "<f4").reshape(-1, width)
    at = np.flatnonzero(n)
    return in_blocks(at + BLOCK * int(g["block"].iloc[0]), n[at], total[at], int(g["part"].iloc[0]) // PARTS)


def one_epoch(sent: Broadcast, epoch: int, share: float, s: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What each shard changes in an epoch. A shard's rows come one after the other; it is learned run by
    run of about shard_words words, so that one run is held at a time."""
    width = s.dim + 1

    def changes(shard: int, m: Model, own: Sums) -> pd.DataFrame:
        """The table with its sums; and, at slots behind it, all else."""
        was, sums = sent.value
        slots = np.flatnonzero(own.table != sums.table)
        rest = np.concatenate([dense(m) - dense(was), dense(own) - dense(sums)])
        rest = np.pad(rest, (0, -len(rest) % width)).reshape(-1, width)
        change = np.concatenate([np.column_stack([m.table[slots] - was.table[slots], own.table[slots] - sums.table[slots]]), rest])
        slots = np.concatenate([slots, s.buckets + np.arange(len(rest))])
        return in_blocks(slots, np.ones(len(slots)), change, shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, m, own, runs, words = None, None, None, 0, 0
        texts: list[np.ndarray] = []
        labels: list[int] = []

        def learn_run() -> None:
            y = np.asarray(labels, np.float64)
            order = np.random.default_rng([s.seed, epoch, shard, runs]).permutation(len(y))
            learn(m, own, texts, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)), order, s)

        for b in batches:
            for of, toxic, rows in zip(b["shard"].tolist(), b["toxic"].tolist(), b["rows"], strict=True):
                if shard is not None and (of != shard or words >= s.shard_words * 3 // 2):
                    learn_run()
                    runs, words, texts, labels = runs + 1, 0, [], []
                if of != shard:
                    if shard is not None:
                        yield changes(shard, m, own)
                    shard, runs, (m, own) = of, 0, copy.deepcopy(sent.value)
                texts.append(np.frombuffer(rows, "<i4").reshape(-1, 3))
                labels.append(toxic)
                words += len(rows) // 12
        if shard is not None:
            learn_run()
            yield changes(shard, m, own)

    return run


def train_on_all(rows: DataFrame, s: Settings) -> Model:
    """train() over a table of any size (shard, toxic, rows: rows of the hashed table as bytes), in files
    that hold the shards in order. In every epoch each shard goes on from the same model; a number is
    then the mean over the shards that changed it. The driver holds one model, whose size hangs on the
    settings alone."""
    spark = rows.sparkSession
    count = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # a row per class
    model = started(np.random.default_rng(s.seed), s)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(s.buckets, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                n[np.unique(np.frombuffer(t, "<i4"))] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])

    seen = rows.select("rows").mapInArrow(touched, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_docs)
    marks = seen.groupBy(F.floor(F.col("slot") / BLOCK)).agg(F.collect_list(F.col("slot").cast("int")).alias("slots")).collect()  # at most `buckets` slots
    rare = np.ones(s.buckets, bool)
    for r in marks:
        rare[r.slots] = False
    model.table[rare] = 0
    if len(count) < 2:
        return one_class(model, np.asarray(list(count), float))
    share = count[1] / (count[0] + count[1])
    sums = Sums.before(model, rare)
    last = rows.agg(F.max("shard")).head()[0]
    width = s.dim + 1

    for epoch in range(s.epochs):
        sent = spark.sparkContext.broadcast((model, sums))
        each = rows.select("shard", "toxic", "rows").mapInPandas(one_epoch(sent, epoch, share, s), CHANGES)
        parts = last + 1
        while parts > PARTS:
            each = each.groupBy("block", F.floor(F.col("part") / PARTS)).applyInPandas(lambda g: added_up(g, width), CHANGES)
            parts = math.ceil(parts / PARTS)
        mean = each.groupBy("block").applyInPandas(lambda g: added_up(g, width), CHANGES).orderBy("block").collect()  # at most a model, a row per block
        sent.destroy()
        rest = []
        for r in mean:
            at = np.frombuffer(r.slots, "<u2").astype(np.int64) + BLOCK * r.block
            change = np.frombuffer(r.change, "<f4").reshape(-1, width) / np.frombuffer(r.n, "<i4")[:, None]
            slots = at[at < s.buckets]
            model.table[slots] += change[: len(slots), :-1].astype(np.float32)
            sums.table[slots] += change[: len(slots), -1].astype(np.float32)
            rest.append(change[len(slots) :].ravel())
        rest = np.concatenate(rest)
        n = len(dense(model))
        set_dense(model, dense(model) + rest[:n])
        set_dense(sums, dense(sums) + rest[n : 2 * n])
    return model


def logits(model: Model, rows: list[np.ndarray], s: Settings) -> np.ndarray:
    """Logits of texts given as rows of the table."""
    out = []
    for lo in range(0, len(rows), 64):
        x, _, starts, lengths = vectors(rows[lo : lo + 64], model.table, max(s.widths) - 1)
        out.append(np.clip(logits_of(model, x, starts, lengths), -30, 30))
    return np.concatenate(out) if out else np.zeros(0)


def score_texts(model: Model, vectors_of: Callable[[pa.LargeStringArray], np.ndarray], texts: list[bytes | None]) -> np.ndarray:
    """Scores of UTF-8 texts; vectors_of: vector_table() of the model."""
    pad = max(k.shape[0] for k in model.kernels) // model.table.shape[1] - 1
    counts, which, distinct = numbered(texts)
    lengths = np.maximum(counts, 1)
    starts = np.cumsum(lengths + pad) - lengths - pad
    x = np.zeros((int((lengths + pad).sum()), model.table.shape[1]), np.float32)
    x[places(starts, counts)] = vectors_of(distinct).take(which, axis=0)
    z = logits_of(model, x, starts, lengths)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def vector_table(model: Model) -> Callable[[pa.LargeStringArray], np.ndarray]:
    """Word vectors under the model."""
    return lambda words: sum(model.table.take(i, axis=0) for i in word_rows_at_once(words, len(model.table)).T)


def calibrate(scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20, n: np.ndarray | None = None) -> tuple[float, dict[str, float]]:
    """A shift of the logit that puts the best common threshold at 0.5, and by language the
    threshold with the best F1; a language with fewer than `least` rows of either class has 0.5. n: rows that each score stands for."""
    n = np.ones(len(labels)) if n is None else n

    def best(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
        cuts = np.unique(np.concatenate([s, [0.5]]))
        mids = np.concatenate([(cuts[:-1] + cuts[1:]) / 2, [0.5]])
        f1 = [2 * (n * y)[s >= c].sum() / max(1, n[s >= c].sum() + (n * y).sum()) for c in mids]
        top = np.flatnonzero(np.isclose(f1, max(f1)))
        return float(np.median(mids[top]))

    if not len(labels) or labels.min() == labels.max():
        return 0.0, {}
    cut = min(max(best(scores, labels, n), 1e-4), 1 - 1e-4)
    shift = float(np.log(cut / (1 - cut)))
    logit = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / (1 - np.clip(scores, 1e-9, 1 - 1e-9))) - shift
    moved = 1 / (1 + np.exp(-logit))
    out = {}
    for lang in sorted(set(langs)):
        at = np.asarray([x == lang for x in langs])
        if min(n[at & (labels == 1)].sum(), n[at & (labels == 0)].sum()) >= least:
            out[lang] = min(max(best(moved[at], labels[at], n[at]), 0.2), 0.8)
    return shift, out


def fit_on_all(prepared: DataFrame, s: Settings) -> Model:
    """Train on all rows but a fifth; that fifth's scores are counted in steps of 1/200 of a logit by
    language and label, which is what the driver sets the thresholds on."""
    held = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))) % 5 == 0
    model = train_on_all(prepared.where(~held), s)
    sent = prepared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = logits(sent.value, [np.frombuffer(r, "<i4").reshape(-1, 3) for r in b.column(2).to_pylist()], s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.rint(200 * z).astype(np.int64))], ["lang", "toxic", "step"])

    got = prepared.where(held).select("lang", "toxic", "rows").mapInArrow(run, "lang string, toxic int, step long")
    got = got.groupBy("lang", "toxic", "step").count().orderBy("lang", "toxic", "step").toPandas()  # at most 24,002 rows a language
    scores = 1 / (1 + np.exp(-got["step"].to_numpy(np.float64) / 200))
    langs = [None if pd.isna(x) else x for x in got["lang"]]
    shift, model.thresholds = calibrate(scores, got["toxic"].to_numpy(np.float64), [str(x) for x in langs], n=got["count"].to_numpy(np.float64))
    model.bias -= shift
    release(prepared)
    return model


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on all labelled rows whose crc32(doc_id as text) mod 5 isn't 0, or on a sample of them if the
    settings name its bounds; a fifth sets the thresholds. Texts are learned whole. Rows without a
    label or id are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where("toxic in (0, 1)")
    order = F.xxhash64(F.lit(s.seed), "doc_id")
    chosen = known
    if s.max_docs_per_class is not None:
        parts = [known.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(s.max_docs_per_class) for y in (0, 1)]
        chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most two times max_docs_per_class rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").cast("binary").alias("text"))
    every = s.max_docs_per_class is None and s.max_words is None and s.max_words_per_class is None
    if every:
        known = chosen = materialize(known)
        own = own.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)  # others aren't shuffled
        size = own.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(F.sum("size")).head()[0]
        shards = max(1, math.ceil((size or 0) / WORD / s.shard_words))
        own = own.repartition(shards, "doc_id")  # a partition of the join is a shard
    rows = own.join(chosen, "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, got = b.column(2).to_pylist(), []
            for lo, hi in groups(texts, TOGETHER):
                counts, which, distinct = numbered(texts[lo:hi])
                found = word_rows_at_once(distinct, s.buckets).astype("<i4").take(which, axis=0)
                got += [x.tobytes() for x in np.split(found, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(got, pa.binary())], ["doc_id", "lang", "toxic", "rows"])

    prepared = rows.mapInArrow(prepare, "doc_id long, lang string, toxic int, rows binary")
    if every:
        prepared = materialize(prepared.withColumn("shard", F.spark_partition_id().cast("long")).sortWithinPartitions("shard", "doc_id", "toxic", "rows"))
        release(known)
        return fit_on_all(prepared, s)
    prepared = materialize(prepared.withColumn("row", F.monotonically_increasing_id()))
    n = (F.length("rows") / 12).alias("n")  # three numbers of four bytes a word
    sizes = prepared.select("row", "doc_id", "toxic", n, F.xxhash64("rows").alias("mark")).where(F.lit(True) if s.max_words is None else F.col("n") <= s.max_words)  # numbers of the sample alone
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy(order, "doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0))
    within = sizes.withColumn("so_far", so_far).where(F.lit(True) if s.max_words_per_class is None else F.col("so_far") <= s.max_words_per_class).select("row")
    sample = prepared.join(F.broadcast(within), "row").toPandas().sort_values(["doc_id", "toxic", "rows"], kind="stable")
    texts = [np.frombuffer(r, "<i4").reshape(-1, 3) for r in sample["rows"]]
    y = sample["toxic"].to_numpy(np.float64)
    held = np.asarray([zlib.crc32(b"c%d" % i) % 5 == 0 for i in sample["doc_id"]], bool)
    model = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held], s)
    pad = max(s.widths) - 1
    scores = []
    tests = [t for t, h in zip(texts, held, strict=True) if h]
    for lo in range(0, len(tests), 64):
        x, _, starts, lengths = vectors(tests[lo : lo + 64], model.table, pad)
        scores.append(1 / (1 + np.exp(-np.clip(forward(model, x, starts, lengths)[0], -30, 30))))
    shift, model.thresholds = calibrate(np.concatenate(scores) if scores else np.zeros(0), y[held], [str(x) for x in sample["lang"][held]])
    model.bias -= shift
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and rejected (score reaches its language's threshold) of every row of docs,
    with the columns named in `keep`. A null or empty text has the score of a text without words;
    equal texts have equal scores, repeated rows a row each; an empty table gives an empty result;
    columns that aren't named are ignored, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        words_vectors = vector_table(m)
        for b in batches:
            texts, langs = b.column(1).to_pylist(), b.column(2).to_pylist()
            got = [score_texts(m, words_vectors, texts[lo:hi]) for lo, hi in groups(texts, TOGETHER)]
            scores = np.concatenate(got) if got else np.zeros(0)
            cut = np.asarray([m.thresholds.get(str(x), 0.5) for x in langs])
            rest = [b.column(i) for i in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(scores >= cut), *rest], ["doc_id", "score", "rejected", *b.schema.names[3:]])

    cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.col("lang").cast("string"), *cols)
    more = "".join(f", _k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(run, "doc_id long, score double, rejected boolean" + more)
    return out.select("doc_id", "score", "rejected", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def without_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the rows that the classifier rejects, with docs' columns."""
    names = {f"_d{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    own = docs.select("doc_id", "text", "lang", *[quoted(c).alias(n) for n, c in names.items()])
    kept = score(own, fit(docs, labels, s), ("text", "lang", *names)).where("not rejected")
    back = {c: n for n, c in names.items()}
    return kept.select(*[quoted(back.get(c, c)).alias(c) for c in docs.columns])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
