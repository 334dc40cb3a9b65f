"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class. A class has a MinHash signature; classes that
agree on all values of a band share a bucket. Buckets give candidates, signatures are compared
batch by batch, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below the chosen miss probability; what survives is decided exactly on
the full sets.

Candidates of a bucket are not all its pairs: first each member meets the bucket's centre, and
buckets whose members then are in one component need no more. What is still apart within a bucket
meets in blocks of bounded size, first by signatures with the same bounds; the few pairs that these
leave are decided on the full sets, and groups in which they leave many are compared exactly, block
by block. So a large group of near copies costs a few comparisons a member, a large group of
documents that only look alike costs signatures, no group's pairs are written, and no link between
components is given up but by the chosen miss probability.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.components import components
from tarnlake.llm.words import WordTable, free_name, ranges, words_of


@dataclass(frozen=True)
class Settings:
    """A pair at the threshold shares no band with probability (1 - percent**rows) ** bands, about
    2e-5; `miss` is the posterior below which a pair is dropped. Signatures are compared in blocks of
    `block` documents; two such blocks send up to `few` pairs to the exact check one by one, and
    groups with blocks that leave more are compared by their sets."""

    width: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    checks: int = 128
    batch: int = 16
    miss: float = 1e-4
    block: int = 1024
    few: int = 1024
    seed: int = 11


#: Bounds of a block of sets: documents, and bytes of their sets (one document may have more).
BLOCK_DOCS, BLOCK_BYTES = 256, 2_000_000
#: Bytes of texts of a batch that become Python's at a time.
TOGETHER = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; fewer words than width: one window."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def _permutations(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    k = s.bands * s.rows
    return (rng.integers(0, 1 << 31, k, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.int64).astype(np.uint32))


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest value of each multiply-shift permutation over the shingles."""
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(1), out=out)
    return out


def _slices(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices with about TOGETHER bytes in the columns named."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in texts)
        for lo, hi in ranges(sizes.tolist(), TOGETHER):
            yield batch.slice(lo, hi - lo)


def describe(s: Settings):
    """Arrow batches of (doc_id, text as bytes) to what banding needs of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_hashes)
        a, b = _permutations(s)
        salt = np.arange(s.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in _slices(batches, 1):
            n, low, high, sig, bands = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                sh = shingles(words.of(words_of(text)), s.width)
                n.append(len(sh))
                if not len(sh):
                    low.append(0), high.append(0), sig.append(b""), bands.append(None)
                    continue
                raw = sh.tobytes()
                both = _digest(raw)
                low.append(both[0]), high.append(both[1])
                m = signature(sh, a, b)
                sig.append((m[: s.checks] & np.uint32(0xFF)).astype(np.uint8).tobytes())
                key = salt.copy()
                for k in range(s.rows):
                    key = mixed(key + m[k :: s.rows])
                bands.append(key.view(np.int64))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set_low", "set_high", "sig", "bands"])

    return run


def _digest(raw: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def drop_below(s: Settings) -> np.ndarray:
    """For each number of values compared (a multiple of batch) the least number of equal values
    with which a pair goes on. The prior of the similarity is uniform; an 8-bit value is equal by
    chance with 1/256."""
    j = (np.arange(2000) + 0.5) / 2000
    p = j + (1 - j) / 256
    above = j >= s.percent / 100
    out = []
    for n in range(s.batch, s.checks + 1, s.batch):
        least = n + 1
        for m in range(n, -1, -1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            post = np.exp(log - log.max())
            if post[above].sum() / post.sum() < s.miss:
                break
            least = m
        out.append(least)
    return np.asarray(out)


def _prune(s: Settings):
    """Arrow batches of pairs with both signatures to the pairs that may reach the threshold."""
    least = drop_below(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, s.checks) for i in (2, 3))
            alive, equal = np.arange(n), np.zeros(n, np.int64)
            for k, need in enumerate(least):
                cols = slice(k * s.batch, (k + 1) * s.batch)
                equal[alive] += (sa[alive, cols] == sb[alive, cols]).sum(1)
                alive = alive[equal[alive] >= need]
                if not len(alive):
                    break
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(alive)) for i in (0, 1)], ["a", "b"])

    return run


def _confirm(s: Settings):
    """Arrow batches of (a, b, text of a, text of b) to the pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_hashes)
        last: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

        def of(doc: int, text: bytes) -> np.ndarray:
            key = (doc, zlib.crc32(text))
            if key not in last:
                last[key] = shingles(words.of(words_of(text)), s.width)
                if len(last) > 64:
                    last.popitem(last=False)
            last.move_to_end(key)
            return last[key]

        for batch in _slices(batches, 2, 3):
            keep = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def _sets(s: Settings):
    """Arrow batches of (doc_id, text) to doc_id and the shingle set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(word_hashes)
        for b in _slices(batches, 1):
            got = [shingles(words.of(words_of(t)), s.width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["doc_id", "shingles"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right."""
    out = np.zeros((len(left), len(right)), np.float64)
    l, r = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(l, r)

    def places(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    if not len(both):
        return out
    (lr, lc), (rr, rc) = places(left, l), places(right, r)
    for lo in range(0, len(both), step):
        a, b = (np.zeros((len(x), step), np.float32) for x in (left, right))
        for m, row, col in ((a, lr, lc), (b, rr, rc)):
            i, j = np.searchsorted(col, [lo, lo + step])
            m[row[i:j], col[i:j] - lo] = 1
        out += a @ b.T
    return out


def _blocks(s: Settings):
    """Arrow batches of two blocks of one group (their members' ids, components and sets) to the
    links between members of different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values for c in (0, 1)]  # two blocks at a time become numbers
                x, y = ([np.frombuffer(m, np.uint64) for m in side.field("shingles").to_pylist()] for side in sides)
                ids, parts = ([side.field(f).to_numpy() for side in sides] for f in ("doc_id", "component"))
                both = shared_counts(x, y)
                sizes = np.asarray([len(v) for v in x])[:, None] + np.asarray([len(v) for v in y])[None, :]
                link = (100 * both >= s.percent * (sizes - both)) & (parts[0][:, None] != parts[1][None, :])
                i, j = np.nonzero(link)
                a.append(ids[0][i]), b.append(ids[1][j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (a, b)], ["a", "b"])

    return run


def _alike(s: Settings):
    """Arrow batches of two blocks of one group (at, left, right; members with id, component,
    signature and size) to the pairs of different components that may reach the threshold; where
    there are more than s.few, only the group, with null ids."""
    least = drop_below(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, a, b = [], [], []
            for row in range(batch.num_rows):
                group, sides = batch.column(0)[row].as_py(), [batch.column(c)[row].values for c in (1, 2)]  # two blocks at a time become numbers
                ids, parts, sizes = ([side.field(f).to_numpy() for side in sides] for f in ("doc_id", "component", "n"))
                x, y = (np.frombuffer(b"".join(side.field("sig").to_pylist()), np.uint8).reshape(len(side), s.checks) for side in sides)
                alive = parts[0][:, None] != parts[1][None, :]
                alive &= 100 * np.minimum(sizes[0][:, None], sizes[1][None, :]) >= s.percent * np.maximum(sizes[0][:, None], sizes[1][None, :])
                equal = np.zeros(alive.shape, np.uint8)
                for k in range(s.batch):
                    equal += x[:, k, None] == y[None, :, k]
                i, j = np.nonzero(alive & (equal >= least[0]))
                equal = equal[i, j].astype(np.int64)
                for k, need in enumerate(least[1:], 1):
                    cols = slice(k * s.batch, (k + 1) * s.batch)
                    equal += (x[i, cols] == y[j, cols]).sum(1)
                    keep = equal >= need
                    i, j, equal = i[keep], j[keep], equal[keep]
                if len(i) > s.few:
                    at.append([group]), a.append([None]), b.append([None])
                elif len(i):
                    at.append([group] * len(i)), a.append(ids[0][i].tolist()), b.append(ids[1][j].tolist())
            flat = lambda v, t: pa.array([x for part in v for x in part], t)
            yield pa.RecordBatch.from_arrays([flat(at, batch.schema.field(0).type), flat(a, pa.int64()), flat(b, pa.int64())], ["at", "a", "b"])

    return run


def _in_blocks(rows: DataFrame, blocks: DataFrame, member: list[str]) -> DataFrame:
    """at, left, right: members of a group dealt into its number of blocks (at, blocks), each block
    with itself and with those after it."""
    dealt = rows.join(blocks, "at").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.repartition("at", "block")  # else the blocks of a group are gathered where the join put the group
    made = materialize(dealt.groupBy("at", "block", "blocks").agg(F.collect_list(F.struct(*member)).alias("left")))
    each = made.select("at", "left", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    return each.join(made.select("at", F.col("block").alias("other"), F.col("left").alias("right")), ["at", "other"]).select("at", "left", "right")


def _between(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame, verified, s: Settings) -> DataFrame:
    """Links that the comparisons with the centres didn't find: between members of one bucket that
    are still in different components.

    Buckets that overlap make one group where that means fewer comparisons than bucket by bucket.
    A group is dealt into blocks of bounded size, and blocks meet in tasks of their own."""
    rows = members.join(labels, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    keys = materialize(rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("doc_id").alias("low"), F.count("*").cast("double").alias("m")).where("x < y"))
    rows = materialize(rows.join(keys.select("key", "low", "m"), "key"))
    groups = components(rows.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    rows = rows.join(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    rows = materialize(rows)
    # small tables of their own: a join in the partitions of an aggregate can't split a large group
    cost = materialize(rows.groupBy("grp").agg(F.sum("m").alias("by_key"), F.approx_count_distinct("doc_id").cast("double").alias("n")))
    rows = rows.join(cost.select("grp", (F.col("n") * F.col("n") <= F.col("by_key")).alias("whole")), "grp")
    at = F.when(F.col("whole"), F.struct(F.lit(0).cast("long").alias("key"), "grp")).otherwise(F.struct("key", "grp"))
    rows = materialize(rows.select(at.alias("at"), "doc_id", "component").distinct())
    blocks = materialize(rows.groupBy("at").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")))
    described = rows.join(sigs.withColumnRenamed("n_shingles", "n"), "doc_id")
    pairs = _in_blocks(described, blocks, ["doc_id", "component", "sig", "n"])
    alike = materialize(pairs.mapInArrow(_alike(s), "at struct<key:long,grp:long>, a long, b long"))
    few = alike.where("a is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = verified(few)

    rows = materialize(rows.join(alike.where("a is null").select("at").distinct(), "at", "left_semi"))
    sets = materialize(texts.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(s), "doc_id long, shingles binary"))
    size = rows.join(sets.select("doc_id", F.length("shingles").alias("bytes")), "doc_id").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    blocks = materialize(size.select("at", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    pairs = _in_blocks(rows.join(sets, "doc_id"), blocks, ["doc_id", "component", "shingles"]).select("left", "right")
    exact = pairs.mapInArrow(_blocks(s), "a long, b long").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return found.union(exact).distinct()


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Words are runs between ASCII white space after A-Z became a-z. A null or empty text has no
    shingles and is linked with nothing. Rows that share a doc_id count as one document, linked with
    what any of their texts is linked with; a null doc_id has a null component and is kept. An empty
    table gives an empty result. Texts are read whole; other columns are ignored."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    base = materialize(raw.mapInArrow(describe(s), "doc_id long, n_shingles long, set_low long, set_high long, sig binary, bands array<long>"))
    some = base.where("n_shingles > 0 and doc_id is not null")
    copies = some.groupBy("set_low", "set_high").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = materialize(copies)
    copied = materialize(some.select("doc_id", "set_low", "set_high").join(copies, ["set_low", "set_high"]).where("doc_id <> rep").distinct())
    copy_edges = copied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    nodes = some.join(copied, ["doc_id", "set_low", "set_high"], "left_anti")

    keys = nodes.select("doc_id", F.explode("bands").alias("key"))
    full = materialize(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low"))
    members = materialize(keys.join(full, "key").distinct())  # key, doc_id, low: buckets of two documents at least
    active = members.select("doc_id").distinct()
    sigs = materialize(nodes.select("doc_id", "sig", "n_shingles").join(active, "doc_id", "left_semi").distinct())
    texts = materialize(raw.join(active, "doc_id", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a, b), distinct, to those that reach the threshold."""
        left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
        right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
        fit = f"100 * least(na, nb) >= {s.percent} * greatest(na, nb)"  # else the sizes alone rule it out
        both = pairs.join(right, "b").join(left, "a").where(fit).select("a", "b", "sa", "sb")
        likely = materialize(both.mapInArrow(_prune(s), "a long, b long").distinct())
        ta, tb = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
        held = likely.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
        return materialize(held.mapInArrow(_confirm(s), "a long, b long").distinct())

    tried = materialize(members.where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct())
    edges = verified(tried)
    edges = materialize(edges.union(_between(members, components(edges), sigs, texts, verified, s)))
    label = materialize(components(edges.union(copy_edges)))
    out = base.select("doc_id", "n_shingles").join(label, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without all but the first document of each group. Of equal rows one stays as well."""
    gone_id = free_name("_gone", docs)
    gone = near_duplicates(docs, s).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.dropDuplicates(["doc_id", "text"]).join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
