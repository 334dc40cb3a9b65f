"""Prefix tries of conversations: what is said by many of them before they part.

A turn is a digest of its role and text, a conversation the sequence of its turns' digests, and equal
sequences are one with a number of members. The sequences are dealt to tasks by their first turn's
digest, and each task builds its subtries as dictionaries of pointers. A first turn whose
conversations have too many turns for a task becomes a node of its own, and what follows it is dealt
by the next turn, and so on. Sums over subtrees run upwards: in a task from the last node made to the
first, as a child is always made after its parent; then level by level over the nodes that were split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize

#: Conversations that start alike are split by their next turn if they have more turns than this.
LIMIT = 50_000
#: Turns dealt to one group of subtries on average.
PER_GROUP = 10_000
NOBODY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def told(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as array<struct<turn, digest, words>>. Turns of the same number
    are in the order of their digests; a turn without a number comes first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    rows = rows.where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns of every conversation, its first h turns being those of conversation
    conv_id - conv_id % 20, where h is crc32(conv_id as text) % 4."""
    own = materialize(told(conversations))
    heads = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


ENDS = "seq binary, n long, low long, ends_sha256 string"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, conv_id) in order to a row per seq, with the digest of its conversations' ids."""
    seq, n, low, digest = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in ENDS.split(", ")])

    for b in batches:
        for s, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if s != seq:
                if n:
                    out.append((seq, n, low, digest.hexdigest()))
                seq, n, low, digest = s, 0, conv, hashlib.sha256()
            digest.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
        yield batch()
    if n:
        out.append((seq, n, low, digest.hexdigest()))
        yield batch()


def sequences(convs: DataFrame) -> DataFrame:
    """The distinct sequences of turns: path (16 bytes a turn), words by turn, n conversations that are
    this sequence, the smallest of them and the digest of all."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = convs.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = materialize(rows.withColumn("seq", F.unhex(F.md5("path"))))
    # The ids of a sequence go through one digest in their order, as they come, without being gathered.
    ends = rows.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_ends, ENDS)
    return ends.join(rows.withColumnRenamed("conv_id", "low"), ["seq", "low"]).drop("seq")


NODE = "level int, prefix binary, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _subtries(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes below the split nodes (level, prefix), from the sequences that go on from there."""
    pointers: dict[tuple, int] = {}  # (node or split node, digest) to the child
    parent, depth, n, low, words, ends, at = [], [], [], [], [], [], []
    group = group.sort_values("low")  # so that a node is made by its smallest conversation
    for level, prefix, path, counts, times, conv, sha in zip(*(group[c] for c in ("level", "prefix", "path", "words", "n", "low", "ends_sha256")), strict=True):
        here, node = (level, prefix), -1
        for d in range(level, len(counts)):
            digest = path[16 * d : 16 * d + 16]
            child = pointers.get((here, digest))
            if child is None:
                child = pointers[here, digest] = len(parent)
                parent.append(node)
                depth.append(d + 1)
                n.append(0)
                low.append(conv)
                words.append(int(counts[d]))
                ends.append(NOBODY)
                at.append((level, prefix))
            n[child] += times
            here = node = child
        ends[node] = sha
    size = len(parent)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * words[i]
        if parent[i] >= 0:
            children[parent[i]] += 1
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    up = pd.array([low[p] if p >= 0 else None for p in parent], "Int64")
    levels, prefixes = ([a[k] for a in at] for k in (0, 1))
    cols = (levels, prefixes, [p < 0 for p in parent], low, depth, up, n, children, leaves, saved, ends)
    return pd.DataFrame(dict(zip((f.split()[0] for f in NODE.split(", ")), cols, strict=True)))


def split(seqs: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """By level, the nodes too large for a task (the root is always one), and the sequences that go on
    below them through smaller ones. A sequence goes on as one of the level's first list until its
    next turn is that of `limit` turns at most, or of no other sequence."""
    rest = seqs.select(F.lit(b"").cast("binary").alias("prefix"), F.lit(None).cast("binary").alias("above"), "*")
    nodes, small = [], []
    while True:
        level = len(nodes)
        left = F.size("words") - level
        going = rest.where(left > 0).withColumn("next", F.substring("path", 16 * level + 1, 16))
        sizes = materialize(going.groupBy("prefix", "next").agg(F.sum(left).alias("turns"), F.count("*").alias("seqs")))
        own = rest.groupBy("prefix").agg(
            F.max("above").alias("above"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.max(F.when(left == 0, F.col("ends_sha256"))).alias("ends_sha256"),
            F.max(F.element_at("words", level) if level else F.lit(0)).cast("long").alias("words"),
        )
        both = own.unionByName(sizes.groupBy("prefix").agg(F.count("*").alias("n_children")), allowMissingColumns=True)  # one row of either for a prefix
        nodes.append(materialize(both.groupBy("prefix").agg(*[F.max(c).alias(c) for c in own.columns[1:]], F.coalesce(F.max("n_children"), F.lit(0)).alias("n_children"))))
        large = sizes.where((F.col("turns") > limit) & (F.col("seqs") > 1)).select("prefix", "next")
        small.append(going.join(large, ["prefix", "next"], "left_anti").withColumn("level", F.lit(level)))
        if large.isEmpty():
            return nodes, small
        below = F.unhex(F.md5(F.substring("path", 1, 16 * (level + 1))))
        rest = materialize(going.join(large, ["prefix", "next"], "left_semi").select(below.alias("prefix"), F.col("prefix").alias("above"), *seqs.columns))


def trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of convs (conv_id, turns as of told()): conv_id (the smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root alone. A row without conv_id belongs to no
    conversation; repeated rows are turns of their own. An empty table gives an empty result. What a
    task holds is bounded by `limit` turns, or one conversation's digests if that is longer."""
    seqs = materialize(sequences(convs))
    nodes, small = split(seqs, limit)
    rows = reduce(DataFrame.unionByName, small)
    turns = seqs.agg(F.sum(F.size("words"))).head()[0] or 0
    group = F.pmod(F.xxhash64("level", "prefix", "next"), F.lit(max(1, -(-turns // PER_GROUP)))).alias("group")
    rows = rows.select(group, "level", "prefix", "path", "words", "n", "low", "ends_sha256")
    built = materialize(rows.groupBy("group").applyInPandas(lambda g: _subtries(g), NODE))

    tops = built.where("top").groupBy("level", "prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    done: list[DataFrame] = []
    below = None
    for level in range(len(nodes) - 1, -1, -1):
        sums = tops.where(F.col("level") == level).drop("level")
        if below is not None:
            sums = sums.unionByName(below.select(F.col("above").alias("prefix"), "n_leaves", "saved_tokens"))
        sums = sums.groupBy("prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        own = nodes[level].join(sums, "prefix", "left")
        saved = F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")
        own = own.withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": saved, "ends_sha256": F.coalesce("ends_sha256", F.lit(NOBODY))})
        below = materialize(own)
        done.append(below.withColumns({"level": F.lit(level), "depth": F.lit(level).cast("long")}))
    splits = reduce(DataFrame.unionByName, done)
    places = splits.select("level", "prefix", F.col("conv_id").alias("up"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = places.select((F.col("level") + 1).alias("level"), F.col("prefix").alias("above"), F.col("up").alias("parent_conv_id"))
    upper = splits.join(parents, ["level", "above"], "left").select(cols)
    first = built.where("top").drop("parent_conv_id").join(places.withColumnRenamed("up", "parent_conv_id"), ["level", "prefix"]).select(cols)
    return upper.unionByName(first).unionByName(built.where("not top").select(cols))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
