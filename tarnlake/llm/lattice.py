"""Language-model scores by subword lattices.

A word's lattice has an arc for every piece of an existing vocabulary that spells a part of it,
and one arc for the whole word if training texts have it. The forward recursion sums over all
segmentations in log space and gives the word's marginal probability; a text's probability is the
product over its words and its end. A word is a piece with the start mark and pieces without, so
that the lattices of all words have a mass of at most 1; whole-word arcs and the end share the rest
of the mass, which is the share of training tokens seen more than once (Good-Turing).

The vocabulary's scores are the ranks of its pieces. They give the first probabilities, falling with
1 / rank (Zipf), and rounds of expectation-maximisation on the lattices of the training words fit
them: a round counts how often each piece is expected over all segmentations.

No word count passes through the driver or one task: a task turns its texts into blocks, each with
the block's distinct words; words meet their counts by a shuffle of (block, word), a row per word
and block however often it occurs there, and go back to the block's documents, which are kept as
word numbers. The piece table has as many rows as the vocabulary.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.words import groups

START = "▁"
#: Bytes of text in a block: larger blocks have fewer (block, word) rows and need more memory.
BLOCK_BYTES = 20_000_000
#: Training documents: crc32(doc_id as text) mod HELD_MOD isn't HELD_REST.
HELD_MOD, HELD_REST = 7, 2
LOG10 = math.log(10)
#: Rounds of expectation-maximisation, and what each piece has beside what is expected of it.
ROUNDS, PSEUDO = 1, 0.5
#: Characters of words whose expected counts are taken on probabilities.
SHORT = 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> tuple[list[str], list[float]]:
    """The vocabulary's pieces and their scores; unused and control ones are empty, bytes are <0x..>."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]


DOC, WORD = 0, 1
BLOCKED = "tag int, block long, doc_id long, held_out boolean, n_tokens long, words binary, times binary, word binary, at int, n long"
NAMES = [f.split()[0] for f in BLOCKED.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]] for f in BLOCKED.split(", ")]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held_out) to blocks: a row per document with the numbers and times of its
    words, and a row per distinct word with its number in the block and count in training texts."""
    base, k = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        ids, texts, held = (b.column(i).to_pylist() for i in range(3))
        for lo, hi in groups(texts, BLOCK_BYTES):
            block, k = base + k, k + 1
            at: dict[bytes, int] = {}
            seen = np.zeros(1024, np.int64)
            docs: tuple[list, ...] = ([], [], [], [], [])
            for doc, text, out in zip(ids[lo:hi], texts[lo:hi], held[lo:hi], strict=True):
                ws = text.lower().split() if text else []
                count = Counter(ws)
                index = np.fromiter((at.setdefault(w, len(at)) for w in count), np.int64, len(count))
                times = np.fromiter(count.values(), np.int64, len(count))
                if len(at) > len(seen):
                    seen = np.concatenate([seen, np.zeros(max(len(seen), len(at) - len(seen)), np.int64)])
                if not out:
                    seen[index] += times
                for c, v in zip(docs, (doc, out, len(ws) + 1, index.astype("<u4").tobytes(), times.astype("<u4").tobytes()), strict=True):
                    c.append(v)
            n, v = len(docs[0]), len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, DOC), TYPES[0]), pa.array(np.full(n, block), TYPES[1]), *(pa.array(c, t) for c, t in zip(docs, TYPES[2:7], strict=True)), *(pa.nulls(n, t) for t in TYPES[7:])], NAMES
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(v, WORD), TYPES[0]), pa.array(np.full(v, block), TYPES[1]), *(pa.nulls(v, t) for t in TYPES[2:7]), pa.array(list(at), TYPES[7]), pa.array(np.arange(v), TYPES[8]), pa.array(seen[:v])], NAMES
            )


def ranked(pieces: list[str], scores: list[float]) -> np.ndarray:
    """Probabilities that fall with 1 / rank by the scores, the highest first; empty pieces have none."""
    known = np.asarray([bool(p) for p in pieces])
    rank = np.empty(len(pieces))
    rank[np.argsort(-np.asarray(scores), kind="stable")] = np.arange(1, len(pieces) + 1)
    p = np.where(known, 1 / rank, 0.0)
    return p / max(p.sum(), 1e-300)


def _expect(pieces: list[str], sent):
    """Training words and counts to expected counts of pieces over all segmentations, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(pieces, sent.value), [0.0] * len(pieces)
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lattice.expect(w.decode("utf-8", "replace"), c, total)
        n = np.asarray(total)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["piece", "n"])

    return run


class Lattice:
    """Log probabilities of words under unigram pieces. Prefixes of pieces are in the table too,
    so that the arcs from a place end with the first string that begins no piece."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        """p: probabilities of the pieces, of sum 1 (0 for empty ones)."""
        logp = np.log(np.maximum(p, 1e-300))
        self.byte = [-30.0] * 256
        self.bytes_of: dict[str, float] = {}
        self.arcs: dict[str, float | None] = {}
        self.place: dict[str | int, int] = {}
        for i, (s, lp) in enumerate(zip(pieces, logp.tolist(), strict=True)):
            if s.startswith("<0x") and len(s) == 6:
                self.byte[int(s[3:5], 16)] = lp
                self.place[int(s[3:5], 16)] = i
            elif s:
                self.arcs[s] = lp
                self.place[s] = i
        for s in list(self.arcs):
            for k in range(1, len(s)):
                self.arcs.setdefault(s[:k], None)
        #: Probability and number of pieces, () for strings that only begin one.
        self.probable = {s: () if lp is None else (math.exp(lp), self.place[s]) for s, lp in self.arcs.items()}

    def expect(self, text: str, times: float, total: list[float]) -> None:
        """Adds to total how often each piece is expected in `times` words, by the forward and the
        backward recursion: on probabilities where a word is so short that none can vanish, else on
        their logarithms."""
        s = START + text
        n = len(s)
        if n <= SHORT and self._expect_short(s, times, total):
            return
        get, exp, log, inf = self.arcs.get, math.exp, math.log, math.inf
        ahead, arcs = [-inf] * (n + 1), [[] for _ in range(n)]
        ahead[0] = 0.0
        for i in range(n):
            a = ahead[i]
            lp = get(s[i], 0.0)
            out = [(i + 1, lp or self.spelled(s[i]), None if lp else s[i])]
            if lp != 0.0:
                for j in range(i + 2, n + 1):
                    lp = get(s[i:j], 0.0)
                    if lp:
                        out.append((j, lp, None))
                    elif lp is not None:
                        break
            arcs[i] = out
            for j, lp, _ in out:
                x, y = ahead[j], a + lp
                ahead[j] = y if x == -inf else (max(x, y) + log(1 + exp(-abs(x - y))))
        behind = [-inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            ways = [lp + behind[j] for j, lp, _ in arcs[i]]
            m = max(ways)
            behind[i] = m + log(sum([exp(v - m) for v in ways]))
            for (j, _, spelt), v in zip(arcs[i], ways, strict=True):
                e = times * exp(ahead[i] + v - ahead[n])
                if spelt is None:
                    total[self.place[s[i:j]]] += e
                else:
                    for byte in spelt.encode("utf-8", "replace"):
                        if byte in self.place:
                            total[self.place[byte]] += e

    def _expect_short(self, s: str, times: float, total: list[float]) -> bool:
        """expect() on probabilities; False, and nothing is added, if a character is spelled by bytes."""
        n, get = len(s), self.probable.get
        ahead, arcs = [0.0] * (n + 1), []
        ahead[0] = 1.0
        for i in range(n):
            a, out = ahead[i], []
            got = get(s[i])
            if not got:
                return False
            for j in range(i + 1, n + 1):
                if j > i + 1:
                    got = get(s[i:j])
                    if got is None:
                        break
                    if not got:
                        continue
                ahead[j] += a * got[0]
                out.append((j, got))
            arcs.append(out)
        if ahead[n] < 1e-280:
            return False
        behind = [0.0] * n + [times / ahead[n]]
        for i in range(n - 1, -1, -1):
            b, a = 0.0, ahead[i]
            for j, (p, k) in arcs[i]:
                way = p * behind[j]
                b += way
                total[k] += a * way
            behind[i] = b
        return True

    def word(self, text: str) -> float:
        """Forward recursion over the word with its start mark: what arrives at a place is summed
        when its own arcs are followed. A character that is no piece is spelled by its bytes."""
        s = START + text
        n = len(s)
        arrived: list[list[float]] = [[] for _ in range(n + 1)]
        arrived[0].append(0.0)
        get, exp, log = self.arcs.get, math.exp, math.log
        for i in range(n):
            x = arrived[i]
            if len(x) == 1:
                a = x[0]
            else:
                m = max(x)
                a = m + log(sum([exp(v - m) for v in x]))
            lp = get(s[i], 0.0)
            arrived[i + 1].append(a + (lp or self.spelled(s[i])))
            if lp == 0.0:
                continue
            for j in range(i + 2, n + 1):
                lp = get(s[i:j], 0.0)
                if lp:
                    arrived[j].append(a + lp)
                elif lp is not None:
                    break
        m = max(arrived[n])
        return m + log(sum([exp(v - m) for v in arrived[n]]))

    def spelled(self, char: str) -> float:
        lp = self.bytes_of.get(char)
        if lp is None:
            lp = self.bytes_of[char] = sum(self.byte[c] for c in char.encode("utf-8", "replace"))
        return lp


def _lattice(pieces: list[str], sent):
    """Words with counts to words with counts and the log probability of their lattices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, sent.value)
        for b in batches:
            lp = [lattice.word(w.decode("utf-8", "replace")) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lp, pa.float64())], ["word", "c", "lattice"])

    return run


def score(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Tokens are the words (runs between ASCII white space, A-Z as a-z) and one end. base_score adds
    log10((c + 1) / (N + V + 1)) over the tokens; score is log10 of
    (1 - u) c / N + u L for each word and (1 - u) c / N for the end, L the word's lattice and u the
    share of training tokens that occur once. Null and empty texts are an end only; a null doc_id
    isn't held out; repeated rows count each. Without training rows the end has 1/2, words L / 2.
    An empty table gives an empty result; other columns are ignored."""
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(key.cast("string")) % HELD_MOD == HELD_REST, F.lit(False))
    blocks = materialize(docs.select(key.alias("doc_id"), F.col("text").cast("binary").alias("text"), held.alias("held_out")).mapInArrow(_block, BLOCKED))
    texts = blocks.where(f"tag = {DOC}").select("block", "doc_id", "held_out", "n_tokens", "words", "times")
    words = blocks.where(f"tag = {WORD}").select("block", "word", "at", "n")
    counts = materialize(words.groupBy("word").agg(F.sum("n").alias("c")))
    ends = texts.where("not held_out").count()
    sums = counts.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    total = int(sums["n"] or 0) + ends
    types = int(sums["v"] or 0) + (ends > 0)
    unseen = min(0.5, max((sums["once"] or 0), 1) / total) if total else 0.5

    pieces, scores = pieces_of(path)
    p = ranked(pieces, scores)
    for _ in range(rounds if total > ends else 0):
        sent = spark.sparkContext.broadcast(p)
        each = counts.where("c > 0").select("word", "c").mapInArrow(_expect(pieces, sent), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        p = np.where(p > 0, PSEUDO, 0.0)
        for r in each.collect():  # a row per piece of the vocabulary at most
            p[r["piece"]] += r["n"]
        p /= p.sum()
    sent = spark.sparkContext.broadcast(p)
    scored = counts.mapInArrow(_lattice(pieces, sent), "word binary, c long, lattice double")
    base = F.log10((F.col("c") + 1) / F.lit(float(total + types + 1)))
    lat = F.col("lattice") / LOG10 + math.log10(unseen)
    seen = F.log10(F.col("c") * F.lit((1 - unseen) / max(total, 1)))
    mixed = F.when(F.col("c") == 0, lat).otherwise(F.greatest(seen, lat) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(seen - lat))))
    scored = scored.select("word", F.col("c").alias("c"), base.alias("base"), mixed.alias("score"))
    back = words.select("block", "word", "at").join(scored, "word").select("block", "at", (F.col("c") > 0).alias("known"), "base", "score")

    end_base = math.log10((ends + 1) / (total + types + 1))
    end_score = math.log10((1 - unseen) * (ends / total if ends else 1.0))
    end_known = int(ends > 0)

    def add(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        n = len(table)
        at = table["at"].to_numpy(np.int64)
        cols = np.zeros((3, n))
        cols[0, at], cols[1, at], cols[2, at] = table["known"], table["base"], table["score"]
        out = np.empty((3, len(docs)))
        for i, (w, t) in enumerate(zip(docs["words"], docs["times"], strict=True)):
            out[:, i] = cols[:, np.frombuffer(w, "<u4")] @ np.frombuffer(t, "<u4").astype(np.float64)
        return pd.DataFrame({
            "doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": out[0].astype(np.int64) + end_known,
            "train_tokens": total, "base_score": out[1] + end_base, "score": out[2] + end_score,
        })

    texts = texts.withColumnRenamed("block", "of_block")
    return texts.groupBy("of_block").cogroup(back.groupBy("block")).applyInPandas(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
