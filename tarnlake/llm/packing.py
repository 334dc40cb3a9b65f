"""Best-fit packing by minimum bin slack.

Documents become token ids plus one end id; ids beyond the capacity are cut into pieces of the
capacity, and the pieces go into as few sequences as possible. A sequence is filled by the
combination of available lengths that leaves the least slack: the longest available piece seeds
it and a bitset subset-sum over the available lengths fills the rest. Which document has a length
doesn't matter for that, so the search runs on the histogram of lengths, which has at most
`capacity` entries whatever the corpus, and one found combination is used as often as its lengths
last. Every piece then finds its place by arithmetic from its rank among the pieces of its length.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize
from tarnlake.llm.words import ranges

CAPACITY = 2048
END_ID = 0
#: Entries a worker's table of known words may hold (about 0.2 kB each); the rest is encoded again.
WORD_CACHE = 1_100_000
#: Seconds that a worker keeps its table of words when no task asks for it.
IDLE = 10.0
#: Bytes of texts encoded together.
TOGETHER = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian uint32 bytes, with a table of words already encoded.

    The tokenizer drops white space and never merges across it, so that a text's ids are those of
    its words one after the other. A word's trailing ASCII punctuation is a token run of its own
    where the normalised word before it ends in a letter or digit. Texts with the mark of a special token go through
    the tokenizer whole."""

    PUNCT = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    BATCH = 4000

    def __init__(self, path: str, limit: int = WORD_CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.ends: dict[str, bool] = {}
        self.mark = self.tok.token_to_id("<|endoftext|>")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words. Those of letters only are one run of the tokenizer's each, so that the numbers of
        the runs part their ids; between others stands the mark of a special token."""
        out: dict[bytes, bytes] = {}
        texts = [w.decode() for w in words]
        letters = [t.isalpha() for t in texts]
        for plain in (True, False):
            some = [(w, t) for w, t, x in zip(words, texts, letters, strict=True) if x == plain]
            for i in range(0, len(some), self.BATCH):
                part = some[i : i + self.BATCH]
                if not (plain and self._runs(part, out)):
                    self._marked(part, out)
        return out

    def _runs(self, part: list[tuple[bytes, str]], out: dict[bytes, bytes]) -> bool:
        """Whether each word is one run; if so their ids are put into out."""
        got = self.tok.encode(" ".join(t for _, t in part), add_special_tokens=False)
        ids, runs = np.asarray(got.ids, "<u4").tobytes(), np.asarray(got.word_ids)
        if runs[-1] != len(part) - 1:
            return False
        edges = (4 * np.searchsorted(runs, np.arange(len(part) + 1))).tolist()
        out.update((w, ids[a:b]) for (w, _), a, b in zip(part, edges, edges[1:]))  # noqa: B905
        return True

    def _marked(self, part: list[tuple[bytes, str]], out: dict[bytes, bytes]) -> None:
        ids = np.asarray(self.tok.encode(" <|endoftext|> ".join(t for _, t in part), add_special_tokens=False).ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        start = 0
        for (w, _), end in zip(part, ends.tolist(), strict=True):
            out[w] = ids[start:end].tobytes()
            start = end + 1

    def _apart(self, letter: str) -> bool:
        """Whether the tokenizer parts punctuation from a word that ends in letter: it does where the last
        code point of the normalised word is a letter or digit, which lower case or decomposition may undo."""
        if letter not in self.ends:
            parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(letter + "."))
            self.ends[letter] = parts[-1][0] == "."
        return self.ends[letter]

    def _stem(self, word: bytes) -> tuple[bytes, bytes]:
        stem = word.rstrip(self.PUNCT)
        if stem and len(stem) < len(word) and self._apart(stem[-4:].decode(errors="ignore")[-1]):
            return stem, word[len(stem) :]
        return word, b""

    def _words(self, text: bytes) -> list[bytes]:
        """The text's words, in lower case where that can't change what marks after a letter compose to."""
        return (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, without an end id. New words join the table; what it has no room for
        leaves it when the texts are done."""
        known = self.known
        docs = [None if b"<|" in t else self._words(t) for t in texts]
        missing: set[bytes] = set()
        for words in docs:
            if words:
                missing.update(filterfalse(known.__contains__, words))
        before = len(known)
        if missing:
            parts = {w: self._stem(w) for w in missing}
            known.update(self._encode([a for a in {a for two in parts.values() for a in two} if a and a not in known]))
            known.update((w, known[a] + known[b]) for w, (a, b) in parts.items() if b)
        ids = known.__getitem__
        out = [self.whole(text.decode()) if words is None else b"".join(map(ids, words)) for text, words in zip(texts, docs, strict=True)]
        if len(known) > max(self.limit, before):
            for w in list(islice(reversed(known), len(known) - max(self.limit, before))):
                del known[w]
        return out


_coders: dict[str, WordEncoder] = {}
_lock = threading.Lock()
_uses = 0


def _let_go(use: int) -> None:
    with _lock:
        if use == _uses:
            _coders.clear()
            pa.default_memory_pool().release_unused()


@contextmanager
def _coder(path: str) -> Iterator[WordEncoder]:
    """The worker's encoder. Workers outlive tasks, and with them the table of words, so that the next task
    of the stage has it; but they outlive the stage as well, so that what no task takes up within IDLE
    seconds goes."""
    global _uses
    with _lock:
        _uses += 1
        if path not in _coders:
            _coders[path] = WordEncoder(path)
        coder = _coders[path]
    try:
        yield coder
    finally:
        del coder
        with _lock:
            _uses += 1
            timer = threading.Timer(IDLE, _let_go, [_uses])
        timer.daemon = True
        timer.start()


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    """Arrow batches of (doc_id, text as UTF-8 bytes) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _coder(path) as coder:
            end = np.asarray([end_id], "<u4").tobytes()
            width = 4 * capacity
            for batch in batches:
                sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                for lo, hi in ranges(sizes, TOGETHER):  # the rest of a batch stays in Arrow's memory
                    ids, texts = (batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1))
                    cols: list[list] = [[], [], [], [], []]
                    raw = []
                    for doc, body in zip(ids, coder.batch([t or b"" for t in texts]), strict=True):
                        body += end
                        for k, at in enumerate(range(0, len(body), width)):
                            part = body[at : at + width]
                            for c, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                                c.append(v)
                            if with_ids:
                                raw.append(np.frombuffer(part, "<u4").astype("i4"))
                    out = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                    if with_ids:
                        out.append(pa.array(raw, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(out, names)

    return run


def fill_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram: [({length: times in a sequence}, sequences), ...].

    The longest available length seeds a sequence; `reach` is the bitset of sums that the lengths
    seen so far can make, each at most as often as it is available."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    out = []
    order = sorted(left, reverse=True)
    while order:
        seed = order[0]
        room = capacity - seed
        target, mask = 1 << room, (1 << (room + 1)) - 1
        reach, layers = 1, []
        for n in order:
            if n > room or reach & target:
                continue
            have = min(left[n] - (n == seed), room // n)
            take = 1
            while have > 0:
                k = min(take, have)
                layers.append((n, k, reach))
                reach |= (reach << (n * k)) & mask
                have -= k
                take *= 2
                if reach & target:
                    break
        at = reach.bit_length() - 1
        use = {seed: 1}
        for n, k, before in reversed(layers):
            if not (before >> at) & 1:
                use[n] = use.get(n, 0) + k
                at -= n * k
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
        out.append((use, times))
        if any(not left[n] for n in use):
            order = [n for n in order if left[n]]
    return out


def layout(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, times in a sequence, first sequence, first offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for use, times in patterns:
        offset = 0
        for n, k in use.items():
            rows.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return {n: np.asarray(r, "i8") for n, r in rows.items()}


def _place(places) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            sequence, offset = np.zeros(len(rank), "i8"), np.zeros(len(rank), "i8")
            for n in np.unique(length):
                sel = np.flatnonzero(length == n)
                rows = at[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[sel], "right") - 1]
                i = rank[sel] - row[:, 0]
                sequence[sel] = row[:, 2] + i // row[:, 1]
                offset[sel] = row[:, 3] + i % row[:, 1] * n
            keep = [c for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most `capacity` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.
    A null or empty text is one piece of length 1 (the end id). Documents longer than the capacity
    are cut, no other. Repeated rows and equal doc_ids are each packed; a null doc_id stays null.
    An empty table gives an empty result. Other columns are ignored.

    One pass over the texts; what follows shuffles about 40 bytes a piece. The ranks of a length
    are numbered in sqrt(count) groups, so that neither a common length nor the table of group
    sizes meets in one task."""
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids array<int>" if with_ids else "")
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_cut(path, capacity, end_id, with_ids), schema)
    pieces = materialize(cut)
    spark = docs.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(layout(fill_bins(counted, capacity)))
    groups = spark.createDataFrame([(n, max(1, int(c**0.5))) for n, c in counted.items()], "length long, groups int")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups")))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.select(*cols, "rank").mapInArrow(_place(places), schema + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
