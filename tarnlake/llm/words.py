"""Tables that a Python worker keeps of the words it has met, and passes over text batches.

Words are the runs of bytes between ASCII white space after A-Z became a-z. bytes.lower() and
bytes.split() do just that on UTF-8, so that texts arrive as binary columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    lo = size = 0
    for i, n in enumerate(sizes):
        size += n + 50
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def groups(texts: list[bytes | None], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` bytes each."""
    return ranges([len(t or b"") for t in texts], most)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


class WordTable:
    """Rows of numbers for words, computed once for a word as long as it is in the table.

    rows(words) gives the row numbers of all words; `values` holds the rows. A table that passes
    `limit` entries is emptied before the next call."""

    def __init__(self, make: Callable[[list[bytes]], np.ndarray], limit: int = 400_000):
        self.make, self.limit = make, limit
        self.at: dict[bytes, int] = {}
        self.values: np.ndarray | None = None
        self.used = 0

    def rows(self, words: list[bytes]) -> np.ndarray:
        if self.used > self.limit:
            self.at.clear()
            self.used = 0
        at = self.at
        new = list(set(words).difference(at))
        if new or self.values is None:
            fresh = self.make(new)
            need = self.used + len(new)
            if self.values is None:
                self.values = np.zeros((max(1024, need), *fresh.shape[1:]), fresh.dtype)
            elif need > len(self.values):
                grown = np.zeros((max(need, 2 * len(self.values)), *fresh.shape[1:]), fresh.dtype)
                grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : need] = fresh
            at.update(zip(new, range(self.used, need), strict=True))
            self.used = need
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        """The rows themselves."""
        at = self.rows(words)
        return self.values[at]


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, *tables: DataFrame) -> str:
    """name, or name with underscores after it, that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
