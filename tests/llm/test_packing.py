import random
import time
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarnlake.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")


def test_fill_bins_is_feasible_and_tight():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        n = rng.randint(1, 200)
        counts[n] = counts.get(n, 0) + 1
    plan = P.fill_bins(counts, 200)
    used = {}
    for use, times in plan:
        assert sum(n * k for n, k in use.items()) <= 200
        for n, k in use.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    least = -(-sum(n * c for n, c in counts.items()) // 200)
    least = max(least, sum(c for n, c in counts.items() if n > 100))
    assert sum(t for _, t in plan) <= 1.01 * least


def test_fill_bins_finds_the_fullest_combination():
    assert P.fill_bins({7: 1, 6: 1, 4: 2, 3: 1}, 10)[0][0] == {7: 1, 3: 1}
    assert P.fill_bins({}, 10) == []
    with pytest.raises(ValueError):
        P.fill_bins({11: 1}, 10)


@pytest.mark.parametrize("text", ["", "Hello, World! It's 1999... naïve café", "a<|endoftext|>b", "don't -- x--y 3.14 ((()))", "ÉTÉ İstanbul ß́ é!", "\x85 \xa0nbsp x", "'tis 's x's' ll'll", "...", "日本語。テスト!!"])
def test_words_encode_as_the_whole_text(text):
    coder = P.WordEncoder(P.default_tokenizer())
    for _ in range(2):
        assert coder.batch([text.encode()])[0] == coder.whole(text)


MARKS = "".join(map(chr, range(0x300, 0x345))) + "\u093c\u09bc\u0a3c\u0b3c\u05bc\u0f39\u0327"


def agree(texts):
    coder = P.WordEncoder(P.default_tokenizer())
    want = coder.tok.encode_batch(texts, add_special_tokens=False)
    got = coder.batch([t.encode() for t in texts])
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != np.asarray(b.ids, "<u4").tobytes()] == []


def test_every_last_letter_before_punctuation():
    marks = P.WordEncoder.PUNCT.decode() + "'"
    chars = [c for c in map(chr, range(1, 0x32000)) if not 0xD800 <= ord(c) < 0xE000]
    agree([f"x{c}{marks[ord(c) % len(marks)]}" for c in chars])
    agree([f"{c}." for c in chars if c.isalpha()])


def test_random_words_of_letters_that_decompose():
    rng = random.Random(6)
    letters = "İIiJjHTWYKſßéÉñ\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f\u09dc\u09dd\u09df\u0a33\u0a36\ufb2a\ufb4b\u0f43\u0f69\u1fb3\u212a\u2126\uac00\u1100\u1161aBc19²½"
    some = [letters, letters, MARKS, ".,;:!?()'\"-#$<>|~", " \u00a0\u0085\x1c\x01\t"]
    agree(["".join(rng.choice(rng.choice(some)) for _ in range(rng.randint(1, 14))) for _ in range(30_000)])


def test_pack_matches_the_tokenizer(odd):
    got = P.pack(odd).toPandas()
    tok = tokenizers.Tokenizer.from_file(P.default_tokenizer())
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r.doc_id, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    have = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have, key=key) == sorted(want, key=key)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(np.cumsum([0, *g.length])[:-1]) and g.length.sum() <= 2048


def test_pack_empty(none):
    assert P.pack(none).count() == 0


def test_an_idle_worker_lets_go_of_its_table(monkeypatch):
    monkeypatch.setattr(P, "IDLE", 0.5)
    path = P.default_tokenizer()
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"some words"])], ["doc_id", "text"])
    task = P._cut(path, 16, 0, False)
    first = next(task(iter([batch])))
    assert list(task(iter([batch]))) == [first]
    kept = weakref.ref(P._coders[path])
    list(task(iter([batch])))
    assert P._coders[path] is kept()  # the next task has it
    until = time.monotonic() + 20
    while P._coders and time.monotonic() < until:
        time.sleep(0.05)
    assert not P._coders
    assert list(task(iter([batch]))) == [first]
