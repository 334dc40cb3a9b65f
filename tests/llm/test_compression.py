import random
import zlib

import numpy as np
import zstandard

from tarnlake.llm import compression as C

SMALL = C.Settings(dictionary=4096, max_docs_per_class=300)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(40, 300))
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "###" for x in w] if kind == 1 else [w[0]] * len(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(600, 1)
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = C.fit(docs, lab, SMALL)
    got = {r.doc_id: r.score for r in C.score(docs, model).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(labels[i][1]) for i in held) / len(held) > 0.95
    probability = np.mean([got[i] for i in held])
    assert abs(probability - np.mean([labels[i][1] for i in held])) < 0.1
    again = C.fit(docs.repartition(7), lab, SMALL)
    assert again == model


def test_sizes_are_those_of_all_blocks():
    rng = random.Random(2)
    texts = [rng.randbytes(40).hex().encode() * 20 for _ in range(60)]
    s = C.Settings(dictionary=2048, block=100)
    model = C.Model((C.dictionary_of(texts[:30], s), C.dictionary_of(texts[30:], s)), (0, 0, 0), s)
    of = C.measure(model)
    for t in [*texts[:5], b"", b"x", b"y" * 1001]:
        sizes = []
        for d in model.dictionaries:
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(8 + sum(len(z.compress(t[i : i + 100])) - 9 for i in range(0, len(t), 100)))
        difference, ratio = of(t)
        assert difference == (sizes[0] - sizes[1]) / sum(sizes) and np.isclose(ratio, np.log(sum(sizes) / 2 / (len(t) + 16)))
    assert of(None) == of(b"")


def test_logistic_has_no_gradient_left():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2)) * [3, 0.1] + [5, -1]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 5 + 20 * (x[:, 1] + 1))))).astype(float)
    w = np.asarray(C.logistic(x, y, ridge=0))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert abs((p - y).sum()) < 1e-6 and np.allclose(x.T @ (p - y), 0, atol=1e-6)
    assert C.logistic(x[:0], y[:0]) == (0.0, 0.0, 0.0)
    assert C.logistic(x, np.ones(500))[0] > 5


def test_odd_rows_have_scores(spark, odd, none):
    lab = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (C.fit(odd, lab, SMALL), C.fit(none, lab.limit(0), SMALL), C.fit(odd, lab.where("quality = 1"))):
        got = C.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        by = {}
        for r in got:
            by.setdefault(r.doc_id, []).append(r.score)
        assert by[1] == by[2] and by[5][0] == by[5][1] == by[4][0]
        assert C.score(none, model).count() == 0


def test_sample_is_whole_and_bounded(spark, docs_of, monkeypatch):
    rows = [(i, chr(97 + i) * n) for i, n in enumerate([10, 90, 30, 30, 30, 30, 30, 30])] + [(3, "a"), (3, None)]
    lab = spark.createDataFrame([(i, 1, 0) for i in range(8)] * 2, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(C, "train", lambda texts, labels, apart, s: seen.extend(texts))
    C.fit(docs_of(rows), lab, C.Settings(max_bytes=50, max_bytes_per_class=70))
    whole = {t for i, t in rows if t and zlib.crc32(str(i).encode()) % 5}
    assert seen and set(map(bytes.decode, seen)) <= whole and max(map(len, seen)) <= 50 and sum(map(len, seen)) <= 70
