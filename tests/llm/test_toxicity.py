import random

import numpy as np
import pandas as pd
import pytest

from tarnlake.llm import toxicity as X
from tarnlake.llm.words import words_of

SMALL = X.Settings(buckets=1 << 12, max_docs_per_class=200, epochs=12)


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"word{rng.randrange(200)}" for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Vilest,", "rotter", "SCOUNDREL!!"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(700, 1)
    docs, lab = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.fit(docs, lab, SMALL)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    held = [i for i, _, _ in labels if X.zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i].score >= 0.5) == bool(labels[i][2]) for i in held) / len(held)
    assert right > 0.95
    kept = X.without_toxic(docs, lab, SMALL)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_odd_rows_have_scores(spark, odd, none):
    lab = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.fit(odd, lab, SMALL)
    got = X.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert X.score(none, model).count() == 0
    nothing = X.fit(none, lab.limit(0), SMALL)
    assert X.score(odd, nothing).count() == odd.count()


def test_batches_score_as_single_texts():
    rng = np.random.default_rng(0)
    m = X.train([X.word_rows([b"a", b"b"], 64), X.word_rows([b"c"], 64)] * 4, np.asarray([1.0, 0.0] * 4), X.Settings(buckets=64, min_docs=1, epochs=2))
    texts = [b"", b"a b c", b"c", b" ".join(rng.choice([b"a", b"b", b"c"], 50).tolist()), None]
    together = X.score_texts(m, X.vector_table(m), texts)
    alone = [X.score_texts(m, X.vector_table(m), [t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6) and together[0] == together[4]


def test_sample_is_whole_and_bounded(spark, docs_of, monkeypatch):
    texts = [(1, "a " * 10), (2, "b " * 90), (3, "c " * 30), (4, "d " * 30), (6, "e " * 30), (7, "f " * 30)]
    lab = spark.createDataFrame([(i, 1, 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    ids = {i for i, _ in texts if X.zlib.crc32(str(i).encode()) % 5}
    seen = []
    monkeypatch.setattr(X, "train", lambda rows, y, s: seen.extend(rows) or X.Model(np.zeros((4, 2)), [], [], np.zeros(0), 0.0))
    monkeypatch.setattr(X, "vectors", lambda rows, *_: seen.extend(rows) or (None, None, None, None))
    monkeypatch.setattr(X, "forward", lambda *_: (np.zeros(len(seen)), []))
    monkeypatch.setattr(X, "calibrate", lambda *_: (0.0, {}))
    X.fit(docs_of(texts), lab, X.Settings(max_words=50, max_words_per_class=70))
    lengths = sorted(len(r) for r in seen)
    whole = {i: len(t.split()) for i, t in texts}
    assert lengths and set(lengths) <= {whole[i] for i in ids} and max(lengths) <= 50 and sum(lengths) <= 70


def plain_logit(m, text):
    """Word by word, filter by filter, place by place."""
    rows = [sum(m.table[r] for r in X.word_rows([w], len(m.table))[0]) for w in (text or b"").lower().split()]
    rows = rows or [np.zeros(m.table.shape[1])]
    z = m.bias
    at = 0
    for kernel, bias in zip(m.kernels, m.biases, strict=True):
        width = kernel.shape[0] // m.table.shape[1]
        for f in range(kernel.shape[1]):
            best = -np.inf
            for i in range(len(rows)):
                window = [rows[i + k] if i + k < len(rows) else np.zeros(m.table.shape[1]) for k in range(width)]
                best = max(best, float(np.concatenate(window) @ kernel[:, f]))
            z += max(0.0, best + bias[f]) * m.out[at]
            at += 1
    return z


def small_model(seed=3):
    rng = np.random.default_rng(seed)
    return X.Model(rng.normal(size=(32, 4)), [rng.normal(size=(4 * w, 3)) for w in (1, 2, 3)], [rng.normal(size=3) for _ in range(3)], rng.normal(size=9), 0.3)


def test_forward_against_a_plain_convolution():
    m = small_model()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["up", "Down,", "left!", "right", "\u00e9t\u00e9"]) for _ in range(n)).encode() for n in (0, 1, 2, 3, 7, 30)] + [None]
    got = X.score_texts(m, X.vector_table(m), texts)
    want = [1 / (1 + np.exp(-plain_logit(m, t))) for t in texts]
    assert np.allclose(got, want, atol=1e-5)


def test_one_step_of_training_follows_the_numeric_gradient(monkeypatch):
    """A step of Adagrad moves a weight by rate * g / sqrt(1e-3 + g^2): g is the gradient of the log loss."""
    start = small_model()
    texts = [X.word_rows(t.split(), 32) for t in (b"up down left", b"right up", b"left", b"down down right up")]
    y = np.asarray([1.0, 0.0, 0.0, 1.0])
    made = iter([start.table, *start.kernels, start.out])
    monkeypatch.setattr(X.np.random, "default_rng", lambda seed: type("R", (), {"normal": lambda self, *a: next(made).copy(), "permutation": lambda self, n: np.arange(n)})())
    s = X.Settings(buckets=32, dim=4, filters=3, min_docs=1, epochs=1, batch=4, rate=1e-4)
    zero = [np.zeros(3), np.zeros(3), np.zeros(3)]
    after = X.train(texts, y, s)

    def loss(out, kernels):
        m = X.Model(start.table.astype(np.float32), [k.astype(np.float32) for k in kernels], zero, out, 0.0)
        x, _, at, n = X.vectors(texts, m.table, 2)
        z = X.forward(m, x.astype(np.float64), at, n)[0]
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))  # both classes have half of the rows

    base = start.out.astype(np.float64)
    for i in range(9):
        up, down = base.copy(), base.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        g = (loss(up, start.kernels) - loss(down, start.kernels)) / 2e-4
        assert np.isclose(after.out[i] - base[i], -s.rate * g / np.sqrt(1e-3 + g**2), rtol=0.02, atol=1e-7)


def test_all_labelled_rows_are_learned(spark, docs_of):
    """More rows of a class, and longer ones, than any sample had: words that only the last of them have decide."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(8)) + (" vilest" if i % 4 == 0 else "")) for i in range(3600)]
    rows += [(10_000 + i, "calm " * 26_000 + "scoundrel") for i in range(8)]
    lab = spark.createDataFrame([(i, 1, int("vilest" in t or "scoundrel" in t)) for i, t in rows], "doc_id long, quality int, toxic int")
    s = X.Settings(buckets=1 << 12, epochs=3, shard_words=60_000)
    model = X.fit(docs_of(rows), lab, s)
    assert np.any(model.table[X.word_rows([b"scoundrel"], s.buckets)[0, 0]])
    again = X.fit(docs_of(rows).repartition(5), lab, s)
    assert np.array_equal(model.table, again.table) and model.bias == again.bias and model.thresholds == again.thresholds
    got = {r.doc_id: r.score for r in X.score(docs_of(rows), model).collect()}
    held = [(i, "vilest" in t) for i, t in rows[:3600] if X.zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bad for i, bad in held) / len(held) > 0.95


@pytest.mark.parametrize("broken", [b"", b"\xff\xfeab cd\x1ce"])
def test_words_at_once_as_one_by_one(broken):
    texts = [b"  A b\t\tC\x0b d ", None, b"", "\u00e9t\u00e9!! stra\u00dfe \U0001f600\U0001f600x".encode(), b"'x' -- " + b"y" * 100 + b" " + b"Y" * 32 + b" " + b"y" * 33, b" \x00z", b"b A", broken]
    counts, which, distinct = X.numbered(texts)
    words = [w for t in texts for w in words_of(t)]
    assert counts.tolist() == [len(words_of(t)) for t in texts] and len(distinct) == len(set(words))
    assert np.array_equal(X.word_rows_at_once(distinct, 1 << 18)[which], X.word_rows(words, 1 << 18))
    nothing = X.numbered([None, b" "])
    assert nothing[0].tolist() == [0, 0] and X.word_rows_at_once(nothing[2], 64).shape == (0, 3)


def shards_of(n, s, seed=2):
    rng = np.random.default_rng(seed)
    rows = [rng.integers(0, s.buckets, (30, 3)).astype("<i4") for _ in range(n)]
    return pd.DataFrame({"shard": np.sort(rng.integers(0, 3, n)), "toxic": rng.integers(0, 2, n), "rows": [r.tobytes() for r in rows]})


def sent_model(s):
    model = X.started(np.random.default_rng(s.seed), s)
    return type("Sent", (), {"value": (model, X.Sums.before(model, np.zeros(s.buckets, bool)))})()


def test_an_epoch_sends_a_row_per_block():
    """Not a row of ten numbers per slot: that took several times the input's disk and the driver's memory."""
    s = X.Settings(buckets=1 << 14)
    sent = sent_model(s)
    got = pd.concat(X.one_epoch(sent, 0, 0.5, s)(iter([shards_of(90, s)])))
    assert got["part"].tolist() == [p for p in range(3) for _ in range(5)]  # four blocks of the table, one of all else
    size = got[["slots", "n", "change"]].map(len).to_numpy().sum()
    assert size <= 42 * (got["slots"].map(len).sum() // 2)
    once = [X.added_up(g, s.dim + 1) for _, g in got.groupby("block")]
    assert all(len(x) == 1 for x in once)
    n = np.concatenate([np.frombuffer(x["n"][0], "<i4") for x in once])
    assert set(n.tolist()) <= {1, 2, 3} and set(n[-80:].tolist()) == {3}
    whole = sum(np.frombuffer(c, "<f4").astype(float).sum() for c in got["change"])
    assert np.isclose(whole, sum(np.frombuffer(x["change"][0], "<f4").astype(float).sum() for x in once), atol=1e-2)
    shuffled = got.sample(frac=1, random_state=1)
    assert all(X.added_up(g, s.dim + 1)["change"][0] == x["change"][0] for (_, g), x in zip(shuffled.groupby("block"), once, strict=True))


def test_a_long_shard_is_learned_in_runs(monkeypatch):
    """All of its rows, in their order, and never more than a run at a time, however they arrive."""
    s = X.Settings(buckets=1 << 12, shard_words=200)
    rows, seen = shards_of(60, s), []
    rows["shard"] = 0
    monkeypatch.setattr(X, "learn", lambda m, own, texts, y, w, order, s: seen.append([t.tobytes() for t in texts]))
    list(X.one_epoch(sent_model(s), 0, 0.5, s)(iter([rows[:7], rows[7:20], rows[20:]])))
    assert [t for r in seen for t in r] == rows["rows"].tolist() and max(map(len, seen)) == 10
