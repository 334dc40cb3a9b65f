import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tarnlake.llm import near_dup as D
from tarnlake.llm.components import components


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    ids = {i for i, _ in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def check(docs, s=D.Settings()):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = D.near_duplicates(docs, s).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(t)) for _, t in rows)


def test_odd_rows(odd):
    check(odd)


def test_group_of_borderline_copies(docs_of):
    """Copies of one text with different numbers of edits: many pairs lie around the threshold."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{i}x{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    docs = docs_of(rows)
    check(docs)
    check(docs, D.Settings(block=16, few=4))  # groups whose blocks leave many pairs are compared by sets


def test_documents_that_only_look_alike(docs_of):
    """A long passage in common puts all into the same buckets; few of them are linked."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(100)]
    own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(passage + own(45 + i % 30))) for i in range(150)]
    rows += [(500 + i, rows[i][1] + " " + " ".join(own(8))) for i in range(0, 40, 2)]
    check(docs_of(rows))
    check(docs_of(rows), D.Settings(block=32, few=10_000))


def test_texts_of_one_id(docs_of):
    """An id with two texts is linked with the copies of both."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (9, a + " tail"), (9, b + " tail"), (9, c), (30, c), (31, "x y z"), (31, "x y z")]
    check(docs_of(rows))


def test_one_document_of_each_group_stays(odd):
    kept = D.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7]


def test_empty(none):
    assert D.near_duplicates(none).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    s = D.Settings()
    least = D.drop_below(s)
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(4000):
        eq = rng.random(s.checks) < 0.75
        lost += any(eq[: (k + 1) * s.batch].sum() < n for k, n in enumerate(least))
    assert lost / 4000 < 0.005
    assert least[-1] > 0.5 * s.checks


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_become_numbers_two_at_a_time():
    s, rng = D.Settings(few=0), np.random.default_rng(3)
    sigs = rng.integers(0, 256, (10, s.checks), np.uint8)
    sets = [np.arange(k, k + 40, dtype=np.uint64) for k in range(10)]
    kind = pa.struct([("doc_id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])
    left, right = ([{"doc_id": i, "component": i, "n": 40, "sig": sigs[i % 10].tobytes(), "shingles": sets[i % 10].tobytes()} for i in range(a, a + 60)] for a in (0, 100))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(range(rows)), *(pa.array([x] * rows, pa.list_(kind)) for x in (left, right))], ["at", "left", "right"])

    def peak(b):
        tracemalloc.start()
        got = list(D._alike(s)(iter([b])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x for g in got for x in g.column(0).to_pylist()] == b.column(0).to_pylist()
        return most

    few, many = batch(10), batch(300)
    peak(few)
    assert peak(many) < 3 * peak(few)

    links = {p for b in D._blocks(s)(iter([many.slice(2, 3).select(["left", "right"])])) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {(i, j) for i in range(60) for j in range(100, 160) if 100 * len(np.intersect1d(sets[i % 10], sets[j % 10])) >= 75 * len(np.union1d(sets[i % 10], sets[j % 10]))}
    assert links == want and len(want) > 100
