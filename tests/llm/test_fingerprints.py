import hashlib

from tarnlake.llm import fingerprints as S


def test_edits(odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = S.edits(odd).collect()
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((-1 if i is None else i, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got if r.doc_id in (4, 5)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_edges(docs_of, none):
    one = S.edits(docs_of([(3, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    assert S.edits(none).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(S.BITS) for _ in range(40)]
    every = list(base)
    for b in base:
        for d in range(1, 7):
            x = b
            for bit in rng.sample(range(S.BITS), d):
                x ^= 1 << bit
            every.append(x)
    rows = [(i, f"{x:0{S.BITS // 4}x}") for i, x in enumerate(every)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in S.within_radius(df.where("doc_id < 40"), df).collect()}
    hexes = {f for _, f in rows}
    want = {(q, f, (int(q, 16) ^ int(f, 16)).bit_count()) for _, q in rows[:40] for f in hexes}
    assert got == {x for x in want if x[2] <= S.RADIUS}


def test_null_ids_and_fingerprints(spark):
    df = spark.createDataFrame([(None, "0" * 32), (None, "0" * 32), (4, "f" * 32), (5, None)], "doc_id long, fingerprint string")
    got = sorted((r.query, r.n_docs, r.first_doc) for r in S.within_radius(df, df).collect())
    assert got == [("0" * 32, 2, None), ("f" * 32, 1, 4)]


def test_more_ranges_than_documents(docs_of):
    """Neighbours across ranges, with many rows of one id."""
    rows = [(i // 3, f"text {i} " + "word " * (i % 7)) for i in range(100)]
    got = {(r.doc_id, r.edited_sha256) for r in S.edits(docs_of(rows).repartition(9)).collect()}
    rows.sort()
    want = set()
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        want.add((i, hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    assert got == want


def test_bits_against_a_plain_vote():
    """Each word votes on every bit by its hash's with weight 1, each pair of neighbours with the pair's."""
    import numpy as np

    from tarnlake.llm.near_dup import mixed
    from tarnlake.llm.words import words_of

    def number(x):
        return int(mixed(np.asarray([x % 2**64], np.uint64))[0])

    for text in ("one two three two", "a", "x y " * 40, "é ü é", " ".join(f"w{i}" for i in range(5000))):
        h = [int(v) for v in S.word_hashes(words_of(text.encode()))]
        terms = [(v, 1.0) for v in h] + [(number(a * 0x9E3779B97F4A7C15 + b), S.PAIR_WEIGHT) for a, b in zip(h, h[1:])]  # noqa: B905
        votes = [0.0] * S.BITS
        for v, w in terms:
            body = b"".join(number(v + k).to_bytes(8, "little") for k in range(S.BITS // 64))
            for i in range(S.BITS):
                votes[i] += w if body[i // 8] >> (7 - i % 8) & 1 else -w
        want = sum((v > 0) << (S.BITS - 1 - i) for i, v in enumerate(votes)).to_bytes(S.BITS // 8, "big")
        sure = sum((abs(v) > 0.01) << (S.BITS - 1 - i) for i, v in enumerate(votes))
        got = S.fingerprint(np.asarray(h, np.uint64))
        assert (int.from_bytes(got, "big") ^ int.from_bytes(want, "big")) & sure == 0
    assert S.fingerprint(np.zeros(0, np.uint64)) == bytes(S.BITS // 8)
