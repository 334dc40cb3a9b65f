import math
import zlib
from collections import Counter

import numpy as np

from tarnlake.llm import lattice as L


def test_forward_sums_over_all_segmentations():
    lat = L.Lattice(["", L.START, "a", "b", "ab", L.START + "a", "<0x63>"], np.asarray([0, 1, 3, 2, 4, 5, 1]) / 16)

    def brute(s):
        if not s:
            return 1.0
        arcs = sum(math.exp(lp) * brute(s[len(k) :]) for k, lp in lat.arcs.items() if lp is not None and s.startswith(k))
        if lat.arcs.get(s[0]) is None:
            arcs += math.exp(sum(lat.byte[x] for x in s[0].encode())) * brute(s[1:])
        return arcs

    for w in ("ab", "aabb", "b", "abab", "cab", ""):
        assert abs(math.exp(lat.word(w)) - brute(L.START + w)) < 1e-12
    assert math.isfinite(lat.word("ab" * 20_000))


def test_score(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 4), held(i)) for i, t in rows)
    got = L.score(odd).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 4), r.held_out) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_empty(none):
    assert L.score(none).count() == 0


def all_cuts(s, p, byte):
    """(probability, pieces) of every segmentation of a word with its start mark."""
    if not s:
        return [(1.0, ())]
    out = []
    for k in range(1, len(s) + 1):
        if s[:k] in p:
            out += [(p[s[:k]] * q, (s[:k], *rest)) for q, rest in all_cuts(s[k:], p, byte)]
    if s[0] not in p:
        spelt = math.prod(byte[b] for b in s[0].encode())
        out += [(spelt * q, (*s[0].encode(), *rest)) for q, rest in all_cuts(s[1:], p, byte)]
    return out


PIECES = ["", L.START, "a", "b", "ab", L.START + "a", L.START + "ab", "ba", "<0x63>"]
PROB = np.asarray([0, 1, 3, 2, 4, 5, 2, 2, 1]) / 20


def test_expected_counts_are_those_of_all_segmentations():
    p = {s: v for s, v in zip(PIECES, PROB, strict=True) if s and not s.startswith("<")}
    byte = {0x63: PROB[-1]}
    got, lat = np.zeros(len(PIECES)), L.Lattice(PIECES, PROB)
    want = np.zeros(len(PIECES))
    for word, times in (("ab", 2), ("aabba", 3), ("cab", 1), ("", 5), ("b", 1)):
        lat.expect(word, times, got)
        cuts = all_cuts(L.START + word, p, byte)
        assert abs(lat.word(word) - math.log(sum(q for q, _ in cuts))) < 1e-12
        for q, pieces in cuts:
            for x in pieces:
                want[PIECES.index(x) if isinstance(x, str) else PIECES.index("<0x63>")] += times * q / sum(v for v, _ in cuts)
    assert np.allclose(got, want)
    long, short = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    lat.expect("ab" * 15, 2, short)
    L.SHORT, before = 0, L.SHORT
    lat.expect("ab" * 15, 2, long)
    L.SHORT = before
    assert np.allclose(short, long) and short.sum() > 0


def test_mass_is_at_most_one():
    """Of all words up to some length over a closed set of characters, for any probabilities."""
    import itertools

    lat = L.Lattice(PIECES, PROB)
    mass = sum(math.exp(lat.word("".join(w))) for n in range(9) for w in itertools.product("ab", repeat=n))
    assert 0.5 < mass <= 1 + 1e-9


def test_score_end_to_end(docs_of, monkeypatch):
    """Against all segmentations of every word, with one round of expectations by hand."""
    monkeypatch.setattr(L, "pieces_of", lambda path: (PIECES, [-float(i) for i in range(len(PIECES))]))
    rows = [(i, t) for i, t in enumerate(["ab ab ba", "AB aab", "", None, "b a b", "cab a", "ba ba ab", "abba a", "bbb", "aaa ab"])]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").lower().split()
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in rows)
    total = sum(c.values()) + ends
    u = min(0.5, max(sum(v == 1 for v in c.values()), 1) / total)
    p = {s: 1 / (i + 1) for i, s in enumerate(PIECES) if s}

    def normed(p):
        z = sum(p.values())
        return {s: v / z for s, v in p.items()}

    def cuts(w, p):
        return all_cuts(L.START + w, {s: v for s, v in p.items() if not s.startswith("<")}, {0x63: p["<0x63>"]})

    p = normed(p)
    new = dict.fromkeys(p, L.PSEUDO)
    for w, n in c.items():
        ways = cuts(w, p)
        for q, pieces in ways:
            for x in pieces:
                new[x if isinstance(x, str) else "<0x63>"] += n * q / sum(v for v, _ in ways)
    p = normed(new)
    like = lambda w: (1 - u) * c[w] / total + u * sum(q for q, _ in cuts(w, p))
    want = {i: sum(math.log10(like(w)) for w in words(t)) + math.log10((1 - u) * ends / total) for i, t in rows}
    got = {r.doc_id: r.score for r in L.score(docs_of(rows), "none", 1).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)

