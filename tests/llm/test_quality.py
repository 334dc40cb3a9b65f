import re
from collections import Counter

from tarnlake.llm import quality as Q


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c, m = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            m.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(m)


def test_statistics(odd, docs_of):
    extra = docs_of([(20, "a b c d e a b c d e a"), (21, "x x x x x x"), (22, "l1 # a\nl1 # a\n \nl1 # a"), (23, "é ü\x85z　y 日本 | <b>"), (24, "1 2 3 4 5 6 1 2 3 4 5 7 8 3 4 5 7 8")])
    docs = odd.unionByName(extra)
    got = Q.statistics(docs).collect()
    want = sorted(((-1 if r.doc_id is None else r.doc_id), *base(r.text)) for r in docs.collect())
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_em_separates_correlated_failures():
    good = ((1, 1, 1, 1), 900)
    bad = ((-1, -1, 1, 1), 80)
    shy = ((0, 0, 1, 1), 20)
    pi, rates = Q.estimate([good, bad, shy])
    assert Q.posterior(good[0], pi, rates) > 0.9 > 0.1 > Q.posterior(bad[0], pi, rates)
    assert Q.posterior(shy[0], pi, rates) > 0.5
    assert Q.estimate([])[1] == []


def test_judge(docs_of, odd, none):
    prose = "The quick fox went home. It found nothing there, and slept. "
    rows = [(i, " ".join(f"{a}{i}" for a in prose.split()) + ". " + " ".join(f"word{chr(97 + (i * k) % 26)}{chr(97 + k % 26)}x." if k % 9 == 0 else f"w{chr(97 + (i + k * 7) % 26)}{chr(97 + (k * i) % 26)}{chr(97 + k % 26)}" for k in range(60))) for i in range(80)]
    rows += [(100 + i, " ".join(f"###{k * i}$$" for k in range(60))) for i in range(1, 9)]
    got = {r.doc_id: r.quality for r in Q.judge(docs_of(rows)).collect()}
    assert min(got[i] for i in range(80)) > 0.5 > max(got[100 + i] for i in range(1, 9))
    assert Q.judge(odd).count() == odd.count() and Q.judge(none).count() == 0
