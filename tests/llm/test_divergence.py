import random
import re
from collections import Counter, defaultdict

import pytest

from tarnlake.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, item string, value int, rank int, term string, id long, share long, `a.b` int"


def plain(rows, least, top=50):
    """Every kept term of every pair, one by one."""
    docs, count, lang_count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
        groups[lang].add(source)
    want = set()
    for lang, own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        for s in own:
            lang_count[lang].update({t: count[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(count[lang, s]) for s in own}, shares(lang_count[lang])
        for s in own:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                want |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return want


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("block", [2, 256])
def test_against_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(D, "LEAST_DOCS", 3)
    monkeypatch.setattr(D, "BLOCK", block)
    rng = random.Random(block)
    words = [f"{c}{d}" for c in "abcdefghé" for d in ("", "x", "ÉY", "zZ")] + ["ß", "日本", "x1y", "a-b", "q_r"]
    rows = [(" ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40))), rng.choice(["en", "en", "en", "de", None]), rng.choice([*"abcdefghijk", "", None])) for _ in range(260)]
    rows += [(None, "en", "only nulls"), ("", "xx", "alone"), ("rare words of one", "yy", "a"), ("other", "yy", "b"), ("a " * 5000, "en", "long"), ("Pages1930 #A", "en", "a")] + [("same same twice", "en", "copies")] * 40
    df = spark.createDataFrame([(i, *r, "item", 1, 2, "term", 3, 4, 5) for i, r in enumerate(rows)], SCHEMA)
    assert found(D.audit(df)) == plain(rows, 3)


def test_top_terms_ties_and_empty(spark, monkeypatch, odd, none):
    monkeypatch.setattr(D, "LEAST_DOCS", 2)
    rows = [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)), "en", "a")] * 2 + [("other words here", "en", "b")] * 2
    df = spark.createDataFrame([(i, *r, "item", 1, 2, "term", 3, 4, 5) for i, r in enumerate(rows)], SCHEMA)
    got = found(D.audit(df))
    assert got == plain(rows, 2) and sum(r[2] == "term" and r[1] == "a" for r in got) == D.TOP_TERMS
    assert found(D.audit(odd)) == plain([(r.text, r.lang, r.source) for r in odd.collect()], 2)
    empty = D.audit(none)
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_share_is_exact(spark):
    rng = random.Random(4)
    rows = [(c, c + rng.randrange(10**k + 1)) for k in range(15) for c in (rng.randrange(1, 10**k + 1), 5)] + [(4 * 10**15, 4 * 10**15 + 1)]
    got = spark.createDataFrame(rows, "c long, m long").select("c", "m", D.share("c", "m").alias("p")).collect()
    assert all(r.p == 1 + 10**9 * r.c // r.m for r in got)
