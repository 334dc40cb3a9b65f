import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a@.-+1 20(9)é_\n", max_size=60))
def test_find_matches_the_patterns(text):
    assert P.find(text) == plain(text)


def test_known_values():
    t = "mail a.b@c-d.org, 10.0.0.256 10.0.0.1.2, 4111 1111 1111 1111, +1 (706) 555-3138, 4111 1111 1111 1112"
    assert [k for k, _, _ in P.find(t)] == ["email", "ip", "card", "phone"]
    assert P.find("1" * 100_000 + " " + "a" * 100_000) == []


def test_terms_that_go_with_one_entity(docs_of):
    rows = [(i, "report by zebulon quirk via x1@mail.org about the weather") for i in range(4)]
    rows += [(10 + i, f"the report about the weather number w{i} by someone") for i in range(60)]
    rows += [(90, None), (91, ""), (None, "the report")]
    docs = docs_of(rows)
    got = P.spans(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        terms = [rows[[x[0] for x in rows].index(r.doc_id)][1][x.start : x.end] for x in r.terms or []]
        assert set(terms) == ({"zebulon", "quirk", "via"} if r.doc_id in range(4) else set())
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert clean[0] == "report by    [EMAIL] about the weather"
    assert clean[10] == rows[4][1] and clean[90] is None and clean[91] == ""
    assert P.sanitise(docs).columns == docs.columns


def test_odd_and_empty(odd, none):
    assert P.spans(odd).count() == odd.count() and P.sanitise(odd).count() == odd.count()
    assert P.spans(none).count() == 0 and P.sanitise(none).count() == 0


def test_terms_go_wherever_they_stand(docs_of):
    """A term far from the entity counts, and goes in a document without the entity too."""
    far = " the weather" * 30
    rows = [(i, f"mail x1@mail.org about{far} then Zebulon\u00a0Quirk, and zebulon's quirkish.") for i in range(4)]
    rows += [(5, "a note on (Quirkish) things by the weather")]
    rows += [(10 + i, f"mail about the weather number w{i} and then on things by a note") for i in range(200)]
    docs = docs_of(rows)
    texts = dict(rows)
    got = {r.doc_id: {texts[r.doc_id][x.start : x.end] for x in r.terms or []} for r in P.spans(docs).collect()}
    assert all(got[i] == {"Zebulon\u00a0Quirk", "zebulon's", "quirkish"} for i in range(4))
    assert got[5] == {"Quirkish"} and not any(got[10 + i] for i in range(200))
    assert {r.doc_id: r.text for r in P.sanitise(docs).collect()}[5] == "a note on ([TERM]) things by the weather"


def disclosing_by_hand(rows):
    """Spans of the terms by the definition: documents counted one by one, no hashes, no shortcuts."""
    space = re.compile(r"[^\x20\x09-\x0D]+")
    docs = []
    for i, t in rows:
        spans = P.find(t or "")
        words = [(m.start(), m.end()) for m in space.finditer(t or "")]
        free = [(a, b) for a, b in words if not any(b > s and a < e for _, s, e in spans)]
        clean = []
        for a, b in free:
            raw = t[a:b]
            w = raw.strip(P.PUNCT)
            if any(c.isalpha() for c in w):
                at = a + raw.find(w)
                clean.append((w.lower(), at, at + len(w)))
        every = {t[a:b].strip(P.PUNCT).lower() for a, b in words}
        docs.append((i, {P.entity(k, t[a:b]) for k, a, b in spans}, clean, every))
    n = len(rows)
    share = {}
    for e in set().union(*(d[1] for d in docs)):
        with_e = [d for d in docs if e in d[1]]
        if len(with_e) < P.SUPPORT or len(with_e) == n:
            continue
        for w in set().union(*({x for x, _, _ in d[2]} for d in with_e)):
            both, n_w = sum(any(x == w for x, _, _ in d[2]) for d in with_e), sum(w in d[3] for d in docs)
            if both >= P.SUPPORT and n_w >= P.SUPPORT:
                s = math.log(n * both / (n_w * len(with_e))) / math.log(n / len(with_e))
                if s >= P.GENERALISE:
                    share[w] = max(s, share.get(w, 0))
    return {i: [(a, b, share[w] >= P.REMOVE) for w, a, b in clean if w in share] for i, _, clean, _ in docs}


def test_terms_against_counts_by_hand(docs_of):
    rng = random.Random(11)
    common = [f"word{i}" for i in range(25)]
    rows = []
    for i in range(90):
        ws = rng.choices(common, k=rng.randint(3, 20))
        if i % 3 == 0:
            who = rng.randrange(8)
            ws.insert(rng.randrange(len(ws)), f"mail u{who}@mail.org")
            ws += rng.sample([f"(Name{who})", f"place{who // 2},", f"job{who // 4}", "12", "--"], 3)
        elif i % 7 == 0:
            ws.append(f"name{rng.randrange(8)}")
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    want = disclosing_by_hand(rows)
    got = {r.doc_id: [(x.start, x.end, x.remove) for x in r.terms or []] for r in P.spans(docs_of(rows)).collect()}
    assert got == {i: sorted(w) for i, w in want.items()} and sum(map(len, got.values())) > 20


def test_long_lists_write_each_entity_and_term_once(spark, docs_of, monkeypatch):
    """A list of E addresses and T words, and its copies, are one set of documents, not E times T pairs."""
    dump = " ".join([f"user{k}@list.org" for k in range(2000)] + [f"surname{chr(97 + k % 26)}{k}x" for k in range(8000)])
    rows = [(i, dump) for i in range(3)] + [(10 + i, f"user{i % 5}@list.org met surname{chr(97 + i % 5)}{i % 5}x near a plain wall {i}") for i in range(40)] + [(100 + i, f"nothing to see at wall {i}") for i in range(300)]
    pairs = []
    join = type(docs_of(rows)).join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "uid":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(type(docs_of(rows)), "join", counted)
    got = {r.doc_id: len(r.terms or []) for r in P.spans(docs_of(rows)).collect()}
    assert got[0] == got[1] == got[2] > 7900 and got[100] == 0
    assert sum(pairs) < 2000


def test_columns_named_as_ours_stay(docs_of):
    docs = docs_of([(1, "mail a@b.org now"), (2, None), (2, ""), (None, "x@y.org")])
    got = P.sanitise(docs)
    assert got.columns == docs.columns
    assert [r._tl_key for r in got.collect()] == ["key"] * 4 and {r._tl_id for r in got.collect()} == {10}
    assert sorted(r.text or "" for r in got.collect()) == ["", "", "[EMAIL]", "mail [EMAIL] now"]
