import random

from tarnlake.llm import substring_dedup as B


def left_of(r):
    """clean_text from the text and the removed spans, which are in order and apart."""
    out, at = "", 0
    for s in r.removed:
        assert at <= s.start < s.end
        out, at = out + r.text[at : s.start], s.end
    return None if r.text is None else out + r.text[at:]


def by_lines(rows):
    """Words left of each text when each line that came before goes: plain sets, no hashes."""
    seen, want = set(), {}
    for i, t in sorted(rows):
        left = []
        for line in t.split("\n"):
            bare = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in line.lower().split()]
            key = tuple(b or w for b, w in zip(bare, line.lower().split(), strict=True))
            if key and key not in seen:
                left += line.split()
            seen.add(key)
        want[i] = left
    return want


def test_lines_and_paragraphs_against_plain_sets(docs_of):
    rows = []
    for n in range(1, 41):
        for v in range(3):
            line = " ".join(f"k{n}v{v}q{k}" for k in range(n))
            rows += [(1000 * n + 10 * v, f"start of its own {n} {v}\n{line}\nend {n} {v}"), (1000 * n + 10 * v + 1, f"another head{n}{v}\n\n{line.upper()}\nanother tail {n} {v}")]
    verse = "\n".join(f"short line{k} here" for k in range(4))
    rows += [(90_001, f"{verse}\n\nsomething else"), (90_002, f"a head\n\n{verse}\n \ntail"), (90_003, "short line1 here!\nonly\nonly"), (90_004, "x\n\ny\nx"), (90_005, "\n \n")]
    got = {r.doc_id: r for r in B.deduplicate(docs_of(rows)).collect()}
    assert {i: r.clean_text.split() for i, r in got.items()} == by_lines(rows)
    for r in got.values():
        assert r.clean_text == left_of(r)
    assert sum(s.end - s.start for s in got[90_002].removed) == len(verse)  # the paragraph is one unit


def test_lines_of_punctuation_only(docs_of):
    """Braces, rules and borders are repeats of their equals only."""
    one = "int f() {\n  a\n}\n---\n| x |\n+---+\n( )\n} {"
    two = "int g() {\n  b\n}\n***\n| y |\n+===+\n({})\n=====\n--- ---"
    got = {r.doc_id: r.clean_text for r in B.deduplicate(docs_of([(1, one), (2, two), (3, "  }\n***\n...")])).collect()}
    assert got[1] == one
    assert got[2].split() == two.replace("\n}\n", "\n\n").split()
    assert got[3].split() == ["..."]


def test_random_lines_against_plain_sets(docs_of):
    rng = random.Random(3)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choices([*lines, "", " "], k=rng.randint(0, 9)))) for i in range(120)]
    got = {r.doc_id: r for r in B.deduplicate(docs_of(rows)).collect()}
    assert {i: r.clean_text.split() for i, r in got.items()} == by_lines(rows)


def test_passages_within_lines(docs_of):
    """What goes is, word for word, in an earlier document; of a passage of 51 words and more that
    comes again most goes, and nothing around it."""
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    rows, where = [], {}
    for p in range(40):
        passage = own(51 + p)
        for copy in range(3):
            head, tail = own(rng.randint(20, 60)), own(rng.randint(20, 60))
            i = 10 * p + copy
            rows.append((i, " ".join(head + passage + tail)))
            where[i] = len(" ".join(head)) + 1, len(" ".join(head + passage))
    rows.append((9_999, " ".join(own(3000))))
    got = {r.doc_id: r for r in B.deduplicate(docs_of(rows)).collect()}
    shares = []
    for i, r in got.items():
        assert r.clean_text == left_of(r)
        if i == 9_999 or i % 10 == 0:
            assert not r.removed
            continue
        a, b = where[i]
        assert all(a <= s.start and s.end <= b for s in r.removed)
        earlier = [" ".join(t.split()) for j, t in rows if j < i]
        assert all(any(r.text[s.start : s.end] in t for t in earlier) for s in r.removed)
        shares.append(sum(s.end - s.start for s in r.removed) / (b - a))
    assert sum(x > 0.4 for x in shares) >= 0.97 * len(shares) and sum(shares) / len(shares) > 0.7


def test_rows_of_one_id_stand_for_themselves(docs_of):
    same = "the same line in both\nown line of the first"
    rows = [(5, same), (5, "own line of the second\nand nothing that repeats"), (5, same), (None, "the same line in both\nthird"), (None, "no repeats here"), (6, "the same line in both")]
    got = B.deduplicate(docs_of(rows)).collect()
    left = sorted((r.doc_id is None, r.text, r.clean_text) for r in got)
    assert len(got) == 6
    for none, text, clean in left:
        repeats = text.startswith("the same line") and text != same
        assert clean == (text.replace("the same line in both", "", 1) if repeats else text), (none, text)


def test_odd_rows(odd, docs_of, none):
    got = B.deduplicate(odd).collect()
    assert len(got) == odd.count() and B.deduplicate(none).count() == 0 and B.removals(none).count() == 0
    by = {}
    for r in got:
        assert r.clean_text == left_of(r)
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].removed == [] and all(r.clean_text == "" for r in by[5]) and by[1][0].clean_text is None
    assert [c for c in odd.columns if c != "removed"] == [c for c in B.deduplicate(odd).columns if c not in ("removed", "clean_text")]


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a line", 2), (2, "a line", 3)], "doc_id long, text string, `a.b` int")
    assert {r["a.b"]: r.clean_text for r in B.deduplicate(docs).collect()} == {2: "a line", 3: ""}
