import hashlib
import random
import re
import zlib

import pytest

from tarnlake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, digest string, path string, level int, prefix string, turns int, `a.b` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def of(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1, "x", 2, 3) for r in rows], SCHEMA)


def ordered(rows):
    """Turns (role, text) of every conversation, in order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in out.items()}


def remade(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain(convs):
    """Every prefix of every conversation, and every node's descendants, by comparing them."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in under if len(q) == len(p) + 1]
        leaves = sum(not any(q != r and r[: len(q)] == q for r in under) for q in under)
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        first = "the same beginning" if rng.random() < 0.6 else f"own beginning {rng.randrange(6)}"
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if t else "user", first if not t else rng.choice(["yes", "no ", " why  not\tnow", "", None])))
    return rows


@pytest.mark.parametrize("limit", [1, 7, 50_000])
def test_against_all_prefixes(spark, limit):
    rows = talk(limit, 60)
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(30) for t in range(5)]  # copies
    rows += [(2000 + k, t, "user", f"deep {t}" if t < 6 else f"parts {k}") for k in range(8) for t in range(9)]  # part late
    rows += [(40, t, "user", f"very long {t}") for t in range(150)] + [(3000, 1, None, None), (3000, 1, None, None), (None, 1, "user", "nobody's")]
    convs = remade(ordered(rows))
    assert any(not turns for turns in convs.values())  # some lose all their turns
    assert found(P.trie(P.rebuilt(of(spark, rows)), limit)) == plain(convs)
    own = ordered(rows)
    assert found(P.trie(P.told(of(spark, rows)), limit)) == plain(own)


def test_turns_are_in_order_with_null_first(spark):
    rows = [(20, 3, "c", "x"), (20, None, "a", "y"), (20, 1, "b", "z"), (20, 1, "b", "z"), (20, 1, None, "w")]
    got = P.told(of(spark, rows)).head().turns
    assert [t.digest for t in got] == [hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest() for r, t in ordered(rows)[20]]
    assert [t.turn for t in got] == [None, 1, 1, 1, 3]


def test_single_and_empty(spark):
    assert found(P.trie(P.rebuilt(of(spark, [])))) == []
    one = [(20, 0, "user", "one two  three")]
    assert found(P.trie(P.told(of(spark, one)))) == plain(ordered(one))
