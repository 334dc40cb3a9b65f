from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.llm import mixing as M


def one_by_one(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats if sum(weights) > 0 else 0):
        i = max(range(len(weights)), key=lambda k: (weights[k] / (2 * got[k] + 1), -k))
        got[i] += 1
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_apportion_is_sainte_lague(weights, seats):
    got = M.apportion([float(w) for w in weights], seats)
    want = one_by_one(weights, seats)
    assert sum(got) == sum(want)
    q = lambda s: sorted(round(w / (2 * k + 1), 9) for w, n in zip(weights, s, strict=True) for k in range(n))
    assert q(got) == q(want)


def test_targets_stop_at_three_times_the_size():
    t = M.targets([10, 1, 89], [1, 2, 3])
    assert t[1] == 3 and abs(sum(t) - 100) < 1e-9 and abs(t[2] - 3 * t[0]) < 1e-9 or t[0] <= 30
    assert M.targets([0, 0], [1, 2]) == [0, 0]
    assert M.targets([], []) == []


def test_mix(odd):
    got = M.mix(odd).toPandas()
    assert len(got) == odd.count()
    again = M.mix(odd).toPandas()
    k = ["doc_id", "size", "taken"]
    assert got.sort_values(k)[k].reset_index(drop=True).equals(again.sort_values(k)[k].reset_index(drop=True))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    for _, g in got.groupby(got.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3 and g["size"].sum() == g.source_size.iloc[0]


def test_mixed_documents_have_the_taken_words(odd):
    mixed = M.mixed_documents(odd)
    assert mixed.columns == odd.columns
    rows = mixed.toPandas()
    taken = M.mix(odd).toPandas().taken.sum()
    assert rows.text.map(lambda t: len(t.split())).sum() == taken
    assert (rows.n_chars == rows.text.map(len)).all()


def test_empty(none):
    assert M.mix(none).count() == 0 and M.mixed_documents(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40), st.integers(0, 30_000), st.sampled_from([1, 7, 64]))
def test_shards_give_all_they_can(cells, words, block):
    got = M.deal_words(cells, words, 3, block)
    assert sum(got) == min(words, 3 * sum(cells)) and all(0 <= g <= 3 * c for g, c in zip(got, cells, strict=True))


def test_a_small_source_in_a_large_mix_meets_its_target(docs_of):
    docs = docs_of([(3 * i, f"a b c d e{i}") for i in range(200)] + [(3 * i + 1, "long " * 33_000) for i in range(40)])
    got = M.mix(docs).toPandas()
    assert got["size"].sum() > 1_280_000
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert got[got.source == "s0"].taken.sum() == 3000 and (got.taken <= 3 * got["size"]).all()


def test_words_are_counted_without_lists_of_them(docs_of):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "\ta\r\nb  c\x0b", "\x00 x\xa0y  z 𝒳 𝒳𝒴", "x" * 70_000, "$1 \\ x", "\x1c\x85 a\x1fb"]
    docs = docs_of(list(enumerate(texts)))
    got = {r.doc_id: r.n for r in docs.select("doc_id", M.n_words("text").alias("n")).collect()}
    assert got == {i: None if t is None else len(M.RE_WORD.findall(t)) for i, t in enumerate(texts)}
    assert "regexp_extract_all" not in M.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
