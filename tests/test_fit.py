import numpy as np
import pytest

from tarnlake.core.checks import IntegrityError
from tarnlake.operators import fit as X

SEARCH = X.Search(n_iter=6, alphas=(0.01, 1.0, 100.0), seed=3, targets=4, rows=40)


def made(seed=0, plays=18, length=9, widths=(5, 2), missing=True):
    """Rows of plays in three partitions, with a band of features, one of others, and nine targets."""
    rng = np.random.default_rng(seed)
    n = plays * length
    a = rng.normal(3, 2, (n, widths[0])).astype(float)
    b = rng.normal(0, 1, (n, widths[1]))
    a[:, 1] = 7.0  # no spread
    if missing:
        a[rng.choice(n, 12, replace=False)] = 0
    play = np.arange(n) // length
    late = [np.roll(v, 2) for v in (a[:, 0], b[:, 0])]
    y = np.column_stack([late[0] * k + late[1] * (3 - k) + rng.normal(0, 2, n) + 1000 for k in range(8)] + [np.full(n, 5.0)])
    return play, play % 3, a, b, y


def frames(spark, play, part, a, b, y):
    rows = spark.createDataFrame([(i, int(p), int(q), u.tolist(), v.tolist()) for i, (p, q, u, v) in enumerate(zip(play, part, a, b, strict=True))], "row long, play int, part int, a array<double>, b array<double>")
    targets = spark.createDataFrame([(i, t, float(v)) for i, r in enumerate(y) for t, v in enumerate(r)], "row long, target long, y double")
    return rows.repartition(5), targets.repartition(3)


def plain_design(play, part, a, b, fold, components=None):
    """Scaled by training rows, missing rows zero, lagged row by row."""
    valid = a.sum(1) != 0
    train, out = valid & (part != fold), []
    for x in (a, b):
        m, s = x[train].mean(0), x[train].std(0, ddof=1)
        z = np.where(s > 1e-6, (x - m) / np.where(s > 1e-6, s, 1), 0.0)
        k = X.components_for(int(train.sum()), x.shape[1])
        if k is not None:
            z = np.clip(z, -10, 10)
            mean = z[train].mean(0)
            top = np.linalg.svd(z[train] - mean, full_matrices=False)[2][:k]
            top *= np.sign(top[np.arange(k), abs(top).argmax(1)])[:, None]
            z = (z - mean) @ top.T
        z[~valid] = 0
        lagged = np.zeros((len(z), 4 * z.shape[1]))
        for t in range(len(z)):
            start = np.flatnonzero(play == play[t])[0]
            lagged[t] = np.concatenate([z[max(t - k, start)] for k in (2, 3, 4, 5)])
        out.append(lagged)
    return valid, out


def corr(p, y):
    p, y = p - p.mean(0), y - y.mean(0)
    d = np.sqrt((p**2).sum(0)) * np.sqrt((y**2).sum(0))
    return np.where(d > 1e-10, (p * y).sum(0) / np.where(d > 1e-10, d, 1), 0)


def plain_fit(play, part, a, b, y, search):
    out = {}
    for fold in range(3):
        valid, bands = plain_design(play, part, a, b, fold)
        train, test = valid & (part != fold), valid & (part == fold)
        m, s = y[train].mean(0), y[train].std(0, ddof=1)
        z = np.where(s > 1e-6, (y - m) / np.where(s > 1e-6, s, 1), 0.0)
        best = [(-9, None, None, None)] * y.shape[1]
        for k, (weights, alphas) in enumerate(search.draws(2)):
            x = np.hstack([np.sqrt(w) * v for w, v in zip(weights, bands, strict=True)])

            def ridge(rows, alpha, x=x, z=z):
                return np.linalg.solve(x[rows].T @ x[rows] + alpha * np.eye(x.shape[1]), x[rows].T @ z[rows])

            for alpha in alphas:
                score = np.mean([corr(x[train & (part == v)] @ ridge(train & (part != v), alpha), z[train & (part == v)]) for v in range(3) if v != fold], axis=0)
                for t in range(y.shape[1]):
                    if score[t] > best[t][0] + 1e-9:
                        w = ridge(train, alpha)[:, t]
                        cut = 4 * (bands[0].shape[1] // 4)
                        r = [corr((x[test] @ w)[:, None], z[test][:, [t]])[0]] + [corr((x[test][:, c] @ w[c])[:, None], z[test][:, [t]])[0] for c in (slice(0, cut), slice(cut, None))]
                        best[t] = (score[t], k, alpha, r)
        out.update({(fold, t): v for t, v in enumerate(best)})
    return out


def test_design_against_loops(spark):
    play, part, a, b, y = made()
    rows, _ = frames(spark, play, part, a, b, y)
    got = {}
    for r in X.design_rows(rows, ["a", "b"], ["play"], "row", "part").collect():
        assert r.is_test == (r.fold == r.part)
        got[r.fold, r.row] = r.a, r.b
    for fold in range(3):
        valid, bands = plain_design(play, part, a, b, fold)
        assert {i for f, i in got if f == fold} == set(np.flatnonzero(valid).tolist())
        for i in np.flatnonzero(valid):
            assert np.allclose(got[fold, i][0], bands[0][i]) and np.allclose(got[fold, i][1], bands[1][i])


def test_fit_against_plain_ridge(spark):
    data = made(1)
    rows, targets = frames(spark, *data)
    design = X.design_rows(rows, ["a", "b"], ["play"], "row", "part")
    got = {(r.fold, r.target): r for r in X.banded_fit(design, ["a", "b"], "row", "part", targets, SEARCH).collect()}
    want = plain_fit(*data, SEARCH)
    assert got.keys() == want.keys() and len(got) == 27
    for k, (score, draw, alpha, r) in want.items():
        g = got[k]
        assert abs(g.score - score) < 1e-8
        if k[1] < 8:
            assert g.draw == draw and np.isclose(g.alpha, alpha) and np.allclose([g.r, *g.r_bands], r, atol=1e-8)
            assert np.isclose(sum(g.weights), 1) and g.r > 0.2
        else:
            assert g.r == 0  # a target without spread
    again = {(r.fold, r.target): r for r in X.banded_fit(design, ["a", "b"], "row", "part", targets.repartition(7), SEARCH).collect()}
    assert all(again[k].draw == g.draw and np.isclose(again[k].r, g.r, atol=1e-9) for k, g in got.items())


def test_more_features_than_rows_go_onto_components(spark):
    rng = np.random.default_rng(5)
    play, part, _, b, y = made(2, missing=False)
    wide = rng.normal(size=(len(play), 30)) @ rng.normal(size=(30, 4000)) + rng.normal(0, 0.1, (len(play), 4000))
    rows, _ = frames(spark, play, part, wide, b, y)
    got = {(r.fold, r.row): r.a for r in X.design_rows(rows, ["a", "b"], ["play"], "row", "part").collect()}
    for fold in range(3):
        _, (want, _) = plain_design(play, part, wide, b, fold)
        k = X.components_for(108, 4000)
        assert k == 25 and want.shape[1] == 4 * k
        for i in range(0, len(play), 7):
            assert np.allclose(np.abs(got[fold, i]), np.abs(want[i]), atol=1e-6)


def test_range_finder_settles_without_all_directions(spark, monkeypatch):
    monkeypatch.setattr(X, "EXACT", 10)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 60)) * 0.8 ** np.arange(60) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)
    mean, top = X.wide_components(df, "v", 300, 5)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:5]
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs((top * want).sum(1)), 1, atol=1e-6)
    assert all(t[abs(t).argmax()] > 0 for t in top)


def test_what_cannot_be_fitted_raises(spark):
    data = made(3)
    rows, targets = frames(spark, *data)
    with pytest.raises(IntegrityError, match="two partitions"):
        X.design_rows(rows.where("part = 0"), ["a", "b"], ["play"], "row", "part")
    two = X.design_rows(rows.where("part < 2"), ["a", "b"], ["play"], "row", "part")
    with pytest.raises(IntegrityError, match="three partitions"):
        X.banded_fit(two, ["a", "b"], "row", "part", targets, SEARCH)
    design = X.design_rows(rows, ["a", "b"], ["play"], "row", "part")
    with pytest.raises(IntegrityError, match="without targets"):
        X.banded_fit(design, ["a", "b"], "row", "part", targets.where("row <> 20"), SEARCH)
    with pytest.raises(IntegrityError, match="not every row"):
        X.banded_fit(design, ["a", "b"], "row", "part", targets.where("not (row = 20 and target = 5)"), SEARCH)
    with pytest.raises(ValueError, match="features"):
        X.banded_fit(design, ["a", "b"], "row", "part", targets, SEARCH, most=10)


@pytest.mark.parametrize("other", [None, "y"])
def test_a_large_batch_is_taken_in_pieces(monkeypatch, other):
    """A batch of Arrow's 10,000 rows of wide arrays isn't copied whole."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(10_000, 6)), rng.normal(size=(10_000, 2))
    frame = X.pd.DataFrame({"fold": 0, "part": np.arange(10_000) // 5_000, "x": list(x), "y": list(y)})
    sizes, of = [], X.matrix
    monkeypatch.setattr(X, "matrix", lambda v: sizes.append(len(v)) or of(v))
    got = X.pd.concat(X._added(["fold", "part"], other)(iter([frame[:0], frame])))
    assert max(sizes) <= 1000 and sum(sizes) == 10_000 * (1 if other is None else 2)
    for part, g in got.groupby("part"):
        own = slice(5_000 * part, 5_000 * (part + 1))
        a = np.column_stack([x[own], np.ones(5_000)])
        want = a.T @ a if other is None else np.vstack([a.T @ y[own], (y[own] ** 2).sum(0)])
        assert np.allclose(np.stack(g.sort_values("i")["c"].to_numpy()), want)
