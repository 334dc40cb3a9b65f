"""Encoding models: design rows by fold, and banded ridge with a random search of the bands' weights.

Rows are time points with a raw vector per band; a fold holds out the rows of one partition. Means,
deviations and principal components are those of the fold's training rows. What a fit needs of the
rows are cross products by fold and partition, so that it takes one pass whatever their number; the
targets are dealt in blocks to tasks, and the search of a block runs in its task on those numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.core import checks
from tarnlake.core.shared import materialize, release
from tarnlake.operators.encode import valid_rows
from tarnlake.operators.features import components_for

LAGS = (2, 3, 4, 5)
#: Training rows up to which all directions are kept while components are sought, so that they are exact.
EXACT = 2048
#: Elements of a vector summed by one task.
TOGETHER = 8
#: Rows of a batch that become numbers together.
ROWS = 1000


def summed(parts: DataFrame, key: list[str]) -> DataFrame:
    """Element-wise sums of the arrays c with equal key and i, from a row per key, i and task; in the order
    of the values, so that it doesn't matter which task came first."""
    kinds = dict(parts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*key, "i"]) + ", c array<double>"

    def add(g: pd.DataFrame) -> pd.DataFrame:
        got = [(i, np.sort(np.stack(x["c"].to_numpy()), axis=0).sum(0)) for i, x in g.groupby("i")]
        out = pd.DataFrame({"i": [r[-2] for r in got], "c": [r[-1] for r in got]})
        for k in key:
            out[k] = g[k].iloc[0]
        return out[[*key, "i", "c"]]

    return parts.groupBy(*key, F.floor(F.col("i") / TOGETHER).alias("_g")).applyInPandas(lambda g: add(g), schema)


def matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64, copy=False)


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches' rows, at most ROWS at a time, so that several copies of them are small."""
    for b in batches:
        for lo in range(0, len(b), ROWS):
            yield b.iloc[lo : lo + ROWS]


def statistics(rows: DataFrame, bands: list[str], partition: str) -> dict:
    """{partition: (n, mean, sum of squares around it)} of the bands one after the other, over valid rows."""
    kind = rows.schema[partition].dataType.simpleString()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict = {}
        for b in pieces(batches):
            for part, g in b.groupby(partition):
                x = np.column_stack([matrix(g[c]) for c in bands])
                n, mean, m2 = len(x), x.mean(0), ((x - x.mean(0)) ** 2).sum(0)
                if part in got:
                    a, am, a2 = got[part]
                    m2 = a2 + m2 + (mean - am) ** 2 * a * n / (a + n)
                    mean = (a * am + n * mean) / (a + n)
                    n += a
                got[part] = n, mean, m2
        for part, (n, mean, m2) in got.items():
            yield pd.DataFrame({partition: part, "i": np.arange(len(mean)), "n": n, "mean": mean, "m2": m2})

    parts = materialize(rows.where("valid").mapInPandas(add, f"{partition} {kind}, i long, n long, mean double, m2 double"))
    means = parts.groupBy(partition, "i").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all_mean"))
    around = F.col("m2") + F.col("n") * (F.col("mean") - F.col("all_mean")) ** 2
    each = parts.join(means, [partition, "i"]).groupBy(partition, "i").agg(F.max("all_n").alias("n"), F.max("all_mean").alias("mean"), F.sum(around).alias("m2"))
    got = each.orderBy(partition, "i").toPandas()  # a row per partition and element
    release(parts)
    return {part: (int(g["n"].iloc[0]), g["mean"].to_numpy(), g["m2"].to_numpy()) for part, g in got.groupby(partition)}


def merged(stats: list[tuple]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and deviation (ddof 1) of several partitions together."""
    n = sum(s[0] for s in stats)
    mean = sum(s[0] * s[1] for s in stats) / n
    m2 = sum(s[2] + s[0] * (s[1] - mean) ** 2 for s in stats)
    return n, mean, np.sqrt(m2 / (n - 1))


def wide_components(rows: DataFrame, vector: str, n: int, k: int, seed: int = 0, tolerance: float = 1e-10, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the leading k components (rows; largest entry positive) of n vectors of any width, by
    a randomised range finder: width times a number of directions is the most that is held. Up to
    EXACT vectors there is a direction for each of them, which is exact after one pass; beyond,
    passes go on until the components' share of the squares stands still."""
    width = len(rows.select(vector).head()[0])
    total = summed(rows.mapInPandas(_sums(vector), "i long, c array<double>"), []).toPandas()
    mean = np.asarray(total["c"].iloc[0]) / n
    l = min(width, n if n <= EXACT else max(2 * k, k + 20))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, l)))[0]
    before = -1.0
    for _ in range(1 if l >= min(n, width) else most):
        q = np.linalg.qr(_collected(rows.mapInPandas(_images(vector, mean, q), "i long, c array<double>")))[0]
        values, turn = np.linalg.eigh(_collected(rows.mapInPandas(_squares(vector, mean, q), "i long, c array<double>")))
        top = values[::-1][:k].sum()
        if abs(top - before) <= tolerance * max(top, 1e-300):
            break
        before = top
    else:
        if l < min(n, width):
            raise ArithmeticError(f"components haven't settled after {most} passes")
    found = (q @ turn[:, ::-1][:, :k]).T
    return mean, found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]


def _collected(parts: DataFrame) -> np.ndarray:
    got = summed(parts, []).orderBy("i").toPandas()
    return np.stack(got["c"].to_numpy())


def _folded(vector: str, of: Callable[[np.ndarray], np.ndarray]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in pieces(batches):
            got = of(matrix(b[vector]))
            total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "c": list(total)})

    return run


def _sums(vector: str) -> Callable:
    return _folded(vector, lambda x: x.sum(0)[None])


def _images(vector: str, mean: np.ndarray, q: np.ndarray) -> Callable:
    return _folded(vector, lambda x: (x - mean).T @ ((x - mean) @ q))


def _squares(vector: str, mean: np.ndarray, q: np.ndarray) -> Callable:
    return _folded(vector, lambda x: ((x - mean) @ q).T @ ((x - mean) @ q))


@dataclass(frozen=True)
class Scaling:
    """How a band becomes numbers of a fold: by mean and deviation, then onto components if it has any."""

    mean: np.ndarray
    deviation: np.ndarray
    components: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        some = self.deviation > 1e-6
        z = np.nan_to_num(np.where(some, (x - self.mean) / np.where(some, self.deviation, 1.0), 0.0), nan=0.0, posinf=0.0, neginf=0.0)
        if self.components is None:
            return z
        mean, top = self.components
        return (np.clip(z, -10, 10) - mean) @ top.T


def design_rows(rows: DataFrame, bands: list[str], play: list[str], row: str, partition: str, lags: tuple[int, ...] = LAGS, most: int = 64, seed: int = 0) -> DataFrame:
    """fold, row, partition, is_test and the bands as lagged arrays of every valid row, for each fold.

    rows: row (unique, in order within a play), the play's columns, partition and a vector per band;
    those whose first band adds up to 0 are missing and count as zeros where they are lagged. Values are
    scaled by the fold's training rows; a band of more than n_train / len(lags) elements goes onto its
    components first. Lags stay in a play and begin with its first row. Fewer than two partitions,
    more than `most`, or a fold with fewer than two rows on a side raise."""
    own = rows.select(F.col(row).cast("long").alias(row), *play, partition, *[F.col(b).cast("array<double>").alias(b) for b in bands])
    own = materialize(own.withColumn("valid", F.coalesce(valid_rows(bands[0]), F.lit(False))))
    checks.bounded(own.select(partition).distinct(), most, "partitions")
    widths = [len(v) for v in own.select(*bands).head() or ()]
    stats = statistics(own, bands, partition)
    if len(stats) < 2:
        raise checks.IntegrityError("at least two partitions with valid rows are needed")
    edges = np.cumsum([0, *widths])
    scalings: dict = {}
    for fold in stats:
        train = [s for part, s in stats.items() if part != fold]
        if stats[fold][0] < 2 or sum(s[0] for s in train) < 2:
            raise checks.IntegrityError(f"partition {fold} leaves too few rows")
        n, mean, deviation = merged(train)
        scalings[fold] = []
        for b, lo, hi in zip(bands, edges, edges[1:], strict=False):
            scaling = Scaling(mean[lo:hi], deviation[lo:hi])
            k = components_for(n, hi - lo, len(lags))
            if k is not None:
                fitted = own.where(f"valid and {partition} <> {fold!r}").select(b)
                fitted = materialize(fitted.mapInPandas(_scaled(b, scaling), f"{b} array<double>"))
                scaling = Scaling(scaling.mean, scaling.deviation, wide_components(fitted, b, n, k, seed))
                release(fitted)
            scalings[fold].append(scaling)

    def by_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in pieces(batches):
            valid = g["valid"].to_numpy()[:, None]
            for fold, scale in scalings.items():
                out = g[[row, *play, partition, "valid"]].copy()
                out["fold"] = fold
                for b, s in zip(bands, scale, strict=True):
                    out[b] = list(np.where(valid, s(matrix(g[b])), 0.0))
                yield out

    kinds = dict(own.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [row, *play, partition, "valid"]) + f", fold {kinds[partition]}, " + ", ".join(f"{b} array<double>" for b in bands)
    each = own.mapInPandas(by_fold, schema)
    w = Window.partitionBy("fold", *play).orderBy(row)
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    late = [F.concat(*[F.coalesce(F.lag(b, k).over(w), F.first(b).over(first)) for k in lags]).alias(b) for b in bands]
    return each.select("fold", row, partition, "valid", *late).where("valid").select("fold", row, partition, (F.col("fold") == F.col(partition)).alias("is_test"), *bands)


def _scaled(band: str, scaling: Scaling) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in pieces(batches):
            yield pd.DataFrame({band: list(np.clip(scaling(matrix(b[band])), -10, 10))})

    return run


@dataclass(frozen=True)
class Search:
    """A random search: draws of the bands' weights (the first one even), each with all alphas."""

    n_iter: int = 100
    alphas: tuple[float, ...] = tuple(10.0 ** np.linspace(-5, 10, 20))
    jitter: bool = True
    seed: int = 0
    #: Targets in a block, and rows of a fold's partition that one task adds up.
    targets: int = 500
    rows: int = 20_000

    def draws(self, bands: int) -> list[tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        out = []
        for i in range(self.n_iter):
            weights = np.full(bands, 1 / bands) if i == 0 or bands == 1 else rng.dirichlet(np.full(bands, (0.1, 1.0)[i % 2]))
            step = rng.random() - 0.5 if self.jitter else 0.0
            out.append((weights, np.asarray(self.alphas) * 10**step))
        return out


def r_of(cov: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Correlation from centred sums; 0 where there is no spread."""
    root = np.sqrt(np.maximum(one, 0)) * np.sqrt(np.maximum(other, 0))
    return np.clip(np.where(root > 1e-10, cov / np.where(root > 1e-10, root, 1.0), 0.0), -1.0, 1.0)


class Products:
    """Cross products of rows with a constant 1 after the features, and those with targets: x (features
    and 1, squared), y (features and 1, by target) and yy (squares of the targets)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, yy: np.ndarray):
        self.x, self.y, self.yy = x, y, yy

    @property
    def n(self) -> float:
        return self.x[-1, -1]

    def __add__(self, other: Products) -> Products:
        return Products(self.x + other.x, self.y + other.y, self.yy + other.yy)

    def scaled(self, mean: np.ndarray, deviation: np.ndarray) -> Products:
        """The same for targets less mean, by deviation; without spread 0."""
        some = np.where(deviation > 1e-6, 1 / np.where(deviation > 1e-6, deviation, 1.0), 0.0)
        sums = self.y[-1]
        return Products(self.x, (self.y - self.x[:, -1:] * mean) * some, (self.yy - 2 * mean * sums + self.n * mean**2) * some**2)

    def r(self, w: np.ndarray) -> np.ndarray:
        """Correlation of the targets with their predictions by the weights w (features by target)."""
        sums = self.x[-1, :-1] @ w
        cov = (w * self.y[:-1]).sum(0) - sums * self.y[-1] / self.n
        return r_of(cov, (w * (self.x[:-1, :-1] @ w)).sum(0) - sums**2 / self.n, self.yy - self.y[-1] ** 2 / self.n)


def solved(train: Products, scale: np.ndarray) -> Callable[[np.ndarray | float], np.ndarray]:
    """Ridge weights without an intercept by alpha, for features multiplied by scale; one
    decomposition serves all alphas. alpha may differ by target."""
    values, vectors = np.linalg.eigh(train.x[:-1, :-1] * scale[:, None] * scale)
    turned = vectors.T @ (train.y[:-1] * scale[:, None])
    return lambda alpha: scale[:, None] * (vectors @ (turned / (np.maximum(values, 0)[:, None] + alpha)))


def searched(parts: dict, fold, widths: list[int], search: Search) -> dict[str, np.ndarray | list]:
    """For each target the draw and alpha whose predictions of the training partitions, each held out
    in turn, correlate best on average (the first of equals), and the scores on the fold's rows of
    the refit: r of the whole prediction, and of each band's part."""
    train = {k: p for k, p in parts.items() if k != fold}
    whole = sum(list(train.values())[1:], list(train.values())[0])
    mean = whole.y[-1] / whole.n
    deviation = np.sqrt(np.maximum(whole.yy - whole.n * mean**2, 0) / (whole.n - 1))
    train = {k: p.scaled(mean, deviation) for k, p in train.items()}
    whole, test = whole.scaled(mean, deviation), parts[fold].scaled(mean, deviation)
    draws = search.draws(len(widths))
    t = whole.y.shape[1]
    best, draw, alpha = np.full(t, -np.inf), np.zeros(t, int), np.zeros(t)
    for k, (weights, alphas) in enumerate(draws):
        scale = np.repeat(np.sqrt(weights), widths)
        scores = np.zeros((len(alphas), t))
        for held in train:
            rest = [p for part, p in train.items() if part != held]
            ridge = solved(sum(rest[1:], rest[0]), scale)
            scores += np.stack([train[held].r(ridge(a)) for a in alphas])
        scores /= len(train)
        top = scores.argmax(0)
        found = scores[top, np.arange(t)]
        better = found > best
        best[better], draw[better], alpha[better] = found[better], k, alphas[top[better]]
    w = np.zeros((sum(widths), t))
    for k in np.unique(draw):
        own = draw == k
        some = Products(whole.x, whole.y[:, own], whole.yy[own])
        w[:, own] = solved(some, np.repeat(np.sqrt(draws[k][0]), widths))(alpha[own])
    edges = np.cumsum([0, *widths])
    by_band = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        only = np.zeros_like(w)
        only[lo:hi] = w[lo:hi]
        by_band.append(test.r(only))
    return {"draw": draw, "alpha": alpha, "weights": [draws[k][0] for k in draw], "score": best, "r": test.r(w), "r_bands": list(np.stack(by_band, 1))}


def banded_fit(design: DataFrame, bands: list[str], row: str, partition: str, targets: DataFrame, search: Search = Search(), most: int = 4096) -> DataFrame:
    """fold, target, draw, alpha, weights (by band), score (of the search), r and r_bands on the fold's
    rows, for every target (row, target, y) and fold of design_rows(). The same seed gives the same
    result. A target needs a y for every row of the design; less than three partitions leave nothing
    to search on and raise, as do more than `most` features, whose squared number of cross products
    the driver sends to the tasks."""
    if len(bands) < 1 or search.n_iter < 1 or search.targets < 1:
        raise ValueError("bands, iterations and targets of a block must be positive")
    kind = dict(design.dtypes)["fold"]
    one = design.select("fold", row, F.col(partition).alias("part"), *bands)
    head = one.head()
    widths = [len(head[b]) for b in bands] if head else []
    if sum(widths) > most:
        raise ValueError(f"{sum(widths)} features, at most {most} can be fitted")
    x = materialize(one.select("fold", row, "part", F.concat(*bands).alias("x")))
    folds = [r["part"] for r in checks.bounded(x.select("part").distinct(), 64, "partitions").collect()]
    if len(folds) < 3:
        raise checks.IntegrityError("at least three partitions are needed")

    block = F.floor(F.col("target") / search.targets).alias("block")
    y = targets.select(F.col(row).cast("long").alias(row), F.col("target").cast("long").alias("target"), F.col("y").cast("double").alias("y"), block)
    y = materialize(y.groupBy(row, "block").agg(F.array_sort(F.collect_list(F.struct("target", "y"))).alias("ys")).select(row, "block", "ys.target", "ys.y"))
    names = materialize(y.groupBy("block").agg(F.min("target").alias("targets"), F.max("target").alias("_last"), F.count("*").alias("_n")))
    rows = x.select(row).distinct()
    checks.require_empty(names.where("targets <> _last"), "targets that not every row has")
    checks.require_empty(rows.join(y.select(row), row, "left_anti"), "rows without targets")
    short = y.join(rows, row, "left_semi").groupBy("block").agg(F.count("*").alias("n")).join(rows.agg(F.count("*").alias("want"))).where("n <> want")
    checks.require_empty(short, "blocks of targets that not every row has")

    gram = x.mapInPandas(_added(["fold", "part"], None), f"fold {kind}, part {kind}, i long, c array<double>")
    squares: dict = {}
    for fold, part, g in ((*k, g) for k, g in summed(gram, ["fold", "part"]).toPandas().groupby(["fold", "part"])):
        squares[fold, part] = np.stack(g.sort_values("i")["c"].to_numpy())
    sent = design.sparkSession.sparkContext.broadcast(squares)  # at most 64 ** 2 times `most` ** 2, of which few are used

    chunk = F.pmod(F.xxhash64(row), F.greatest(F.lit(1), F.ceil(F.lit(x.count() / len(folds) ** 2 / search.rows)))).alias("chunk")
    both = x.join(y.select(row, "block", "y"), row).withColumn("chunk", chunk)
    both = both.repartition("fold", "part", "block", "chunk").sortWithinPartitions("fold", "part", "block")
    cross = summed(both.mapInPandas(_added(["fold", "part", "block"], "y"), f"fold {kind}, part {kind}, block long, i long, c array<double>"), ["fold", "part", "block"])

    def one_block(g: pd.DataFrame) -> pd.DataFrame:
        fold = g["fold"].iloc[0]
        parts = {}
        for part, p in g.groupby("part"):
            c = np.stack(p.sort_values("i")["c"].to_numpy())
            parts[part] = Products(sent.value[fold, part], c[:-1], c[-1])
        out = pd.DataFrame(searched(parts, fold, widths, search))
        out["fold"], out["block"], out["place"] = fold, g["block"].iloc[0], np.arange(len(out))
        return out[["fold", "block", "place", "draw", "alpha", "weights", "score", "r", "r_bands"]]

    fitted = cross.groupBy("fold", "block").applyInPandas(lambda g: one_block(g), f"fold {kind}, block long, place int, draw int, alpha double, weights array<double>, score double, r double, r_bands array<double>")
    at = F.element_at("targets", F.col("place") + 1).alias("target")
    return fitted.join(names, "block").select("fold", at, "draw", "alpha", "weights", "score", "r", "r_bands")


def _added(key: list[str], other: str | None) -> Callable:
    """Cross products of x and a constant 1 with themselves or, with `other`, with that array and its own
    squares. Rows of a key come together where the products are large, so that one is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict = {}

        def out(k) -> pd.DataFrame:
            c = got.pop(k)
            frame = pd.DataFrame({"i": np.arange(len(c)), "c": list(c)})
            for name, v in zip(key, k, strict=True):
                frame[name] = v
            return frame[[*key, "i", "c"]]

        for b in pieces(batches):
            for k, g in b.groupby(key, sort=False):
                x = np.column_stack([matrix(g["x"]), np.ones(len(g))])
                if other is None:
                    c = x.T @ x
                else:
                    y = matrix(g[other])
                    c = np.vstack([x.T @ y, (y**2).sum(0)])
                    for done in [d for d in got if d != k]:
                        yield out(done)
                got[k] = got[k] + c if k in got else c
        for k in list(got):
            yield out(k)

    return run


def identity(tables: list[DataFrame]) -> str:
    """A digest of the rows of some tables, whatever their order: numbers of rows, and sums and exclusive
    ors of two hashes of the whole rows."""
    import hashlib

    parts = []
    for df in tables:
        cols = sorted(df.columns)
        h, g = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
        row = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.bit_xor(g), F.sum(g.cast("decimal(38,0)"))).head()
        parts.append([cols, [str(v) for v in row]])
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def fit_subjects(rows: DataFrame, targets: DataFrame, path: str, subjects: list[str], bands: list[str], play: list[str], row: str, partition: str, search: Search = Search(), lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Fit each of the subjects (a column `subject` of rows and targets) and write PATH/subject=...; a
    subject whose result is there and was made from the same rows, targets and settings isn't
    fitted again, one made from others raises. Returns all results with their fingerprint.

    A subject without rows raises before anything is fitted. Results are written when a subject is
    complete, with `fingerprint` in every row."""
    spark = rows.sparkSession
    present = {r[0] for r in rows.where(F.col("subject").isin(subjects)).select("subject").distinct().collect()}  # named by the caller
    lacking = sorted(set(subjects) - present)
    if lacking:
        raise checks.IntegrityError(f"no rows of {lacking}")
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in subjects:
        x, y = rows.where(F.col("subject") == s).drop("subject"), targets.where(F.col("subject") == s).drop("subject")
        mark = identity([x, y]) + f" {bands} {play} {row} {partition} {lags} {search}"
        at = f"{path.rstrip('/')}/subject={s}"
        if files.exists(jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")):
            had = spark.read.parquet(at).select("fingerprint").distinct().limit(2).collect()
            if [r.fingerprint for r in had] != [mark]:
                raise checks.IntegrityError(f"the result of {s} is of other inputs or settings")
            continue
        design = materialize(design_rows(x, bands, play, row, partition, lags))
        fitted = banded_fit(design, bands, row, partition, y, search)
        fitted.withColumn("fingerprint", F.lit(mark)).write.mode("overwrite").parquet(at)
        release(design)
    return spark.read.parquet(path).where(F.col("subject").isin(subjects))
