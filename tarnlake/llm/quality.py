"""Quality rules under weak supervision, in DataFrame functions only.

Each rule looks at a statistic of the text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation estimates from all documents how often each rule votes good on good and
on bad documents; the posterior probability of good then decides, instead of all rules having to
pass. There are at most 3 ** len(RULES) patterns of votes whatever the corpus, so EM runs on their
counts. Texts are read once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table
from tarnlake.core.shared import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: A word of letters only, with one sign of punctuation at most.
PLAIN = r"(?<![^\x20\x09-\x0D])[\p{L}'-]+[.,;:!?]?(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """bad and good are SQL conditions on the statistics; bad wins, neither abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 50"),
    Rule("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    Rule("windows", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("letters", "10 * n_letters < 8 * word_chars", "10 * n_letters >= 9 * word_chars"),
    Rule("plain_words", "10 * n_plain < 7 * n_words", "10 * n_plain >= 9 * n_words"),
    Rule("variety", "n_words >= 20 and 100 * n_distinct < 25 * n_words", "100 * n_distinct >= 35 * n_words"),
    Rule("capitals", "n_upper * 2 > word_chars", "n_upper * 8 <= word_chars"),
    Rule("sentences", "n_stops * 60 < n_words or n_stops * 2 > n_words", "n_stops * 40 >= n_words and n_stops * 3 <= n_words"),
)
#: EM starts from, and is held by, these rates of good votes: a good document passes nearly every
#: rule that votes, and a bad one most of them, as it fails in its own way. The weight is a share of
#: all documents.
PRIOR_RATES, PRIOR_WEIGHT, PRIOR_GOOD = (0.99, 0.7), 0.02, 0.8


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words in windows of `width` words that the text has twice or more, each word once.

    Windows are sorted by hash with their places; of those with an equal neighbour the places are
    sorted again, and each covers the words up to the next place, at most `width`."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width)))
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted))

    def of_sorted(s: Column) -> Column:
        same = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | (F.get(s, k + 1)["x"].eqNullSafe(e["x"])))
        return let(F.array_sort(F.transform(same, lambda e: e["i"])), of_places)

    def of_places(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1), x + width) - x))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, of_hashes)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of docs; a null or empty text has zeros."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("w", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("l", lines)
    return rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(PLAIN)).cast("long").alias("n_plain"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_stops"),
    )


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, number of documents): the share of good documents, and for each rule the
    probabilities that a vote is good on a good and on a bad document. An abstention says nothing."""
    total = sum(n for _, n in patterns)
    k = len(patterns[0][0]) if patterns else 0
    good, rates = PRIOR_GOOD, [PRIOR_RATES] * k
    w = max(1.0, PRIOR_WEIGHT * total)
    for _ in range(steps):
        up, votes = 0.0, [[0.0, 0.0, 0.0, 0.0] for _ in range(k)]
        for v, n in patterns:
            p = posterior(v, good, rates)
            up += n * p
            for j, x in enumerate(v):
                if x:
                    c = votes[j]
                    c[0] += n * p
                    c[2] += n * (1 - p)
                    if x > 0:
                        c[1] += n * p
                        c[3] += n * (1 - p)
        new_good = (up + w * PRIOR_GOOD) / (total + w)
        new = [((c[1] + w * PRIOR_RATES[0]) / (c[0] + w), (c[3] + w * PRIOR_RATES[1]) / (c[2] + w)) for c in votes]
        moved = max([abs(new_good - good), *(abs(a - b) for x, y in zip(new, rates, strict=True) for a, b in zip(x, y, strict=True))])
        good, rates = new_good, new
        if moved < 1e-9:
            break
    return good, rates


def weights(rates: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """For each rule what a good and a bad vote add to the log odds of good."""
    return [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in rates]


def posterior(v: tuple[int, ...], good: float, rates: list[tuple[float, float]]) -> float:
    z = math.log(good / (1 - good)) + sum(w[0] if x > 0 else w[1] if x < 0 else 0.0 for x, w in zip(v, weights(rates), strict=True))
    return 1 / (1 + math.exp(-z))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The statistics of every row of docs with each rule's vote (v_name) and quality, the
    posterior probability of good. Repeated rows count each; an empty table gives an empty result;
    a text without words has the votes of zeros. Other columns are ignored."""
    rows = materialize(statistics(docs).withColumns({f"v_{r.name}": vote(r) for r in rules}))
    cols = [f"v_{r.name}" for r in rules]
    counted = rows.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(*cols).collect()  # at most 3 ** len(rules)
    good, rates = estimate([(tuple(r[c] for c in cols), r["n"]) for r in counted]) if counted else (PRIOR_GOOD, [PRIOR_RATES] * len(cols))
    z = F.lit(math.log(good / (1 - good)))
    for c, (up, down) in zip(cols, weights(rates), strict=True):
        z = z + F.when(F.col(c) > 0, up).when(F.col(c) < 0, down).otherwise(0.0)
    return rows.withColumn("quality", 1 / (1 + F.exp(-z)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality")
