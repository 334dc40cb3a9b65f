"""Personal data: patterns, and terms that give a protected entity away.

Emails, IP addresses, card and phone numbers are found by pattern; each distinct value is a
protected entity. What a term of an entity's documents reveals of it is their pointwise mutual information
against the entity's own information, log(N n(t,c) / n(t) n(c)) / log(N / n(c)), with counts of
documents over the whole corpus: 1 if the term occurs with that entity only. Terms above one
threshold are generalised wherever they stand in any document, above a higher one removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.core.session import table
from tarnlake.core.shared import materialize, release
from tarnlake.llm.words import free_name, quoted

KINDS = ("email", "ip", "card", "phone")
#: A pair of entity and term counts from so many documents on.
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

RE_DIGIT = re.compile(r"[0-9]")
RE_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RE_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
RE_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
RE_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ (no part of a match but its middle can be one)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = RE_TAIL.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if RE_DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in RE_IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in RE_CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[^0-9]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in RE_PHONE.finditer(text):
                if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(s: str) -> int:
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(s.encode()), "little", signed=True)


def entity(kind: str, value: str) -> int:
    return _hash(kind + ":" + (value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)))


def words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the words that are no part of any span; no ASCII punctuation at their
    ends, which may leave nothing."""
    at = [m.span() for m in RE_WORD.finditer(text)]
    starts = np.asarray([a for a, _ in at])
    ends = np.asarray([b for _, b in at])
    used = np.zeros(len(at), bool)
    for _, a, b in spans:
        used[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    for (a, b), u in zip(at, used.tolist(), strict=True):
        if not u:
            raw = text[a:b]
            head = len(raw) - len(raw.lstrip(PUNCT))
            word = raw.strip(PUNCT)
            yield word, a + head, a + head + len(word)


def term(word: str) -> int | None:
    """The number of a word as a term, which has a letter."""
    return _hash("t" + word.lower()) if any(c.isalpha() for c in word) else None


FIELDS = [("tag", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("term", pa.int64()), ("n", pa.int64())]
SQL_TYPE = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
DOC, TERM = range(2)
#: Distinct terms that a task counts before it hands on what it has.
TERM_TABLE = 400_000


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to document rows, with the distinct entities and, if there are any, all
    distinct terms; and document counts of terms."""
    names = [f for f, _ in FIELDS]
    known: dict[bytes, int | None] = {}
    df: dict[int, int] = {}

    def counts() -> pa.RecordBatch:
        k = len(df)
        cols = {"tag": pa.array(np.full(k, TERM), pa.int32()), "term": pa.array(np.fromiter(df.keys(), np.int64, k)), "n": pa.array(np.fromiter(df.values(), np.int64, k))}
        return pa.RecordBatch.from_arrays([cols.get(f, pa.nulls(k, t)) for f, t in FIELDS], names)

    for b in batches:
        rows: dict[str, list] = {f: [] for f in names}

        def put(tag: int, rows=rows, **x) -> None:
            for f in names:
                rows[f].append(x.get(f))
            rows["tag"][-1] = tag

        for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            spans = find(text) if text else []
            n = {f"n_{k}": 0 for k in KINDS}
            for k, _, _ in spans:
                n[f"n_{k}"] += 1
            more = {}
            if spans:
                own = {w for w, _, _ in words(text, spans)}
                more = {"entities": list({entity(k, text[a:z]) for k, a, z in spans}), "terms": list({term(w) for w in own} - {None})}
            put(DOC, doc_id=doc, row=key, base=joined(spans), **n, **more)
            if text:
                if len(known) > TERM_TABLE:
                    known.clear()
                met = set()
                for w in set(text.encode().split()):  # at ASCII white space, as RE_WORD
                    if w not in known:
                        known[w] = term(w.decode().strip(PUNCT))
                    met.add(known[w])
                met.discard(None)
                for h in met:
                    df[h] = df.get(h, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(rows[f], t) for f, t in FIELDS], names)
        if len(df) > TERM_TABLE:
            yield counts()
            df.clear()
    if df:
        yield counts()


#: Bits of the table by which a task passes over words that are no disclosing terms (4 MB).
BITS = 1 << 25
#: The most frequent terms, those that can't reach the threshold with any entity, are left out before terms are paired.
FREQUENT = 50_000


SPACES = frozenset(" \t\n\x0b\x0c\r")


def standing(text: str, word: str) -> Iterator[int]:
    """Where a word stands between white space."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if (at == 0 or text[at - 1] in SPACES) and (end == len(text) or text[end] in SPACES):
            yield at
        at = text.find(word, at + 1)


def _places(bits: bytes):
    """(doc_id, row, text) to the words that may be disclosing terms, by `bits`."""

    def may(word: str) -> int | None:
        h = term(word)
        return h if h is not None and bits[(h % BITS) >> 3] >> (h % 8) & 1 else None

    def find_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int | None] = {}
        for b in batches:
            out: list[tuple] = []
            for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                if len(known) > TERM_TABLE:
                    known.clear()
                some = []
                for w in set(text.encode().split()):  # at ASCII white space, as RE_WORD
                    if w not in known:
                        known[w] = may(w.decode().strip(PUNCT))
                    if known[w] is not None:
                        some.append((w.decode(), known[w]))
                spans = find(text) if some else []
                for raw, h in some:
                    word = raw.strip(PUNCT)
                    head = raw.find(word)
                    for at in standing(text, raw):
                        if not any(at + len(raw) > s and at < e for _, s, e in spans):
                            out.append((doc, key, h, at + head, at + head + len(word)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 2, strict=True)], ["doc_id", "row", "term", "start", "end"])

    return find_places


def _row() -> F.Column:
    return F.xxhash64("doc_id", "text")


#: What tells one set of documents from another: their number and three sums over them.
SET = ("n", "a", "b", "c")


def _by_set(rows: DataFrame, name: str) -> DataFrame:
    """Each value of `name` with the number and the mark of the documents (uid) it is in."""
    h, g, low = F.xxhash64("uid"), F.xxhash64(F.lit(1), "uid"), F.lit(0xFFFFFFFF)
    sums = F.sum(h.bitwiseAND(low)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(g.bitwiseAND(low))
    return rows.groupBy(name).agg(F.count("*").alias("n"), *[x.alias(c) for x, c in zip(sums, SET[1:], strict=True)]).where(F.col("n") >= SUPPORT)


def disclosing(all_: DataFrame, total: float) -> DataFrame:
    """term and share (the highest with any entity) of the terms from GENERALISE on.

    both <= n_entity, so a pair reaches it only if n_term <= N^(1 - GENERALISE) n_entity^GENERALISE;
    what is left out for that before pairs are counted couldn't be in the result. Entities that are in
    the same documents count the same with any term, and so do such terms: a document writes its
    entities and its terms once each, and what is paired are the sets of documents they stand for, so
    that a long list of addresses, or copies of one, is a single set."""
    own = all_.where(f"tag = {DOC} and entities is not null").select("uid", "entities", "terms")
    of_entity = own.select("uid", F.explode("entities").alias("entity"))
    entities = materialize(_by_set(of_entity, "entity"))
    counts = materialize(all_.where(f"tag = {TERM}").groupBy("term").agg(F.sum("n").alias("n_term")).where(F.col("n_term") >= SUPPORT))
    most = entities.agg(F.max("n")).head()[0] or 0
    cap = 1.001 * total ** (1 - GENERALISE) * most**GENERALISE
    frequent = counts.where(F.col("n_term") > cap).orderBy(F.desc("n_term")).limit(FREQUENT).select("term")
    of_term = own.select("uid", F.explode("terms").alias("term")).join(F.broadcast(frequent), "term", "left_anti")
    terms = materialize(_by_set(of_term, "term").join(counts, "term"))
    entity_set, term_set = F.struct(*SET).alias("entity_set"), F.struct("n_term", *SET).alias("term_set")
    sides = of_entity.join(entities, "entity").select("uid", entity_set).distinct(), of_term.join(terms, "term").select("uid", term_set).distinct()
    pairs = sides[0].join(sides[1], "uid").groupBy("entity_set", "term_set").agg(F.count("*").alias("both")).where(F.col("both") >= SUPPORT)
    n_entity, n_term = F.col("entity_set.n"), F.col("term_set.n_term")
    info = F.log(F.lit(max(total, 1.0)) / n_entity)
    pmi = F.log(F.lit(max(total, 1.0)) * F.col("both") / (n_term * n_entity))
    shown = pairs.where(info > 0).select("term_set", (pmi / info).alias("share")).where(F.col("share") >= GENERALISE)
    shown = shown.groupBy("term_set").agg(F.max("share").alias("share"))
    found = materialize(terms.select("term", term_set).join(shown, "term_set").select("term", "share"))
    release(entities, counts, terms)
    return found


def detect(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document rows (doc_id, row, counts by kind, base) and the disclosing terms by row: terms
    as array<struct<start, end, share, remove>> in order, for rows that have any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", _row().alias("row"), "text")
    all_ = materialize(rows.mapInArrow(_gather, ", ".join(f"{f} {SQL_TYPE[t]}" for f, t in FIELDS)).withColumn("uid", F.monotonically_increasing_id()))
    found = all_.where(f"tag = {DOC}").select("doc_id", "row", *[f"n_{k}" for k in KINDS], "base")
    shown = disclosing(all_, float(found.count()))
    bits = bytearray(BITS // 8)
    at = shown.select(F.pmod("term", F.lit(BITS)).alias("bit"))
    at = at.groupBy((F.col("bit") / 32768).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    for r in at.collect():  # BITS / 32768 at most, 4 KB each
        bits[r["page"] * 4096 : (r["page"] + 1) * 4096] = r["bits"]
    places = rows.mapInArrow(_places(bytes(bits)), "doc_id long, row long, term long, start int, end int")
    hit = places.join(shown, "term").groupBy("doc_id", "row", "start", "end").agg(F.max("share").alias("share"))
    span = F.struct("start", "end", "share", (F.col("share") >= REMOVE).alias("remove"))
    return found, hit.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base (spans by pattern) and terms of every row of docs.

    A null or empty text has none; repeated rows count each; a null doc_id is like any other.
    An empty table gives an empty result; other columns are ignored."""
    found, terms = detect(docs)
    t = terms.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), "terms")
    return found.join(t, F.col("row").eqNullSafe(F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d", "_r")


@F.pandas_udf(T.StringType())
def sanitised(text: pd.Series, terms: pd.Series) -> pd.Series:
    """The text with its base spans replaced by marks, and its terms removed or replaced."""

    def one(t: str | None, more) -> str | None:
        if not t:
            return t
        cuts = [(a, b, MARKS[k]) for k, a, b in find(t)]
        if more is not None:
            cuts += [(int(m["start"]), int(m["end"]), "" if m["remove"] else "[TERM]") for m in more]
        out, at = [], 0
        for a, b, mark in sorted(cuts, key=lambda c: (c[0], -c[1])):
            if a >= at:
                out += [t[at:a], mark]
            at = max(at, b)
        return "".join([*out, t[at:]])

    return pd.Series([one(t, m) for t, m in zip(text, terms, strict=True)], dtype=object)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the text sanitised, and n_chars that of the new text where docs has it."""
    _, terms = detect(docs)
    i, r, t = (free_name(n, docs) for n in ("_tl_id", "_tl_row", "_tl_terms"))
    found = terms.select(F.col("doc_id").alias(i), F.col("row").alias(r), F.col("terms").alias(t))
    same = (F.xxhash64(F.col("doc_id").cast("long"), "text") == F.col(r)) & F.col("doc_id").cast("long").eqNullSafe(F.col(i))
    both = docs.join(found, same, "left")
    both = both.withColumn("text", sanitised("text", t))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*[quoted(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(table(spark, sf_dir, "documents"))
    more = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"])), ",")
    both = F.concat_ws(",", F.nullif("base", F.lit("")), more)
    return got.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), both.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def base_sha256(text: str | None) -> str:
    return hashlib.sha256(joined(find(text or "")).encode()).hexdigest()
