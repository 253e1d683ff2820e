"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: compatibility forms resolved, accents taken off, case folded, Latin letters of other shapes read by
their Unicode names, letters of other scripts as the Latin ones they look like, and in words that mix letters with digits or
signs, those as the letters they imitate.  The lexicon is learned: words and word beginnings (of 4 to 12 letters) that are far
more frequent in toxic training documents get the log of their odds as weight, and two-word phrases around them that
are as frequent in clean documents become exceptions.  All of them are kept: the training sample bounds their number.
The score is a logistic function of the matched weight, normalised by the text's length, fitted on
the same training rows.

Training uses labelled rows only, at most `TRAIN_ROWS` of them (those with the smallest hash of the
id; a documented bound; documents that share an id each count, and so enlarge it).  Labels, language, source and id are never inputs of a score.

Empty table: no rows.  Null or empty text: no match, so the score is that of zero weight.  Rows with
null labels do not train.  Repeated label rows train once for each.  Without any toxic or clean
training row the lexicon is empty and every score is the base rate, counted with two rows more of which
half a row is toxic: with no row at all nothing is predicted toxic.  Very long texts are matched whole,
in one pass.  Of terms that begin at one place the longest counts.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from radiotiles.llm.common import learned_from, stage

TRAIN_ROWS = 20_000
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһкмтпгвьѵӏ" "ιονρτυκαεηβγϲϳ" "օհցսոԛզ", "aeopcyxijsdqwhkmtnrbbvl" "iovptukaenbycj" "ohgunqq", strict=True))
#: Latin letters of other shapes, by name: small capitals, script, dotless and open letters, letters with strokes and hooks.
SHAPED = re.compile(r"LATIN (?:SMALL LETTER|LETTER SMALL CAPITAL) (?:SCRIPT |DOTLESS |OPEN |BARRED )?([A-Z]|ALPHA|IOTA|UPSILON)(?: WITH .+)?")
NAMED = {chr(c): {"ALPHA": "a", "IOTA": "i", "UPSILON": "u"}.get(m[1], m[1].lower()) for c in range(0x80, 0x1E00) if (m := SHAPED.fullmatch(unicodedata.name(chr(c), "")))}
#: Digits and signs that stand for letters.
IMITATED = dict(zip("013457869@$!|+€£", "oieastbgqasiltel", strict=True))
#: Combining accents U+0300 to U+036F go, as do characters without width.
FOLD = str.maketrans({**NAMED, **HOMOGLYPHS, **{chr(c): "" for c in range(0x300, 0x370)}, "​": "", "‌": "", "‍": "", "­": "", "﻿": ""})
UNMASK = str.maketrans(IMITATED)
WORD = re.compile(r"[^\W_]+(?:[@$!|+€£*_]+[^\W_]+)*|[@$][^\W_]+(?:[@$!|+]+[^\W_]+)*")
ODD = re.compile(r"[0-9@$!|+€£*_]")


def fold_word(w: str) -> str:
    if ODD.search(w) and any(c.isalpha() for c in w):
        w = w.replace("*", "").replace("_", "").translate(UNMASK)
    return w


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold().translate(FOLD)
    else:
        text = text.lower()
    words = WORD.findall(text)
    if ODD.search(text):
        words = [fold_word(w) for w in words]
    return words


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(a):
            a.make_automaton()
        return a


def matched_weight(folded: str, automaton) -> float:
    """Weight of the terms in ' word word ... '; at one place the longest term counts, and none inside
    an exception phrase."""
    if not len(automaton):
        return 0.0
    best: dict[int, float] = {}
    free: list[tuple[int, int]] = []
    longest: dict[int, int] = {}
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            free.append((start, end))
        elif n > longest.get(start, 0):
            longest[start], best[start] = n, w
    # exceptions and hits in the order of their places, each looked at once
    total, reach, at = 0.0, -1, 0
    free.sort()
    for start in sorted(best):
        while at < len(free) and free[at][0] <= start:
            reach = max(reach, free[at][1])
            at += 1
        if start >= reach:
            total += best[start]
    return total


def feature(weight: float, n_words: int) -> float:
    """Matched weight by length: a hit in a long text counts less, by the square root of its length."""
    return weight / math.sqrt(max(n_words, 25) / 25.0)


def hashed(doc_id: Column) -> Column:
    return F.xxhash64(F.lit("toxicity"), doc_id)


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, limit: int) -> DataFrame:
    """(text, toxic) of the bounded training sample."""
    own = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and i is not null").where(learned_from(F.col("i"), modulus))
    picked = own.orderBy(hashed(F.col("i")), "i", "toxic").limit(limit)
    return docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(picked), F.col("d") == F.col("i")).select("text", "toxic")


def prefixes(word: str) -> Iterator[str]:
    """Beginnings of 4 to 12 letters, and the word itself."""
    yield from (word[:k] for k in range(4, min(len(word), 12) + 1))
    if len(word) > 12 or 1 < len(word) < 4:
        yield word


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, limit: int = TRAIN_ROWS) -> Model:
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(fold(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(1)], names=["words", "toxic"])

    # read three times below, so folded once and written
    rows = stage(training_rows(docs, labels, modulus, limit).mapInArrow(folded, "words string, toxic int"), "toxicity")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each label in which a word beginning occurs."""
        seen = (Counter(), Counter())
        for batch in batches:
            for line, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(line.split())
                seen[1 if toxic else 0].update({p for w in words for p in prefixes(w)} | {""})
            if sum(map(len, seen)) > 500_000:
                yield told(seen)
                seen = (Counter(), Counter())
        if seen[0] or seen[1]:
            yield told(seen)

    def told(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(seen[0] | seen[1])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["term", "clean", "toxic"])

    counts = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = counts.where("term = ''").select("clean", "toxic").first()
    n_clean, n_toxic = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    if not n_clean or not n_toxic:
        p = (n_toxic + 0.5) / (n_clean + n_toxic + 2)  # without any row under a half, so nothing is rejected
        return Model({}, (), 0.0, math.log(p / (1 - p)))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(2, n_toxic // 200)
    found = counts.where("term != ''").where(F.col("toxic") >= least).select("term", odds.alias("w")).where("w > 3").collect()  # of the sample, whose size is bounded
    weights = {r["term"]: r["w"] for r in found}
    # a longer term says nothing new where its beginning is already as telling
    weights = {t: w for t, w in weights.items() if not any(t[:k] in weights and weights[t[:k]] >= w - 1.5 for k in range(2, len(t)))}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two-word phrases with a term, by label."""
        seen = (Counter(), Counter())
        for batch in batches:
            for line, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = line.split()
                hits = [i for i, w in enumerate(words) if any(p in weights for p in prefixes(w))]
                seen[1 if toxic else 0].update({" ".join(words[a : a + 2]) for i in hits for a in (i - 1, i) if 0 <= a < len(words) - 1})
        if seen[0] or seen[1]:
            yield told(seen)

    phrases = rows.mapInArrow(around, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = phrases.where((F.col("clean") >= 3) & (odds < -1)).collect()
    model = Model(weights, tuple(sorted(r["term"] for r in harmless)), 1.0, 0.0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = [feature(matched_weight(f" {' '.join(words)} ", automaton), len(words)) for words in map(str.split, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "toxic"])

    # at most `limit` rows of two numbers
    points = rows.mapInArrow(gather, "x double, toxic int").toPandas()
    slope, intercept = logistic(points["x"].to_numpy(), points["toxic"].to_numpy())
    return Model(weights, model.exceptions, slope, intercept)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a small ridge on the slope."""
    a, b = 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design.T @ (y - p) - np.array([ridge * a, 0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-9])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(rec, score, predicted) of every row; rec is the row as a struct."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # words of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        automaton = m.automaton()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = fold(text or "")
                x = feature(matched_weight(f" {' '.join(words)} ", automaton), len(words))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * x + m.intercept)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([int(v >= 0.5) for v in out], pa.int32())], names=["rec", "score", "predicted"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["rec"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(narrow, model).select("rec.doc_id", "score", "predicted")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic."""
    return score(docs, model).where("predicted = 0").select(*[F.col("rec").getField(c).alias(c) for c in docs.columns])
