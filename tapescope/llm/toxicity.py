"""Toxicity: boosted trees over dense text features, calibrated isotonically.

Two small passes learn from labelled rows.  The first counts in how many toxic
and other texts each word and word stem occurs and keeps those that lean to
toxic ones as a weighted lexicon.  The second turns each text into dense
features (lexicon densities, nearness of lexicon words to second-person words,
capitals, punctuation, obfuscation) and fits gradient-boosted trees; an isotonic
regression on rows the trees have not seen turns their margin into a
probability.  Features of labelled rows use a lexicon counted without their own
fold, so the trees see them as they will see new texts.

Scoring is one narrow pass over the documents.  Learning uses at most
``SAMPLE_ROWS`` labelled rows, those of smallest hash, whatever the table size.

Defined cases: null and empty texts have all features 0 and get the score that
follows; labels that are null are not used, of repeated labels of a document the
largest counts; without both classes every score is the smoothed share of toxic
labels; repeated documents are scored each; a null doc_id is not held out and
not learned from; all input columns pass through ``scored`` inside ``row``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapescope.llm.common import written

#: Labelled rows to learn from, units of the lexicon, stem lengths, texts a unit must occur in.
SAMPLE_ROWS, LEXICON_UNITS, STEMS, LEAST_TEXTS = 16_384, 2_000, (4, 5), 3
FOLDS, CACHE_WORDS = 5, 200_000
FEATURES = ("log_words", "hit_density", "log_hits", "top_weight", "weight_density", "log_kinds", "near_person", "person_density", "capitals", "capital_words",
            "punctuation", "shouts", "obfuscated", "masked_hits", "stretched", "mean_weight")
PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre usted ustedes vosotros ti tú".split())
_LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
_STRETCH = re.compile(r"(.)\1{2,}")
_UPPER, _PUNCT, _SPACE = bytes(range(65, 91)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" \t\n\r\x0b\x0c"


def units(word: str) -> list[str]:
    """A word and its stems as lexicon units."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def plain(word: str) -> tuple[str, bool]:
    """A lower-case word without edge signs, and whether it was disguised inside."""
    core = _EDGES.sub("", word)
    if core.isalpha():
        return core, False
    clear = _INNER.sub("", core.translate(_LEET))
    return clear, bool(clear) and any(c.isalpha() for c in core)


class Lexicon:
    """Weights of words, looked up by their units and remembered for a bounded number of words."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def of(self, word: str) -> tuple[float, bool, bool]:
        """(weight, disguised, second person) of a lower-case word."""
        got = self.known.get(word)
        if got is None:
            core, disguised = plain(word)
            got = (max((self.weights.get(u, 0.0) for u in units(core)), default=0.0), disguised, core in PERSON)
            if len(self.known) >= CACHE_WORDS:
                self.known = {}
            self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        raw = text.encode("utf-8", "surrogatepass")
        words = text.lower().split()
        n, size = len(words), max(1, len(raw) - (len(raw) - len(raw.translate(None, _SPACE))))
        hits, people, kinds, masked, obfuscated, stretched = [], [], set(), 0, 0, 0
        known, of = self.known, self.of
        for i, word in enumerate(words):
            weight, disguised, person = known.get(word) or of(word)
            if weight:
                hits.append((i, weight))
                kinds.add(word[:5])
                masked += disguised
            if disguised:
                obfuscated += 1
            if person:
                people.append(i)
        near = 0.0
        if hits and people:
            at = np.array(people)
            where = np.searchsorted(at, [i for i, _ in hits])
            gaps = [min(abs(i - people[max(k - 1, 0)]), abs(people[min(k, len(people) - 1)] - i)) for (i, _), k in zip(hits, where)]
            near = 1 / (1 + min(gaps))
        stretched = len(_STRETCH.findall(text))
        total, per = sum(w for _, w in hits), max(n, 1)
        upper = len(raw) - len(raw.translate(None, _UPPER))
        punct = len(raw) - len(raw.translate(None, _PUNCT))
        return [math.log1p(n), 100 * len(hits) / per, math.log1p(len(hits)), max((w for _, w in hits), default=0.0), 100 * total / per, math.log1p(len(kinds)), near,
                100 * len(people) / per, upper / size, sum(map(str.isupper, text.split())) / per if upper else 0.0, punct / size, raw.count(b"!") / size,
                obfuscated / per, math.log1p(masked), stretched / per, total / len(hits) if hits else 0.0]


_LEXICONS: dict[str | int, str | Lexicon] = {}


def _features(lexicons: list[dict[str, float]]):
    """A column function (text, number of the lexicon) -> features."""
    key = uuid.uuid4().hex  # workers outlive a query: their lexicons are those of this very function

    @F.pandas_udf("array<double>")
    def compute(text: pd.Series, which: pd.Series) -> pd.Series:
        if _LEXICONS.get("key") != key:  # one model at a time in a worker
            _LEXICONS.clear()
            _LEXICONS["key"] = key
        def one(t, k):
            if k not in _LEXICONS:
                _LEXICONS[k] = Lexicon(lexicons[k])
            return _LEXICONS[k].features(t)

        return pd.Series([one(t, k) for t, k in zip(text, which)])

    return compute


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


class Model:
    """A fitted model: lexicon, trees and calibration, or a constant score."""

    def __init__(self, weights: dict[str, float], trees=None, calibration=None, constant: float = 0.0):
        self.weights, self.trees, self.calibration, self.constant = weights, trees, calibration, constant

    def scored(self, docs: DataFrame) -> DataFrame:
        """``row`` (all columns of ``docs``) and ``score``."""
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if self.trees is None:
            return rows.withColumn("score", F.lit(float(self.constant)))
        compute = _features([self.weights])
        rows = rows.withColumn("features", array_to_vector(compute(F.col("row.text").cast("string"), F.lit(0))))
        return _calibrated(self.trees.transform(rows), self.calibration).select("row", "score")


def _margin(rows: DataFrame) -> DataFrame:
    return rows.withColumn("margin", vector_to_array("rawPrediction")[1])


def _calibrated(rows: DataFrame, calibration) -> DataFrame:
    """Calibrated probability; a hundredth of the plain one orders texts on the same step."""
    out = calibration.transform(_margin(rows))
    plain_score = 1 / (1 + F.exp(-2 * F.col("margin")))
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * plain_score)))


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, t1..t4, n1..n4): toxic texts and all texts with the unit by fold, counted in part before the shuffle."""
    names = [f"{k}{f}" for k in "tn" for f in range(1, FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts)), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(len(names)))], names=["unit", *names])

        for batch in batches:
            for text, toxic, f in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for unit in {u for w in set((text or "").lower().split()) for u in units(plain(w)[0]) if len(u) > 2}:
                    c = counts.setdefault(unit, [0] * len(names))
                    c[f - 1] += toxic
                    c[f + FOLDS - 2] += 1
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    raw = sample.select("text", "toxic", "fold").mapInArrow(run, "unit string, " + ", ".join(f"{n} long" for n in names))
    return raw.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names])


def _weights(rows: list, base: float, without: int = 0) -> dict[str, float]:
    """Log odds of the units against the base rate, shrunk towards it; fold ``without`` is left out."""
    out = {}
    for r in rows:
        t = sum(r[f"t{f}"] for f in range(1, FOLDS) if f != without)
        n = sum(r[f"n{f}"] for f in range(1, FOLDS) if f != without)
        if t >= LEAST_TEXTS - (without > 0):
            rate = (t + 2 * base) / (n + 2)
            weight = math.log(rate / (1 - rate)) - math.log(base / (1 - base))
            if weight > 1.5:
                out[r["unit"]] = weight
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled documents outside fold 0."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).withColumn("fold", fold(F.col("doc_id")).cast("int")).where("fold <> 0")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows ids and labels
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(sample.select("doc_id", "text", "toxic", "fold"), "labelled")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    parts = sample.groupBy((F.col("fold") == FOLDS - 1).alias("last")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    if len(parts) < 2 or any(p["t"] in (0, p["n"]) for p in parts):
        return Model({}, constant=(toxic + 1) / (n + 2))
    base = toxic / n
    t, all_n = sum(F.col(f"t{f}") for f in range(1, FOLDS)), sum(F.col(f"n{f}") for f in range(1, FOLDS))
    rate = (t + 2 * base) / (all_n + 2)
    leaning = _unit_counts(sample).where((t >= LEAST_TEXTS) & (rate > 3 * base / (1 + 2 * base))).orderBy(
        F.desc(F.log(rate / base) * F.sqrt(t)), "unit").limit(LEXICON_UNITS).collect()
    weights = _weights(leaning, base)
    by_fold = [_weights(leaning, base, without=f) for f in range(1, FOLDS)]
    compute = _features(by_fold)
    rows = written(sample.select("fold", F.col("toxic").cast("double").alias("label"), compute("text", F.col("fold") - 1).alias("f")).coalesce(4), "toxicity-features")
    rows = rows.withColumn("features", array_to_vector("f")).select("fold", "label", "features")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=11, minInstancesPerNode=3).fit(rows.where(F.col("fold") < FOLDS - 1))
    held = written(_margin(trees.transform(rows.where(F.col("fold") == FOLDS - 1))).select("label", "margin"), "toxicity-margins")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
    return Model(weights, trees, calibration)
