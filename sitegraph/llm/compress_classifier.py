"""Operator 3: quality classifier by compression with zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts.  A text is cut
into blocks of ``BLOCK`` bytes, each is compressed once with either dictionary, and
the normalised difference ``(bad - good) / max(bad, good)`` of the total sizes says
which dictionary knows the text better.  Logistic calibration on labelled texts
that did not go into the dictionaries turns the difference into a score between 0
and 1, rising with the difference.

Fitting uses a bounded sample of the labelled training rows: ``sample`` documents
of a class (the smallest hashes of the id), half for the dictionaries (up to
``SNIPPETS`` blocks of each), half for the calibration, which is weighted by the
class counts of all labelled training rows.  Scoring takes whole texts of all
documents, and neither labels nor other columns enter a score.

Defined results: a null or empty text has difference 0; without labelled rows of
both classes every difference is 0, and the score is the smoothed share of good
labels; when there are too few samples to train a dictionary, the samples
themselves are the dictionary; a document labelled more than once is good if any
label says so; repeated rows get a row each; a null id hashes as the empty text
(held out); other columns are left aside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import crc_mod, read, utf8

FOLDS, THRESHOLD = 5, 0.3
SAMPLE, BLOCK, SNIPPETS, DICTIONARY, LEVEL = 6000, 1024, 2, 1 << 18, 3


def blocks(text: bytes) -> list[bytes]:
    return [text[k:k + BLOCK] for k in range(0, len(text), BLOCK)]


def snippets(text: bytes, most: int = SNIPPETS) -> list[bytes]:
    """Evenly spaced blocks of a text."""
    own = blocks(text)
    return [own[k * len(own) // min(most, len(own))] for k in range(min(most, len(own)))]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves when they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def score(self, difference: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-(difference * self.slope + self.intercept)))


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    if content not in _COMPRESSORS:
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(level=LEVEL)
        _COMPRESSORS[content] = zstandard.ZstdCompressor(
            dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _COMPRESSORS[content]


def size_difference(text: bytes, good: bytes, bad: bytes) -> float:
    own = blocks(text)
    if not own or not good or not bad:
        return 0.0
    a, b = compressor(good), compressor(bad)
    x = sum(len(a.compress(t)) for t in own)
    y = sum(len(b.compress(t)) for t in own)
    return (y - x) / max(x, y)


def difference(text: Column, good: bytes, bad: bytes) -> Column:
    """Column: normalised difference of the compressed sizes of the whole text."""
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([size_difference(b, good, bad) for b in utf8(texts)], type=pa.float64())

    return run.asNondeterministic()(text)


def calibration(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit (Newton steps, a weak prior
    that keeps the slope finite and not negative)."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    features = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -35, 35)))
        gradient = features.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]) / scale, 0.0), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows of the training folds."""
    known = (labels.select(F.col(key).alias("id"), F.col(label).alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
             .where(crc_mod(F.col("id"), folds) != 0))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((n_good + 1) / (n_bad + 1))
    if not n_good or not n_bad:
        return Model(b"", b"", 0.0, prior)
    hashed = known.select("id", "y", F.xxhash64("id", F.lit("sample")).alias("h"))
    chosen = [hashed.where(F.col("y") == y).orderBy("h").limit(sample) for y in (0, 1)]
    # at most 2 * sample narrow rows: broadcast, so the texts are not shuffled
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).join(
        F.broadcast(chosen[0].unionAll(chosen[1])), F.col("doc") == F.col("id")).dropDuplicates(["id"])

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([snippets(b) for b in utf8(texts)], type=pa.list_(pa.binary()))

    for_dictionary = rows.where("h % 2 = 0").select("y", "h", cut("body").alias("parts")).orderBy("h").collect()
    samples = {y: [bytes(p) for r in for_dictionary if r.y == y for p in r.parts] for y in (0, 1)}
    good, bad = dictionary(samples[1]), dictionary(samples[0])
    # a histogram of the differences of at most 2001 values per class
    held = rows.where("h % 2 != 0").select("y", F.round(difference(F.col("body"), good, bad), 3).alias("x"))
    points = held.groupBy("y", "x").agg(F.count("*").alias("n")).collect()
    of = {y: sum(p.n for p in points if p.y == y) for y in (0, 1)}
    if not good or not bad or not of[0] or not of[1]:
        return Model(good, bad, 0.0, prior)
    total = n_good + n_bad
    weight = np.array([p.n / of[p.y] * (n_good if p.y else n_bad) / total * len(points) for p in points])
    slope, intercept = calibration(np.array([p.x for p in points]), np.array([float(p.y) for p in points]), weight)
    return Model(good, bad, slope, intercept)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", folds: int = FOLDS,
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return (docs.select(F.col(key).alias("doc_id"), (crc_mod(F.col(key), folds) == 0).alias("held_out"),
                        difference(F.col(text), model.good, model.bad).alias("x"))
            .select("doc_id", "held_out", model.score(F.col("x")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))
