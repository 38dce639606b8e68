"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, characters that are no letters become one space, and its features are the hashes (to 2**BITS) of
its distinct character n-grams, over the whole text. Each feature is scaled by the log ratio of its smoothed document
frequencies in toxic and other training texts; a logistic regression with L2 penalty learns the weights on top.

It is fitted on at most SAMPLE labelled documents, those with the smallest hash of doc_id among the rows that may be
learnt from: crc32 of the doc_id as text, modulo 5, is not 0. Labels are looked up for these alone; language, source and
doc_id are never features. Fitting needs memory for the sample only, scoring for one slice of texts.

Defined results: null text is empty and scores as the intercept does; a doc_id with several labels is toxic if one of
them says so, and is learnt from by its smallest text; labels without a document, or null, are ignored; without labels of both kinds every score is the share of
toxic ones (0 without any); repeated rows are scored one by one; empty tables give no rows; a null doc_id is not held
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import batch_slices, cut, hash_sample, keep_only, lean, mix, slices

ORDERS = (4, 5)
BITS = 22
SAMPLE = 8000
FOLDS = 5
#: Features that fewer training documents hold, or whose log-count ratio is nearer to 0, are left out.
LEAST_DOCUMENTS = 3
LEAST_RATIO = 0.7
PENALTY = 1e-3
STEPS = 300

_LETTERS: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space for every run of other characters and at both ends."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _LETTERS[0][x]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, x, 32)[keep].astype(np.uint64)


def features(text: str | None, of_interest: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct feature numbers; with a table of interest, only those that it marks."""
    x = _codes(text or "")
    found = []
    for n in ORDERS:
        if len(x) >= n:
            h = np.full(len(x) - n + 1, np.uint64(n))
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - n + 1 + k]
            h = (mix(h) >> np.uint64(64 - BITS)).astype(np.int32)
            found.append(h if of_interest is None else h[of_interest[h]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    at: np.ndarray
    weights: np.ndarray
    intercept: float


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.interest = np.zeros(1 << BITS, bool)
        self.interest[model.at] = True

    def score(self, text: str | None) -> float:
        have = features(text, self.interest)
        margin = self.model.intercept + float(self.model.weights[np.searchsorted(self.model.at, have)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train_rows(rows: list[np.ndarray], toxic: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> Model:
    """A model from the chosen features (sorted numbers at, scaled by ratio) of training documents and their labels."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    column = np.searchsorted(at, np.concatenate(rows)).astype(np.int32)
    value = ratio[column]
    w, b = np.zeros(len(at)), float(np.log(share / (1 - share)))
    mean_w, mean_b, var_w, var_b = np.zeros(len(at)), 0.0, np.zeros(len(at)), 0.0
    for t in range(1, STEPS + 1):
        margin = b + np.bincount(owner, weights=value * w[column], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic
        grad_w = np.bincount(column, weights=value * error[owner], minlength=len(at)) / len(rows) + PENALTY * w
        grad_b = error.mean()
        mean_w, mean_b = 0.9 * mean_w + 0.1 * grad_w, 0.9 * mean_b + 0.1 * grad_b
        var_w, var_b = 0.99 * var_w + 0.01 * grad_w**2, 0.99 * var_b + 0.01 * grad_b**2
        rate = 0.03 / np.sqrt(t / 50 + 1)
        w -= rate * (mean_w / (1 - 0.9**t)) / (np.sqrt(var_w / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mean_b / (1 - 0.9**t)) / (np.sqrt(var_b / (1 - 0.99**t)) + 1e-8)
    return Model(at, w * ratio, b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, and how many toxic and other documents of a slice hold it."""
    keep_only()
    for toxic, texts in slices(batches, ("toxic", "text"), "text"):
        held = [features(t) for t in texts]
        flat = np.concatenate(held)
        of_toxic = np.repeat(np.array(toxic, bool), [len(h) for h in held])
        found, inverse = np.unique(flat, return_inverse=True)
        ones = np.bincount(inverse, weights=of_toxic, minlength=len(found)).astype(np.int64)
        every = np.bincount(inverse, minlength=len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(ones), pa.array(every - ones)], names=["feature", "in_toxic", "in_other"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled documents outside the held-out fold. Executors count features and choose those
    that matter; the driver sees no more than these."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).dropna().where(~held_out())
    chosen = hash_sample(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")), "doc_id", sample)
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    # one text of each doc_id, so that rows that repeat one do not pass the bound
    texts = cut(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text"), "toxicity-sample")
    ones, every = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    counts = texts.mapInArrow(lean(_counts), "feature int, in_toxic bigint, in_other bigint").groupBy("feature").agg(F.sum("in_toxic").alias("a"), F.sum("in_other").alias("b"))
    ratio = F.log((F.col("a") + 1) / (ones + 2)) - F.log((F.col("b") + 1) / (every - ones + 2))
    kept = counts.where(F.col("a") + F.col("b") >= LEAST_DOCUMENTS).select("feature", ratio.alias("ratio")).where(F.abs("ratio") >= LEAST_RATIO).toPandas().sort_values("feature")
    at = kept["feature"].to_numpy(np.int32)
    at_of = docs.sparkSession.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interest = np.zeros(1 << BITS, bool)
        interest[at_of.value] = True
        for toxic, texts in slices(batches, ("toxic", "text"), "text"):
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([features(t, interest).tobytes() for t in texts], pa.binary())], names=["toxic", "features"])

    rows = texts.mapInArrow(lean(run), "toxic int, features binary").collect()
    rows.sort(key=lambda r: (r.toxic, r.features))
    return train_rows([np.frombuffer(r.features, np.int32) for r in rows], np.array([r.toxic for r in rows]), at, kept["ratio"].to_numpy(float))


def classify(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The columns to keep, score and predicted of every row of docs(text, ...)."""
    model_of = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = StructType([*docs.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        scorer = Scorer(model_of.value)
        for batch in batch_slices(batches, "_text"):
            scores = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            out = [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "score", "predicted"])

    return docs.mapInArrow(lean(run), schema)


def report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text"))
    return classify(docs, fit(docs, labels, sample), ("doc_id",)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
