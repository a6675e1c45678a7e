"""Operator 5: toxicity by a linear classifier over naive Bayes scaled n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import buckets, spelled
from .runtime import bounded_sample, checked, fold_of, prepare, settle
from .words import blocks

#: Character n-grams and the bits of their hashes.
SIZES = (4, 5, 6)
BITS = 18
#: Labelled texts of each class that the classifier is fitted on.
SAMPLE = 5000
THRESHOLD = 0.7
#: Smoothing of the counts; standard errors by which a ratio must differ from 0;
#: strength of the penalty; passes over the sample.
ALPHA, SURE, PENALTY, PASSES = 1.0, 3.0, 1e-3, 150


def _present(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text, in order; ``seen`` is all False before and after."""
    seen[buckets(spelled(text), SIZES, BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a class each bucket occurs."""
    seen = np.zeros(1 << BITS, bool)
    for batch in blocks(batches):
        held = np.zeros((2, 1 << BITS), np.int64)
        for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
            held[label, _present(text, seen)] += 1
        label, gram = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.astype(np.int32)), pa.array(gram.astype(np.int32)), pa.array(held[label, gram])],
            names=["toxic", "gram", "n"],
        )


def log_ratios(held: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket; 0 where it is within chance."""
    good, bad = held + ALPHA
    ratio = np.log((bad / bad.sum()) / (good / good.sum()))
    return np.where(np.abs(ratio) >= SURE * np.sqrt(1 / bad + 1 / good), ratio, 0.0)


def _features(used: np.ndarray):
    """Places among the ``used`` buckets of those that a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        for batch in blocks(batches):
            found = [place[_present(t, seen)] for t in batch["text"].to_pylist()]
            grams = pa.array([x[x >= 0] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["toxic"], grams], names=["toxic", "grams"])

    return run


def fit(sample: pd.DataFrame, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients times ratios of the used buckets, and the constant.

    Logistic regression on the ratios of the buckets that a text has, with both classes
    weighted alike, by accelerated gradient steps.
    """
    y = sample["toxic"].to_numpy().astype(float)
    col = np.concatenate([*sample["grams"], np.empty(0, np.int32)]).astype(np.int32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), sample["grams"].map(len).to_numpy())
    value = ratio[col]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    # A step that suits the steepest direction: at most the mean squared length.
    step = 4 / max(1e-9, float(np.bincount(row, value * value, len(y)) @ weight + 1))
    w, b = np.zeros(len(ratio)), 0.0
    ahead, ahead_b, turn = w, b, 1.0
    for _ in range(PASSES):
        z = np.bincount(row, value * ahead[col], len(y)) + ahead_b
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        step_w = ahead - step * (np.bincount(col, value * slope[row], len(ratio)) + PENALTY * ahead)
        step_b = ahead_b - step * slope.sum()
        after = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        ahead, ahead_b = step_w + (turn - 1) / after * (step_w - w), step_b + (turn - 1) / after * (step_b - b)
        w, b, turn = step_w, step_b, after
    return w * ratio, b


def _score(model: dict[int, float]):
    used = [g for g in model if g >= 0]
    weights = np.zeros(1 << BITS)
    weights[used] = [model[g] for g in used]
    constant = model[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for batch in blocks(batches):
            scores = []
            for text in batch["text"].to_pylist():
                grams = _present(text, seen)
                z = constant + float(weights[grams].sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights of buckets, and the constant under -1, from at most ``sample`` texts a class.

    The texts are chosen by a hash of the id among labelled ones. Tasks count buckets
    and extract the telling ones; one task fits, whose input has a fixed largest size.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    known = docs.filter(F.col("text").isNotNull()).select("doc_id").join(marked, "doc_id").distinct()
    chosen = settle(bounded_sample(known, "toxic", sample, "doc_id"))
    texts = settle(docs.select("doc_id", "text").join(checked(chosen), "doc_id").select("toxic", "text"))
    if texts.select("toxic").distinct().count() < 2:
        return {-1: 0.0}
    counted = texts.mapInArrow(_held, "toxic int, gram int, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most two for each bucket
    held = np.zeros((2, 1 << BITS))
    held[np.asarray(rows["toxic"]), np.asarray(rows["gram"])] = np.asarray(rows["n"])
    ratios = log_ratios(held)
    used = np.flatnonzero(ratios)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        weights, constant = fit(part, ratios[used])
        return pd.DataFrame({"gram": np.append(used, -1), "weight": np.append(weights, constant)})

    features = texts.mapInArrow(_features(used), "toxic int, grams array<int>")
    found = features.groupBy().applyInPandas(run, "gram int, weight double").collect()
    return {r["gram"]: r["weight"] for r in found}


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``.

    Features are the distinct hashed n-grams of the letters of the whole text, each
    scaled by its log-count ratio; n-grams whose ratio is within chance are left out. Labels of
    rows whose crc32 of the id modulo 3 is 1 are not read, nor labels other than 0
    and 1; of rows that repeat an id, each counts, and contradicting labels both do.
    Texts that are null, empty or without letters score as the constant says, and
    without labels of both classes every score is 0.5. Repeated rows are scored each
    for itself; an empty table gives no rows; further columns are not read.
    """
    prepare(docs.sparkSession)
    learn = lambda frame: frame.filter(fold_of(F.col("doc_id"), 3) != 1)
    model = train(learn(docs), learn(labels), sample)
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double").select(
        "doc_id",
        (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
