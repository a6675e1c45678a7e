"""Operator 1: language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import packed, spelled
from .runtime import bounded_sample, checked, fold_of, prepare, settle
from .words import blocks, tally

UNKNOWN = "und"
#: n-grams of 1 to 3 characters; ranks kept of a language and looked at in a text.
SIZES = (1, 2, 3)
PROFILE = 400
#: Labelled texts of a language that its profile is made from.
SAMPLE = 2000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        langs = np.array(batch["lang"].to_pylist(), object)
        texts = np.array(batch["text"].to_pylist(), object)
        for lang in sorted(set(langs)):
            codes = [spelled(t) for t in texts[langs == lang]]
            grams = [packed(c, n) for c in codes for n in SIZES]
            keys, n = tally(np.concatenate(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"]
            )


def profiles(labelled: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the most frequent n-grams of each language, by count, then code.

    ``labelled`` has doc_id, lang and text. At most ``sample`` texts of a language,
    chosen by a hash of the id, are read whole; rows without text or lang are not used.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # Ids alone are ranked; the chosen, few, are then looked up where the texts are read.
    chosen = settle(bounded_sample(usable.select("doc_id", "lang"), "lang", sample, "doc_id"))
    texts = usable.select("doc_id", "lang", "text").join(checked(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = texts.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size).select("lang", "gram", "rank")


def _frequent(codes: np.ndarray, size: int) -> np.ndarray:
    grams = np.sort(np.concatenate([packed(codes, n) for n in SIZES]))
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    counts = np.diff(np.append(first, len(grams)))
    keys = grams[first]
    if len(keys) > size:  # those that may be among the first, ties included
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:size]


def _predict(model: list[tuple[str, int, int]], size: int):
    langs = sorted({lang for lang, _, _ in model})
    vocabulary = np.unique(np.array([gram for _, gram, _ in model], np.int64))
    ranks = np.full((len(vocabulary) + 1, len(langs)), size, np.int64)  # absent: the largest distance
    place = {lang: i for i, lang in enumerate(langs)}
    for lang, gram, rank in model:
        ranks[np.searchsorted(vocabulary, gram), place[lang]] = rank

    def one(text: str | None) -> tuple[str, float, bool]:
        codes = spelled(text)
        if not len(codes) or not langs:
            return UNKNOWN, 0.0, len(codes) > 0
        grams = _frequent(codes, size)
        at = np.searchsorted(vocabulary, grams)
        known = at < len(vocabulary)
        known[known] = vocabulary[at[known]] == grams[known]
        rows = ranks[np.where(known, at, len(vocabulary))]
        away = np.where(rows < size, np.abs(rows - np.arange(len(grams))[:, None]), size).sum(0)
        best = int(away.argmin())
        return langs[best], float(1 - away[best] / (size * len(grams))), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [one(t) for t in batch["text"].to_pylist()]
            lang = pa.array([x[0] for x in found], pa.string())
            score = pa.array([x[1] for x in found], pa.float64())
            letters = pa.array([x[2] for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lang, score, letters], names=[*batch.schema.names, _LANG, _SCORE, _LETTERS]
            )

    return run


_LANG, _SCORE, _LETTERS = "__language_id_lang", "__language_id_score", "__language_id_letters"


def tagged(docs: DataFrame, model: DataFrame, columns: list[str], size: int = PROFILE) -> DataFrame:
    """``columns`` of ``docs`` (text among them), the predicted language, its score
    and whether the text has a letter.

    A profile has ``size`` rows and there are as many as languages labelled, so that
    the model is small whatever the corpus; it goes to the tasks with the code.
    """
    rows = [(r["lang"], r["gram"], r["rank"]) for r in model.collect()]
    read = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema)
    return read.mapInArrow(_predict(rows, size), f"{schema}, {_LANG} string, {_SCORE} double, {_LETTERS} boolean")


def labelled_part(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    return docs.filter(fold_of(F.col("doc_id"), folds) != held).select("doc_id", "lang", "text")


def language_id(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs``.

    A text's ``size`` most frequent n-grams are compared with each profile; the sum of
    the differences of ranks (``size`` where a profile lacks the n-gram) is the
    distance, the nearest profile's language is predicted, the first name among equals.
    The score is 1 less the distance over its largest value. Texts that are null,
    empty or without a letter are `und` with score 0, and so is every text where no
    row is labelled. Repeated rows are judged each for itself; an empty table gives
    no rows; further columns are not read. A row with a null doc_id is not held out.
    """
    prepare(docs.sparkSession)
    model = profiles(labelled_part(docs), sample, size)
    return tagged(docs, model, ["doc_id", "text"], size).select(
        "doc_id",
        (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col(_LANG).alias("lang_pred"),
        F.col(_SCORE).alias("score"),
    )


def identified(docs: DataFrame, sample: int = SAMPLE, size: int = PROFILE) -> DataFrame:
    """The rows of ``docs`` with a letter to tell a language by, with their columns.

    Rows whose text is null, empty or without a letter go; where no row is labelled no
    language is judged, and rows with a letter stay.
    """
    prepare(docs.sparkSession)
    model = profiles(labelled_part(docs), sample, size)
    return tagged(docs, model, docs.columns, size).filter(F.col(_LETTERS)).select(*docs.columns)
