"""Operator 12: importance resampling of documents towards a target's distribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alnum import run_checksums, words
from .runtime import prepare, settle
from .words import blocks

#: Buckets of features, words of a feature, factor of logarithms, seed of the draw.
BUCKETS, RUN, PRECISION, SEED = 10_000, 3, 1000, 42
#: Share that is drawn, in percent, of documents with so many words.
PERCENT, LEAST_WORDS = 5, 20
#: Keys to a partition when few of them remain.
KEYS = 1_000_000

_KEY = ["behind", "doc", "row"]


def _tallied(buckets: int):
    """Features of a task's texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in blocks(batches):
            _, sums = run_checksums(words(batch["text"]), RUN)
            total += np.bincount(sums % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, counted in tasks and then summed."""
    counts = texts.select("text").mapInArrow(_tallied(buckets), "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Rounded log ratio of smoothed frequencies for each bucket, target against documents."""
    spark = documents.sparkSession
    sides = settle(
        bucket_counts(documents, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
        .unionAll(bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long"), F.col("n")))
    )
    whole = sides.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in "st"]).first()
    both = (
        sides.unionAll(spark.range(buckets).select(F.col("id"), F.lit(0).cast("long"), F.lit(0).cast("long")))
        .groupBy("bucket")
        .agg(*[F.sum(c).cast("double").alias(c) for c in "st"])
    )
    ratio = ((F.col("t") + 1.0) * F.lit(whole.s + buckets)) / ((F.col("s") + 1.0) * F.lit(whole.t + buckets))
    gains = np.zeros(buckets, np.int64)
    for r in both.select("bucket", F.floor(F.lit(float(PRECISION)) * F.ln(ratio)).alias("gain")).collect():
        gains[r.bucket] = r.gain  # as many rows as buckets, a parameter
    return gains


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = words(batch["text"])
            n = found.counts()
            document, sums = run_checksums(found, RUN)
            # Whole numbers far below 2**53, so that sums of doubles are exact.
            weight = np.bincount(document, gains[sums % np.uint32(len(gains))], batch.num_rows)
            features = np.bincount(document, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n), pa.array(features), pa.array(weight.astype(np.int64))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, a function of its id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(PRECISION)) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _medians(low: tuple | None, pivot: tuple | None, high: tuple | None):
    """One row a partition about its keys between ``low`` and ``high``: how many are at
    most the pivot, and size and median of what is below and above it. Without a pivot
    everything counts as below it."""

    def less(keys: np.ndarray, bound: tuple) -> np.ndarray:
        a, b, c = keys
        return (a < bound[0]) | ((a == bound[0]) & ((b < bound[1]) | ((b == bound[1]) & (c < bound[2]))))

    def median(keys: np.ndarray) -> tuple[int, list]:
        n = keys.shape[1]
        if not n:
            return 0, [0, 0, 0]
        return n, keys[:, np.lexsort(keys[::-1])[(n - 1) // 2]].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            keys = np.stack([np.asarray(batch[c]) for c in _KEY])
            if high is not None:
                keys = keys[:, less(keys, high)]
            if low is not None:
                keys = keys[:, ~less(keys, (*low[:2], low[2] + 1))]
            parts.append(keys)
        keys = np.concatenate(parts, 1) if parts else np.empty((3, 0), np.int64)
        if pivot is None:
            below, above, equal = keys, keys[:, :0], 0
        else:
            under, upto = less(keys, pivot), less(keys, (*pivot[:2], pivot[2] + 1))
            below, above, equal = keys[:, under], keys[:, ~upto], int(upto.sum() - under.sum())
        (n, mid), (m, top) = median(below), median(above)
        yield pa.RecordBatch.from_pylist([{"upto": n + equal, "below": n, "mid": mid, "above": m, "top": top}], schema=_FOUND)

    return run


_FOUND = pa.schema(
    [("upto", pa.int64()), ("below", pa.int64()), ("mid", pa.list_(pa.int64())), ("above", pa.int64()), ("top", pa.list_(pa.int64()))]
)


def _weighted(medians: list[tuple[list, int]]) -> tuple | None:
    """The median of partition medians, each weighted by its partition's size."""
    held = sorted((tuple(key), n) for key, n in medians if n)
    half, so_far = sum(n for _, n in held), 0
    for key, n in held:
        so_far += 2 * n
        if so_far >= half:
            return key
    return None


def _key_at(keys: DataFrame, rank: int) -> tuple:
    """The key of the given rank (1 is the smallest) of settled, different keys.

    The weighted median of the partitions' medians has at least a quarter of the
    remaining keys on either side, so a round discards a quarter or more of them, and
    the driver sees one row a partition. What remains is written again whenever it has
    shrunk to a quarter.
    """
    low = pivot = high = None
    left = written = None
    while True:
        found = keys.mapInArrow(_medians(low, pivot, high), "upto long, below long, mid array<long>, above long, top array<long>").collect()
        upto, below = sum(r.upto for r in found), sum(r.below for r in found)
        if pivot is None:
            left = written = below
        elif below < rank <= upto:
            return pivot
        elif rank <= below:
            high, left = pivot, below
        else:
            rank, low, left = rank - upto, pivot, sum(r.above for r in found)
        pivot = _weighted([(r.mid, r.below) if pivot is None or high == pivot else (r.top, r.above) for r in found])
        if 4 * left < written:
            own, key = F.struct(*_KEY), lambda k: F.struct(*[F.lit(x).cast("long") for x in k])
            kept = keys.filter((own > key(low)) if low else F.lit(True)).filter((own < key(high)) if high else F.lit(True))
            keys, written = settle(kept.coalesce(left // KEYS + 1)), left


def _ranked(winners: DataFrame) -> DataFrame:
    """Sorted rows with their rank: places in sorted partitions after the sizes of those before."""
    placed = settle(winners.orderBy(*_KEY)).select("*", F.monotonically_increasing_id().alias("_place"))
    part = F.shiftright("_place", 33).alias("_part")
    sizes = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count(F.lit(1))).collect())  # a row a partition
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    offsets = winners.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    rank = F.col("_before") + F.col("_place") - F.shiftleft("_part", 33) + 1
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", rank)


def resample(
    documents: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each document.

    Runs of 1 to 3 words fall into buckets by their checksum. A bucket's gain is the
    rounded log ratio of its smoothed frequency in ``target`` to that in ``documents``,
    a document's weight the sum of its features' gains, its score the weight with
    Gumbel noise from its id: the highest scores are a draw without replacement. Of
    the documents with ``least_words`` the highest ``percent`` are drawn and ranked.

    Null texts have no words, so weight 0 and no rank, like empty ones. A null doc_id
    takes the noise of an empty id and loses ties. Ties go to the smaller id; rows that
    agree in score and id too, repeated ones for instance, are drawn in the order of
    reading. An empty table gives no rows; a target without words leaves only the
    smoothed frequencies. Further columns are not read.
    """
    prepare(documents.sparkSession)
    gains = bucket_gains(documents, target, buckets)
    kind = documents.schema["doc_id"].dataType.simpleString()
    weighed = documents.select("doc_id", "text").mapInArrow(
        _weighed(gains), f"doc_id {kind}, n_words long, n_features long, weight long"
    )
    scored = settle(
        weighed.select(
            "doc_id", "n_features", "weight",
            (F.col("weight") + _noise(F.col("doc_id"), seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("able"),
        )
    ).withColumn("row", F.monotonically_increasing_id())
    rows = scored.withColumn("behind", -F.col("score")).withColumn(
        "doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).max))
    )
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    drawn = rows.filter("able").count() * percent // 100
    if not drawn:
        return scored.select(*columns, none)
    cutoff = _key_at(rows.filter("able").select(*_KEY), drawn)
    won = F.col("able") & (F.struct(*_KEY) <= F.struct(*[F.lit(x).cast("long") for x in cutoff]))
    return _ranked(rows.filter(won)).select(*columns, "rank").unionAll(rows.filter(~won).select(*columns, none))
