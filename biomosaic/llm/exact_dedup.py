"""Operator 2: exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checked, prepare, settle, shards

_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: Runs that meet in one merge, as a power of two.
FAN_IN_BITS = 4

_DIGESTS = "doc_id long, digest binary, n_bytes long, proof long"
_RUN = "lane long, digest binary, n_bytes long, proof long, keep_id long, members long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256, length and a second, independent digest of each normalised text."""
    for batch in batches:
        sha, size, proof = [], [], []
        for text in batch["text"].cast(pa.large_binary()):
            raw = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_TO_LOWER)
            sha.append(hashlib.sha256(raw).digest())
            size.append(len(raw))
            proof.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sha, pa.binary()), pa.array(size, pa.int64()), pa.array(proof, pa.int64())],
            names=["doc_id", "digest", "n_bytes", "proof"],
        )


def digests(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_digest, _DIGESTS)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours of a sorted stream become one: the largest id and the number.

    Only the last group of a batch waits for the next batch.
    """
    names = [x.split()[0] for x in _RUN.split(", ")]
    waiting: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        digest = batch["digest"].cast(pa.large_binary())
        raw = np.frombuffer(digest.buffers()[2], np.uint8)[digest.offset * 32 :][: 32 * batch.num_rows]
        words = raw.view(np.int64).reshape(-1, 4)
        ints = {k: np.asarray(batch[k].fill_null(-(1 << 63))).astype(np.int64) for k in names if k != "digest"}
        key = np.column_stack([ints["lane"], words, ints["n_bytes"], ints["proof"]])
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        out = {k: v[first] for k, v in ints.items()}
        out["keep_id"] = np.maximum.reduceat(ints["keep_id"], first)
        out["members"] = np.add.reduceat(ints["members"], first)
        out["digest"] = [raw[32 * i : 32 * i + 32].tobytes() for i in first]
        rows = list(zip(*[out[k] if k == "digest" else out[k].tolist() for k in names], strict=True))
        if waiting and waiting[:4] == rows[0][:4]:
            rows[0] = (*rows[0][:4], max(waiting[4], rows[0][4]), waiting[5] + rows[0][5])
        elif waiting:
            rows.insert(0, waiting)
        waiting = rows.pop()
        yield _rows(rows, names)
    if waiting:
        yield _rows([waiting], names)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    arrays = []
    for name, values in zip(names, columns, strict=True):
        if name == "keep_id":  # the smallest long stands for null while runs are merged
            values = [None if v == -(1 << 63) else v for v in values]
        arrays.append(pa.array(values, pa.binary() if name == "digest" else pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def merge_runs(found: DataFrame, lanes_bits: int, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row for each distinct digest, after rounds that merge runs of lanes.

    Each row starts in one of 2**lanes_bits lanes. A round joins 2**fan_in_bits lanes
    into one: rows go by lane and digest, partitions sort them (spilling if they
    must), and equal digests of the joined runs become one row. At the end one lane
    is left, still dealt out over all partitions by digest. A digest held by a third
    of all rows has one row in each lane after the first sort, so no task gets many.
    """
    spark = found.sparkSession
    parts = shards(spark)
    runs = found.select(
        F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << lanes_bits)).alias("lane"),
        "digest", "n_bytes", "proof", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("members"),
    )
    key = ["lane", "digest", "n_bytes", "proof"]
    left = lanes_bits
    while True:
        runs = runs.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_merge, _RUN)
        if not left:
            return runs.drop("lane")
        left = max(0, left - fan_in_bits)
        runs = runs.withColumn("lane", F.pmod("lane", F.lit(1 << left)))


def exact_dedup(docs: DataFrame, lanes_bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The
    row with the largest doc_id of a group stays. Rows that repeat a doc_id and its
    text are all reported; of those with the kept id, all are marked kept. A null
    doc_id loses against any other; a group of only null ids keeps null. An empty
    table gives no rows; further columns are not read.

    Groups are keyed by SHA-256, length and a second digest together.
    """
    prepare(docs.sparkSession)
    if lanes_bits is None:
        lanes_bits = max(0, shards(docs.sparkSession) - 1).bit_length()
    found = digests(docs)
    groups = merge_runs(found, lanes_bits)
    same = ["digest", "n_bytes", "proof"]
    return found.join(groups, same).select(
        "doc_id",
        "keep_id",
        F.col("members").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = next(_digest(iter([batch])))
        yield pa.RecordBatch.from_arrays([*batch.columns, found["digest"]], names=[*batch.schema.names, _OWN])


_OWN, _KEY, _ROWS = "__exact_dedup_digest", "__exact_dedup_id", "__exact_dedup_rows"


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each distinct text.

    Of rows that share the kept id and the text, one stays; only such rows are dealt out.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    kept = settle(
        exact_dedup(docs).filter("kept")
        .groupBy(key.alias(_KEY), F.unhex("text_sha256").alias(_OWN))
        .agg(F.count(F.lit(1)).alias(_ROWS))
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    own = docs.mapInArrow(_with_digest, f"{schema}, {_OWN} binary").withColumn(_KEY, key)
    once = own.join(checked(kept.filter(F.col(_ROWS) == 1)), [_KEY, _OWN], "left_semi")
    again = own.join(checked(kept.filter(F.col(_ROWS) > 1)), [_KEY, _OWN], "left_semi").dropDuplicates([_KEY, _OWN])
    return once.unionByName(again).select(*docs.columns)
