"""Operator 3: substring dedup by suffix automata of reference shards.

Passages that occur in several documents are found by anchors first: every window of
SIZE words holds the same smallest hash of its GRAM-word runs wherever it occurs. Only
the first occurrence of a repeated window becomes a reference. References are cut into
shards of bounded size; a shard's automaton is given to each of the tasks that stream
the documents with anchors of the shard, and matching statistics say which windows
occur in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .runtime import checked, prepare, settle
from .words import blocks, mix, signed, split

SIZE, GRAM = 50, 8
#: Words of references in a shard, and streamed passages that share one task's automaton.
SHARD_WORDS, STREAMED = 60_000, 4_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Runs:
    """Hashes of runs of words of a batch."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * _powers(_BASE, n)[:n], dtype=np.uint64))
        self.back = _powers(_INVERSE, n)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        value = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mix(value + mix(np.asarray(length, np.uint64)))


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchored(hashes: np.ndarray, ptr: np.ndarray, size: int, gram: int):
    """Runs of windows with the same anchor: (document, start, windows, anchor, digest).

    Starts count words of the batch; the digest is that of all words of a run.
    """
    n = len(hashes)
    if n < size:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    runs = _Runs(hashes)
    grams = runs.of(np.arange(n - gram + 1), gram)
    least = _smallest(grams, size - gram + 1)  # one for each window of the batch
    room = np.maximum(0, np.diff(ptr) - size + 1)
    doc = np.repeat(np.arange(len(ptr) - 1), room)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(room) - room, room) + ptr[:-1][doc]
    anchor = least[start]
    first = np.flatnonzero((np.diff(anchor, prepend=~anchor[:1]) != 0) | (np.diff(doc, prepend=-1) != 0))
    count = np.diff(np.append(first, len(doc)))
    begin = start[first]
    return doc[first], begin, count, anchor[first], runs.of(begin, count + size - 1)


def _scan(size: int, gram: int):
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            words = split(batch["text"], lower=False)
            doc, begin, count, anchor, digest = anchored(words.hashes(), words.ptr, size, gram)
            items = pa.StructArray.from_arrays(
                [
                    pa.array(signed(anchor)), pa.array(signed(digest)),
                    pa.array((begin - words.ptr[:-1][doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
                ],
                fields=list(kind.value_type),
            )
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
            sums = []
            for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
                sums.append(hashlib.sha256(b" ".join(words.text(i) for i in range(a, b))).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array(sums, pa.binary()), pa.array(words.counts()),
                    pa.ListArray.from_arrays(offsets, items, type=kind),
                ],
                names=["doc_id", "sha", "n_words", "runs"],
            )

    return run


def _twin(sha: bytes) -> int:
    """A short name of a sequence of words, which tells rows with the same id apart."""
    return int.from_bytes(sha[:8], "big", signed=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed words, each text with the name of its sequence of words."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in blocks(batches):
        twins, words = [], []
        for text in batch["text"].to_pylist():
            joined = b" ".join((text or "").encode("utf-8", "replace").split())
            twins.append(_twin(hashlib.sha256(joined).digest()))
            words.append(squeeze.compress(joined))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(twins, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "twin", "words"]
        )


def _unpacked(batch: pa.RecordBatch):
    open_ = zstandard.ZstdDecompressor().decompress
    return split(pa.array([open_(w).decode("utf-8", "replace") for w in batch["words"].to_pylist()], pa.string()), lower=False)


def _passages(size: int):
    """Word hashes of each asked run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            words = _unpacked(batch)
            hashes = words.hashes()
            rows = []
            for row, asked in enumerate(batch["asked"].to_pylist()):
                doc, twin = batch["doc_id"][row].as_py(), batch["twin"][row].as_py()
                for run_ in asked:
                    a = words.ptr[row] + run_["start"]
                    own = hashes[a : a + run_["windows"] + size - 1]
                    rows.append((run_["anchor"], doc, twin, run_["start"], run_["windows"], own.tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["anchor", "doc_id", "twin", "start", "windows", "own"],
            )

    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch["windows"]).astype(np.int64)
            found = [np.empty(0, np.uint64)]
            for own, n in zip(batch["own"].to_pylist(), counts, strict=True):
                found.append(_Runs(np.frombuffer(own, np.uint64)).of(np.arange(n), size))
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(np.asarray(batch["start"]).astype(np.int64), counts) << 32 | place
            doc = np.repeat(np.asarray(batch["doc_id"]), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(found))), pa.array(doc), pa.array(at)], names=["window", "doc_id", "at"]
            )

    return run


def _references(size: int):
    """The words of the repeated windows of a passage that occur there first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, owners, texts = [], [], []
            for anchor, doc, own, places in zip(*[batch[c].to_pylist() for c in ("anchor", "doc_id", "own", "places")], strict=True):
                at = np.unique(places)
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    anchors.append(anchor)
                    owners.append(doc)
                    texts.append(own[8 * part[0] : 8 * (part[-1] + size)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(owners, pa.int64()), pa.array(texts, pa.binary())],
                names=["anchor", "doc_id", "own"],
            )

    return run


def _stream(size: int):
    """Rows of a shard's share: its references, then the passages that are matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, automaton, closed = None, Automaton(), False
        for batch in batches:
            docs, twins, starts = [], [], []
            for *key, doc, twin, start, own in zip(*[batch[c].to_pylist() for c in ("shard", "salt", "doc_id", "twin", "start", "own")], strict=True):
                if key != share:
                    share, automaton, closed = key, Automaton(), False
                symbols = np.frombuffer(own, np.int64).tolist()
                if start is None:
                    automaton.add(symbols, doc)
                    continue
                if not closed:
                    automaton.close()
                    closed = True
                for end, hit in enumerate(automaton.matches(symbols, size, doc)):
                    if hit:
                        docs.append(doc)
                        twins.append(twin)
                        starts.append(start + end - size + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(twins, pa.int64()), pa.array(starts, pa.int32())],
                names=["doc_id", "twin", "start"],
            )

    return run


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in blocks(batches, "words"):
            removed, shas = [], []
            for packed, cuts in zip(batch["words"].to_pylist(), batch["cuts"].to_pylist(), strict=True):
                words = open_(packed).split(b" ")
                edge = np.zeros(len(words) + 1, np.int64)
                for cut in cuts:
                    edge[cut["start"]] += 1
                    edge[cut["start"] + cut["windows"] + size - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).digest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["twin"], pa.array(removed, pa.int64()), pa.array(shas, pa.binary())],
                names=["doc_id", "twin", "n_removed", "kept"],
            )

    return run


def substring_dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    A word goes if some window of ``size`` consecutive words over it also starts in a
    document with a smaller doc_id; windows are those of the input. Words are kept as
    they are; kept_sha256 is of the kept words joined by one blank. A null text has no
    words. Rows that repeat an id do not count against each other; rows with a null id
    lose nothing and nothing is lost to them. An empty table gives no rows; further
    columns are not read. Words are compared by hashes of 64 bits.
    """
    prepare(docs.sparkSession)
    read = docs.select("doc_id", "text")
    scanned = settle(
        read.mapInArrow(_scan(size, gram), "doc_id long, sha binary, n_words long, runs array<struct<anchor:long,digest:long,start:int,windows:int>>")
    )
    # The first 8 bytes of the digest as a long, as _twin() has it.
    twin = F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long").alias("twin")
    runs = scanned.filter("doc_id IS NOT NULL").select("doc_id", twin, F.explode("runs").alias("r")).select("doc_id", "twin", "r.*")
    shared = (
        runs.groupBy("anchor")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("digest") < F.max("digest")).alias("varied"))
        .filter("lo < hi")
    )
    # Runs that are equal as a whole are one: copies lose all their windows.
    met = settle(runs.join(shared.select("anchor", "lo", "varied"), "anchor"))
    first = met.filter("varied").groupBy("anchor", "digest").agg(F.min("doc_id").alias("first"))
    judged = met.join(first, ["anchor", "digest"], "left").withColumn("first", F.coalesce("first", "lo"))
    judged = settle(
        judged.filter("varied OR doc_id > first")
        .select("doc_id", "twin", "anchor", "start", "windows", (F.col("doc_id") > F.col("first")).alias("copy"))
    )
    row = ["doc_id", "twin"]
    asked = judged.filter("NOT copy").groupBy(*row).agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("asked"))
    # Compressed before they are dealt out, texts of the same row are together then.
    packed = read.filter("doc_id IS NOT NULL").mapInArrow(_packed, "doc_id long, twin long, words binary")
    near = settle(judged.select(*row).distinct())
    texts = settle(packed.join(checked(near), row, "left_semi").dropDuplicates(row))
    passages = settle(
        texts.join(asked, row).mapInArrow(
            _passages(size), "anchor long, doc_id long, twin long, start int, windows int, own binary"
        )
    )
    cuts = judged.filter("copy").select(*row, "start", "windows").unionAll(
        _matched(passages, size).withColumn("windows", F.lit(1))
    )
    per_doc = cuts.groupBy(*row).agg(F.collect_set(F.struct("start", "windows")).alias("cuts"))
    changed = texts.join(per_doc, row).mapInArrow(_remove(size), "doc_id long, twin long, n_removed long, kept binary")
    return scanned.select("doc_id", "sha", twin, "n_words").join(changed, row, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256"),
    )


def _matched(passages: DataFrame, size: int) -> DataFrame:
    """(doc_id, twin, start) of the windows found by the automata of the shards."""
    once = passages.select("anchor", "doc_id", "start", "windows", "own")
    windows = once.mapInArrow(_windows(size), "window long, doc_id long, at long")
    owners = (
        windows.groupBy("window")
        .agg(F.min(F.struct("doc_id", "at")).alias("o"), F.max("doc_id").alias("hi"))
        .filter("o.doc_id < hi")
        .groupBy("o.doc_id", F.shiftright("o.at", 32).cast("int").alias("start"))
        .agg(F.collect_list(F.col("o.at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("places"))
    )
    references = settle(
        once.select("doc_id", "anchor", "start", "own").join(owners, ["doc_id", "start"])
        .mapInArrow(_references(size), "anchor long, doc_id long, own binary")
    )
    words = references.agg(F.sum(F.length("own") / 8)).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(int(words // SHARD_WORDS) + 1)).alias("shard")
    asking = passages.join(references.select("anchor").distinct(), "anchor", "left_semi")
    streamed = asking.select(shard, "doc_id", "twin", "start", "own")
    salts = settle(asking.select(shard).groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / STREAMED).cast("int").alias("salts")))
    given = references.select(shard, "doc_id", "own").join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc_id",
        F.lit(None).cast("long").alias("twin"), F.lit(None).cast("int").alias("start"), "own",
    )
    taken = streamed.join(salts, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int").alias("salt"), "doc_id", "twin", "start", "own"
    )
    return (
        given.unionAll(taken).repartition("shard", "salt")
        .sortWithinPartitions("shard", "salt", F.col("start").isNotNull(), "doc_id")
        .mapInArrow(_stream(size), "doc_id long, twin long, start int")
    )
