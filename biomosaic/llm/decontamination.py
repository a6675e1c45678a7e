"""Operator 11: benchmark passages in training texts, found in a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alnum import words
from .runtime import checked, prepare, settle
from .words import blocks

WIDTH = 10
#: Bytes of text in a segment of the index; a longer text is a segment of its own.
SEGMENT = 1 << 22
#: Windows that a task holds at once; further ones are further passes over the index.
WINDOWS = 200_000
#: Candidate places that are intersected at a time.
PLACES = 1 << 21

_INDEX = "docs array<{}>, sizes array<int>, terms binary, starts binary, places binary"
_FOUND = "segment long, document int, doc_id {}, n_words long, numbers array<long>, starts array<int>, lengths array<int>"


def _bytes(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def _numbers(data: pa.Scalar, kind: type, count: int) -> np.ndarray:
    wide = count * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data.as_buffer(), wide, "zstd") if count else b"", kind)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment a row: its terms, sorted, and the places of each, ascending.

    Documents stand one after another with a place between them that no word has.
    Places are kept as differences, which compress.
    """
    for batch in blocks(batches, size=SEGMENT):
        found = words(batch["text"])
        key, sizes = found.hashes(), found.counts()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]])) if len(order) else order
        place = (np.arange(len(key)) + found.documents())[order].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch["doc_id"]),
                pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(sizes.astype(np.int32))),
                pa.array([_bytes(key[order][first])], pa.binary()),
                pa.array([len(first).to_bytes(8, "little") + _bytes(first.astype(np.int32))], pa.binary()),
                pa.array([_bytes(np.diff(place, prepend=np.int32(0)))], pa.binary()),
            ],
            names=["docs", "sizes", "terms", "starts", "places"],
        )


def positional_index(docs: DataFrame) -> DataFrame:
    """Postings of all words of all texts, by segments of documents, written once.

    A segment holds the postings of its documents, so that no posting is shuffled, a hot
    word is spread like the documents that use it, and terms of a phrase meet in a task.
    Words are known by 64-bit hashes.
    """
    prepare(docs.sparkSession)
    # Segments are rows of some MB.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 26))
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = docs.select("doc_id", "text").mapInArrow(_indexed, _INDEX.format(kind))
    return settle(index).withColumn("segment", F.monotonically_increasing_id())


def _windows(width: int):
    """Different windows of a task's items: their words' hashes, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = words(batch["text"])
            key = found.hashes()
            for i in np.flatnonzero(found.counts()):
                own = key[found.ptr[i] : found.ptr[i + 1]]
                runs = np.unique(np.lib.stride_tricks.sliding_window_view(own, min(width, len(own))), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["item_id"].take(pa.array(np.full(len(runs), i))),
                        pa.array([r.tobytes() for r in runs], pa.binary()),
                    ],
                    names=["item_id", "window"],
                )

    return run


def item_windows(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(number, window) of the different windows and (number, item_id) of their items."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = settle(items.select("item_id", "text").mapInArrow(_windows(width), f"item_id {kind}, window binary"))
    windows = settle(found.select("window").distinct()).withColumn("number", F.monotonically_increasing_id())
    held = settle(found.join(windows, "window").select("number", "item_id").filter(F.col("item_id").isNotNull()).distinct())
    return windows, held


@dataclass
class _Query:
    """Windows as places in the sorted list of their terms; -1 behind a shorter one's end."""

    numbers: np.ndarray
    terms: np.ndarray
    slots: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, rows: list) -> _Query:
        rows = sorted(rows, key=lambda r: r.number)
        length = np.array([len(r.window) // 8 for r in rows])
        flat = np.frombuffer(b"".join(r.window for r in rows), np.uint64)
        terms, place = np.unique(flat, return_inverse=True)
        slots = np.full((len(rows), int(length.max())), -1)
        slots[np.arange(slots.shape[1]) < length[:, None]] = place
        return cls(np.array([r.number for r in rows]), terms, slots, length)


class _Postings:
    """A segment's postings of the query's terms, searchable by (term, place)."""

    def __init__(self, segment: dict, query: _Query):
        sizes = np.asarray(segment["sizes"].values, np.int64)
        self.base = np.cumsum(sizes + 1) - sizes - 1  # place of each document's first word
        n = int(sizes.sum())
        starts = segment["starts"].as_buffer().to_pybytes()
        count = int.from_bytes(starts[:8], "little")
        terms = _numbers(segment["terms"], np.uint64, count)
        starts = np.append(_numbers(pa.scalar(starts[8:], pa.binary()), np.int32, count), n).astype(np.int64)
        places = np.cumsum(_numbers(segment["places"], np.int32, n), dtype=np.int64)
        at = np.minimum(np.searchsorted(terms, query.terms), max(0, count - 1))
        held = terms[at] == query.terms if count else np.zeros(len(query.terms), bool)
        self.count = np.where(held, starts[at + 1] - starts[at], 0) if count else held.astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        pick = _ramps(np.where(held, starts[at], 0) if count else at, self.count)
        self.place = places[pick]
        self.span = n + len(sizes) + 1
        self.key = np.repeat(np.arange(len(at)), self.count) * self.span + self.place

    def following(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The term's first place at or after the given one, -1 if there is none."""
        at = np.searchsorted(self.key, term * self.span + np.clip(place, 0, self.span - 1))
        at = np.minimum(at, max(0, len(self.key) - 1))
        found = self.key[at] - term * self.span
        return np.where((found >= place) & (found >= 0) & (found < self.span), found, -1)


def _ramps(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of count[i] numbers each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _seeds(postings: _Postings, query: _Query) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place of its rarest term, the window's words from the rarest term on).

    Windows of which the segment lacks a term are left out at once.
    """
    real = query.slots >= 0
    often = np.where(real, postings.count[query.slots], np.iinfo(np.int64).max)
    window = np.flatnonzero(often.min(1) > 0)
    order = np.argsort(often[window], axis=1, kind="stable")
    term = query.slots[window, order[:, 0]]
    count = postings.count[term]
    part = (np.cumsum(count) - count) // PLACES
    for p in np.unique(part):
        own = part == p
        times = count[own]
        yield (
            np.repeat(window[own], times),
            postings.place[_ramps(postings.first[term[own]], times)],
            np.repeat(order[own], times, axis=0),
        )


def _phrases(postings: _Postings, query: _Query) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place, length) of exact occurrences: lists of places less the word's
    offset in the window, intersected from the rarest word's on."""
    for window, place, order in _seeds(postings, query):
        start = place - order[:, 0]
        for step in range(1, order.shape[1]):
            word = order[:, step]
            more = step < query.length[window]
            term = np.where(more, query.slots[window, word], 0)
            keep = ~more | (postings.following(term, start + word) == start + word) & (start >= 0)
            window, start, order = window[keep], start[keep], order[keep]
        yield window, start, query.length[window]


def _near(slop: int):
    """(window, place, length) of the runs of at most window + ``slop`` words that hold
    all of a window's different words, in any order, and begin and end with one."""

    def run(postings: _Postings, query: _Query) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for window, place, order in _seeds(postings, query):
            widest, runs = query.length[window] + slop, []
            for back in range(int(widest.max()) - 1 if len(widest) else -1, -1, -1):
                begin = place - back
                keep = (back < widest) & (begin >= 0)
                low, high = np.full(len(window), postings.span), np.full(len(window), -1)
                for step in range(order.shape[1]):
                    more = step < query.length[window]
                    term = np.where(more, query.slots[window, order[:, step]], 0)
                    found = postings.following(term, begin)
                    keep &= ~more | (found >= 0) & (found < begin + widest)
                    low = np.where(more, np.minimum(low, found), low)
                    high = np.where(more, np.maximum(high, found), high)
                keep &= low == begin
                keep &= np.searchsorted(postings.base, low, "right") == np.searchsorted(postings.base, high, "right")
                runs.append(np.stack([window[keep], begin[keep], (high - low + 1)[keep]]))
            if runs:
                yield tuple(np.unique(np.concatenate(runs, 1), axis=1))

    return run


def _searched(query: _Query, find):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = {name: batch[name][i] for name in batch.schema.names}
                postings = _Postings(segment, query)
                hits = [np.stack(h) for h in find(postings, query)]
                window, place, length = np.concatenate([*hits, np.empty((3, 0), np.int64)], 1)
                document = np.searchsorted(postings.base, place, "right") - 1
                order = np.lexsort((window, place, document))
                document, place = document[order], place[order]
                ends = np.searchsorted(document, np.arange(len(postings.base) + 1)).astype(np.int32)
                lists = [query.numbers[window[order]], (place - postings.base[document]).astype(np.int32), length[order].astype(np.int32)]
                n = len(postings.base)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, segment["segment"].as_py())),
                        pa.array(np.arange(n, dtype=np.int32)),
                        segment["docs"].values,
                        pa.array(np.asarray(segment["sizes"].values, np.int64)),
                        *[pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in lists],
                    ],
                    names=["segment", "document", "doc_id", "n_words", "numbers", "starts", "lengths"],
                )

    return run


def matches(index: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Where windows occur: one row a document with the arrays numbers, starts, lengths.

    Element i says that window ``numbers[i]`` occurs in the ``lengths[i]`` words from
    word ``starts[i]`` on. Without ``slop`` occurrences are exact phrases; with it they
    are all shortest runs from their first word on, of at most as many words as the
    window and ``slop`` more, that hold all its different words in any order.

    The query is searched in blocks of WINDOWS windows, dealt by hash: each is one pass
    over the index, and is all that a task or the driver holds of the items.
    """
    kind = index.schema["docs"].dataType.elementType.simpleString()
    parts = -(-windows.count() // WINDOWS) or 1
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("window"), F.lit(parts)))
    find = _phrases if slop is None else _near(slop)
    found = None
    for part in range(parts):
        query = dealt.filter(F.col("part") == part).select("number", "window").collect()
        if query or part == parts - 1 and found is None:
            query = _Query.of(query) if query else _Query(*[np.empty(0, np.int64)] * 2, np.empty((0, 1), int), np.empty(0, int))
            own = index.mapInArrow(_searched(query, find), _FOUND.format(kind))
            found = own if found is None else found.unionAll(own)
    if parts == 1:
        return found
    together = [F.flatten(F.collect_list(c)).alias(c) for c in ("numbers", "starts", "lengths")]
    return found.groupBy("segment", "document", "doc_id", "n_words").agg(*together)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words inside any occurrence, and the different windows, of each document."""
    for batch in batches:
        hit = np.zeros(batch.num_rows, np.int64)
        numbers = [[]] * batch.num_rows
        for i in np.flatnonzero(np.asarray(batch["numbers"].value_lengths())):
            a, n = (np.asarray(batch[c][i].values, np.int64) for c in ("starts", "lengths"))
            order = np.argsort(a, kind="stable")
            a, b = a[order], (a + n)[order]
            reach = np.maximum.accumulate(b)  # what is covered up to here
            hit[i] = np.maximum(0, b - np.maximum(a, np.append(0, reach[:-1]))).sum()
            numbers[i] = np.unique(np.asarray(batch["numbers"][i].values))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["n_words"], pa.array(hit), pa.array(numbers, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "n_hit", "numbers"],
        )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document.

    A window is ``width`` consecutive words of an item, or all words of a shorter one;
    ``n_hit`` counts the document's words inside occurrences, ``items_sha256`` is the
    SHA-256 of the ids of items with occurring windows, sorted as strings and joined by
    commas. Documents with the same windows are looked up once.

    Null and empty texts have no words, and so no window and no hit. Repeated rows of
    documents are judged one by one; repeated items and ids count once. An item without
    an id hits words but is not listed. An empty table of documents gives no rows, one
    of items no hit. Further columns are not read.
    """
    index = positional_index(docs)
    windows, held = item_windows(items, width)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(
        matches(index, windows, slop)
        .select("doc_id", "n_words", "numbers", "starts", "lengths")
        .mapInArrow(_covered, f"doc_id {kind}, n_words long, n_hit long, numbers array<long>")
    )
    sets = settle(found.filter("n_hit > 0").select("numbers").distinct()).withColumn("_set", F.monotonically_increasing_id())
    listed = (
        sets.select("_set", F.explode("numbers").alias("number"))
        .join(checked(held), "number")
        .groupBy("_set")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
        .select("_set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    named = sets.join(listed, "_set").select("numbers", "n_items", "items_sha256")
    # Clean documents, the most by far, take no part in a join.
    clean = found.filter("n_hit = 0").withColumns({"n_items": F.lit(None), "items_sha256": F.lit(None)})
    hit = found.filter("n_hit > 0").join(named, "numbers", "left")
    return hit.unionByName(clean).select(
        "doc_id", "n_words", "n_hit",
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
