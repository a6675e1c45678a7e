"""Operator 7: packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import prepare, settle, shards
from .words import _SPACE, BLOCK, Words, blocks, split

SIZE = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers, and words that it encodes at a time.
REMEMBERED, SLICE = 1 << 19, 1 << 12

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Pattern of tokenizers that end a token after each run of letters, and the mark of that end.
_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)  # visible ASCII other than letters
_SIGN[0x21:0x7F] = ~_LETTER[0x21:0x7F]


def _runs(words: Words) -> tuple[Words, np.ndarray]:
    """Words in lower case, cut where a letter is followed by an ASCII sign or digit, and
    which of the pieces are letters alone.

    Only ASCII and the letters of Latin-1 (C3 and one byte) are looked at. An upper-case
    letter before any other character stays: the two may be composed to one.
    """
    data = words.data
    latin = (np.append(np.uint8(0), data[:-1]) == 0xC3) & (data != 0x97) & (data != 0xB7)
    letter = _LETTER[data] | latin
    after = np.append(data[1:], np.uint8(0x20))
    upper = np.where(latin, data < 0x9F, _LETTER[data] & (data < 97)) & ((after < 0x80) | (after == 0xC3))
    cuts = np.flatnonzero(letter & _SIGN[after]) + 1
    begins, ends = np.zeros(len(data), bool), np.zeros(len(data) + 1, bool)
    begins[words.start] = begins[cuts[cuts < len(data)]] = True
    ends[words.end] = ends[cuts] = True
    start = np.flatnonzero(begins)
    ptr = np.searchsorted(start, np.append(words.start, len(data))[words.ptr])
    # The first byte of a Latin-1 letter is one of it, too; blanks up to the next word are not seen.
    other = ~letter & ~_SPACE[data] & ~((data == 0xC3) & np.append(latin[1:], False))
    alone = ~np.logical_or.reduceat(other, start) if len(start) else np.empty(0, bool)
    return Words(data + upper * np.uint8(32), start, np.flatnonzero(ends), ptr), alone


class _Ids:
    """Token ids of texts. The tokenizer drops white space and splits at it, so that
    the ids of a text are those of its words one after another; words recur, and each
    is encoded once while it is remembered (by its 64-bit hash). Where the tokenizer
    folds case and ends tokens after runs of letters, the runs are remembered instead,
    of which there are far fewer (see _runs)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are Spark's to deal out
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Read one by one: the whole file as Python objects would stay in the worker's memory.
        rules = [json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        norm, cut = rules[0].get("normalizers", []), rules[1].get("pretokenizers", [])
        self.folds = (
            [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"]
            and (norm[1]["pattern"], norm[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [x["type"] for x in cut] == ["Split", "ByteLevel"]
            and cut[0] == {"type": "Split", "pattern": {"Regex": _RUNS}, "behavior": "Removed", "invert": True}
            and not cut[1]["use_regex"] and not cut[1]["add_prefix_space"]
            and getattr(self.tokenizer.model, "end_of_word_suffix", None) == _WORD_END
        )
        #: Found in texts before anything else is done with them.
        self.added = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.last = np.array([(x or "").endswith(_WORD_END) for x in tokens], bool)
        self.forget()

    def forget(self) -> None:
        self.words, self.again = np.empty(0, np.uint64), np.empty(0, bool)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def keep_recurring(self) -> None:
        """Forgets words that were not met again since they were learnt or last kept."""
        rows = np.flatnonzero(self.again)
        self.ids = self.ids[_spans(self.begin[rows], self.size[rows])]
        self.words, self.size, self.again = self.words[rows], self.size[rows], np.zeros(len(rows), bool)
        self.begin = np.cumsum(self.size) - self.size

    def _apart(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are encoded each by itself, and how many each has."""
        part = [words.text(i).decode("utf-8", "replace") for i in at]
        new = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        size = np.fromiter(map(len, new), np.int64, len(new))
        return np.fromiter((i for x in new for i in x), np.uint32, int(size.sum())), size

    def _together(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters alone, encoded as one text: the last token of
        each, and no other, has the mark of the end."""
        n = words.end[at] - words.start[at] + 1
        line = words.data[np.minimum(_spans(words.start[at], n), len(words.data) - 1)]
        line[np.cumsum(n) - 1] = 0x20
        text = line.tobytes().decode("utf-8", "replace")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(at) or ends[-1] != len(ids):
            return self._apart(words, at)
        return ids, np.diff(ends, prepend=0)

    def learn(self, hashes: np.ndarray, words: Words, at: np.ndarray, alone: np.ndarray) -> None:
        """Encodes new words slice by slice: an encoding is far larger than its ids."""
        order = np.argsort(~alone, kind="stable")
        ids, size = [self.ids], []
        for encode, rows in ((self._together, order[: int(alone.sum())]), (self._apart, order[int(alone.sum()) :])):
            for i in range(0, len(rows), SLICE):
                new, n = encode(words, at[rows[i : i + SLICE]])
                ids.append(new)
                size.append(n)
        sizes = np.concatenate(size)
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate(ids)
        size, begin = np.empty_like(sizes), np.empty_like(sizes)
        size[order], begin[order] = sizes, begins
        # Both are sorted: what is new goes in between.
        row = np.searchsorted(self.words, hashes)
        self.words, self.again = np.insert(self.words, row, hashes), np.insert(self.again, row, False)
        self.begin, self.size = np.insert(self.begin, row, begin), np.insert(self.size, row, size)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the words that are remembered, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        row = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[row] == hashes, row, -1)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text begin and end."""
        words = split(texts, lower=False)
        alone = np.zeros(len(words.start), bool)
        if self.folds and not self._has_added(words.data):
            words, alone = _runs(words)
        found, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        row = self._known(found)
        new = row < 0
        self.again[row[~new]] = True
        if new.any():
            if len(self.words) + int(new.sum()) > REMEMBERED:
                self.keep_recurring()
                if len(self.words) + int(new.sum()) > REMEMBERED // 4 * 3:
                    self.forget()
                    new[:] = True
            self.learn(found[new], words, at[new], alone[at[new]])
            row = self._known(found)
        n = self.size[row][which]
        ends = np.cumsum(n)
        return self.ids[_spans(self.begin[row][which], n)], np.append(0, ends)[words.ptr]

    def _has_added(self, data: np.ndarray) -> bool:
        text = data.tobytes().lower()
        return any(x in text for x in self.added)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the spans one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Ids:
    """Kept by a Python worker from task to task."""
    return _Ids(path)


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in blocks(batches, size=BLOCK):
            ids, at = encoder.of(batch["text"])
            docs, starts, lengths, sums, totals = [], [], [], [], []
            for doc, a, b in zip(batch["doc_id"].to_pylist(), at[:-1], at[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(own), size):
                    piece = own[start : start + size]
                    docs.append(doc)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (docs, starts, lengths, sums, totals)],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Each text's ids and the end id, cut into pieces of ``size`` and a rest."""
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, size), _PIECES)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Packing patterns as intervals of ranks: (length, rank, count, sequence, packs, offset).

    Lengths are placed longest first, each into the shortest packs there are, in which
    it fits, else into new ones. Packs of one pattern are handled together, so that the
    work depends on the number of lengths, not of pieces. Interval (l, r, c, s, p, o):
    the pieces of length l with ranks r to r + c - 1 go to the p packs from sequence s,
    row by row: rank r + i lies in sequence s + i % p at o + l * (i // p).
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    shortest: list[tuple[int, int, int]] = []  # (filled, first sequence, packs)
    packs = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if shortest and shortest[0][0] + length <= size:
                filled, first, n = heapq.heappop(shortest)
                reach = shortest[0][0] if shortest else size
                deep = max(1, min((reach - filled) // length, (size - filled) // length, left // n))
            else:
                filled, first, n, deep = 0, packs, left, 1
                packs += n
                if size // length > 1:  # many short ones: fill packs evenly, none is begun in vain
                    deep = min(size // length, left)
                    n = -(-left // deep)
                    packs = first + n
                    deep = left // n
            if left < n:  # the pattern divides: some of its packs get one more
                heapq.heappush(shortest, (filled, first + left, n - left))
                n, deep = left, 1
            out.append((length, rank, n * deep, first, n, filled))
            heapq.heappush(shortest, (filled + length * deep, first, n))
            rank, left = rank + n * deep, left - n * deep
    return out


_PLACED = _PIECES + ", sequence_id long, offset long"


def _place(patterns: list[tuple[int, int, int, int, int, int]]):
    """Rank of a length to sequence and offset, by binary search among the patterns."""
    table = np.array(sorted(patterns), np.int64).reshape(-1, 6)
    names = [x.split()[0] for x in _PLACED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(int(table[-1, 0]) + 2)) if len(table) else None
        for batch in batches:
            length, rank = np.asarray(batch["length"]), np.asarray(batch["rank"])
            row = np.empty(len(length), np.int64)
            for one in np.unique(length):
                at, lo, hi = length == one, first[one], first[one + 1]
                row[at] = lo + np.searchsorted(table[lo:hi, 1], rank[at], "right") - 1
            _, r0, _, sequence, packs, offset = table[row].T
            i = rank - r0
            placed = (sequence + i % packs, offset + length * (i // packs))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names[:-2]], *map(pa.array, placed)], names=names)

    return run


def ranked(found: DataFrame, salts: int) -> DataFrame:
    """Rank from 0 of each piece among those of its length.

    Pieces are ordered within salted parts of a length, so that a length of a third of
    all pieces is dealt out; the parts' sizes, at most lengths x salts rows, shift them.
    """
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("row", F.row_number().over(within))
    return numbered.join(shifts, ["length", "salt"]).withColumn("rank", F.col("row") - 1 + F.col("shift"))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    A text's ids, then the end id; null counts as empty, so that every row of ``docs``
    has a piece. Rows that repeat an id or a text are packed each for itself, a null
    doc_id too. An empty table gives no rows. Texts longer than ``size`` are cut into
    full pieces and a rest; full pieces are sequences by themselves. Equal lengths are
    interchangeable and go by (doc_id, start) within a salt.

    The pieces (no ids) are kept once. The driver sees the histogram, at most ``size``
    rows, and makes the patterns from it; tasks look ranks up in the patterns.
    """
    spark = docs.sparkSession
    prepare(spark)
    found = settle(pieces(docs, tokenizer, size))
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(histogram, size)
    return ranked(found, shards(spark)).select(
        *[x.split()[0] for x in _PIECES.split(", ")], "rank"
    ).mapInArrow(_place(patterns), _PLACED)
