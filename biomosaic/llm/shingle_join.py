"""Operator 8: n-gram Jaccard join with an R-tree over count vectors.

Words of a text are hashed to shingles, shingles to groups; the counts of its groups
are the text's point. The overlap of two sets is at most the sum of the smaller counts
of each group, and that of a set with anything in a tree node at most the same sum with
the node's largest counts. Pairs that survive are verified on the sets themselves.

A tree over everything would be one large index in one place. Here the top of the tree
is a partition of the plane by cells: sets so alike that they may link agree in a cell
for certain (see _cells). Below each cell lies a packed tree of its members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import checked, prepare, settle, shards
from .words import Words, blocks, mix, signed, split

WORDS = 4
#: Least similarity in hundredths.
PERCENT = 85
#: Coordinates of a point.
GROUPS = 256
#: Sets of up to so many shingles meet by prefixes, larger ones by parts.
SMALL = 48
#: Growth of the size bands of the parts.
BAND = 1.5
#: Rounds of nearest members before the full search, each in one of SHARE cells.
NEAREST, SHARE = 1, 4
#: Members of a tree node; members of a cell that one task compares with as many.
LEAF, BLOCK_ROWS = 32, 1024


def shingles(words: Words, k: int = WORDS) -> list[np.ndarray]:
    """The sorted set of each document: all runs of k words, or the whole of fewer."""
    h = words.hashes()
    m = max(0, len(h) - k + 1)
    run = np.zeros(m, np.uint64)
    for i in range(k):
        run = mix(run ^ h[i : i + m])
    out = []
    for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True):
        if b - a >= k:
            own = np.sort(run[a : b - k + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            value = np.array([b - a], np.uint64)
            for x in h[a:b]:
                value = mix(mix(value) ^ x)
            out.append(value)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _name(own: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a set."""
    a, b = mix(own), mix(~own)
    return int(signed(mix(a.sum(keepdims=True)))[0]), int(signed(mix(b.sum(keepdims=True)))[0])


def _need(a: int, b: int, percent: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


class _Bands:
    """Size bands; band j serves pairs whose smaller set has low[j] to low[j + 1] - 1."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [SMALL * percent // 100 + 1]

    def of(self, n: int) -> list[int]:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND)))
        return [j for j in range(len(self.low) - 1) if self.low[j] <= n and self.percent * n <= 100 * (self.low[j + 1] - 1)]

    def parts(self, j: int) -> int:
        """More parts than two linked sets can differ in, and spare ones for empty parts."""
        a = self.low[j + 1] - 1
        b = 100 * a // self.percent
        apart = (100 - self.percent) * (a + b) // (100 + self.percent)
        return apart + 5 + apart // 16


def _cells(own: np.ndarray, bands: _Bands) -> np.ndarray:
    """Cells of a set; sets that link share one.

    Larger sets: hash ranges cut all sets of a size band into more parts than linked
    sets have differences, so that some part is equal in both, and the part's content
    is a cell. That part might be empty in both; the spare parts and the random spread
    of differences make up for it beyond any doubt at these sizes. Small sets: linked
    ones share one of their first shingles in hash order (prefix filter).
    """
    n, percent = len(own), bands.percent
    found = []
    if n * percent <= 100 * SMALL:
        order = np.sort(mix(own ^ np.uint64(0xA5A5)))
        found.append(order[: n - -(-percent * n // 100) + 1])
    for j in bands.of(n):
        m = bands.parts(j)
        part = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        content = np.add.reduceat(mix(own ^ np.uint64(j + 1)), first)
        found.append(mix(content ^ mix(part[first] + np.uint64(j << 32))))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            sets = shingles(split(batch["text"], lower=True), k)
            names = [_name(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x[0] for x in names], pa.int64()),
                    pa.array([x[1] for x in names], pa.int64()),
                ],
                names=["doc_id", "n", "node", "proof"],
            )

    return run


def _emit_cells(k: int, percent: int, crowds: dict[int, int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = _Bands(percent)
        for batch in blocks(batches):
            keys, nodes = [], []
            seen = set()
            for doc, own in zip(batch["doc_id"].to_pylist(), shingles(split(batch["text"], lower=True), k), strict=True):
                node = _name(own)[0]
                if not len(own) or doc is None or node in seen or crowds.get(node, doc) != doc:
                    continue
                seen.add(node)
                cells = _cells(own, bands)
                keys.append(cells)
                nodes.append(np.full(len(cells), node))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(nodes))], names=["cell", "node"]
                )

    return run


def _pack(k: int):
    """Points, and the words compressed: shorter than the set, which is made from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in blocks(batches):
            words = split(batch["text"], lower=True)
            sets = shingles(words, k)
            texts = [b" ".join(words.text(i) for i in range(a, b)) for a, b in zip(words.ptr[:-1], words.ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([_name(s)[0] for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([point(s).tobytes() for s in sets], pa.binary()),
                    pa.array([squeeze.compress(t) for t in texts], pa.binary()),
                ],
                names=["doc_id", "node", "n", "point", "words"],
            )

    return run


_PACKED = "doc_id long, node long, n long, point binary, words binary"


def point(own: np.ndarray) -> np.ndarray:
    """Counts of the groups. Larger counts than a byte are cut to 255, which can only
    bring points nearer, see bound()."""
    return np.minimum(np.bincount((own & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8)


def bound(n: np.ndarray, points: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Largest overlap that sets of n and m shingles with these points can have.

    The sum of the smaller counts, written as half of what the sums exceed the
    distance by, which stays an upper bound for cut counts.
    """
    apart = np.abs(points.astype(np.int16) - others.astype(np.int16)).sum(-1, dtype=np.int64)
    return (n + m - apart) // 2


def minima(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Summed smaller counts of all pairs: over t, how many groups have t in both."""
    most = int(min(points.max(initial=0), others.max(initial=0)))
    if most <= 24:
        out = np.zeros((len(points), len(others)), np.float32)
        for t in range(1, most + 1):
            out += (points >= t).astype(np.float32) @ (others >= t).astype(np.float32).T
        return out.astype(np.int64)
    return np.stack([np.minimum(p, others).sum(1, dtype=np.int64) for p in points])


class Tree:
    """A packed R-tree of points: leaves of LEAF members in order of size.

    ``search`` gives the pairs (asked, member) whose overlap could suffice for a link,
    and its bound: leaves are opened by their largest counts, members by their own.
    """

    def __init__(self, n: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((points[:, 0], n))
        self.n, self.points = n[self.order], points[self.order]
        first = np.arange(0, len(n), LEAF)
        self.first = np.append(first, len(n))
        self.high = np.maximum.reduceat(self.points, first, axis=0)
        self.small, self.large = self.n[first], self.n[self.first[1:] - 1]

    def search(self, n: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.asarray(n, np.int64)[:, None]
        # Cut counts bound nothing: what they may hide is added.
        most = minima(at, self.high) + np.where((self.high == 255).any(1), n, 0)
        least = -(-percent * (n + self.small) // (100 + percent))
        open_ = (most >= least) & (self.large * 100 >= percent * n) & (n * 100 >= percent * self.small)
        asked, hits, bounds = [], [], []
        for leaf in np.flatnonzero(open_.any(0)):
            rows = np.flatnonzero(open_[:, leaf])
            part = slice(self.first[leaf], self.first[leaf + 1])
            if int(max(at[rows].max(), self.points[part].max())) < 255:
                most = minima(at[rows], self.points[part])
            else:
                most = bound(n[rows], at[rows][:, None], self.n[part], self.points[part][None])
            need = -(-percent * (n[rows] + self.n[part]) // (100 + percent))
            i, j = np.nonzero(most >= need)
            asked.append(rows[i])
            hits.append(self.order[part][j])
            bounds.append(most[i, j])
        none = np.empty(0, np.int64)
        return tuple(np.concatenate([none, *x]) for x in (asked, hits, bounds))


def _met(own: pa.RecordBatch, percent: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components of one cell (or two blocks of it) whose points allow a link.

    Members of the commonest component are connected already, so that only the others
    are looked up, in the tree of the other block. ``nearest``: each only with the one
    of largest bound.
    """
    i, j = own["i"][0].as_py(), own["j"][0].as_py()
    points = np.frombuffer(b"".join(own["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
    node, n, comp, where = (np.asarray(own[c]) for c in ("node", "n", "comp", "block"))
    values, counts = np.unique(comp, return_counts=True)
    common = comp == values[counts.argmax()]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for mine, other in [(i, j)] if i == j else [(i, j), (j, i)]:
        asked, told = np.flatnonzero((where == mine) & ~common), np.flatnonzero(where == other)
        if not len(asked) or not len(told):
            continue
        rows, hits, bounds = Tree(n[told], points[told]).search(n[asked], points[asked], percent)
        x, y = asked[rows], told[hits]
        apart = np.flatnonzero(comp[x] != comp[y])
        if nearest:
            apart = apart[np.lexsort((-bounds[apart], x[apart]))]
            apart = apart[np.diff(x[apart], prepend=-1) != 0]
        a.append(np.minimum(node[x[apart]], node[y[apart]]))
        b.append(np.maximum(node[x[apart]], node[y[apart]]))
    return np.concatenate(a), np.concatenate(b)


def _meet(percent: int, nearest: bool):
    """_met() of every (cell, i, j): rows come sorted by them, a group has at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in chain(batches, [None]):
            if batch is not None and rest is not None:
                batch = pa.concat_batches([rest, batch])
            last, rest = batch is None, rest if batch is None else batch
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([np.asarray(rest[c]).astype(np.int64) for c in ("cell", "i", "j")])
            cuts = np.append(np.flatnonzero((np.diff(keys, axis=1) != 0).any(0)) + 1, rest.num_rows)
            upto = len(cuts) if last else len(cuts) - 1  # the last group may go on
            if upto:
                spans = zip(np.append(0, cuts[: upto - 1]), cuts[:upto], strict=True)
                a, b = zip(*(_met(rest.slice(x, y - x), percent, nearest) for x, y in spans), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                rest = rest.slice(cuts[upto - 1])

    return run


def _near(percent: int):
    """Pairs whose points allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (np.asarray(batch[c]).astype(np.int64) for c in ("na", "nb"))
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, GROUPS) for c in ("pa", "pb"))
            enough = bound(n, x, m, y) >= -(-percent * (n + m) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(enough & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))))

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        read = lambda column: shingles(split(pa.array(map(open_, column.to_pylist()), pa.binary()).cast(pa.string()), False), k)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keep = []
                for x, y in zip(read(batch["wa"]), read(batch["wb"]), strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    keep.append(int((both[1:] == both[:-1]).sum()) >= _need(len(x), len(y), percent))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs that link: first by their points, then by the sets of those that are left."""
    points = sets.select("node", "n", "point")
    at = lambda s: points.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("point").alias(f"p{s}"))
    near = settle(pairs.join(at("a"), "a").join(at("b"), "b").mapInArrow(_near(percent), "a long, b long"))
    wanted = settle(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = sets.select("node", "words").join(checked(wanted), "node", "left_semi")
    side = lambda s: held.select(F.col("node").alias(s), F.col("words").alias(f"w{s}"))
    return near.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(k, percent), "a long, b long")


def shingle_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Sets of distinct k-word shingles of the whole lower-cased (A-Z) texts; a text of
    fewer words is one shingle. Texts that are null or without words have an empty set
    and link with nothing. Two rows link when 100 * overlap >= percent * union; rows
    with equal sets always do, repeated rows among them. component_id is the smallest
    doc_id reachable; rows with a null doc_id link with nothing and have none. An empty
    table gives no rows; further columns are not read.

    Equal sets are one node. The nodes of each cell are first paired with one leader of
    the cell, the same for most cells of a family of copies, then in some of the cells
    with their nearest member by the tree; what that leaves unconnected in any cell is
    searched with the tree, in blocks. So every pair that could join two components is
    looked at, and copies never meet all pairs.
    """
    spark = docs.sparkSession
    prepare(spark)
    read = docs.select("doc_id", "text")
    light = settle(read.mapInArrow(_describe(k), "doc_id long, n long, node long, proof long"))
    filled = light.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Nodes with one row in a thousand or more: at most a thousand, only their first row has cells.
    total = light.count()
    crowds = {r["node"]: r["rep"] for r in filled.filter(F.col("copies") * 1000 >= total).filter("copies > 1").collect()}
    cells = read.mapInArrow(_emit_cells(k, percent, crowds), "cell long, node long")
    cells = settle(_mixed(cells.withColumn("comp", F.col("node"))))
    # One row for each node that shares a cell.
    named = settle(cells.select("node").distinct().join(filled, "node").select(F.col("rep").alias("doc_id"), "node"))
    # Texts that share no cell go before their words are looked at again.
    wanted = read.join(checked(settle(named.select("doc_id").distinct())), "doc_id", "left_semi")
    packed = wanted.mapInArrow(_pack(k), _PACKED)
    sets = settle(packed.join(checked(named), ["doc_id", "node"], "left_semi").drop("doc_id").dropDuplicates(["node"]))
    joined = _grown(None, _links(_led(cells), sets, k, percent))
    for round_ in range(NEAREST + 1):
        cells = settle(_mixed(_placed(cells.select("cell", "node"), joined)))
        if cells.isEmpty():
            break
        last = round_ == NEAREST
        some = cells if last else cells.filter(F.pmod(F.xxhash64("cell", F.lit(round_)), F.lit(SHARE)) == 0)
        joined = _grown(joined, _links(_rest(some, sets, percent, not last), sets, k, percent))
    roots = filled.join(joined.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "rep", F.coalesce("component_id", "node").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("rep").alias("component"))
    found = roots.join(smallest, "root").select("node", "component")
    return light.join(found, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, of each component only those with the smallest doc_id.

    Rows that link with nothing stay: null ids, texts without words. Of rows that
    repeat an id all stay or go together.
    """
    gone = settle(shingle_join(docs, k, percent).filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)


def _mixed(placed: DataFrame) -> DataFrame:
    """Members of cells with several components."""
    whole = Window.partitionBy("cell")
    return (
        placed.withColumn("lo", F.min("comp").over(whole))
        .withColumn("hi", F.max("comp").over(whole))
        .filter("lo < hi")
        .select("cell", "node", "comp")
    )


def _led(cells: DataFrame) -> DataFrame:
    """Pairs of each cell's leader with the members of other components."""
    lead = cells.groupBy("cell").agg(F.min(F.struct(F.xxhash64("node").alias("order"), "node", "comp")).alias("lead"))
    return (
        cells.join(lead, "cell")
        .filter("comp != lead.comp")
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        .distinct()
    )


def _placed(members: DataFrame, joined: DataFrame) -> DataFrame:
    return members.join(joined.withColumnRenamed("id", "node"), "node", "left").select(
        "cell", "node", F.coalesce("component_id", "node").alias("comp")
    )


def _grown(joined: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if joined is not None:
        links = links.unionAll(joined.filter("id != component_id").select("id", "component_id"))
    return settle(components(links, "a", "b"))


def _rest(cells: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs still to verify: of one cell, of different components, allowed by the tree.

    Cells of two have had their pair with the leader.
    """
    groups = cells.groupBy("cell").agg(
        F.count_distinct("node").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign")
    )
    # Cells with the same members are searched once.
    once = groups.filter("members > 2").groupBy("members", "sign").agg(F.min("cell").alias("cell"))
    rows = (
        cells.select("cell", "node", "comp").distinct()
        .join(once.select("cell", "members"), "cell")
        .join(sets.select("node", "n", "point"), "node")
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK_ROWS).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    )
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "node", "comp", "n", "point",
    )
    # A number of its own: few bytes, but much work, which Spark would put into few tasks.
    parts = shards(cells.sparkSession)
    together = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return together.mapInArrow(_meet(percent, nearest), "a long, b long").distinct()
