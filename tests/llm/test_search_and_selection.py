"""Operators 11 to 13 against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biomosaic.llm import alnum, clustering, decontamination, resampling
from biomosaic.llm.queries import ORACLES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
words_of = lambda text: WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---- words and checksums


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_checksums_of_runs(longest):
    texts = [None, "", "A-b  C_d\tÉté 12x", "x", "one\x7ftwo\x00three", "y" * 64 + " " + "z" * 65 + " " + "w" * 1000 + " v", "öÖ!"]
    found = alnum.words(pa.array(["left out", *texts]).slice(1))
    at, sums = alnum.run_checksums(found, longest)
    expected = sorted(
        (d, zlib.crc32(" ".join(w[i : i + n]).encode()))
        for d, w in enumerate(map(words_of, texts)) for n in range(1, longest + 1) for i in range(len(w) - n + 1)
    )
    assert sorted(zip(at.tolist(), sums.tolist())) == expected
    assert found.counts().tolist() == [len(words_of(t)) for t in texts]


# ---- 11


@pytest.fixture(scope="module")
def texts(corpus):
    return {**corpus, 1000: None, 1001: "", 1002: "?!", 1003: "tan", 1004: "Tan rest tan REST tan", 1005: "mile " * 3000}


@pytest.fixture(scope="module")
def items(spark, texts):
    pick = random.Random(3)
    found = [(50, "tan rest"), (51, "TAN"), (51, "tan"), (52, None), (53, "--"), (None, "rest tan"), (9, "mile " * 12), (54, "no such words at all")]
    for i, text in enumerate(texts.values()):
        w = words_of(text)
        if i % 9 == 0 and len(w) > 30:
            at = pick.randrange(len(w) - 25)
            found.append((100 + i, "; ".join(w[at : at + pick.choice([8, 10, 25])]).upper()))
    return found


def _occurrences(texts, items, width=10):
    """(document, item, start, length) by comparing every place with every window."""
    out = set()
    for doc, text in texts.items():
        w = words_of(text)
        for item, passage in items:
            p = words_of(passage)
            n = min(width, len(p))
            runs = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
            out |= {(doc, item, i, n) for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in runs}
    return out


def _reported(texts, items):
    found = _occurrences(texts, items)
    for doc, text in texts.items():
        own = [f for f in found if f[0] == doc]
        hit = {i for _, _, start, n in own for i in range(start, start + n)}
        ids = sorted({str(item) for _, item, _, _ in own if item is not None})
        yield doc, len(words_of(text)), len(hit), len(ids), sha(",".join(ids)), bool(hit)


def _frames(spark, make_docs, texts, items):
    return make_docs(*texts.items(), extra=True), spark.createDataFrame(items, "item_id long, text string").withColumn("number", F.lit("x"))


@pytest.mark.parametrize("windows", [200_000, 40])
def test_decontamination(spark, make_docs, texts, items, windows, monkeypatch):
    monkeypatch.setattr(decontamination, "WINDOWS", windows)
    monkeypatch.setattr(decontamination, "SEGMENT", 1 << 13)
    monkeypatch.setattr(decontamination, "PLACES", 50)
    docs, passages = _frames(spark, make_docs, texts, items)
    found = {tuple(r) for r in decontamination.decontaminate(docs, passages).collect()}
    assert found == set(_reported(texts, items))
    assert sum(r[-1] for r in found) > 20


def test_spans_of_phrases(spark, make_docs, texts, items):
    docs, passages = _frames(spark, make_docs, texts, items)
    windows, held = decontamination.item_windows(passages)
    rows = decontamination.matches(decontamination.positional_index(docs), windows)
    spans = rows.select("doc_id", F.explode(F.arrays_zip("numbers", "starts", "lengths")).alias("m")).join(held, F.col("m.numbers") == F.col("number"))
    found = {tuple(r) for r in spans.select("doc_id", "item_id", "m.starts", "m.lengths").collect()}
    assert found == {o for o in _occurrences(texts, items) if o[1] is not None}


@pytest.mark.parametrize("slop", [0, 3])
def test_spans_of_near_words(spark, make_docs, slop):
    pick = random.Random(11)
    texts = {i: " ".join(pick.choice("abcdefg") for _ in range(pick.choice([2, 9, 40]))) for i in range(30)}
    items = [(0, "a b c"), (1, "g a g"), (2, "e"), (3, "f f"), (4, "a b c d e f")]
    docs, passages = _frames(spark, make_docs, texts, items)
    windows, held = decontamination.item_windows(passages, 4)
    rows = decontamination.matches(decontamination.positional_index(docs), windows, slop)
    spans = rows.select("doc_id", F.explode(F.arrays_zip("numbers", "starts", "lengths")).alias("m")).join(held, F.col("m.numbers") == F.col("number"))
    found = {tuple(r) for r in spans.select("doc_id", "item_id", "m.starts", "m.lengths").collect()}
    expected = set()
    for doc, text in texts.items():
        w = words_of(text)
        for item, passage in items:
            p = words_of(passage)
            n = min(4, len(p))
            for window in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}:
                for i in range(len(w)):
                    upto = next((j for j in range(i + 1, min(len(w), i + n + slop) + 1) if set(window) <= set(w[i:j])), None)
                    if upto and w[i] in window:
                        expected.add((doc, item, i, upto - i))
    assert found == expected and found


def test_decontamination_of_odd_tables(spark, make_docs, odd_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    clean = decontamination.decontaminate(odd_docs, none).collect()
    assert len(clean) == odd_docs.count() and not any(r.contaminated or r.n_items for r in clean)
    assert {r.items_sha256 for r in clean} == {sha("")}
    empty = make_docs((1, "x")).filter("doc_id = 2")
    assert decontamination.decontaminate(empty, none).collect() == []
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    passages = [(1, "one two"), (2, "b c d e f"), (None, "wort wort")]
    found = sorted(map(str, (tuple(r) for r in decontamination.decontaminate(odd_docs, spark.createDataFrame(passages, "item_id long, text string")).collect())))
    assert found == sorted(str(r) for doc, text in texts for r in _reported({doc: text}, passages))


# ---- 12


def _drawn(docs, target, percent=5, least=20, seed=42):
    """Rows of the contract, by counters."""
    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [buckets(t) for _, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for b in own:
        np.add.at(s, b, 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + 10000) / ((s[i] + 1) * (t.sum() + 10000)))) for i in range(10000)]
    out = []
    for (doc, text), b in zip(docs, own):
        h = int(sha(f"{seed}:{'' if doc is None else doc}")[:8], 16)
        weight = sum(gain[i] for i in b)
        out.append([doc, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [i for i, (_, text) in enumerate(docs) if len(words_of(text)) >= least]
    order = sorted(able, key=lambda i: (-out[i][3], docs[i][0] is None, docs[i][0] or 0))
    for rank, i in enumerate(order[: percent * len(able) // 100]):
        out[i][4] = rank + 1
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize("percent", [0, 5, 50, 100])
def test_resampling(spark, make_docs, texts, items, percent, monkeypatch):
    monkeypatch.setattr(resampling, "KEYS", 7)
    docs, target = _frames(spark, make_docs, texts, items)
    found = resampling.resample(docs, target, percent=percent)
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(str(tuple(r)) for r in found.collect()) == _drawn(list(texts.items()), [t for _, t in items], percent)


def test_resampling_of_odd_tables(spark, make_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for least, percent in ((0, 100), (2, 60)):
        found = resampling.resample(odd_docs, none, percent=percent, least_words=least).collect()
        assert sorted(str(tuple(r)[:4]) for r in found) == sorted(re.sub(r", [^,]*\)$", ")", r) for r in _drawn(texts, [], 0))
        able = sum(len(words_of(t)) >= least for _, t in texts)
        assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, able * percent // 100 + 1))
    assert resampling.resample(make_docs((1, "x")).filter("doc_id = 2"), none).collect() == []


def test_selection_finds_every_rank(spark):
    """Ties in all but the last part of the key, uneven and empty partitions."""
    pick = random.Random(2)
    keys = [(pick.choice([-3, 0, 0, 0, 7]), pick.choice([1, 2, 2]), i) for i in range(60)]
    frame = spark.createDataFrame(keys, "behind long, doc long, row long").repartition(5, "behind")
    for rank in (1, 2, 17, 30, 59, 60):
        assert resampling._key_at(frame, rank) == sorted(keys)[rank - 1]


# ---- 13


def _clustered(vectors, clusters=16, rounds=3, d=64):
    good = [(i, v) for i, v in vectors if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(64 * x) for x in v]) for i, v in good]
    centroids = [p for _, p in sorted(points, key=lambda r: (sha(f"1:{'' if r[0] is None else r[0]}"), r[1]))[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [min((apart(p, c), k) for k, c in enumerate(centroids)) for _, p in points]
    for _ in range(rounds):
        where = place()
        for k in range(len(centroids)):
            own = [p for (_, p), (_, w) in zip(points, where) if w == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    where = place()
    total = sum(x for x, _ in where)
    own = {k: sum(x for x, w in where if w == k) for k in range(len(centroids))}
    return sorted(
        str((i, k, x, own[k], total, sha(",".join(map(str, centroids[k]))))) for (i, _), (x, k) in zip(points, where)
    )


@pytest.fixture(scope="module")
def vectors():
    pick = random.Random(8)
    middle = [[pick.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    out = [(i, [x + pick.gauss(0, 0.05) for x in pick.choice(middle)]) for i in range(150)]
    out += [(3, out[3][1]), (200, None), (201, []), (202, [0.1] * 63), (203, [0.1] * 63 + [None]), (204, [float("nan")] * 64)]
    return [*out, (205, [float("inf")] * 64), (206, [0.0] * 64), (207, [0.0] * 64), (None, [-0.01] * 64), (None, [-0.01] * 64)]


@pytest.fixture(scope="module")
def vector_frame(spark):
    def build(vectors):
        frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
        return frame.withColumns({c: F.lit("x") for c in ("label", "cluster", "distance", "point", "inertia")}).repartition(3)

    return build


@pytest.mark.parametrize("clusters", [1, 5, 16])
def test_clustering(vector_frame, vectors, clusters):
    found = clustering.cluster_vectors(vector_frame(vectors), clusters=clusters)
    assert sorted(str(tuple(r)) for r in found.collect()) == _clustered(vectors, clusters)


def test_clustering_of_odd_tables(vector_frame, vectors):
    assert clustering.cluster_vectors(vector_frame(vectors).filter("vec_id < 0")).collect() == []
    same = [(i % 3, [0.5] * 64) for i in range(20)]
    assert sorted(str(tuple(r)) for r in clustering.cluster_vectors(vector_frame(same)).collect()) == _clustered(same)
    with pytest.raises(Exception, match="over 134217728"):
        clustering.cluster_vectors(vector_frame([(1, [1e30] * 64)])).collect()


def test_walk_outward_meets_the_nearest():
    """Equal distances, repeated centroids, values beyond all centroids and between them."""
    pick = np.random.default_rng(4)
    for k, d, spread in ((1, 3, 5), (7, 2, 3), (40, 5, 4), (30, 64, 100)):
        centroids, points = pick.integers(-spread, spread, (k, d)), pick.integers(-2 * spread, 2 * spread, (500, d))
        far = ((points[:, None] - centroids) ** 2).sum(2)
        number, best = clustering.nearest(points, centroids)
        assert (number == far.argmin(1)).all() and (best == far.min(1)).all()


# ---- SQL


def test_sql_on_small_tables(spark, make_docs, texts, items, vector_frame, vectors, tmp_path):
    docs, passages = _frames(spark, make_docs, texts, items)
    tables = {"documents": docs, "benchmark": passages, "embeddings": vector_frame(vectors)}
    results = {
        "op11_decontamination": decontamination.decontaminate(docs, passages),
        "op13_clustering": clustering.cluster_vectors(tables["embeddings"]),
    }
    with duckdb.connect() as con:
        for name, frame in tables.items():
            frame.write.parquet(str(tmp_path / name))
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        for name, frame in results.items():
            result = con.execute(ORACLES[name])
            order = [[c[0] for c in result.description].index(c) for c in frame.columns]
            expected = sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())
            assert sorted(str(tuple(r)) for r in frame.collect()) == expected, name
