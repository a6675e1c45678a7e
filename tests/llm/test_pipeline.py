"""The pipeline, stage by stage, against brute force on a small table."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from biomosaic.llm.queries import ORACLES, QUERIES, TOKENIZER


@pytest.fixture(scope="module")
def folder(spark, corpus, make_docs, tmp_path_factory):
    rows = [(k, v, "en", f"s{k % 4 // 2}") for k, v in corpus.items()]
    rows += [(2000, None, None, None), (2001, "12 !", "en", "s0"), (2002, rows[0][1].upper(), "en", None)]
    path = tmp_path_factory.mktemp("tables")
    make_docs(*rows).write.parquet(str(path / "documents.parquet"))
    return path


def test_registered():
    assert [f"op{n}_" for n in range(1, 14)] == [next(k for k in QUERIES if k.startswith(f"op{n}_"))[: len(f"op{n}_")] for n in range(1, 14)]
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES) and corpus_pipeline.ORACLE_SQL is None
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(str(folder / "documents.parquet"))
    columns, held = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == columns
        held.append([tuple(r) for r in docs.collect()])
        docs = spark.createDataFrame(held[-1], docs.schema)
    text = {r[0]: r[1] for r in spark.read.parquet(str(folder / "documents.parquet")).collect()}
    lettered = {k: v for k, v in text.items() if v and any(c.isalpha() for c in v)}
    assert sorted(r[0] for r in held[0]) == sorted(lettered)
    last = {}
    for k in sorted(lettered):
        last[lettered[k].encode().lower()] = k
    assert sorted(r[0] for r in held[1]) == sorted(last.values())
    sets = {}
    for k in last.values():
        w = lettered[k].encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if r == high else r for k, r in root.items()}
    assert sorted(r[0] for r in held[2]) == sorted(k for k, r in root.items() if k == r)
    assert {r for r in held[3]} <= {r for r in held[2]} and held[3]
    plain = Tokenizer.from_file(TOKENIZER)
    pieces = collections.Counter()
    for r in held[3]:
        ids = np.array([*plain.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            pieces[r[0], a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder)).collect()
    assert collections.Counter(tuple(r)[:5] for r in packed) == pieces
    whole = corpus_pipeline.run(spark, str(folder))
    assert collections.Counter(tuple(r)[:5] for r in whole.collect()) == pieces
