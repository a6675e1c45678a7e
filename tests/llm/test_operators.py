"""Each operator against brute force on a small corpus, and on odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biomosaic.llm import (
    components, exact_dedup, language_id, mixing, near_vectors, packing, secret_scan, shingle_join,
    substring_dedup, suffix_tree_lm, toxicity,
)
from biomosaic.llm import runtime
from biomosaic.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
fold = lambda doc_id, n: zlib.crc32(str(doc_id).encode()) % n
lower = lambda text: (text or "").encode().lower()


@pytest.fixture(scope="module")
def docs(corpus, make_docs):
    return make_docs(*[(k, v, "en", f"s{k % 3}") for k, v in corpus.items()])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")


def _all(labels):
    return {
        "language_id": language_id.language_id, "exact_dedup": exact_dedup.exact_dedup,
        "substring_dedup": substring_dedup.substring_dedup, "secret_scan": secret_scan.secret_scan,
        "toxicity": lambda d: toxicity.toxicity(d, labels), "mix": mixing.mix,
        "pack": lambda d: packing.pack(d, TOKENIZER), "shingle_join": shingle_join.shingle_join,
        "suffix_tree_lm": suffix_tree_lm.suffix_tree_lm,
        "identified": language_id.identified, "keep_one": exact_dedup.keep_one,
        "keep_near": shingle_join.keep_one, "mixed": mixing.mixed,
    }


@pytest.mark.parametrize("name", list(_all(None)))
def test_empty_tables(make_docs, labels, name):
    empty = make_docs((1, "x")).filter("doc_id = 2")
    assert _all(labels.filter("doc_id < 0"))[name](empty).collect() == []


@pytest.mark.parametrize("name", ["toxicity"])
def test_missing_labels(docs, labels, name):
    assert {r.score for r in _all(labels.filter("doc_id < 0"))[name](docs.limit(5)).collect()} == {0.5}


def rows_of(frame):
    return collections.Counter(tuple(r) for r in frame.collect())


def test_exact_dedup(docs, corpus):
    groups = collections.defaultdict(list)
    for k, v in corpus.items():
        groups[hashlib.sha256(lower(v)).hexdigest()].append(k)
    expected = {(k, max(ks), len(ks), k == max(ks), h) for h, ks in groups.items() for k in ks}
    for bits in (0, 3, 6):
        assert set(rows_of(exact_dedup.exact_dedup(docs, bits))) == expected


def test_exact_dedup_odd(odd_docs):
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(odd_docs).collect()}
    assert (found[1].keep_id, found[1].group_size) == (2, 3)  # null counts as empty
    assert found[5].kept and not found[4].kept
    assert (found[6].keep_id, found[6].group_size) == (7, 4) and not found[None].kept
    kept = exact_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 8, 9, 11]


def test_shingle_join(docs, corpus):
    sets = {}
    for k, v in corpus.items():
        w = lower(v).split()
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) or frozenset([tuple(w)] if w else [])
    component = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(component[a], component[b])
            changed |= component[a] != low or component[b] != low
            component[a] = component[b] = low
    assert len({a for a, b in links if sets[a] != sets[b]}) > 5
    assert set(rows_of(shingle_join.shingle_join(docs))) == {(k, len(s), component[k]) for k, s in sets.items()}


def test_shingle_join_without_leader_rounds(docs, monkeypatch):
    """The search alone, over blocks of a few members, joins what leaders would."""
    expected = rows_of(shingle_join.shingle_join(docs))
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", 2)
    led = shingle_join._led
    two = lambda cells: cells.groupBy("cell").agg(F.count_distinct("node").alias("m")).filter("m = 2").select("cell")
    monkeypatch.setattr(shingle_join, "_led", lambda cells: led(cells.join(two(cells), "cell")))
    assert rows_of(shingle_join.shingle_join(docs)) == expected


def test_shingle_join_odd(odd_docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.shingle_join(odd_docs).collect()}
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3)
    assert found[4] == found[5] == (1, 4) and found[6] == found[7] == (1, 6)
    assert found[10] == (5, 10) and found[11] == (5, 10) and found[None][1] is None
    kept = shingle_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 6, 8, 9, 10, None, None]))


@pytest.mark.parametrize("k", [4, 5])
def test_shingle_join_few_words_alone(make_docs, k):
    """A partition of fewer words than k, but more than one, has a shingle."""
    for n in range(1, k + 2):
        docs = make_docs((1, " ".join("abcdef"[:n]))).coalesce(1)
        assert [tuple(r) for r in shingle_join.shingle_join(docs, k).collect()] == [(1, max(1, n - k + 1), 1)]
        assert shingle_join.keep_one(docs, k).count() == 1


def _removed(rows, size=50):
    first, out = {}, {}
    words = {k: WORD.findall(v or "") for k, v in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - size + 1):
            first.setdefault(tuple(words[k][i : i + size]), k)
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 300)  # several shards and shares
    monkeypatch.setattr(substring_dedup, "STREAMED", 3)
    expected = _removed(corpus.items())
    assert sum(x[1] for x in expected.values()) > 500
    assert set(rows_of(substring_dedup.substring_dedup(docs))) == {(k, *v) for k, v in expected.items()}


def test_substring_dedup_odd(odd_docs):
    found = {r.doc_id: r for r in substring_dedup.substring_dedup(odd_docs).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert tuple(found[1]) == (1, 0, 0, none) and tuple(found[3]) == (3, 0, 0, none)
    assert found[4].n_words == 6000 and found[4].n_removed == found[5].n_removed == 0  # own repeats stay
    assert found[None].n_removed == 0


def test_suffix_tree(docs, corpus):
    tokens = {k: [*lower(v).split(), None] for k, v in corpus.items()}
    counts = collections.Counter(x for k, w in tokens.items() if fold(k, 5) != 1 for x in w)
    total = sum(counts.values())
    base = lambda x: math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1)))
    gain = 0
    for r in suffix_tree_lm.suffix_tree_lm(docs).collect():
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 5) == 1, len(w), sum(counts[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(map(base, w)))
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_suffix_tree_is_a_distribution(make_docs):
    """Shares of all next words after each context add up to one."""
    pick = np.random.default_rng(4)
    phrases = ["a b c", "a b d", "x b e", "b f", "x y"]
    docs = make_docs(*[(k, " ".join(pick.choice(phrases, 60))) for k in range(30)])
    counts = docs.select("text").mapInArrow(suffix_tree_lm._count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts["w"] = counts["word"].to_numpy().view(np.uint64)
    counts = counts.sort_values("w")
    v = suffix_tree_lm.Vocabulary(counts["w"].to_numpy(), counts["n"].to_numpy(), int(counts["n"].sum()), len(counts))
    one, two = suffix_tree_lm.grow(docs.select("text"), v)
    size, everything = len(v.words), np.arange(len(v.words))
    assert len(one.keys) > 3 and len(two.keys) > 1
    base = v.base(v.counts)
    unknown = 0.5 / (v.total + 0.5 * (v.types + 1))
    for i in range(len(one.keys)):
        shares = one.apply(np.full(size, i), everything, size, base)
        rest = one.apply(np.array([i]), np.array([-1]), size, np.array([unknown]))
        assert shares.min() > 0 and shares.sum() + rest[0] == pytest.approx(1)
    for i in range(len(two.keys)):
        last = one.of(np.array([two.keys[i] % size]))[0]
        shorter = one.apply(np.full(size, last), everything, size, base)
        rest = one.apply(np.array([last]), np.array([-1]), size, np.array([unknown]))
        shares = two.apply(np.full(size, i), everything, size, shorter)
        assert shares.sum() + two.apply(np.array([i]), np.array([-1]), size, rest)[0] == pytest.approx(1)


def test_suffix_tree_scores_do_not_saturate(make_docs, monkeypatch):
    """Rare words are told apart by a context of four words in a corpus where they have
    hardly a share, the same whether weights are held or joined."""
    noise = [" ".join(f"n{x}" for x in np.random.default_rng(7 + i).integers(0, 40, 30000)) for i in range(4)]
    rare = [f"{a} y c d {e}" for a, e in ("xp", "zq") for _ in range(10)]  # x: less than 2e-4 of all
    train = [k for k in range(100) if fold(k, 5) != 1]
    asked = [k for k in range(100) if fold(k, 5) == 1]
    docs = make_docs(*zip(train, [*noise, *rare], strict=False), (asked[0], "x y c d p"), (asked[1], "x y c d q"))
    score = lambda: {r.doc_id: r.score for r in suffix_tree_lm.suffix_tree_lm(docs).collect()}
    first = score()
    assert first[asked[0]] - first[asked[1]] > 1
    monkeypatch.setattr(suffix_tree_lm, "HELD_SHARE", 1e-2)
    assert score() == pytest.approx(first)


def test_suffix_tree_odd(odd_docs):
    found = suffix_tree_lm.suffix_tree_lm(odd_docs).collect()
    assert len(found) == 14 and all(r.n_tokens >= 1 and r.score < 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}


@pytest.mark.parametrize("odd", [False, True])
def test_packing(docs, odd_docs, odd):
    from tokenizers import Tokenizer

    source, size = (odd_docs if odd else docs), 128
    plain = Tokenizer.from_file(TOKENIZER)
    found = packing.pack(source, TOKENIZER, size).collect()
    whole = collections.Counter()
    for r in source.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), size):
            piece = ids[a : a + size]
            whole[r.doc_id, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r)[:5] for r in found) == whole
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= size


def test_language_id(spark, make_docs):
    texts = {"en": "the cat and the dog went over there with them", "de": "der hund und die katze gingen über die straße"}
    rows = [(i, f"{t} {i}", lang, "s") for i in range(30) for lang, t in texts.items()]
    rows = [(2 * i + j, *r[1:]) for i, r in enumerate(rows) for j in (0, 1)]
    rows += [(900, None, "en", "s"), (901, "12 !?", "de", "s"), (902, "THE DOG", None, "s"), (None, "die katze", None, "s")]
    docs = make_docs(*rows, extra=True)
    found = language_id.language_id(docs, sample=5).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id, 3) == 1)
        expected = {900: "und", 901: "und", 902: "en", None: "de"}.get(r.doc_id, truth[r.doc_id])
        assert r.lang_pred == expected
    assert language_id.identified(docs).columns == docs.columns
    assert language_id.identified(docs).count() == len(rows) - 2


def test_language_without_labels(make_docs):
    found = language_id.language_id(make_docs((1, "some words", None, None))).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    rows = ((1, "some words", None, None), (2, "12 !?", None, None), (3, None, None, None), (4, "", None, None))
    assert [r.doc_id for r in language_id.identified(make_docs(*rows)).collect()] == [1]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_bounded_sample(spark, monkeypatch, broadcast):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", broadcast)
    rows = [(i, "few" if i % 50 == 0 else "many" if i % 7 else None) for i in range(2000)] + [(77, "many")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, lang string").withColumn("_h", F.xxhash64("doc_id"))
    held = frame.collect()
    found = runtime.bounded_sample(frame, "lang", 45, "doc_id")
    assert found.columns == frame.columns
    for lang, size in (("few", 40), ("many", 45)):
        expected = sorted((r._h, r.doc_id) for r in held if r.lang == lang)[:45]
        assert len(expected) == size
        assert sorted((r._h, r.doc_id) for r in found.collect() if r.lang == lang) == expected
    assert found.filter("lang IS NULL").isEmpty()


def test_out_of_place_distance():
    codes = np.array([1, 120, 1])  # the letter x between edges
    grams = [120, (1 << 21) | 120, (120 << 21) | 1, (1 << 42) | (120 << 21) | 1]
    assert language_id._frequent(codes, 3).tolist() == sorted(grams)[:3]
    model = [("a", grams[1], 0), ("a", grams[0], 1), ("b", grams[0], 0), ("b", 5, 1)]
    batch = pa.RecordBatch.from_pydict({"text": ["x", None]})
    found = next(language_id._predict(model, 2)(iter([batch]))).to_pylist()
    # a: |0 - 1| + |1 - 0| of at most 4; b: 0 and 2 for the missing one.
    assert [(r[language_id._LANG], r[language_id._SCORE]) for r in found] == [("a", 0.5), ("und", 0.0)]


def test_toxicity(spark, make_docs):
    clean = ["walking through gardens and quiet streets", "reading books about rivers and mountains", "cooking soup with beans and herbs"]
    rows = [(i, clean[i % 3] + (" you stupid fool" if i % 2 else "") + f" nr{i}") for i in range(240)]
    marked = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    docs = make_docs(*rows, (900, None), (901, ""), (None, "quiet streets"), extra=True)
    found = toxicity.toxicity(docs, marked).collect()
    assert len(found) == 243 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 for r in held if r.doc_id < 240)
    assert {r.predicted for r in found if r.doc_id in (900, 901, None)} == {0}


def _weights(tokens, power):
    raised = {k: (v / sum(tokens.values())) ** power for k, v in tokens.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def test_mixing(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    rows = [(i, "w " * (i % 9 + 1), "en", "big" if i % 10 else ("mid" if i % 20 else None)) for i in range(600)]
    docs = make_docs(*rows)
    tokens = collections.Counter()
    for r in rows:
        tokens[r[3]] += r[0] % 9 + 1
    total = sum(tokens.values())
    for mixture in (mixing.Mixture(), mixing.Mixture(entropy=0.999, repeats=3), mixing.Mixture(budget=total * 2)):
        budget = mixture.budget or total
        entropy = lambda p: -sum(w * math.log(w) for w in _weights(tokens, p).values())
        grid = [i / 4096 for i in range(4097)]
        target = max(p for p in grid if entropy(p) >= mixture.entropy * math.log(3))
        limit = min([p for p in grid if all(w * budget / tokens[k] <= mixture.repeats for k, w in _weights(tokens, p).items())] or [1])
        expected = _weights(tokens, max(target, limit))
        found = mixing.mix(docs, mixture).collect()
        taken, whole = collections.Counter(), collections.defaultdict(set)
        for r in found:
            assert r.weight == pytest.approx(expected[r.source], abs=1e-3)
            taken[r.source] += r.n_tokens
            whole[r.source, r["pass"]].add(r.doc_id)
        for k in tokens:
            assert abs(taken[k] - next(r.weight for r in found if r.source == k) * budget) <= 10
        sizes = {k: sum(r[3] == k for r in rows) for k in tokens}
        for (k, p), ids in whole.items():  # every pass but the last has all rows, once
            assert len(ids) == sizes[k] or (k, p + 1) not in whole
        assert len(found) == sum(len(x) for x in whole.values())
        mixed = collections.Counter(r.doc_id for r in mixing.mixed(docs, mixture).collect())
        assert mixed == collections.Counter(r.doc_id for r in found)


def test_mixing_odd(odd_docs):
    found = mixing.mix(odd_docs).collect()
    assert {r.source for r in found} <= {"s", None} and sum(r.n_tokens for r in found) > 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns


def test_secret_scan(spark, make_docs):
    key = lambda i: "AKIA" + hashlib.sha256(str(i).encode()).hexdigest()[:16].upper()
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:20] + "a1"
    rows = [(i, f"see the page {key(i)} now") for i in range(40)]
    rows += [(100 + i, f'he set password = "{word(i)}" there') for i in range(40)]
    rows += [(200 + i, f"call {10**17 + i * 7919} or test_example_{word(i)} today") for i in range(40)]
    docs = make_docs(*rows, (900, None), (901, ""), (902, "nothing here"), (None, key(77), None, None), extra=True)
    found = secret_scan.secret_scan(docs).collect()
    assert {r.doc_id for r in found} == {r[0] for r in rows} | {None}
    assert all(r.kept == (r.doc_id is None or r.doc_id < 200) for r in found)
    by_hand = spark.createDataFrame([(r[0], v, int(r[0] >= 200)) for r in rows for v in re.findall(r"[A-Za-z0-9_]{16,}", r[1])], "doc_id long, value string, label int")
    turned = secret_scan.secret_scan(docs, by_hand).collect()
    assert all(r.kept == (r.doc_id is not None and r.doc_id >= 200) for r in turned if r.doc_id is not None)
    assert all(r.score == 1 for r in secret_scan.secret_scan(docs.filter("doc_id < 40")).collect())


def test_secret_scan_runs_no_python(docs):
    text = secret_scan.described(secret_scan.candidates(docs))._jdf.queryExecution().executedPlan().toString()
    mixed = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text + mixed)


@pytest.mark.parametrize("dims", [8, 12])
def test_near_vectors(spark, dims):
    pick = np.random.default_rng(dims)
    centers = pick.normal(size=(12, dims))
    rows = [(i, int(i % 2), (centers[i % 12] + pick.normal(size=dims) * 0.12).tolist()) for i in range(150)]
    rows += [(150, 0, rows[0][2]), (150, 0, rows[0][2]), (151, 1, rows[0][2]), (152, None, rows[0][2])]
    odd = [(200, 0, None), (201, 0, [0.0] * dims), (202, 0, [float("nan")] + [1.0] * (dims - 1)), (203, 0, [None] + [1.0] * (dims - 1)),
           (204, 0, []), (205, 0, [float("inf")] + [0.0] * (dims - 1)), (206, 0, rows[0][2][:-1]), (None, 0, rows[0][2])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").withColumn("n_links", F.lit("x"))
    found = near_vectors.near_vectors(frame).collect()
    assert len(found) == len(rows + odd)
    good = [(i, label, np.array(v, np.float32).astype(float)) for i, label, v in rows if label is not None]
    links, parent = collections.Counter(), {i: i for i, _, _ in good}
    for a, (i, li, x) in enumerate(good):
        for b, (j, lj, y) in enumerate(good):
            if a != b and li == lj and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                low = min(parent[i], parent[j])
                parent = {k: low if p in (parent[i], parent[j]) else p for k, p in parent.items()}
    expected = collections.Counter((i, links[a], parent[i], i == parent[i]) for a, (i, _, _) in enumerate(good))
    expected += collections.Counter([(i, 0, i, True) for i, *_ in [*odd[:-1], rows[-1]]] + [(None, 0, None, False)])
    assert rows_of(frame.sparkSession.createDataFrame(found, "vec_id long, n_links long, component_id long, kept boolean")) == expected


def test_near_vectors_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert near_vectors.near_vectors(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 299)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r.id, r.component_id) for r in found} == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 160)} | {(299, 299), (300, 299)}
    assert len(found) == 51 + 60 + 2
