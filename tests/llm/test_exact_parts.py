"""Small parts against brute force, without Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from biomosaic.llm import packing, shingle_join, substring_dedup, words
from biomosaic.llm.automaton import Automaton
from biomosaic.llm.queries import TOKENIZER

ODD = ["", "  ", "A b\tc", "Ünïcode é x", "<|endoftext|> hi don't 12", "ΑΣ ΑΣ.\x1cq\x85z", "日本語 テスト", "a\x00b", None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words(texts):
    found = words.split(pa.array(texts, pa.string()), lower=True)
    expected = [(t or "").encode().lower().split() for t in texts]
    spans = zip(found.ptr[:-1], found.ptr[1:], strict=True)
    assert [[found.text(i) for i in range(a, b)] for a, b in spans] == expected
    flat = [w for ws in expected for w in ws]
    hashes = found.hashes()
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = pa.array(["aa b ccc " * 50, "ccc aa"])
    whole = words.split(texts, False).hashes()
    monkeypatch.setattr(words, "BLOCK", 7)
    assert (words.split(texts, False).hashes() == whole).all()


def test_token_ids():
    from tokenizers import Tokenizer

    ids, at = packing._Ids(TOKENIZER).of(pa.array(ODD, pa.string()))
    plain = Tokenizer.from_file(TOKENIZER)
    for text, a, b in zip(ODD, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_packing_plan(seed):
    pick = random.Random(seed)
    size = pick.choice([4, 16, 64, 100])
    histogram = {n: pick.choice([1, 2, 3, 50, 1000]) for n in pick.sample(range(1, size + 1), pick.randint(1, min(size, 12)))}
    packs, seen = {}, {}
    for length, rank, count, first, n, offset in packing.plan(histogram, size):
        seen.setdefault(length, []).append((rank, count))
        for i in range(count):
            packs.setdefault(first + i % n, []).append((offset + length * (i // n), length))
    for length, intervals in seen.items():
        assert sorted(x for r, c in intervals for x in range(r, r + c)) == list(range(histogram[length]))
    for pieces in packs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(packs) == list(range(len(packs)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=16))
def test_automaton(sequences, asked):
    automaton = Automaton()
    for owner, symbols in enumerate(sequences, 1):
        automaton.add(symbols, owner)
    automaton.close()
    for size in (1, 3, 4):
        for below in (2, 4, 9):
            held = {tuple(s[i : i + size]) for o, s in enumerate(sequences, 1) if o < below for i in range(len(s) - size + 1)}
            expected = [i + 1 >= size and tuple(asked[i + 1 - size : i + 1]) in held for i in range(len(asked))]
            assert automaton.matches(asked, size, below) == expected


def test_equal_windows_have_equal_anchors():
    pick = random.Random(2)
    shared = [pick.randrange(9) for _ in range(80)]
    rows = [[pick.randrange(9) for _ in range(30)] + shared + [pick.randrange(9) for _ in range(20)] for _ in range(2)]
    hashes = words.mix(np.array([x for r in rows for x in r], np.uint64))
    doc, start, count, anchor, _ = substring_dedup.anchored(hashes, np.array([0, 130, 260]), 50, 8)
    of = {(d, s + i): a for d, s, c, a in zip(doc, start, count, anchor, strict=True) for i in range(c)}
    assert len(of) == 2 * 81
    assert all(of[0, 30 + i] == of[1, 160 + i] for i in range(31))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [3, 7, 20, 41, 47, 56, 60, 120, 500])
def test_linked_sets_share_a_cell(n, percent):
    """The most that linked sets can differ, in many random ways."""
    pick = np.random.default_rng(n)
    bands = shingle_join._Bands(percent)
    for _ in range(60):
        own = np.unique(pick.integers(0, 0xFFFFFFFFFFFFFFFF, n, dtype=np.uint64))
        drop = int(pick.integers(0, n * (100 - percent) // 100 + 1))
        add = max(0, (100 * (n - drop)) // percent - n)
        other = np.unique(np.append(pick.permutation(own)[: n - drop], pick.integers(0, 0xFFFFFFFFFFFFFFFF, add, dtype=np.uint64)))
        both = len(np.intersect1d(own, other))
        if 100 * both >= percent * len(np.union1d(own, other)):
            assert set(shingle_join._cells(own, bands).tolist()) & set(shingle_join._cells(other, bands).tolist())


def test_tree_finds_all_that_can_link():
    pick = np.random.default_rng(3)
    base = pick.integers(0, 0xFFFFFFFFFFFFFFFF, 300, dtype=np.uint64)
    sets = [np.unique(np.append(base[pick.random(300) < 0.95], pick.integers(0, 0xFFFFFFFFFFFFFFFF, k, dtype=np.uint64))) for k in range(200)]
    n, points = np.array([len(s) for s in sets]), np.stack([shingle_join.point(s) for s in sets])
    tree = shingle_join.Tree(n, points)
    for i in (0, 40, 199):
        found = set(tree.search(n[i : i + 1], points[i : i + 1], 85)[1].tolist())
        assert (shingle_join.minima(points[i : i + 1], points)[0] == np.minimum(points[i], points).sum(1, dtype=int)).all()
        for j, other in enumerate(sets):
            both = len(np.intersect1d(sets[i], other))
            assert shingle_join.bound(n[i], points[i], n[j], points[j]) >= both
            if 100 * both >= 85 * (n[i] + n[j] - both):
                assert j in found
    crowded = np.full(shingle_join.GROUPS, 255, np.uint8)  # cut counts bound nothing
    assert len(shingle_join.Tree(np.array([200000]), crowded[None]).search(np.array([190000]), crowded[None], 85)[1]) == 1


def test_crc_of_pieces_is_little_endian():
    assert zlib.crc32(np.array([1, 300], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x2c\x01\0\0")
