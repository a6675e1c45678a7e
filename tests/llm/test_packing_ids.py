"""Token ids from remembered runs of letters are those of the tokenizer on whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from biomosaic.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def encoder():
    return packing._Ids(PATH)


def _ids(encoder, texts):
    ids, at = encoder.of(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_a_word_is_remembered_once_whatever_its_case_and_the_signs_after_it(encoder):
    _ids(encoder, ["Über, über. ÜBER&&& über", "Word. word, WORD! word wOrd###"])
    # Two runs of letters, five runs of signs.
    assert len(encoder.words) == 7
    assert encoder.folds


def test_recurring_words_outlast_a_full_memory(encoder, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    _ids(encoder, ["again and"])
    _ids(encoder, ["again and " + " ".join("abcdefghi")])
    _ids(encoder, [" ".join("jklmnopqrstu")])
    learnt = []
    monkeypatch.setattr(encoder, "learn", lambda *a: learnt.append(a))
    _ids(encoder, ["and again"])
    assert not learnt


@pytest.mark.parametrize("remembered", [50, 1 << 19])
def test_ids_are_the_tokenizers(encoder, monkeypatch, remembered):
    """Marks that compose with letters, contractions, added tokens in either case."""
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    whole, deal = Tokenizer.from_file(PATH), random.Random(7)
    signs = list("abcJKkistSÉéß×÷ÞİıΣς…ﬁ한가²½̸́̌ \u0085'.,!-_12|<>& \t\n\x00\x1c")
    signs += ["'s", "'LL", "n't", " ", "😀"]
    for marks in (signs, [*signs, "<|endoftext|>", "<|STARTOFTEXT|>"]):
        for _ in range(30):
            texts = ["".join(deal.choices(marks, k=deal.randrange(60))) for _ in range(20)] + [None, ""]
            want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
            assert _ids(encoder, texts) == want
