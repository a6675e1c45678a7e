import random

import pytest

LONG = "wort " * 6000


@pytest.fixture(scope="session")
def make_docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def build(*rows, extra=False):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
        frame = spark.createDataFrame(full, schema)
        if extra:  # names that the operators use for their own columns
            from pyspark.sql import functions as F

            for name in ("score", "keep_id", "node", "word", "start", "rank", "n_words", "weight", "label", "sha", "row"):
                frame = frame.withColumn(name, F.lit("x"))
        return frame.repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty and long texts, ties, a repeated row, null columns, further columns."""
    return make_docs(
        (1, None), (2, ""), (3, "  \n "), (4, LONG), (5, LONG.upper()), (6, "one two"), (6, "one two"),
        (7, "one two", None, None), (None, "one two"), (None, None, None, None), (8, "12 !? 34"),
        (9, "x" * 3000), (10, "a b c d e f g h"), (11, "a b c d e f g h"), extra=True,
    )


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact copies, near copies and shared passages, from a small vocabulary."""
    pick = random.Random(5)
    vocabulary = [a + b for a in ("ta", "re", "mi", "so", "lu", "ven", "kor") for b in ("n", "st", "le", "ra", "x", "po")]
    texts = []
    passage = [pick.choice(vocabulary) for _ in range(70)]
    for i in range(160):
        kind = i % 8
        words = [pick.choice(vocabulary) for _ in range(pick.choice([3, 12, 40, 60, 120, 260]))]
        if texts and kind == 1:
            words = list(pick.choice(texts))
        elif texts and kind in (2, 3):
            words = list(pick.choice(texts))
            for _ in range(max(1, len(words) // 60)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
        elif kind == 4:
            at = pick.randrange(len(words))
            cut = pick.randrange(0, 15)
            words[at:at] = passage[cut:]
        texts.append(words)
    return {i * 3 + 1: (" " if i % 2 else "\n").join(w if j % 7 else w.title() for j, w in enumerate(words)) for i, words in enumerate(texts)}
