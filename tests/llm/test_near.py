"""Near duplicates that fingerprints alone miss, against all pairs."""

import random

import pytest
from test_whole import one_of_each

from tidemark.llm import neardup
from tidemark.plans.ship import ship


def kept(spark, texts):
    ship(spark)
    rows = [(k, t) for k, t in texts.items()]
    return {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}


def edited(original, copies, edits, at):
    """Copies of a text, each with some of its words replaced by others of it; the text itself has the id ``at``."""
    draw = random.Random(5)
    texts = {}
    for k in range(copies + 1):
        words = list(original)
        for i in draw.sample(range(len(words)), 0 if k == at else edits):
            words[i] = draw.choice(original)
        texts[k] = " ".join(words)
    return texts


ORIGINAL = [f"word{i % 211}" for i in random.Random(3).sample(range(10_000), 300)]


def test_copies_of_one_original(spark):
    texts = edited(ORIGINAL, 150, 5, 0)
    assert one_of_each(texts) == {0}
    assert kept(spark, texts) == {0}


def test_copies_of_an_original_in_their_middle(spark):
    texts = edited(ORIGINAL, 150, 5, 75)
    assert one_of_each(texts) == {0}
    assert kept(spark, texts) == {0}


@pytest.mark.parametrize("block", [False, True])
def test_tails_and_blocks(spark, block):
    """Zipf texts, each with a copy that has a tail more or a block replaced, so that many lie beyond the radius."""
    draw = random.Random(8)
    words, weights = [f"z{i}" for i in range(5000)], [1 / (i + 1) for i in range(5000)]
    texts = {}
    for k in range(300):
        text = draw.choices(words, weights, k=400)
        more = draw.choices(words, weights, k=draw.randint(20, 85))
        n = len(more) // 2
        texts[2 * k] = " ".join(text)
        texts[2 * k + 1] = " ".join([*text[:100], *more[:n], *text[100 + n :]] if block else [*text, *more])
    want = one_of_each(texts)
    assert 300 <= len(want) < 450
    assert kept(spark, texts) == want


def test_same_words_in_another_order(spark):
    """Near copies whose fingerprint is also that of a smaller, dissimilar document."""
    words = [f"word{i}" for i in range(200)]
    shuffled = random.Random(1).sample(words, len(words))
    texts = {1: " ".join(shuffled), 2: " ".join(words), 3: " ".join([*words, words[-1]])}
    assert kept(spark, texts) == {1, 2}


def test_clashing_columns_and_empty_tables(spark):
    ship(spark)
    rows = [(1, "a b c d e f g", 7), (2, "a b c d e f g", 8), (None, "a b c d e f g", 9), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone_id int")
    assert sorted(tuple(r) for r in neardup.keep_one(df).select("doc_id", "gone_id").collect() if r.doc_id) == [(1, 7), (4, None)]
    assert neardup.keep_one(df).filter("doc_id is null").count() == 1
    assert neardup.keep_one(df.filter("false")).count() == 0
