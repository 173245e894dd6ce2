"""Disguised words: the gate, signs at word edges, long strings."""

from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from detectlab.llm import toxicity

WORDS = "idiot moron stupid clown loser asshole you are such a the hello".split()


@cache
def restorer():
    counts = np.zeros(toxicity.WIDTH**3)
    for word in WORDS * 50:
        codes = [0, 0, *(toxicity._CODE[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[(a * toxicity.WIDTH + b) * toxicity.WIDTH + c] += 1
    return toxicity.Restorer(toxicity.character_model(counts))


@pytest.mark.parametrize(("text", "word"), [
    ("i-d-i-0-t", "idiot"), ("m.0.r.o.n", "moron"), ("i d 1 o t", "idiot"), ("id¡ot", "idiot"), ("mor0n", "moron"), ("los€r", "loser"),
    ("$tupid", "stupid"), ("@sshole", "asshole"), ("1diot", "idiot"), ("s t u p 1 d", "stupid"), ("$tup1d!", "stupid"),
])
def test_signs_anywhere(text, word):
    assert restorer().restore(f"the {text} the").split()[1] == word


def test_signs_that_are_none():
    assert restorer().restore("hello! clown5 (the 12 $5 5-1").split()[0].startswith("hello")
    assert restorer().restore("a 12 $5 555-6503 !!! the") == "a 12 $5 555-6503 !!! the"


@pytest.mark.parametrize("join", [",", "/", "-", ";", "--"])
def test_long_strings(join):
    text = join.join(["1d10t", "m0r0n", "stup1d", "c1own", "l0ser", "1d1ot", "moron", "st0pid"])
    read = restorer().restore(text)
    assert len(text) > 40 and [w for w in ("idiot", "moron", "stupid", "clown", "loser") if w in read] == ["idiot", "moron", "stupid", "clown", "loser"]


def test_long_phrases_and_long_words():
    assert restorer().restore(" ".join("youaresuchastupididiot")).split()[-2:] == ["stupid", "idiot"]
    assert restorer().restore("st" + "u" * 500 + "pid") == "stupid"
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff1" * 3
    assert restorer().restore(key) == key


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aidot015$@!|(€¡*._- \n#,é", "aaa", "idiot", "²"]), max_size=25).map("".join))
def test_the_gate_leaves_nothing_out(text):
    assert restorer().restore(text) == restorer().decoded(text)


def test_length_is_no_reason_to_skip():
    for n in (3, 4, 9, 30):
        assert restorer().restore("1d10t" * n).replace(" ", "") == "idiot" * n
        assert restorer().restore("1d10tm0r0n" * n).replace(" ", "") == "idiotmoron" * n
    assert restorer().restore("24be64439e3e49cf46b2d7c90f3602a3d0b907ff1") == "24be64439e3e49cf46b2d7c90f3602a3d0b907ff1"


def test_any_few_separators():
    for text in ("i/d/i/o/t", "i,d,i,o,t", "i  d  i  o  t", "i\nd\ni\no\nt", "i - d - i - o - t", "i / d / 1 / o / t"):
        assert restorer().restore(text) == "idiot"


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "two"), (3, None), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    sample, _ = toxicity._sample(docs, labels, "doc_id", "text")
    assert sorted((r.doc_id, r.y) for r in sample.collect()) == [(1, 1), (2, 0), (3, 0)]
