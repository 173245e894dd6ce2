"""The agenda of pairs against the sentencepiece library."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from detectlab.llm import pieces
from detectlab.llm.queries import QUERIES
from detectlab.session import read_table


@pytest.fixture(scope="module")
def model():
    return pieces.piece_model(pieces.model_bytes())


@pytest.fixture(scope="module")
def library():
    return pieces.library(pieces.model_bytes())


def row(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)


def test_documents(spark, sf, library):
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_piece_round_trip"](spark, sf).collect()}
    assert got == {i: row(library, t) for i, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aaabeeth  \n\t'sdrelv12_.%#|<>éß²½日  　▁\x00\x85😀"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text) and model.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 260), st.integers(0, 31999)), max_size=12))
def test_any_ids(model, library, ids):
    assert model.decode(ids) == library.decode(ids)


def test_long_words_and_runs(model, library):
    for text in ["a" * 5000, "ab" * 3000, " " * 777, "x" + " " * 100 + "y ", "=" * 999 + "\n" * 50, "é" * 2000]:
        assert model.encode(text) == library.encode(text)


def test_full_caches_start_anew(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    monkeypatch.setattr(pieces, "CACHE_PARTS", 2)
    text = "some words that are qqqzx and zzqj, then others xxqv"
    assert model.encode(text) == library.encode(text) == model.encode(text)


def test_disagreement_is_told(library):
    model = pieces.PieceModel(pieces.model_bytes())
    model.words["wrong"] = (5, 6)
    model.unchecked.append(("wrong", (5, 6)))
    model.encode("right words")
    model.encode(" two  blanks")
    model.check(library)
    assert model.wrong == {"wrong"} and not model.unchecked
    assert model.agrees("right words") and not model.agrees("all wrong here") and model.agrees("wrongs")


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n \n"), (5, "same text"), (5, "same text"), (None, "no id"), (6, "x" * 20000), (7, "<s> </s><unk>▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit("x").alias(c) for c in ("piece_ids", "decoded", "agreed", "__r", "n_tokens")])
    assert Counter(tuple(r) for r in pieces.round_trips(df).collect()) == Counter((i, *row(library, t)) for i, t in rows)
    kept = pieces.encoded(df)
    assert {"piece_ids", "decoded", "agreed", "n_tokens"} <= set(kept.columns) and len(set(kept.columns)) == len(kept.columns)
    assert {(r.text or "", r.decoded) for r in kept.collect()} == {(t or "", library.decode(library.encode(t or ""))) for _, t in rows}
    assert pieces.round_trips(df.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceModel(b"")


def test_control_ids_before_the_text(model, library):
    for ids in ([1, 315], [1, 2, 315, 315], [2, 1], [1, 3, 315], [315, 1, 315]):
        assert model.decode(ids) == library.decode(ids)
