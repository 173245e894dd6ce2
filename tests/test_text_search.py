"""Exact match against brute force, normal forms and layered decoding."""

import re
import unicodedata
from collections import Counter
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from detectlab.functions import encodings as E
from detectlab.functions.unicode import normal_form
from detectlab.operators import detect as D
from detectlab.operators import exactmatch as X

EDGES = re.compile(r"""^[,;:!?"'<>\[\]{}]+|[,;:!?"'<>\[\]{}]+$""")


def folded(text):
    return re.sub(r"[\s\-./()]+", "", unicodedata.normalize("NFKC", text).lower())


def brute(rows, values):
    known = {}
    for category, value in values:
        if folded(value):
            known.setdefault(folded(value), set()).add(category)
    found = Counter()
    for doc_id, text in rows:
        tokens = [t for t in (folded(EDGES.sub("", t)) for t in unicodedata.normalize("NFKC", text or "").lower().split()) if t]
        for i in range(len(tokens)):
            run = ""
            for j in range(i, min(len(tokens), i + 40)):
                run += tokens[j]
                for category in known.get(run, ()):
                    found[doc_id, i + 1, j - i + 1, category] += 1
    return found


VALUES = [("card", "4532 0151-1283"), ("name", "Ann Lee"), ("mail", "a.b@x.org"), ("other", "ann-lee"), ("form", "ﬁle １２３"), ("long", "one two three four five six")]
ROWS = [
    (1, "see 4532 0151 1283, or 45320151-1283 (4 5 3 2 0 1 5 1 1 2 8 3) and ann"), (2, None), (3, ""), (4, " \n "),
    (5, "Ann Lee ANN  LEE annlee an nlee! 'ann lee'"), (6, "file 123 ﬁle①②③ FILE-123"), (7, "word " * 700 + "a.b@x.org a b @ x org " + "one two three four five six " * 3),
    (7, "ann lee"), (None, "x ann lee"),
]


@pytest.mark.parametrize(("window", "values"), [(128, VALUES), (3, VALUES), (3, [*VALUES, ("short", "a b")])])
def test_registered_values_are_found(spark, monkeypatch, window, values):
    monkeypatch.setattr(X, "WINDOW", window)
    dictionary = X.register_values(spark.createDataFrame([(c, c, v) for c, v in values], "category string, label string, value string"), "k")
    rows = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("run", F.lit("x"))
    want = brute(ROWS, values)
    assert len(want) > 8
    for known in (dictionary, dictionary.drop("probe", "head")):
        found = X.find_registered(rows, ["doc_id"], "text", known, "k")
        assert Counter(tuple(r) for r in found.select("doc_id", "position", "words", "category").collect()) == want
    assert X.find_registered(rows.limit(0), ["doc_id"], "text", dictionary, "k").count() == 0
    assert X.find_registered(rows, ["doc_id"], "text", dictionary.limit(0), "k").count() == 0


def test_normal_forms(spark):
    texts = ["ﬁ①𝟏½ｶﾞ한글", "éé", "plain", "", None, "ﷺ㌔Å", "á̧̃"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        got = df.select("t", normal_form(F.col("t"), form).alias("n")).collect()
        assert all(r.n == (r.t if r.t is None else unicodedata.normalize(form, r.t)) for r in got)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["&eacute;", "&nbsp;", "&CounterClockwiseContourIntegral;", "&nosuch;", "&lt;", "&amp;amp;", "& ", "&#233;", "&#x1F600;", "x", ";", "&fjlig;"]), max_size=6))
def test_entities(spark, parts):
    text = "".join(parts)
    got = spark.createDataFrame([(text,)], "t string").select(D.unescape_html(F.col("t"))).first()[0]
    assert got == unescape(text)


def test_layers_are_searched_breadth_first(spark):
    card = "4532015112830366"
    built = {
        0: F.lit(card), 1: E.base64(F.lit(card)), 2: E.percent(E.base64(F.lit(card))), 3: E.hex_lower(E.percent(E.base64(F.lit(card)))),
        4: E.base64(E.hex_lower(E.percent(E.base64(F.lit(card))))),
    }
    found = lambda t: F.contains(t, F.lit(card))
    row = spark.range(1).select(*[D.search_views(e, found).alias(f"d{n}") for n, e in built.items()], D.search_views(built[4], found, 4).alias("deep")).first()
    assert (row.d1, row.d2, row.d3, row.d4, row.deep) == (1, 2, 3, None, 4)
    views = spark.range(1).select(D.decoded_views(built[2])).first()[0]
    assert card in views and len(views) == len(set(views))
    assert spark.createDataFrame([(None,), ("",)], "t string").select(D.search_views(F.col("t"), found).alias("d")).where("d IS NOT NULL").count() == 0


def test_runs_are_found_across_parts_and_rows(spark, monkeypatch):
    """The rows of a batch stand one after the other: no run goes over a row's end, and none is lost where a part ends; one Python step."""
    monkeypatch.setattr(X, "WINDOW", 2)
    values = [("c", "c", "alpha beta"), ("c", "c", "béta 42"), ("c", "c", "xyz")]
    dictionary = X.register_values(spark.createDataFrame(values, "category string, label string, value string"), "k")
    texts = [(1, "x alpha"), (2, "beta xyz"), (3, None), (4, ""), (5, "one, (al-pha) \"BE.TA\", two x.y.z! bÉ ta4 2 " * 3), (6, "!" * 20000 + "x yz"),
             (7, "alphabeta"), (8, "xyz" * 3)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    for known in (dictionary, dictionary.drop("probe")):
        got = sorted((r.doc_id, r.position, r.words) for r in X.find_registered(rows, ["doc_id"], "text", known, "k").collect())
        each = [(2, 2), (5, 1), (6, 3)]
        assert got == [(2, 2, 1), *((5, 8 * i + at, n) for i in range(3) for at, n in each), (6, 1, 2), (7, 1, 1)]
    runs = X._runs(rows, ["doc_id"], "text", [3, 9], "k", None)
    assert runs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
