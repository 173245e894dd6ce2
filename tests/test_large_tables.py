"""Results that only odd inputs or larger tables tell apart."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from detectlab.functions import ladders
from detectlab.functions.checks import mod97
from detectlab.functions.entropy import shannon
from detectlab.operators import compare as J
from detectlab.operators import detect as D
from detectlab.operators import neardup as L
from detectlab.operators import scoring as M
from detectlab.operators import sigindex
from detectlab.plans import QUERIES, derived


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    rows = [(1, "card 4532015112830366 here"), (2, "nothing")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["stream_detection"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.category, r.match) for r in found] == [(1, "credit_card", "4532015112830366")]


def test_entropy_of_exactly_the_threshold(spark):
    tokens = ["6f7627229b6f4e6629aba1bb65bb8058" + "a" * 16, "04b7310f384ab4f847594793ac84c3cc" + "a" * 16, "03946929a127ca07220331185021772b" + "a" * 16]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(shannon(F.col("t"))).collect()]
    want = []
    for token in tokens:
        total = 0.0
        for _, c in sorted(Counter(token).items()):
            total += -(c / len(token)) * math.log2(c / len(token))
        want.append(total)
    assert got == want
    long = "ab" * 200
    assert abs(spark.range(1).select(shannon(F.lit(long))).first()[0] - 1.0) < 1e-12


def test_a_palindrome_is_its_own_reversal(spark):
    rows = spark.createDataFrame([("ssn", "123454321"), ("ssn", "000454000"), ("email", "abccba")], "category string, variant string")
    assert [r.detected for r in D.run_detection(rows, decode=True).collect()] == [True, False, False]


def test_a_summary_counts_what_its_rows_stand_for(spark):
    rows = spark.createDataFrame([("a", "t", "pass", 3), ("a", "t", "fail", 5), ("b", "t", "error", 2)], "category string, technique string, severity string, rows long")
    found = M.overall(rows).first()
    assert (found.total, found["pass"], found.fail, found.error) == (10, 3, 5, 2)
    both = {r.category: (r.total_a, r.pass_a, r.total_b) for r in J.by_category_delta(rows, rows).collect()}
    assert both == {"a": (8, 3, 8), "b": (2, 0, 2)}


def test_runs_beside_each_other_equal_runs_that_are_joined(spark, sf):
    a, b = derived.detection_run(spark, sf, False), derived.detection_run(spark, sf, True)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    pairs = derived.paired_run(spark, sf).cache()
    assert rows(J.changed_rows(pairs.drop("caught"))) == rows(J.row_diffs(a, b))
    assert pairs.filter("caught").count() == b.filter("severity = 'pass'").select(*J.KEY).distinct().count()


def test_remainders_in_pieces(spark):
    texts = ["GB82WEST12345698765432", "0" * 36, "Z" * 36, "Z" * 37, "7", "a1*b2", "12 34"]
    want = [int("".join(str(int(c, 36)) for c in t)) % 97 if t.isalnum() else None for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mod97(F.col("t"))).collect()]
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


def test_rates_of_a_corpus_are_drawn_apart(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)))], "doc_id long, text string")
    kept = {r.variant: r.variant_text.split() for r in L.neardup_corpus(docs, "doc_id", "text", variants=5).collect()}
    replaced = {v: {i for i, w in enumerate(ws) if not w.startswith("word")} for v, ws in kept.items()}
    assert all(replaced[v] - replaced[v + 1] for v in range(4))


def test_results_of_a_payload_are_grouped_in_place(spark, sf):
    run = derived.detection_run(spark, sf, False, derived.payloads_by_id(spark, sf))
    prepared = run.groupBy("payload_id").agg(F.collect_list("variant"))._jdf.queryExecution().executedPlan().toString()
    assert prepared.count("hashpartitioning(payload_id") == 1


def test_documents_that_share_frequent_shingles_alone_are_not_compared(spark, monkeypatch):
    passage = " ".join(f"common{i}" for i in range(40))
    own = lambda side, i: " ".join(f"{side}{i}word{j}" for j in range(60))
    texts = {i: f"{own('a', i)} {passage}" for i in range(30)} | {100: "", 101: "ab", 102: "a b"}
    other = {i: f"{own('b', i)} {passage}" for i in range(30)} | {50: texts[3], 51: texts[4] + " end", 52: texts[3], 53: "ab", 54: ""}
    seen, rated = [], L.rated
    monkeypatch.setattr(L, "rated", lambda pairs, left, right: seen.append(pairs.count()) or rated(pairs, left, right))
    for threshold, want in ((0.5, {3: (50, 1.0, 1), 4: (51, 98 / 99, 1), 101: (53, 1.0, 1)}), (0.25, None)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        registered = spark.createDataFrame(list(other.items()), "reg long, other string")
        got = {r.doc_id: (r.reg, r.jaccard, r.matches) for r in L.similar_registered(docs, "doc_id", "text", registered, "reg", "other", threshold).collect()}
        if want is None:
            sets = lambda t: {tuple(t.split()[i:i + 3]) for i in range(len(t.split()) - 2)}
            best = {i: min((-len(sets(t) & sets(o)) / len(sets(t) | sets(o)), k) for k, o in other.items() if len(o.split()) > 2) for i, t in texts.items() if i < 100}
            assert {i: (k, -j) for i, (j, k) in best.items() if -j >= threshold} == {i: v[:2] for i, v in got.items() if i < 100} and got[101] == (53, 1.0, 1)
        else:
            assert got == want
    assert seen[0] == 3


def test_numbered_shingles_tell_texts_apart_as_their_strings_do(spark):
    rows = [("a b c d",), ("A b C d",), ("a b",), ("abc",), ("",), ("　x y z w ",), ("x x x x x",)]
    both = spark.createDataFrame(rows, "t string").select(L.shingles(F.col("t")).alias("s"), L.shingle_set(F.col("t")).alias("n")).collect()
    assert [len(r.s) for r in both] == [len(r.n) for r in both]
    assert all((set(a.s) == set(b.s)) == (a.n == b.n) for a in both for b in both)


def test_a_run_over_distinct_values_counts_what_the_whole_run_does(spark, sf):
    keys = ["category", "technique", "strategy", "severity", "detected", "confidence", "error"]
    for normalised in (False, True):
        whole = derived.detection_run(spark, sf, normalised).groupBy(*keys).agg(F.count("*").alias("rows"), F.min("payload_id").alias("first"))
        counted = derived.counted_run(spark, sf, normalised)
        assert counted.filter("category = 'random_api_key'").count() < counted.filter("category = 'iban'").count() / 5
        grouped = counted.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.min("payload_id").alias("first"))
        assert sorted(map(str, whole.collect())) == sorted(map(str, grouped.collect()))


@pytest.mark.parametrize("each", [False, True])
def test_similarities_without_texts_are_those_of_the_ladder(spark, each, monkeypatch):
    word = lambda i: ("ab12", "NATO,", "the", "Lorem", "data", "(USD)", "mail@x")[i % 7] if i % 5 else f"word{i % 83}"
    texts = ["", "a", "ab NATO", "x y z", "a a a a a", " ".join("the" for _ in range(50)), None, *[" ".join(word(i * j) for i in range(3 + 97 * j)) for j in range(12)]]
    # Keys of several lengths, so that what is drawn from takes one, two and three blocks.
    docs = spark.createDataFrame([(str(i) * (1 + i * i), t) for i, t in enumerate(texts)], "doc string, text string")
    rates = (0.0, 0.05, 0.3, 1.0)
    whole = L.ladder(docs, "doc", "text", rates, 7, each).drop("variant_text")
    monkeypatch.setattr(ladders, "TOGETHER", 500)
    apart = L.ladder_similarities(docs, "doc", "text", rates, 7, each)
    assert apart.columns == whole.columns
    assert sorted(map(str, apart.collect())) == sorted(map(str, whole.collect()))
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_put_together_for_similarities_alone(spark, sf):
    for name in ("neardup_threshold_report", "neardup_corpus_manifest"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "variant_text" not in plan


def test_md5_of_many_messages():
    for prefix in ("", "0|distort|1|0.05|", "p" * 53, "p" * 54, "p" * 55, "p" * 64, "p" * 119):
        first, second = ladders.draws([prefix, "other"], np.array([101, 3]))
        want = [hashlib.md5(f"{prefix}{i}".encode()).hexdigest() for i in range(101)] + [hashlib.md5(f"other{i}".encode()).hexdigest() for i in range(3)]
        assert [f"{a:08x}{b:08x}" for a, b in zip(first, second)] == [w[:16] for w in want]


def test_sums_of_placed_cases_beyond_64_bits(spark):
    rows = lambda ids: spark.createDataFrame([("t", n, i, f"t_{n}") for n, i in enumerate(ids, 1)] + [("u", 1, -5, "u")], "base_name string, n int, payload_id long, case_name string")
    small, large = [7, 1 << 40], [1 << 60, 1 << 61, 3 << 59, 11]
    for ids, kind in ((small, "bigint"), (large, "decimal(38,0)")):
        found = M.placed_cases(rows(ids))
        assert dict(found.dtypes)["placed"] == kind
        assert {r.base_name: (r.cases, int(r.placed), r.last_name) for r in found.collect()} == {
            "t": (len(ids), sum(n * i for n, i in enumerate(ids, 1)), f"t_{len(ids)}"), "u": (1, -5, "u")}


def test_documents_that_share_a_band_alone_are_no_pairs(spark):
    passage = lambda g: " ".join(f"common{g}word{i}" for i in range(12))
    texts = [(i, f"{passage(i % 20)} " + " ".join(f"own{i}word{j}" for j in range(90))) for i in range(240)] + [
        (240, passage(0)), (241, passage(0) + " end"), (242, "ab"), (243, "")]
    sets = L.shingle_sets(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text")
    signed = sigindex.signatures(sets)
    bands = signed.select("row", F.explode("bands").alias("band"))
    met = bands.join(bands.withColumnRenamed("row", "other"), "band").where("row < other").select("row", "other").distinct().count()
    pairs = sigindex.candidates(signed, signed, 0.5).where("l_row < r_row")
    assert met > 100 and pairs.count() < met / 10
    found = L.rated(pairs, sets, sets).where("jaccard >= 0.5").collect()
    assert [round(r.jaccard, 9) for r in found] == [round(10 / 11, 9)]
    # No set and no minimum is shuffled, neither for signatures nor to keep one document of each set.
    assert "Exchange hashpartitioning" not in signed._jdf.queryExecution().executedPlan().toString()
    one, _ = L.one_per_set(sets, "doc_id", "first")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and one.count() == 243


def test_sketches_agree_in_as_many_minima_as_sets_are_similar(spark):
    rng = np.random.default_rng(5)
    shared, rest = rng.integers(0, 1 << 63, (300, 200)), rng.integers(0, 1 << 63, (300, 200))
    a = np.concatenate([shared, rest[:, :100]], axis=1).astype(np.uint64)
    b = np.concatenate([shared, rest[:, 100:]], axis=1).astype(np.uint64)
    of = lambda x: sigindex.signatures_of(x.reshape(-1), np.full(300, 300))
    (bands_a, sketch_a), (bands_b, sketch_b) = of(a), of(b)
    nibbles = lambda k: (k[:, :, None] >> np.arange(0, 64, 4, dtype=np.uint64)) & np.uint64(15)
    common = (nibbles(sketch_a) == nibbles(sketch_b)).sum(axis=(1, 2))
    assert abs(common.mean() - 42.5) < 1.5 and common.min() >= sigindex.least_common(0.5) and abs(common.std() - 4.5) < 0.8
    assert abs((bands_a == bands_b).sum(axis=1).mean() - 10) < 0.7
    rows = [(int(i), *map(int, k)) for i, k in enumerate(np.concatenate([sketch_a, sketch_b], axis=1).view(np.int64))]
    names = [f"{side}{i}" for side in "lr" for i in range(sigindex.SKETCH)]
    got = spark.createDataFrame(rows, ["id", *names]).select(sigindex.common_minima("l", "r").alias("c"), "id").collect()
    assert {r.id: r.c for r in got} == dict(enumerate(common.tolist()))


def test_two_runs_are_counted_in_one_pass(spark, sf):
    keys = ["category", "generator", "technique", "strategy", "severity"]
    for normalised, counted in zip((False, True), derived.paired_counts(spark, sf)):
        whole = derived.detection_run(spark, sf, normalised).groupBy(*keys).agg(F.count("*").alias("rows"))
        assert sorted(map(str, whole.collect())) == sorted(map(str, counted.groupBy(*keys).agg(F.sum("rows").alias("rows")).collect()))


def test_hexadecimal_digits_without_an_x_are_no_entity(spark):
    texts = {"&#65;&#x42;&#X43;": "ABC", "&#ab; &#x;": "&#ab; &#x;", "&#127;&#128;&#8364;&#x1F600;": "\x7f\x80\u20ac\U0001F600", "&#0;&#xD800;": "&#0;&#xD800;"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.unescape_html(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == texts
