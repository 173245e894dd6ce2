"""The pipeline's near-duplicate stage against all pairs."""

import random
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from detectlab.llm import nearcopies
from detectlab.session import read_table


def roots(sets):
    """{id: shingle set} -> {id: least id of its group}, over all pairs."""
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if nearcopies.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_stage_equals_all_pairs(spark, sf, scale):
    where = sf.replace("sf0.001", scale)
    docs = read_table(spark, where, "documents")
    owner = roots({r.doc_id: nearcopies.shingles(r.text) for r in docs.collect()})
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, where)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in owner if owner[i] == i)


def varied(rng, words, edits, tag):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"{tag}{rng.random()}"
    return words


@pytest.mark.parametrize("n", [300, 1500])
def test_copies_linked_to_one_member_of_a_hot_group(spark, n):
    """n near copies of a text, and for each of them one copy that is similar to it alone."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(300)]
    first = [varied(rng, base, 3, "x") for _ in range(n)]
    # Six words more in a row: similar to its own first, to the others not.
    second = []
    for words in first:
        at = rng.randrange(5, 250)
        second.append([*words[:at], *[f"y{rng.random()}" for _ in range(44)], *words[at + 6 :]])
    sets = [nearcopies.shingles(" ".join(w)) for w in (*first[:40], *second[:40])]
    assert all(nearcopies.jaccard(sets[i], sets[40 + i]) >= 0.8 for i in range(40))
    rows = [(i, " ".join(w)) for i, w in enumerate([*first, *second])]
    docs = spark.createDataFrame([*rows, (10**6, " ".join(reversed(base)))], "doc_id long, text string").repartition(8)
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect()) == [0, 10**6]


def test_a_common_passage_is_no_group(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join([*passage, *[f"u{rng.random()}" for _ in range(60)]])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert nearcopies.drop_near_copies(docs).count() == 400


def test_one_row_of_each_group(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "a b c d"), (None, "a b c d"), (7, None), (None, None), (5, ""),
            (None, "q w e r t"), (None, "q w e r t"), (8, "z " * 3000)]
    kept = nearcopies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 5, None, 8])
    assert nearcopies.drop_near_copies(kept.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(300)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (1000, " ".join(reversed(base)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.drop_near_copies(docs).collect()) == [0, 1000]


def test_balls_give_all_pairs_within_two_bits(spark):
    """The fingerprints are of the shingle sets; each set is joined to all within two bits of it, through the balls alone."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(1500)]
    texts = [*(" ".join(varied(rng, base, 1, "x")) for _ in range(40)), *(" ".join(varied(rng, base, 900, "y")) for _ in range(20))]
    prints = {i: nearcopies.sketch(t)[2] for i, t in enumerate(texts)}
    for i in (0, 50):
        hashes = [xxhash.xxh64_intdigest(g) for g in nearcopies.shingles(texts[i])]
        bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
        assert prints[i] & (1 << 64) - 1 == sum(x << b for b, x in enumerate(bits))
    sets = spark.createDataFrame(list(prints.items()), "node long, fp long")
    pairs = {(r.a, r.b) for r in nearcopies.ball_pairs(sets).collect()}
    near = [(i, j) for i in prints for j in prints if i < j and ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2]
    assert near and pairs <= set(near)

    def groups(links):
        up = {i: i for i in prints}
        for _ in prints:
            for a, b in links:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(pairs) == groups(near)


def test_shingles_of_hot_sets_are_made_once(spark, capsys):
    """One Python step a task, so one worker."""
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "a b c d e x"), (4, None)], "node long, text string")
    plans = []
    kept, nearcopies.materialise = nearcopies.materialise, lambda df, name: (plans.append((name, df)), kept(df, name))[1]
    try:
        rare = nearcopies.rare_shingles(texts.select("node"), texts, 5, 0.8)
    finally:
        nearcopies.materialise = kept
    # A set similar to the third or the second shares two shingles with it; of the first, one of the two is enough.
    assert [(r.node, r.n) for r in rare.collect()] == [(1, 2)]
    terms = dict(plans)["terms"]
    terms.explain()
    plan = capsys.readouterr().out
    assert plan.count("EvalPython") + plan.count("MapInArrow") == 1


def hot_group(n):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    return [" ".join(base), *(" ".join(varied(rng, base, 3, "x")) for _ in range(n - 1))]


def test_a_hot_group_gives_few_candidates(spark):
    """A few for each set, not some of every key, and they join it."""
    texts = hot_group(600)
    kept = [nearcopies.sketch(t) for t in texts]
    sets = spark.createDataFrame([(i, s[1], s[3]) for i, s in enumerate(kept)], "node long, keys array<long>, kept array<long>")
    pairs, hot = nearcopies.candidates(sets, 0.8)
    pairs = {(r.a, r.b) for r in pairs.collect()}
    assert len(pairs) < 10 * len(texts) and hot.count() == len(texts)
    assert {(0, i) for i in range(1, 600)} <= pairs


def test_what_is_kept_leaves_no_similar_pair_out(spark):
    rng = random.Random(22)
    rows = []
    for length in (4, 9, 60, 300, 2500):
        base = [f"w{i}" for i in range(length)]
        rows += [(" ".join(varied(rng, base, e, "x")), " ".join(varied(rng, base, e, "y"))) for e in (0, 1, length // 90, length // 40, length // 9) for _ in range(8)]
    similar = [nearcopies.jaccard(nearcopies.shingles(a), nearcopies.shingles(b)) for a, b in rows]
    kept = [(i, nearcopies.sketch(a)[3], nearcopies.sketch(b)[3]) for i, (a, b) in enumerate(rows)]
    near = {r.i for r in spark.createDataFrame(kept, "i int, x array<long>, y array<long>").where(nearcopies.near("x", "y", 0.8)).collect()}
    assert {i for i, s in enumerate(similar) if s >= 0.8} <= near
    assert not any(s < 0.4 for i, s in enumerate(similar) if i in near) and len(near) < len(rows)
    # Nothing shared in 512 cells cannot be similar, whatever the minima are.
    assert 0.8 > 1 - nearcopies.least_equal(0.8) / 128 > 0.3


def test_sets_apart_meet_in_one_row(spark, capsys):
    """Pairs of different components are rows of the join once, and only those that can be similar."""
    rng = random.Random(23)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(varied(rng, base, 5, "x")) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    hot = spark.createDataFrame([(i, nearcopies.sketch(t)[3]) for i, t in rows], "node long, kept array<long>")
    rare = nearcopies.rare_shingles(hot.select("node"), spark.createDataFrame(rows, "node long, text string"), 5, 0.8)
    none = spark.createDataFrame([], "node long, component long")
    got = {(r.a, r.b) for r in nearcopies.across(rare, hot, none, None, 0.8).collect()}
    sets = [nearcopies.shingles(t) for t in texts]
    similar = {(i, j) for j in range(60) for i in range(j) if nearcopies.jaccard(sets[i], sets[j]) >= 0.8}
    assert similar <= got and len(got) < 60 * 59 // 4
