"""Operators that compare documents, models that learn, and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from detectlab.llm import components, nearcopies, sharding, simhash, toxicity
from detectlab.llm.queries import QUERIES
from detectlab.session import read_table
from tests.llm.test_near_copies import roots

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum((2 * v > len(grams)) << b for b, v in enumerate(votes))


def groups_of(prints):
    """{id: fingerprint} -> {id: least id of its group}."""
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates(spark, sf):
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    owner = groups_of(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_groups"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", owner[i]) for i in texts}


def test_links_of_fingerprints(spark):
    """Chains, rings and dense balls of fingerprints, against all pairs."""
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(40):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            v ^= rng.choice([0, 1 << rng.randrange(64), (1 << rng.randrange(64)) | (1 << rng.randrange(64))])
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << b) for b in range(64)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    owner = groups_of(dict(zip(signed, values, strict=True)))
    sizes = Counter(owner.values())
    assert {v for v in signed if sizes[owner[v]] > 1} == set(found)
    by_root, by_component = defaultdict(set), defaultdict(set)
    for v in found:
        by_root[owner[v]].add(v)
        by_component[found[v]].add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_component.values()))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "a b c d"), (7, None), (5, ""), (None, "q w e r t"), (None, None), (9, " "), (8, "z " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in ("fp", "component", "shard", "slot", "h", "score", "lang", "source")])


def test_near_duplicates_on_odd_rows(odd):
    rows = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert rows == Counter([(3, 1), (1, 1), (1, 1), (7, 5), (5, 5), (9, 5), (None, 5), (None, None), (8, 8)])
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 5, 8, None, None])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(9, 9), (None, 3)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


# --- shards -----------------------------------------------------------------------------------------------------------

def check_shards(rows, texts, shards):
    """Laws of the result; the bytes of each shard."""
    size, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r.size, r.text_crc32) for r in rows) == want
    return [size[i] for i in range(shards)]


def test_shards_of_documents(spark, sf):
    texts = [r.text for r in read_table(spark, sf, "documents").collect()]
    check_shards(QUERIES["op6_minimax_shards"](spark, sf).collect(), texts, 16)


@pytest.mark.parametrize(("seed", "shards"), [(1, 4), (2, 16), (3, 5), (4, 1)])
def test_least_capacity(spark, seed, shards):
    """The largest shard is as small as the best contiguous partition in hash order allows."""
    rng = random.Random(seed)
    groups = [(rng.getrandbits(64) - (1 << 63), rng.randrange(1, 50)) for _ in range(400)]
    # Hashes that share long prefixes need several levels.
    groups += [(groups[0][0] ^ k, rng.randrange(1, 50)) for k in range(1, 60)]
    cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "h long, size long"), shards)
    groups.sort()
    size = Counter()
    for h, n in groups:
        size[sum(h >= c for c in cuts)] += n
    best = max(n for _, n in groups)

    def fits(capacity):
        used, load = 1, 0
        for _, n in groups:
            if load + n > capacity:
                used, load = used + 1, 0
            load += n
        return used <= shards

    while not fits(best):
        best += 1
    assert len(cuts) < shards and max(size.values()) == best


def test_shards_with_large_groups(spark):
    texts = ["hot " * 50] * 400 + ["warm " * 40] * 200 + [f"text number {i}" for i in range(3000)] + [None, "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    size = check_shards(sharding.byte_shards(df, 8).collect(), texts, 8)
    # The two large groups have a shard each, and the others share the rest evenly.
    assert sorted(size)[-2:] == [200 * 201, 400 * 201] and max(sorted(size)[:6]) < 1.05 * sum(sorted(size)[:6]) / 6


def test_shards_on_odd_rows(odd):
    texts = [r.text for r in odd.collect()]
    check_shards(sharding.byte_shards(odd, 4).collect(), texts, 4)
    assert sharding.byte_shards(odd.limit(0)).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def insults(spark):
    """Half of the toxic documents of the held-out part write their words in disguise."""
    rng = random.Random(11)
    plain = ["the", "garden", "house", "street", "winter", "letter", "music", "river", "people", "morning", "stone", "paper", "sister", "market"]
    bad = ["stupid", "idiot", "moron", "pathetic"]
    disguise = {"stupid": "stup1d", "idiot": "1d10t", "moron": "m o r o n", "pathetic": "paaaathetic"}
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = int(i % 3 == 0)
        if toxic:
            for _ in range(4):
                w = rng.choice(bad)
                words.insert(rng.randrange(40), disguise[w] if zlib.crc32(str(i).encode()) % 4 == 2 and i % 2 else w)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs += [(9001, None), (9002, ""), (9002, ""), (None, "x" * 5000), (9003, "%%% ### 12345"), (9004, "a" * 300 + "1b" * 300)]
    labels += [(5, None), (None, 1), (3, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("toxic", F.lit(7)),
            spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:900]))


def test_toxicity_sees_through_disguise(insults):
    docs, labels, truth = insults
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert not any(r.predicted for r in rows if r.doc_id in (9001, 9002, 9003))


def test_toxicity_without_two_labels(insults):
    docs, labels, _ = insults
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    one_sided = {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()}
    assert len(one_sided) == 1 and one_sided.pop() < 0.01
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_restoring():
    import numpy as np

    counts = np.zeros(toxicity.WIDTH**3)
    for word in ["idiot", "clown", "the", "loser", "hello"] * 50:
        codes = [0, 0, *(toxicity._CODE[c] for c in word), 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[(a * toxicity.WIDTH + b) * toxicity.WIDTH + c] += 1
    restore = toxicity.Restorer(toxicity.character_model(counts)).restore
    assert restore("the 1d10t and the c|own") == "the idiot and the clown"
    assert restore("you l o s e r !") == "you loser !"
    assert restore("l.o.s.e.r") == "loser" and restore("looooser") == "loser"
    # Numbers, keys and signs at the end of a word are left alone.
    assert restore("hello the 555-6503 athe*** 24be64439e3e49cf46b2d7c90f3602a3d0b907ff1") == "hello the 555-6503 athe*** 24be64439e3e49cf46b2d7c90f3602a3d0b907ff1"


def test_held_out_quality(spark, sf):
    truth = {r.doc_id: r.toxic for r in read_table(spark, sf, "labels").collect()}
    rows = QUERIES["op10_toxicity"](spark, sf).collect()
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth) >= 0.85 * len(truth)


# --- pipeline ---------------------------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    flagged = {r.doc_id for r in QUERIES["op10_toxicity"](spark, sf).collect() if r.predicted}
    left = {i: t for i, t in texts.items() if i not in flagged}
    owner = roots({i: nearcopies.shingles(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if owner[i] == i}
    dirty = {r.doc_id for r in QUERIES["op3_decontamination"](spark, sf).collect() if r.contaminated}
    want = set(left) - dirty
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(rows) == want
    from detectlab.llm import bpe, secrets

    model, scanner = bpe.automaton(bpe.vocabulary_text()), secrets.SecretScanner(secrets.identifier_words(docs.where(F.col("doc_id").isin(list(want)))))
    for i, r in rows.items():
        text = secrets.redact(texts[i], scanner)
        assert b"".join(n.to_bytes(4, "little") for n in r.token_ids) == model.encode(text) and r.n_chars == len(text)


def test_stages_keep_the_columns(spark, sf):
    docs = read_table(spark, sf, "documents").limit(0).withColumn("hits", F.lit(1))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
