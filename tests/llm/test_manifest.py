"""The Merkle manifest against a recursive brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from detectlab.llm import merkle
from detectlab.llm.queries import QUERIES
from detectlab.session import read_table

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, arity):
    """The last digest, and for each leaf the digests (left, right) of every level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, i in enumerate(at):
            run = i // arity * arity
            paths[leaf].append((digests[run:i], digests[i + 1 : run + arity]))
            at[leaf] = i // arity
        digests = [h(*digests[i : i + arity]) for i in range(0, len(digests), arity)]
    return digests[0], paths


def brute(rows, arity=16):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], []
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        top, paths = tree([leaf_of(r) for r in by_source[s]], arity)
        subroots.append(top)
        inner.append(paths)
    if not subroots:
        return Counter()
    root, outer = tree(subroots, arity)
    out = Counter()
    for s, top, paths, above in zip(order, subroots, inner, outer, strict=True):
        for r, path in zip(by_source[s], paths, strict=True):
            full = path + above
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            digest = leaf_of((*r[:4], r[4].translate(LOWER))) if bad else leaf_of(r)
            for left, right in full:
                digest = h(*left, digest, *right)
            proof = h(*(d for left, right in full for d in left + right))
            out[r[0], leaf_of(r), top, root, proof, digest, digest == root] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    want = brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert result(QUERIES["op12_merkle_manifest"](spark, sf)) == want


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_trees_of_any_size(spark, arity):
    rng = random.Random(arity)
    rows = []
    for source, n in (("hot", 300), ("a", 1), ("b", 16), ("c", 17), ("é", 2), ("Z", 33), (None, 5), ("", 1)):
        rows += [(rng.randrange(1000), source, rng.choice(["en", None]), rng.choice([None, 7]), rng.choice([None, "", "Text É x", "plain"])) for _ in range(n)]
    rows += [(None, "b", None, None, None), (None, None, "x", 1, "A"), (5, "c", "x", 1, "A"), (5, "c", "x", 1, "A")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("tree", "node", "at", "n", "leaf", "root", "__slice")])
    assert result(merkle.verification(df.repartition(5), arity=arity)) == brute(rows, arity)


def test_many_sources_and_none(spark):
    rows = [(i, f"s{i % 40}", "en", i, f"Text {i}") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(merkle.verification(df)) == brute(rows)
    assert result(merkle.verification(df.where("doc_id = 3"))) == brute(rows[3:4])
    assert result(merkle.verification(df.limit(0))) == Counter()
