"""Toxicity by a noisy channel: restore disguised words with a character model, then score the restored text.

1. A character trigram model is counted over all words of all documents.
2. Strings that look disguised (symbols or digits beside letters, letters and symbols spelt out with separators, a letter
   three or more times in a row) become a lattice: a symbol is one of the letters that it stands for or a break, a repeated
   letter is kept or skipped, a separator between single letters is skipped or a break. Viterbi search finds the likeliest
   reading. Long strings are cut where their words are joined; none is left out for its length but keys and numbers.
3. Words and word beginnings of the restored text that tell toxic from other documents get a weight, and a logistic
   regression on how many there are, how strong and how dense gives the score.

What labels teach is fitted on a bounded sample of labelled rows: at most ``MAX_TOXIC`` with label 1 and ``MAX_OTHER``
with label 0, the first by a hash of their id; counts are weighted back to the whole. The regression is fitted on documents whose
words did not choose the weights (two halves, each scored with the words of the other).

Nulls, ties, empties: null and empty texts get the score of a text without words; rows are scored alone, so repeated rows,
repeated and null ids need nothing of their own; an id with several labels takes the largest, null labels are left out;
without rows of both labels every score is the smoothed share of label 1; other columns pass through or are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.llm.common import crc_remainder, materialise

MAX_TOXIC, MAX_OTHER = 4000, 8000
MAX_FEATURES = 4096
LEAST_DOCS, LEAST_Z = 4, 4.0
PREFIXES = range(3, 9)
THRESHOLD = 0.3
CACHE_WORDS = 60_000

# The alphabet of the character model: break, a-z, the lower-case letters of Latin-1, any other letter.
_LETTERS = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
OTHER, WIDTH = len(_LETTERS), 64
_CODE = {c: i for i, c in enumerate(_LETTERS)}
_CODES = np.zeros(0x250, dtype=np.int32)
for _c in range(0x250):
    _CODES[_c] = _CODE.get(chr(_c), OTHER if chr(_c).isalpha() else 0)

#: Letters that a sign stands for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i"}
_SIGN_COST, _BREAK_COST, _KEEP_COST, _SKIP_COST = -0.7, -6.0, -2.0, -0.2
_EDGE_COST = -3.0  # a break at the edge of a word, where signs are mostly what they seem
_PUNCTUATION = frozenset("!|+(*")
_SIGN_SET = re.escape("".join(SIGNS))
_LETTER = r"[^\W\d_]"
_PLAIN_SIGNS = re.escape("".join(c for c in SIGNS if c not in _PUNCTUATION))
# Letters one by one, signs among them, with up to three separators between two of them.
_APART = r"[ \t\n\r.\-_*/,]{1,3}"
_SPELT_OUT = re.compile(
    rf"(?<![^\W_])(?:{_LETTER}|[{_PLAIN_SIGNS}]){_APART}(?:(?:{_LETTER}|[{_SIGN_SET}]){_APART}){{2,}}"
    rf"(?:{_LETTER}|[{_PLAIN_SIGNS}])(?![^\W_])")
_TOKEN = re.compile(r"\S+")
_INNER = re.compile(  # a letter and a sign with nothing but separators between, or a letter three times in a row
    rf"{_LETTER}[*._\-]*[{_SIGN_SET}]|[{_SIGN_SET}][*._\-]*{_LETTER}|{_LETTER}\*+{_LETTER}|({_LETTER})\1\1"
)
_PIECES = re.compile(rf"(?:\w|[{_SIGN_SET}.\-_*])+")
_JOINS = re.compile(r"(?<=[^\s.\-_*]{2})[.\-_*]+|[.\-_*]+(?=[^\s.\-_*]{2})")
_LONG_RUN = re.compile(rf"({_LETTER})\1{{3,}}")
_NOT_LETTERS = bytes(b if (97 <= b <= 122 or b >= 128) else 32 for b in range(256))
#: Longer strings are cut into pieces, at what joins their words, before they are decoded.
_LONGEST = 40
#: Hexadecimal digits are a key, not a disguised word.
_KEY = re.compile(r"[0-9a-f]{16,}")


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over the whole table. Each task adds up its texts, then the sums are added by trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH**3, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
                    codes = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], OTHER)
                    codes = np.concatenate([[0, 0], codes, [0]])
                    total += np.bincount((codes[:-2] * WIDTH + codes[1:-1]) * WIDTH + codes[2:], minlength=WIDTH**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    sums = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(WIDTH**3)
    for k, n in sums.collect():  # at most one row a trigram of the alphabet
        counts[k] = n
    return counts


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams backed by bigrams, backed by letters."""
    three = counts.reshape(WIDTH, WIDTH, WIDTH)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    letters = (one + 1) / (one.sum() + WIDTH)
    pairs = (two + 5 * letters[None, :]) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * pairs[None, :, :]) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


_KIND = bytes(97 if (97 <= b <= 122 or b >= 128) else 49 if chr(b) in SIGNS else 35 for b in range(256))
_SPELT_KIND = bytes(97 if (97 <= b <= 122 or b >= 128 or chr(b) in SIGNS) else 32 if b in b" \t\n\r.-_*/," else 35 for b in range(256))
_SPELT_GATE = re.compile(rb"a {1,3}a {1,3}a {1,3}a")
_TRIPLE = re.compile(r"([^\x00-\x7f])\1\1")


def disguised(text: str) -> tuple[bool, bool]:
    """Whether ``text``, in lower case, may hold words spelt out, and other disguised words; true wherever there are any."""
    data = text.encode()
    # A character is one byte without the bytes that continue it.
    spelt = bool(_SPELT_GATE.search(data.translate(_SPELT_KIND, bytes(range(128, 192)))))
    kinds = data.translate(_KIND, b"._-*")
    if b"a1" in kinds or b"1a" in kinds or b"*" in data:
        return spelt, True
    if not data.isascii() and ("€" in text or "¡" in text or _TRIPLE.search(text)):
        return spelt, True
    raw = np.frombuffer(data, dtype=np.uint8)
    same = raw[1:] == raw[:-1]
    return spelt, bool((same[1:] & same[:-1] & (raw[2:] >= 97)).any())


class Restorer:
    """Viterbi decoding of disguised strings, in lower case."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()
        self.cache: dict[tuple[str, bool], str] = {}

    def restore(self, text: str) -> str:
        """``text`` in lower case, disguised strings in their likeliest reading."""
        return self.decoded(text, *disguised(text))

    def decoded(self, text: str, spelt: bool = True, other: bool = True) -> str:
        """``restore`` without the gate."""
        if spelt:
            text = _SPELT_OUT.sub(lambda m: self._reading(m.group(), True), text)
        return _TOKEN.sub(lambda m: self._token(m.group()), text) if other else text

    def _token(self, word: str) -> str:
        # No word begins or ends in the same letter three times, so such signs are none.
        start, stop = 0, len(word)
        while stop - start >= 3 and not word[start].isalnum() and word[start] == word[start + 1] == word[start + 2]:
            start = stop - len(word[start:stop].lstrip(word[start]))
        while stop - start >= 3 and not word[stop - 1].isalnum() and word[stop - 1] == word[stop - 2] == word[stop - 3]:
            stop = start + len(word[start:stop].rstrip(word[stop - 1]))
        return word[:start] + self._core(word[start:stop]) + word[stop:]

    def _core(self, word: str) -> str:
        if not _INNER.search(word):
            return word
        if len(word) <= _LONGEST:
            return self._reading(word)
        return _PIECES.sub(lambda m: self._piece(m.group()), word)

    def _piece(self, word: str) -> str:
        """A piece of a long string; pieces that are long themselves fall apart where their words are joined."""
        word = _LONG_RUN.sub(r"\1\1\1", word)
        if len(word) <= _LONGEST:
            return self._reading(word) if _INNER.search(word) else word
        parts, at = [], 0
        for join in [*_JOINS.finditer(word), None]:
            part = word[at : join.start() if join else len(word)]
            parts.append(self._reading(part) if _INNER.search(part) else part)
            if join:
                parts.append(join.group())
                at = join.end()
        return "".join(parts)

    def _reading(self, word: str, spelt: bool = False) -> str:
        known = self.cache.get((word, spelt))
        if known is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            short = _LONG_RUN.sub(r"\1\1\1", word)
            letters = sum(c.isalpha() for c in short)
            told = sum(c.isalnum() or c in SIGNS for c in short)
            # Numbers and keys are no disguised words.
            plain = 3 * letters < told or spelt and 2 * letters < told
            key = not spelt and _KEY.fullmatch(short)
            known = word if plain or key else self._decode(short, spelt)
            if len(word) <= 200:
                self.cache[word, spelt] = known
        return known

    def _options(self, word: str, spelt: bool) -> list[list[tuple[str, float]]]:
        """For each sign of the word what it may be: a letter, a break, or nothing."""
        out, start, stop = [], 0, len(word)
        while start < stop and not (word[start].isalnum() or word[start] in SIGNS):
            start += 1
        while stop > start and not (word[stop - 1].isalnum() or word[stop - 1] in SIGNS):
            stop -= 1
        first = next((i for i in range(start, stop) if word[i].isalpha()), stop)
        last = next((i for i in range(stop - 1, start - 1, -1) if word[i].isalpha()), start)
        for i in range(start, stop):
            c = word[i]
            if c.isalpha():
                run = i - len(word[start:i].rstrip(c)) - start
                again = i > start and word[i - 1] == c and (run >= 2 or word[i + 1 : i + 2] == c)
                out.append([(c, _KEEP_COST), ("", _SKIP_COST)] if again else [(c, 0.0)])
            elif c in SIGNS:
                inside = first < i < last
                cost = _BREAK_COST if inside else _SIGN_COST if c in _PUNCTUATION else _EDGE_COST
                out.append([*((x, _SIGN_COST) for x in SIGNS[c]), (" ", cost)])
            elif spelt:
                out.append([("", 0.0), (" ", _SKIP_COST)])
            else:
                out.append([("", _SKIP_COST), (" ", _KEEP_COST)])
        return out

    def _decode(self, word: str, spelt: bool = False) -> str:
        model, code = self.model, _CODE
        places, first, a, b = self._options(word, spelt), 0, 0, 0
        # Letters before the first choice are as they are.
        while first < len(places) and len(places[first]) == 1:
            a, b = b, code.get(places[first][0][0], OTHER)
            first += 1
        best: dict[tuple[int, int], tuple[float, str]] = {(a, b): (0.0, "".join(o[0][0] for o in places[:first]))}
        for options in places[first:]:
            step: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, read) in best.items():
                for letter, cost in options:
                    if letter:
                        c = code.get(letter, OTHER)
                        state, value, path = (b, c), score + cost + model[(a * WIDTH + b) * WIDTH + c], read + letter
                    else:
                        state, value, path = (a, b), score + cost, read
                    if state not in step or step[state] < (value, path):
                        step[state] = (value, path)
            best = step
        return max((score + model[(a * WIDTH + b) * WIDTH], read) for (a, b), (score, read) in best.items())[1]


@dataclass
class ToxicModel:
    characters: np.ndarray
    weights: dict[bytes, float] = field(default_factory=dict)
    coefficients: np.ndarray | None = None  # None: ``share`` is every score
    share: float = 0.0


def _words(text: str, restorer: Restorer) -> list[bytes]:
    """Words of the restored text. Byte classes are those of UTF-8: letters beyond ASCII are kept whole."""
    return restorer.restore(text.lower()).encode().translate(_NOT_LETTERS).split()


def _features(word: bytes) -> list[bytes]:
    """The word as such and its beginnings; an end is marked by a blank."""
    return [word + b" ", *(word[:n] for n in PREFIXES if n <= len(word))]


class Scorer:
    """Document numbers for the regression, and the score."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.restorer = Restorer(model.characters)
        self.cache: dict[bytes, float] = {}

    def _weight(self, word: bytes) -> float:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        get = self.model.weights.get
        value = self.cache[word] = max((get(f, 0.0) for f in _features(word)), default=0.0)
        return value

    def numbers(self, text: str | None) -> list[float]:
        words = _words(text, self.restorer) if text else []
        get = self.cache.get
        found = []
        for word in words:
            weight = get(word)
            if weight is None:
                weight = self._weight(word)
            if weight:
                found.append(weight)
        n, hits, total = len(words), len(found), sum(found)
        return [1.0, np.log1p(hits), np.log1p(total), max(found, default=0.0), np.log1p(n), 100.0 * hits / (n + 20),
                float(hits >= 2), np.sqrt(total / (n + 20))]

    def score(self, text: str | None) -> float:
        if self.model.coefficients is None:
            return self.model.share
        return float(_logistic(np.array(self.numbers(text)) @ self.model.coefficients))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's steps; the first column is the constant."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, beta = x / scale, np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = _logistic(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[int, float]]:
    """(id, y, text) of the bounded sample, written; how many rows of each label one of them stands for."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")))
    ids, stands = None, {}
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    for y, most in ((1, MAX_TOXIC), (0, MAX_OTHER)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.union(part)
        stands[y] = max(1.0, totals.get(y, 0) / most)
    # The broadcast is bounded by the two limits.
    ids = F.broadcast(materialise(ids, "sample-ids"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id")
    # One text of an id, so that the rows are bounded as the ids are; chosen in each task first, by its hash.
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    return materialise(one.select("doc_id", "y", "text"), "sample"), stands


def _select(counts: pd.DataFrame, halves: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> dict[bytes, float]:
    """Log-odds of the features that occur clearly more often in documents with label 1 of these halves."""
    a = sum(counts[f"n1{h}"] for h in halves).to_numpy(float)
    b = sum(counts[f"n0{h}"] for h in halves).to_numpy(float)
    size1, size0 = (sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0))
    odds = np.log((a + 0.5) / (size1 - a + 0.5)) - np.log((b + 0.5) / (size0 - b + 0.5))
    spread = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    good = np.flatnonzero((a >= LEAST_DOCS) & (odds / spread >= LEAST_Z))
    names = counts["f"].to_numpy()
    ranked = sorted(good, key=lambda i: (-odds[i] / spread[i], names[i]))[:MAX_FEATURES]
    return {bytes(names[i]): float(odds[i]) for i in ranked}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """``labels`` (doc_id, toxic) are those to learn from."""
    characters = character_model(character_counts(docs, text_col))
    sample, stands = _sample(docs, labels, id_col, text_col)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sample = sample.withColumn("half", half)
    sizes = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
    n1, n0 = (sum(n for (y, _), n in sizes.items() if y == label) for label in (1, 0))
    if not n1 or not n0:
        return ToxicModel(characters, share=(n1 + 0.5) / (n1 + n0 + 1) if n1 + n0 else 0.0)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(characters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen = Restorer(shared.value), Counter()
        for batch in batches:
            for y, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                features = {f for w in set(_words(text or "", restorer)) for f in _features(w)}
                seen.update((f, 2 * y + h) for f in features)
            if len(seen) > 1_000_000:
                yield _counted(seen)
                seen.clear()
        yield _counted(seen)

    kinds = [F.sum(F.when(F.col("k") == 2 * y + h, F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (1, 0) for h in (0, 1)]
    cores = spark.sparkContext.defaultParallelism
    sample = sample.repartition(4 * cores, "doc_id")
    counted = sample.select("y", "half", "text").mapInArrow(count, "f binary, k int, n long").groupBy("f").agg(*kinds)
    # Rows that can be chosen at all, the likeliest first; the bound keeps what the driver gets small.
    strong = (counted.where(F.expr(f"n10 + n11 >= {LEAST_DOCS} AND (n10 + n11) * {n0} > 2 * (n00 + n01) * {n1}"))
              .withColumn("lift", F.expr("(n10 + n11) / sqrt(n00 + n01 + 1)")))
    counts = strong.orderBy(F.desc("lift"), "f").limit(8 * MAX_FEATURES).drop("lift").toPandas()
    by_half = {h: _select(counts, (1 - h,), sizes) for h in (0, 1)}
    shared_halves = spark.sparkContext.broadcast(by_half)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {h: Scorer(ToxicModel(shared.value, w)) for h, w in shared_halves.value.items()}
        for batch in batches:
            ys, halves, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = [scorers[h].numbers(t) for h, t in zip(halves, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])

    # One short row for each row of the bounded sample.
    measured = sample.select("y", "half", "text").mapInArrow(measure, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in measured], dtype=float)
    x = np.array([r["x"] for r in measured])
    weight = np.where(y == 1, stands[1], stands[0])
    return ToxicModel(characters, _select(counts, (0, 1), sizes), _regression(x, y, weight))


def _counted(seen: Counter) -> pa.RecordBatch:
    keys = list(seen)
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in keys], pa.binary()), pa.array([k for _, k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())],
        names=["f", "k", "n"],
    )


def score_column(df: DataFrame, model: ToxicModel, text_col: str = "text") -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array([scorer.score(t.as_py()) for t in texts], type=pa.float64())

    return run(F.col(text_col))


def held_out(id_column: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(crc_remainder(id_column, 4) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; labels of held-out ids are not read."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, model, text_col).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a score under the threshold; all their columns stay."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), id_col, text_col)
    return docs.where(score_column(docs, model, text_col) < THRESHOLD)
