"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, all but letters becomes one blank, and n-grams of 1 to 3 signs are hashed into ``BUCKETS``. The
matrix of log-probabilities (buckets x languages) is broadcast; a batch of texts is scored by adding up its rows. The
score is the posterior of the best language among those learnt.

The model is fitted on a bounded sample: at most about ``MAX_PER_LANGUAGE`` documents of each language, those with the
smallest hashes of their ids; it reads their whole texts. Every document is scored over its whole text.

Nulls, ties, empties: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing was
learnt; languages with equal scores are taken in alphabetical order; repeated rows and null ids are scored like any other
(a null id is neither learnt from nor held out); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import crc_remainder

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
MAX_PER_LANGUAGE = 3000
UNKNOWN = "und"
#: Signs of a step: bounds the arrays of a batch, whatever the texts.
STEP_SIGNS = 1 << 20

_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Which code points are letters; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def signs(text: str | None) -> np.ndarray:
    """Letters in lower case and single blanks, one at each end; empty if there is no letter."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a letter ends its word
    blank = np.array([32], dtype=np.uint32)
    found = np.concatenate([blank, points[keep]])
    return found if found[-1] == 32 else np.concatenate([found, blank])


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of each n-gram of this order."""
    value = np.full(len(points) - order + 1, order, dtype=np.uint32)
    for k in range(order):
        value = (value ^ points[k : len(points) - order + 1 + k]) * _FACTORS[k]
        value ^= value >> np.uint32(15)
    return value & np.uint32(BUCKETS - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # BUCKETS x languages
    priors: np.ndarray


def _groups(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    group, held = [], 0
    for text in texts:
        group.append(signs(text))
        held += len(group[-1])
        if held >= STEP_SIGNS:
            yield group
            group, held = [], 0
    yield group


def log_likelihoods(group: list[np.ndarray], model: LanguageModel) -> np.ndarray:
    """Texts x languages. Texts are laid end to end; n-grams over a seam are left out."""
    lengths = np.array([len(p) for p in group])
    out = np.tile(model.priors, (len(group), 1)).astype(np.float64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    points = np.concatenate([group[i] for i in some])
    starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
    for order in ORDERS:
        rows = model.matrix[buckets(points, order)]
        for k in range(1, order):
            rows[np.maximum(starts[1:] - k, 0)] = 0
        out[some] += np.add.reduceat(rows, starts, axis=0, dtype=np.float64) if len(rows) > starts[-1] else _slow_sums(rows, starts)
    return out


def _slow_sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = [*starts[1:], len(rows)]
    return np.array([rows[s:e].sum(axis=0, dtype=np.float64) for s, e in zip(starts, ends, strict=True)])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from the rows of ``docs`` with a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    draw = F.pmod(F.xxhash64(id_col, F.lit("language")), F.lit(1 << 30))
    # A few rows, one a language: the share of its documents that makes the bound.
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0))
    keep = F.lit(False)
    for lang, n in sizes.items():
        below = min(1 << 30, int(MAX_PER_LANGUAGE / n * (1 << 30)))
        keep = keep | ((F.col(lang_col) == lang) & (draw < below))
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(number), BUCKETS), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = signs(text)
                for order in ORDERS:
                    if len(points) >= order:
                        total[number[lang]] += np.bincount(buckets(points, order), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], names=["l", "b", "n"]
        )

    sample = known.where(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    counts = np.zeros((BUCKETS, len(languages)))
    for lang, bucket, n in sums.collect():  # at most buckets x languages rows
        counts[bucket, lang] = n
    matrix = np.log((counts + 0.5) / (counts.sum(axis=0, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    shares = np.array([sizes[lang] for lang in languages], dtype=float)
    return LanguageModel(languages, matrix, np.log(shares / shares.sum()))


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict_column(df: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            names: list[str] = []
            scores: list[float] = []
            for group in _groups(texts.to_pylist()):
                if not model.languages:
                    names += [UNKNOWN] * len(group)
                    scores += [0.0] * len(group)
                    continue
                total = log_likelihoods(group, model)
                best = total.argmax(axis=1) if len(group) else np.zeros(0, dtype=int)
                top = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if len(group) else []
                for points, i, p in zip(group, best, top, strict=True):
                    names.append(model.languages[i] if len(points) else UNKNOWN)
                    scores.append(float(p) if len(points) else 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run(F.col(text_col))


def held_out(id_column: Column) -> Column:
    return F.coalesce(crc_remainder(id_column, 5) == 0, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; the languages of held-out rows are not read."""
    learnt = docs.where(crc_remainder(F.col(id_col), 5) != 0)
    model = fit(learnt, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), predict_column(docs, model, text_col).alias("__r"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "__r.*")


__all__ = ["LanguageModel", "fit", "held_out", "languages", "predict_column"]
