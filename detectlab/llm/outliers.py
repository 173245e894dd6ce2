"""Quality rules: fixed limits, and robust multivariate outliers among documents of the same language and source.

Each text gives counts (words, symbols, repeated lines and words, capitals, marks), and a vector of their transformed
shares. For each language and source the minimum-covariance-determinant estimate is found by concentration steps: the
share ``CORE`` of the rows that is nearest by Mahalanobis distance gives the next mean and covariance. A step is one
aggregate over all rows: distances are counted in narrow classes, with the sums of each class, and the classes up to the
wanted share are added up. So no group is collected or sorted, and a hot one is a few partial sums in each task. Rows whose
distance is over ``CUTOFF`` are rejected.

Shares have a floor, and the covariance gets ``FLOOR`` squared on its diagonal: most texts have no repeats at all, and the
spread of the nearest rows would otherwise be nothing.

Groups of fewer than ``LEAST_ROWS`` rows are pooled with the other such groups of their language, and those pools that are
still too small with each other; what remains too small is judged by the fixed limits alone.

Nulls, ties, empties: a null or empty text has no words and fails; null languages and sources are values of their own;
rows are judged alone, so repeated rows, repeated and null ids change the estimates but not the shape of the result; rows
of equal distance are in the core together; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import map_texts, materialise

LEAST_WORDS, MOST_REPEATED = 50, 50
CORE, STEPS, LEAST_ROWS = 0.75, 5, 50
FLOOR, CUTOFF = 0.1, 100.0
SIZE = 7

_BLANKS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOLS)

COUNTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("x", T.ArrayType(T.DoubleType()))]
)


def _repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more; different words."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(ids) < 3:
        return 0, len(number)
    base = len(number)
    if base < 1 << 21:
        keys = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, base
    again = np.isin(keys, twice)
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum()), base


def counts(text: str | None) -> tuple:
    text = text or ""
    data = text.encode()
    having = lambda some: len(data) - len(data.translate(None, some))
    words = data.split()
    n, chars = len(words), len(text) - having(_BLANKS)
    symbols = having(_SYMBOLS)
    seen: set[bytes] = set()
    lines = again = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    repeated, different = _repeated_words(words)
    shares = (
        (chars + 5) / (n + 1), symbols / (chars + 50) + 0.03, again / (lines + 5) + 0.2, repeated / (n + 50) + 0.2,
        having(_CAPITALS) / (chars + 50) + 0.03, having(_MARKS) / (chars + 50) + 0.03, (different + 10) / (n + 10) + 0.2,
    )
    return n, chars, symbols, again, repeated, [float(v) for v in np.log(shares)]


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` under ``mean`` and ``precision`` (row by row)."""
    z = [F.col("x")[i] - F.col("mean")[i] for i in range(SIZE)]
    terms = [z[i] * z[j] * F.col("precision")[i * SIZE + j] * (1 if i == j else 2) for i in range(SIZE) for j in range(i, SIZE)]
    return sum(terms[1:], terms[0])


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and quartile ranges as spreads."""
    quarters = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 400).alias(f"q{i}") for i in range(SIZE)]
    found = rows.groupBy("key").agg(*quarters, F.count("*").alias("total"))
    spread = [(F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.35 + F.lit(FLOOR) for i in range(SIZE)]
    precision = [1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(SIZE) for j in range(SIZE)]
    return found.select("key", "total", F.array([F.col(f"q{i}")[1] for i in range(SIZE)]).alias("mean"), F.array(precision).alias("precision"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _inverse(covariances: pa.Array) -> pa.Array:
    """Of each group's covariance, row by row: one small matrix a group."""
    out = []
    for flat in covariances.to_pylist():
        matrix = np.array(flat).reshape(SIZE, SIZE) + FLOOR**2 * np.eye(SIZE)
        out.append(np.linalg.inv(matrix).ravel())
    return pa.array(out, type=pa.list_(pa.float64()))


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: (key, total, mean, precision) from the rows nearest to the last estimate."""
    near = rows.join(model, "key").withColumn("class", F.floor(32 * F.log1p(F.greatest(_distance(), F.lit(0.0)))).cast("int"))
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    # Sums of deviations from the last mean: large common parts would cost digits.
    z = [F.col("x")[i] - F.col("mean")[i] for i in range(SIZE)]
    sums = [F.sum(z[i]).alias(f"s{i}") for i in range(SIZE)] + [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]
    classes = near.groupBy("key", "class").agg(F.count("*").alias("n"), F.first("total").alias("total"), F.first("mean").alias("mean"), *sums)
    before = F.sum("n").over(Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    core = classes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < F.ceil(F.lit(CORE) * F.col("total")))
    names = [f"s{i}" for i in range(SIZE)] + [f"p{i}_{j}" for i, j in pairs]
    total = core.groupBy("key").agg(F.sum("n").alias("n"), F.first("total").alias("total"), F.first("mean").alias("mean"), *[F.sum(c).alias(c) for c in names])
    shift = [F.col(f"s{i}") / F.col("n") for i in range(SIZE)]
    cell = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}") / F.col("n") - shift[i] * shift[j]
    return total.select(
        "key", "total", F.array([F.col("mean")[i] + shift[i] for i in range(SIZE)]).alias("mean"),
        _inverse(F.array([cell(i, j) for i in range(SIZE) for j in range(SIZE)])).alias("precision"),
    )


def _keys(rows: DataFrame) -> DataFrame:
    """(lang, source) -> the group that it is judged in; null if even the last pool is too small."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < LEAST_ROWS
    in_lang = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang"))
    sizes = sizes.withColumn("pool", F.when(small, in_lang))
    rest = sizes.where(F.col("pool") < LEAST_ROWS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rest"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    key = (F.when(~small, F.concat(name("lang"), F.lit("\x01"), name("source")))
           .when(F.col("pool") >= LEAST_ROWS, name("lang")).when(F.col("rest") >= LEAST_ROWS, F.lit("")))
    return sizes.crossJoin(F.broadcast(rest)).select("lang", "source", key.alias("key"))  # rest: one row


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) for every row.

    ``distance`` is the squared robust distance; null for rows that fail the limits or have no group.
    """
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                        map_texts(lambda: counts, COUNTS)(F.col(text_col)).alias("__r"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = materialise(taken.select("doc_id", "lang", "source", "__r.*").withColumn("base_failed", failed), "counts")
    passed = rows.where("NOT base_failed")
    keys = materialise(_keys(passed), "keys")
    same = passed["lang"].eqNullSafe(keys["lang"]) & passed["source"].eqNullSafe(keys["source"])
    fit_rows = materialise(passed.join(keys, same).where("key IS NOT NULL").select("key", "x"), "vectors")
    model = materialise(_start(fit_rows), "estimates")
    for _ in range(STEPS):
        model = materialise(_concentrate(fit_rows, model), "estimates")
    keyed = keys.join(model, "key")
    same = rows["lang"].eqNullSafe(keyed["lang"]) & rows["source"].eqNullSafe(keyed["source"])
    distance = F.when(~F.col("base_failed"), _distance())
    return rows.join(keyed, same, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= CUTOFF)).alias("kept"), distance.alias("distance"),
    )
