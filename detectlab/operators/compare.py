"""Comparing two runs: overall, by category, by technique, row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectlab.operators.rates import ratio
from detectlab.operators.scoring import ORDER, WEIGHT, many, tallies

KEY = ("payload_value", "category", "generator", "technique", "strategy")


def index_rows(results: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One row per result key; the last row wins. An aggregate, so repeated keys shrink before the shuffle."""
    last = F.max_by(F.struct("severity", "confidence"), F.struct(*order))
    return results.groupBy(*KEY).agg(last.alias("row")).select(
        *KEY, F.col("row.severity").alias("severity"), F.col("row.confidence").alias("confidence"))


def overall_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(*tallies(df)).select(
            *[F.col(c).alias(f"{c}_{tag}") for c in ("total", "pass", "fail", "error")],
            ratio(F.col("pass"), F.col("total")).alias(f"rate_{tag}"))

    return side(before, "a").crossJoin(F.broadcast(side(after, "b"))).withColumn(
        "delta", F.col("rate_b") - F.col("rate_a"))


def _sides(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both runs in one table; grouping treats nulls as equal, where a join would not."""
    return before.select(*columns, F.lit("a").alias("side")).unionByName(after.select(*columns, F.lit("b").alias("side")))


def _delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over both runs; a missing side counts as zeros."""
    weight = [WEIGHT] if WEIGHT in before.columns and WEIGHT in after.columns else []
    sides = _sides(before, after, [*keys, "severity", *weight])
    of = lambda side, more=F.lit(True): many(sides, (F.col("side") == side) & more)
    passed = F.col("severity") == "pass"
    both = sides.groupBy(*keys).agg(
        of("a").alias("total_a"), of("a", passed).alias("pass_a"), of("b").alias("total_b"), of("b", passed).alias("pass_b"))
    return both.withColumn("rate_a", ratio(F.col("pass_a"), F.col("total_a"))).withColumn(
        "rate_b", ratio(F.col("pass_b"), F.col("total_b"))).withColumn("delta", F.col("rate_b") - F.col("rate_a"))


def by_category_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Categories of either run; a missing side counts as zeros."""
    return _delta(before, after, ["category"])


def by_technique_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Only techniques whose rate changed, most lost first."""
    return _delta(before, after, ["generator", "technique"]).filter(F.col("delta") != 0).orderBy(
        "delta", "generator", "technique")


def _paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each result key with the last row of either run, ``a`` and ``b`` (null: the run has none).

    One exchange on the key and one aggregate after it: the key is nearly unique, so an aggregate before the exchange
    would sort every row and shrink nothing.
    """
    last = lambda side: F.max_by(
        F.struct("severity", "confidence"), F.when(F.col("side") == side, F.struct(*[c for c in ORDER]))).alias(side)
    columns = list(dict.fromkeys([*KEY, *ORDER, "severity", "confidence"]))
    return _sides(before, after, columns).repartition(*KEY).groupBy(*KEY).agg(last("a"), last("b"))


def row_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose severity changed (a missing side is ``absent``) or whose confidence moved by 0.01 or more."""
    return changed_rows(_paired(before, after))


def changed_rows(pairs: DataFrame) -> DataFrame:
    """The same of keys that already stand beside each other: the key, and structs ``a`` and ``b`` of severity and confidence."""
    absent = F.lit("absent")
    paired = pairs.select(
        *KEY, F.coalesce("a.severity", absent).alias("severity_a"), F.col("a.confidence").alias("confidence_a"),
        F.coalesce("b.severity", absent).alias("severity_b"), F.col("b.confidence").alias("confidence_b"))
    moved = F.round(F.col("confidence_b") - F.col("confidence_a"), 4)
    return paired.withColumn("confidence_delta", moved).filter(
        (F.col("severity_a") != F.col("severity_b")) | F.coalesce(F.abs("confidence_delta") >= 0.01, F.lit(False)))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went from caught to missed, and back."""
    return changes(row_diffs(before, after))


def changes(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn(
        "change",
        F.when((F.col("severity_a") == "pass") & (F.col("severity_b") == "fail"), "regression")
        .when((F.col("severity_a") == "fail") & (F.col("severity_b") == "pass"), "improvement"),
    ).filter(F.col("change").isNotNull())


def only_in(before: DataFrame, after: DataFrame) -> DataFrame:
    """Result keys that the second run no longer has."""
    return missing_rows(_paired(before, after))


def missing_rows(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a IS NOT NULL AND b IS NULL").select(
        *KEY, F.col("a.severity").alias("severity"), F.col("a.confidence").alias("confidence"))
