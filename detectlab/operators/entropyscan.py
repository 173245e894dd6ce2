"""High-entropy tokens in text, the modes that gate them, and probes of a detector's modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.entropy import shannon
from detectlab.functions.text import starts_in_order
from detectlab.operators.rates import pct

MODES = ("off", "gated", "assignment", "all")
GATE_WORDS = "api_key|apikey|api key|secret|token|password|passwd|credential|auth"
ASSIGNMENT = "[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*[\"']?$"
# Contexts a value is shown in, and the contexts each mode is expected to catch.
CONTEXTS = {"bare": "{value}", "gated": "api_key: {value}", "assignment": "SECRET_TOKEN={value}"}
EXPECTED = {"off": (), "gated": ("gated",), "assignment": ("assignment",), "all": ("bare", "gated", "assignment")}
TOKEN = r"""[^\s,;'"()\[\]{}=:]+"""


def high_entropy_tokens(
    df: DataFrame, keys: Sequence[str], text: str = "text", mode: str = "all",
    threshold: float = fixed.ENTROPY_THRESHOLD, min_length: int = fixed.ENTROPY_MIN_LENGTH,
) -> DataFrame:
    """One row per token long and varied enough to be a secret: keys, token, start, entropy.

    ``gated`` needs a secret keyword within 80 characters, ``assignment`` a ``NAME=`` that ends within the 60 characters
    before the token. Stays in one narrow stage.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    source = df.filter(F.lit(mode != "off"))
    # Only runs that are long enough are looked for, so short words cost nothing after the first pass.
    pattern = TOKEN[:-1] + f"{{{min_length},}}"
    matches = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    rows = source.select(*keys, F.col(text).alias("__text"), matches.alias("__m")).filter(F.size("__m") > 0).select(
        *keys, "__text", F.inline(F.arrays_zip(
            F.col("__m").alias("token"),
            starts_in_order(F.col("__text"), F.split("__text", pattern), F.col("__m")).alias("start"))))
    rows = rows.withColumn("entropy", shannon(F.col("token"))).filter(F.col("entropy") > threshold)
    if mode == "gated":
        begin = F.greatest(F.col("start") - fixed.GATE_WINDOW, F.lit(1))
        end = F.col("start") + F.length("token") + fixed.GATE_WINDOW
        rows = rows.filter(F.lower(F.substring(F.col("__text"), begin, end - begin)).rlike(GATE_WORDS))
    if mode == "assignment":
        begin = F.greatest(F.col("start") - fixed.ASSIGNMENT_WINDOW, F.lit(1))
        rows = rows.filter(F.substring(F.col("__text"), begin, F.col("start") - begin).rlike(ASSIGNMENT))
    return rows.drop("__text")


def has_secret(text: Column, mode: str, threshold: float, min_length: int = fixed.ENTROPY_MIN_LENGTH) -> Column:
    """Whether a text holds a token that a mode reports; for short texts, where the windows cover everything."""
    tokens = F.filter(F.split(text, fixed.ENTROPY_DELIMITERS), lambda t: F.length(t) >= min_length)
    hit = F.exists(tokens, lambda t: shannon(t) > threshold)
    if mode == "off":
        return F.lit(False)
    if mode == "gated":
        return hit & F.lower(text).rlike(GATE_WORDS)
    if mode == "assignment":
        return hit & text.rlike(r"[A-Za-z_][A-Za-z0-9_]*\s*=\s*[\"']?[^\s,;'\"()\[\]{}=:]{" + str(min_length) + ",}")
    return hit


def context_probes(values: DataFrame, value: str = "value") -> DataFrame:
    """Every value bare, beside a keyword, and in an assignment."""
    return values.select("*", F.inline(F.array(*[
        F.struct(F.lit(c).alias("context"), F.replace(F.lit(t), F.lit("{value}"), F.col(value)).alias("text"))
        for c, t in CONTEXTS.items()])))


def context_report(values: DataFrame, mode: str, threshold: float, value: str = "value") -> DataFrame:
    """Tested and detected per category and context, one column pair per context."""
    probed = context_probes(values, value).withColumn("detected", has_secret(F.col("text"), mode, threshold))
    return probed.groupBy("category").agg(*[
        a for c in CONTEXTS for a in (
            F.count_if(F.col("context") == c).alias(f"{c}_tested"),
            F.count_if((F.col("context") == c) & F.col("detected")).alias(f"{c}_detected"))])


def mode_coverage(values: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Share of the probes each mode is expected to catch that it does catch. All modes in one pass."""
    probed = context_probes(values, value).select("context", F.inline(F.array(*[
        F.struct(F.lit(m).alias("mode"), has_secret(F.col("text"), m, threshold).alias("detected"),
                 F.col("context").isin(*EXPECTED[m]).alias("expected") if EXPECTED[m] else F.lit(False).alias("expected"))
        for m in MODES])))
    return probed.groupBy("mode").agg(
        F.count_if("expected").alias("total_expected"),
        F.count_if(F.col("expected") & F.col("detected")).alias("detected_expected"),
    ).withColumn("coverage_pct", pct(F.col("detected_expected"), F.col("total_expected")))


def defeat_counts(variants: DataFrame, threshold: float, text: str = "variant", mode: str = "all") -> DataFrame:
    """Per technique how often the entropy scan misses the variant, most first."""
    return variants.groupBy("technique").agg(
        F.count("*").alias("tested"), F.count_if(~has_secret(F.col(text), mode, threshold)).alias("defeated"),
    ).orderBy(F.desc("defeated"), "technique")
