"""Run log: de-duplication, pairing, baselines, trends, technique history and what to run next.

A run log has run_seq (append order), ts, type, scanner_label, tool, archive_file, total, pass, fail, pass_rate,
fp_rate and technique_success_rates (a map).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectlab.operators.rates import previous_in_group

# Prior bypass probability per family, for families and techniques the transforms give.
SEED_WEIGHTS = {
    "unicode_encoding": 0.82, "unicode_whitespace": 0.85, "bidirectional": 0.76, "soft_hyphen": 0.68, "encoding": 0.70,
    "encoding_chains": 0.78, "delimiter": 0.55, "splitting": 0.60, "structural": 0.58, "leetspeak": 0.50,
    "regional_digits": 0.65, "morse_code": 0.65, "context_injection": 0.40, "entropy_evasion": 0.75,
}
TECHNIQUE_SEEDS = {
    "unicode_nbsp": 0.85, "unicode_en_space": 0.83, "unicode_em_space": 0.82, "unicode_thin_space": 0.84,
    "unicode_figure_space": 0.80, "unicode_narrow_nbsp": 0.84, "unicode_ideographic_space": 0.79,
    "unicode_mixed_spaces": 0.82, "zero_width_zwsp": 0.85, "zero_width_zwj": 0.83, "zero_width_zwnj": 0.83,
    "homoglyph_substitution": 0.82, "fullwidth_digits": 0.74, "base64_of_rot13": 0.78, "rot13_of_base64": 0.74,
    "html_entity_hex": 0.71, "html_entity_decimal": 0.69, "regional_arabic_indic": 0.68, "regional_devanagari": 0.65,
    "regional_thai": 0.65, "morse_space_sep": 0.65, "morse_slash_sep": 0.60, "double_url_encoding": 0.72,
    "base64_standard": 0.58, "rot13": 0.42, "reversed_full": 0.48,
}
NEUTRAL = 0.5


def scan_label(column: str = "scanner_label") -> Column:
    """Label as file names carry it: letters, digits, ``-_.``, at most 40 characters."""
    cleaned = F.substring(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "[^A-Za-z0-9._-]", "_"), 1, 40)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unlabelled"))


def run_type() -> Column:
    """A log line without a type is a scan."""
    return F.coalesce(F.col("type"), F.lit("scan"))


def dedupe_runs(runs: DataFrame) -> DataFrame:
    """Lines of the same scan write kept once, the first; lines without an archive are all kept. By timestamp."""
    key = ["archive_file", "scanner_label", "tool", "total", "pass", "fail", "pass_rate"]
    named = runs.filter(F.coalesce(F.col("archive_file"), F.lit("")) != "").fillna("", ["scanner_label", "tool"])
    loose = runs.filter(F.coalesce(F.col("archive_file"), F.lit("")) == "")
    rest = [c for c in runs.columns if c not in key and c != "run_seq"]
    kept = named.groupBy(*key).agg(F.min("run_seq").alias("run_seq"), *[F.min_by(c, "run_seq").alias(c) for c in rest])
    return kept.select(*runs.columns).unionByName(loose).orderBy("ts", "run_seq")


def latest_runs(runs: DataFrame, kind: str, n: int) -> DataFrame:
    return runs.filter(run_type() == kind).orderBy(F.desc("run_seq")).limit(n)


def dashboard_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """Newest first, with a run id made of the timestamp."""
    return latest_runs(runs, "scan", n).withColumn("run_id", F.date_format("ts", "'R-'yyyyMMdd'T'HHmmss"))


def trend(runs: DataFrame, kind: str, n: int, label: str | None = None) -> DataFrame:
    """The last n runs, oldest first, with the rate that belongs to the type."""
    chosen = runs if label is None else runs.filter(F.col("scanner_label") == label)
    rate = F.col("fp_rate") if kind == "falsepos" else F.col("pass_rate")
    return latest_runs(chosen, kind, n).select(
        "run_seq", "ts", F.date_format("ts", "MM-dd").alias("day"), "scanner_label", rate.alias("rate")).orderBy("run_seq")


def trend_by_label(runs: DataFrame, kind: str, n: int) -> DataFrame:
    """The last n runs of every label; only n rows per label and task are shuffled."""
    w = Window.partitionBy("scanner_label").orderBy(F.desc("run_seq"))
    rate = F.col("fp_rate") if kind == "falsepos" else F.col("pass_rate")
    return runs.filter(run_type() == kind).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select(
        "run_seq", "scanner_label", rate.alias("rate"), "rn")


def pair_with_false_positives(runs: DataFrame) -> DataFrame:
    """Each scan with the latest false-positive run of its label or its tool, by log order.

    The either-or match is two equi-joins against one row per label and one per tool; the later of the two wins.
    """
    scans, fps = runs.filter(run_type() == "scan"), runs.filter(run_type() == "falsepos")
    latest = F.max(F.struct("run_seq", "fp_rate"))
    by_label = fps.filter(F.coalesce(F.col("scanner_label"), F.lit("")) != "").groupBy("scanner_label").agg(
        latest.alias("of_label"))
    by_tool = fps.filter(F.coalesce(F.col("tool"), F.lit("")) != "").groupBy("tool").agg(latest.alias("of_tool"))
    best = F.greatest(F.coalesce("of_label", "of_tool"), F.coalesce("of_tool", "of_label"))
    return scans.join(by_label, "scanner_label", "left").join(by_tool, "tool", "left").withColumn("__fp", best).select(
        "run_seq", "scanner_label", "tool", "pass_rate", F.col("__fp.run_seq").alias("fp_run_seq"),
        F.col("__fp.fp_rate").alias("fp_rate"))


def automatic_baseline(runs: DataFrame, buckets: int = 64) -> DataFrame:
    """Each scan against the scan before it with the same sanitised label."""
    scans = runs.filter(run_type() == "scan").withColumn("label", scan_label())
    return previous_in_group(scans, "label", "run_seq", "pass_rate", "baseline", buckets).select(
        "run_seq", "label", "pass_rate", "baseline", F.round(F.col("pass_rate") - F.col("baseline"), 1).alias("delta_pp"))


def technique_history(runs: DataFrame, last_n: int | None = None) -> DataFrame:
    """Per technique: runs, average, latest, previous, delta, last seen. ``last_n`` limits the log lines read and adds
    the rates themselves, at most ``last_n`` per technique."""
    lines = runs if last_n is None else runs.orderBy(F.desc("run_seq")).limit(last_n)
    points = lines.select("run_seq", "ts", F.explode("technique_success_rates").alias("technique", "rate"))
    newest = Window.partitionBy("technique").orderBy(F.desc("run_seq"))
    second = points.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= 2).groupBy("technique").agg(
        F.max(F.when(F.col("rn") == 2, F.col("rate"))).alias("previous"))
    history = [] if last_n is None else [
        F.transform(F.array_sort(F.collect_list(F.struct("run_seq", "rate"))), lambda s: s["rate"]).alias("history")]
    return (
        points.groupBy("technique").agg(
            F.count("*").alias("runs"), F.avg("rate").alias("average"), F.max_by("rate", "run_seq").alias("latest"),
            F.max_by("ts", "run_seq").alias("last_seen"), *history)
        .join(second, "technique").withColumn("delta", F.col("latest") - F.col("previous"))
    )


def rank_history(history: DataFrame, min_runs: int = 1, top: int | None = None, contains: str = "") -> DataFrame:
    """By latest rate; an arrow shows a move of more than half a point."""
    moved = F.col("delta") * 100
    out = history.filter((F.col("runs") >= min_runs) & F.contains(F.lower("technique"), F.lit(contains.lower())))
    out = out.withColumn("arrow", F.when(moved > 0.5, "up").when(moved < -0.5, "down").otherwise("flat"))
    out = out.orderBy(F.desc("latest"), "technique")
    return out if top is None else out.limit(top)


def _seeds(spark, table: dict[str, float], key: str) -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"{key} string, seed double")


def history_by_generator(history: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Technique averages folded to families, so that a family lookup finds them."""
    return history.join(F.broadcast(catalogue.select("technique", "generator").distinct()), "technique").groupBy(
        "generator").agg(F.avg("average").alias("pass_rate"))


def blend_seeds(generator_history: DataFrame, weight: float = 0.7) -> DataFrame:
    """Expected pass rate per family: history and prior 70 to 30, 0.5 where one is missing; no history gives the prior.
    Always in pass-rate units."""
    spark = generator_history.sparkSession
    joined = generator_history.join(_seeds(spark, SEED_WEIGHTS, "generator"), "generator", "full_outer")
    any_history = F.broadcast(generator_history.agg((F.count("*") > 0).alias("known")))
    seed_pass = F.lit(1.0) - F.coalesce(F.col("seed"), F.lit(NEUTRAL))
    blended = F.coalesce(F.col("pass_rate"), F.lit(NEUTRAL)) * weight + seed_pass * (1.0 - weight)
    return joined.crossJoin(any_history).select(
        "generator", F.when(F.col("known"), blended).otherwise(seed_pass).alias("expected_pass_rate"))


def fast_subset(history: DataFrame, catalogue: DataFrame, top: int = 5, floor: float = 0.10) -> DataFrame:
    """Techniques per family by expected bypass, the first ``top`` at or above ``floor`` marked kept."""
    spark = history.sparkSession
    seeds = _seeds(spark, SEED_WEIGHTS, "generator").withColumnRenamed("seed", "family_seed")
    tech_seeds = _seeds(spark, TECHNIQUE_SEEDS, "technique")
    bypass = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("average")))
    seed = F.coalesce("seed", "family_seed", F.lit(NEUTRAL))
    weighted = (
        catalogue.join(F.broadcast(seeds), "generator", "left").join(F.broadcast(tech_seeds), "technique", "left")
        .join(history.select("technique", "average"), "technique", "left")
        .withColumn("weight", F.when(F.col("average").isNull(), seed).otherwise(bypass * 0.7 + seed * 0.3))
    )
    w = Window.partitionBy("generator").orderBy(F.desc("weight"), "ordinal")
    return weighted.withColumn("rank", F.row_number().over(w)).select(
        "generator", "technique", "weight", "rank", ((F.col("rank") <= top) & (F.col("weight") >= floor)).alias("kept"))


def restrict_by_history(techniques: DataFrame, history: DataFrame, limit: float = 0.5) -> DataFrame:
    """Techniques that have been caught at most half of the time."""
    return techniques.join(history.filter(F.col("average") <= limit), "technique", "left_semi")


def observed_rates(catalogue: DataFrame, history: DataFrame) -> DataFrame:
    """The technique catalogue with the rate seen last; null where it never ran."""
    return catalogue.join(history.select("technique", F.col("latest").alias("observed_rate")), "technique", "left")
