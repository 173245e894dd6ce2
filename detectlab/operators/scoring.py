"""Reports over an outcome table: counts, rates, rankings, bands, recommendations.

An outcome table has category, generator, technique, strategy, severity, detected, confidence, variant, payload_id and
ordinal. Groups are few (categories, techniques), so partial aggregation leaves one small row per group and map task
before the shuffle, however large a group is. The three denominators in use keep separate names: ``detection_rate_all``
and ``bypass_rate_all`` count errors, ``evasion_rate_tested`` does not. ``*_pct`` is the displayed tenth.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectlab.operators.catalogue import BUCKETS
from detectlab.operators.rates import banded, null_safe_join, number_in_group, pct, ratio
from detectlab.session import materialise

MIN_SAMPLES = 3

ORDER = ("payload_id", "generator", "ordinal", "strategy")


def technique_name() -> Column:
    return F.coalesce(F.nullif(F.col("technique"), F.lit("")), F.col("generator"))


WEIGHT = "rows"


def many(results: DataFrame, test: Column | None = None) -> Column:
    """How many rows, or rows that pass a test. In a summary a row stands for as many as its column ``rows`` says."""
    if WEIGHT not in results.columns:
        return F.count("*") if test is None else F.count_if(test)
    return F.coalesce(F.sum(F.col(WEIGHT) if test is None else F.when(test, F.col(WEIGHT))), F.lit(0))


def tallies(results: DataFrame | None = None) -> list[Column]:
    count = (lambda *test: many(results, *test)) if results is not None else (lambda *test: F.count_if(*test) if test else F.count("*"))
    return [count().alias("total"), *[count(F.col("severity") == s).alias(s) for s in ("pass", "fail", "error")]]


def _tested() -> Column:
    return F.col("pass") + F.col("fail")


def overall(results: DataFrame) -> DataFrame:
    return results.agg(*tallies(results)).withColumn("detection_rate_all", ratio(F.col("pass"), F.col("total"))).withColumn(
        "detection_pct", pct(F.col("pass"), F.col("total")))


def by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(*tallies(results)).withColumn(
        "evasion_rate_tested", ratio(F.col("fail"), _tested())).withColumn("evasion_pct", pct(F.col("fail"), _tested()))


def by_generator(results: DataFrame) -> DataFrame:
    return results.groupBy("generator").agg(*tallies(results)).withColumn(
        "bypass_rate_all", ratio(F.col("fail"), F.col("total"))).withColumn(
        "bypass_pct", pct(F.col("fail"), F.col("total")))


def top_bypass(results: DataFrame, n: int = 5) -> DataFrame:
    return by_generator(results).orderBy(F.desc("bypass_rate_all"), "generator").limit(n)


def _with_first(rows: DataFrame, keys: list[str], aggregates: list[Column], firsts: dict[str, str]) -> DataFrame:
    """Aggregates by key, and for each name in ``firsts`` the first variant with that severity.

    The first pass keeps numbers alone, so it is a hash aggregate that shrinks to a row per key and task; the payload ids
    that it finds pick the few rows among which the first variant is, by the whole order.
    """
    least = [F.min(F.when(F.col("severity") == sev, F.col("payload_id"))).alias(f"__id_{name}") for name, sev in firsts.items()]
    counted = rows.groupBy(*keys).agg(*aggregates, *least)
    picked = null_safe_join(rows, counted.select(*keys, *[f"__id_{n}" for n in firsts]), keys)
    of = {n: (F.col("severity") == sev) & (F.col("payload_id") == F.col(f"__id_{n}")) for n, sev in firsts.items()}
    place = F.struct(*[F.col(c) for c in ORDER], F.col("variant"))
    found = picked.filter(reduce(lambda x, y: x | y, of.values())).groupBy(*keys).agg(
        *[F.min(F.when(test, place)).alias(n) for n, test in of.items()])
    return null_safe_join(counted, found, keys, "left").drop(*[f"__id_{n}" for n in firsts])


def by_technique(results: DataFrame, merged: bool = False) -> DataFrame:
    """Per technique and family; ``merged`` joins techniques that two families share."""
    named = results.withColumn("technique_name", technique_name())
    keys = ["technique_name"] if merged else ["technique_name", "generator"]
    example = lambda name: F.substring(F.col(f"{name}.variant"), 1, 200)
    return _with_first(named, keys, tallies(named), {"__evaded": "fail", "__caught": "pass"}).withColumn(
        "example_evaded", example("__evaded")).withColumn("example_detected", example("__caught")).drop(
        "__evaded", "__caught").withColumn("evasion_rate_tested", ratio(F.col("fail"), _tested())).withColumn(
        "evasion_pct", pct(F.col("fail"), _tested()))


def _pairs(results: DataFrame) -> DataFrame:
    tested = results.filter(F.col("severity") != "error").withColumn("technique_name", technique_name())
    counts = [many(tested).alias("samples"), many(tested, F.col("severity") == "fail").alias("fail")]
    return _with_first(tested, ["category", "technique_name"], counts, {"first": "fail"})


def best_and_worst(results: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per category the techniques with the lowest and highest evasion rate, and one evaded value."""
    pairs = _pairs(results).withColumn("rate", F.col("fail") / F.col("samples"))
    enough = F.col("samples") >= min_samples
    ranked = F.struct(F.col("rate"), F.col("technique_name"), F.col("samples"))
    return pairs.groupBy("category").agg(
        F.min(F.when(enough, ranked)).alias("best"), F.max(F.when(enough, ranked)).alias("worst"),
        F.substring(F.min("first")["variant"], 1, 200).alias("sample_evaded"),
    ).select(
        "category",
        F.col("best.technique_name").alias("best_technique"), F.col("best.rate").alias("best_rate"),
        F.col("best.samples").alias("best_samples"),
        F.col("worst.technique_name").alias("worst_technique"), F.col("worst.rate").alias("worst_rate"),
        F.col("worst.samples").alias("worst_samples"), "sample_evaded",
    )


# Confidence bands; the top one includes 1.0.
CONFIDENCE_BANDS = (("0.9-1.0", 0.9, 1.01), ("0.7-0.9", 0.7, 0.9), ("0.5-0.7", 0.5, 0.7), ("0.3-0.5", 0.3, 0.5),
                    ("0.0-0.3", 0.0, 0.3))


def confidence_histogram(results: DataFrame) -> DataFrame:
    """Five rows, empty bands included. One global aggregate, then five rows from its one row."""
    counted = results.filter(F.col("detected") & F.col("confidence").isNotNull()).agg(
        many(results).alias("total"),
        *[many(results, (F.col("confidence") >= low) & (F.col("confidence") < high)).alias(f"b{i}")
          for i, (_, low, high) in enumerate(CONFIDENCE_BANDS)],
    )
    return counted.select("total", F.inline(F.array(*[
        F.struct(F.lit(name).alias("band"), F.col(f"b{i}").alias("count"))
        for i, (name, _, _) in enumerate(CONFIDENCE_BANDS)
    ]))).select("band", "count", pct(F.col("count"), F.col("total")).alias("pct"))


def worst_pairs(results: DataFrame, n: int = 4, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return (
        _pairs(results).filter((F.col("samples") >= min_samples) & (F.col("fail") > 0))
        .withColumn("evasion_rate_tested", F.col("fail") / F.col("samples"))
        .orderBy(F.desc("evasion_rate_tested"), "category", "technique_name").limit(n)
        .select("category", "technique_name", "samples", "fail", "evasion_rate_tested",
                F.substring(F.col("first.variant"), 1, 180).alias("example"))
    )


def strategy_gap(results: DataFrame) -> DataFrame:
    """Bypass of plain text against all other strategies together."""
    text, fail = F.col("strategy") == "text", F.col("severity") == "fail"
    return results.agg(
        many(results, text).alias("text_total"), many(results, text & fail).alias("text_fail"),
        many(results, ~text).alias("file_total"), many(results, ~text & fail).alias("file_fail"),
    ).withColumn("text_pct", pct(F.col("text_fail"), F.col("text_total"))).withColumn(
        "file_pct", pct(F.col("file_fail"), F.col("file_total"))).withColumn(
        "gap_pp", F.round(F.col("file_pct") - F.col("text_pct"), 1))


def key_findings(results: DataFrame) -> DataFrame:
    """rank, kind, subject, metric. All five findings come from one table of (family, category, strategy) counts."""
    fail = many(results, F.col("severity") == "fail")
    base = results.groupBy("generator", "category", "strategy").agg(many(results).alias("total"), fail.alias("fail"))

    def rated(key: str) -> DataFrame:
        return base.groupBy(key).agg(
            F.sum("total").alias("total"), F.sum("fail").alias("fail"),
            F.count_distinct(F.when(F.col("fail") > 0, F.col("category"))).alias("cats"),
        ).withColumn("metric", pct(F.col("fail"), F.col("total")))

    gens, cats = rated("generator"), rated("category")
    all_cats = base.agg(F.count_distinct("category").alias("n_cats"), F.sum("fail").alias("all_fail"))
    finding = lambda df, rank, kind, subject: df.select(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
        F.col(subject).alias("subject"), F.col("metric").cast("double").alias("metric"))
    top = gens.orderBy(F.desc("metric"), "generator").limit(1)
    level = banded(F.col("metric"), ((80.0, "evades_consistently"), (50.0, "highest_bypass")), "highest_bypass_mild")
    # The top family and the category count are one row each.
    broad = (
        gens.crossJoin(F.broadcast(top.select(F.col("generator").alias("top"))))
        .crossJoin(F.broadcast(all_cats))
        .filter((F.col("generator") != F.col("top")) & (F.col("metric") >= 30)
                & (F.col("cats") >= F.greatest(F.lit(2), F.floor(F.col("n_cats") / 2))))
        .orderBy(F.desc("cats"), "generator").limit(1)
    )
    exposed = cats.crossJoin(F.broadcast(all_cats)).filter((F.col("n_cats") > 1)).orderBy(
        F.desc("metric"), "category").limit(1).filter(F.col("metric") >= 40)
    gap = strategy_gap(results).filter(
        (F.col("text_total") > 0) & (F.col("file_total") > 0) & (F.abs("gap_pp") >= 5)).select(
        F.lit("file strategies").alias("subject"), F.col("gap_pp").alias("metric"))
    zero = gens.filter(F.col("metric") == 0)
    few = zero.agg(F.count("*").alias("n_zero"))
    silent = zero.crossJoin(F.broadcast(few)).filter(F.col("n_zero") <= 4)
    any_fail = F.broadcast(all_cats.select(F.col("all_fail").alias("any_fail")))
    none = all_cats.filter(F.col("all_fail") == 0).select(F.lit("all variants").alias("subject"),
                                                         F.lit(0.0).alias("metric"))
    found = (
        finding(top, 1, level, "generator")
        .unionByName(finding(broad, 2, "broad_bypass", "generator"))
        .unionByName(finding(exposed, 3, "most_exposed_category", "category"))
        .unionByName(finding(gap, 4, "strategy_gap", "subject"))
        .unionByName(finding(silent, 5, "no_bypass", "generator"))
    )
    return found.crossJoin(any_fail).filter(F.col("any_fail") > 0).drop("any_fail").unionByName(
        finding(none, 0, "all_detected", "subject"))


def technique_rates(results: DataFrame) -> DataFrame:
    """Pass rate per technique to 4 places, errors left out."""
    return results.filter(F.col("severity") != "error").groupBy(technique_name().alias("technique_name")).agg(
        F.round(many(results, F.col("severity") == "pass") / many(results), 4).alias("pass_rate"))


def technique_rate_map(results: DataFrame) -> DataFrame:
    """The same as one map: as many entries as there are techniques."""
    return technique_rates(results).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("technique_name", "pass_rate")))).alias("technique_success_rates"))


# Detection bands in percent.
DETECTION_BANDS = ((90.0, "ok"), (70.0, "warn"))
EXECUTIVE_BANDS = ((95.0, "strong"), (70.0, "workable"))


def category_bands(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(*tallies(results)).withColumn(
        "detection_pct", pct(F.col("pass"), F.col("total"))).withColumn(
        "band", banded(F.col("detection_pct"), DETECTION_BANDS, "bad"))


def top_evading(results: DataFrame, n: int = 15) -> DataFrame:
    return results.groupBy(technique_name().alias("technique_name")).agg(*tallies(results)).withColumn(
        "bypass_pct", pct(F.col("fail"), F.col("total"))).orderBy(
        F.desc("fail"), F.desc("bypass_pct"), "technique_name").limit(n)


def recommendations(results: DataFrame, false_positives: DataFrame | None = None) -> DataFrame:
    """kind, subject, metric, level. ``false_positives`` is a one-row table with total_tested and total_flagged."""
    cats = results.groupBy("category").agg(*tallies(results)).withColumn("metric", pct(F.col("pass"), F.col("total")))
    weak = cats.filter(F.col("metric") < 50).orderBy("metric", "category").limit(5)
    worst = weak.agg(F.min("metric").alias("lowest"))
    weak = weak.crossJoin(F.broadcast(worst)).select(
        F.lit("weak_category").alias("kind"), F.col("category").alias("subject"), "metric",
        F.when(F.col("lowest") < 20, "bad").otherwise("warn").alias("level"))
    techs = results.groupBy(technique_name().alias("technique_name")).agg(*tallies(results)).withColumn(
        "metric", pct(F.col("fail"), F.col("total"))).filter((F.col("total") >= 10) & (F.col("metric") >= 75))
    evading = techs.orderBy(F.desc("metric"), F.desc("total"), "technique_name").limit(5).select(
        F.lit("evading_technique").alias("kind"), F.col("technique_name").alias("subject"), "metric",
        F.lit("warn").alias("level"))
    n_evading = techs.agg(F.count("*").alias("n_evading"))
    baseline = overall(results).crossJoin(F.broadcast(n_evading)).filter(
        (F.col("detection_pct") >= 95) & (F.col("n_evading") == 0)).select(
        F.lit("baseline_ok").alias("kind"), F.lit("overall").alias("subject"), F.col("detection_pct").alias("metric"),
        F.lit("good").alias("level"))
    recs = weak.unionByName(evading).unionByName(baseline)
    if false_positives is not None:
        rate = pct(F.col("total_flagged"), F.col("total_tested"))
        recs = recs.unionByName(false_positives.select(
            F.lit("false_positive_noise").alias("kind"), F.lit("overall").alias("subject"), rate.alias("metric"),
            F.when(rate < 25, "warn").otherwise("bad").alias("level")).filter(F.col("metric") >= 15))
    quiet = recs.agg(F.count("*").alias("n")).filter(F.col("n") == 0).select(
        F.lit("nothing_critical").alias("kind"), F.lit("overall").alias("subject"), F.lit(0.0).alias("metric"),
        F.lit("good").alias("level"))
    return recs.unionByName(quiet)


def executive_bands(results: DataFrame, false_positives: DataFrame) -> DataFrame:
    rate = pct(F.col("total_flagged"), F.col("total_tested"))
    return overall(results).crossJoin(F.broadcast(false_positives)).select(
        "total", "pass", "fail", "detection_pct",
        banded(F.col("detection_pct"), EXECUTIVE_BANDS, "material_gap").alias("detection_band"),
        rate.alias("fp_pct"), banded(rate, ((10.0, "noisy"),), "acceptable").alias("fp_band"))


# What to change in a detector per technique: exact names first, then the longest prefix, then a general line.
FIXES = {
    "zero_width_zwsp": "strip U+200B before matching", "zero_width_zwnj": "strip U+200C before matching",
    "zero_width_zwj": "strip U+200D before matching", "homoglyph_substitution": "map look-alike letters to ASCII",
    "fullwidth_digits": "apply NFKC before matching", "html_entity_decimal": "unescape HTML entities",
    "html_entity_hex": "unescape HTML entities", "mid_line_break": "join lines before matching",
    "html_comment_injection": "remove markup comments", "css_comment_injection": "remove block comments",
    "rot13": "add a ROT13 view", "reversed_full": "add a reversed view", "no_delimiter": "accept bare digits",
    "mixed_case": "match without regard to case",
}
PREFIX_FIXES = {
    "regional_mixed": "map every decimal digit to ASCII, digit by digit", "regional_": "map decimal digits to ASCII",
    "morse_": "decode Morse digits", "unicode_": "map Unicode spaces to a space", "base64_": "add a base64 view",
    "base32_": "add a base32 view", "hex_": "add a hex view", "url_": "decode percent escapes",
    "double_url_": "decode percent escapes twice", "shy_": "strip soft hyphens", "wj_": "strip word joiners",
}
# What a family does to a value, and what undoes it where the technique has no line of its own.
FAMILY_NOTES = {
    "unicode_encoding": ("characters are replaced by look-alikes, entities or invisible ones", "fold characters to ASCII before matching"),
    "delimiter": ("groups of the value are joined by other delimiters", "match on the value without delimiters"),
    "splitting": ("the value is broken up by markup, noise or line breaks", "strip markup and join lines before matching"),
    "leetspeak": ("letters are written as digits and signs", "match a second view with signs read as letters"),
    "regional_digits": ("digits come from other scripts", "map decimal digits to ASCII"),
    "structural": ("the value is padded, cut, repeated or re-cased", "match inside longer runs and without regard to case"),
    "encoding": ("the value is encoded once", "decode likely encodings and match the result"),
    "encoding_chains": ("the value is encoded twice", "decode in layers and match every layer"),
    "context_injection": ("the value stands within a sentence or record", "match inside running text, not whole fields alone"),
    "bidirectional": ("direction marks surround or cut the value", "strip direction marks"),
    "morse_code": ("digits are written in Morse code", "decode Morse digits"),
    "soft_hyphen": ("invisible hyphens or joiners stand in the value", "strip soft hyphens and word joiners"),
    "unicode_whitespace": ("groups are parted by unusual spaces", "map Unicode spaces to a space"),
    "entropy_evasion": ("a secret is cut, diluted or encoded so that its entropy falls", "join adjacent strings before measuring entropy"),
}
GENERAL_FIX = "add a normalisation step for this technique"
GENERAL_NOTE = "the value is changed by a transform of the user's own"


def fix_for(technique: Column, generator: Column | None = None) -> Column:
    """By the technique's name, its beginning, its family, or the general line."""
    out = F.lit(GENERAL_FIX)
    if generator is not None:
        for name, (_, fix) in FAMILY_NOTES.items():
            out = F.when(generator == name, fix).otherwise(out)
    for prefix, fix in sorted(PREFIX_FIXES.items(), key=lambda kv: len(kv[0])):
        out = F.when(technique.startswith(prefix), fix).otherwise(out)
    for name, fix in FIXES.items():
        out = F.when(technique == name, fix).otherwise(out)
    return out


def description_for(generator: Column) -> Column:
    out = F.lit(GENERAL_NOTE)
    for name, (note, _) in FAMILY_NOTES.items():
        out = F.when(generator == name, note).otherwise(out)
    return out


def suggestions(results: DataFrame) -> DataFrame:
    """One row per failing technique."""
    return results.filter(F.col("severity") == "fail").groupBy("technique").agg(
        F.min("generator").alias("generator"), many(results).alias("fail")
    ).withColumn("description", description_for(F.col("generator"))).withColumn(
        "suggested_fix", fix_for(F.col("technique"), F.col("generator")))


def last_payload(summary: DataFrame, n: int) -> int | None:
    """A payload id up to which every failing technique has its first ``n`` rows, or all; null where a summary does not tell.

    The rows of a summary are rows of the run, so the ``n``-th least payload id among them is one that the ``n``-th row does not exceed.
    """
    ids = F.array_sort(F.collect_list("payload_id"))
    bounds = summary.filter(F.col("severity") == "fail").groupBy("technique").agg(
        F.get(ids, F.least(F.lit(n), F.size(ids)) - 1).alias("last"), ((F.size(ids) >= n) | (F.sum(WEIGHT) <= F.size(ids))).alias("known"))
    found = bounds.agg(F.max("last").alias("last"), F.bool_and("known").alias("known")).first()
    return found["last"] if found["known"] else None


def feedback(results: DataFrame, examples: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """Failing techniques by count with their first values. The rank limit is applied before the shuffle.

    ``rows`` holds the first rows where ``results`` is a summary.
    """
    failing = results.filter(F.col("severity") == "fail")
    counts = failing.groupBy("technique").agg(F.min("generator").alias("generator"), many(failing).alias("fail"))
    rank = F.row_number().over(Window.partitionBy("technique").orderBy(*ORDER))
    shown = (
        (failing if rows is None else rows.filter(F.col("severity") == "fail")).select("technique", *ORDER, "variant").withColumn("rn", rank).filter(F.col("rn") <= examples)
        .groupBy("technique").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "variant"))),
                                              lambda s: s["variant"]).alias("examples"))
    )
    return counts.join(F.broadcast(shown), "technique").select(
        "technique", "generator", "fail", F.array_join("examples", " | ").alias("examples"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def case_base(label: str = "label") -> Column:
    return F.concat_ws("_", F.lit("test"), slug(F.col(label)), slug(F.col("technique")))


def regression_cases(results: DataFrame, label: str = "label") -> DataFrame:
    """Each failing variant with a unique case name; repeats of a name are numbered in slices, not in one task.

    A column ``base_name`` that the results have already is taken as it is.
    """
    failing = results.filter(F.col("severity") == "fail")
    if "base_name" not in failing.columns:
        failing = failing.withColumn("base_name", case_base(label))
    numbered = number_in_group(failing, ["base_name"], list(ORDER), "n")
    return numbered.withColumn("case_name", F.when(F.col("n") == 1, F.col("base_name")).otherwise(
        F.concat_ws("_", F.col("base_name"), F.col("n").cast("string"))))


def placed_cases(cases: DataFrame) -> DataFrame:
    """Per base name: cases, the sum of number times payload id (``placed``), and the last case name.

    The sum grows with the cube of the run, so it is kept in two halves. It is a bigint while every sum fits one, else a decimal of 38 digits.
    """
    product = F.col("n") * F.col("payload_id")
    halves = cases.groupBy("base_name").agg(
        F.count("*").alias("cases"), F.sum(F.shiftright(product, 32)).alias("__high"), F.sum(product.bitwiseAND((1 << 32) - 1)).alias("__low"),
        F.max("case_name").alias("last_name"))
    whole = F.col("__high").cast("decimal(38,0)") * F.lit(1 << 32) + F.col("__low")
    placed = materialise(halves.select("base_name", "cases", whole.cast("decimal(38,0)").alias("placed"), "last_name"), "placed-cases")
    beyond = placed.filter((F.col("placed") > (1 << 63) - 1) | (F.col("placed") < -(1 << 63))).limit(1).count()
    return placed if beyond else placed.withColumn("placed", F.col("placed").cast("bigint"))


def false_positive_rates(flagged: DataFrame) -> DataFrame:
    """Per category and overall (category ``ALL``) in one pass; ``flagged`` has category and a boolean flagged."""
    return flagged.rollup("category").agg(
        F.count("*").alias("total"), F.count_if(F.col("flagged")).alias("flagged"), F.grouping("category").alias("g"),
    ).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "total", "flagged",
             pct(F.col("flagged"), F.col("total")).alias("false_positive_pct"))


def flagged_values(flagged: DataFrame) -> DataFrame:
    """The flagged values themselves, as rows: a list per category would grow without bound."""
    return flagged.filter(F.col("flagged")).select("category", "value")


def gate(results: DataFrame, minimum: float) -> DataFrame:
    """Whether the detection rate reaches the minimum, in percent."""
    return overall(results).select("total", "pass", "detection_pct", F.lit(minimum).alias("minimum"),
                                   (F.col("detection_pct") >= minimum).alias("passed"))


def failing_rows(results: DataFrame, n: int = 50) -> DataFrame:
    return results.filter(F.col("severity") == "fail").orderBy(*ORDER).limit(n)


def bucket_of(category: Column) -> Column:
    """Coarse bucket of a category, the first that names it, else OTHER."""
    out = F.lit("OTHER")
    for bucket, names in reversed(BUCKETS.items()):
        out = F.when(category.isin(*names), bucket).otherwise(out)
    return out


def bucket_metrics(results: DataFrame, flagged: DataFrame) -> DataFrame:
    """TP, FN, FP with recall and precision per bucket; every bucket is there, OTHER only if seen."""
    outcome = results.groupBy(bucket_of(F.col("category")).alias("bucket")).agg(
        many(results, F.col("severity") == "pass").alias("tp"), many(results, F.col("severity") == "fail").alias("fn"))
    false = flagged.groupBy(bucket_of(F.col("category")).alias("bucket")).agg(
        F.count_if(F.col("flagged")).alias("fp"))
    spark = results.sparkSession
    names = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    joined = names.join(outcome, "bucket", "full_outer").join(false, "bucket", "full_outer").fillna(0, ["tp", "fn", "fp"])
    return joined.select("bucket", "tp", "fn", "fp", pct(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_pct"),
                         pct(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_pct"))


def coverage(results: DataFrame, known: int) -> DataFrame:
    tested = F.count_distinct("category")
    return results.agg(tested.alias("tested")).withColumn("known", F.greatest(F.lit(known), F.col("tested"))).withColumn(
        "coverage_pct", pct(F.col("tested"), F.col("known")))


def technique_bands(rates: DataFrame, rate: str = "pass_rate") -> DataFrame:
    """How many techniques are caught at 0.8 and up, at 0.5 and up, below."""
    r = F.col(rate)
    return rates.agg(F.count_if(r >= 0.8).alias("high"), F.count_if((r >= 0.5) & (r < 0.8)).alias("medium"),
                     F.count_if(r < 0.5).alias("low"))


def top_caught(results: DataFrame, n: int = 5, given: DataFrame | None = None, evading: bool = False) -> DataFrame:
    """Techniques by catch rate, best caught first (or worst with ``evading``); given rates replace counted ones."""
    rates = given if given is not None else technique_rates(results)
    order = F.asc("pass_rate") if evading else F.desc("pass_rate")
    return rates.orderBy(order, "technique_name").limit(n)
