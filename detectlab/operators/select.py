"""Choosing payloads and reading detector responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.checks import luhn_valid
from detectlab.functions.text import digits_only, let
from detectlab.operators import catalogue as K


def filter_categories(df: DataFrame, categories: Sequence[str] | None = None, heuristic: bool = False) -> DataFrame:
    """Allow-list of categories; heuristic ones are left out unless asked for."""
    out = df if heuristic else df.filter(~F.col("category").isin(*K.HEURISTIC))
    return out if categories is None else out.filter(F.col("category").isin(*categories))


def filter_tier(df: DataFrame, tier: str, members: DataFrame | None = None) -> DataFrame:
    """Rows whose category the tier holds. ``members`` (tier, category) is a user's own table and replaces the tiers in it."""
    if members is None:
        return df.filter(K.in_tier(tier, F.col("category")))
    return df.join(members.filter(F.col("tier") == tier).select("category").distinct(), "category", "left_semi")


def cross_strategies(df: DataFrame, strategies: Sequence[str] = ("text", "docx", "pdf", "xlsx")) -> DataFrame:
    return df.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def with_bucket(df: DataFrame) -> DataFrame:
    """Coarse bucket by a broadcast lookup of a fixed table; the first bucket that names a category wins."""
    first = K.dim_bucket(df.sparkSession).groupBy("category").agg(F.min_by("bucket", "ord").alias("bucket"))
    return df.join(F.broadcast(first), "category", "left").fillna("OTHER", ["bucket"])


def expand_buckets(wanted: DataFrame) -> DataFrame:
    """Categories of the wanted buckets (bucket, at), each once, in first-seen order."""
    dim = F.broadcast(K.dim_bucket(wanted.sparkSession))
    named = wanted.withColumn("bucket", F.upper("bucket")).groupBy("bucket").agg(F.min("at").alias("at"))
    return named.join(dim, "bucket").groupBy("category").agg(F.min(F.struct("at", "ord")).alias("first")).orderBy(
        "first").select("category", F.col("first.at").alias("at"), F.col("first.ord").alias("ord"))


def with_group(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Catalogue group: named, else by country prefix (health identifiers to healthcare), else by word, else Other.

    A prefix is everything up to the first underscore, so the prefix lookup is an equi-join. ``groups`` (category,
    catalog_group), a user's own table with a row a category, wins over all of these.
    """
    spark = df.sparkSession
    cat = F.col("category")
    named = F.broadcast(K.dim_group(spark).withColumnRenamed("catalog_group", "__named"))
    regional = F.broadcast(K.dim_prefix(spark).withColumnRenamed("catalog_group", "__regional"))
    health = F.lit(False)
    for part in K.HEALTH_PARTS:
        health = health | F.contains(cat, F.lit(part))
    by_word = F.lit("Other")
    for group, words in reversed(K.KEYWORD_GROUPS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(cat, F.lit(word))
        by_word = F.when(hit, group).otherwise(by_word)
    joined = df.join(named, "category", "left").withColumn(
        "prefix", F.concat(F.substring_index(cat, "_", 1), F.lit("_"))).join(regional, "prefix", "left")
    own = F.lit(None).cast("string")
    if groups is not None:
        joined = joined.join(groups.select("category", F.col("catalog_group").alias("__own")), "category", "left")
        own = F.col("__own")
    return joined.withColumn("catalog_group", F.coalesce(
        own, F.col("__named"), F.when(F.col("__regional").isNotNull() & health, "Healthcare"), F.col("__regional"), by_word,
    )).drop("__own", "__named", "__regional", "prefix")


def value_format(value: Column) -> Column:
    """Category of a bare value by its shape; digits are ASCII digits."""
    def decide(v: Column) -> Column:
        digits = digits_only(v)
        n = F.length(digits)
        out = F.when(v.rlike(fixed.CARD_SHAPE) & n.between(13, 19) & luhn_valid(digits), "credit_card").otherwise("unknown")
        out = F.when(v.startswith("+") | (v.startswith("1") & (n == 11)), "phone").otherwise(out)
        for name, pattern in reversed(fixed.VALUE_FORMATS):
            out = F.when(v.rlike(pattern), name).otherwise(out)
        return out

    return let(F.trim(value), decide)


def category_counts(payloads: DataFrame, kind: str | None = None) -> DataFrame:
    out = payloads if kind is None else payloads.filter(F.col("category_type") == kind)
    return out.groupBy("category", "category_type").agg(F.count("*").alias("payloads"))


# --- detector responses -----------------------------------------------------------------------------------------------

# Response keys probed in this order, and texts that mean yes.
RESPONSE_KEYS = ("detected", "found", "matches", "findings", "alert", "flagged")
YES_TEXTS = ("true", "1", "yes", "detected")


def _truthy(response: Column, key: str, texts: bool) -> Column:
    """Truth of a key's value by its type; null where the key is absent or, without ``texts``, of another type."""
    value = F.try_variant_get(response, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(response, f"$.{key}", "double")
    out = (
        F.when(kind == "BOOLEAN", F.try_variant_get(response, f"$.{key}", "boolean"))
        .when(kind.startswith("ARRAY"), kind.rlike("^ARRAY<") & (F.size(
            F.try_variant_get(response, f"$.{key}", "array<variant>")) > 0))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number != 0)
    )
    if texts:
        text = F.lower(F.try_variant_get(response, f"$.{key}", "string"))
        out = out.when(kind == "STRING", text.isin(*YES_TEXTS)).when(kind.isNotNull(), F.lit(False))
    return out


def response_detected(raw: Column, key: str = "detected") -> Column:
    """Outcome of a response text. A configured key that is present decides alone; else the usual keys are probed."""
    response = F.try_parse_json(raw)
    probes = [_truthy(response, k, texts=False) for k in RESPONSE_KEYS]
    return F.coalesce(_truthy(response, key, texts=True), *probes, F.lit(False))


# What a finding says of the issuer of a card, in itself or in its metadata.
BIN_FIELDS = ("bin_brand", "bin_country", "bin_card_type", "bin_issuer")
_BIN = ",".join(f"{f}:string" for f in BIN_FIELDS)
FINDING = f"struct<category:string,sub_category:string,confidence:double,validator:string,entropy_classification:string,{_BIN},metadata:struct<{_BIN}>>"


def clean_flag_detected(raw: Column) -> Column:
    """Responses that say whether a text is clean, or how many findings it has, or list them."""
    r = F.from_json(raw, f"is_clean boolean, finding_count double, findings array<{FINDING}>")
    return F.coalesce(~r["is_clean"], r["finding_count"] > 0, F.size(r["findings"]) > 0, F.lit(False))


def score_detected(raw: Column, minimum: float) -> Column:
    """Responses that are a list of scored results."""
    r = F.from_json(raw, "array<struct<score:double>>")
    return F.coalesce(F.exists(r, lambda x: F.coalesce(x["score"], F.lit(0.0)) >= minimum), F.lit(False))


def file_matches(raw: Column) -> Column:
    """Responses that list files with matches, or matches directly: struct of the match count and the error text."""
    nested = F.from_json(raw, f"array<struct<file_path:string,error:string,matches:array<{FINDING}>>>")
    flat = F.from_json(raw, f"array<{FINDING}>")
    by_file = F.get(nested, F.lit(0))
    is_file = F.coalesce(by_file["file_path"].isNotNull(), F.lit(False))
    error = F.when(flat.isNull(), "unexpected response").when(is_file, F.nullif(by_file["error"], F.lit("")))
    count = F.when(is_file, F.coalesce(F.size(by_file["matches"]), F.lit(0))).otherwise(F.coalesce(F.size(flat), F.lit(0)))
    return F.struct(F.greatest(count, F.lit(0)).alias("matches"), error.alias("error"))


def best_finding(raw: Column) -> Column:
    """The finding with the highest confidence (missing counts as 0), the first of equals; null without findings."""
    r = F.from_json(raw, f"findings array<{FINDING}>")
    ranked = F.transform(r["findings"], lambda f, i: F.struct(
        F.coalesce(f["confidence"], F.lit(0.0)).alias("c"), (-i).alias("at"), f.alias("f")))
    return F.array_max(ranked)["f"]


def enrichment(finding: Column) -> Column:
    """What a finding adds to a result: confidence, sub-category and the issuer's fields; empty texts are null."""
    def text(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    return F.struct(finding["confidence"].alias("confidence"), text(finding["sub_category"]).alias("sub_category"),
                    *[F.coalesce(text(finding["metadata"][f]), text(finding[f])).alias(f) for f in BIN_FIELDS])
