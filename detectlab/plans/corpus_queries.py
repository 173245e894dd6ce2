"""Queries for selection, detector responses, corpora and their sinks, history, and streams."""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.operators import catalogue as K
from detectlab.operators import corpus as G
from detectlab.operators import history as H
from detectlab.operators import select as Q
from detectlab.operators.variants import FAMILIES, NORMALISED, technique_catalogue
from detectlab.plans import derived
from detectlab.plans import sqlref as S
from detectlab.plans.registry import query
from detectlab.plans.value_queries import synth_sql
from detectlab.sources import readers, sinks
from detectlab.session import materialise, read_table, shared_dir, spread

SEED = 42

# --- selection --------------------------------------------------------------------------------------------------------

PAY = S.CUSTOMER_PAYLOADS
_SOME = ("credit_card", "email", "random_api_key", "phone")


@query("select_categories", f"SELECT payload_id, category, value FROM ({PAY}) WHERE category IN {S.in_list(_SOME)} AND category NOT IN {S.in_list(K.HEURISTIC)}")
def select_categories(spark, sf_dir):
    return Q.filter_categories(derived.customer_payloads(spark, sf_dir), _SOME).select("payload_id", "category", "value")


@query("select_tier_banking", f"SELECT payload_id, category FROM ({PAY}) WHERE category IN {S.in_list(K.TIER_BANKING)}")
def select_tier_banking(spark, sf_dir):
    return Q.filter_tier(derived.customer_payloads(spark, sf_dir), "banking").select("payload_id", "category")


@query("select_strategies", f"SELECT category, strategy, count(*) AS n FROM ({PAY}) CROSS JOIN (SELECT unnest(['text', 'docx', 'pdf', 'xlsx']) AS strategy) GROUP BY ALL")
def select_strategies(spark, sf_dir):
    return Q.cross_strategies(derived.customer_payloads(spark, sf_dir)).groupBy("category", "strategy").agg(F.count("*").alias("n"))


_FAM = " UNION ALL ".join(
    f"SELECT category, '{g}' AS generator, count(*) AS n FROM ({PAY}) " + (f"WHERE category IN {S.in_list(K.APPLICABLE[g])} " if g in K.APPLICABLE else "") + "GROUP BY category"
    for g in FAMILIES)


@query("select_applicable_families", _FAM)
def select_applicable_families(spark, sf_dir):
    from detectlab.operators.variants import applies

    rows = derived.customer_payloads(spark, sf_dir).select("category", F.explode(F.array_compact(F.array(*[
        F.when(applies(g, F.col("category")), g) for g in FAMILIES]))).alias("generator"))
    return rows.groupBy("category", "generator").agg(F.count("*").alias("n"))


_BUCKET = "CASE " + " ".join(f"WHEN category IN {S.in_list(cs)} THEN '{b}'" for b, cs in K.BUCKETS.items()) + " ELSE 'OTHER' END"


@query("classify_bucket", f"SELECT payload_id, category, {_BUCKET} AS bucket FROM ({PAY})")
def classify_bucket(spark, sf_dir):
    return Q.with_bucket(derived.customer_payloads(spark, sf_dir).select("payload_id", "category"))


_DIM = " UNION ALL ".join(f"SELECT '{b}' AS bucket, '{c}' AS category, {i} AS ord" for i, (b, c) in enumerate(
    (b, c) for b, cs in K.BUCKETS.items() for c in cs))


@query("expand_buckets",
       f"SELECT category, CAST(f.a AS BIGINT) AS \"at\", f.o AS ord FROM (SELECT category, min(struct_pack(a := seen, o := ord)) AS f FROM ({_DIM}) JOIN (SELECT upper(b) AS bucket, min(event_id) AS seen FROM "
       "(SELECT event_id, (['pci', 'phi', 'none', 'cred'])[CAST(event_id % 4 AS INT) + 1] AS b FROM events) GROUP BY 1) USING (bucket) GROUP BY category)")
def expand_buckets(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("pci", "phi", "none", "cred")])
    wanted = read_table(spark, sf_dir, "events").select(
        F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("bucket"), F.col("event_id").alias("at"))
    return Q.expand_buckets(wanted)


_GROUP = "CASE " + " ".join(f"WHEN category IN {S.in_list(cs)} THEN '{g}'" for g, cs in K.GROUPS.items())
_HEALTH = "(" + " OR ".join(f"contains(category, '{p}')" for p in K.HEALTH_PARTS) + ")"
_GROUP += " " + " ".join(
    f"WHEN split_part(category, '_', 1) IN {S.in_list(ps)} AND contains(category, '_') THEN CASE WHEN {_HEALTH} THEN 'Healthcare' ELSE '{g}' END" for g, ps in K.REGION_PREFIXES.items())
_GROUP += " " + " ".join("WHEN " + " OR ".join(f"contains(category, '{w}')" for w in ws) + f" THEN '{g}'" for g, ws in K.KEYWORD_GROUPS) + " ELSE 'Other' END"
_NAMES = tuple(c for c in fixed.FORMAT_SPECS) + ("credit_card", "uae_eid", "us_npi", "x_secret", "drug_code", "wallet_id", "misc")
# Expected members, written out: a table that is cut short must show.
_TIER_NAMES = ("credit_card", "ssn", "email", "uk_nin", "us_zip4", "de_tax_id", "fr_passport", "jp_passport", "br_cep", "zw_id", "mx_rfc", "bitcoin", "lei_num", "reg_sar", "au_dl", "eg_nid")
_IN_TIER = {"core": ("credit_card", "ssn", "email", "uk_nin", "us_zip4", "de_tax_id", "fr_passport", "lei_num", "reg_sar", "au_dl"),
            "regional": ("credit_card", "ssn", "email", "uk_nin", "us_zip4", "de_tax_id", "fr_passport", "jp_passport", "mx_rfc", "lei_num", "reg_sar", "au_dl")}


def _tier(name):
    def run(spark, sf_dir):
        names = F.array(*[F.lit(x) for x in _TIER_NAMES])
        events = read_table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_TIER_NAMES) + 1).cast("int")).alias("category"))
        return Q.filter_tier(events, name)

    return run


for _t, _members in _IN_TIER.items():
    query(f"select_tier_{_t}", f"SELECT * FROM (SELECT event_id, ({S.array(_TIER_NAMES)})[CAST(event_id % {len(_TIER_NAMES)} AS INT) + 1] AS category FROM events) WHERE category IN {S.in_list(_members)}")(_tier(_t))


@query("classify_group", f"SELECT event_id, category, {_GROUP} AS catalog_group FROM (SELECT event_id, ({S.array(_NAMES)})[CAST(event_id % {len(_NAMES)} AS INT) + 1] AS category FROM events)")
def classify_group(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in _NAMES])
    events = read_table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_NAMES) + 1).cast("int")).alias("category"))
    return Q.with_group(events).select("event_id", "category", "catalog_group")


_DIG = "regexp_replace(v, '[^0-9]', '', 'g')"
_FORMAT = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for n, p in fixed.VALUE_FORMATS) + (
    f" WHEN starts_with(v, '+') OR (starts_with(v, '1') AND length({_DIG}) = 11) THEN 'phone' WHEN regexp_matches(v, '{fixed.CARD_SHAPE}') AND length({_DIG}) BETWEEN 13 AND 19 AND {S.luhn_valid(_DIG)} THEN 'credit_card' ELSE 'unknown' END")


@query("classify_value_format", f"SELECT payload_id, category, {_FORMAT} AS detected_format FROM (SELECT payload_id, category, trim(value) AS v FROM ({PAY}))")
def classify_value_format(spark, sf_dir):
    return derived.customer_payloads(spark, sf_dir).select("payload_id", "category", Q.value_format(F.col("value")).alias("detected_format"))


@query("catalogue_categories", f"SELECT category, CASE WHEN category IN {S.in_list(K.HEURISTIC)} THEN 'heuristic' ELSE 'structured' END AS category_type, count(*) AS payloads FROM ({PAY}) GROUP BY ALL")
def catalogue_categories(spark, sf_dir):
    typed = derived.customer_payloads(spark, sf_dir).withColumn("category_type", F.when(F.col("category").isin(*K.HEURISTIC), "heuristic").otherwise("structured"))
    return Q.category_counts(typed)


# --- responses --------------------------------------------------------------------------------------------------------

_HOT = "value > 10"
_V = "printf('%.2f', value)"


@query("response_detected", f"SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 3 THEN FALSE WHEN 5 THEN FALSE ELSE {_HOT} END AS detected FROM events")
def response_detected(spark, sf_dir):
    return derived.responses(spark, sf_dir).select("event_id", Q.response_detected(F.col("raw")).alias("detected"))


@query("response_clean_flag", f"SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN NOT ({_HOT}) WHEN 1 THEN floor(value) > 0 ELSE TRUE END AS detected FROM events")
def response_clean_flag(spark, sf_dir):
    return derived.responses(spark, sf_dir).select("event_id", Q.clean_flag_detected(F.col("raw_clean")).alias("detected"))


@query("response_scores", f"SELECT event_id, CAST({_V} AS DOUBLE) >= 50 AS detected FROM events")
def response_scores(spark, sf_dir):
    return derived.responses(spark, sf_dir).select("event_id", Q.score_detected(F.col("raw_scores"), 50.0).alias("detected"))


@query("response_file_matches",
       "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS matches, CASE WHEN event_id % 3 = 1 THEN 'failed' END AS error FROM events")
def response_file_matches(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, '[{"file_path":"a","matches":[{"category":"x"},{"category":"y"}]}]').when(
        F.col("event_id") % 3 == 1, '[{"file_path":"a","error":"failed","matches":[]}]').otherwise('[{"category":"x","confidence":0.4}]')
    rows = read_table(spark, sf_dir, "events").select("event_id", Q.file_matches(raw).alias("m"))
    return rows.select("event_id", "m.matches", "m.error")


@query("response_best_finding",
       f"SELECT event_id, CASE WHEN event_id % 6 < 2 THEN NULL WHEN CAST({_V} AS DOUBLE) > 0.5 THEN 'late' ELSE event_type END AS category, CASE WHEN event_id % 6 < 2 THEN NULL "
       f"WHEN CAST({_V} AS DOUBLE) > 0.5 THEN 'mod97' ELSE 'luhn' END AS validator, CASE WHEN event_id % 6 >= 2 THEN greatest(CAST({_V} AS DOUBLE), 0.5::DOUBLE) END AS confidence FROM events")
def response_best_finding(spark, sf_dir):
    best = Q.best_finding(F.col("raw_clean"))
    return derived.responses(spark, sf_dir).select("event_id", best.alias("f")).select("event_id", "f.category", "f.validator", "f.confidence")


@query("response_enrichment",
       "SELECT event_id, CASE WHEN value > 10 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN value > 10 THEN event_type END AS sub_category, "
       "CASE WHEN value > 10 THEN 'visa' ELSE 'other' END AS bin_brand, CASE WHEN value > 10 AND event_id % 2 = 0 THEN 'CA' END AS bin_country, "
       "CAST(NULL AS VARCHAR) AS bin_card_type, CASE WHEN value > 10 THEN 'bank ' || user_id END AS bin_issuer FROM events")
def response_enrichment(spark, sf_dir):
    """Two findings a response; the surer one gives its sub-category and what its metadata say of the card's issuer."""
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id")
    country = F.when(F.col("event_id") % 2 == 0, '"CA"').otherwise('""')
    raw = F.concat(F.lit('{"findings":[{"confidence":0.5,"bin_brand":"other","metadata":{"bin_brand":""}},{"confidence":'),
                   F.when(F.col("value") > 10, "0.9").otherwise("0.1"), F.lit(',"sub_category":"'), F.col("event_type"),
                   F.lit('","bin_brand":"low","metadata":{"bin_brand":"visa","bin_country":'), country, F.lit(',"bin_issuer":"bank '),
                   F.col("user_id").cast("string"), F.lit('"}}]}'))
    return e.select("event_id", Q.enrichment(Q.best_finding(raw)).alias("x")).select("event_id", "x.*")


# --- corpora ----------------------------------------------------------------------------------------------------------

CORPUS_CATEGORIES = ("credit_card", "email", "iban", "phone", "sin", "ssn")


def entries(spark, sf_dir):
    """One synthetic plain value per customer and category; the entry id is the customer's key and the category's place."""
    ids = spread(read_table(spark, sf_dir, "customer").select("c_custkey"))
    values = G.synthetic_values(ids, "c_custkey", list(CORPUS_CATEGORIES), SEED)
    place = F.array_position(F.array(*[F.lit(c) for c in CORPUS_CATEGORIES]), F.col("category")) - 1
    return values.select((F.col("c_custkey") * 6 + place).alias("entry_id"), "category", F.col("value").alias("plain_value"))


ENTRIES = " UNION ALL ".join(f"SELECT c_custkey * 6 + {i} AS entry_id, category, value AS plain_value FROM ({synth_sql(c)})" for i, c in enumerate(CORPUS_CATEGORIES))


def corpus(spark, sf_dir, **options):
    return G.build_corpus(entries(spark, sf_dir), seed=SEED, **options)


def corpus_sql(families, weights: dict[str, float], evasion_rate: float = 0.5, keyword_rate: float = 0.5, exhaustive: bool = False, language: str = "en", techniques=None) -> str:
    """The corpus in SQL: draw, family by cumulative weight, technique by place among the emitted, sentence."""
    names = sorted(families)
    emits = {"regional_digits": "regexp_matches(value, '[0-9]')", "morse_code": "regexp_matches(value, '[0-9]')",
             "leetspeak": "regexp_matches(value, '(?i)[aeiostlgbzqrkxhwmnucdfjpvy]')", "unicode_whitespace": "(raw <> value OR length(raw) > 4)"}
    ok = {g: "(" + (f"category IN {S.in_list(K.APPLICABLE[g])}" if g in K.APPLICABLE else "TRUE") + " AND " + emits.get(g, "TRUE") + ")" for g in names}
    listed = {g: "list_filter([" + ", ".join(
        f"CASE WHEN {keep.replace('variant', f'({e})')} THEN {{'t': '{t}', 'v': {e}}} END" for t, e, keep in S.VARIANTS[g] if techniques is None or t in techniques)
        + "], lambda x: x IS NOT NULL AND x.v IS NOT NULL)" for g in names if techniques is None or any(t in techniques for t, _, _ in S.VARIANTS[g])}
    if techniques is not None:  # a family counts if an allowed technique gives a variant
        ok = {g: f"({ok[g]} AND len({listed[g]}) > 0)" if g in listed else "FALSE" for g in names}
    upto = {g: "(" + " + ".join(f"CASE WHEN {ok[h]} THEN {float(weights[h])}::DOUBLE ELSE 0 END" for h in names[:i + 1]) + ")" for i, g in enumerate(names)}
    u = S.uniform(SEED, "family", "entry_id")
    test = (lambda g: ok[g]) if exhaustive else (lambda g: f"{ok[g]} AND {u} * {upto[names[-1]]} < {upto[g]}")
    family = "CASE " + " ".join(f"WHEN {test(g)} THEN '{g}'" for g in names) + " END"
    options = "CASE family " + " ".join(f"WHEN '{g}' THEN {o}" for g, o in listed.items()) + " END"
    pick = f"options[CAST(floor({S.uniform(SEED, 'technique', 'entry_id')} * len(options)) AS INT) + 1]"
    us = S.uniform(SEED, "sentence", "entry_id")
    texts = G.SENTENCES[language]
    one = lambda ts: f"({S.array(ts)})[CAST(floor({us} * {len(ts)}) AS INT) + 1]"
    sentence = "CASE category " + " ".join(f"WHEN '{c}' THEN {one(ts)}" for c, ts in texts.items() if c) + f" ELSE {one(texts[None])} END"
    return (
        f"SELECT entry_id, category, plain_value, variant_value, technique, generator, replace(technique, '_', ' ') AS transform_name, has_keywords, "
        f"CASE WHEN NOT own AND drawn THEN replace({sentence}, '{{value}}', variant_value) ELSE variant_value END AS embedded_text FROM ("
        f"SELECT *, own OR drawn AS has_keywords FROM (SELECT entry_id, category, value AS plain_value, coalesce(p.v, value) AS variant_value, p.t AS technique, "
        f"CASE WHEN p IS NOT NULL THEN family END AS generator, coalesce(p IS NOT NULL AND family = 'context_injection', FALSE) AS own, {S.uniform(SEED, 'keyword', 'entry_id')} < {keyword_rate} AS drawn "
        f"FROM (SELECT *, CASE WHEN len(options) > 0 THEN {pick} END AS p FROM (SELECT *, {options} AS options FROM (SELECT *, CASE WHEN {S.uniform(SEED, 'evade', 'entry_id')} < {evasion_rate} THEN {family} END AS family "
        f"FROM (SELECT entry_id, category, plain_value AS value, regexp_replace(plain_value, '[^A-Za-z0-9]', '', 'g') AS raw FROM ({ENTRIES})))))))"
    )


PICK = ("delimiter", "leetspeak", "structural", "context_injection", "bidirectional", "unicode_whitespace")
C_RANDOM = corpus_sql(PICK, {g: 1.0 for g in PICK})
EXPECTED = {"delimiter": 0.9, "leetspeak": 0.2, "structural": 0.5, "context_injection": 1.0, "bidirectional": 0.4}


def _corpus(spark, sf_dir):
    return corpus(spark, sf_dir, families=PICK)


@query("corpus_random", C_RANDOM)
def corpus_random(spark, sf_dir):
    return _corpus(spark, sf_dir)


@query("corpus_weighted", corpus_sql(PICK, G.family_weights("weighted", EXPECTED, PICK), 0.8, 0.3))
def corpus_weighted(spark, sf_dir):
    return corpus(spark, sf_dir, families=PICK, mode="weighted", expected=EXPECTED, evasion_rate=0.8, keyword_rate=0.3)


_ADV = G.family_weights("adversarial", EXPECTED, PICK)


@query("corpus_adversarial", corpus_sql(tuple(_ADV), _ADV))
def corpus_adversarial(spark, sf_dir):
    return corpus(spark, sf_dir, families=PICK, mode="adversarial", expected=EXPECTED)


@query("corpus_exhaustive", corpus_sql(PICK, {g: 1.0 for g in PICK}, exhaustive=True))
def corpus_exhaustive(spark, sf_dir):
    return corpus(spark, sf_dir, families=PICK, mode="exhaustive")


_MIX = {"structural": 0.75, "bidirectional": 0.25}


@query("corpus_technique_mix", corpus_sql(tuple(_MIX), _MIX, language="fr-CA"))
def corpus_technique_mix(spark, sf_dir):
    return corpus(spark, sf_dir, families=PICK, mix=_MIX, language="fr-CA")


_ALLOWED = ("uppercase", "hyphen_delimiter", "leet_minimal")


@query("corpus_allow_list", corpus_sql(PICK, {g: 1.0 for g in PICK}, 1.0, 0.3, techniques=_ALLOWED))
def corpus_allow_list(spark, sf_dir):
    """Three techniques allowed, every entry to be varied: those stay plain that no allowed technique changes."""
    return corpus(spark, sf_dir, families=PICK, techniques=_ALLOWED, evasion_rate=1.0, keyword_rate=0.3)


def _family_counts_sql(families) -> str:
    """Categories and families: the family drawn first, then one branch per family that asks for its emitted variants."""
    names = sorted(families)
    digit, letter = "regexp_matches(value, '[0-9]')", "regexp_matches(value, '(?i)[aeiostlgbzqrkxhwmnucdfjpvy]')"
    longest = "list_max(list_transform(string_split_regex(value, '[ \\t\\n,;''\"()\\[\\]{}=:]'), lambda t: length(t)))"
    emits = {"regional_digits": digit, "morse_code": digit, "leetspeak": letter, "unicode_whitespace": "(raw <> value OR length(raw) > 4)", "entropy_evasion": f"{longest} >= 4"}
    ok = {g: f"({f'category IN {S.in_list(K.APPLICABLE[g])}' if g in K.APPLICABLE else 'TRUE'} AND {emits.get(g, 'TRUE')})" for g in names}
    listed = ", ".join(f"CASE WHEN {ok[g]} THEN '{g}' END" for g in names)
    kept = {g: ", ".join(f"CASE WHEN {keep.replace('variant', f'({e})')} THEN {e} END" for _, e, keep in S.VARIANTS[g]) for g in names}
    branches = " UNION ALL ".join(
        f"SELECT category, CASE WHEN len(list_filter([{kept[g]}], lambda x: x IS NOT NULL)) > 0 THEN '{g}' END AS generator FROM f WHERE family = '{g}'"
        for g in names)
    return (f"WITH o AS (SELECT *, list_filter([{listed}], lambda x: x IS NOT NULL) AS options FROM (SELECT entry_id, category, plain_value AS value, regexp_replace(plain_value, '[^A-Za-z0-9]', '', 'g') AS raw FROM ({ENTRIES}))), "
            f"f AS MATERIALIZED (SELECT *, CASE WHEN {S.uniform(SEED, 'evade', 'entry_id')} < 0.5 THEN options[CAST(floor({S.uniform(SEED, 'family', 'entry_id')} * len(options)) AS INT) + 1] END AS family FROM o) "
            f"SELECT category, generator, count(*) AS n FROM ({branches} UNION ALL SELECT category, NULL AS generator FROM f WHERE family IS NULL) GROUP BY ALL")


@query("corpus_all_families", _family_counts_sql(FAMILIES))
def corpus_all_families(spark, sf_dir):
    """Every family, with equal weights."""
    return corpus(spark, sf_dir).groupBy("category", "generator").agg(F.count("*").alias("n"))


def _mode_sql() -> str:
    """Categories, rates and number of categories drawn by the same hashes, as one-row expressions."""
    keyed = ", ".join(f"({S.hashed(SEED, f'mode.categories.{i}', '0')}, '{c}')" for i, c in enumerate(sorted(CORPUS_CATEGORIES)))
    n = S.between(SEED, "mode.n", "0", 2, min(5, len(CORPUS_CATEGORIES)))
    chosen = f"SELECT c FROM (SELECT c, row_number() OVER (ORDER BY k, c) AS rn FROM (VALUES {keyed}) t(k, c)) WHERE rn <= {n}"
    rate = lambda salt: f"(0.2::DOUBLE + 0.6::DOUBLE * {S.uniform(SEED, salt, '0')})"
    rows = corpus_sql(PICK, {g: 1.0 for g in PICK}, rate("mode.evasion"), rate("mode.keyword"))
    return (f"SELECT coalesce(category, 'ALL') AS category, count(*) AS entries, count(technique) AS variants, count(*) FILTER (WHERE has_keywords) AS with_keywords, "
            f"{S.pct('count(technique)', 'count(*)')} AS variant_pct FROM ({rows}) WHERE category IN ({chosen}) GROUP BY ROLLUP (category)")


@query("corpus_random_mode", _mode_sql())
def corpus_random_mode(spark, sf_dir):
    """Categories and rates drawn from the seed."""
    drawn = G.random_parameters(SEED, CORPUS_CATEGORIES)
    chosen = entries(spark, sf_dir).filter(F.col("category").isin(*drawn["categories"]))
    return G.summarise(G.build_corpus(chosen, seed=SEED, evasion_rate=drawn["evasion_rate"], keyword_rate=drawn["keyword_rate"], families=PICK))


@query("corpus_summary", f"SELECT coalesce(category, 'ALL') AS category, count(*) AS entries, count(technique) AS variants, count(*) FILTER (WHERE has_keywords) AS with_keywords, "
                         f"{S.pct('count(technique)', 'count(*)')} AS variant_pct FROM ({C_RANDOM}) GROUP BY ROLLUP (category)")
def corpus_summary(spark, sf_dir):
    return G.summarise(_corpus(spark, sf_dir))


_TOTAL = 1003


@query("corpus_allocation",
       f"WITH c AS (SELECT DISTINCT c_mktsegment AS category FROM customer) SELECT category, CAST({_TOTAL} // k + CASE WHEN rn <= {_TOTAL} % k THEN 1 ELSE 0 END AS INT) AS n FROM "
       "(SELECT category, row_number() OVER (ORDER BY category) AS rn, count(*) OVER () AS k FROM c)")
def corpus_allocation(spark, sf_dir):
    segments = read_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    return G.allocate(segments, total=_TOTAL)


@query("corpus_plain_values",
       "WITH pool AS (SELECT n_regionkey, list_sort(list(n_name)) AS pool FROM nation GROUP BY n_regionkey) SELECT c_custkey AS idx, r_name AS category, "
       "pool[CAST(c_custkey % len(pool) AS INT) + 1] AS plain_value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN pool USING (n_regionkey)")
def corpus_plain_values(spark, sf_dir):
    """Categories without a synthetic rule rotate through their seeds: nation names, per region of the customer."""
    regions = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    seeds = regions.select(F.col("r_name").alias("category"), F.col("n_name").alias("value"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    wanted = customers.join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("category"), F.col("c_custkey").alias("idx"), F.lit(0).alias("n"), F.col("c_custkey").alias("entry_id"))
    return G.plain_values(wanted, seeds, SEED, []).select("category", "idx", "plain_value")


# --- sinks ------------------------------------------------------------------------------------------------------------

@query("sink_csv_rows", f"SELECT category, plain_value, variant_value, coalesce(technique, '') AS technique, coalesce(generator, '') AS generator, coalesce(transform_name, '') AS transform_name, "
                        f"CASE WHEN has_keywords THEN 'True' ELSE 'False' END AS has_keywords, embedded_text FROM ({C_RANDOM})")
def sink_csv_rows(spark, sf_dir):
    return sinks.csv_rows(_corpus(spark, sf_dir))


_INSIDE = "coalesce(generator = 'context_injection', FALSE)"
_VALUE = f"CASE WHEN {_INSIDE} THEN plain_value ELSE variant_value END"
_FILL_NAME = S.choice(SEED, "fill.name", "entry_id", sinks.NAMES["en"])
_FILL_ADDR = f"(CAST({S.between(SEED, 'fill.house', 'entry_id', 1, 999)} AS VARCHAR) || ' ' || {S.choice(SEED, 'fill.street', 'entry_id', sinks.STREETS['en'])})"
_FILL_DATE = f"strftime(DATE '1950-01-01' + {S.below(SEED, 'fill.date', 'entry_id', 18250)}, '%Y-%m-%d')"
_FILL_TS = f"strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds({S.below(SEED, 'fill.ts', 'entry_id', 31536000)}), '%Y-%m-%d %H:%M:%S')"
_FILL_AMOUNT = f"printf('%.2f', {S.between(SEED, 'fill.amount', 'entry_id', 1000, 500000)} / 100.0::DOUBLE)"
_FIELD = "CASE category " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in sinks.JSON_FIELDS.items()) + " ELSE category END"


@query("sink_json_records",
       f"SELECT entry_id, 'CUST-' || entry_id AS customer_id, {_FILL_NAME} AS name, {_FIELD} AS field, {_VALUE} AS value, CASE WHEN {_INSIDE} THEN variant_value END AS notes, technique AS evasion FROM ({C_RANDOM})")
def sink_json_records(spark, sf_dir):
    """The records read back from their JSON text."""
    parsed = sinks.json_records(_corpus(spark, sf_dir)).select("entry_id", F.from_json("record", "map<string,string>").alias("r"))
    own = ("customer_id", "name", "notes", "_evasion_technique", "_generator")
    field = F.map_filter("r", lambda k, v: ~k.isin(*own))
    return parsed.select("entry_id", F.col("r")["customer_id"].alias("customer_id"), F.col("r")["name"].alias("name"),
                         F.map_keys(field)[0].alias("field"), F.map_values(field)[0].alias("value"),
                         F.col("r")["notes"].alias("notes"), F.col("r")["_evasion_technique"].alias("evasion"))


def _wide_sql(language: str) -> str:
    names = sinks.WIDE_COLUMNS[language]
    default = {0: "'C-' || entry_id", 1: S.choice(SEED, "fill.name", "entry_id", sinks.NAMES[language]), 4: _FILL_DATE,
               5: f"(CAST({S.between(SEED, 'fill.house', 'entry_id', 1, 999)} AS VARCHAR) || ' ' || {S.choice(SEED, 'fill.street', 'entry_id', sinks.STREETS[language])})"}
    cols = []
    for i, n in enumerate(names[:-1]):
        holders = [c for c, slot in sinks.CATEGORY_SLOT.items() if slot == i]
        cols.append((f"CASE WHEN category IN {S.in_list(holders)} THEN {_VALUE} END" if holders else default[i]) + f" AS {n}")
    notes = f"CASE WHEN {_INSIDE} OR category NOT IN {S.in_list(sinks.CATEGORY_SLOT)} THEN embedded_text END AS notes"
    return f"SELECT {', '.join(cols)}, {notes} FROM ({C_RANDOM})"


def _wide(language):
    return lambda spark, sf_dir: sinks.wide_table(_corpus(spark, sf_dir), language)


query("sink_wide_table_en", _wide_sql("en"))(_wide("en"))
query("sink_wide_table_fr", _wide_sql("fr"))(_wide("fr"))

_SLOT = lambda cats: f"CASE WHEN category IN {S.in_list(cats)} THEN {_VALUE} END"


def _table(name):
    return lambda spark, sf_dir: sinks.relational_tables(_corpus(spark, sf_dir))[name]


query("sink_relational_customers", f"SELECT entry_id AS id, {_FILL_NAME} AS name, {_SLOT(['email'])} AS email, {_SLOT(['phone'])} AS phone, {_SLOT(['sin', 'ssn'])} AS sin, {_FILL_DATE} AS date_of_birth, "
      f"{_FILL_ADDR} AS address, CASE WHEN category NOT IN {S.in_list(sinks.RELATIONAL)} THEN embedded_text END AS notes FROM ({C_RANDOM}) WHERE category IN ('email', 'phone', 'sin', 'ssn') OR category NOT IN {S.in_list(sinks.RELATIONAL)}")(_table("customers"))
query("sink_relational_transactions", f"SELECT entry_id AS id, {_VALUE} AS card_number, {_FILL_AMOUNT} AS amount, {_FILL_TS} AS ts FROM ({C_RANDOM}) WHERE category = 'credit_card'")(_table("transactions"))
query("sink_relational_accounts", f"SELECT entry_id AS id, {_SLOT(['iban'])} AS iban, {_SLOT(['swift_bic'])} AS swift_bic, {_FILL_NAME} AS owner FROM ({C_RANDOM}) WHERE category IN ('iban', 'swift_bic')")(_table("accounts"))

_U = S.uniform(SEED, "log.level", "entry_id")
_LEVEL = "CASE " + " ".join(f"WHEN {_U} < {upto} THEN '{n}'" for n, upto in sinks.LOG_LEVELS[:-1]) + f" ELSE '{sinks.LOG_LEVELS[-1][0]}' END"
_ACTION = "CASE category " + " ".join(f"WHEN '{c}' THEN {S.choice(SEED, 'log.action', 'entry_id', ts)}" for c, ts in sinks.ACTIONS.items() if c) + f" ELSE {S.choice(SEED, 'log.action', 'entry_id', sinks.ACTIONS[None])} END"
_TAIL = "CASE WHEN technique IS NULL THEN '' ELSE '  # evasion: ' || technique END"


@query("sink_log_lines",
       f"SELECT entry_id, CASE {S.below(SEED, 'log.layout', 'entry_id', 3)} WHEN 0 THEN ts || ' ' || level || ' [' || service || '] ' || message WHEN 1 THEN ts || ' ' || level || ' service=' || service || ' action=\"' || message || '\" duration_ms=' || ms "
       f"ELSE 'json ' || message END || {_TAIL} AS line FROM (SELECT *, strftime(TIMESTAMP '2026-04-17 08:00:00' + to_seconds(entry_id % 31536000), '%Y-%m-%d %H:%M:%S') AS ts, {_LEVEL} AS level, {S.choice(SEED, 'log.service', 'entry_id', sinks.SERVICES)} AS service, "
       f"replace({_ACTION}, '{{value}}', variant_value) AS message, {S.between(SEED, 'log.ms', 'entry_id', 1, 500)} AS ms FROM ({C_RANDOM}))")
def sink_log_lines(spark, sf_dir):
    """Lines of the JSON layout are parsed back to their message, since writers escape differently."""
    lines = sinks.log_lines(_corpus(spark, sf_dir))
    body = F.regexp_extract("line", r"(?s)^(\{.*\})(  # evasion: [a-z0-9_]+)?$", 1)
    tail = F.regexp_extract("line", r"(?s)^\{.*\}(  # evasion: [a-z0-9_]+)?$", 1)
    message = F.get_json_object(body, "$.message")
    return lines.select("entry_id", F.when(F.col("line").startswith("{"), F.concat(F.lit("json "), message, tail)).otherwise(F.col("line")).alias("line"))


@query("sink_payments",
       f"SELECT 'PMT-' || entry_id AS id, 'E2E-' || entry_id AS e2e, {_FILL_NAME} AS debtor, {_FILL_AMOUNT} AS amount, {_SLOT(['iban'])} AS iban, CASE WHEN category = 'credit_card' THEN 'Card: ' || {_VALUE} "
       f"WHEN category NOT IN ('iban', 'swift_bic') THEN embedded_text END AS free FROM ({C_RANDOM})")
def sink_payments(spark, sf_dir):
    rows = sinks.payment_rows(_corpus(spark, sf_dir))
    return rows.select(F.col("PmtInfId").alias("id"), F.col("CdtTrfTxInf.PmtId.EndToEndId").alias("e2e"), F.col("Dbtr.Nm").alias("debtor"),
                       F.col("CdtTrfTxInf.Amt").alias("amount"), F.col("CdtTrfTxInf.CdtrAcct.Id.IBAN").alias("iban"), F.col("CdtTrfTxInf.RmtInf.Ustrd").alias("free"))


@query("source_payments_round_trip",
       f"SELECT 'PMT-' || entry_id AS id, 'E2E-' || entry_id AS e2e, {_FILL_NAME} AS debtor, {_FILL_AMOUNT} AS amount, {_SLOT(['iban'])} AS iban, CASE WHEN category = 'credit_card' THEN 'Card: ' || {_VALUE} "
       f"WHEN category NOT IN ('iban', 'swift_bic') THEN embedded_text END AS free FROM ({C_RANDOM})")
def source_payments_round_trip(spark, sf_dir):
    """The corpus as an XML message, read back."""
    path = _path(spark, "payments")
    sinks.write_payments(_corpus(spark, sf_dir), path)
    return readers.read_payments(spark, path)[0].select("id", "e2e", "debtor", "amount", "iban", "free")


@query("sink_sql_table",
       f"SELECT entry_id AS id, {_FILL_NAME} AS name, CASE WHEN category IN ('email', 'phone') THEN embedded_text END AS sensitive_val, " + ", ".join(
           f"CASE WHEN category IN {S.in_list([c for c, f in sinks.JSON_FIELDS.items() if f == n])} THEN {_VALUE} END AS {n}" for n in sinks.SQL_COLUMNS) + f" FROM ({C_RANDOM})")
def sink_sql_table(spark, sf_dir):
    return sinks.sql_table(_corpus(spark, sf_dir))


_NOISE = "CASE WHEN entry_id % 5 = 0 THEN chr(10) || (" + S.array(sinks.NOISE_LINES) + ")[CAST(entry_id % 3 AS INT) + 1] ELSE '' END"


@query("sink_documents", f"SELECT entry_id // 50 AS doc, count(*) AS lines, md5('DOCUMENT ' || (entry_id // 50) || chr(10) || string_agg('[' || category || '] ' || embedded_text || {_NOISE}, chr(10) ORDER BY entry_id) || chr(10) || 'END') AS digest FROM ({C_RANDOM}) GROUP BY entry_id // 50")
def sink_documents(spark, sf_dir):
    docs = sinks.assemble_documents(_corpus(spark, sf_dir), "generic", "medium", 50)
    return docs.select("doc", "lines", F.md5("text").alias("digest"))


def _layout_sql(layout: str, noise: str) -> str:
    header, line, footer = sinks.LAYOUTS[layout]
    text = f"replace(replace({S.lit(line)}, '{{category}}', category), '{{text}}', embedded_text)"
    extra = f"CASE WHEN entry_id % {sinks.NOISE[noise]} = 0 THEN chr(10) || ({S.array(sinks.NOISE_LINES)})[CAST(entry_id % {len(sinks.NOISE_LINES)} AS INT) + 1] ELSE '' END"
    head = f"replace({S.lit(header)}, '{{doc}}', CAST(entry_id // 50 AS VARCHAR))"
    return (f"SELECT entry_id // 50 AS doc, count(*) AS lines, md5(any_value({head}) || chr(10) || string_agg({text} || {extra}, chr(10) ORDER BY entry_id) || chr(10) || {S.lit(footer)}) AS digest "
            f"FROM ({C_RANDOM}) GROUP BY entry_id // 50")


def _layout(layout, noise):
    def run(spark, sf_dir):
        return sinks.assemble_documents(_corpus(spark, sf_dir), layout, noise, 50).select("doc", "lines", F.md5("text").alias("digest"))

    return run


for _i, _l in enumerate(n for n in sinks.LAYOUTS if n != "generic"):
    _n = list(sinks.NOISE)[_i % len(sinks.NOISE)]
    query(f"sink_documents_{_l}", _layout_sql(_l, _n))(_layout(_l, _n))


@query("sink_fillers", f"SELECT c_custkey AS entry_id, name, address, date, timestamp, amount FROM (SELECT c_custkey, c_custkey AS entry_id, {_FILL_NAME} AS name, {_FILL_ADDR} AS address, {_FILL_DATE} AS date, {_FILL_TS} AS timestamp, {_FILL_AMOUNT} AS amount FROM customer)")
def sink_fillers(spark, sf_dir):
    fake = sinks.fillers(F.col("c_custkey"), SEED)
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), *[fake[n].alias(n) for n in ("name", "address", "date", "timestamp", "amount")])


# --- sources: written to the shared folder and read back ----------------------------------------------------------------

def _path(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("source_csv_round_trip", f"SELECT category, count(*) AS n, count(*) FILTER (WHERE technique IS NOT NULL) AS variants, CAST(sum(CAST('0x' || substr(md5(plain_value || has_keywords), 1, 8) AS BIGINT)) AS BIGINT) AS checksum "
                                f"FROM (SELECT category, plain_value, technique, CASE WHEN has_keywords THEN 'True' ELSE 'False' END AS has_keywords FROM ({C_RANDOM})) GROUP BY category")
def source_csv_round_trip(spark, sf_dir):
    path = _path(spark, "corpus-csv")
    sinks.write_corpus(_corpus(spark, sf_dir), "csv", path)
    back = spark.read.schema(", ".join(f"{c} string" for c in sinks.CSV_COLUMNS)).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    digest = F.conv(F.substring(F.md5(F.concat("plain_value", "has_keywords")), 1, 8), 16, 10).cast("bigint")
    return back.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.coalesce("technique", F.lit("")) != "").alias("variants"), F.sum(digest).alias("checksum"))


@query("source_scan_documents",
       f"SELECT category, {S.COUNTS} FROM ({S.RESULTS}) GROUP BY category")
def source_scan_documents(spark, sf_dir):
    """Outcome rows written as scan documents with nested results, one per payload, and read back as rows."""
    path = _path(spark, "scans")
    o = derived.detection_run(spark, sf_dir, False, derived.payloads_by_id(spark, sf_dir))
    row = F.struct(
        F.struct(F.col("payload_value").alias("value"), "category", F.lit("structured").alias("category_type"), "label").alias("payload"),
        F.struct(F.col("variant").alias("value"), "generator", "technique", F.col("technique").alias("transform_name"), "strategy").alias("variant"),
        "detected", "severity", "error", "confidence")
    docs = o.groupBy("payload_id").agg(F.collect_list(row).alias("results"), F.count("*").alias("total")).select(
        F.struct(F.lit("2026-01-01T00:00:00+00:00").alias("timestamp"), F.lit("rules").alias("scanner"), "total").alias("meta"), "results")
    docs.write.json(path, compression="gzip")
    rows = readers.read_scans(spark, path, multi_line=False)
    from detectlab.operators.scoring import tallies

    return rows.groupBy("category").agg(*tallies())


@query("source_run_rows", f"SELECT strategy AS run_id, total, pass, fail, error, {S.pct('pass', 'total')} AS pass_rate, 'scan' AS type, n_categories FROM (SELECT strategy, count(DISTINCT category) AS n_categories, {S.COUNTS} FROM ({S.RESULTS}) GROUP BY strategy)")
def source_run_rows(spark, sf_dir):
    rows = readers.run_rows(derived.summary(spark, sf_dir).withColumn("run_id", F.col("strategy")))
    return rows.withColumn("n_categories", F.size("categories").cast("bigint")).drop("categories", "strategies")


_DAY = ("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS total, count(*) FILTER (WHERE value > 10) AS pass, count(*) FILTER (WHERE NOT value > 10) AS fail, " + ", ".join(
    f"round(count(*) FILTER (WHERE user_id % 4 = {i} AND value > 10)::DOUBLE / nullif(count(*) FILTER (WHERE user_id % 4 = {i}), 0), 4) AS r{i}" for i in range(4)) + " FROM events GROUP BY ALL")
RUNS = ("SELECT CAST(datediff('day', DATE '2024-01-01', day) * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS run_seq, CAST(day AS TIMESTAMP) AS ts, CASE WHEN event_type = 'purchase' THEN 'falsepos' ELSE 'scan' END AS type, event_type AS scanner_label, "
        "CASE WHEN event_type IN ('click', 'purchase') THEN 'web' ELSE 'cli' END AS tool, CASE WHEN event_type <> 'view' THEN 'scan-' || event_type END AS archive_file, total, pass, fail, "
        f"round(pass * 100.0::DOUBLE / total, 1) AS pass_rate, round(fail * 100.0::DOUBLE / total, 1) AS fp_rate, r0, r1, r2, r3 FROM ({_DAY})")


@query("source_run_log", f"SELECT type, scanner_label, count(*) AS runs, CAST(sum(total) AS BIGINT) AS total, CAST(sum(pass) AS BIGINT) AS pass, max(ts) AS last_ts FROM ({RUNS}) GROUP BY ALL")
def source_run_log(spark, sf_dir):
    """The run log appended as JSON lines with a broken and a blank line, and read back."""
    path = _path(spark, "runs")
    runs = derived.run_log(spark, sf_dir)
    lines = runs.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), *[c for c in runs.columns if c not in ("ts", "run_seq")])).alias("value"))
    lines.write.text(path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    back = readers.read_runs(spark, path)
    return back.groupBy("type", "scanner_label").agg(F.count("*").alias("runs"), F.sum("total").alias("total"), F.sum("pass").alias("pass"), F.max("ts").alias("last_ts"))


@query("source_payloads", f"SELECT category, count(*) AS n, count(DISTINCT value) AS different FROM ({PAY}) GROUP BY category")
def source_payloads(spark, sf_dir):
    """A user's payload table from CSV."""
    path = _path(spark, "payloads")
    derived.customer_payloads(spark, sf_dir).select("value", "category", "label").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_payloads(spark, path, "csv").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"))


_FLAGS = "SELECT event_type AS category, count(*) AS total, count(*) FILTER (WHERE value > 10) AS flagged FROM events GROUP BY 1"


def _flag_reports(spark, sf_dir):
    """One false-positive report per tool over event types, as JSON documents."""
    counted = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 10).alias("flagged"))
    item = F.struct("total", "flagged", (F.col("flagged") / F.col("total")).alias("false_positive_rate"), F.array().cast("array<string>").alias("flagged_values"))
    return counted.agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_type"), item))).alias("by_category"), F.sum("total").alias("total_tested"), F.sum("flagged").alias("total_flagged")).select(
        F.lit("scanner").alias("tool"), "total_tested", "total_flagged", "by_category")  # a few event types: one small document


@query("source_false_positives", f"WITH c AS ({_FLAGS}) SELECT 'scanner' AS tool, category, total, flagged, (SELECT CAST(sum(total) AS BIGINT) FROM c) AS total_tested FROM c")
def source_false_positives(spark, sf_dir):
    path = _path(spark, "fp-reports")
    _flag_reports(spark, sf_dir).write.json(path)
    return readers.read_false_positives(spark, path).select("tool", "category", "total", "flagged", "total_tested")


@query("source_dictionary", "SELECT DISTINCT 'part_name' AS category, 'part \"x\", ' || p_brand AS label, p_name AS value FROM part")
def source_dictionary(spark, sf_dir):
    """A dictionary with quotes and commas, through CSV and through JSON: the rows that both give."""
    values = read_table(spark, sf_dir, "part").select(
        F.lit("part_name").alias("category"), F.concat(F.lit('part "x", '), "p_brand").alias("label"), F.col("p_name").alias("value")).distinct()
    a, b = _path(spark, "dictionary-csv"), _path(spark, "dictionary-json")
    sinks.write_dictionary_csv(values, a)
    sinks.write_dictionary_json(values, b)
    return readers.read_dictionary(spark, a).intersect(readers.read_dictionary(spark, b, "json"))


@query("source_archive", "SELECT CAST(ts AS DATE) AS run_date, regexp_replace(event_type || ' / x', '[^A-Za-z0-9._-]', '_', 'g') AS scanner_label, count(*) AS n FROM events GROUP BY ALL")
def source_archive(spark, sf_dir):
    """Results archived by day and label in two appends; labels as folder names carry them."""
    path = _path(spark, "archive")
    events = read_table(spark, sf_dir, "events").select("ts", F.concat("event_type", F.lit(" / x")).alias("scanner_label"), "event_id", "value")
    for high in (True, False):
        readers.archive_runs(events.filter((F.col("value") > 10) == high), path)
    return spark.read.parquet(path).groupBy(F.col("run_date").cast("date").alias("run_date"), "scanner_label").agg(F.count("*").alias("n"))


@query("source_backfill", f"WITH c AS ({_FLAGS}) SELECT 'falsepos' AS type, CAST(sum(total) AS BIGINT) AS total FROM c UNION ALL SELECT 'scan' AS type, total FROM c")
def source_backfill(spark, sf_dir):
    """Loose documents of both kinds in one folder, and one of neither."""
    path = _path(spark, "loose")
    _flag_reports(spark, sf_dir).write.json(path)
    scans = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total"))
    meta = F.struct(F.lit("2026-04-19T06:00:00+00:00").alias("timestamp"), F.col("event_type").alias("scanner"), "total")
    document = F.to_json(F.struct(meta.alias("meta"), F.array().cast("array<struct<x:int>>").alias("results")))
    scans.select(document.alias("value")).write.option("maxRecordsPerFile", 1).mode("append").text(path)  # a document a file
    spark.range(1).select(F.lit('{"other": 1}').alias("value")).write.mode("append").text(path)
    rows = readers.backfill(spark, path)
    return rows.select("type", F.coalesce("total", "total_tested").alias("total"))


@query("source_run_order", f"SELECT row_number() OVER (ORDER BY day) AS run_seq, total, pass FROM (SELECT CAST(ts AS DATE) AS day, CAST(sum(total) AS BIGINT) AS total, CAST(sum(pass) AS BIGINT) AS pass FROM ({RUNS}) GROUP BY 1)")
def source_run_order(spark, sf_dir):
    """Runs appended one day first and all later days in a larger file after it: numbered in append order."""
    path = _path(spark, "ordered-runs")
    days = derived.run_log(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.sum("total").alias("total"), F.sum("pass").alias("pass"))
    day = F.first_value("day").over(Window.orderBy("day"))  # one row a day of the log
    marked = materialise(days.withColumn("first", F.col("day") == day), "days")
    for first in (True, False):
        runs = marked.filter(F.col("first") == first).select(
            F.lit("scan").alias("type"), F.date_format("day", "yyyy-MM-dd'T'00:00:00XXX").alias("timestamp"), "total", "pass")
        readers.append_runs(runs.coalesce(1), path)
    return readers.read_runs(spark, path).select("run_seq", "total", "pass")


@query("source_append_retry", f"SELECT row_number() OVER (ORDER BY week) AS run_seq, total, pass FROM (SELECT date_trunc('week', ts) AS week, CAST(sum(total) AS BIGINT) AS total, CAST(sum(pass) AS BIGINT) AS pass FROM ({RUNS}) GROUP BY 1)")
def source_append_retry(spark, sf_dir):
    """One append a week of runs; each is tried twice at the same time and once more after that, and leaves one."""
    path = _path(spark, "appended-runs")
    weeks = derived.run_log(spark, sf_dir).groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.sum("total").alias("total"), F.sum("pass").alias("pass"))
    weeks = materialise(weeks, "weeks")
    for (week,) in sorted(weeks.select("week").collect()):
        # The time says nothing here: all appends have the same one.
        runs = weeks.where(F.col("week") == F.lit(week)).select(F.lit("scan").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), "total", "pass")
        with ThreadPoolExecutor(2) as tries:
            numbers = set(tries.map(lambda _: readers.append_runs(runs, path, f"week {week:%Y-%m-%d}"), range(2)))  # noqa: B023
        numbers.add(readers.append_runs(runs, path, f"week {week:%Y-%m-%d}"))
        assert len(numbers) == 1
    return readers.read_runs(spark, path).select("run_seq", "total", "pass")


@query("source_missing_log", f"SELECT count(*) FILTER (WHERE run_seq < 0) AS runs, count(*) AS others FROM ({RUNS})")
def source_missing_log(spark, sf_dir):
    """A log that no run was appended to yet, beside one that has runs."""
    path = _path(spark, "no-runs")
    log = derived.run_log(spark, sf_dir).select("type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), "total")
    readers.append_runs(log, path, "all")
    both = readers.read_runs(spark, path + "-that-is-not-there").withColumn("there", F.lit(False)).unionByName(
        readers.read_runs(spark, path).withColumn("there", F.lit(True)))
    return both.agg(F.count_if(~F.col("there")).alias("runs"), F.count_if("there").alias("others"))


# --- history ----------------------------------------------------------------------------------------------------------

def _runs(spark, sf_dir):
    return derived.run_log(spark, sf_dir)


@query("history_dedupe", f"SELECT run_seq, scanner_label, total, pass FROM (SELECT *, row_number() OVER (PARTITION BY archive_file, scanner_label, tool, total, pass, fail, pass_rate ORDER BY run_seq) AS rn FROM ({RUNS})) WHERE archive_file IS NULL OR rn = 1")
def history_dedupe(spark, sf_dir):
    """The log read twice over, as after a repeated append: repeated lines of a run collapse, loose lines are kept once."""
    runs = _runs(spark, sf_dir)
    named = runs.filter(F.col("archive_file").isNotNull())
    return H.dedupe_runs(runs.unionByName(named)).select("run_seq", "scanner_label", "total", "pass")


@query("history_latest", f"SELECT run_seq, scanner_label, pass_rate, strftime(ts, 'R-%Y%m%dT%H%M%S') AS run_id FROM ({RUNS}) WHERE type = 'scan' ORDER BY run_seq DESC LIMIT 10")
def history_latest(spark, sf_dir):
    return H.dashboard_history(_runs(spark, sf_dir)).select("run_seq", "scanner_label", "pass_rate", "run_id")


@query("history_trend", f"SELECT run_seq, ts, strftime(ts, '%m-%d') AS day, scanner_label, pass_rate AS rate FROM ({RUNS}) WHERE type = 'scan' AND scanner_label = 'click' ORDER BY run_seq DESC LIMIT 12")
def history_trend(spark, sf_dir):
    return H.trend(_runs(spark, sf_dir), "scan", 12, "click")


@query("history_fp_trend", f"SELECT run_seq, ts, strftime(ts, '%m-%d') AS day, scanner_label, fp_rate AS rate FROM ({RUNS}) WHERE type = 'falsepos' ORDER BY run_seq DESC LIMIT 8")
def history_fp_trend(spark, sf_dir):
    return H.trend(_runs(spark, sf_dir), "falsepos", 8)


@query("history_trend_by_label", f"SELECT * FROM (SELECT run_seq, scanner_label, pass_rate AS rate, row_number() OVER (PARTITION BY scanner_label ORDER BY run_seq DESC) AS rn FROM ({RUNS}) WHERE type = 'scan') WHERE rn <= 5")
def history_trend_by_label(spark, sf_dir):
    return H.trend_by_label(_runs(spark, sf_dir), "scan", 5).withColumn("rn", F.col("rn").cast("bigint"))


@query("history_pair_false_positives",
       f"WITH r AS ({RUNS}) SELECT s.run_seq, s.scanner_label, s.tool, s.pass_rate, max(f.run_seq) AS fp_run_seq, arg_max(f.fp_rate, f.run_seq) AS fp_rate FROM (SELECT * FROM r WHERE type = 'scan') s LEFT JOIN "
       "(SELECT * FROM r WHERE type = 'falsepos') f ON f.scanner_label = s.scanner_label OR f.tool = s.tool GROUP BY ALL")
def history_pair_false_positives(spark, sf_dir):
    return H.pair_with_false_positives(_runs(spark, sf_dir))


@query("history_baseline", f"SELECT run_seq, scanner_label AS label, pass_rate, lag(pass_rate) OVER w AS baseline, round(pass_rate - lag(pass_rate) OVER w, 1) AS delta_pp FROM ({RUNS}) WHERE type = 'scan' WINDOW w AS (PARTITION BY scanner_label ORDER BY run_seq)")
def history_baseline(spark, sf_dir):
    return H.automatic_baseline(_runs(spark, sf_dir))


_POINTS = " UNION ALL ".join(f"SELECT run_seq, ts, '{t}' AS technique, r{i} AS rate FROM r WHERE r{i} IS NOT NULL" for i, t in enumerate(derived.HISTORY_TECHNIQUES))
_HIST = (f"WITH r AS ({RUNS}), p AS ({_POINTS}), q AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY run_seq DESC) AS rn FROM p) SELECT technique, count(*) AS runs, avg(rate) AS average, max(rate) FILTER (WHERE rn = 1) AS latest, "
         "max(ts) AS last_seen, max(rate) FILTER (WHERE rn = 2) AS previous FROM q GROUP BY technique")


def _history(spark, sf_dir):
    return H.technique_history(_runs(spark, sf_dir))


@query("history_techniques", f"SELECT technique, runs, round(average, 6) AS average, latest, last_seen, previous, round(latest - previous, 6) AS delta FROM ({_HIST})")
def history_techniques(spark, sf_dir):
    return _history(spark, sf_dir).withColumn("average", F.round("average", 6)).withColumn("delta", F.round("delta", 6))


@query("history_techniques_last", "WITH r AS (SELECT * FROM (" + RUNS + f") ORDER BY run_seq DESC LIMIT 20), p AS ({_POINTS}) SELECT technique, count(*) AS runs, array_to_string(list(printf('%.4f', rate) ORDER BY run_seq), ',') AS history FROM p GROUP BY technique")
def history_techniques_last(spark, sf_dir):
    rows = H.technique_history(_runs(spark, sf_dir), last_n=20)
    return rows.select("technique", "runs", F.array_join(F.transform("history", lambda r: F.format_string("%.4f", r)), ",").alias("history"))


@query("history_rank", f"SELECT technique, latest, CASE WHEN (latest - previous) * 100 > 0.5 THEN 'up' WHEN (latest - previous) * 100 < -0.5 THEN 'down' ELSE 'flat' END AS arrow FROM ({_HIST}) WHERE contains(technique, 'h') ORDER BY latest DESC, technique LIMIT 3")
def history_rank(spark, sf_dir):
    return H.rank_history(_history(spark, sf_dir), min_runs=2, top=3, contains="H").select("technique", "latest", "arrow")


_CAT = " UNION ALL ".join(f"SELECT '{g}' AS generator, '{t.name}' AS technique, {t.ordinal} AS ordinal" for g, ts in FAMILIES.items() for t in ts) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{g}', '{t}', {o}" for g, t, o in NORMALISED)
_SEEDS = " UNION ALL ".join(f"SELECT '{g}' AS generator, {w}::DOUBLE AS seed" for g, w in H.SEED_WEIGHTS.items())
_TSEEDS = " UNION ALL ".join(f"SELECT '{g}' AS technique, {w}::DOUBLE AS tseed" for g, w in H.TECHNIQUE_SEEDS.items())


@query("history_seed_blend",
       f"WITH c AS ({_CAT}), h AS (SELECT generator, avg(average) AS pass_rate FROM ({_HIST}) JOIN (SELECT DISTINCT technique, generator FROM c) USING (technique) GROUP BY generator) "
       f"SELECT generator, round(0.7::DOUBLE * coalesce(pass_rate, 0.5::DOUBLE) + 0.3::DOUBLE * (1 - coalesce(seed, 0.5::DOUBLE)), 6) AS expected_pass_rate FROM h FULL JOIN ({_SEEDS}) USING (generator)")
def history_seed_blend(spark, sf_dir):
    folded = H.history_by_generator(_history(spark, sf_dir), technique_catalogue(spark))
    return H.blend_seeds(folded).withColumn("expected_pass_rate", F.round("expected_pass_rate", 6))


@query("history_fast_subset",
       f"WITH c AS ({_CAT}), h AS ({_HIST}), w AS (SELECT c.*, CASE WHEN average IS NULL THEN coalesce(tseed, seed, 0.5::DOUBLE) ELSE 0.7::DOUBLE * greatest(0, least(1, 1 - average)) + 0.3::DOUBLE * coalesce(tseed, seed, 0.5::DOUBLE) END AS weight "
       f"FROM c LEFT JOIN h USING (technique) LEFT JOIN ({_SEEDS}) USING (generator) LEFT JOIN ({_TSEEDS}) USING (technique)) SELECT generator, technique, round(weight, 6) AS weight, rn AS rank, rn <= 5 AND weight >= 0.1 AS kept FROM "
       "(SELECT *, row_number() OVER (PARTITION BY generator ORDER BY weight DESC, ordinal) AS rn FROM w)")
def history_fast_subset(spark, sf_dir):
    return H.fast_subset(_history(spark, sf_dir), technique_catalogue(spark)).withColumn("weight", F.round("weight", 6))


@query("history_restrict", f"WITH c AS ({_CAT}) SELECT technique, generator FROM c SEMI JOIN (SELECT technique FROM ({_HIST}) WHERE average <= 0.82) USING (technique)")
def history_restrict(spark, sf_dir):
    return H.restrict_by_history(technique_catalogue(spark), _history(spark, sf_dir), 0.82).select("technique", "generator")


@query("catalogue_observed_rates", f"SELECT generator, technique, ordinal, latest AS observed_rate FROM ({_CAT}) LEFT JOIN ({_HIST}) USING (technique)")
def catalogue_observed_rates(spark, sf_dir):
    return H.observed_rates(technique_catalogue(spark), _history(spark, sf_dir))
