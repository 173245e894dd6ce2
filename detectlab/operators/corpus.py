"""Labelled corpora: allocation, plain values, variant choice, keyword sentences, summary, false-positive corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectlab.functions import draws as D
from detectlab.functions.nearmiss import near_miss, wrap_in_context
from detectlab.functions.synth import SYNTHS, corpus_card, synth
from detectlab.functions.text import alnum, let
from detectlab.operators import variants as X
from detectlab.operators.history import NEUTRAL, SEED_WEIGHTS
from detectlab.operators.rates import null_safe_join, number_in_group, pct

EVASION_MODES = ("random", "weighted", "adversarial", "exhaustive")
WEIGHT_FLOOR = 0.05
CHUNK_ROWS = 1 << 16
# The families that ``emits`` has a rule for: those of the library itself.
WHOLE_FAMILIES = frozenset(X.FAMILIES)

# Sentences that give a value its context, per category and language.
SENTENCES = {
    "en": {
        "credit_card": ("Payment card {value} was charged today.", "Card on file: {value}.", "Visa payment from {value}."),
        "ssn": ("Employee SSN: {value}.", "Social security number {value} is verified.", "W-2 issued to SSN {value}."),
        "sin": ("SIN on record: {value}.", "Social insurance number {value} is verified.", "T4 issued for SIN {value}."),
        "iban": ("Wire transfer to IBAN {value}.", "Bank account (IBAN): {value}."),
        "email": ("Contact email: {value}.", "Mail was sent to the address {value}."),
        "phone": ("Call back on phone number {value}.", "Customer phone: {value}."),
        "ca_ramq": ("Quebec health card RAMQ {value}.", "RAMQ number on file: {value}."),
        None: ("Reference value: {value}.", "Confidential record: {value}."),
    },
    "fr-CA": {
        "credit_card": ("La carte {value} a été débitée.", "Carte au dossier : {value}."),
        "ssn": ("Numéro SSN de l'employé : {value}.",),
        "sin": ("NAS au dossier : {value}.", "Feuillet T4 émis pour le NAS {value}."),
        "iban": ("Virement vers IBAN {value}.",),
        "email": ("Adresse de courriel (email) : {value}.",),
        "phone": ("Numéro de téléphone : {value}.",),
        "ca_ramq": ("Carte RAMQ au dossier : {value}.",),
        None: ("Valeur de référence : {value}.",),
    },
}


def allocate(categories: DataFrame, count: int = 100, per_category: dict[str, int] | None = None,
             total: int | None = None) -> DataFrame:
    """category, n: ``count`` each, own counts where given, or ``total`` split evenly with the remainder to the first
    categories in name order. One row per category."""
    if total is not None:
        spot = F.row_number().over(Window.orderBy("category")) - 1
        size = categories.agg(F.count("*").alias("k"))
        return categories.crossJoin(F.broadcast(size)).select("category", (
            F.floor(F.lit(total) / F.col("k")) + F.when(spot < F.lit(total) % F.col("k"), 1).otherwise(0)
        ).cast("int").alias("n"))
    n = F.lit(count)
    for name, own in (per_category or {}).items():
        n = F.when(F.col("category") == name, own).otherwise(n)
    return categories.select("category", n.cast("int").alias("n"))


def entries_for(allocation: DataFrame) -> DataFrame:
    """One row per entry: category, idx, n, entry_id. Ids are dense: those of a category follow those of the one before.

    A category is cut into chunks of ``CHUNK_ROWS``, the few chunk rows are dealt out, and each makes its own entries, so a
    large category uses all tasks and the entries themselves are not shuffled.
    """
    earlier = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)  # one row a category
    placed = allocation.filter(F.col("n") > 0).withColumn("__first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(CHUNK_ROWS).cast("long"))
    chunks = placed.withColumn("__chunk", F.explode(starts)).repartition("category", "__chunk")
    ends = F.least(F.col("__chunk") + CHUNK_ROWS, F.col("n").cast("long")) - 1
    return chunks.withColumn("idx", F.explode(F.sequence("__chunk", ends))).select(
        "category", "idx", "n", (F.col("__first") + F.col("idx")).alias("entry_id"))


def plain_values(entries: DataFrame, seeds: DataFrame, seed: int, categories: Sequence[str]) -> DataFrame:
    """Adds plain_value: synthetic where a rule exists and more entries than seeds are wanted, else seeds in turn.

    ``entries`` has category, idx, n and entry_id; ``seeds`` is a catalogue with category and value, of any size. Seeds are
    numbered within their category, and an entry is joined with the one whose turn it is. Cards are always synthetic.
    """
    turns = number_in_group(seeds.select("category", "value"), ["category"], ["value"], "__turn")
    sizes = turns.groupBy("category").agg(F.count("*").alias("__size"))
    turns = turns.select("category", (F.col("__turn") - 1).alias("__turn"), F.col("value").alias("__seed"))
    sized = null_safe_join(entries, sizes, ["category"], "left").withColumn("__turn", F.pmod(F.col("idx").cast("long"), F.col("__size")))
    joined = null_safe_join(sized, turns, ["category", "__turn"], "left")
    drawn = F.lit(None).cast("string")
    for name in categories:
        build = corpus_card if name == "credit_card" else SYNTHS.get(name)
        if build is not None:
            drawn = F.when(F.col("category") == name, build(seed, F.col("entry_id"))).otherwise(drawn)
    turn = F.col("__seed")
    wanted = (F.col("category") == "credit_card") | (F.col("n") > F.coalesce("__size", F.lit(0)))
    return joined.withColumn("plain_value", F.when(wanted, F.coalesce(drawn, turn)).otherwise(turn)).drop(
        "__size", "__turn", "__seed")


def emits(generator: str, value: Column, techniques: Sequence[str] | None = None) -> Column:
    """Whether a family gives at least one variant of the value, by the techniques that are allowed.

    For a whole family of the library this is a short rule. Families with a part of their techniques, and families added by
    ``register_transform``, are asked technique by technique.
    """
    if techniques is not None or generator not in WHOLE_FAMILIES:
        parts = X.Parts.direct(value)
        given = [_if_kept(t, value)(t.build(parts)).isNotNull() for t in X.FAMILIES[generator] if techniques is None or t.name in techniques]
        return reduce(lambda x, y: x | y, given, F.lit(False))
    raw = alnum(value)
    if generator in ("regional_digits", "morse_code"):
        return value.rlike("[0-9]")
    if generator == "leetspeak":
        return value.rlike("(?i)[aeiostlgbzqrkxhwmnucdfjpvy]")
    if generator == "entropy_evasion":
        return F.length(X.longest_token(value)) >= 4
    if generator == "unicode_whitespace":
        return (raw != value) | (F.length(raw) > 4)
    return F.lit(True)


def family_weights(mode: str, expected: dict[str, float] | None, families: Sequence[str],
                   mix: dict[str, float] | None = None) -> dict[str, float]:
    """Weight per family. ``expected`` is the expected pass rate per family (history blended with priors).

    Without any history the priors stand alone, as in ``history.blend_seeds``.
    """
    if mode not in EVASION_MODES:
        raise ValueError(f"unknown evasion mode {mode!r}; one of {', '.join(EVASION_MODES)}")
    if mix:
        return {g: w for g, w in mix.items() if w > 0 and g in families}
    if expected is None:
        expected = {g: 1 - SEED_WEIGHTS.get(g, NEUTRAL) for g in families}
    rate = lambda g: expected.get(g, NEUTRAL)
    if mode == "weighted":
        return {g: max(1.0 - rate(g), WEIGHT_FLOOR) for g in families}
    if mode == "adversarial":
        kept = [g for g in families if rate(g) <= 0.5]
        return {g: 1.0 for g in (kept or families)}
    return {g: 1.0 for g in families}


def choose_family(value: Column, category: Column, u: Column, weights: dict[str, float], mode: str,
                  applicable: dict[str, Sequence[str]] | None = None, techniques: Sequence[str] | None = None) -> Column:
    """A family among those that apply and give a variant, by weight; the first by name in exhaustive mode."""
    names = sorted(weights)
    options = F.array_compact(F.array(*[
        F.when(X.applies(g, category, applicable) & emits(g, value, techniques),
               F.struct(F.lit(g).alias("g"), F.lit(float(weights[g])).alias("w"))) for g in names]))
    if mode == "exhaustive":
        return F.get(options, F.lit(0))["g"]

    def pick(opts: Column) -> Column:
        whole = F.aggregate(opts, F.lit(0.0), lambda acc, o: acc + o["w"])
        seed = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("g"))
        walked = F.aggregate(opts, seed, lambda acc, o: F.struct(
            (acc["upto"] + o["w"]).alias("upto"),
            F.coalesce(acc["g"], F.when(u * whole < acc["upto"] + o["w"], o["g"])).alias("g")))
        return walked["g"]

    return let(options, pick)


def build_corpus(
    entries: DataFrame, seed: int = 42, evasion_rate: float = 0.5, keyword_rate: float = 0.5, language: str = "en",
    mode: str = "random", expected: dict[str, float] | None = None, families: Sequence[str] | None = None,
    techniques: Sequence[str] | None = None, mix: dict[str, float] | None = None,
    evasion_per_category: dict[str, float] | None = None, opt_in: Sequence[str] = (),
) -> DataFrame:
    """Corpus rows from entries with category, plain_value and entry_id. Narrow: every draw depends on the entry alone.

    Only the chosen family of an entry is expanded, so an entry costs one family and not all of them. Families in
    ``opt_in`` are left out unless named in ``families`` or ``mix``.
    """
    names = [g for g in (families or X.FAMILIES) if families or g not in opt_in or (mix and g in mix)]
    weights = family_weights(mode, expected, names, mix)
    eid, cat, plain = F.col("entry_id"), F.col("category"), F.col("plain_value")
    rate = F.lit(float(evasion_rate))
    for name, own in (evasion_per_category or {}).items():
        rate = F.when(cat == name, float(own)).otherwise(rate)
    keys = entries.columns
    chosen = entries.withColumn("__do", D.uniform(seed, "evade", eid) < rate).withColumn(
        "__family", F.when(F.col("__do"), choose_family(plain, cat, D.uniform(seed, "family", eid), weights, mode, techniques=techniques)))
    base = X.project_parts_of_family(chosen, "plain_value", "__family", list(weights))
    parts = X.Parts(plain)
    options = F.lit(None)
    for g in weights:
        built = F.array_compact(F.array(*[
            let(t.build(parts), _if_kept(t, plain)) for t in X.FAMILIES[g]
            if techniques is None or t.name in techniques]))
        options = F.when(F.col("__family") == g, built).otherwise(options)
    u = D.uniform(seed, "technique", eid)

    def pick(opts: Column) -> Column:
        return F.get(opts, F.floor(u * F.size(opts)).cast("int"))

    # Expanding the one pick keeps filters on the corpus above it, instead of copying the choice into each of them.
    picked = base.select(*keys, "__family", F.inline(F.array(let(let(options, pick), lambda v: F.struct(
        v["technique"].alias("technique"), v["value"].alias("__value"))))))
    out = picked.select(
        *keys, F.coalesce(F.col("__value"), plain).alias("variant_value"), "technique",
        F.when(F.col("technique").isNotNull(), F.col("__family")).alias("generator"),
        F.replace(F.col("technique"), F.lit("_"), F.lit(" ")).alias("transform_name"))
    return embed(out, seed, keyword_rate, language)


def _if_kept(technique: X.Technique, plain: Column):
    def keep(v: Column) -> Column:
        ok = v.isNotNull() if technique.kept == X.KEPT_ALWAYS else (v != plain)
        return F.when(ok, F.struct(F.lit(technique.name).alias("technique"), v.alias("value")))

    return keep


def sentence(category: Column, value: Column, u: Column, language: str = "en") -> Column:
    if language not in SENTENCES:
        raise ValueError(f"unknown language {language!r}; one of {', '.join(SENTENCES)}")
    pick = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]),
                                      (F.floor(u * len(texts)) + 1).cast("int"))
    table = SENTENCES[language]
    template = pick(table[None])
    for name, texts in table.items():
        if name is not None:
            template = F.when(category == name, pick(texts)).otherwise(template)
    return F.replace(template, F.lit("{value}"), value)


def embed(corpus: DataFrame, seed: int, keyword_rate: float, language: str = "en") -> DataFrame:
    """Adds has_keywords and embedded_text; a variant that is a sentence already keeps it and counts."""
    own = F.coalesce(F.col("generator") == "context_injection", F.lit(False))
    drawn = D.uniform(seed, "keyword", F.col("entry_id")) < keyword_rate
    wrapped = sentence(F.col("category"), F.col("variant_value"), D.uniform(seed, "sentence", F.col("entry_id")), language)
    return corpus.withColumn("has_keywords", own | drawn).withColumn(
        "embedded_text", F.when(~own & drawn, wrapped).otherwise(F.col("variant_value")))


def random_parameters(seed: int, categories: Sequence[str]) -> dict:
    """2 to 5 categories and both rates in [0.2, 0.8], drawn from the seed."""
    most = min(5, len(categories))
    n = 2 + int(D.uniform_of(seed, "mode.n", 0) * (most - 2 + 1))
    order = D.permutation_of(seed, "mode.categories", 0, sorted(categories))
    return {"categories": sorted(order[:n]), "evasion_rate": 0.2 + 0.6 * D.uniform_of(seed, "mode.evasion", 0),
            "keyword_rate": 0.2 + 0.6 * D.uniform_of(seed, "mode.keyword", 0)}


def summarise(corpus: DataFrame) -> DataFrame:
    """Entries, variants and variant share per category, and the totals (category ``ALL``), in one pass."""
    return corpus.rollup("category").agg(
        F.count("*").alias("entries"), F.count("technique").alias("variants"),
        F.count_if("has_keywords").alias("with_keywords"), F.grouping("category").alias("g"),
    ).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("category")).alias("category"), "entries", "variants",
             "with_keywords", pct(F.col("variants"), F.col("entries")).alias("variant_pct"))


def near_miss_corpus(ids: DataFrame, key: str, categories: Sequence[str], seed: int = 42, wrap: bool = False) -> DataFrame:
    """One near-miss per row and category: key, category, value, text."""
    rows = ids.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), near_miss(c, seed, F.col(key)).alias("value")) for c in categories])))
    text = wrap_in_context(F.col("category"), F.col("value")) if wrap else F.col("value")
    return rows.withColumn("text", text)


def synthetic_values(ids: DataFrame, key: str, categories: Sequence[str], seed: int = 42) -> DataFrame:
    """One valid value per row and category: key, category, value."""
    return ids.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), synth(c, seed, F.col(key)).alias("value")) for c in categories])))
