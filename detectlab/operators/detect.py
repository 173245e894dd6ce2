"""Rule detection over text columns: spans, context gate, normalisation, layered decoding, detection runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.functions import checks as C
from detectlab.functions import encodings as E
from detectlab.functions import fixed
from detectlab.functions.text import digits_only, let, starts_in_order
from detectlab.functions.unicode import normal_form, unescape_named
from detectlab.operators.variants import HOMOGLYPH_FROM, HOMOGLYPH_TO

EXACT, CHECKED, SHAPED = 1.0, 0.95, 0.6


@dataclass(frozen=True)
class Rule:
    """A shape, what confirms it, its form without delimiters, and the words that make a match plausible."""

    pattern: str
    confirm: Callable[[Column], Column] | None
    compact: str | None
    confirm_compact: Callable[[Column], Column] | None
    keywords: str
    confidence: float
    needs: str = ""  # text without this cannot match
    by_default: bool = True  # else only where the category is asked for by name: bare shapes that plain numbers have too


def _card_valid(value: Column) -> Column:
    return C.luhn_valid(digits_only(value))


def _bare_ssn_valid(value: Column) -> Column:
    return C.ssn_valid(F.concat_ws("-", F.substring(value, 1, 3), F.substring(value, 4, 2), F.substring(value, 6, 4)))


RULES: dict[str, Rule] = {
    "credit_card": Rule(r"[0-9]{13,19}|(?:[0-9]{4}[ .-]){3}[0-9]{2,4}(?:[ .-][0-9]{1,3})?", _card_valid, r"[0-9]{13,19}", C.luhn_valid,
                        "card|visa|pan|payment|carte", CHECKED),
    "ssn": Rule(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", C.ssn_valid, r"[0-9]{9}", _bare_ssn_valid,
                "ssn|social security|w-2", CHECKED),
    "sin": Rule(r"[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}", C.sin_valid, r"[0-9]{9}", C.sin_valid,
                "sin|social insurance|nas|t4", CHECKED),
    "iban": Rule(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", C.iban_valid, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", C.iban_valid,
                 "iban|wire|transfer|bank", CHECKED),
    "email": Rule(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", None, None, None,
                  "mail|contact|address", SHAPED, "@"),
    "phone": Rule(r"\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}", None, r"1[2-9][0-9]{9}", None, "phone|call|tel", SHAPED, "+1-"),
    "ca_ramq": Rule(r"[A-Z]{4} [0-9]{4} [0-9]{4}", C.ramq_valid, r"[A-Z]{4}[0-9]{8}", C.ramq_valid,
                    "ramq|quebec|health", CHECKED),
    "ipv4_address": Rule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", None, None, None, "ip|host|server", SHAPED),
    "aws_key": Rule(r"AKIA[0-9A-Z]{16}", None, r"AKIA[0-9A-Z]{16}", None, "aws|key", SHAPED, "AKIA"),
    "jwt": Rule(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", None, None, None, "token|bearer|auth", SHAPED, "eyJ"),
    "cusip_num": Rule(r"[0-9A-Z]{8}[0-9]", C.cusip_valid, r"[0-9A-Z]{8}[0-9]", C.cusip_valid, "cusip|security|bond", CHECKED, by_default=False),
    "sedol_num": Rule(r"[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]", C.sedol_valid, r"[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]", C.sedol_valid, "sedol|security|stock",
                      CHECKED, by_default=False),
    "isin": Rule(r"[A-Z]{2}[0-9A-Z]{9}[0-9]", C.isin_valid, r"[A-Z]{2}[0-9A-Z]{9}[0-9]", C.isin_valid, "isin|security|bond|stock", CHECKED,
                 by_default=False),
    "figi_num": Rule(r"[B-DF-HJ-NP-TV-Z]{2}G[0-9B-DF-HJ-NP-TV-Z]{8}[0-9]", C.figi_valid, r"[B-DF-HJ-NP-TV-Z]{2}G[0-9B-DF-HJ-NP-TV-Z]{8}[0-9]",
                     C.figi_valid, "figi|instrument", CHECKED, by_default=False),
    "lei_num": Rule(r"[0-9A-Z]{18}[0-9]{2}", C.lei_valid, r"[0-9A-Z]{18}[0-9]{2}", C.lei_valid, "lei|legal entity", CHECKED, by_default=False),
    "br_cpf": Rule(r"[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}", C.cpf_valid, r"[0-9]{11}", C.cpf_valid, "cpf|contribuinte", CHECKED, by_default=False),
    "de_tax_id": Rule(r"[1-9][0-9]{10}", C.de_tax_valid, r"[1-9][0-9]{10}", C.de_tax_valid, "steuer|tax", CHECKED, by_default=False),
    "au_medicare": Rule(r"[2-6][0-9]{3} [0-9]{5} [0-9]", C.medicare_valid, r"[2-6][0-9]{9}", C.medicare_valid, "medicare", CHECKED, by_default=False),
    "uk_nin": Rule(r"[A-Z]{2} [0-9]{2} [0-9]{2} [0-9]{2} [A-D]", C.nin_valid, r"[A-Z]{2}[0-9]{6}[A-D]", C.nin_valid, "national insurance|nino",
                   CHECKED, by_default=False),
}


def register_detector(category: str, rule: Rule) -> None:
    RULES[category] = rule


def _rules(categories: Sequence[str] | None) -> dict[str, Rule]:
    names = [c for c, r in RULES.items() if r.by_default] if categories is None else list(categories)
    unknown = [c for c in names if c not in RULES]
    if unknown:
        raise ValueError(f"no detection rule for {unknown}")
    return {c: RULES[c] for c in names}


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def find_spans(
    df: DataFrame, keys: Sequence[str], text: str = "text", categories: Sequence[str] | None = None,
    gate: bool = False, window: int = fixed.GATE_WINDOW,
) -> DataFrame:
    """One row per confirmed match: keys, category, match, 1-based start. One narrow stage, no shuffle.

    ``gate`` keeps a match only where a keyword of its category stands within ``window`` characters.
    """
    rules = _rules(categories)
    def matches(rule: Rule) -> Column:
        found = extract(F.col(text), rule.pattern)
        return F.when(F.contains(F.col(text), F.lit(rule.needs)), found) if rule.needs else found

    every = F.array(*[F.struct(F.lit(c).alias("category"), matches(r).alias("matches")) for c, r in rules.items()])
    # Only categories with matches are expanded, so a text is not copied once per rule.
    hits = F.filter(every, lambda x: F.size(x["matches"]) > 0)
    found = df.select(*keys, F.col(text).alias("__text"), hits.alias("__found")).select(
        *keys, "__text", F.inline("__found"))
    # The pieces are cut rule by rule, so that each pattern stays a literal and is compiled once.
    pieces = F.lit(None).cast("array<string>")
    for category, rule in rules.items():
        pieces = F.when(F.col("category") == category, F.split(F.col("__text"), rule.pattern)).otherwise(pieces)
    spans = found.select(
        *keys, "category", "__text",
        F.posexplode(F.arrays_zip(
            F.col("matches").alias("match"),
            starts_in_order(F.col("__text"), pieces, F.col("matches")).alias("start"),
        )).alias("ordinal", "__hit"),
    ).select(*keys, "category", "__text", F.col("__hit.match").alias("match"), F.col("__hit.start").alias("start"))
    keep = F.lit(False)
    for category, rule in rules.items():
        confirmed = F.lit(True) if rule.confirm is None else rule.confirm(F.col("match"))
        if gate:
            confirmed = confirmed & near_keyword(F.col("__text"), F.col("start"), F.length("match"), rule.keywords, window)
        keep = F.when(F.col("category") == category, confirmed).otherwise(keep)
    return spans.filter(keep).drop("__text")


def near_keyword(text: Column, start: Column, width: Column, keywords: str, window: int) -> Column:
    begin = F.greatest(start - window, F.lit(1))
    around = F.substring(text, begin, start + width + window - begin)
    return F.lower(around).rlike(keywords)


def _any_match(text: Column, pattern: str, confirm: Callable[[Column], Column] | None, needs: str = "") -> Column:
    found = text.rlike(pattern) if confirm is None else F.exists(extract(text, pattern), confirm)
    return F.contains(text, F.lit(needs)) & found if needs else found


def detects(category: Column, text: Column, categories: Sequence[str] | None = None) -> Column:
    """Whether the rule of the row's category matches the text; false for a category without a rule."""
    out = F.lit(False)
    for name, rule in _rules(categories).items():
        out = F.when(category == name, _any_match(text, rule.pattern, rule.confirm, rule.needs)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def detects_compact(category: Column, text: Column, categories: Sequence[str] | None = None) -> Column:
    """The same on text without delimiters."""
    out = F.lit(False)
    for name, rule in _rules(categories).items():
        pattern, confirm = (rule.compact, rule.confirm_compact) if rule.compact else (rule.pattern, rule.confirm)
        out = F.when(category == name, _any_match(text, pattern, confirm)).otherwise(out)
    return F.coalesce(out, F.lit(False))


# --- normalisation ----------------------------------------------------------------------------------------------------

INVISIBLE = "".join(fixed.ZERO_WIDTH.values()) + fixed.SOFT_HYPHEN + fixed.WORD_JOINER + "".join(
    (fixed.RLO, fixed.LRO, fixed.RLE, fixed.PDF, fixed.RLI, fixed.PDI, fixed.ALM))


def _fold_strings() -> tuple[str, str]:
    """Characters folded one to one: digit blocks, fullwidth digits, Unicode spaces, look-alikes.

    A look-alike shared by a digit and a letter is read as the digit, since the numeric identifiers are the ones that
    a check digit can confirm.
    """
    table: dict[str, str] = {}
    for source, target in zip(HOMOGLYPH_TO, HOMOGLYPH_FROM):
        if target.isdigit() or (target.isupper() and source not in table):
            table.setdefault(source, target)
    for base in list(fixed.DIGIT_BLOCKS.values()) + [fixed.FULLWIDTH_ZERO]:
        table.update({chr(base + i): str(i) for i in range(10)})
    table.update({c: " " for c in fixed.UNICODE_SPACES.values()})
    return "".join(table), "".join(table.values())


FOLD_FROM, FOLD_TO = _fold_strings()
ENTITY = "&#[xX]?[0-9a-fA-F]{1,6};"


def code_point_text(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def unescape_html(text: Column) -> Column:
    """Numeric entities of any code point, and all named ones."""
    def number(entity: Column) -> Column:
        hexed = F.lower(F.substring(entity, 3, 1)) == "x"
        # Hexadecimal digits without an x are no number.
        return F.when(hexed, F.conv(F.substring(entity, F.lit(4), F.length(entity) - 4), 16, 10)).otherwise(
            F.substring(entity, F.lit(3), F.length(entity) - 3)).try_cast("bigint")

    def decoded(entity: Column) -> Column:
        return let(number(entity), lambda n: F.when(n.between(1, 0x7F), F.char(n)).when(
            n.between(0x80, 0xD7FF) | n.between(0xE000, 0x10FFFF), code_point_text(n)).otherwise(entity))

    joined = F.array_join(F.transform(
        F.arrays_zip(F.split(text, ENTITY).alias("piece"), extract(text, ENTITY).alias("entity")),
        lambda x: F.concat(x["piece"], F.coalesce(decoded(x["entity"]), F.lit(""))),
    ), "")
    out = F.when(F.contains(text, F.lit("&#")), joined).otherwise(text)
    out = let(out, lambda t: F.when(F.contains(t, F.lit("&")), unescape_named(t)).otherwise(t))
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", ""), r"(?s)/\*.*?\*/", "")


def _only(needed: str, step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A step of the normaliser that leaves texts without ``needed`` as they are, and costs them one search."""
    return lambda text: F.when(text.rlike(needed), step(text)).otherwise(text)


def fold_characters(text: Column) -> Column:
    """Invisible characters removed, digit blocks, spaces and look-alikes to ASCII."""
    return F.translate(text, FOLD_FROM + INVISIBLE, FOLD_TO)


MORSE_RUN = r"(?:[.-]{5}[ /\n]?){4}"


def unmorse(text: Column) -> Column:
    """Runs of five-symbol Morse digits as digits; only where a run of four with a dot occurs."""
    out = F.regexp_replace(text, "([.-]{5})[ /\n]?", "$1|")
    for digit, code in fixed.MORSE.items():
        out = F.replace(out, F.lit(code + "|"), F.lit(digit))
    return F.when(text.rlike(MORSE_RUN) & text.rlike(r"[.][.-]{4}|[.-]{4}[.]"), out).otherwise(text)


def normalise(text: Column) -> Column:
    """Undo character-level and markup-level obfuscation: entities, percent escapes (two layers), comments,
    invisible and look-alike characters, compatibility forms (NFKC), Morse digits. Stays on the JVM."""
    def decoded(raw: Column) -> Column:
        out = unescape_html(raw)
        for _ in range(2):
            out = let(out, lambda t: F.when(F.contains(t, F.lit("%")), E.unpercent(t)).otherwise(t))
        return out

    # All that is folded stands outside ASCII.
    plain = _only(r"[^\x00-\x7F]", lambda t: let(fold_characters(t), lambda f: normal_form(f, "NFKC")))
    return let(_only("[&%]", decoded)(text), lambda d: let(_only(r"<!--|/\*", strip_comments)(d), lambda s: let(plain(s), unmorse)))


def compact(text: Column) -> Column:
    """Delimiters removed."""
    return F.regexp_replace(text, r"[\s./_-]+", "")


# --- layered decoding -------------------------------------------------------------------------------------------------


#: Layers that only some texts can be; null where a text is none of them.
_STRICT = (E.unbase64, E.unhex, E.unbase32, E.unbase32_hex,
           lambda t: F.when(F.contains(t, F.lit("%")), F.nullif(E.unpercent(t), t)))
#: Layers that any text can be; beyond the second layer they would only multiply the views. A text without letters has no rotation; a
#: palindrome is its own reversal.
_LOOSE = (lambda t: F.nullif(E.rot13(t), t), F.reverse)
MAX_LAYERS = 3


def _next_views(frontier: Column, seen: Column, depth: int) -> Column:
    """The texts one layer below the frontier that have not been seen as a view."""
    layers = _STRICT + (_LOOSE if depth <= 2 else ())
    below = F.array_compact(F.flatten(F.transform(frontier, lambda t: F.array(*[layer(t) for layer in layers]))))
    return F.array_distinct(below) if depth == 1 else F.array_except(below, seen)


def search_views(text: Column, found: Callable[[Column], Column], max_layers: int = MAX_LAYERS) -> Column:
    """The least number of encoding layers under which a view of the text satisfies ``found``; null if none does.

    Breadth first: a layer is decoded only where no view of the layers before was found, and no text is looked at twice.
    """
    def at(depth: int, frontier: Column, seen: Column) -> Column:
        def look(views: Column) -> Column:
            hit = F.when(F.exists(views, found), F.lit(depth))
            if depth == max_layers:
                return hit
            return hit.otherwise(F.when(F.size(views) > 0, let(F.concat(seen, views), lambda all_: at(depth + 1, views, all_))))

        return let(_next_views(frontier, seen, depth), look)

    return at(1, F.array(text), F.array(text))


def decoded_views(text: Column, max_layers: int = MAX_LAYERS) -> Column:
    """All texts that the text may hold under one to ``max_layers`` layers of encoding, without the text itself."""
    def at(depth: int, frontier: Column, seen: Column) -> Column:
        def grow(views: Column) -> Column:
            if depth == max_layers:
                return F.concat(seen, views)
            return let(F.concat(seen, views), lambda all_: at(depth + 1, views, all_))

        return let(_next_views(frontier, seen, depth), grow)

    return F.array_except(at(1, F.array(text), F.array(text)), F.array(text))


# --- detection runs ---------------------------------------------------------------------------------------------------


def severity(detected: Column, error: Column) -> Column:
    """error, else pass when detected, else fail. An empty error text is no error."""
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(detected, "pass").otherwise("fail")


def run_detection(
    variants: DataFrame, text: str = "variant", category: str = "category", error: str | None = None,
    normalised: bool = False, decode: bool = False, wrap: Callable[[Column, Column], Column] | None = None,
    min_confidence: float = 0.0, known: str | None = None,
) -> DataFrame:
    """Apply the rule of each row's category; adds detected, confidence, error and severity.

    ``wrap`` puts the value into a sentence first; the reported value stays as it is. ``normalised`` and ``decode`` add
    views of the text, tried only where the plain text did not match. ``known`` names a column with the confidence of an earlier run
    over the plain text, which is then not matched again.
    """
    cat = F.col(category)
    scanned = F.col(text) if wrap is None else wrap(cat, F.col(text))
    rows = variants.withColumn("__scanned", scanned)
    confidence = F.when(detects(cat, F.col("__scanned")), _confidence(cat)) if known is None else F.col(known)
    if normalised:
        # A text that is normal already did not match, or it would not be looked at here.
        found = let(normalise(F.col("__scanned")), lambda t: F.when(
            (t != F.col("__scanned")) & detects(cat, t), _confidence(cat) * 0.9).when(detects_compact(cat, compact(t)), _confidence(cat) * 0.8))
        # A category without a rule is found in no view.
        confidence = F.coalesce(confidence, F.when(cat.isin(*_rules(None)), found))
    if decode:
        plain = normalise(F.col("__scanned")) if normalised else F.col("__scanned")
        layers = search_views(plain, lambda t: detects(cat, t) | detects_compact(cat, compact(t)))
        confidence = F.coalesce(confidence, F.when(layers.isNotNull(), _confidence(cat) * 0.7))
    failed = F.lit("") if error is None else F.coalesce(F.col(error), F.lit(""))
    out = rows.withColumn("__confidence", F.when(failed == "", confidence)).drop("__scanned")
    out = out.withColumn("detected", F.coalesce(F.col("__confidence") >= min_confidence, F.lit(False)))
    out = out.withColumn("confidence", F.when(F.col("detected"), F.col("__confidence"))).drop("__confidence")
    return out.withColumn("error", failed).withColumn("severity", severity(F.col("detected"), F.col("error")))


def by_strategy(run: DataFrame, strategies: Sequence[str], error: str | None = None) -> DataFrame:
    """A run under several strategies: strategy, and detected, confidence, error and severity where a strategy failed.

    A strategy carries the same text, so the rules are applied once, before the rows are multiplied. ``error`` is a SQL expression
    over the run's columns and ``strategy``.
    """
    rows = run.drop("error", "severity").withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))
    rows = rows.withColumn("error", F.lit("") if error is None else F.coalesce(F.expr(error), F.lit("")))
    read = F.col("error") == ""
    return rows.withColumn("detected", F.col("detected") & read).withColumn("confidence", F.when(read, F.col("confidence"))).withColumn(
        "severity", severity(F.col("detected"), F.col("error")))


def _confidence(category: Column) -> Column:
    out = F.lit(SHAPED)
    for name, rule in RULES.items():
        out = F.when(category == name, rule.confidence).otherwise(out)
    return out
