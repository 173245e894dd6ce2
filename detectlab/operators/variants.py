"""Variant transforms: one payload row in, one row per applicable technique out.

A technique is a column built from the payload value. The techniques of a family form one array that is expanded with
``inline``; a technique that does not apply gives null and is dropped after the expansion. All families are expanded
from a single scan of the payloads. Unicode normal forms are made for rows holding non-ASCII text alone: ASCII text never changes
under any of the four forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.functions import encodings as E
from detectlab.functions import fixed
from detectlab.functions.text import alnum, between, chars, chunks, first_half, half, last_half
from detectlab.functions.unicode import normal_form
from detectlab.operators.catalogue import APPLICABLE

KEPT_ALWAYS, KEPT_IF_CHANGED = "always", "changed"


class Parts:
    """Columns that several techniques share, projected once before the expansion."""

    shared: dict[str, Callable[[Column], Column]] = {
        "chars": chars,
        "raw": alnum,
        "groups": lambda v: chunks(alnum(v), 4),
        "mid": half,
        "head": first_half,
        "tail": last_half,
        "b64": E.base64,
        "hex": E.hex_lower,
        "b32": E.base32,
        "percent": E.percent,
        "rot": E.rot13,
    }

    def __init__(self, value: Column):
        self.v = value
        for name in self.shared:
            setattr(self, name, F.col(f"__{name}"))

    @classmethod
    def direct(cls, value: Column) -> Parts:
        """Parts as expressions of the value, for use without a projection."""
        parts = cls.__new__(cls)
        parts.v = value
        for name, build in cls.shared.items():
            setattr(parts, name, build(value))
        return parts

    @classmethod
    def project(cls, df: DataFrame, value: str, used: Iterable[str]) -> DataFrame:
        return df.select("*", *[cls.shared[name](F.col(value)).alias(f"__{name}") for name in used])


@dataclass(frozen=True)
class Technique:
    generator: str
    name: str
    ordinal: int
    build: Callable[[Parts], Column]
    kept: str


FAMILIES: dict[str, list[Technique]] = {}
_USES: dict[str, tuple[str, ...]] = {}


def register_transform(generator: str, name: str, build: Callable[[Parts], Column], kept: str = KEPT_ALWAYS) -> None:
    """Add a technique. ``build`` gets the shared parts and returns the variant, or null where it does not apply.

    ``kept`` is ``always`` or ``changed`` (drop the variant when it equals the payload value).
    """
    family = FAMILIES.setdefault(generator, [])
    family.append(Technique(generator, name, len(family), build, kept))


def _digit_map(base: int) -> str:
    return "".join(chr(base + i) for i in range(10))


def _homoglyph_strings() -> tuple[str, str]:
    table = dict(fixed.HOMOGLYPHS)
    table.update({k.lower(): v for k, v in fixed.HOMOGLYPHS.items() if k.isalpha()})
    return "".join(table), "".join(table.values())


HOMOGLYPH_FROM, HOMOGLYPH_TO = _homoglyph_strings()


def _unequal(candidate: Column, *others: Column) -> Column:
    """The candidate where it differs from every other form, else null."""
    condition = F.lit(True)
    for other in others:
        condition = condition & (candidate != other)
    return F.when(condition, candidate)


def _alternating(items: Column, even: str, odd: str) -> Column:
    """Items joined by two separators in turn; null for a single item."""
    joined = F.array_join(
        F.transform(items, lambda x, i: F.when(i == 0, x).otherwise(
            F.concat(F.when(i % 2 == 1, even).otherwise(odd), x))), "")
    return F.when(F.size(items) > 1, joined)


def project_parts_of_family(df: DataFrame, value: str, family: str, families: Sequence[str]) -> DataFrame:
    """The shared parts where each row needs one family only: a part is computed just for the families that use it."""
    columns = []
    for name, build in Parts.shared.items():
        users = [g for g in families if name in _USES.get(g, tuple(Parts.shared))]
        if users:
            columns.append(F.when(F.col(family).isin(*users), build(F.col(value))).alias(f"__{name}"))
    return df.select("*", *columns)


# --- unicode_encoding -------------------------------------------------------------------------------------------------

def _percent_mixed(p: Parts) -> Column:
    mixed = F.array_join(
        F.transform(p.chars, lambda c, i: F.when((i % 2 == 0) & c.rlike(r"[\p{L}\p{N}]"), E.percent(c)).otherwise(c)), "")
    return _unequal(mixed, p.v, E.percent_digits(p.v))


for _abbr, _char in fixed.ZERO_WIDTH.items():
    register_transform("unicode_encoding", f"zero_width_{_abbr}", lambda p, s=_char: F.array_join(p.chars, s))
register_transform("unicode_encoding", "fullwidth_digits",
                   lambda p: F.translate(p.v, fixed.DIGITS, _digit_map(fixed.FULLWIDTH_ZERO)), KEPT_IF_CHANGED)
register_transform("unicode_encoding", "homoglyph_substitution",
                   lambda p: F.translate(p.v, HOMOGLYPH_FROM, HOMOGLYPH_TO), KEPT_IF_CHANGED)
register_transform("unicode_encoding", "html_entity_decimal", lambda p: F.array_join(
    F.transform(p.chars, lambda c: F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))), ""))
register_transform("unicode_encoding", "html_entity_hex", lambda p: F.array_join(
    F.transform(p.chars, lambda c: F.concat(F.lit("&#x"), F.lower(F.hex(F.ascii(c))), F.lit(";"))), ""))
register_transform("unicode_encoding", "url_percent_encoding_full", lambda p: p.percent)
register_transform("unicode_encoding", "url_percent_encoding_digits",
                   lambda p: E.percent_digits(p.v), KEPT_IF_CHANGED)
register_transform("unicode_encoding", "url_percent_encoding_mixed", _percent_mixed)
_USES["unicode_encoding"] = ("chars", "percent")

# --- delimiter --------------------------------------------------------------------------------------------------------

register_transform("delimiter", "no_delimiter", lambda p: p.raw)
for _name, _sep in (("space", " "), ("hyphen", "-"), ("dot", "."), ("slash", "/"), ("tab", "\t"), ("newline", "\n")):
    register_transform("delimiter", f"{_name}_delimiter", lambda p, s=_sep: F.array_join(p.groups, s), KEPT_IF_CHANGED)
register_transform("delimiter", "mixed_delimiter", lambda p: _alternating(p.groups, " ", "-"), KEPT_IF_CHANGED)
register_transform("delimiter", "excessive_delimiter", lambda p: F.array_join(p.groups, "--"), KEPT_IF_CHANGED)
_USES["delimiter"] = ("raw", "groups")

# --- splitting --------------------------------------------------------------------------------------------------------


def _json_text(value: Column) -> Column:
    """A JSON string literal in ASCII: other characters as ``\\u`` escapes of their UTF-16 units."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def unit(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return F.regexp_replace(units, "(.{4})", r"\\u$1")

    def escaped(c: Column) -> Column:
        out = F.when(c.rlike(r"[^\x20-\x7E]"), unit(c)).otherwise(c)
        for raw, text in short.items():
            out = F.when(c == raw, text).otherwise(out)
        return out

    plain = ~value.rlike(r'[^\x20-\x7E]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(F.array_join(F.transform(chars(value), escaped), "")), F.lit('"'))


def _xml_text(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


register_transform("splitting", "mid_line_break", lambda p: F.concat(p.head, F.lit("\n"), p.tail))
register_transform("splitting", "html_comment_injection", lambda p: F.array_join(p.chars, "<!---->"))
register_transform("splitting", "css_comment_injection", lambda p: F.array_join(p.chars, "/**/"))
register_transform("splitting", "prefix_noise", lambda p: F.concat(F.lit(fixed.NOISE_EN[:20] + " "), p.v))
register_transform("splitting", "suffix_noise", lambda p: F.concat(p.v, F.lit(" " + fixed.NOISE_EN[:20])))
register_transform("splitting", "json_field_split", lambda p: F.concat(
    F.lit('{"part1": '), _json_text(p.head), F.lit(', "part2": '), _json_text(p.tail), F.lit("}")))
register_transform("splitting", "whitespace_padding", lambda p: F.array_join(p.chars, " "))
register_transform("splitting", "xml_tag_injection",
                   lambda p: F.concat(F.lit("<data>"), _xml_text(p.v), F.lit("</data>")))
register_transform("splitting", "fr_ca_prefix_noise", lambda p: F.concat(F.lit(fixed.NOISE_FR[:30] + " "), p.v))
register_transform("splitting", "fr_ca_suffix_noise", lambda p: F.concat(p.v, F.lit(" " + fixed.NOISE_FR[:30])))
_USES["splitting"] = ("chars", "mid", "head", "tail")

# --- leetspeak --------------------------------------------------------------------------------------------------------


def _leet(table: dict[str, str]) -> Callable[[Parts], Column]:
    singles = {k: v for k, v in table.items() if len(v) == 1}
    source = "".join(singles) + "".join(singles).upper()
    target = "".join(singles.values()) * 2
    longer = {k: v for k, v in table.items() if len(v) > 1}

    def build(p: Parts) -> Column:
        # Longer outputs hold letters that are keys themselves, so each key first becomes a private-use mark.
        marks = {k: chr(0xE000 + i) for i, k in enumerate(longer)}
        out = F.translate(p.v, source + "".join(marks) + "".join(marks).upper(),
                          target + "".join(marks.values()) * 2)
        for key, mark in marks.items():
            out = F.replace(out, F.lit(mark), F.lit(longer[key]))
        return out

    return build


register_transform("leetspeak", "leet_minimal", _leet(fixed.LEET_MINIMAL), KEPT_IF_CHANGED)
register_transform("leetspeak", "leet_moderate", _leet(fixed.LEET_MODERATE), KEPT_IF_CHANGED)
register_transform("leetspeak", "leet_aggressive", _leet(fixed.LEET_AGGRESSIVE), KEPT_IF_CHANGED)
_USES["leetspeak"] = ()

# --- regional_digits --------------------------------------------------------------------------------------------------


def _in_block(value: Column, name: str) -> Column:
    return F.translate(value, fixed.DIGITS, _digit_map(fixed.DIGIT_BLOCKS[name]))


def _alternating_blocks(p: Parts) -> Column:
    """Every second digit gets a private-use mark in front, which selects its block."""
    mark = chr(0xE000)
    out = F.regexp_replace(p.v, "([0-9][^0-9]*)([0-9])", f"$1{mark}$2")
    for digit in fixed.DIGITS:
        out = F.replace(out, F.lit(mark + digit), F.lit(chr(fixed.DIGIT_BLOCKS["devanagari"] + int(digit))))
    return _in_block(out, "arabic_indic")


def _halved_blocks(p: Parts) -> Column:
    """Thai up to half of the digits, Bengali after it."""
    at = F.filter(F.sequence(F.lit(1), F.length(p.v)), lambda i: F.substring(p.v, i, F.lit(1)).rlike("[0-9]"))
    cut = F.coalesce(F.try_element_at(at, F.nullif(F.floor(F.size(at) / 2).cast("int"), F.lit(0))), F.lit(0))
    return F.concat(_in_block(F.substring(p.v, F.lit(1), cut), "thai"),
                    _in_block(F.substring(p.v, cut + 1, F.length(p.v)), "bengali"))


def _only_with_digit(p: Parts, out: Column) -> Column:
    return F.when(p.v.rlike("[0-9]"), out)


for _name in fixed.DIGIT_BLOCKS:
    register_transform("regional_digits", f"regional_{_name}",
                       lambda p, n=_name: _only_with_digit(p, _in_block(p.v, n)))
register_transform("regional_digits", "regional_mixed_alternating",
                   lambda p: _only_with_digit(p, _alternating_blocks(p)))
register_transform("regional_digits", "regional_mixed_partial", lambda p: _only_with_digit(p, _halved_blocks(p)))
_USES["regional_digits"] = ()

# --- structural -------------------------------------------------------------------------------------------------------


def _mixed_case(p: Parts) -> Column:
    mixed = F.array_join(F.transform(p.chars, lambda c, i: F.when(i % 2 == 0, F.upper(c)).otherwise(F.lower(c))), "")
    return _unequal(mixed, p.v, F.upper(p.v), F.lower(p.v))


register_transform("structural", "left_pad_spaces", lambda p: F.concat(F.lit(" " * 10), p.v))
register_transform("structural", "right_pad_spaces", lambda p: F.concat(p.v, F.lit(" " * 10)))
register_transform("structural", "left_pad_zeros", lambda p: F.concat(F.lit("0" * 5), p.v))
register_transform("structural", "right_pad_zeros", lambda p: F.concat(p.v, F.lit("0" * 5)))
register_transform("structural", "noise_embedded", lambda p: F.concat(F.lit("X" * 10), p.v, F.lit("X" * 10)))
register_transform("structural", "overlapping_prefix", lambda p: F.concat(F.lit("test_value_"), p.v))
register_transform("structural", "partial_first_half", lambda p: F.when(p.mid > 0, p.head))
register_transform("structural", "partial_last_half", lambda p: p.tail, KEPT_IF_CHANGED)
register_transform("structural", "partial_minus_one",
                   lambda p: F.when(F.length(p.v) > 1, F.substring(p.v, F.lit(1), F.length(p.v) - 1)))
register_transform("structural", "repeated", lambda p: F.concat(p.v, F.lit(" "), p.v))
register_transform("structural", "uppercase", lambda p: F.upper(p.v), KEPT_IF_CHANGED)
register_transform("structural", "lowercase", lambda p: F.lower(p.v), KEPT_IF_CHANGED)
register_transform("structural", "mixed_case", _mixed_case)
_USES["structural"] = ("chars", "mid", "head", "tail")

# --- encoding ---------------------------------------------------------------------------------------------------------


def _within_groups(p: Parts) -> Column:
    return F.array_join(F.transform(p.groups, F.reverse), "")


def _group_order(p: Parts) -> Column:
    return F.array_join(F.reverse(p.groups), "")


def _one_integer(p: Parts) -> Column:
    bare = F.ltrim(p.hex, F.lit("0"))
    return F.concat(F.lit("0x"), F.when(bare == "", "0").otherwise(bare))


register_transform("encoding", "base64_standard", lambda p: p.b64)
register_transform("encoding", "base64_urlsafe", lambda p: _unequal(F.translate(p.b64, "+/", "-_"), p.b64))
register_transform("encoding", "base64_no_padding", lambda p: _unequal(F.rtrim(p.b64, F.lit("=")), p.b64))
register_transform("encoding", "base64_mime_linebreaks",
                   lambda p: F.when(F.length(p.b64) > 76, F.array_join(chunks(p.b64, 76), "\n")))
register_transform("encoding", "base64_partial", lambda p: F.concat(p.head, E.base64(p.tail)))
register_transform("encoding", "base64_double", lambda p: E.base64(p.b64))
register_transform("encoding", "base32_standard", lambda p: p.b32)
register_transform("encoding", "base32_no_padding", lambda p: _unequal(F.rtrim(p.b32, F.lit("=")), p.b32))
register_transform("encoding", "base32_lowercase", lambda p: F.lower(p.b32))
register_transform("encoding", "base32_hex_alphabet", lambda p: F.translate(p.b32, fixed.BASE32, fixed.BASE32_HEX))
register_transform("encoding", "hex_lowercase", lambda p: p.hex)
register_transform("encoding", "hex_uppercase", lambda p: F.upper(p.hex))
register_transform("encoding", "hex_escaped_bytes", lambda p: F.regexp_replace(p.hex, "(..)", r"\\x$1"))
register_transform("encoding", "hex_0x_integer", _one_integer)
register_transform("encoding", "hex_spaced_bytes", lambda p: F.rtrim(F.regexp_replace(p.hex, "(..)", "$1 ")))
register_transform("encoding", "rot13", lambda p: F.when(p.v.rlike(r"\p{L}"), p.rot))
register_transform("encoding", "reversed_full", lambda p: F.reverse(p.v), KEPT_IF_CHANGED)
register_transform("encoding", "reversed_within_groups", lambda p: _unequal(_within_groups(p), p.raw, F.reverse(p.v)))
register_transform("encoding", "reversed_group_order", lambda p: _unequal(_group_order(p), p.raw, _within_groups(p)))
register_transform("encoding", "double_url_encoding", lambda p: F.replace(p.percent, F.lit("%"), F.lit("%25")))
register_transform("encoding", "double_url_encoding_digits", lambda p: _unequal(
    F.regexp_replace(p.percent, "%(3[0-9])", "%25$1"), F.replace(p.percent, F.lit("%"), F.lit("%25"))))
_USES["encoding"] = ("raw", "groups", "head", "tail", "mid", "b64", "hex", "b32", "percent", "rot")

# --- encoding_chains --------------------------------------------------------------------------------------------------


def _quote(value: Column) -> Column:
    for raw, escaped in (("+", "%2B"), ("/", "%2F"), ("=", "%3D")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


register_transform("encoding_chains", "base64_of_rot13", lambda p: E.base64(p.rot))
register_transform("encoding_chains", "base64_of_hex", lambda p: E.base64(p.hex))
register_transform("encoding_chains", "hex_of_base64", lambda p: E.hex_lower(p.b64))
register_transform("encoding_chains", "rot13_of_base64", lambda p: E.rot13(p.b64))
register_transform("encoding_chains", "url_of_base64", lambda p: _quote(p.b64))
register_transform("encoding_chains", "base64_of_base64", lambda p: E.base64(p.b64))
register_transform("encoding_chains", "base64_of_rot13_of_hex", lambda p: E.base64(E.rot13(p.hex)))
_USES["encoding_chains"] = ("b64", "hex", "rot")

# --- bidirectional ----------------------------------------------------------------------------------------------------

register_transform("bidirectional", "rlo_wrap", lambda p: F.concat(F.lit(fixed.RLO), p.v, F.lit(fixed.PDF)))
register_transform("bidirectional", "lro_wrap", lambda p: F.concat(F.lit(fixed.LRO), p.v, F.lit(fixed.PDF)))
register_transform("bidirectional", "rle_embed", lambda p: F.concat(F.lit(fixed.RLE), p.v, F.lit(fixed.PDF)))
register_transform("bidirectional", "mid_rlo_inject",
                   lambda p: F.concat(p.head, F.lit(fixed.RLO), p.tail, F.lit(fixed.PDF)))
register_transform("bidirectional", "rli_isolate", lambda p: F.concat(F.lit(fixed.RLI), p.v, F.lit(fixed.PDI)))
register_transform("bidirectional", "alm_between_chars", lambda p: F.array_join(p.chars, fixed.ALM))
_USES["bidirectional"] = ("chars", "mid", "head", "tail")

# --- morse_code -------------------------------------------------------------------------------------------------------


def morse(value: Column, sep: str) -> Column:
    """Digits as Morse symbols with ``sep`` around every symbol; other characters stay."""
    out = F.regexp_replace(value, "(?s)([^0-9])", f"{sep}$1{sep}") if sep else value
    if sep:
        out = F.regexp_replace(out, "([0-9])(?=[0-9])", f"$1{sep}")
        out = F.regexp_replace(out, f"(?:{sep}){{2,}}", sep)
    marks = "".join(chr(0xE100 + i) for i in range(10))
    out = F.translate(out, fixed.DIGITS, marks)
    for digit, mark in zip(fixed.DIGITS, marks):
        out = F.replace(out, F.lit(mark), F.lit(fixed.MORSE[digit]))
    return out


for _name, _sep in (("space", " "), ("slash", "/"), ("no", ""), ("newline", "\n")):
    register_transform("morse_code", f"morse_{_name}_sep",
                       lambda p, s=_sep: _only_with_digit(p, morse(p.v, s)))
_USES["morse_code"] = ()

# --- soft_hyphen ------------------------------------------------------------------------------------------------------


def _two_char_shy(p: Parts) -> Column:
    tight = F.array_join(chunks(p.raw, 2), fixed.SOFT_HYPHEN)
    return _unequal(tight, p.v, F.array_join(p.groups, fixed.SOFT_HYPHEN))


def _mixed_joiners(p: Parts) -> Column:
    return F.coalesce(_alternating(p.chars, fixed.SOFT_HYPHEN, fixed.WORD_JOINER), p.v)


register_transform("soft_hyphen", "shy_group_boundaries",
                   lambda p: F.array_join(p.groups, fixed.SOFT_HYPHEN), KEPT_IF_CHANGED)
register_transform("soft_hyphen", "shy_2char_boundaries", _two_char_shy)
register_transform("soft_hyphen", "shy_between_every_char", lambda p: F.array_join(p.chars, fixed.SOFT_HYPHEN))
register_transform("soft_hyphen", "wj_group_boundaries",
                   lambda p: F.array_join(p.groups, fixed.WORD_JOINER), KEPT_IF_CHANGED)
register_transform("soft_hyphen", "wj_between_every_char", lambda p: F.array_join(p.chars, fixed.WORD_JOINER))
register_transform("soft_hyphen", "mixed_shy_wj", _mixed_joiners)
_USES["soft_hyphen"] = ("chars", "raw", "groups")

# --- unicode_whitespace -----------------------------------------------------------------------------------------------

for _name, _sep in fixed.UNICODE_SPACES.items():
    register_transform("unicode_whitespace", f"unicode_{_name}",
                       lambda p, s=_sep: F.array_join(p.groups, s), KEPT_IF_CHANGED)
register_transform("unicode_whitespace", "unicode_mixed_spaces", lambda p: _alternating(
    p.groups, fixed.UNICODE_SPACES["nbsp"], fixed.UNICODE_SPACES["thin_space"]), KEPT_IF_CHANGED)
_USES["unicode_whitespace"] = ("groups",)

# --- context_injection ------------------------------------------------------------------------------------------------

for _name, _template in fixed.CONTEXT_TEMPLATES.items():
    register_transform("context_injection", _name,
                       lambda p, t=_template: F.replace(F.lit(t), F.lit("{value}"), p.v))
_USES["context_injection"] = ()

# --- entropy_evasion --------------------------------------------------------------------------------------------------


def longest_token(value: Column) -> Column:
    """The longest run between token delimiters; the first one when several are equally long."""
    tokens = F.split(value, r"""[ \t\n,;'"()\[\]{}=:]""")
    ranked = F.transform(tokens, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("at"), t.alias("token")))
    return F.array_max(ranked)["token"]


def _around(p: Parts, rebuilt: Callable[[Column], Column]) -> Column:
    """The value with its first longest token replaced; null when that token has fewer than 4 characters."""
    core = longest_token(p.v)
    at = F.instr(p.v, core)
    before = F.substring(p.v, F.lit(1), at - 1)
    after = F.substring(p.v, at + F.length(core), F.length(p.v))
    return F.when(F.length(core) >= 4, F.concat(before, rebuilt(core), after))


def _cut(core: Column) -> tuple[Column, Column]:
    at = F.greatest(F.lit(1), F.least(F.length(core) - 1, half(core) - 1))
    return F.substring(core, F.lit(1), at), F.substring(core, at + 1, F.length(core))


def _quoted_cut(core: Column, middle: str, ends: str) -> Column:
    left, right = _cut(core)
    return F.concat(F.lit(ends), left, F.lit(middle), right, F.lit(ends))


register_transform("entropy_evasion", "entropy_split",
                   lambda p: _around(p, lambda c: F.array_join(chunks(c, 15), "\n")))
register_transform("entropy_evasion", "entropy_comment", lambda p: _around(p, lambda c: _quoted_cut(c, '";c";', "")))
register_transform("entropy_evasion", "entropy_concat", lambda p: _around(p, lambda c: _quoted_cut(c, '" + "', '"')))
register_transform("entropy_evasion", "entropy_low_mix",
                   lambda p: _around(p, lambda c: F.concat(c, F.lit("a" * 16))))
register_transform("entropy_evasion", "entropy_encode",
                   lambda p: F.when(F.length(longest_token(p.v)) >= 4, p.b64))
register_transform("entropy_evasion", "entropy_space",
                   lambda p: _around(p, lambda c: F.array_join(chunks(c, 4), " ")))
_USES["entropy_evasion"] = ("b64",)

# --- Unicode normalisation forms --------------------------------------------------------------------------------------

NORMALISED = (
    ("unicode_encoding", "nfd_normalization", 20), ("unicode_encoding", "nfc_normalization", 21),
    ("unicode_encoding", "nfkc_normalization", 22), ("unicode_encoding", "nfkd_normalization", 23),
    ("encoding", "mixed_normalization_alternating", 30), ("encoding", "mixed_normalization_cross_form", 31),
    ("encoding", "nfkd_normalization", 32),
)


def _by_turns(value: Column) -> Column:
    """NFD and NFC by turns, character by character."""
    return F.array_join(F.transform(chars(value), lambda c, i: F.when(i % 2 == 1, normal_form(c, "NFC")).otherwise(normal_form(c, "NFD"))), "")


def _cross_form(value: Column) -> Column:
    """The first half decomposed, the second composed; the value itself where that is what alternating gives."""
    cross = F.concat(normal_form(first_half(value), "NFD"), normal_form(last_half(value), "NFKC"))
    return F.when(cross == _by_turns(value), value).otherwise(cross)


_FORM_OF = {"nfd_normalization": "NFD", "nfc_normalization": "NFC", "nfkc_normalization": "NFKC", "nfkd_normalization": "NFKD"}
_MIXED = {"mixed_normalization_alternating": _by_turns, "mixed_normalization_cross_form": _cross_form}


def normalised_variant(value: Column, technique: str) -> Column:
    """One of ``NORMALISED``."""
    return normal_form(value, _FORM_OF[technique]) if technique in _FORM_OF else _MIXED[technique](value)


# --- expansion --------------------------------------------------------------------------------------------------------


def applies(generator: str, category: Column, applicable: dict[str, Sequence[str]] | None = None) -> Column:
    """Whether a family covers a category; families without a list cover all."""
    allowed = (APPLICABLE if applicable is None else applicable).get(generator)
    return F.lit(True) if allowed is None else category.isin(*allowed)


def _selected(generators: Sequence[str] | None, techniques: Sequence[str] | None) -> dict[str, list[Technique]]:
    names = list(FAMILIES) if generators is None else list(generators)
    unknown = [g for g in names if g not in FAMILIES]
    if unknown:
        raise ValueError(f"unknown transform families: {unknown}")
    chosen = {g: [t for t in FAMILIES[g] if techniques is None or t.name in techniques] for g in names}
    return {g: ts for g, ts in chosen.items() if ts}


def expand_variants(
    df: DataFrame,
    value: str = "value",
    category: str = "category",
    generators: Sequence[str] | None = None,
    techniques: Sequence[str] | None = None,
    strategies: Sequence[str] = ("text",),
    applicable: dict[str, Sequence[str]] | None = None,
    normal_form_rows: bool = True,
) -> DataFrame:
    """Payload rows times every applicable technique and strategy.

    Techniques that are not asked for are left out of the plan rather than filtered after they ran. Adds the columns
    generator, technique, ordinal, strategy and variant.
    """
    keys = df.columns
    chosen = _selected(generators, techniques)
    used = {part for g in chosen for part in _USES[g]} if all(g in _USES for g in chosen) else set(Parts.shared)
    base = Parts.project(df, value, [name for name in Parts.shared if name in used])
    parts = Parts(F.col(value))
    arrays = [
        F.when(applies(g, F.col(category), applicable), F.array(*[
            F.struct(
                F.lit(g).alias("generator"), F.lit(t.name).alias("technique"), F.lit(t.ordinal).alias("ordinal"),
                F.lit(t.kept == KEPT_ALWAYS).alias("kept"), t.build(parts).alias("variant"),
            )
            for t in ts
        ])).otherwise(F.array())
        for g, ts in chosen.items()
    ]
    out = None
    if arrays:
        # One nested array per family: the outer explode keeps a single scan, the inner one only builds that family.
        rows = base.select(*keys, F.explode(F.array(*arrays)).alias("__family"))
        out = (
            rows.select(*keys, F.inline("__family"))
            .filter(F.col("variant").isNotNull() & (F.col("kept") | (F.col("variant") != F.col(value))))
            .drop("kept")
        )
    forms = [
        n for n in NORMALISED
        if (generators is None or n[0] in generators) and (techniques is None or n[1] in techniques)
    ]
    if normal_form_rows and forms:
        marked = F.array(*[
            F.struct(F.lit(g).alias("generator"), F.lit(t).alias("technique"), F.lit(o).alias("ordinal"),
                     normalised_variant(F.col(value), t).alias("variant"))
            for g, t, o in forms
        ])
        normalised = (
            df.filter(F.col(value).rlike(r"[^\x00-\x7F]"))
            .select(*keys, F.inline(marked))
            .filter(F.col("variant") != F.col(value))
        )
        out = normalised if out is None else out.unionByName(normalised)
    if out is None:
        raise ValueError("no technique is left to apply")
    return out.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def technique_catalogue(spark) -> DataFrame:
    """One row per technique the transforms can give."""
    rows = [(g, t.name, t.ordinal) for g, ts in FAMILIES.items() for t in ts] + [(g, t, o) for g, t, o in NORMALISED]
    return spark.createDataFrame(rows, "generator string, technique string, ordinal int")
