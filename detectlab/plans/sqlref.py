"""SQL fragments for the reference side of the registered queries, written apart from the Spark columns."""

from __future__ import annotations

from detectlab.functions import fixed
from detectlab.operators import catalogue as K


def lit(text: str) -> str:
    """A SQL string literal; characters outside plain ASCII are spelled with chr()."""
    parts, plain = [], ""
    for ch in text:
        if " " <= ch <= "~":
            plain += "''" if ch == "'" else ch
        else:
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append(f"chr({ord(ch)})")
    if plain or not parts:
        parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def in_list(names) -> str:
    return "(" + ", ".join(lit(n) for n in names) + ")"


def array(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


# --- draws ------------------------------------------------------------------------------------------------------------

def key(seed: int, salt: str, row_id: str) -> str:
    return f"('{seed}|{salt}|' || CAST({row_id} AS VARCHAR))"


def hashed(seed: int, salt: str, row_id: str) -> str:
    return f"md5({key(seed, salt, row_id)})"


def hex_int(expr: str, start: int, size: int) -> str:
    return f"CAST('0x' || substr({expr}, {start}, {size}) AS BIGINT)"


def uniform(seed: int, salt: str, row_id: str) -> str:
    return f"({hex_int(f'md5({key(seed, salt, row_id)})', 1, 8)} / 4294967296.0::DOUBLE)"


def below(seed: int, salt: str, row_id: str, n) -> str:
    return f"CAST(floor({uniform(seed, salt, row_id)} * {n}) AS INT)"


def between(seed: int, salt: str, row_id: str, low: int, high: int) -> str:
    return f"({below(seed, salt, row_id, high - low + 1)} + {low})"


def choice(seed: int, salt: str, row_id: str, options) -> str:
    return f"({array(options)})[{below(seed, salt, row_id, len(options))} + 1]"


def digits(seed: int, salt: str, row_id: str, n: int) -> str:
    parts = []
    for block, at in enumerate(range(0, n, 12)):
        size = min(12, n - at)
        number = f"({hex_int(f'md5({key(seed, f'{salt}.{block}', row_id)})', 1, 15)} % {10 ** size})"
        parts.append(f"lpad(CAST({number} AS VARCHAR), {size}, '0')")
    return "(" + " || ".join(parts) + ")"


def symbols(seed: int, salt: str, row_id: str, n, alphabet: str, longest: int | None = None) -> str:
    longest = n if isinstance(n, int) else longest
    parts = []
    for block in range(-(-longest // 16)):
        size = min(16, longest - 16 * block)
        h = f"sha256({key(seed, f'{salt}.{block}', row_id)})"
        parts.append(
            f"array_to_string(list_transform(range(0, {size}), lambda i: substr({lit(alphabet)}, "
            f"CAST(CAST('0x' || substr({h}, CAST(4 * i + 1 AS INT), 4) AS BIGINT) % {len(alphabet)} AS INT) + 1, 1)), '')")
    drawn = "(" + " || ".join(parts) + ")"
    return drawn if isinstance(n, int) else f"substr({drawn}, 1, {n})"


def from_format(seed: int, salt: str, row_id: str, spec: str) -> str:
    parts, at = [], 0
    while at < len(spec):
        end = at
        while end < len(spec) and spec[end] == spec[at]:
            end += 1
        run, name = spec[at:end], f"{salt}.{at}"
        if run[0] == "D":
            parts.append(digits(seed, name, row_id, len(run)))
        elif run[0] == "L":
            parts.append(symbols(seed, name, row_id, len(run), fixed.UPPER))
        elif run[0] == "X":
            parts.append(symbols(seed, name, row_id, len(run), fixed.UPPER + fixed.DIGITS))
        else:
            parts.append(lit(run))
        at = end
    return "(" + " || ".join(parts) + ")"


# --- checks -----------------------------------------------------------------------------------------------------------

def luhn_sum(expr: str, double_odd: int) -> str:
    """Digit sum from the right; positions with ``i % 2 = double_odd`` (1-based) are doubled."""
    return (f"list_sum(list_transform(string_split(reverse({expr}), ''), lambda c, i: CASE WHEN i % 2 = {double_odd} "
            f"THEN (CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 ELSE CAST(c AS INT) END))")


def luhn_digit(expr: str) -> str:
    return f"CAST((10 - {luhn_sum(expr, 1)} % 10) % 10 AS VARCHAR)"


def luhn_valid(expr: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match({expr}, '[0-9]+') THEN {luhn_sum(expr, 0)} % 10 = 0 ELSE FALSE END, FALSE)"


VALUES = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#'"


def char_value(c: str) -> str:
    return f"greatest(strpos({VALUES}, upper({c})) - 1, 0)"


def mod97(expr: str) -> str:
    return (f"list_reduce(string_split(upper({expr}), ''), lambda a, c: CASE WHEN {char_value('c')} < 10 THEN "
            f"(a * 10 + {char_value('c')}) % 97 ELSE (a * 100 + {char_value('c')}) % 97 END, 0::BIGINT)")


def mod97_digits(expr: str) -> str:
    padded = f"({expr} || '00')"
    return f"lpad(CAST(98 - {mod97(padded)} AS VARCHAR), 2, '0')"


def iban_valid(expr: str) -> str:
    bare = f"upper(replace({expr}, ' ', ''))"
    return (f"coalesce(CASE WHEN length({bare}) >= 5 AND regexp_full_match({bare}, '[0-9A-Z]+') THEN "
            f"{mod97(f'(substr({bare}, 5) || substr({bare}, 1, 4))')} = 1 ELSE FALSE END, FALSE)")


def sin_valid(expr: str) -> str:
    bare = f"replace(replace({expr}, ' ', ''), '-', '')"
    return f"(length({bare}) = 9 AND {luhn_valid(bare)})"


def ssn_valid(expr: str) -> str:
    return (f"(regexp_full_match({expr}, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND substr({expr}, 1, 3) NOT IN ('000', '666') "
            f"AND substr({expr}, 1, 1) <> '9' AND substr({expr}, 5, 2) <> '00' AND substr({expr}, 8, 4) <> '0000')")


def weighted(expr: str, weights) -> str:
    return "(" + " + ".join(f"{char_value(f'substr({expr}, {i + 1}, 1)')} * {w}" for i, w in enumerate(weights)) + ")"


def cusip_digit(expr: str) -> str:
    terms = []
    for i in range(8):
        v = f"({char_value(f'substr({expr}, {i + 1}, 1)')} * {2 if i % 2 else 1})"
        terms.append(f"({v} // 10 + {v} % 10)")
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR)"


def sedol_digit(expr: str) -> str:
    return f"CAST((10 - {weighted(expr, fixed.SEDOL_WEIGHTS)} % 10) % 10 AS VARCHAR)"


def spelled(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split(upper({expr}), ''), "
            f"lambda c: CAST({char_value('c')} AS VARCHAR)), '')")


def isin_digit(expr: str) -> str:
    return luhn_digit(spelled(expr))


def cpf_digit(expr: str, n: int) -> str:
    total = weighted(expr, range(n + 1, 1, -1))
    return f"CAST(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END AS VARCHAR)"


def de_tax_digit(expr: str) -> str:
    step = "CASE WHEN (a + CAST(c AS INT)) % 10 = 0 THEN 20 ELSE ((a + CAST(c AS INT)) % 10) * 2 END % 11"
    return f"CAST((11 - list_reduce(string_split({expr}, ''), lambda a, c: CAST(({step}) AS BIGINT), 10::BIGINT)) % 10 AS VARCHAR)"


def medicare_digit(expr: str) -> str:
    return f"CAST({weighted(expr, fixed.MEDICARE_WEIGHTS)} % 10 AS VARCHAR)"


# --- rates ------------------------------------------------------------------------------------------------------------

def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ((2000 * ({part}) + ({whole})) // (2 * ({whole}))) / 10.0::DOUBLE ELSE 0.0::DOUBLE END"


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / ({whole}) ELSE 0.0::DOUBLE END"


# --- payloads ---------------------------------------------------------------------------------------------------------

def card(k: str) -> str:
    body = f"('4' || lpad(CAST({k} AS VARCHAR), 14, '0'))"
    return f"({body} || {luhn_digit(body)})"


def payloads(table: str, k: str, word: str, extra: str = "") -> str:
    pad = lambda e, n: f"lpad(CAST({e} AS VARCHAR), {n}, '0')"
    sin8, bban = f"('1' || {pad(k, 7)})", pad(k, 18)
    sin9, german = f"({sin8} || {luhn_digit(sin8)})", f"({bban} || 'DE')"
    values = {
        "credit_card": card(k),
        "ssn": f"({pad(f'({k} % 665 + 1)', 3)} || '-' || {pad(f'({k} % 99 + 1)', 2)} || '-' || {pad(f'({k} % 9999 + 1)', 4)})",
        "sin": f"(substr({sin9}, 1, 3) || ' ' || substr({sin9}, 4, 3) || ' ' || substr({sin9}, 7, 3))",
        "iban": f"('DE' || {mod97_digits(german)} || {bban})",
        "email": f"(lower({word}) || '.' || CAST({k} AS VARCHAR) || '@example.com')",
        "phone": f"('+1-416-' || CAST({k} % 800 + 200 AS VARCHAR) || '-' || {pad(f'({k} % 10000)', 4)})",
        "random_api_key": f"md5({word})",
    }
    return " UNION ALL ".join(
        f"SELECT {k} * 7 + {i} AS payload_id, {word} AS label{extra}, '{c}' AS category, {v} AS value FROM {table}"
        for i, (c, v) in enumerate(values.items()))


SUPPLIER_PAYLOADS = payloads("supplier", "s_suppkey", "s_name")
CUSTOMER_PAYLOADS = payloads("customer", "c_custkey", "c_mktsegment", ", c_acctbal")
ORDER_CARDS = f"SELECT o_orderkey AS payload_id, 'credit_card' AS category, {card('o_orderkey')} AS value FROM orders"


# --- variants ---------------------------------------------------------------------------------------------------------

def block(base: int) -> str:
    return "".join(chr(base + i) for i in range(10))


def translate(expr: str, source: str, target: str) -> str:
    return f"translate({expr}, {lit(source)}, {lit(target)})"


def b64(e: str) -> str:
    return f"to_base64(encode({e}))"


def hexl(e: str) -> str:
    return f"lower(hex(encode({e})))"


def pcte(e: str, mark: str = "%") -> str:
    return f"regexp_replace(hex(encode({e})), '(..)', '{mark}\\1', 'g')"


def rot13(e: str) -> str:
    up, low = fixed.UPPER, fixed.UPPER.lower()
    return translate(e, up + low, up[13:] + up[:13] + low[13:] + low[:13])


def join(items: str, sep: str) -> str:
    return f"array_to_string({items}, {lit(sep)})"


def base32(e: str, alphabet: str) -> str:
    bits = f"CAST(CAST(encode({e}) AS BIT) AS VARCHAR)"
    padded = f"rpad({bits}, CAST(ceil(length({bits}) / 5.0) * 5 AS INT), '0')"
    number = " + ".join(f"CAST(substr(b, {i + 1}, 1) AS INT) * {16 >> i}" for i in range(5))
    body = f"array_to_string(list_transform(regexp_extract_all({padded}, '.....'), lambda b: substr('{alphabet}', {number} + 1, 1)), '')"
    return f"rpad({body}, CAST(ceil(length({body}) / 8.0) * 8 AS INT), '=')"


ALWAYS, CHANGED = "TRUE", "variant <> value"
CH, GR = "string_split(value, '')", "regexp_extract_all(raw, '(?s).{1,4}')"


def alternating(items: str, even: str, odd: str) -> str:
    return (f"CASE WHEN len({items}) > 1 THEN array_to_string(list_transform({items}, lambda x, i: CASE WHEN i = 1 THEN x "
            f"WHEN i % 2 = 0 THEN {lit(even)} || x ELSE {lit(odd)} || x END), '') END")


def _digit_rank(pick: str) -> str:
    rank = "length(regexp_replace(substr(value, 1, CAST(i - 1 AS INT)), '[^0-9]', '', 'g'))"
    return (f"array_to_string(list_transform({CH}, lambda c, i: CASE WHEN regexp_matches(c, '[0-9]') THEN "
            f"{pick.replace('RANK', rank)} ELSE c END), '')")


def _leet(table: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"array_to_string(list_transform({CH}, lambda c: CASE lower(c) {arms} ELSE c END), '')"


def _morse(sep: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MORSE.items())
    s = lit(sep)
    body = f"array_to_string(list_transform({CH}, lambda c: CASE c {arms} ELSE {s} || c || {s} END), {s})"
    return f"regexp_replace({body}, {s} || '{{2,}}', {s}, 'g')" if sep else body


def variant_techniques() -> dict[str, list[tuple[str, str, str]]]:
    """(technique, expression, keep condition) per family, in technique order."""
    head, tail = "substr(value, 1, length(value) // 2)", "substr(value, length(value) // 2 + 1)"
    digit = "regexp_matches(value, '[0-9]')"
    letter = "regexp_matches(value, '\\p{L}')"
    out: dict[str, list[tuple[str, str, str]]] = {}
    source = "".join(fixed.HOMOGLYPHS) + "".join(k.lower() for k in fixed.HOMOGLYPHS if k.isalpha())
    target = "".join(fixed.HOMOGLYPHS.values()) + "".join(v for k, v in fixed.HOMOGLYPHS.items() if k.isalpha())
    pdig = "regexp_replace(value, '([0-9])', '%3\\1', 'g')"
    out["unicode_encoding"] = [(f"zero_width_{n}", join(CH, c), ALWAYS) for n, c in fixed.ZERO_WIDTH.items()] + [
        ("fullwidth_digits", translate("value", fixed.DIGITS, block(fixed.FULLWIDTH_ZERO)), CHANGED),
        ("homoglyph_substitution", translate("value", source, target), CHANGED),
        ("html_entity_decimal", f"array_to_string(list_transform({CH}, lambda c: '&#' || CAST(unicode(c) AS VARCHAR) || ';'), '')", ALWAYS),
        ("html_entity_hex", f"array_to_string(list_transform({CH}, lambda c: '&#x' || lower(hex(unicode(c))) || ';'), '')", ALWAYS),
        ("url_percent_encoding_full", pcte("value"), ALWAYS),
        ("url_percent_encoding_digits", pdig, CHANGED),
        ("url_percent_encoding_mixed",
         f"array_to_string(list_transform({CH}, lambda c, i: CASE WHEN i % 2 = 1 AND regexp_matches(c, '[0-9A-Za-z]') "
         f"THEN {pcte('c')} ELSE c END), '')", f"variant <> value AND variant <> {pdig}"),
    ]
    seps = (("space", " "), ("hyphen", "-"), ("dot", "."), ("slash", "/"), ("tab", "\t"), ("newline", "\n"))
    out["delimiter"] = [("no_delimiter", "raw", ALWAYS)] + [
        (f"{n}_delimiter", join(GR, s), CHANGED) for n, s in seps] + [
        ("mixed_delimiter", alternating(GR, " ", "-"), CHANGED), ("excessive_delimiter", join(GR, "--"), CHANGED)]
    q = lambda e: f"('\"' || replace(replace({e}, '\\', '\\\\'), '\"', '\\\"') || '\"')"
    esc = "value"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        esc = f"replace({esc}, {lit(a)}, {lit(b)})"
    out["splitting"] = [
        ("mid_line_break", f"{head} || chr(10) || {tail}", ALWAYS),
        ("html_comment_injection", join(CH, "<!---->"), ALWAYS), ("css_comment_injection", join(CH, "/**/"), ALWAYS),
        ("prefix_noise", f"{lit(fixed.NOISE_EN[:20] + ' ')} || value", ALWAYS),
        ("suffix_noise", f"value || {lit(' ' + fixed.NOISE_EN[:20])}", ALWAYS),
        ("json_field_split", f"'{{\"part1\": ' || {q(head)} || ', \"part2\": ' || {q(tail)} || '}}'", ALWAYS),
        ("whitespace_padding", join(CH, " "), ALWAYS), ("xml_tag_injection", f"'<data>' || {esc} || '</data>'", ALWAYS),
        ("fr_ca_prefix_noise", f"{lit(fixed.NOISE_FR[:30] + ' ')} || value", ALWAYS),
        ("fr_ca_suffix_noise", f"value || {lit(' ' + fixed.NOISE_FR[:30])}", ALWAYS),
    ]
    out["leetspeak"] = [("leet_minimal", _leet(fixed.LEET_MINIMAL), CHANGED),
                        ("leet_moderate", _leet(fixed.LEET_MODERATE), CHANGED),
                        ("leet_aggressive", _leet(fixed.LEET_AGGRESSIVE), CHANGED)]
    blk = lambda e, n: translate(e, fixed.DIGITS, block(fixed.DIGIT_BLOCKS[n]))
    out["regional_digits"] = [(f"regional_{n}", blk("value", n), digit) for n in fixed.DIGIT_BLOCKS] + [
        ("regional_mixed_alternating", _digit_rank(
            f"CASE WHEN RANK % 2 = 0 THEN {blk('c', 'arabic_indic')} ELSE {blk('c', 'devanagari')} END"), digit),
        ("regional_mixed_partial", _digit_rank(
            f"CASE WHEN RANK < length(regexp_replace(value, '[^0-9]', '', 'g')) // 2 THEN {blk('c', 'thai')} "
            f"ELSE {blk('c', 'bengali')} END"), digit)]
    mixed = f"array_to_string(list_transform({CH}, lambda c, i: CASE WHEN i % 2 = 1 THEN upper(c) ELSE lower(c) END), '')"
    out["structural"] = [
        ("left_pad_spaces", "repeat(' ', 10) || value", ALWAYS), ("right_pad_spaces", "value || repeat(' ', 10)", ALWAYS),
        ("left_pad_zeros", "repeat('0', 5) || value", ALWAYS), ("right_pad_zeros", "value || repeat('0', 5)", ALWAYS),
        ("noise_embedded", "repeat('X', 10) || value || repeat('X', 10)", ALWAYS),
        ("overlapping_prefix", "'test_value_' || value", ALWAYS),
        ("partial_first_half", head, "length(value) // 2 > 0"), ("partial_last_half", tail, CHANGED),
        ("partial_minus_one", "substr(value, 1, length(value) - 1)", "length(value) > 1"),
        ("repeated", "value || ' ' || value", ALWAYS), ("uppercase", "upper(value)", CHANGED),
        ("lowercase", "lower(value)", CHANGED),
        ("mixed_case", mixed, "variant <> value AND variant <> upper(value) AND variant <> lower(value)")]
    within = f"array_to_string(list_transform({GR}, lambda g: reverse(g)), '')"
    order = f"array_to_string(list_reverse({GR}), '')"
    v64, vpct = b64("value"), pcte("value")
    v32 = base32("value", fixed.BASE32)
    bare_hex = f"ltrim({hexl('value')}, '0')"
    out["encoding"] = [
        ("base64_standard", v64, ALWAYS), ("base64_urlsafe", f"translate({v64}, '+/', '-_')", f"variant <> {v64}"),
        ("base64_no_padding", f"rtrim({v64}, '=')", f"variant <> {v64}"),
        ("base64_mime_linebreaks", f"array_to_string(regexp_extract_all({v64}, '.{{1,76}}'), chr(10))", f"length({v64}) > 76"),
        ("base64_partial", f"{head} || {b64(tail)}", ALWAYS), ("base64_double", b64(v64), ALWAYS),
        ("base32_standard", v32, ALWAYS), ("base32_no_padding", f"rtrim({v32}, '=')", f"variant <> {v32}"),
        ("base32_lowercase", f"lower({v32})", ALWAYS), ("base32_hex_alphabet", base32("value", fixed.BASE32_HEX), ALWAYS),
        ("hex_lowercase", hexl("value"), ALWAYS), ("hex_uppercase", "hex(encode(value))", ALWAYS),
        ("hex_escaped_bytes", f"regexp_replace({hexl('value')}, '(..)', '\\\\x\\1', 'g')", ALWAYS),
        ("hex_0x_integer", f"'0x' || CASE WHEN {bare_hex} = '' THEN '0' ELSE {bare_hex} END", ALWAYS),
        ("hex_spaced_bytes", f"rtrim(regexp_replace({hexl('value')}, '(..)', '\\1 ', 'g'))", ALWAYS),
        ("rot13", rot13("value"), letter), ("reversed_full", "reverse(value)", CHANGED),
        ("reversed_within_groups", within, "variant <> raw AND variant <> reverse(value)"),
        ("reversed_group_order", order, f"variant <> raw AND variant <> {within}"),
        ("double_url_encoding", f"replace({vpct}, '%', '%25')", ALWAYS),
        ("double_url_encoding_digits", f"regexp_replace({vpct}, '%(3[0-9])', '%25\\1', 'g')", f"variant <> replace({vpct}, '%', '%25')"),
    ]
    quoted = v64
    for a, b in (("+", "%2B"), ("/", "%2F"), ("=", "%3D")):
        quoted = f"replace({quoted}, '{a}', '{b}')"
    out["encoding_chains"] = [
        ("base64_of_rot13", b64(rot13("value")), ALWAYS), ("base64_of_hex", b64(hexl("value")), ALWAYS),
        ("hex_of_base64", hexl(v64), ALWAYS), ("rot13_of_base64", rot13(v64), ALWAYS), ("url_of_base64", quoted, ALWAYS),
        ("base64_of_base64", b64(v64), ALWAYS), ("base64_of_rot13_of_hex", b64(rot13(hexl("value"))), ALWAYS)]
    wrap = lambda a, b: f"{lit(a)} || value || {lit(b)}"
    out["bidirectional"] = [
        ("rlo_wrap", wrap(fixed.RLO, fixed.PDF), ALWAYS), ("lro_wrap", wrap(fixed.LRO, fixed.PDF), ALWAYS),
        ("rle_embed", wrap(fixed.RLE, fixed.PDF), ALWAYS),
        ("mid_rlo_inject", f"{head} || {lit(fixed.RLO)} || {tail} || {lit(fixed.PDF)}", ALWAYS),
        ("rli_isolate", wrap(fixed.RLI, fixed.PDI), ALWAYS), ("alm_between_chars", join(CH, fixed.ALM), ALWAYS)]
    out["morse_code"] = [(f"morse_{n}_sep", _morse(s), digit) for n, s in (
        ("space", " "), ("slash", "/"), ("no", ""), ("newline", "\n"))]
    shy, wj = fixed.SOFT_HYPHEN, fixed.WORD_JOINER
    two = join("regexp_extract_all(raw, '.{1,2}')", shy)
    out["soft_hyphen"] = [
        ("shy_group_boundaries", join(GR, shy), CHANGED),
        ("shy_2char_boundaries", two, f"variant <> value AND variant <> {join(GR, shy)}"),
        ("shy_between_every_char", join(CH, shy), ALWAYS), ("wj_group_boundaries", join(GR, wj), CHANGED),
        ("wj_between_every_char", join(CH, wj), ALWAYS), ("mixed_shy_wj", alternating(CH, shy, wj), ALWAYS)]
    out["unicode_whitespace"] = [(f"unicode_{n}", join(GR, c), CHANGED) for n, c in fixed.UNICODE_SPACES.items()] + [
        ("unicode_mixed_spaces", alternating(GR, fixed.UNICODE_SPACES["nbsp"], fixed.UNICODE_SPACES["thin_space"]), CHANGED)]
    out["context_injection"] = [(n, f"replace({lit(t)}, '{{value}}', value)", ALWAYS)
                                for n, t in fixed.CONTEXT_TEMPLATES.items()]
    longest = "list_reduce(regexp_extract_all(value, '[^ \\t\\n,;''\"()\\[\\]{}=:]+'), lambda a, t: CASE WHEN length(t) > length(a) THEN t ELSE a END, '')"
    cut = f"greatest(1, least(length({longest}) - 1, length({longest}) // 2 - 1))"
    left, right = f"substr({longest}, 1, {cut})", f"substr({longest}, {cut} + 1)"
    before = f"substr(value, 1, strpos(value, {longest}) - 1)"
    after = f"substr(value, strpos(value, {longest}) + length({longest}))"
    around = lambda core: f"{before} || {core} || {after}"
    enough = f"length({longest}) >= 4"
    pieces = lambda n, sep: f"array_to_string(regexp_extract_all({longest}, '.{{1,{n}}}'), {lit(sep)})"
    out["entropy_evasion"] = [
        ("entropy_split", around(pieces(15, "\n")), enough),
        ("entropy_comment", around(f"{left} || '\";c\";' || {right}"), enough),
        ("entropy_concat", around(f"'\"' || {left} || '\" + \"' || {right} || '\"'"), enough),
        ("entropy_low_mix", around(f"{longest} || repeat('a', 16)"), enough),
        ("entropy_encode", v64, enough), ("entropy_space", around(pieces(4, " ")), enough)]
    return out


VARIANTS = variant_techniques()


def variants(source: str, families, extra: str = "") -> str:
    """SELECT of payload_id, category, value, generator, technique, ordinal, variant over a payload relation."""
    parts = []
    for g in families:
        allowed = K.APPLICABLE.get(g)
        where = f"WHERE category IN {in_list(allowed)}" if allowed else ""
        for i, (name, expr, keep) in enumerate(VARIANTS[g]):
            parts.append(
                f"SELECT * FROM (SELECT payload_id, label{extra}, category, value, '{g}' AS generator, '{name}' AS technique, {i} AS ordinal, "
                f"raw, {expr} AS variant FROM pre {where}) WHERE variant IS NOT NULL AND ({keep})")
    return (f"WITH pay AS ({source}), pre AS (SELECT *, regexp_replace(value, '[^A-Za-z0-9]', '', 'g') AS raw FROM pay) "
            + " UNION ALL ".join(parts))


# --- detection --------------------------------------------------------------------------------------------------------

SPAN_PATTERNS = {
    "credit_card": r"[0-9]{13,19}|(?:[0-9]{4}[ .-]){3}[0-9]{2,4}(?:[ .-][0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "sin": r"[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "ca_ramq": r"[A-Z]{4} [0-9]{4} [0-9]{4}",
    "ipv4_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
SPAN_KEYWORDS = {
    "credit_card": "card|visa|pan|payment|carte", "ssn": "ssn|social security|w-2", "sin": "sin|social insurance|nas|t4",
    "iban": "iban|wire|transfer|bank", "email": "mail|contact|address", "phone": "phone|call|tel",
    "ca_ramq": "ramq|quebec|health", "ipv4_address": "ip|host|server", "aws_key": "aws|key", "jwt": "token|bearer|auth",
}


def _ramq_valid(m: str) -> str:
    month = f"TRY_CAST(substr(replace({m}, ' ', ''), 7, 2) AS INT)"
    return f"coalesce({month} BETWEEN 1 AND 12 OR {month} BETWEEN 51 AND 62, FALSE)"


def confirmed(category: str, m: str) -> str:
    digits_of = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    return {"credit_card": luhn_valid(digits_of), "ssn": ssn_valid(m), "sin": sin_valid(m), "iban": iban_valid(m),
            "ca_ramq": _ramq_valid(m)}.get(category, "TRUE")


def plain_hit(category: str, text: str) -> str:
    found = f"regexp_extract_all({text}, '{SPAN_PATTERNS[category]}')"
    return f"len(list_filter({found}, lambda m: {confirmed(category, 'm')})) > 0"


def compact_hit(category: str, text: str) -> str:
    """On text without delimiters."""
    bare_ssn = "(substr(m, 1, 3) || '-' || substr(m, 4, 2) || '-' || substr(m, 6))"
    rules = {"credit_card": ("[0-9]{13,19}", luhn_valid("m")), "ssn": ("[0-9]{9}", ssn_valid(bare_ssn)),
             "sin": ("[0-9]{9}", sin_valid("m")), "iban": (SPAN_PATTERNS["iban"], iban_valid("m")),
             "email": (SPAN_PATTERNS["email"], "TRUE"), "phone": ("1[2-9][0-9]{9}", "TRUE")}
    pattern, valid = rules[category]
    return f"len(list_filter(regexp_extract_all({text}, '{pattern}'), lambda m: {valid})) > 0"


RUN_CATEGORIES = ("credit_card", "ssn", "sin", "iban", "email", "phone")


def hit(text: str, rule=plain_hit) -> str:
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {rule(c, text)}" for c in RUN_CATEGORIES) + " ELSE FALSE END"


def fold_strings() -> tuple[str, str]:
    pairs: dict[str, str] = {}
    for k, v in fixed.HOMOGLYPHS.items():
        if k.isdigit():
            pairs[v] = k
    for k, v in fixed.HOMOGLYPHS.items():
        pairs.setdefault(v, k)
    for base in [*fixed.DIGIT_BLOCKS.values(), fixed.FULLWIDTH_ZERO]:
        pairs.update({chr(base + i): str(i) for i in range(10)})
    pairs.update({c: " " for c in fixed.UNICODE_SPACES.values()})
    gone = "".join(fixed.ZERO_WIDTH.values()) + fixed.SOFT_HYPHEN + fixed.WORD_JOINER + "".join(
        (fixed.RLO, fixed.LRO, fixed.RLE, fixed.PDF, fixed.RLI, fixed.PDI, fixed.ALM))
    return "".join(pairs) + gone, "".join(pairs.values())


ENTITY = "&#[xX]?[0-9a-fA-F]{1,6};"


def normalise_steps(source: str, column: str, keep: str = "*") -> str:
    """A chain of selects over ``source`` that ends with the column ``norm``; numeric entities must be code points."""
    body = "regexp_replace(ents[i], '[&#;]', '', 'g')"
    number = f"CASE WHEN lower(left({body}, 1)) = 'x' THEN CAST('0x' || substr({body}, 2) AS INT) ELSE CAST({body} AS INT) END"
    named = "e0"
    for name, ch in (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        named = f"replace({named}, '{name}', {lit(ch)})"
    once = "CASE WHEN contains({0}, '%') THEN url_decode({0}) ELSE {0} END"
    source_chars, target_chars = fold_strings()
    return (
        f"SELECT * EXCLUDE (pieces, ents, e0, e1, e2), translate(regexp_replace(regexp_replace(e2, '(?s)<!--.*?-->', '', 'g'), "
        f"'(?s)/\\*.*?\\*/', '', 'g'), {lit(source_chars)}, {lit(target_chars)}) AS norm FROM ("
        f"SELECT *, {once.format('e1')} AS e2 FROM (SELECT *, {once.format('named_')} AS e1 FROM (SELECT *, {named} AS named_ FROM ("
        f"SELECT *, CASE WHEN len(ents) > 0 THEN array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: "
        f"pieces[i] || CASE WHEN i <= len(ents) THEN chr({number}) ELSE '' END), '') ELSE {column} END AS e0 FROM ("
        f"SELECT {keep}, string_split_regex({column}, '{ENTITY}') AS pieces, regexp_extract_all({column}, '{ENTITY}') AS ents "
        f"FROM ({source}))))))"
    ).replace("EXCLUDE (pieces, ents, e0, e1, e2)", "EXCLUDE (pieces, ents, e0, named_, e1, e2)")


RUN_FAMILIES = ("delimiter", "structural", "unicode_encoding")


def run_rows(normalised: bool = False) -> str:
    """Outcome rows of all customer payloads, as the Spark side stores them."""
    base = variants(CUSTOMER_PAYLOADS, RUN_FAMILIES, ", c_acctbal")
    rule = "CASE WHEN category IN ('email', 'phone') THEN 0.6 ELSE 0.95 END"
    if normalised:
        base = normalise_steps(base, "variant")
        compact = "regexp_replace(norm, '[\\s./_-]+', '', 'g')"
        score = (f"CASE WHEN {hit('variant')} THEN {rule} WHEN {hit('norm')} THEN {rule} * 0.9::DOUBLE "
                 f"WHEN {hit(compact, compact_hit)} THEN {rule} * 0.8::DOUBLE END")
    else:
        score = f"CASE WHEN {hit('variant')} THEN {rule} END"
    return (
        "SELECT payload_id, label, category, payload_value, generator, technique, ordinal, strategy, variant, detected, "
        "CASE WHEN detected THEN score::DOUBLE END AS confidence, error, CASE WHEN error <> '' THEN 'error' WHEN detected THEN 'pass' ELSE 'fail' END AS severity "
        "FROM (SELECT *, error = '' AND score IS NOT NULL AS detected FROM (SELECT payload_id, label, category, value AS payload_value, generator, "
        "technique, ordinal, strategy, variant, CASE WHEN strategy = 'docx' AND c_acctbal < 0 THEN 'extraction failed' ELSE '' END AS error, score "
        f"FROM (SELECT *, {score} AS score FROM ({base})) CROSS JOIN (SELECT unnest(['text', 'docx']) AS strategy)))"
    )


RESULTS = run_rows()
RESULTS_NORMALISED = run_rows(True)
COUNTS = ("count(*) AS total, count(*) FILTER (WHERE severity = 'pass') AS pass, count(*) FILTER (WHERE severity = 'fail') AS fail, "
          "count(*) FILTER (WHERE severity = 'error') AS error")
