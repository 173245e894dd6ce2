"""Queries over documents, pages and conversations: spans, normalisation, exact match, entropy, near-duplicates."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.entropy import core_token, shannon
from detectlab.functions.shingles import jaccard, shingles
from detectlab.operators import detect as D
from detectlab.operators import entropyscan as N
from detectlab.operators import exactmatch as X
from detectlab.operators import neardup as L
from detectlab.operators import sigindex as I
from detectlab.functions.nearmiss import wrap_in_context
from detectlab.operators.corpus import synthetic_values
from detectlab.operators.variants import expand_variants
from detectlab.plans import derived
from detectlab.plans import sqlref as S
from detectlab.plans.registry import query
from detectlab.plans.value_queries import synth_sql
from detectlab.session import read_table, shared_dir, spread

KEY = "edm-key"


def _docs(spark, sf_dir, *columns):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", *(columns or ("text",))))


# --- spans ------------------------------------------------------------------------------------------------------------

def spans_sql(table: str, key: str, categories=tuple(S.SPAN_PATTERNS)) -> str:
    """Confirmed matches with their 1-based start, from the pieces between matches."""
    parts = []
    for c in categories:
        p = S.SPAN_PATTERNS[c]
        start = ("list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(ms[i]) + "
                 "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + 1")
        parts.append(
            f"SELECT {key}, '{c}' AS category, ms[i] AS match, CAST({start} AS INT) AS start, text FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ("
            f"SELECT {key}, text, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS pieces FROM {table})) WHERE {S.confirmed(c, 'ms[i]')}")
    return " UNION ALL ".join(parts)


@query("detect_spans_documents", f"SELECT doc_id, category, match, start FROM ({spans_sql('documents', 'doc_id')})")
def detect_spans_documents(spark, sf_dir):
    return D.find_spans(_docs(spark, sf_dir), ["doc_id"])


@query("detect_spans_conversations",
       "SELECT conv_id, turn, category, match, start FROM (" + spans_sql("(SELECT conv_id, turn, text FROM conversations)", "conv_id, turn") + ")")
def detect_spans_conversations(spark, sf_dir):
    rows = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return D.find_spans(rows, ["conv_id", "turn"])


_MESSAGES = f"(SELECT conv_id, turn, text || ' - card ' || {S.card('conv_id * 100 + turn')} || CASE WHEN turn % 2 = 0 THEN '' ELSE ', mail me' || conv_id || '@mail.example.com' END AS text FROM conversations)"


@query("detect_spans_messages", "SELECT conv_id, turn, category, match, start FROM (" + spans_sql(_MESSAGES, "conv_id, turn") + ")")
def detect_spans_messages(spark, sf_dir):
    """Messages that end with a card number, and every second one with an address."""
    rows = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    mail = F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(", mail me"), F.col("conv_id").cast("string"), F.lit("@mail.example.com")))
    text = F.concat("text", F.lit(" - card "), derived.card_number(F.col("conv_id") * 100 + F.col("turn")), mail)
    return D.find_spans(rows.select("conv_id", "turn", text.alias("text")), ["conv_id", "turn"])


_IDENTIFIERS = ("cusip_num", "sedol_num", "isin", "figi_num", "lei_num", "br_cpf", "de_tax_id", "au_medicare", "uk_nin")
_ID_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{c}' AS category, value FROM ({synth_sql(c)})" for c in _IDENTIFIERS)


@query("detect_spans_identifiers",
       f"SELECT c_custkey, category, value AS match, 5 AS start FROM ({_ID_SQL}) WHERE c_custkey % 2 = 0")
def detect_spans_identifiers(spark, sf_dir):
    """One drawn identifier a line; every second line has its last digit, or first letter, changed and must not be found."""
    ids = spread(read_table(spark, sf_dir, "customer").select("c_custkey"))
    lines = synthetic_values(ids, "c_custkey", _IDENTIFIERS, 42)
    # The check digit is the last sign, in Medicare numbers the one before the issue number.
    turned = lambda keep: F.expr(f"concat(left(value, length(value) - {keep}), translate(substr(value, length(value) - {keep} + 1, 1), '0123456789', '1234567890'), right(value, {keep} - 1))")
    broken = (F.when(F.col("category") == "uk_nin", F.concat(F.lit("D"), F.substr("value", F.lit(2))))
              .when(F.col("category") == "au_medicare", turned(3)).otherwise(turned(1)))
    text = F.concat(F.lit("id: "), F.when(F.col("c_custkey") % 2 == 0, F.col("value")).otherwise(broken))
    found = D.find_spans(lines.select("c_custkey", F.col("category").alias("own"), text.alias("text")), ["c_custkey", "own"], categories=_IDENTIFIERS)
    return found.filter(F.col("own") == F.col("category")).select("c_custkey", "category", "match", "start")


_WINDOW = "substr(text, greatest(start - 80, 1), start + length(match) + 80 - greatest(start - 80, 1))"
_NEAR = "CASE category " + " ".join(f"WHEN '{c}' THEN regexp_matches(lower({_WINDOW}), '{k}')" for c, k in S.SPAN_KEYWORDS.items()) + " END"


@query("detect_context_gate", f"SELECT doc_id, category, match, start FROM ({spans_sql('documents', 'doc_id')}) WHERE {_NEAR}")
def detect_context_gate(spark, sf_dir):
    return D.find_spans(_docs(spark, sf_dir), ["doc_id"], gate=True)


@query("normalise_documents", "SELECT doc_id, md5(norm) AS digest FROM (" + S.normalise_steps("SELECT doc_id, text FROM documents", "text") + ")")
def normalise_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(D.normalise(F.col("text"))).alias("digest"))


@query("normalise_pages", "SELECT page_id, md5(norm) AS digest FROM (" + S.normalise_steps("SELECT page_id, html FROM pages", "html") + ")")
def normalise_pages(spark, sf_dir):
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.md5(D.normalise(F.col("html"))).alias("digest"))


_REVERSIBLE = ("unicode_encoding", "bidirectional", "soft_hyphen", "unicode_whitespace", "regional_digits")


@query("normalise_variants",
       f"SELECT payload_id, generator, technique, norm FROM ({S.normalise_steps(S.variants(S.SUPPLIER_PAYLOADS, _REVERSIBLE), 'variant')})")
def normalise_variants(spark, sf_dir):
    rows = expand_variants(derived.supplier_payloads(spark, sf_dir), generators=_REVERSIBLE, normal_form_rows=False)
    return rows.select("payload_id", "generator", "technique", D.normalise(F.col("variant")).alias("norm"))


_DECODED = ("encoding_chains",)
_UN64 = "try(decode(from_base64({0})))"
_UNHEX = "CASE WHEN regexp_full_match({0}, '([0-9a-f]{{2}})+') THEN try(decode(unhex({0}))) END"
_VIEWS = {
    "base64_of_rot13": S.rot13(_UN64.format("variant")), "base64_of_hex": _UNHEX.format(_UN64.format("variant")),
    "hex_of_base64": _UN64.format(_UNHEX.format("variant")), "rot13_of_base64": _UN64.format(S.rot13("variant")),
    "base64_of_base64": _UN64.format(_UN64.format("variant")),
}


@query("decode_views",
       "SELECT generator, technique, category, count(*) AS n, count(*) AS recovered FROM ("
       + S.variants(S.SUPPLIER_PAYLOADS, _DECODED) + ") WHERE technique IN " + S.in_list(_VIEWS) + " AND value = CASE technique "
       + " ".join(f"WHEN '{t}' THEN {e}" for t, e in _VIEWS.items()) + " END GROUP BY ALL")
def decode_views(spark, sf_dir):
    """Two-layer chains: the payload itself is among the decoded views of every variant."""
    rows = expand_variants(derived.supplier_payloads(spark, sf_dir), generators=_DECODED, techniques=list(_VIEWS), normal_form_rows=False)
    found = F.array_contains(D.decoded_views(F.col("variant")), F.col("value"))
    return rows.groupBy("generator", "technique", "category").agg(F.count("*").alias("n"), F.count_if(found).alias("recovered"))


_COMPACT_SQL = "regexp_replace({0}, '[\\s./_-]+', '', 'g')"


def _seen_sql(text: str) -> str:
    return f"({S.hit(text)} OR {S.hit(_COMPACT_SQL.format(text), S.compact_hit)})"


#: Techniques that no layer undoes: only the text itself, reversed or rotated, can match.
_UNDONE_BY_NOTHING = ("base64_partial", "reversed_group_order", "reversed_within_groups")


@query("detection_run_decoded",
       f"SELECT generator, technique, count(*) AS n, count(*) FILTER (WHERE CASE WHEN technique IN {S.in_list(_UNDONE_BY_NOTHING)} "
       f"THEN {S.hit('variant')} OR {_seen_sql('reverse(variant)')} OR ({S.rot13('variant')} <> variant AND {_seen_sql(S.rot13('variant'))}) OR {_seen_sql(S.rot13('reverse(variant)'))} ELSE {_seen_sql('value')} END) AS detected "
       f"FROM ({S.variants(S.SUPPLIER_PAYLOADS, ['encoding', 'encoding_chains'])}) GROUP BY ALL")
def detection_run_decoded(spark, sf_dir):
    """Encoded variants with layered decoding: what an encoding can be undone for is found where the plain value is."""
    rows = expand_variants(derived.supplier_payloads(spark, sf_dir), generators=["encoding", "encoding_chains"], normal_form_rows=False)
    run = D.run_detection(rows, decode=True)
    return run.groupBy("generator", "technique").agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"))


_FORMS = ("mathematical", "circled", "superscript", "ligature", "hangul", "entities")
_EACH_DIGIT = {"mathematical": "".join(chr(0x1D7CE + i) for i in range(10)), "circled": chr(0x24EA) + "".join(chr(0x2460 + i) for i in range(9)),
               "superscript": "\u2070\u00b9\u00b2\u00b3" + "".join(chr(0x2070 + i) for i in range(4, 10))}


@query("normalise_compatibility",
       "SELECT c_custkey, form, CASE form " + " ".join(f"WHEN '{f}' THEN 'no ' || CAST(c_custkey * 7919 AS VARCHAR)" for f in _EACH_DIGIT)
       + " WHEN 'ligature' THEN 'office file ' || CAST(c_custkey AS VARCHAR) || ' flows' WHEN 'hangul' THEN chr(CAST(44032 + c_custkey * 29 % 11172 AS INT)) "
       f"WHEN 'entities' THEN 'caf\u00e9 \u20ac' || CAST(c_custkey AS VARCHAR) || ' 1\u20442 &nosuch; <b>' END AS norm FROM customer CROSS JOIN (SELECT unnest({S.array(_FORMS)}) AS form)")
def normalise_compatibility(spark, sf_dir):
    """Compatibility forms and entities: digits of other kinds, ligatures, Hangul spelt in letters, named entities."""
    key = F.col("c_custkey")
    syllable = (key * 29) % 11172
    final = syllable % 28
    jamo = F.concat(D.code_point_text(F.floor(syllable / 588) + 0x1100), D.code_point_text(F.floor(syllable % 588 / 28) + 0x1161),
                    F.when(final > 0, D.code_point_text(final + 0x11A7)).otherwise(""))
    texts = {form: F.concat(F.lit("no "), F.translate((key * 7919).cast("string"), "0123456789", digits)) for form, digits in _EACH_DIGIT.items()}
    texts["ligature"] = F.concat(F.lit("o\ufb03ce \ufb01le "), key.cast("string"), F.lit(" \ufb02ows"))
    texts["hangul"] = jamo
    texts["entities"] = F.concat(F.lit("caf&eacute;&nbsp;&euro;"), key.cast("string"), F.lit(" &frac12; &nosuch; &lt;b&gt;"))
    rows = spread(read_table(spark, sf_dir, "customer").select("c_custkey")).select(
        "c_custkey", F.inline(F.array(*[F.struct(F.lit(f).alias("form"), texts[f].alias("text")) for f in _FORMS])))
    return rows.select("c_custkey", "form", D.normalise(F.col("text")).alias("norm"))


_WRAPPED = "replace(CASE category " + " ".join(f"WHEN '{c}' THEN {S.lit(t)}" for c, t in fixed.WRAP_TEMPLATES.items()) + f" ELSE {S.lit(fixed.WRAP_FALLBACK)} END, '{{value}}', variant)"
_SURE = ("credit_card", "ssn", "sin", "iban")


@query("detection_run_wrapped",
       f"SELECT category, technique, count(*) AS n, count(*) FILTER (WHERE category IN {S.in_list(_SURE)} AND {S.hit('t')}) AS detected FROM (SELECT *, {_WRAPPED} AS t FROM ({S.variants(S.SUPPLIER_PAYLOADS, ['structural'])})) GROUP BY ALL")
def detection_run_wrapped(spark, sf_dir):
    """Values in a sentence of their category; only matches that a check digit confirms count."""
    rows = expand_variants(derived.supplier_payloads(spark, sf_dir), generators=["structural"], normal_form_rows=False)
    run = D.run_detection(rows, wrap=wrap_in_context, min_confidence=0.9)
    return run.groupBy("category", "technique").agg(F.count("*").alias("n"), F.count_if("detected").alias("detected"))


# --- exact-data match -------------------------------------------------------------------------------------------------

_COMPAT_FROM = "".join(fixed.UNICODE_SPACES.values()) + "".join(chr(0xFF01 + i) for i in range(94))
_COMPAT_TO = " " * len(fixed.UNICODE_SPACES) + "".join(chr(0x21 + i) for i in range(94))


def _norm(e: str) -> str:
    return f"regexp_replace(lower({S.translate(e, _COMPAT_FROM, _COMPAT_TO)}), '[\\s\\-./()]+', '', 'g')"


def _hash(e: str) -> str:
    return f"sha256('{KEY}' || {e})"


_VALUES = ("SELECT DISTINCT category, category AS label, match AS value FROM (" + spans_sql("documents", "doc_id", ("credit_card", "email", "ipv4_address"))
           + ") UNION ALL SELECT DISTINCT 'part_name' AS category, 'part' AS label, p_name AS value FROM part")
_DICT = (f"SELECT category, {_hash('n')} AS value_hash, min(label) AS label, max(length(n)) AS n_chars, max(len(string_split_regex(trim(value), '\\s+'))) AS n_words "
         f"FROM (SELECT *, {_norm('value')} AS n FROM ({_VALUES})) WHERE n <> '' GROUP BY ALL")


def registered_values(spark, sf_dir):
    """Values to register: what the rules confirm in documents, and two-word part names."""
    spans = D.find_spans(_docs(spark, sf_dir), ["doc_id"], categories=["credit_card", "email", "ipv4_address"])
    found = spans.select("category", F.col("category").alias("label"), F.col("match").alias("value")).distinct()
    parts = read_table(spark, sf_dir, "part").select("p_name").distinct().select(
        F.lit("part_name").alias("category"), F.lit("part").alias("label"), F.col("p_name").alias("value"))
    return found.unionByName(parts)


@query("edm_register", f"SELECT category, value_hash, label, n_chars, n_words FROM ({_DICT})")
def edm_register(spark, sf_dir):
    return X.register_values(registered_values(spark, sf_dir), KEY).drop("probe")


@query("edm_registration_counts",
       f"SELECT 'edm:' || category AS category, count(*) AS entries, count(DISTINCT value_hash) AS hashes, count(DISTINCT value_hash) > 50000 AS over_limit FROM ({_DICT}) GROUP BY category")
def edm_registration_counts(spark, sf_dir):
    return X.registration_counts(X.register_values(registered_values(spark, sf_dir), KEY))


_CLEAN = "regexp_replace(t, '^[,;:!?\"''<>\\[\\]{}]+|[,;:!?\"''<>\\[\\]{}]+$', '', 'g')"


def _found_sql(texts: str) -> str:
    """Tokens with the places of their characters in the text; a run is a start and an end that a length apart stand."""
    tokens = f"list_filter(list_transform(string_split_regex({S.translate('text', _COMPAT_FROM, _COMPAT_TO)}, '\\s+'), lambda t: {_norm(_CLEAN)}), lambda t: t <> '')"
    return (f"WITH known AS (SELECT *, {_norm('value')} AS n FROM ({_VALUES})), dict AS ({_DICT}), "
            "heads AS (SELECT DISTINCT left(n, 4) AS head FROM known WHERE length(n) >= 4), short AS (SELECT count(*) AS n FROM known WHERE length(n) BETWEEN 1 AND 3), "
            f"lists AS (SELECT doc_id, {tokens} AS ts FROM ({texts})), joined AS (SELECT doc_id, array_to_string(ts, '') AS j FROM lists), "
            "ts AS (SELECT doc_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM lists), "
            "placed AS (SELECT doc_id, i, sum(length(t)) OVER w AS e, length(t) AS n, "
            "left(t || coalesce(lead(t, 1) OVER w, '') || coalesce(lead(t, 2) OVER w, '') || coalesce(lead(t, 3) OVER w, ''), 4) AS head FROM ts WINDOW w AS (PARTITION BY doc_id ORDER BY i)), "
            "starts AS (SELECT * FROM placed WHERE head IN (SELECT head FROM heads) OR (SELECT n FROM short) > 0), "
            "runs AS (SELECT a.doc_id, a.i, b.i AS j, a.e - a.n + 1 AS at, l.len FROM starts a JOIN (SELECT DISTINCT n_chars AS len FROM dict) l ON TRUE "
            "JOIN placed b ON b.doc_id = a.doc_id AND b.e = a.e - a.n + l.len), "
            "spelt AS (SELECT r.doc_id, r.i, r.j, substr(t.j, CAST(r.at AS BIGINT), CAST(r.len AS BIGINT)) AS run FROM runs r JOIN joined t USING (doc_id)) "
            f"SELECT doc_id, CAST(i AS INT) AS position, CAST(j - i + 1 AS INT) AS words, category, label, value_hash FROM spelt JOIN dict ON {_hash('run')} = value_hash")


_FOUND = _found_sql("SELECT doc_id, text FROM documents")


def _dictionary(spark, sf_dir):
    return derived.stored(spark, sf_dir, "dictionary", lambda: X.register_values(registered_values(spark, sf_dir), KEY))


def _found(spark, sf_dir):
    dictionary = _dictionary(spark, sf_dir)
    return dictionary, X.find_registered(_docs(spark, sf_dir), ["doc_id"], "text", dictionary, KEY)


@query("edm_find_documents", _FOUND)
def edm_find_documents(spark, sf_dir):
    return _found(spark, sf_dir)[1]


@query("edm_match_rate",
       f"SELECT category, registered, found, {S.pct('found', 'registered')} AS match_pct FROM (SELECT d.category, count(*) AS registered, count(h.value_hash) AS found FROM ({_DICT}) d LEFT JOIN "
       f"(SELECT DISTINCT category, value_hash FROM ({_FOUND})) h USING (category, value_hash) GROUP BY d.category)")
def edm_match_rate(spark, sf_dir):
    return X.match_rate(*_found(spark, sf_dir))


def _four(sep: str) -> str:
    return (f"CASE WHEN length(value) <= 4 THEN value || {S.lit(sep)} || left(value, 1) ELSE array_to_string(regexp_extract_all(value, '(?s).{{1,4}}'), {S.lit(sep)}) END")


_PROBES = {"exact": "value", "uppercase": "upper(value)", "lowercase": "lower(value)", "dashes": _four("-"), "spaces": _four(" "), "dots": _four("."),
           "slashes": _four("/"), "nbsp_spaces": _four("\u00a0"), "homoglyph_0": f"replace(value, '0', {S.lit(chr(0x41e))})",
           "homoglyph_o": f"replace(value, 'o', {S.lit(chr(0x43e))})", "zero_width": _four("\u200b")}
_PROBED = " UNION ALL ".join(f"SELECT '{n}' AS probe, {e} AS text FROM vals" for n, e in _PROBES.items())


_TYPED = {"spaces": _four(" "), "dashes": _four("-"), "dots": _four("."), "wide": "array_to_string(string_split(value, ''), '  ')"}
_TYPED_TEXTS = (f"SELECT row_number() OVER (ORDER BY category, value, form) AS doc_id, text FROM (" + " UNION ALL ".join(
    f"SELECT category, value, '{form}' AS form, 'see ' || {e} || ', please' AS text FROM vals" for form, e in _TYPED.items()) + ")")


@query("edm_find_typed", f"WITH vals AS (SELECT DISTINCT category, value FROM ({_VALUES})), found AS ({_found_sql(_TYPED_TEXTS)}) "
       "SELECT category, position, words, count(*) AS n FROM found GROUP BY ALL")
def edm_find_typed(spark, sf_dir):
    """Registered values as people write them: in groups of four by spaces, dashes or dots, and letter by letter."""
    values = registered_values(spark, sf_dir).select("category", "value").distinct()
    value = F.col("value")
    forms = {form: X.every_four(value, sep) for form, sep in (("spaces", " "), ("dashes", "-"), ("dots", "."))}
    forms["wide"] = F.array_join(F.split(value, ""), "  ")
    texts = values.select(F.inline(F.array(*[F.struct(
        F.concat_ws("/", "category", "value", F.lit(form)).alias("doc_id"), F.concat(F.lit("see "), e, F.lit(", please")).alias("text")) for form, e in forms.items()])))
    found = X.find_registered(texts, ["doc_id"], "text", _dictionary(spark, sf_dir), KEY)
    return found.groupBy("category", "position", "words").agg(F.count("*").alias("n"))


@query("edm_probe_report",
       f"WITH vals AS ({_VALUES}), known AS (SELECT DISTINCT value_hash FROM ({_DICT})) SELECT probe, tested, detected, {S.pct('detected', 'tested')} AS detected_pct, "
       f"CASE WHEN detected * 100 >= tested * 99 THEN 'yes' WHEN detected * 100 >= tested * 20 THEN 'partial' ELSE 'no' END AS absorbed FROM (SELECT probe, count(*) AS tested, "
       f"count(k.value_hash) AS detected FROM ({_PROBED}) p LEFT JOIN known k ON {_hash(_norm('p.text'))} = k.value_hash GROUP BY probe)")
def edm_probe_report(spark, sf_dir):
    values = registered_values(spark, sf_dir)
    return X.probe_report(values, X.register_values(values, KEY), KEY)


# --- entropy ----------------------------------------------------------------------------------------------------------

def _entropy(e: str) -> str:
    chars = f"string_split({e}, '')"
    share = f"(length({e}) - length(replace({e}, c, '')))::DOUBLE / length({e})"
    return f"CASE WHEN {e} = '' THEN 0.0::DOUBLE ELSE list_sum(list_transform(list_sort(list_distinct({chars})), lambda c: -({share}) * log2({share}))) END"


@query("entropy_of_labels", f"SELECT p_partkey, round({_entropy('p_name')}, 6) AS entropy FROM part")
def entropy_of_labels(spark, sf_dir):
    part = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    return part.select("p_partkey", F.round(shannon(F.col("p_name")), 6).alias("entropy"))


LOW = 3.0
_TOKEN = "[^\\s,;''\"()\\[\\]{}=:]{16,}"
_TOKENS_SQL = (
    "SELECT doc_id, token, CAST(list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(ms[i]) + list_sum(list_transform(pieces[1:i], lambda x: length(x))) + 1 AS INT) AS start, text "
    f"FROM (SELECT *, ms[i] AS token FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{_TOKEN}') AS ms, "
    f"string_split_regex(text, '{_TOKEN}') AS pieces FROM documents))) WHERE {_entropy('token')} > {LOW}")
_GATE = f"regexp_matches(lower(substr(text, greatest(start - 80, 1), start + length(token) + 80 - greatest(start - 80, 1))), '{N.GATE_WORDS}')"
_ASSIGN = "regexp_matches(substr(text, greatest(start - 60, 1), start - greatest(start - 60, 1)), '[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*[\"'']?$')"
for _mode, _where in (("all", "TRUE"), ("gated", _GATE), ("assignment", _ASSIGN), ("off", "FALSE")):
    def _entropy_query(mode):
        def run(spark, sf_dir):
            rows = N.high_entropy_tokens(_docs(spark, sf_dir), ["doc_id"], mode=mode, threshold=LOW)
            return rows.select("doc_id", "token", "start", F.round("entropy", 6).alias("entropy"))

        return run

    query(f"entropy_tokens_{_mode}", f"SELECT doc_id, token, start, round({_entropy('token')}, 6) AS entropy FROM ({_TOKENS_SQL}) WHERE {_where}")(_entropy_query(_mode))


def _after(sep: str) -> str:
    return f"CASE WHEN strpos(v, '{sep}') > 0 THEN nullif(trim(substr(v, strpos(v, '{sep}') + {len(sep)})), '') END"


@query("entropy_core_token", f"SELECT event_id, coalesce({_after('=')}, {_after(': ')}, {_after(':')}, v) AS core FROM (SELECT event_id, "
                             "(['a=b', 'key: tail', 'k:v', 'bare', 'x=', 'n: =q'])[CAST(event_id % 6 AS INT) + 1] || props AS v FROM events)")
def entropy_core_token(spark, sf_dir):
    head = F.element_at(F.array(*[F.lit(x) for x in ("a=b", "key: tail", "k:v", "bare", "x=", "n: =q")]), (F.col("event_id") % 6 + 1).cast("int"))
    events = read_table(spark, sf_dir, "events").select("event_id", F.concat(head, F.col("props")).alias("v"))
    return events.select("event_id", core_token(F.col("v")).alias("core"))


_SECRETS = "SELECT o_orderkey, (['random_api_key', 'random_token'])[CAST(o_orderkey % 2 AS INT) + 1] AS category, CASE WHEN o_orderkey % 2 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE 'n' || CAST(o_orderkey AS VARCHAR) END AS value FROM orders"


def _secrets(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    orders = spread(read_table(spark, sf_dir, "orders").select("o_orderkey"))
    return orders.select("o_orderkey", F.when(odd, "random_token").otherwise("random_api_key").alias("category"),
                         F.when(odd, F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).otherwise(
                             F.md5(F.col("o_orderkey").cast("string"))).alias("value"))


_PIECES = "list_filter(string_split_regex(t, '[\\s,;''\"()\\[\\]{}=:]'), lambda x: length(x) >= 16)"
_ANY = f"len(list_filter({_PIECES}, lambda x: {_entropy('x')} > {LOW})) > 0"
_HAS = {"off": "FALSE", "all": _ANY, "gated": f"({_ANY} AND regexp_matches(lower(t), '{N.GATE_WORDS}'))",
        "assignment": f"({_ANY} AND regexp_matches(t, '[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*[\"'']?[^\\s,;''\"()\\[\\]{{}}=:]{{16,}}'))"}
_CTX = " UNION ALL ".join(f"SELECT category, '{c}' AS context, replace('{t}', '{{value}}', value) AS t FROM s" for c, t in N.CONTEXTS.items())


@query("entropy_context_report",
       f"WITH s AS ({_SECRETS}), c AS ({_CTX}) SELECT category, " + ", ".join(
           f"count(*) FILTER (WHERE context = '{c}') AS {c}_tested, count(*) FILTER (WHERE context = '{c}' AND {_HAS['gated']}) AS {c}_detected" for c in N.CONTEXTS) + " FROM c GROUP BY category")
def entropy_context_report(spark, sf_dir):
    return N.context_report(_secrets(spark, sf_dir), "gated", LOW)


@query("entropy_mode_coverage",
       f"WITH s AS ({_SECRETS}), c AS ({_CTX}) SELECT *, {S.pct('detected_expected', 'total_expected')} AS coverage_pct FROM (" + " UNION ALL ".join(
           f"SELECT '{m}' AS mode, count(*) FILTER (WHERE context IN {S.in_list(N.EXPECTED[m] or ('-',))}) AS total_expected, "
           f"count(*) FILTER (WHERE context IN {S.in_list(N.EXPECTED[m] or ('-',))} AND {_HAS[m]}) AS detected_expected FROM c" for m in N.MODES) + ")")
def entropy_mode_coverage(spark, sf_dir):
    return N.mode_coverage(_secrets(spark, sf_dir), LOW)


@query("entropy_defeat_counts",
       f"SELECT technique, count(*) AS tested, count(*) FILTER (WHERE NOT ({_ANY})) AS defeated FROM (SELECT *, variant AS t FROM ({S.variants(S.SUPPLIER_PAYLOADS, ['entropy_evasion'])})) GROUP BY technique")
def entropy_defeat_counts(spark, sf_dir):
    rows = expand_variants(derived.supplier_payloads(spark, sf_dir), generators=["entropy_evasion"], normal_form_rows=False)
    return N.defeat_counts(rows, LOW)


# --- near-duplicates --------------------------------------------------------------------------------------------------

def words_sql(e: str) -> str:
    return f"list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> '')"


# The word list is bound in an inner select and zipped with itself: a SQL lambda would copy it once per word.
_SH = ("SELECT {k}, CASE WHEN low = '' THEN []::VARCHAR[] WHEN len(w) >= 3 THEN list_distinct(list_transform(list_zip(w, w[2:], w[3:], true), lambda x: x[1] || ' ' || x[2] || ' ' || x[3])) "
       "ELSE list_distinct(list_transform(range(1, length(low) - least(3, length(low)) + 2), lambda i: substr(low, CAST(i AS INT), CAST(least(3, length(low)) AS INT)))) END AS s "
       "FROM (SELECT {k}, lower({t}) AS low, list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: x <> '') AS w FROM {f})")


@query("neardup_shingles", "SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS digest FROM (" + _SH.format(k="doc_id", t="text", f="documents") + ")")
def neardup_shingles(spark, sf_dir):
    s = F.array_sort(shingles(F.col("text")))
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select(
        "doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _jaccard_sql(keep: str, source: str) -> str:
    """keep columns and the Jaccard similarity of the list columns a and b of ``source``."""
    return (f"SELECT {keep}, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE c::DOUBLE / (n - c) END AS jaccard FROM "
            f"(SELECT {keep}, len(a) + len(b) AS n, len(list_intersect(a, b)) AS c FROM {source})")



@query("neardup_jaccard_of_turns",
       "WITH u AS (" + _SH.format(k="conv_id, turn", t="text", f="conversations") + ") SELECT conv_id, turn, round(jaccard, 6) AS jaccard FROM ("
       + _jaccard_sql("conv_id, turn", "(SELECT x.conv_id, x.turn, x.s AS a, y.s AS b FROM u x JOIN u y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)") + ")")
def neardup_jaccard_of_turns(spark, sf_dir):
    """Each turn against the next one of its conversation: an equi-join on (conversation, turn)."""
    rows = spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).select(
        "conv_id", "turn", shingles(F.col("text")).alias("s"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("next"))
    return rows.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(jaccard(F.col("s"), F.col("next")), 6).alias("jaccard"))


def _distorted(rates, seed: int, each: bool) -> str:
    of_rate = "CAST(rate AS VARCHAR) || '|' || " if each else ""
    h = f"md5('{seed}|distort|' || CAST(doc_id AS VARCHAR) || '|' || {of_rate}CAST(i - 1 AS VARCHAR))"
    bare = "regexp_replace(x, '^[.,;:()]+|[.,;:()]+$', '', 'g')"
    keep = f"(regexp_matches(x, '[0-9@$]') OR (length({bare}) >= 2 AND upper({bare}) = {bare} AND lower({bare}) <> {bare}))"
    filler = S.array(fixed.DISTORTION_WORDS)
    word = (f"CASE WHEN {keep} THEN x WHEN CAST('0x' || substr({h}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < rate THEN ({filler})[CAST(CAST('0x' || substr({h}, 9, 8) AS BIGINT) % {len(fixed.DISTORTION_WORDS)} AS INT) + 1] ELSE x END")
    steps = ", ".join(f"{{'step': {i}, 'rate': {r}::DOUBLE}}" for i, r in enumerate(rates))
    return (f"SELECT doc_id, step, rate AS distortion, text, array_to_string(list_transform({words_sql('text')}, lambda x, i: {word}), ' ') AS variant_text "
            f"FROM (SELECT doc_id, text, u.step AS step, u.rate AS rate FROM (SELECT doc_id, text, unnest([{steps}]) AS u FROM documents))")


def _ladder_sql(rates, seed: int = 0, each: bool = False) -> str:
    return ("WITH v AS (" + _distorted(rates, seed, each) + "), a AS (" + _SH.format(k="doc_id", t="text", f="documents") + "), b AS ("
            + _SH.format(k="doc_id, step, distortion, md5(variant_text) AS digest", t="variant_text", f="v").replace(
                "md5(variant_text) AS digest, CASE", "digest, CASE") + ") "
            + _jaccard_sql("doc_id, step, distortion, digest", "(SELECT b.doc_id, b.step, b.distortion, b.digest, a.s AS a, b.s AS b FROM b JOIN a USING (doc_id))"))


@query("neardup_ladder", "SELECT doc_id, step, distortion, digest, round(jaccard, 6) AS jaccard FROM (" + _ladder_sql(fixed.DISTORTION_RATES) + ")")
def neardup_ladder(spark, sf_dir):
    steps = L.ladder(_docs(spark, sf_dir), "doc_id", "text")
    return steps.select("doc_id", "step", "distortion", F.md5("variant_text").alias("digest"), F.round("jaccard", 6).alias("jaccard"))


@query("neardup_corpus_manifest", "SELECT doc_id AS base, step AS variant, round(distortion, 4) AS distortion, round(jaccard, 4) AS jaccard FROM ("
       + _ladder_sql(tuple(L.corpus_rates(6)), each=True) + ")")
def neardup_corpus_manifest(spark, sf_dir):
    return L.neardup_manifest(_docs(spark, sf_dir), "doc_id", "text", variants=6)


_THRESHOLDS = (0.3, 0.5, 0.7, 0.83)


@query("neardup_threshold_report",
       "SELECT threshold, count(*) AS variants, count(*) FILTER (WHERE jaccard >= threshold) AS detected, min(jaccard) FILTER (WHERE jaccard >= threshold) AS lowest_detected, "
       "count(*) FILTER (WHERE jaccard >= threshold)::DOUBLE / count(*) AS recall FROM (" + _ladder_sql(fixed.DISTORTION_RATES, each=True)
       + f") CROSS JOIN (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS threshold) GROUP BY threshold")
def neardup_threshold_report(spark, sf_dir):
    return L.threshold_report(L.ladder_similarities(_docs(spark, sf_dir), "doc_id", "text", draw_each_rate=True), _THRESHOLDS)


T = 0.02


@query("neardup_match_registered",
       "WITH d AS (" + _SH.format(k="doc_id", t="text", f="documents") + "), b AS (" + _SH.format(k="item_id", t="text", f="benchmark") + "), du AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM d), "
       "bu AS (SELECT item_id, len(s) AS n, unnest(s) AS t FROM b), p AS (SELECT doc_id, item_id, count(*)::DOUBLE / (any_value(du.n) + any_value(bu.n) - count(*)) AS j FROM du JOIN bu USING (t) GROUP BY ALL) "
       f"SELECT doc_id, item_id, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, item_id) AS rn FROM p WHERE j >= {T}) WHERE rn = 1")
def neardup_match_registered(spark, sf_dir):
    """Documents that resemble a registered passage; passages are short, so the threshold is low."""
    passages = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = L.similar_registered(_docs(spark, sf_dir), "doc_id", "text", passages, "item_id", "passage", T)
    return found.select("doc_id", "item_id", F.round("jaccard", 6).alias("jaccard"))


_INDEXED = 0.5
_INDEX_SQL = (
    "WITH s AS (" + _SH.format(k="doc_id", t="text", f="documents") + "), k AS (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0), "
    "classes AS (SELECT s, row_number() OVER () AS c, min(doc_id) FILTER (WHERE doc_id % 2 = 0) AS registered FROM k GROUP BY s), u AS (SELECT c, registered, len(s) AS n, unnest(s) AS t FROM classes), "
    "p AS (SELECT x.c AS probe, y.registered, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM u x JOIN u y ON x.t = y.t AND y.registered IS NOT NULL GROUP BY x.c, y.c, y.registered), "
    f"best AS (SELECT probe, registered, j, count(*) OVER (PARTITION BY probe) AS matches, row_number() OVER (PARTITION BY probe ORDER BY j DESC, registered) AS rn FROM p WHERE j >= {_INDEXED}), "
    "found AS (SELECT k.doc_id, b.registered, round(b.j, 6) AS jaccard, b.matches FROM k JOIN classes ON classes.s = k.s JOIN best b ON b.probe = classes.c AND b.rn = 1 WHERE k.doc_id % 2 = 1) ")


def _probed(spark, sf_dir):
    """An index of the documents with even ids, as a later session would read it, probed by all others."""
    path = os.path.join(shared_dir(spark), f"signatures-{uuid.uuid4().hex}")
    docs = _docs(spark, sf_dir)
    I.write_index(docs.where("doc_id % 2 = 0"), "doc_id", "text", path)
    return I.probe_index(docs.where("doc_id % 2 = 1"), "doc_id", "text", path, _INDEXED)


@query("neardup_index_probe", _INDEX_SQL + "SELECT * FROM found")
def neardup_index_probe(spark, sf_dir):
    return _probed(spark, sf_dir).select("doc_id", "registered", F.round("jaccard", 6).alias("jaccard"), "matches")


@query("neardup_index_recall", _INDEX_SQL + "SELECT count(*) AS exact, TRUE AS recalled FROM found")
def neardup_index_recall(spark, sf_dir):
    """The index beside the exact join: at least 0.95 of its documents are found. Both read the same shingle sets."""
    sets = L.shingle_sets(_docs(spark, sf_dir), "doc_id", "text")
    probes, registered = sets.where("doc_id % 2 = 1"), sets.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "reg")
    exact = L.similar_sets(probes, "doc_id", registered, "reg", _INDEXED)
    path = os.path.join(shared_dir(spark), f"signatures-{uuid.uuid4().hex}")
    I.write_sets(registered, "reg", path)
    found = I.probe_sets(probes, "doc_id", path, _INDEXED).select("doc_id", F.lit(1).alias("hit"))
    both = exact.select("doc_id").join(found, "doc_id", "left")
    return both.agg(F.count("*").alias("exact"), (F.count("hit") >= 0.95 * F.count("*")).alias("recalled"))


_EVALUATED = 0.5


@query("neardup_evaluation",
       "WITH " + _ladder_sql(fixed.DISTORTION_RATES).split("WITH ", 1)[1].split("SELECT doc_id, step, distortion, digest, CASE WHEN n = 0")[0].rstrip().rstrip(",").replace("documents", "passages").replace(
           "v AS (", "passages AS (SELECT item_id AS doc_id, text FROM benchmark), v AS (", 1)
       + ", au AS (SELECT doc_id AS base, len(s) AS n, unnest(s) AS t FROM a), bu AS (SELECT doc_id, step, len(s) AS n, unnest(s) AS t FROM b), "
       "p AS (SELECT bu.doc_id, step, base, count(*)::DOUBLE / (any_value(au.n) + any_value(bu.n) - count(*)) AS j FROM au JOIN bu USING (t) GROUP BY ALL), "
       f"found AS (SELECT doc_id, step, base FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, step ORDER BY j DESC, base) AS rn FROM p WHERE j >= {_EVALUATED}) WHERE rn = 1), "
       f"judged AS (SELECT coalesce(own.j, 0) >= {_EVALUATED} AS truth, found.base IS NOT NULL AND found.base = b.doc_id AS hit FROM b LEFT JOIN found ON found.doc_id = b.doc_id AND found.step = b.step "
       "LEFT JOIN p own ON own.doc_id = b.doc_id AND own.step = b.step AND own.base = b.doc_id), "
       "counts AS (SELECT count(*) FILTER (WHERE truth AND hit) AS tp, count(*) FILTER (WHERE truth AND NOT hit) AS fn, count(*) FILTER (WHERE NOT truth AND hit) AS fp FROM judged) "
       "SELECT tp, fn, fp, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM counts")
def neardup_evaluation(spark, sf_dir):
    """Distorted benchmark passages, looked up among all passages: how many lead back to the one that they come from."""
    passages = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    steps = L.ladder(passages, "item_id", "text").withColumn("variant", F.col("item_id") * 100 + F.col("step"))
    found = L.similar_registered(steps.select("variant", "variant_text"), "variant", "variant_text",
                                 passages.select(F.col("item_id").alias("base"), F.col("text").alias("passage")), "base", "passage", _EVALUATED)
    return L.evaluate_matches(steps.select(F.col("item_id").alias("base"), "variant", "jaccard"), found, _EVALUATED)
