"""Secret scans: fixed patterns, and strings in a sensitive context that zstandard cannot compress.

Patterns, leftmost and non-overlapping for each kind, failing matches dropped:

* ``assign``: a sensitive name, a separator and a value of 12 characters or more; the name's letters in either case;
* ``access``: ``AKIA[A-Z0-9]+`` of 18 or more;
* ``hex``: ``[0-9a-f]+`` of 16 or more.

``novel`` spans come from novelty: a candidate is a run of 16 or more key characters, with letters and digits, that follows
a sensitive word within ``REACH`` characters. Its marginal bytes are those that it adds to a compressed frame of the dictionaries and the
text around it, less what a frame costs that is extended at all (``FRAME_BYTES``). The dictionary holds words of identifiers in the forms that
identifiers have (after ``_``, ``-`` and ``/``, in capitals, with a capital), so a name is a few matches and costs less than ``NOVEL_RATE`` bytes a
character, as known identifiers of its length do, and a key costs nearly its entropy. At that rate or more it is reported.

Two word lists make the dictionary: a fixed one, and the words of identifiers of the table itself: those that occur in ``LEAST_COUNT``
identifiers or more, the most frequent ``MOST_WORDS`` of them. They are counted over all rows; the driver gets the chosen ones.

Nulls, ties, empties: a null or empty text has no spans; each row is scanned alone, so repeated rows and ids, null ids,
other columns and empty tables need nothing of their own. Whole texts are scanned; the text around a candidate that primes
the compressor is ``AROUND`` characters on each side, and it decides nothing but how a candidate compares with it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import ASCII_LOWER, map_texts

KINDS = ("assign", "access", "hex", "novel")
REACH, AROUND, NOVEL_RATE, FRAME_BYTES, LEVEL = 48, 2048, 0.64, 3, 12
MOST_WORDS, LEAST_COUNT = 1500, 3

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_MARK = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * 16

#: Words after which a string may be a key. The first list is of those that are looked for in every text.
_SENSITIVE = (*_NAMES, b"credential", b"bearer", b"private", b"access", b"auth", b"signature", b"session", b"pwd")
_SENSITIVE_WORD = re.compile("|".join(w.decode() for w in _SENSITIVE), re.IGNORECASE | re.ASCII)
_KEY_RUN = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")

#: What a compressor should know of code before it sees any: names that are long, common and no secrets.
IDENTIFIERS = """
access_key access_token account_id api_key application/json attribute authorization authentication bearer boolean buffer
callback certificate client_id client_secret column configuration connection constructor container content_type controller
cookie created_at credentials database_url datetime default description destination directory document element encoding
endpoint environment exception expires_in export expression filename finally function generate_token getElementById
getenv handler hashlib headers hostname identifier implements import index initialize instance integer interface
iterator javascript keyboard language length library listener localhost location manager message metadata method
middleware module namespace navigator number object options os.environ output package parameter parent password
performance permission placeholder platform port private_key process property protected protocol provider public_key
query random raise receive recursive redirect_uri reference refresh_token register repository request resource
response return schema secret_key security select sequence serialize server session_id settings signature source
statement static status storage string structure subscribe success super switch synchronized table template temporary
timeout timestamp token_type transaction transform typescript undefined update_time upload username validate value
variable vector version visibility volume warning webhook whitespace window worker workspace write
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 example placeholder your-api-key-here xxxxxxxxxxxxxxxx
"""


#: Numbers that identifiers end in.
_NUMBERS = (*map(str, range(2015, 2032)), *(f"{i:02d}" for i in range(32)), *(f"v{i}" for i in range(1, 10)), "128", "256", "512", "1000")
_WORD_PARTS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
# Identifiers, and the words in them that a dictionary takes.
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]++(?:[_/-][A-Za-z0-9]++)+|[a-z]+[A-Z][A-Za-z]*")
_INNER_CAPITAL = re.compile(r"[a-z][A-Z]")
_IDENTIFIER_WORD = re.compile(r"[A-Z]?[a-z]{3,19}|[A-Z]{4,20}")
#: Words that a task counts before it hands them on.
_HELD = 100_000


def dictionary_of(words: list[str]) -> bytes:
    """Words in the forms that identifiers have, the numbers after them."""
    low = list(dict.fromkeys(w.lower() for w in words))
    up, capital = [w.upper() for w in low], [w.title() for w in low]
    parts = ["_" + "_".join([*_NUMBERS, *low]), "/" + "/".join(low), "-" + "-".join([*_NUMBERS, *low]), "-" + "-".join(up), "_" + "_".join(up), "".join(capital)]
    return ("".join(parts) + " ").encode()


def identifier_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent words of the table's identifiers, counted in all rows; at most ``most`` words come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

        for batch in batches:
            for text in batch.column(0):
                for token in (text.as_py() or "").split():
                    if "_" in token or "-" in token or "/" in token or not token.islower() and _INNER_CAPITAL.search(token):
                        for name in _IDENTIFIER.findall(token):
                            seen.update(w.lower() for w in _IDENTIFIER_WORD.findall(name))
                if len(seen) > _HELD:
                    yield counted()
                    seen.clear()
        yield counted()

    counted = docs.select(text_col).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return [r["w"] for r in counted.orderBy(F.desc("n"), "w").limit(most).collect()]


class SecretScanner:
    """Spans of one text after the other; holds the compressor and the dictionary."""

    def __init__(self, words: list[str] | tuple[str, ...] = (), identifiers: str = IDENTIFIERS, level: int = LEVEL):
        self.dictionary = dictionary_of([*_WORD_PARTS.findall(identifiers), *words])
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=False)

    def marginal_bytes(self, text: str, start: int, end: int) -> int:
        """Compressed bytes of dictionary and text around with the span, less those without it and those of any longer frame."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        before = self.dictionary + before
        with_it = self.compressor.compress(before + text[start:end].encode() + after)
        return max(0, len(with_it) - len(self.compressor.compress(before + after)) - FRAME_BYTES)

    def spans(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(start, kind, end, start of the value, marginal bytes of a novel one, else 0), in order."""
        if not text:
            return []
        data = text.encode().translate(ASCII_LOWER)
        found: list[tuple[int, int, int, int]] = []
        if any(name in data for name in _NAMES):
            found += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        if _HEX_RUN in data.translate(_HEX_MARK):
            found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
        out = [(s, k, e, v, 0) for s, k, e, v in found]
        if any(word in data for word in _SENSITIVE):
            out += self._novel(text, sorted((s, e) for s, _, e, _ in found))
        return sorted(out)

    def _novel(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        out, reach, words = [], -1, _SENSITIVE_WORD.finditer(text)
        word, at = next(words, None), 0
        for m in _KEY_RUN.finditer(text):
            start, end = m.span()
            while word is not None and word.end() <= start:
                reach, word = word.end() + REACH, next(words, None)
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if start > reach or any(s < end and start < e for s, e in taken[at : at + 8]):
                continue
            run = m.group()
            if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
                continue
            cost = self.marginal_bytes(text, start, end)
            if cost >= NOVEL_RATE * (end - start):
                out.append((start, 3, end, start, cost))
        return out


def _joined(spans: list[tuple[int, ...]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


REPORT = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("n_novel", T.LongType()), T.StructField("marginal_bytes", T.StringType()),
])


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel, marginal_bytes) for every row.

    ``marginal_bytes``: of the novel spans, comma-joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier_words(docs, text_col))

    def make():
        scanner = SecretScanner(shared.value)

        def one(text: str | None) -> tuple:
            spans = scanner.spans(text)
            counts = [sum(k == kind for _, k, *_ in spans) for kind in range(len(KINDS))]
            base = _joined([s for s in spans if s[1] < 3])
            return (*counts[:3], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), counts[3], ",".join(str(s[4]) for s in spans if s[1] == 3))

        return one

    run = map_texts(make, REPORT)
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("__r")).select("doc_id", "__r.*")


def redact(text: str | None, scanner: SecretScanner, mark: str = "[secret]") -> str | None:
    """The text with the value of every span replaced; names before the values stay."""
    kept, at = [], 0
    for start, end in sorted((value, e) for _, _, e, value, _ in scanner.spans(text)):
        if start >= at:
            kept += [text[at:start], mark]
        at = max(at, end)
    return "".join([*kept, text[at:]]) if kept else text


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, the secrets in the text replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier_words(docs, text_col))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = SecretScanner(shared.value)
        for texts in batches:
            yield pa.array([redact(t, scanner) for t in texts.to_pylist()], type=pa.string())

    return docs.withColumn(text_col, run(F.col(text_col)))
