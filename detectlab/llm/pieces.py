"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent pairs in order of score.

A text becomes characters, with ``▁`` for each blank and one before the text. All adjacent pairs whose concatenation is a
piece stand on an agenda; the pair of the best score is merged (of equal ones the leftmost), and the pairs that the new
symbol makes with its neighbours join the agenda. Entries whose symbols have changed since are passed over. What is left when
the agenda is empty are the tokens; a symbol that is no piece is written as the pieces of its bytes.

Merges can't cross a place whose two characters stand side by side in no piece, so texts are cut there and the agenda of a
chunk is worked off once for each worker's cache: the result is that of the whole text.

Every Arrow batch is checked against the sentencepiece library: what a worker has encoded for the first time (each word, or the
whole text where blanks don't tell its words) is encoded and decoded by the library as well. ``agreed`` tells of each row whether
the library gives the same ids and the same decoded text for all that it consists of.

Nulls, ties, empties: a null or empty text has no ids and decodes to the empty text; each row is encoded alone, so repeated
rows and ids, null ids, empty tables and further columns need nothing of their own. Special pieces written in a text are
ordinary text. Vocabularies with a normaliser, with pieces of the user's own or with unused pieces are refused.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import fresh

VOCABULARY = "piece_bpe_32k.model"
#: Words with their blank, and parts of words, in a worker's cache; a full one starts anew.
CACHE_WORDS, CACHE_PARTS = 600_000, 300_000
#: Characters of the texts that the library gets at once.
_GROUP = 1 << 20
_SPACE = "▁"
#: Kinds of pieces in the file format.
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


class PieceModel:
    """``encode`` and ``decode`` of one vocabulary."""

    def __init__(self, model: bytes):
        """``model``: the content of a sentencepiece file."""
        pieces, trainer, normaliser = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2 or any(kind not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for _, _, kind in pieces):
            raise ValueError("not a merge-type vocabulary of plain pieces")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0):
            raise ValueError("vocabularies that normalise texts are not supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        # The best score comes first in a heap if it is the smallest number.
        self.rank = {p: -score for p, score, kind in pieces if kind == _NORMAL}
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        spelt = {_BYTE: lambda p: bytes([int(p[3:5], 16)]), _CONTROL: lambda p: b"", _UNKNOWN: lambda p: " ⁇ ".encode()}
        self.labels = [spelt.get(kind, lambda p: p.replace(_SPACE, " ").encode())(p) for p, _, kind in pieces]
        self.numbers = [str(i) for i in range(len(pieces))]
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        # Chunks begin before blanks where no piece has a blank after another character.
        self.by_blank = not any(pair[1] == _SPACE and pair[0] != _SPACE for pair in self.joined)
        self.marked = [p.startswith(_SPACE) and kind == _NORMAL for p, _, kind in pieces]
        #: Words that are one piece with their blank.
        self.whole = {p[1:]: (i,) for p, i in self.ids.items() if len(p) > 1 and p[0] == _SPACE and self.agenda(list(p)) == [p]}
        self.words = dict(self.whole)
        #: Texts encoded since the last check with their ids, and texts that the library encodes differently.
        self.unchecked: list[tuple[str, tuple[int, ...]]] = list(self.whole.items())
        self.wrong: set[str] = set()
        self.parts: dict[str, tuple[int, ...]] = {}

    def agenda(self, symbols: list[str]) -> list[str]:
        """The symbols that are left when no pair can be merged."""
        rank = self.rank
        n = len(symbols)
        find = rank.get
        pairs = [(score, i, i + 1, merged) for i in range(n - 1)
                 if (score := find(merged := symbols[i] + symbols[i + 1])) is not None]
        if not pairs:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(pairs)
        while pairs:
            _, i, j, merged = heappop(pairs)
            if symbols[i] + symbols[j] != merged or after[i] != j:
                continue
            symbols[i], symbols[j] = merged, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = merged + symbols[k]
                score = find(wider)
                if score is not None:
                    heappush(pairs, (score, i, k, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + merged
                score = find(wider)
                if score is not None:
                    heappush(pairs, (score, h, i, wider))
        return [s for s in symbols if s]

    def _ids_of(self, part: str) -> tuple[int, ...]:
        found: list[int] = []
        for symbol in self.agenda(list(part)):
            i = self.ids.get(symbol)
            if i is not None:
                found.append(i)
            elif self.fallback:
                found.extend(map(self.bytes.__getitem__, symbol.encode()))
            else:
                found.append(self.unknown)
        return tuple(found)

    def _cut(self, chunk: str) -> list[str]:
        joined = self.joined
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in joined]
        return [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)] if cuts else [chunk]

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            ids = self.parts[part] = self._ids_of(part)
        return ids

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self._part, self._cut(chunk))))

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word with a blank before it, which is not in the cache."""
        if len(self.words) >= CACHE_WORDS + len(self.whole):
            self.words.clear()
            self.words.update(self.whole)
        ids = self.words[word] = self._chunk(_SPACE + word)
        self.unchecked.append((word, ids))
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.by_blank and self.prefix and _SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            get, make = self.words.get, self._word
            return list(chain.from_iterable([get(w) or make(w) for w in text.split(" ")]))
        marked = _SPACE * self.prefix + text.replace(" ", _SPACE)
        ids = list(chain.from_iterable(map(self._chunk, _RUNS.findall(marked) if self.by_blank else [marked])))
        self.unchecked.append((text, tuple(ids)))
        return ids

    def check(self, peer) -> None:
        """Has the library encode what has not been checked, and decode its ids."""
        if self.unchecked:
            texts = [t for t, _ in self.unchecked]
            theirs = peer.encode(texts, num_threads=1)
            back = peer.decode(theirs, num_threads=1)
            self.wrong.update(t for (t, ids), other, text in zip(self.unchecked, theirs, back, strict=True)
                              if list(ids) != other or self.decode(list(ids)) != text)
            self.unchecked = []

    def agrees(self, text: str) -> bool:
        """Whether the library, too, encodes the text so."""
        return not self.wrong or not (text in self.wrong or any(w in self.wrong for w in text.split(" ")))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. A byte that begins no valid character is U+FFFD."""
        labels = self.labels
        spelt = b"".join([labels[i] for i in ids])
        # Control ids in front spell nothing, so the first id after them leads the text.
        first = next((i for i in ids if labels[i]), None)
        if self.prefix and first is not None and self.marked[first]:
            spelt = spelt[1:]
        try:
            return spelt.decode()
        except UnicodeDecodeError:
            return _lenient(spelt)


_RUNS = regex.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as wrong:
            out.append(data[at : at + wrong.start].decode())
            out.append("�")
            at += wrong.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    """One for each process: tasks that follow each other share tables and caches."""
    return PieceModel(model)


@lru_cache(maxsize=2)
def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver; half a megabyte whatever the corpus."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``_GROUP`` characters: ids of long texts don't pile up."""
    group, held = [], 0
    for text in texts:
        group.append(text or "")
        held += len(group[-1])
        if held >= _GROUP:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encoder(docs: DataFrame, path: str | None, kind: T.StructType, row) -> Column:
    """Column function text -> struct by ``row(model, ids, decoded, agreed)``."""
    from pyspark.sql.pandas.types import to_arrow_type

    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, peer = piece_model(shared.value), library(shared.value)
        for batch in batches:
            rows = []
            for texts in _groups(batch.to_pylist()):
                ids = [model.encode(t) for t in texts]
                decoded = [model.decode(i) for i in ids]
                model.check(peer)
                rows += [row(model, i, d, model.agrees(t)) for t, i, d in zip(texts, ids, decoded, strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            yield pa.StructArray.from_arrays(
                [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], fields=list(arrow)
            )

    return run


def _digest(model: PieceModel, ids: list[int], decoded: str, agreed: bool) -> tuple:
    numbers = model.numbers
    listed = ",".join([numbers[i] for i in ids]).encode()
    return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), agreed


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agreed) for every row."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                         T.StructField("decoded_sha256", T.StringType()), T.StructField("agreed", T.BooleanType())])
    run = _encoder(docs, path, kind, _digest)
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("__r")).select("doc_id", "__r.*")


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All columns and ``piece_ids`` (an array of ints), ``decoded`` and ``agreed``."""
    kind = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()),
                         T.StructField("agreed", T.BooleanType())])
    run = _encoder(docs, path, kind, lambda model, ids, decoded, agreed: (ids, decoded, agreed))
    taken = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("piece_ids", "decoded", "agreed")]
    name = fresh(docs, "pieces")
    return docs.select(*taken, run(F.col(text_col)).alias(name)).select(*taken, f"{name}.*")
