"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton accepts exactly the token sequences that byte-pair merging gives (Berglund, Martens and van der Merwe,
Constructing a BPE Tokenization DFA, 2024). It starts as one state with an arc for each byte. The gadget of a merge
x y -> z, in order of rank, takes every state s with arcs s -x-> q -y-> r, sends x to a copy of q that lacks y, and adds
s -z-> r. The state after a token then depends on that token alone, so an arc is a pair of tokens, and following the
gadgets backwards tells whether it is there:

* a pair that is itself merged has lost its arc, once its gadget has been applied;
* if the left token is the younger one, its state is a copy of the state after its right part, as of its own gadget;
* if the right token is the younger one, its arc was added where the arc of its left part was, as of its own gadget.

All arcs are 2.5 thousand million pairs for 50,000 tokens, so rows of the transition table are filled when they are first
read; the gadgets' own arcs are compiled at once and show which tokens can be reached at all. A word is encoded by the
path that spells it: at each place the longest token with an arc from the last one, else a shorter one. A place has one
valid path to it, so a place that failed is not tried again, and the work is linear.

Words are the pieces that the vocabulary's own pre-tokenizer makes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import fresh, map_texts

VOCABULARY = "byte_bpe_50k.json"
#: Entries of a cache; a full one starts anew.
CACHE_WORDS, CACHE_CHUNKS, CACHE_ARCS = 60_000, 250_000, 150_000

#: White space as the pre-tokenizer has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECES = regex.compile(
    rf"{_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Texts of these characters alone: the standard module's classes say the same of them, and it is faster.
_UNUSUAL = re.compile(r"[^\n -~À-ɏ‐-‧‰-›€]")
_USUAL_PIECES = re.compile(rf"{_CONTRACTIONS}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def space_pieces(text: str) -> list[str] | None:
    """The text cut before each space, where that is where its words begin; else None.

    It is so for usual characters if no white space stands beside a space.
    """
    if _UNUSUAL.search(text) or "  " in text or "\n " in text or " \n" in text:
        return None
    first, *rest = text.split(" ")
    pieces = [" " + chunk for chunk in rest]
    return [first, *pieces] if first else pieces


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Automaton:
    """The compiled merges: ``encode`` and ``decode``."""

    def __init__(self, vocabulary: str):
        """``vocabulary``: the content of a tokenizers file with a byte-level BPE model."""
        file = json.loads(vocabulary)
        model, bytes_of = file["model"], _byte_of_character()
        if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary")
        special = file["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in special):
            raise ValueError("special tokens with conditions are not supported")
        self.special = {t["content"]: t["id"] for t in special}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        label = {i: bytes(bytes_of[c] for c in name) for name, i in model["vocab"].items() if name not in self.special}
        self.labels = [label.get(i, b"") for i in range(max([*label, *self.special.values()]) + 1)]
        for name, i in self.special.items():
            self.labels[i] = name.encode()
        self._compile(model, label)
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _compile(self, model: dict, label: dict[int, bytes]) -> None:
        vocab = model["vocab"]
        size = len(self.labels)
        self.born = [-1] * size  # rank of the merge that makes a token, -1 for bytes
        self.left, self.right = [0] * size, [0] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        usable = {i for i, b in label.items() if len(b) == 1}
        for rank, merge in enumerate(model["merges"]):
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            a, b, z = vocab[x], vocab[y], vocab[x + y]
            self.merged.setdefault((a, b), rank)
            if self.born[z] < 0 and len(label[z]) > 1 and a in usable and b in usable and self._arc(a, b, rank):
                self.born[z], self.left[z], self.right[z] = rank, a, b
                usable.add(z)
        self.token = {label[i]: i for i in usable}
        # The longest token that begins with four given bytes; other tokens have three at most.
        self.longest: dict[bytes, int] = {}
        for b in self.token:
            if len(b) > 3:
                self.longest[b[:4]] = max(len(b), self.longest.get(b[:4], 0))

    def _arc(self, s: int, t: int, before: int) -> bool:
        """Whether token t may follow token s when the gadgets of rank under ``before`` have been applied."""
        born, merged = self.born, self.merged
        while True:
            if merged.get((s, t), before) < before:
                return False
            if born[s] > born[t]:
                s, before = self.right[s], born[s]
            elif born[t] >= 0:
                # The gadget itself has taken the arc of its own left part where that part is the last token.
                t, before = self.left[t], born[t] + 1
            else:
                return True

    def _follows(self, s: int, t: int) -> bool:
        known = self.arcs.get((s, t))
        if known is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            known = self.arcs[s, t] = self._arc(s, t, 1 << 60)
        return known

    def path(self, word: bytes) -> list[int]:
        """The one path through the automaton that spells the word."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        token, longest = self.token, self.longest
        end, at, out, starts = len(word), 0, [], []
        failed: set[int] = set()
        size = 0  # of the next token to try; 0: the longest possible
        while at < end:
            if not size:
                size = min(longest.get(word[at : at + 4], 3), end - at)
            last = out[-1] if out else -1
            while size:
                t = token.get(word[at : at + size])
                if t is not None and (last < 0 or self._follows(last, t)) and at + size not in failed:
                    break
                size -= 1
            if size:
                out.append(t)
                starts.append(at)
                at += size
                size = 0
                continue
            # No arc leads on from here: the token before was too long.
            if not out:
                raise ValueError("a byte is not in the vocabulary")
            failed.add(at)
            while True:
                start = starts.pop()
                out.pop()
                size, at = at - start - 1, start
                if size:
                    break
                failed.add(at)
                if not out:
                    raise ValueError("no path spells the word")
        return out

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            ids = self.words[word] = packed(self.path(word.encode()))
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            if len(self.chunks) >= CACHE_CHUNKS:
                self.chunks.clear()
            path = self.path
            ids = self.chunks[chunk] = packed([i for word in _USUAL_PIECES.findall(chunk) for i in path(word.encode())])
        return ids

    def _plain(self, text: str) -> bytes:
        """Without special tokens."""
        pieces = space_pieces(text)
        if pieces is None:
            usual = not _UNUSUAL.search(text)
            return b"".join(map(self._word, (_USUAL_PIECES if usual else _PIECES).findall(text)))
        get = self.chunks.get
        return b"".join([get(p) or self._chunk(p) for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers; of a null text, none."""
        if not text:
            return b""
        if self.split_special is None or not any(name in text for name in self.special):
            return self._plain(text)
        parts = self.split_special.split(text)
        return b"".join(
            self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts) if p
        )

    def forget(self) -> None:
        """Empties the caches; what was compiled stays."""
        for cache in (self.words, self.chunks, self.arcs):
            cache.clear()

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton(vocabulary: str) -> Automaton:
    """One for each process: tasks that follow each other share tables and caches."""
    return Automaton(vocabulary)


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file, read on the driver; some megabytes whatever the corpus."""
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        return file.read()


ROUND_TRIP = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    A null or empty text has no ids. Repeated rows and ids, null ids and empty tables need nothing of their own: each row
    is encoded alone. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def make():
        model = automaton(shared.value)

        def one(text: str | None) -> tuple:
            ids = model.encode(text)
            decoded = model.decode(ids).encode()
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return one

    run = map_texts(make, ROUND_TRIP)
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("__r")).select("doc_id", "__r.*")


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """All columns and ``token_ids`` (an array of ints; empty for a null or empty text) and ``n_tokens``.

    Other steps of a job run in the same workers, so the caches are emptied after each task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))
    schema = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def make():
        model = automaton(shared.value)

        def one(text: str | None) -> tuple:
            ids = np.frombuffer(model.encode(text), dtype="<u4").astype(np.int32)
            return ids, len(ids)

        return one

    taken = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("token_ids", "n_tokens")]
    name = fresh(docs, "encoded")
    return docs.select(*taken, map_texts(make, schema, lambda: automaton(shared.value).forget())(F.col(text_col)).alias(name)).select(*taken, f"{name}.*")
