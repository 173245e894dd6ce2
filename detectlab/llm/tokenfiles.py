"""Token-ID files: texts to ids, ids in range-coded blocks, and back.

Documents are dealt out by ranges of their id and sorted within each partition, so files, segments and documents follow each
other in ascending id order. A segment is a run of whole documents of about ``SEGMENT_IDS`` ids:

    header   magic "DLTI", version, nibbles of an id, documents, ids, blocks
    index    id of each document (null: flag), ids of each document
    blocks   size, checksum and bytes of each block, then their payloads

Segments are rows (part, seq, n_ids, data) that Spark writes to ``target``, or to the shared folder: a task that is run again writes
the same rows, and a lost executor costs the tasks that it ran. Reading back decodes each segment on its own.

Nulls, ties, empties: a null or empty text has the end id alone; null document ids come first; documents that repeat an id
stand next to each other in the order of their texts' hashes, so that an id with a third of all rows is cut into ranges as well, each with
its own start; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from detectlab.llm import bpe
from detectlab.llm.common import materialise
from detectlab.llm.rangecoder import decode_blocks, encode_blocks, nibbles_of

END_ID = 2
SEGMENT_IDS = 1 << 22
_HEADER = struct.Struct("<4sHHIQI")
_MAGIC, _VERSION = b"DLTI", 2
#: Pieces in a worker's cache; a full one starts anew.
CACHE_CHUNKS = 600_000
#: Characters that are held in pieces at once.
GROUP_CHARS = 1 << 19


class LibraryEncoder:
    """The tokenizers library with caches: pieces between spaces that it has met are not encoded again."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = bpe.automaton(vocabulary).special
        self.chunks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The same for texts that are together short enough to be held in pieces; the library gets all new pieces at once."""
        get = self.chunks.get
        out: list[bytes | list[str]] = []
        new: set[str] = set()
        for text in texts:
            pieces = None
            if text and not any(name in text for name in self.special):
                pieces = bpe.space_pieces(text)
            if pieces is None:
                out.append(self._whole(text) if text else b"")
                continue
            found = list(map(get, pieces))
            if None in found:
                new.update(p for p, ids in zip(pieces, found, strict=True) if ids is None)
                out.append(pieces)
            else:
                out.append(b"".join(found))
        if new:
            waiting = [p for p in out if isinstance(p, list)]
            if len(self.chunks) + len(new) > CACHE_CHUNKS:
                self.chunks.clear()
                new = {p for pieces in waiting for p in pieces}
            pieces = list(new)
            for piece, coded in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
                self.chunks[piece] = bpe.packed(coded.ids)
        get = self.chunks.__getitem__
        return [b"".join(map(get, p)) if isinstance(p, list) else p for p in out]


@lru_cache(maxsize=2)
def library_encoder(vocabulary: str) -> LibraryEncoder:
    """One for each process."""
    return LibraryEncoder(vocabulary)


def _groups(ids: list[int | None], texts: list[str | None]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """Both in order, in groups of about ``GROUP_CHARS`` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= GROUP_CHARS:
            yield ids[start : i + 1], texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


def pack_segment(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """Ids of documents (little-endian unsigned 32-bit) -> a segment."""
    ids = np.frombuffer(b"".join(documents), dtype="<u4")
    nibbles = nibbles_of(ids)
    blocks = encode_blocks(ids, nibbles)
    index = [
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        np.array([len(d) // 4 for d in documents], dtype="<u4").tobytes(),
        np.array([(n, crc, len(p)) for n, crc, p in blocks], dtype="<u4").reshape(-1, 3).tobytes(),
    ]
    header = _HEADER.pack(_MAGIC, _VERSION, nibbles, len(documents), len(ids), len(blocks))
    return b"".join([header, *index, *(p for _, _, p in blocks)])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids of each document, all ids); raises if the bytes are not what was written."""
    magic, version, nibbles, n_docs, n_ids, n_blocks = _HEADER.unpack_from(data)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a token-id segment")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += found.nbytes
        return found

    names, empty, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    blocks, places = [], take("<u4", 3 * n_blocks).reshape(-1, 3).tolist()
    for n, crc, size in places:
        blocks.append((n, crc, data[at : at + size]))
        at += size
    ids = decode_blocks(blocks, nibbles)
    if len(ids) != n_ids or int(lengths.sum()) != n_ids:
        raise ValueError("ids are missing")
    return [None if e else d for d, e in zip(names.tolist(), empty.tolist(), strict=True)], lengths, ids


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, target: str | None = None) -> DataFrame:
    """Writes all texts' ids and gives the written segments (part, seq, n_ids, data).

    ``path``: the vocabulary; ``target``: a folder that is not there yet, for the files.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_text(path))
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seq = library_encoder(shared.value), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        documents: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()),
                       pa.array([pack_segment(names, documents)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "n_ids", "data"])

        for batch in batches:
            for ids_of, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_id, ids in zip(ids_of, model.encode_all(texts), strict=True):
                    names.append(doc_id)
                    documents.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield segment()
                        names, documents, held, seq = [], [], 0, seq + 1
        if documents:
            yield segment()

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    taken = taken.withColumn("h", F.xxhash64("text"))
    ordered = taken.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    segments = ordered.mapInArrow(encode, "part int, seq int, n_ids long, data binary")
    if target is None:
        return materialise(segments, "token-ids")
    segments.write.parquet(target)
    return docs.sparkSession.read.schema(segments.schema).parquet(target)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, first): ids before each segment. Parts are added up on their own, then within each."""
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a partition of the write.
    parts = parts.select("part", earlier("n", Window.orderBy("part")).alias("before"))
    within = sizes.select("part", "seq", earlier("n_ids", Window.partitionBy("part").orderBy("seq")).alias("inside"))
    return within.join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))


def read_ids(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                names, lengths, ids = unpack_segment(data.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                flat = ids.astype("<u4")
                sums = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(names, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    documents = segments.select("part", "seq", "data").mapInArrow(
        decode, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return documents.join(segment_starts(segments), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, target: str | None = None) -> DataFrame:
    """Writes the ids and reads them back: (doc_id, start, n_tokens, ids_crc32) for every row."""
    return read_ids(write_ids(docs, id_col, text_col, path, target))
