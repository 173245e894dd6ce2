"""Similarity of distorted texts to their own, from word hashes alone: the draws of ``shingles.drawn_words`` for many words at once, in numpy.

A batch holds words of many documents end to end. No word is looked at as a string, and no distorted text is put together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Words of documents that are worked on together, at about so many: their arrays stay in a core's cache.
TOGETHER = 1 << 14

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1).astype(np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MIX = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def md5_heads(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second four bytes of the MD5 of padded messages, each as a big-endian number; ``blocks``: one row of bytes a message."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    state = [np.full(words.shape[1], s, np.uint32) for s in _START]
    for first in range(0, len(words), 16):
        a, b, c, d = (s.copy() for s in state)
        for i in range(64):
            if i < 16:
                f, at = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, at = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, at = c ^ (b | ~d), 7 * i % 16
            f += a
            f += words[first + at]
            f += _SINES[i]
            turned = f << _SHIFTS[i]
            f >>= 32 - _SHIFTS[i]
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        state = [s + x for s, x in zip(state, (a, b, c, d))]
    return state[0].byteswap(), state[1].byteswap()


def draws(prefixes: Sequence[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``md5_heads`` of each prefix followed by 0, 1, ... up to its count."""
    heads = [p.encode() for p in prefixes]
    owner = np.repeat(np.arange(len(heads)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))[owner]
    digits = np.ones(len(place), np.int64)
    for power in range(1, len(str(int(counts.max(initial=0))))):
        digits += place >= 10**power
    lengths = sizes + digits
    n_blocks = (lengths + 9 + 63) // 64
    first, second = np.empty(len(owner), np.uint32), np.empty(len(owner), np.uint32)
    for n in np.unique(n_blocks):
        rows = np.flatnonzero(n_blocks == n)
        width = 64 * int(n)
        begun = np.frombuffer(b"".join(h[:width].ljust(width, b"\0") for h in heads), np.uint8).reshape(-1, width)
        text = begun[owner[rows]]
        at, rest = lengths[rows], place[rows]
        line = np.arange(len(rows))
        text[line, at] = 0x80
        for back in range(1, int(digits[rows].max()) + 1):
            has = line if back == 1 else np.flatnonzero(digits[rows] >= back)
            text[has, at[has] - back] = 48 + rest[has] % 10
            rest = rest // 10
        text.view("<u8")[:, -1] = at * 8
        first[rows], second[rows] = md5_heads(text)
    return first, second


def _shingles(hashes: np.ndarray, starts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit shingles of three words, told apart by document too."""
    return hashes[starts] * _MIX[0] + hashes[starts + 1] * _MIX[1] + hashes[starts + 2] * _MIX[2] + salt


def similarities(hashes: np.ndarray, kept: np.ndarray, counts: np.ndarray, prefixes: Sequence[Sequence[str]], rates: Sequence[float],
                 fillers: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each document to itself at each rate, by distinct runs of three words; documents of three words at least.

    A document's prefixes are one for each rate, or one for all. A run of which no word is replaced is the text's own, so only changed
    runs are looked up.
    """
    n = len(counts)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(n), counts - 2)
    starts = np.arange(len(of)) + 2 * of
    assert len(of) == int(ends[-1]) - 2 * n
    salt = of.astype(np.uint64) * _MIX[3]
    known, own = np.unique(_shingles(hashes, starts, salt), return_inverse=True)
    known_of = np.empty(len(known), np.int64)
    known_of[own] = of
    size = np.bincount(known_of, minlength=n)
    out = np.empty((n, len(rates)))
    drawn = None
    for r, rate in enumerate(rates):
        if drawn is None or len(prefixes[0]) > 1:
            drawn = draws([p[r if len(p) > 1 else 0] for p in prefixes], counts)
        replaced = (drawn[0] / 4294967296.0 < rate) & ~kept
        variant = np.where(replaced, fillers[drawn[1] % len(fillers)], hashes)
        changed = replaced[starts] | replaced[starts + 1] | replaced[starts + 2]
        met = np.zeros(len(known), bool)
        met[own[~changed]] = True
        # Distinct changed runs: those that the text has, too, are met, and the others are its variant's alone.
        new, new_of = _shingles(variant, starts[changed], salt[changed]), of[changed]
        order = np.argsort(new)
        new, new_of = new[order], new_of[order]
        once = np.ones(len(new), bool)
        once[1:] = new[1:] != new[:-1]
        new, new_of = new[once], new_of[once]
        at = np.minimum(np.searchsorted(known, new), len(known) - 1)
        found = known[at] == new
        met[at[found]] = True
        common = np.bincount(known_of[met], minlength=n)
        out[:, r] = common / (size + np.bincount(new_of[~found], minlength=n))
    return out


def rated_batches(batches: Iterator[pa.RecordBatch], rates: Sequence[float], fillers: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (key, hashes, kept, prefixes, short): a key with ``short`` where it is not null, else with ``similarities``."""
    filler_hashes = np.array(fillers, np.int64).view(np.uint64)
    for batch in batches:
        short = batch.column("short")
        todo = batch.filter(short.is_null())
        keys = [batch.column(0).filter(short.is_valid())]
        lists = [short.filter(short.is_valid())]
        if len(todo):
            hashes, kept = todo.column("hashes"), todo.column("kept")
            words = hashes.flatten().to_numpy().view(np.uint64)
            flags = kept.flatten().to_numpy(zero_copy_only=False)
            counts = hashes.value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(counts)
            prefixes = todo.column("prefixes").to_pylist()
            rated = np.empty((len(todo), len(rates)))
            first = 0
            while first < len(todo):
                begin = ends[first] - counts[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + TOGETHER, "right")))
                part = slice(begin, ends[last - 1])
                rated[first:last] = similarities(words[part], flags[part], counts[first:last], prefixes[first:last], rates, filler_hashes)
                first = last
            keys.append(todo.column(0))
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(todo) + 1) * len(rates), pa.int32()), pa.array(rated.reshape(-1))))
        for key, values in zip(keys, lists):
            if len(key):
                yield pa.RecordBatch.from_arrays([key, values.cast(pa.list_(pa.float64()))], names=[batch.schema.names[0], "rated"])
