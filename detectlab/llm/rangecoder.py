"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Each id is predicted from the one before it (order 1), the two before it (order 2) and from what the block has had so far
(order 0). The prediction is a mixture

    P(x) = w2 [x = what followed the last two ids] + w1 [x = what followed the last id] + w0 P0(x).

The weights adapt, one set for each state of the contexts: how often in a row either context's prediction has been right, whether
the two are the same, and what was right last time. P0 is a tree over the id's nibbles: the first is in one distribution with the
weights, each further one in a distribution of its own for the nibbles before it. Distributions learn fast at first (a half, a third
of the way to the new symbol ...) and then by 1 / 32. A range coder (64-bit interval, carries, 32-bit words) turns the choices into
bytes: one choice for an id that a context predicted, one for each nibble of the others. Blocks are independent: models start anew in
each one, and each has its own checksum.

Coding is sequential within a block, so all blocks of a call advance together: a step is one id of every block, as array
operations. Encoder and decoder share the model code and so stay in step.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 4096
#: Ids are smaller than this; the number itself means that there is no prediction.
MAX_ID = (1 << 32) - 1
_TABLE_BITS = 11
_SURE = 3  # right predictions in a row that are told apart
_STATES, _CHOICES, _PARTS = 2 * (_SURE + 1) ** 2 * 3, 18, 16
#: Distributions of a nibble: one for each three nibbles before it; longer prefixes are hashed.
_ROWS_BITS = 12
_BITS = 15
_ONE = 1 << _BITS
_U = np.uint64
_SHIFT, _WORD = _U(_BITS), _U(32)
_LOW_LIMIT = _U(1 << 32)
_FULL = _U(0xFFFFFFFFFFFFFFFF)
#: How far a distribution goes to a new symbol, as a shift, by the times that it was used.
_PACE = np.array([1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 5], dtype=np.int16)


def _targets(n: int, least: int = 12) -> np.ndarray:
    """Row s: the starts of all symbols when s has nearly everything."""
    i, s = np.arange(n)[None, :], np.arange(n)[:, None]
    return np.where(i <= s, i * least, _ONE - (n - i) * least).astype(np.int16)


_TO_CHOICE, _TO_PART = _targets(_CHOICES), _targets(_PARTS)


def nibbles_of(ids: np.ndarray) -> int:
    """Nibbles that the largest id has, one at least."""
    return max(1, -(-int(ids.max()).bit_length() // 4)) if len(ids) else 1


class _Rows:
    """Adaptive distributions: rows of starts in 1 / 2^15, and how often each was used."""

    def __init__(self, rows: int, symbols: int):
        self.starts = np.empty((rows, symbols), dtype=np.int16)
        self.starts[:] = (np.arange(symbols) * (_ONE // symbols)).astype(np.int16)
        self.used = np.zeros(rows, dtype=np.uint8)
        self.item = self.starts.view(np.dtype((np.void, 2 * symbols))).ravel()
        self.targets = _targets(symbols)

    def take(self, at: np.ndarray) -> np.ndarray:
        """Several times as fast as an index expression."""
        return np.take(self.starts, at, axis=0, mode="clip")

    def learn(self, at: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> None:
        """Moves the given rows towards their symbols and writes them back, each as one item."""
        used = self.used[at]
        rows += (np.take(self.targets, symbol, axis=0, mode="clip") - rows) >> _PACE[used][:, None]
        self.item[at] = rows.view(self.item.dtype).ravel()
        self.used[at] = np.minimum(used + 1, len(_PACE) - 1)


class _Model:
    """Context tables of all blocks; blocks are rows."""

    def __init__(self, blocks: int, nibbles: int):
        self.row = np.arange(blocks, dtype=np.int64)
        self.base = self.row << _TABLE_BITS
        self.after = [np.full(blocks << _TABLE_BITS, MAX_ID, dtype=np.uint32) for _ in range(2)]
        self.right = [np.zeros(blocks << _TABLE_BITS, dtype=np.uint8) for _ in range(2)]
        self.choice = _Rows(blocks * _STATES, _CHOICES)
        self.levels = [_Rows(blocks << min(4 * k, _ROWS_BITS), _PARTS) for k in range(1, nibbles)]
        self.top = 4 * (nibbles - 1)
        self.last1 = np.zeros(blocks, dtype=np.int64)
        self.last2 = np.zeros(blocks, dtype=np.int64)
        self.outcome = np.full(blocks, 2, dtype=np.int64)

    def predict(self, n: int) -> np.ndarray:
        """Predictions for the next id of the first n blocks, and the distributions of the first choice."""
        mask = (1 << _TABLE_BITS) - 1
        a = self.last1[:n] * 40503
        self.place1 = self.base[:n] + (a >> 5 & mask)
        self.place2 = self.base[:n] + (a + self.last2[:n] * 60493 >> 6 & mask)
        self.guess1, self.guess2 = self.after[0][self.place1], self.after[1][self.place2]
        sure = self.right[1][self.place2].astype(np.int64) * (_SURE + 1) + self.right[0][self.place1]
        self.state = self.row[:n] * _STATES + (sure * 2 + (self.guess1 == self.guess2)) * 3 + self.outcome[:n]
        return self.choice.take(self.state)

    def level(self, k: int, some: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Rows of the distributions of nibble k after a prefix."""
        bits = min(4 * k, _ROWS_BITS)
        key = prefix if 4 * k <= _ROWS_BITS else (prefix * 40503 >> 4) & ((1 << bits) - 1)
        return (some << bits) + key

    def learn(self, n: int, ids: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        for k, (place, guess) in enumerate(((self.place1, self.guess1), (self.place2, self.guess2))):
            self.right[k][place] = np.where(guess == ids, np.minimum(self.right[k][place] + 1, _SURE), 0)
            self.after[k][place] = ids
        self.choice.learn(self.state, rows, chosen)
        self.outcome[:n] = np.minimum(chosen, 2)
        self.last2[:n] = self.last1[:n]
        self.last1[:n] = ids


def _find(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The symbol of each row in whose interval a place lies: as many starts as are not beyond it, less one."""
    below = np.ascontiguousarray(rows.T) <= place.astype(np.int16)
    return np.add.reduce(below, axis=0, dtype=np.uint8).astype(np.int64) - 1


def _bounds(rows: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and width of a symbol in each row."""
    n = rows.shape[1]
    flat, at = rows.ravel(), np.arange(0, len(rows) * n, n) + symbol
    start = flat[at].astype(np.int64)
    end = np.where(symbol == n - 1, np.int64(_ONE), flat[np.minimum(at + 1, len(flat) - 1)].astype(np.int64))
    return start, end - start


class _Encoder:
    def __init__(self, blocks: int):
        self.low = np.zeros(blocks, dtype=_U)
        self.range = np.full(blocks, _FULL)
        # A choice takes under 15 bits.
        self.out = np.zeros((blocks, 64), dtype=np.uint32)
        self.size = np.zeros(blocks, dtype=np.int64)

    def _carry(self, rows: np.ndarray) -> None:
        at = self.size[rows] - 1
        while len(rows):
            self.out[rows, at] += np.uint32(1)
            again = self.out[rows, at] == 0
            rows, at = rows[again], at[again] - 1

    def put(self, rows: slice | np.ndarray, start: np.ndarray, width: np.ndarray, shift: np.uint64 = _SHIFT) -> None:
        """Narrows the intervals of some blocks to a part of them, in 1 / 2^shift."""
        span = self.range[rows] >> shift
        old = self.low[rows]
        low = old + span * start.astype(_U)
        over = low < old
        if over.any():
            self._carry(np.flatnonzero(over) if isinstance(rows, slice) else rows[over])
        span *= width.astype(_U)
        full = np.flatnonzero(span < _LOW_LIMIT)
        if len(full):
            some = full if isinstance(rows, slice) else rows[full]
            short = low[full]
            if int(self.size[some].max()) + 2 >= self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
            self.out[some, self.size[some]] = short >> _WORD
            self.size[some] += 1
            low[full] = short << _WORD
            span[full] <<= _WORD
        self.low[rows], self.range[rows] = low, span

    def finish(self) -> list[bytes]:
        """One word that lies in the last interval of each block: intervals are at least as wide as a word."""
        rows = np.arange(len(self.low))
        last = (self.low >> _WORD) + (self.low & (_LOW_LIMIT - _U(1)) != 0)
        over = np.flatnonzero(last >> _WORD)
        if len(over):
            self._carry(over)
        self.out[rows, self.size] = last.astype(np.uint32)
        self.size += 1
        return [self.out[i, : self.size[i]].astype("<u4").tobytes() for i in range(len(rows))]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        sizes = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
        self.words = np.zeros(int(sizes.sum() + 4 * len(sizes)), dtype=_U)
        self.next = np.concatenate([[0], np.cumsum(sizes + 4)[:-1]])
        for at, payload in zip(self.next.tolist(), payloads, strict=True):
            self.words[at : at + len(payload) // 4] = np.frombuffer(payload, dtype="<u4")
        self.code = (self.words[self.next] << _WORD) | self.words[self.next + 1]
        self.next += 2
        self.range = np.full(len(payloads), _FULL)

    def peek(self, rows: slice | np.ndarray, shift: np.uint64 = _SHIFT) -> np.ndarray:
        """Where the code lies, in 1 / 2^shift of the interval."""
        self.span = self.range[rows] >> shift
        self.at = self.code[rows]
        return np.minimum(self.at // self.span, _U((1 << int(shift)) - 1)).astype(np.int64)

    def take(self, rows: slice | np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        code = self.at - self.span * start.astype(_U)
        span = self.span * width.astype(_U)
        full = np.flatnonzero(span < _LOW_LIMIT)
        if len(full):
            some = full if isinstance(rows, slice) else rows[full]
            code[full] = (code[full] << _WORD) | self.words[self.next[some]]
            self.next[some] += 1
            span[full] <<= _WORD
        self.code[rows], self.range[rows] = code, span


def encode_blocks(ids: np.ndarray, nibbles: int | None = None) -> list[tuple[int, int, bytes]]:
    """ids of so many nibbles at most -> (ids, checksum, payload) of each block of ``BLOCK`` ids; the last may be shorter."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    if not len(ids):
        return []
    nibbles = nibbles or nibbles_of(ids)
    if ids.min() < 0 or ids.max() >= min(MAX_ID, 1 << 4 * nibbles):
        raise ValueError("ids must be unsigned numbers of 32 bits less one")
    blocks = -(-len(ids) // BLOCK)
    last = len(ids) - (blocks - 1) * BLOCK
    flat = np.zeros(blocks * BLOCK, dtype=np.int64)
    flat[: len(ids)] = ids
    table = np.ascontiguousarray(flat.reshape(blocks, BLOCK).T)
    model, coder = _Model(blocks, nibbles), _Encoder(blocks)
    for step in range(BLOCK if blocks > 1 else last):
        n = blocks if step < last else blocks - 1
        x = table[step, :n]
        rows = model.predict(n)
        chosen = np.where(x == model.guess2, 0, np.where(x == model.guess1, 1, 2 + (x >> model.top)))
        coder.put(slice(0, n), *_bounds(rows, chosen))
        some = np.flatnonzero(chosen > 1)
        if len(some):
            y = x[some]
            for k, level in enumerate(model.levels, 1):
                below = model.top - 4 * k
                at, part = model.level(k, some, y >> below + 4), y >> below & 15
                cells = level.take(at)
                coder.put(some, *_bounds(cells, part))
                level.learn(at, cells, part)
        model.learn(n, x, rows, chosen)
    sizes = [BLOCK] * (blocks - 1) + [last]
    return [
        (size, zlib.crc32(flat[i * BLOCK : i * BLOCK + size].astype("<u4").tobytes()), payload)
        for i, (size, payload) in enumerate(zip(sizes, coder.finish(), strict=True))
    ]


def decode_blocks(coded: list[tuple[int, int, bytes]], nibbles: int) -> np.ndarray:
    """The ids of all blocks, in order; a wrong checksum is an error."""
    if not coded:
        return np.zeros(0, dtype=np.uint32)
    sizes = np.array([size for size, _, _ in coded])
    # Longest first, so that the blocks that still run are the first rows.
    order = np.argsort(-sizes, kind="stable")
    left = sizes[order]
    model, coder = _Model(len(coded), nibbles), _Decoder([coded[i][2] for i in order])
    table = np.zeros((int(left[0]), len(coded)), dtype=np.uint32)
    for step in range(int(left[0])):
        n = int(np.searchsorted(-left, -step, side="left"))
        rows = model.predict(n)
        chosen = _find(rows, coder.peek(slice(0, n)))
        coder.take(slice(0, n), *_bounds(rows, chosen))
        x = np.where(chosen == 0, model.guess2, model.guess1).astype(np.int64)
        some = np.flatnonzero(chosen > 1)
        if len(some):
            y = chosen[some] - 2
            for k, level in enumerate(model.levels, 1):
                at = model.level(k, some, y)
                cells = level.take(at)
                part = _find(cells, coder.peek(some))
                coder.take(some, *_bounds(cells, part))
                level.learn(at, cells, part)
                y = y << 4 | part
            x[some] = y
        table[step, :n] = x
        model.learn(n, x, rows, chosen)
    columns = np.ascontiguousarray(table.T)
    found: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(coded)
    for row, i in enumerate(order):
        ids = columns[row, : sizes[i]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != coded[i][1]:
            raise ValueError(f"block {i}: wrong checksum")
        found[i] = ids
    return np.concatenate(found)
