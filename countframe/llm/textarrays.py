"""Vectorised work on Arrow string columns inside tasks.

A batch of texts is handled as one UTF-8 byte buffer plus row offsets, in
blocks of about ``BLOCK_BYTES`` (a longer text is a block of its own), so
memory stays a small multiple of a block or of the longest text.  Words are
maximal runs of "word bytes"; every word and word window gets a 64-bit hash
computed with prefix sums over the bytes.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

# byte classes --------------------------------------------------------------
_ALL = np.arange(256)
#: words [^\x20\x09-\x0D]+
NON_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text in lower case (ASCII)
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: ASCII lower case, byte by byte
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

# hashing -------------------------------------------------------------------
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE_LOWER = _BYTE[LOWER]
_P = int(_rng.integers(0, 1 << 62)) * 4 + 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = int(_rng.integers(0, 1 << 62)) * 4 + 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES + 1), U64(base))
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# blocks --------------------------------------------------------------------
class Block:
    """Rows [first, first + n) of a batch: bytes ``data``, ``offsets`` (n + 1)."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column, size: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = string_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        stop = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        stop = min(max(stop, first + 1), n)
        base = offsets[first]
        yield Block(first, data[base:offsets[stop]], offsets[first:stop + 1] - base)
        first = stop


# words ---------------------------------------------------------------------
class Words:
    """Words of a block: byte span [start, end), row, hash; ``first`` holds
    the index of each row's first word (n + 1 entries)."""

    def __init__(self, block: Block, word_bytes: np.ndarray, lower: bool = True):
        data, offsets = block.data, block.offsets
        size = len(data)
        edge = np.zeros(size + 1, bool)          # a text begins here
        edge[offsets] = True
        values = _BYTE_LOWER if lower else _BYTE
        if lower:
            word_bytes = word_bytes[LOWER]
        mask = word_bytes[data]
        before = np.zeros(size, bool)
        before[1:] = mask[:-1]
        before &= ~edge[:size]
        after = np.zeros(size, bool)
        after[:-1] = mask[1:]
        after &= ~edge[1:]
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        total = np.zeros(size + 1, U64)
        np.cumsum(values[data] * _powers(_P, size), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(_P_INV, size + 1)[self.start]
        self.hash = mix64(h ^ (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(block.n), self.counts)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every run of ``size`` consecutive words
    of one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for k in range(size):
        acc *= U64(_Q)
        acc += words.hash[k:k + n]
    at = np.flatnonzero(words.row[:n] == words.row[size - 1:])
    return at, mix64(acc[at] ^ (U64(size) << U64(56)))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every ``size``-word shingle; a text of fewer words, but
    not none, gives one shingle: the whole sequence.  Repeats are kept."""
    at, h = windows(words, size)
    rows, hashes = [words.row[at]], [h]
    for short in range(1, size):
        few = np.flatnonzero(words.counts == short)
        if len(few):
            acc = np.zeros(len(few), U64)
            for k in range(short):
                acc = acc * U64(_Q) + words.hash[words.first[few] + k]
            rows.append(few)
            hashes.append(mix64(acc ^ (U64(short) << U64(56))))
    return np.concatenate(rows), np.concatenate(hashes)


def shingle_sets(column, size: int, word_bytes: np.ndarray = NON_SPACE) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Per block: (block, first, sorted distinct shingle hashes); row r owns
    hashes[first[r]:first[r + 1]]."""
    for block in blocks(column):
        row, h = shingles(Words(block, word_bytes), size)
        sizes = np.bincount(row, minlength=block.n)
        if len(row) and (row[1:] < row[:-1]).any():       # short texts come last
            h = h[np.argsort(row, kind="stable")]
        stop = np.cumsum(sizes)
        sets = [np.unique(h[e - n:e]) for e, n in zip(stop, sizes)]
        first = np.cumsum([0] + [len(x) for x in sets])
        yield block, first, np.concatenate(sets) if sets else h
