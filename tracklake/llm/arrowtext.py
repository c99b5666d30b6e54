"""Vectorised text helpers over Arrow string buffers.

Operators that run Python inside Spark tasks get Arrow record batches from
``mapInArrow`` and work on the UTF-8 bytes of a whole batch at once with numpy:
no Python loop over words or characters.  Batches are cut into blocks of a few
megabytes (always between documents) so the working arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: byte -> does it belong to a word; ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (on lower-cased bytes)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: lower-cases A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of whole rows with about ``limit`` text bytes each: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, len(batch))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
        pa.default_memory_pool().release_unused()  # else a worker keeps the room of its largest batch for good


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if len(data):
        at = offsets[:-1][offsets[:-1] < len(data)]
        first[at] = inside[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << max(12, (n - 1).bit_length())
            both = []
            for base in (_BASE, _INVERSE):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
            self.up, self.down = both
        return self.up, self.down


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hash of any range of a symbol sequence in constant time, from one prefix sum.

    Equal ranges have equal hashes wherever they lie.  Different ranges may collide
    and can be made to, so callers use it to find candidates and compare symbols.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        up, self.down = _powers.upto(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        codes = _BYTE_CODES[symbols] if symbols.dtype == np.uint8 else symbols
        np.cumsum(codes * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each k symbols in a row."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row, by doubling."""
    if len(values) < width:
        return values[:0]
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def winnow(grams: np.ndarray, symbol_offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer anchors: which k-gram speaks for which windows.

    Each run of ``window`` symbols inside one document is owned by the leftmost
    smallest of its k-grams, so equal windows are owned by equal k-grams at equal
    distances.  Returns, one row for each anchor, (document, anchor position,
    first owned window start, last owned window start); the owned starts of an
    anchor are contiguous.
    """
    none = np.zeros(0, np.int64)
    n = int(symbol_offsets[-1])
    if n < window:
        return none, none, none, none
    low = np.uint64((1 << 32) - 1)  # the same in every block, so equal windows have equal owners; a block has fewer symbols
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    owner = (sliding_min(keyed, window - k + 1) & low).astype(np.int64)
    starts, ends = symbol_offsets[:-1], symbol_offsets[1:] - window + 1
    keep = ends > starts
    edges = np.zeros(len(owner) + 1, np.int32)
    np.add.at(edges, starts[keep], 1)
    np.add.at(edges, ends[keep], -1)
    valid = np.cumsum(edges[:-1]) > 0
    change = valid.copy()
    change[1:] &= (owner[1:] != owner[:-1]) | ~valid[:-1]
    change[starts[keep]] = True
    first = np.flatnonzero(change)
    stop = valid.copy()
    stop[:-1] &= (owner[1:] != owner[:-1]) | ~valid[1:]
    stop[ends[keep] - 1] = True
    last = np.flatnonzero(stop)
    return np.searchsorted(symbol_offsets, first, "right") - 1, owner[first], first, last


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, backwards: bool = False) -> pa.Array:
    """A binary column of the slices ``data[start:end]``, each from its last byte to its first if ``backwards``."""
    n = ends - starts
    offsets = np.concatenate(([0], np.cumsum(n)))
    k = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    at = np.repeat(ends - 1, n) - k if backwards else np.repeat(starts, n) + k
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))]).cast(pa.binary())


def common_prefix(data: np.ndarray, own: np.ndarray, own_end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Bytes that the slice ``data[own:own_end]`` of each row shares with ``data[other:other_end]`` from its start."""
    n = np.minimum(own_end - own, other_end - other)
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    differ = np.flatnonzero(data[own[row] + k] != data[other[row] + k])
    out, rows = n.copy(), row[differ]
    first = np.ones(len(rows), bool)
    first[1:] = rows[1:] != rows[:-1]
    out[rows[first]] = k[differ[first]]
    return out
