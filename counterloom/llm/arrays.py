"""Numpy primitives over Arrow text columns, used inside Spark tasks.

A text column is handled as one byte array plus document offsets, so a batch of thousands of documents costs a
fixed number of array passes. Words are runs of bytes other than 0x20 and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``), which
in UTF-8 never split a character. Null texts count as empty.

Hashes are polynomials over 2**64 with random byte weights, finalised by a mixing function: any span's hash comes from two
prefix sums. They find candidates; what must be exact is confirmed on the bytes or by a strong digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_WEIGHT = np.frombuffer(b"".join(hashlib.sha256(b"byte weight %d" % i).digest()[:8] for i in range(256)), np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Words of more bytes are digested one by one.
LONG_WORD = 512

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 4 << 20


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can serve as a bucket."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets (n + 1, from 0) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, index, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(index, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, so that memory does not follow Arrow's batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_WEIGHT[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _power_tables(len(sums))[1][start])


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash, not 0, of the ``k`` items from each item on, also across documents; a light mixing, for sampling."""
    n = max(len(sums) - k, 0)
    h = sums[k : k + n] - sums[:n]
    h *= _power_tables(len(sums))[1][:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.maximum(h, np.uint64(1), out=h)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that stays within one document."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[full]] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[offsets[full + 1] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owners(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each span: its bytes go eight at a time through a mixing function, so no pattern of them cancels out, as it can in a
    polynomial. Spans should be words: the longest sets the number of passes, and very long ones are digested one by one."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64((seed * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) % (1 << 64)))
    padded = np.append(data, np.zeros(8, np.uint8))
    long = np.flatnonzero(size > LONG_WORD)
    left, done = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(left):
        for a in range(0, len(left), 1 << 16):  # bounds the bytes that are copied
            part = left[a : a + (1 << 16)]
            at = start[part] + done
            piece = padded[at[:, None] + np.arange(8)].view(np.uint64).ravel()
            spare = np.maximum(done + 8 - size[part], 0).astype(np.uint64) * np.uint64(8)
            piece = (piece << spare) >> spare  # without the bytes behind the span
            out[part] = mix((out[part] ^ piece) * np.uint64(_BASE) + np.uint64(0x2545F4914F6CDD1D))
        done += 8
        left = left[size[left] > done]
    for i in long:
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), np.uint64)[0]
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word."""
    start, end = spans(~SPACE[data], offsets)
    return start, end, owners(offsets, start)


def doc_offsets(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the items of each of ``n`` documents, from their document numbers in order."""
    return np.searchsorted(doc, np.arange(n + 1))


def window_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """First item of every window of ``k`` items that lies within one document."""
    fits = np.zeros(offsets[-1] + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= k)
    np.add.at(fits, offsets[long], 1)
    np.add.at(fits, offsets[long + 1] - k + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:-1]))


def windows(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First item and hash of every window of ``k`` items that lies within one document."""
    start = window_starts(offsets, k)
    return start, span_hash(prefix(values), start, start + k)


def sums_by_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return member(keys, twice)


def member(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted distinct ones."""
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys


def covered(start: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether each of ``n`` items lies in a span of ``length`` items that begins at one of the starts."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values; shorter by w - 1."""
    size, out = 1, values
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[: len(out) - step], out[step:])
        size += step
    return out


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of hashes, one per seed."""
    return mix(values + np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64)))


def grouped(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.Table]:
    """The rows of one key at a time, from batches sorted by integer key columns; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            this = tuple(ids[:, x].tolist())
            if held and this != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = this
    if held:
        yield pa.Table.from_batches(held)
