"""Vectorised text kernels shared by the operators: whole Arrow batches of text become word hashes.

Texts are read as UTF-8 bytes. A word is a maximal run of bytes of one class; A-Z count as a-z.
Words are 64-bit hashes of their lower-cased bytes; at 10^10 distinct words or shingles about one
pair is expected to collide, which moves one intersection by one.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

try:  # glibc alone gives freed pages back on demand
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None

U64 = np.uint64
#: Bytes of text handled at once (a longer single text is still handled whole).
CHUNK_BYTES = 1 << 20


def release() -> None:
    """Give freed memory back to the system: a worker that is kept for later tasks would hold its peak."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: digits, letters and everything beyond ASCII
ALNUM_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: everything but blank, tab, line feed, vertical tab, form feed, carriage return
SPACE_WORD = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: letters and everything beyond ASCII
LETTER_WORD = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER] | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_BASE = U64(0xD6E8FEB86659FD93)
#: Longer words are hashed byte by byte.
SHORT_BYTES = 64
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            t = np.full(n, base, U64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Regroup batches into tables of about ``limit`` bytes of text, with the text's bytes and offsets."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out():
        table = pa.Table.from_batches(held)
        return (table, *text_buffer(table[column]))

    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(off, off[begin] + limit - size, "right")) - 1
            end = min(max(end, begin + (not held)), batch.num_rows)
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += int(off[end] - off[begin])
            if end < batch.num_rows or size >= limit:
                yield out()
                held, size = [], 0
            begin = end
    if held:
        yield out()
        held = []
    release()


def word_bounds(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and where each text's words begin (len(off) entries)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.frombuffer(buf.tobytes().translate(word.tobytes()), bool)
    edge = np.empty(n + 1, bool)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    edge[0] = edge[n] = True
    edge[off] = True
    at = np.flatnonzero(edge)
    first = at[:-1]
    keep = inside[first]
    starts, ends = first[keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, off)


def _by_piece(hashed: Callable, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hashed`` of the spans (in order of their starts), a piece of the buffer at a time."""
    out = np.zeros(len(starts), U64)
    k = 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(starts, starts[k] + CHUNK_BYTES)))
        first, last = starts[k], ends[k:m].max()
        out[k:m] = hashed(buf[first:last], starts[k:m] - first, ends[k:m] - first)
        k = m
    return out


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the lower-cased bytes of each span (in order of their starts)."""
    return _by_piece(_hash_piece, buf, starts, ends)


def _hash_piece(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    values = _BYTE_VALUE[buf]
    values *= power[: len(buf)]
    np.cumsum(values, out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another hash of the same bytes, for many short spans: the work is by span, not by byte."""
    return _by_piece(_hash_short, buf, starts, ends)


def _hash_short(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    lower = buf.tobytes().translate(LOWER.tobytes()) + bytes(8)
    eight = np.ndarray(len(buf) + 1, "<u8", lower, 0, (1,))  # the eight bytes from each place on
    out = mix(eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ size.astype(U64)
    more = np.flatnonzero((size > 8) & (size <= SHORT_BYTES))
    for k in range(8, SHORT_BYTES, 8):
        at = starts[more] + k
        out[more] = mix(out[more] * _BASE + (eight[at] & _FIRST_BYTES[np.minimum(ends[more] - at, 8)]))
        more = more[size[more] > k + 8]
        if not len(more):
            break
    long = np.flatnonzero(size > SHORT_BYTES)
    if len(long):
        end = np.cumsum(size[long])
        apart = np.concatenate([buf[b:e] for b, e in zip(starts[long], ends[long], strict=True)])
        out[long] = _hash_piece(apart, end - size[long], end)
    return out


def words(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin."""
    starts, ends, begin = word_bounds(buf, off, word)
    return hash_words(buf, starts, ends), begin


def roll(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = values[:n].copy()
    for k in range(1, width):
        out *= _SHINGLE_BASE
        out += values[k : k + n]
    return mix(out)


def shingle_sets(hashes: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by hash within it, and where each text's set begins.

    A text of fewer words than ``width``, but not none, has its whole word sequence as its one shingle.
    """
    count = np.diff(begin)
    per = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), per)
    first = np.repeat(begin[:-1] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    rolled = roll(hashes, width)
    out = np.zeros(len(owner), U64)
    full = np.repeat(count >= width, per)
    out[full] = rolled[first[full]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        h = int(count[d])
        for v in hashes[begin[d] : begin[d + 1]]:
            h = (h * 0xD6E8FEB86659FD93 + int(v)) & 0xFFFFFFFFFFFFFFFF
        out[np.searchsorted(owner, d)] = mix(np.array([h ^ 0x5555], U64))[0]
    keep = np.ones(len(out), bool)
    bounds = np.concatenate([[0], np.cumsum(per)])
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        out[b:e].sort()
    if len(out):
        keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(count)))]).astype(np.int64)
