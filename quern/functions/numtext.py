"""Vectorised word and n-gram hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as
splitting the text by those six characters. Everything here works on whole Arrow buffers, so a
word costs tens of nanoseconds instead of a Python object.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 2**64)
#: Words of more bytes than this are hashed one by one with BLAKE2b.
LONG_WORD = 512
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), applied to a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, dtype=_U)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """The words of a block of texts. first[d]:first[d+1] are the words of text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The number of its text, for each word."""
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1 joined by one space."""
        if hi <= lo:
            return b""
        raw = self.data[self.starts[lo] : self.ends[hi - 1]]
        gaps = self.starts[lo + 1 : hi] - self.ends[lo : hi - 1]
        if len(gaps) == 0 or (gaps.max() == 1 and not np.any(_SPACE[raw] & (raw != 0x20))):
            return raw.tobytes()
        return b" ".join(raw.tobytes().split())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if binary else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(column: pa.Array, lower: bool = False) -> Words:
    """Cut every text of a column into words; lower: lower-case A-Z first."""
    data, off = buffers(column)
    return cut(_LOWER[data] if lower else data, off)


def cut(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64), off)
    ink = ~_SPACE[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.logical_not(ink[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(ink & edge)
    edge[-1] = True
    np.logical_not(ink[1:], out=edge[:-1])
    edge[off[1:][off[1:] > 0] - 1] = True
    ends = np.flatnonzero(ink & edge) + 1
    return Words(data, starts, ends, np.searchsorted(starts, off), off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes on every machine."""
    length = ends - starts
    out = mix(length.astype(_U) * _STEP)
    if len(starts) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    part = view[starts] & _MASKS[np.minimum(length, 8)]
    out = mix(out ^ part)
    at = np.flatnonzero(length > 8)
    long = at[length[at] > LONG_WORD]
    at = at[length[at] <= LONG_WORD]
    done = 8
    while len(at):
        left = length[at] - done
        out[at] = mix((out[at] + _STEP) ^ (view[starts[at] + done] & _MASKS[np.minimum(left, 8)]))
        at = at[left > 8]
        done += 8
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside one text, and the word at which each starts."""
    n = len(word_hashes)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(word_hashes * _power(_ODD, n), out=total[1:])
        value = (total[k:] - total[:-k]) * _power(_ODD_INVERSE, n - k + 1)
        value = mix(value + _U(k))
    end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n - k + 1) + k <= end[: n - k + 1])
    return (value, at) if len(at) == len(value) else (value[at], at)


def running(values: np.ndarray) -> np.ndarray:
    """0 and the running sums of a mask or of small counts, in four bytes each where that is enough."""
    out = np.zeros(len(values) + 1, np.int32 if len(values) < 1 << 30 and values.dtype == bool else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of a mask or of counts over each text."""
    upto = running(values)
    return (upto[off[1:]] - upto[off[:-1]]).astype(np.int64)


def distinct_per_doc(values: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted by text and value."""
    if len(values) == 0:
        return values, doc
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], d[keep]


def slices(batch: pa.RecordBatch | pa.Table, text: str, most: int = 4 << 20) -> Iterator[pa.Table]:
    """Cut a batch into runs of rows with about so many bytes of text, one row at least."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    if table.num_rows == 0:
        return
    column = table.column(text).combine_chunks()
    _, off = buffers(column)
    at = 0
    while at < table.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield table.slice(at, to - at)
        at = to


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of items of about so much in all, one item at least."""
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        yield at, to
        at = to


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim; other C libraries have none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand memory that is free, but kept by Arrow and the C library for later, to the system: a Python worker lives on beside others and the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def lean(work: Callable) -> Callable:
    """A function of groupBy().applyInArrow(), cogroup() or mapInArrow() that gives back memory when a call ends. For calls on blocks or whole partitions: it takes milliseconds."""

    def after(out):
        give_back()
        return out

    if inspect.isgeneratorfunction(work):

        def run(batches):
            yield from work(batches)
            give_back()

        return run
    # Spark counts the parameters to see whether the key is wanted.
    return {1: lambda t: after(work(t)), 2: lambda x, y: after(work(x, y)), 3: lambda key, left, right: after(work(key, left, right))}[len(inspect.signature(work).parameters)]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without planes that are all zero."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(blob: bytes | memoryview, n: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    out = np.zeros((n, 8), np.uint8)
    if width:
        out[:, :width] = raw[1 : 1 + width * n].reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their differences."""
    values = np.ascontiguousarray(values, dtype=_U)
    return pack(np.diff(values, prepend=_U(0)))


def unpack_sorted(blob: bytes | memoryview, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n), dtype=_U)
