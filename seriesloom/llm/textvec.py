"""Vectorised text primitives over Arrow string batches.

Everything works on the UTF-8 bytes of many texts at once: word boundaries,
64-bit word hashes and rolling k-word hashes come out as numpy arrays, with no
Python object per word.  Texts are handled in chunks of whole documents so the
working set stays at a few tens of MB whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MASK = (1 << 64) - 1
#: bytes of text handled at once (a longer single document is its own chunk)
CHUNK_BYTES = 2 << 20


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(U(seed & MASK) + np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << max(0, (n - 1)).bit_length())
        out = np.ones(size, U)
        done, step = 1, base & MASK
        while done < size:
            out[done : 2 * done] = out[:done] * U(step)
            done, step = 2 * done, step * step & MASK
        _POWERS[base] = have = out
    return have[:n]


#: one odd base and one byte table for each independent hash lane
WORD_BASES = [int(x) | 1 for x in splitmix(11, 2)]
GRAM_BASES = [int(x) | 1 for x in splitmix(12, 2)]
BYTE_VALUES = [splitmix(21, 256), splitmix(22, 256)]


def byte_class(excluded: list[tuple[int, int]], fold_ascii: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is-word mask, byte folding) for words made of all bytes outside the ranges."""
    fold = np.arange(256, dtype=np.uint8)
    if fold_ascii:
        fold[65:91] += 32
    word = np.ones(256, bool)
    for lo, hi in excluded:
        word[lo : hi + 1] = False
    return word[fold], fold


#: words are runs of anything but ASCII white space
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
SPACED_LOWER = byte_class([(0x20, 0x20), (0x09, 0x0D)], fold_ascii=True)
#: words are runs of digits, letters and non-ASCII characters, A-Z folded
ALNUM_LOWER = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], fold_ascii=True)


def flatten(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = pc.fill_null(arr, "" if not pa.types.is_binary(arr.type) else b"")
    arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def valid(arr: pa.Array) -> pa.Array:
    """A binary column's texts with bytes that are not UTF-8 replaced."""
    try:
        arr.cast(pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace").encode() for x in arr.to_pylist()], pa.large_binary())
    return arr


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of whole texts."""
    buf, offs = flatten(arr)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Words:
    """Words of a run of texts: byte spans, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray
    hashes: list[np.ndarray]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def words(buf: np.ndarray, offs: np.ndarray, kind: tuple[np.ndarray, np.ndarray], lanes: int = 1) -> Words:
    """Split texts into words; `lanes` independent 64-bit hashes of each."""
    is_word, fold = kind
    n = len(buf)
    mask = is_word[buf]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] = mask[heads]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = mask[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = Words(starts, ends, np.searchsorted(starts, offs), [])
    for lane in range(lanes):
        out.hashes.append(span_hashes(buf[mask] if lanes else buf, ends - starts, BYTE_VALUES[lane][fold], WORD_BASES[lane]))
    return out


def span_hashes(flat: np.ndarray, lens: np.ndarray, values: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of consecutive spans of `flat` (all of positive length)."""
    if not len(lens):
        return np.zeros(0, U)
    head = np.cumsum(lens) - lens
    at = np.arange(len(flat)) - np.repeat(head, lens)
    vals = values[flat] * powers(base, int(lens.max()))[at]
    return mix(np.add.reduceat(vals, head) + lens.astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values (also across texts: mask those)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    base = GRAM_BASES[lane]
    total = np.zeros(n + 1, U)
    np.cumsum(h * powers(base, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n)[: n - k + 1])


def inside(offs: np.ndarray, k: int) -> np.ndarray:
    """Which of the n-k+1 runs of k words lie within one text."""
    n = int(offs[-1])
    if n < k:
        return np.zeros(0, bool)
    return (np.repeat(offs[1:], np.diff(offs)) - np.arange(n) >= k)[: n - k + 1]


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each `width` consecutive values, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out, size = op(out[: len(out) - size], out[size:]), 2 * size
    return out if size == width else op(out[: len(out) - (width - size)], out[width - size :])


def kept_bytes(buf: np.ndarray, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's kept words joined by one space: (bytes, offsets)."""
    ndoc = len(w.offs) - 1
    flag = np.zeros(len(buf) + 1, np.int8)
    flag[w.starts[keep]] += 1
    np.add.at(flag, w.ends[keep], np.int8(-1))
    take = np.zeros(len(buf) + 1, bool)
    take[:-1] = np.cumsum(flag[:-1], dtype=np.int8) > 0
    doc = w.docs()[keep]
    more = np.zeros(len(doc), bool)  # a kept word of the same text follows
    more[:-1] = doc[1:] == doc[:-1]
    seps = w.ends[keep][more]
    out = np.concatenate([buf, np.zeros(1, np.uint8)])
    out[seps] = 0x20
    take[seps] = True
    size = np.bincount(doc, weights=(w.ends - w.starts)[keep] + more, minlength=ndoc).astype(np.int64)
    return out[take], np.concatenate([[0], np.cumsum(size)])
