"""Static range asymmetric numeral systems over token ids, in numpy.

One frequency table serves all segments of a corpus.  A segment is a run of
ids, cut into blocks that are coded independently; ids of a block go to `LANES`
interleaved coders in turn, and all blocks and lanes advance together as one
vector.  At every `STEP` rounds the lanes' states and the place in the block's
words are kept as a checkpoint; a reader may start at any of them, and `decode`
starts at all of them at once.  Each block carries a CRC-32 of its ids, the
segment one of its bytes.  Places beyond the last id code nothing.

A segment's bytes (little-endian): magic, a byte that tells its form, the number
of ids (64 bits), what follows, and a CRC-32 of all before it.  Form 1: for each
block its words and CRC, for each checkpoint its word place, the states, the
words.  Forms 2 and 4: the ids themselves in so many bytes each, where that is
shorter, so no segment is larger than its ids and 17 bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

U = np.uint64
MAGIC = b"RAN2"
CODED = 1
LANES = 32
#: ids of a lane in a block, and between checkpoints
ROUNDS, STEP = 512, 256
LOW = U(1 << 31)


@dataclass(frozen=True)
class Table:
    """Symbols (ascending) with frequencies that sum to 2**bits."""

    symbols: np.ndarray
    freq: np.ndarray
    bits: int

    @property
    def slots(self) -> np.ndarray:
        """The symbol's place for each slot."""
        return np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq)


def table_of(symbols: np.ndarray, counts: np.ndarray) -> Table:
    """The table of counted symbols; every one keeps a frequency of one or more."""
    order = np.argsort(symbols)
    symbols, counts = symbols[order].astype(np.uint32), counts[order].astype(np.float64)
    bits = max(16, int(len(symbols)).bit_length() + 4)
    if bits > 28:
        raise ValueError("too many symbols for one table")
    if not len(symbols):
        return Table(symbols, np.zeros(0, np.int64), bits)
    freq = np.maximum(1, np.floor(counts * ((1 << bits) / counts.sum()))).astype(np.int64)
    over = int(freq.sum()) - (1 << bits)
    for i in np.argsort(-freq, kind="stable"):  # the most frequent give or take the difference
        if not over:
            break
        change = min(over, int(freq[i]) // 2) if over > 0 else over
        freq[i] -= change
        over -= change
    return Table(symbols, freq, bits)


def _shape(n: int) -> tuple[int, int, int]:
    """(blocks, rounds, checkpoints of a block) for n ids."""
    rounds = min(ROUNDS, -(-n // LANES))
    return -(-n // (ROUNDS * LANES)), rounds, -(-rounds // STEP)


def encode(ids: np.ndarray, table: Table) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    width = 2 if not n or ids.max() < 1 << 16 else 4
    head = MAGIC + bytes([CODED]) + n.to_bytes(8, "little")
    coded = head + _coded(ids, table) if n else head
    if not n or len(coded) >= width * n + 13:
        coded = MAGIC + bytes([width]) + n.to_bytes(8, "little") + ids.astype(f"<u{width}").tobytes()
    return coded + zlib.crc32(coded).to_bytes(4, "little")


def _coded(ids: np.ndarray, table: Table) -> bytes:
    n, bits = len(ids), table.bits
    blocks, rounds, marks = _shape(n)
    whole = np.zeros(blocks * rounds * LANES, np.int64)
    at = np.searchsorted(table.symbols, ids)
    if (table.symbols[np.minimum(at, len(table.symbols) - 1)] != ids).any():
        raise ValueError("an id is not in the table")
    whole[:n] = at
    whole = whole.reshape(blocks, rounds, LANES)
    order = whole.transpose(1, 0, 2)
    f_of, c_of = table.freq.astype(U), np.concatenate([[0], np.cumsum(table.freq[:-1])]).astype(U)
    f, c = f_of[order], c_of[order]
    most, gap = f << U(63 - bits), U(1 << bits) - f
    x = np.full((blocks, LANES), LOW)
    emitted, words = np.zeros((rounds, blocks, LANES), bool), np.zeros((rounds, blocks, LANES), np.uint32)
    states = np.zeros((blocks, marks, LANES), U)
    spare = n - (blocks - 1) * rounds * LANES  # ids of the last block
    for r in range(rounds - 1, -1, -1):
        full = np.greater_equal(x, most[r], out=emitted[r])
        dead = max(0, min(LANES, spare - r * LANES))
        full[-1, dead:] = False
        np.copyto(words[r], x, casting="unsafe")
        y = x >> (full.astype(U) << U(5))
        y += (y // f[r]) * gap[r]
        y += c[r]
        if dead < LANES:
            y[-1, dead:] = x[-1, dead:]
        x = y
        if r % STEP == 0:
            states[:, r // STEP] = x
    per_round = emitted.sum(2)
    place = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(per_round, 0)])
    crcs = [zlib.crc32(ids[b * rounds * LANES : (b + 1) * rounds * LANES].tobytes()) for b in range(blocks)]
    body = words.transpose(1, 0, 2)[emitted.transpose(1, 0, 2)]
    parts = [place[-1].astype("<u4"), np.array(crcs, "<u4"), place[:-1:STEP].T.astype("<u4"), states.astype("<u8"), body.astype("<u4")]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def decode(raw: bytes, table: Table) -> np.ndarray:
    """All ids, from all checkpoints of all blocks at once; checks every CRC."""
    if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("not a segment, or damaged")
    form, n, at = raw[4], int.from_bytes(raw[5:13], "little"), 13
    if form != CODED:
        return np.frombuffer(raw, f"<u{form}", n, at).astype(np.uint32)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    blocks, rounds, marks = _shape(n)
    size, crcs = take("<u4", blocks).astype(np.int64), take("<u4", blocks)
    place, x = take("<u4", blocks * marks).astype(np.int64), take("<u8", blocks * marks * LANES).reshape(-1, LANES)
    words = np.append(take("<u4", int(size.sum())), np.uint32(0)).astype(U)
    start = place + np.repeat(np.cumsum(size) - size, marks)
    slots, bits = table.slots, table.bits
    f_of, c_of = table.freq.astype(U), np.concatenate([[0], np.cumsum(table.freq[:-1])]).astype(U)
    out = np.zeros((STEP, len(x), LANES), np.uint32)
    first = (np.arange(blocks)[:, None] * rounds + np.arange(marks) * STEP).reshape(-1, 1) * LANES + np.arange(LANES)  # each state's first id
    last = np.repeat((np.arange(blocks) + 1) * rounds, marks)[:, None] * LANES
    for r in range(min(STEP, rounds)):
        slot = x & U((1 << bits) - 1)
        s = slots[slot]
        out[r] = table.symbols[s]
        y = f_of[s] * (x >> U(bits)) + slot - c_of[s]
        low = y < LOW
        if r * LANES + int(first[-1, -1]) >= n or r >= rounds - (marks - 1) * STEP:  # some places hold no id
            live = (first + r * LANES < n) & (first + r * LANES < last)
            y, low = np.where(live, y, x), low & live
        rank = np.cumsum(low, 1)
        next_word = words[np.minimum(start[:, None] + rank - 1, len(words) - 1)]
        x = np.where(low, (y << U(32)) | next_word, y)
        start = start + rank[:, -1]
    ids = np.concatenate([out.transpose(1, 0, 2).reshape(blocks, marks * STEP, LANES)[b, :rounds].reshape(-1) for b in range(blocks)])[:n]
    for b in range(blocks):
        if zlib.crc32(np.ascontiguousarray(ids[b * rounds * LANES : (b + 1) * rounds * LANES], "<u4").tobytes()) != crcs[b]:
            raise ValueError(f"block {b} is damaged")
    return ids
