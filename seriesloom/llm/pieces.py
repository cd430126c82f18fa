"""Byte-level BPE ids of whole texts, by distinct pieces.

The tokenizers library splits a text into pieces and encodes each piece on its
own.  Where a tokenizer file asks for just that (a byte-level pre-tokenizer
with its own pattern, no normalizer, no prefix space, no truncation or padding),
the split is done here for many texts at once on their bytes, and the library's
model encodes every distinct piece once for each worker (a bounded cache keyed
by two independent 64-bit hashes).  Texts fall into three tiers:

* ASCII and Latin letters are told apart by their bytes;
* other characters by their code points' Unicode categories, where these have
  been the same since version 3.2, so that no later table changes the result;
* what is left (characters of other versions, the string of an added token, or
  bytes that are not UTF-8, which are replaced) is encoded by the library whole.

For any other tokenizer file the library encodes all texts.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from . import textvec as T

U = np.uint64
#: bytes of text whose pieces are looked up at once
CHUNK = 2 << 20
#: distinct pieces kept by a worker from chunk to chunk; a chunk with more still has all of its own
KEPT = 600_000

SPACE, WHITE, LETTER, DIGIT, OTHER, STRANGE = 1, 2, 4, 8, 16, 32
#: fixed values: English endings that are pieces of their own after a quote
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _classes() -> np.ndarray:
    c = np.full(256, OTHER, np.uint8)
    c[0x20] = SPACE
    c[0x09:0x0E] = WHITE
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = c[128:] = LETTER
    return c


CLASS = _classes()
#: bytes that may stand in a text of the first tier: ASCII, and the letters U+00C0 to U+024F
PLAIN = np.zeros(256, bool)
PLAIN[0x09:0x0E] = PLAIN[0x20:0x7F] = PLAIN[0x80:0xC0] = PLAIN[0xC3:0xCA] = True


@functools.cache
def point_classes() -> np.ndarray:
    """Class of each code point; STRANGE where Unicode versions differ."""
    old, out = unicodedata.ucd_3_2_0, np.full(0x110000, STRANGE, np.uint8)
    for cp in range(0x30000):  # later planes hold nothing that is stable and common
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == old.category(c) and kind not in ("Cn", "Cs", "Co"):
            white = kind in ("Zs", "Zl", "Zp") or cp in (*range(0x09, 0x0E), 0x85)
            out[cp] = WHITE if white else {"L": LETTER, "N": DIGIT}.get(kind[0], OTHER)
    out[0x20] = SPACE
    return out


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def cuts(buf: np.ndarray, offs: np.ndarray, cls: np.ndarray | None = None, lead: np.ndarray | None = None) -> np.ndarray:
    """First bytes of all pieces; cls: each byte's class if not the first tier's, lead: each byte's character's first byte."""
    n = len(buf)
    cls = CLASS[buf] if cls is None else cls
    head = np.zeros(n + 1, bool)
    head[offs] = True
    first = np.ones(n, bool) if lead is None else lead
    white = cls <= WHITE
    before = np.concatenate([[False], white[:-1]]) & ~head[:-1]
    last = np.append(first[1:], True)  # of a character
    after = np.concatenate([~white[1:], [False]]) & ~head[1:] & last  # a non-white character of the same text follows
    if lead is not None:  # any byte of a white character knows what follows the character
        end = np.flatnonzero(last)
        after = after[end[np.cumsum(first) - 1]]
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    change |= head[:-1]
    spaced = np.concatenate([[False], buf[:-1] == 0x20]) & ~head[:-1]
    begin = np.where(white, ~before | after, change & ~spaced) & first
    quote = np.flatnonzero(buf == 0x27)
    if len(quote):
        own = head[quote] | ((cls[quote - 1] != SPACE) & (cls[quote - 1] != OTHER))  # begins a piece
        long = np.append(buf, np.zeros(2, np.uint8))
        size = np.zeros(len(quote), np.int64)
        text_end = offs[np.searchsorted(offs, quote, "right")]
        for e in ENDINGS:
            same = own & (quote + len(e) < text_end)
            for k, b in enumerate(e):
                same &= long[quote + 1 + k] == b
            size[same & (size == 0)] = len(e)
        at, size = quote[size > 0], size[size > 0]
        for k in (1, 2):
            begin[(at + k)[size >= k]] = False
        stop = at + size + 1
        begin[stop[stop < n]] = True
    return np.flatnonzero(begin)


def odd_texts(buf: np.ndarray, offs: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Which texts hold a marked byte."""
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offs[1:]] > total[offs[:-1]]


def unlatin(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes that the first tier does not cover."""
    bad, lead = ~PLAIN[buf], buf >= 0xC0
    tail = ((buf & 0xC0) == 0x80).astype(bool)
    head = np.zeros(len(buf) + 1, bool)
    head[offs] = True
    bad[1:] |= (lead[:-1] & ~head[1:-1]) != tail[1:]
    bad[:1] |= tail[:1]
    bad |= lead & (head[1:] | ~np.append(tail[1:], False))
    bad[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
    return bad


def marked(buf: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Bytes where the string of an added token begins."""
    bad, raw = np.zeros(len(buf), bool), buf.tobytes()
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            bad[at] = True
            at = raw.find(mark, at + 1)
    return bad


def picked(buf: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some texts' bytes end to end, and their offsets."""
    size = np.diff(offs)
    return buf[np.repeat(which, size)], np.concatenate([[0], np.cumsum(size[which])])


def own_split(tokenizer) -> bool:
    """Whether a tokenizer asks for exactly the split made here."""
    from tokenizers import models

    pre = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    rest = tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None
    return bool(plain and rest and isinstance(tokenizer.model, models.BPE) and not tokenizer.model.dropout)


class Encoder:
    """Ids of texts by one tokenizer file, with the worker's cache of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = own_split(self.tokenizer)
        self.model = self.tokenizer.model
        self.table = dict(enumerate(byte_letters()))
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, U), np.zeros(0, U)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(0, np.uint32), np.zeros(0, bool)

    def shrink(self) -> None:
        """Drop the pieces that were not met again since they came, or since the last time."""
        keep = self.used
        self.key, self.check, size = self.key[keep], self.check[keep], self.size[keep]
        end = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[keep] - (end - size), size) + np.arange(int(size.sum()))]
        self.start, self.size, self.used = end - size, size, np.zeros(len(size), bool)

    def known(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def learn(self, key: np.ndarray, check: np.ndarray, raw: bytes, lo: np.ndarray, hi: np.ndarray) -> None:
        """Encode new pieces (ascending keys) and merge them in, whatever their number."""
        table = self.table
        ids = [[t.id for t in self.model.tokenize(raw[i:j].decode("latin-1").translate(table))] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        at = np.searchsorted(self.key, key)
        self.key, self.check = np.insert(self.key, at, key), np.insert(self.check, at, check)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)
        self.used = np.insert(self.used, at, np.zeros(len(at), bool))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each text)."""
        n = len(offs) - 1
        if not self.fast:
            return self.library(buf, offs)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        tier = np.where(odd_texts(buf, offs, unlatin(buf, offs)), 1, 0)
        tier[odd_texts(buf, offs, marked(buf, self.marks))] = 2
        if not tier.any():
            return self.plain(buf, offs)
        own = []
        for k, way in enumerate((self.plain, self.wide, self.library)):
            which = tier == k
            ids, count = way(*picked(buf, offs, which)) if which.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            own.append((np.flatnonzero(which), ids, count))
        count = np.zeros(n, np.int64)
        for which, _, c in own:
            count[which] = c
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for which, ids, c in own:
            out[np.repeat(start[which] - np.cumsum(c) + c, c) + np.arange(len(ids))] = ids
        return out, count

    def library(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's own ids of whole texts; bytes that are not UTF-8 are replaced."""
        texts = [buf[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offs[:-1], offs[1:], strict=True)]
        parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def wide(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of any characters, told apart by their code points."""
        try:
            points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:
            return self.library(buf, offs)
        cls = point_classes()[points]
        lead = (buf & 0xC0) != 0x80
        cls = cls[np.cumsum(lead) - 1]
        strange = odd_texts(buf, offs, cls == STRANGE)
        if not strange.any():
            return self.plain(buf, offs, cls, lead)
        keep = np.repeat(~strange, np.diff(offs))
        good, odd = self.plain(*picked(buf, offs, ~strange), cls[keep], lead[keep]), self.library(*picked(buf, offs, strange))
        count = np.zeros(len(strange), np.int64)
        count[~strange], count[strange] = good[1], odd[1]
        out, of = np.zeros(int(count.sum()), np.uint32), np.repeat(strange, count)
        out[~of], out[of] = good[0], odd[0]
        return out, count

    def plain(self, buf: np.ndarray, offs: np.ndarray, cls: np.ndarray | None = None, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts of known characters, by their distinct pieces."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        lo = cuts(buf, offs, cls, lead)
        hi = np.append(lo[1:], len(buf))
        one, two = (T.span_hashes(buf, hi - lo, T.BYTE_VALUES[k], T.WORD_BASES[k]) for k in (0, 1))
        order = np.argsort(one)
        new = np.ones(len(order), bool)
        new[1:] = one[order][1:] != one[order][:-1]
        first, piece = order[new], np.empty(len(order), np.int64)
        piece[order] = np.cumsum(new) - 1
        key = one[first]
        if np.any(two[first][piece] != two):  # two pieces share a hash: too rare to need speed
            return self.library(buf, offs)
        at = self.known(key, two[first])
        if (new := at < 0).any():
            if len(self.key) + int(new.sum()) > KEPT:
                self.used[at[~new]] = True
                self.shrink()  # what this chunk needs stays
                if len(self.key) + int(new.sum()) > KEPT:  # the cache begins anew, with all of this chunk in it
                    self.clear()
                    new[:] = True
            self.learn(key[new], two[first][new], buf.tobytes(), lo[first[new]], hi[first[new]])
            at = self.known(key, two[first])
            assert at.min() >= 0, "a piece of this chunk is not in the cache"
            self.used[at[~new]] = True
        else:
            self.used[at] = True
        size = self.size[at][piece]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at][piece] - (end - size), size) + np.arange(end[-1])]
        total = np.concatenate([[0], end])
        return ids, np.diff(total[np.searchsorted(lo, offs)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
