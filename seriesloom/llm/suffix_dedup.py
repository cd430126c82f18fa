"""Removal of repeated passages by sparse suffix arrays.

Suffixes are retained at anchors only (see `anchors`).  Each carries its next
half window as one hash and the words before and after that as 32-bit hashes.
A block sorts the suffixes that share their first half window twice, by what
follows and by what precedes, and compares neighbours: the common lengths say
where the classes of suffixes that match over any given length end.  A match of
`window` words that reaches k words left of the anchor joins the class of k
words leftwards with that of the rest rightwards, so extending to all k finds
every earlier document with such a window, in two sorts for a block.

What an anchor's matches of `window` words or more with documents of smaller
doc_id cover is removed; the earliest copy stays.

A half window can be hot (see `anchors`).  Two suffixes that match around a hot
one share half the other words of a window to its right or to its left, so each
is dealt twice, with those to the right and with those to the left, and sorted in
that order like the others.  Of suffixes of a batch that agree in all their words
only the earliest document's goes on; the others' matches are found right there.

Defined cases: null texts have no words; a null doc_id is kept whole and judges
nothing; repeated doc_ids never remove from each other; texts shorter than a
window stay; very long texts are whole; an empty table gives no rows; other
columns, whatever their names, are left out.  Output: doc_id, n_words, n_removed,
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import exchange as X
from . import textvec as T

U = np.uint64


def suffix_dedup(docs: DataFrame, window: int = 50, broadcast_bytes: int = X.BROADCAST_BYTES, hot: int | None = None) -> DataFrame:
    """See the module's text.  One row for each input row; hot: see anchors.hot_count."""
    if window < 4:
        raise ValueError("window must be four words or more")
    docs = X.ensure_text(docs)
    ws, blocks = X.Workspace(docs.sparkSession, "suffix", docs), X.blocks_for(docs)
    busy = A.repeated_anchors(ws, docs, window, blocks, hot or A.hot_count(blocks))
    ws.write("spans", neighbours(X.attach(ws, docs, "anchors", bound=broadcast_bytes), window, blocks, busy))
    ws.drop("anchors")
    return A.without_spans(ws, docs, "spans", broadcast_bytes)


def around(short: np.ndarray, doc: np.ndarray, at: np.ndarray, step: int, width: int, offs: np.ndarray) -> np.ndarray:
    """The `width` word hashes from `at` on in one direction; 0 beyond the text."""
    j = at[:, None] + step * np.arange(width)[None, :]
    good = (j >= offs[doc][:, None]) & (j < offs[doc + 1][:, None])
    return np.where(good, short[np.clip(j, 0, max(len(short) - 1, 0))], np.uint32(0))


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values of each row pair agree (0 never agrees)."""
    return np.cumprod((a == b) & (a != 0), axis=1, dtype=np.int8).sum(axis=1, dtype=np.int32)


def neighbours(docs: DataFrame, window: int, blocks: int, busy: np.ndarray) -> DataFrame:
    half = window // 2
    side = window - half
    kinds = {"sig": U, "doc": np.int64, "pos": np.int32, "tag": np.uint32, "after": np.uint32, "before": np.uint32}
    schema = X.block_schema(*kinds, *A.SETTLED)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            pos, row = A.listed(batch.column(2), np.int32)
            tag, _ = A.listed(batch.column(3), np.uint32)
            for lo, hi, buf, offs in T.chunks(batch.column(1)):
                w = T.words(buf, offs, T.SPACED)
                i, j = np.searchsorted(row, [lo, hi])
                doc, own = row[i:j] - lo, A.tags(w)
                mine = tag[i:j] == own[doc]
                doc = doc[mine]
                at = w.offs[doc] + pos[i:j][mine]
                if not len(at):
                    continue
                short = np.maximum((w.hashes[0] >> U(32)).astype(np.uint32), np.uint32(1))
                after, before = around(short, doc, at + half, 1, side, w.offs), around(short, doc, at - 1, -1, side, w.offs)
                c = {"sig": T.grams(w.hashes[0], half)[at], "doc": ids[lo + doc], "pos": (at - w.offs[doc]).astype(np.int32), "tag": own[doc], "after": after, "before": before}
                hot = A.among(c["sig"], busy)
                if hot.any():
                    some = {k: v[hot] for k, v in c.items()}
                    out = matches(some, half, window)
                    yield X.padded(X.pack(A.doc_block(out["doc"], blocks), dict(zip(A.SETTLED, out.values(), strict=True))), schema)
                    both = halves(first_of_each(some), side)
                    c = {k: np.concatenate([v[~hot], both[k]]) for k, v in c.items()}
                yield X.padded(X.pack((c["sig"] >> U(32)) % U(blocks), c), schema)

    def compare(table: pa.Table) -> pa.Table:
        c, settled = X.unpack(table, kinds), X.unpack(table, A.SETTLED)
        c["after"], c["before"] = c["after"].reshape(-1, side), c["before"].reshape(-1, side)
        out = {k: np.concatenate([v, settled[f"{k}_s"]]) for k, v in matches(c, half, window).items()}
        return pa.Table.from_batches([X.pack(A.doc_block(out["doc"], blocks), out)])

    moved = docs.select("doc_id", "text", "pos", "tag").mapInArrow(X.giving_back(emit), X.binary_schema(*kinds, *A.SETTLED))
    return A.by_document(X.by_block(moved, compare, X.binary_schema("doc", "start", "end", "tag"), blocks=blocks), {"start": np.int32, "end": np.int32, "tag": np.uint32}, blocks)


def folded(side: np.ndarray, words: int, salt: int) -> np.ndarray:
    """A hash of the first words of each row."""
    values = (side[:, :words].astype(U) + U(salt)) * T.splitmix(41, words)
    return T.mix(values.sum(1, dtype=U) + U(salt))


def halves(c: dict[str, np.ndarray], side: int) -> dict[str, np.ndarray]:
    """Each suffix under two finer signatures: with the next words, and with the words before."""
    words = side // 2
    sig = np.concatenate([T.mix(c["sig"] ^ folded(c[k], words, salt)) for k, salt in (("after", 1), ("before", 2))])
    return {k: np.concatenate([v, v]) for k, v in c.items()} | {"sig": sig}


def first_of_each(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of suffixes that agree in all their words, those of the earliest document."""
    n, width = c["after"].shape
    key = np.empty((n, 8 + 8 * width), np.uint8)
    key[:, :8] = c["sig"].view(np.uint8).reshape(n, 8)
    key[:, 8:] = np.hstack([c["after"], c["before"]]).view(np.uint8).reshape(n, -1)
    _, same = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_inverse=True)
    keep = c["doc"] == A.earliest(c["doc"], same)
    return {k: v[keep] for k, v in c.items()}


def sorted_suffixes(sig: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order: the shared first half window, then word by word; words each has in common with the one before it there, -1 if not even the first)."""
    n, width = side.shape
    key = np.empty((n, 8 + 4 * width), np.uint8)
    key[:, :8] = sig.astype(">u8").view(np.uint8).reshape(n, 8)
    key[:, 8:] = side.astype(">u4").view(np.uint8).reshape(n, -1)
    order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
    x, y = order[1:], order[:-1]
    return order, np.concatenate([[-1], np.where(sig[x] == sig[y], common(side[x], side[y]), -1)])


def classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Number of each suffix's class of those that match it over `length` words."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def matches(c: dict[str, np.ndarray], half: int, window: int) -> dict[str, np.ndarray]:
    """Spans of later documents that match an earlier one around an anchor."""
    n, side = len(c["doc"]), window - half
    low, high = np.full(n, window), np.full(n, -1)  # words left of the anchor, of the windows that match
    if n:
        right, left = sorted_suffixes(c["sig"], c["after"]), sorted_suffixes(c["sig"], c["before"])
        for k in range(side + 1):
            both = classes(*right, side - k) * (n + 1) + classes(*left, k)
            later = c["doc"] > A.earliest(c["doc"], both)
            low[later], high[later] = np.minimum(low[later], k), k
    x = np.flatnonzero(high >= 0)
    return {"doc": c["doc"][x], "start": (c["pos"][x] - high[x]).astype(np.int32), "end": (c["pos"][x] - low[x] + window).astype(np.int32), "tag": c["tag"][x]}


def digest(out: DataFrame) -> DataFrame:
    """Digest columns of the query, as for the other passage operator."""
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
