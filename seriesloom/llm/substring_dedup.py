"""Removal of passages that repeat across documents, by level-wise doubling.

Level 1 finds which runs of half a level's words repeat (only at the positions
that `anchors` selects).  The runs that repeat, and no others, are extended to
windows of twice that length; of those the ones that stand in two documents are
extended to twice the length again, and so on up to `window` words, where the
last level tells in which document each comes first.  A window of the next level
is a candidate only if all windows of half its length inside repeat.  If none
survives a level, the work ends there.  Odd lengths are halved upwards.

A word goes if it lies in a window of `window` words whose word sequence also
starts in a document with a smaller doc_id.  All windows are judged on the
input, not on what other removals leave.

Defined cases: a null text has no words; a null doc_id has no place in the
order, so that row is kept whole and no other row is judged by it; rows that
repeat a doc_id never remove from each other; texts shorter than a window stay;
very long texts are whole; an empty table gives no rows; other columns, whatever
their names, are left out.  Output: doc_id, n_words, n_removed and text (the
kept words joined by one space).
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


def lengths(window: int, first: int) -> list[int]:
    """The levels' window lengths, each half the next, down to 2 * first or less."""
    out = [window]
    while out[0] > 2 * first:
        out.insert(0, -(-out[0] // 2))
    return out


def substring_dedup(docs: DataFrame, window: int = 50, first: int = 25, broadcast_bytes: int = X.BROADCAST_BYTES, hot: int | None = None) -> DataFrame:
    """See the module's text.  One row for each input row; first: words of the shortest runs, about; hot: see anchors.hot_count."""
    if window < 2 or first < 1:
        raise ValueError("window must be two words or more, and first one or more")
    docs = X.ensure_text(docs)
    ws, blocks = X.Workspace(docs.sparkSession, "substring", docs), X.blocks_for(docs)
    levels = lengths(window, first)
    busy = A.repeated_anchors(ws, docs, levels[0], blocks, hot or A.hot_count(blocks))
    alive = "anchors"
    for n in levels:
        name = "spans" if n == window else f"level-{n}"
        found = ws.write(name, windows_of(ws, X.attach(ws, docs, alive, bound=broadcast_bytes), n, blocks, busy, alive == "anchors", n == window))
        ws.drop(alive)
        busy, alive = np.zeros(0, U), name
        if n < window and found.isEmpty():
            return A.without_spans(ws, docs, name, broadcast_bytes)
    return A.without_spans(ws, docs, "spans", broadcast_bytes)


def windows_of(ws: X.Workspace, docs: DataFrame, window: int, blocks: int, busy: np.ndarray, anchored: bool, last: bool) -> DataFrame:
    """A level: windows around surviving runs (anchored), or inside surviving spans, that repeat, as spans by document.

    The last level gives those that an earlier document holds, the others all that two documents hold.
    Windows are dealt by their smallest half window, or by themselves if that is in `busy`.
    """
    cold = {"whole": U, "check": np.uint32, "doc": np.int64, "start": np.int32, "count": np.int32, "tag": np.uint32}
    schema = X.block_schema(*cold, *A.WINDOWS, *A.SETTLED)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - window // 2 + 1
        for batch in batches:
            ids = batch.column(0).to_numpy()
            pos, row = A.listed(batch.column(2), np.int32)
            tag, _ = A.listed(batch.column(3), np.uint32)
            end = pos if anchored else A.listed(batch.column(4), np.int32)[0]
            for lo, hi, buf, offs in T.chunks(batch.column(1)):
                w = T.words(buf, offs, T.SPACED, lanes=2)
                h, low, ok = A.minima(w, window)
                i, j = np.searchsorted(row, [lo, hi])
                doc, own = row[i:j] - lo, A.tags(w)
                mine = tag[i:j] == own[doc]
                at = (w.offs[doc] + pos[i:j])[mine]
                if not len(low):
                    continue
                if anchored:
                    alive = np.full(len(h), A.TOP)
                    alive[at] = h[at]
                    go = np.flatnonzero(ok & (T.sliding(alive, width, np.minimum) == low))
                else:
                    stop = (w.offs[doc] + end[i:j])[mine] - window + 1
                    edge = np.zeros(len(ok) + 1, np.int64)
                    np.add.at(edge, at[stop > at], 1)
                    np.add.at(edge, stop[stop > at], -1)
                    go = np.flatnonzero(ok & (np.cumsum(edge)[:-1] > 0))
                if len(busy):
                    apart = A.among(low[go], busy)
                    yield from A.deal_windows(w, go[apart], ids[lo:hi], own, window, blocks, schema, last)
                    go = go[~apart]
                if not len(go):
                    continue
                whole, check = T.grams(w.hashes[0], window)[go], (T.grams(w.hashes[1], window, 1)[go] >> U(32)).astype(np.uint32)
                block = (low[go] >> U(32)) % U(blocks)
                head = np.flatnonzero(np.concatenate([[True], (go[1:] != go[:-1] + 1) | (low[go][1:] != low[go][:-1])]))
                first = go[head]
                of = np.searchsorted(w.offs, first, "right") - 1
                count = np.diff(np.append(head, len(go))).astype(np.int32)
                a = X.pack(block, {"whole": whole, "check": check})
                b = X.pack(block[head], {"doc": ids[lo + of], "start": (first - w.offs[of]).astype(np.int32), "count": count, "tag": own[of]})
                yield X.padded(pa.RecordBatch.from_arrays([*a.columns, *b.columns[1:]], [*a.schema.names, *b.schema.names[1:]]), schema)

    def judge(table: pa.Table) -> pa.Table:
        c, apart = X.unpack(table, cold), A.judge_windows(table, window, last)
        run = np.repeat(np.arange(len(c["count"])), c["count"])
        pos = c["start"][run] + (np.arange(len(run)) - np.repeat(np.cumsum(c["count"]) - c["count"], c["count"]))
        doc = c["doc"][run]
        at = np.flatnonzero(A.twice(doc, c["whole"], c["check"], last))
        out = A.spans(doc[at], pos[at], c["tag"][run[at]], window)
        out = {k: np.concatenate([v, apart[k]]) for k, v in out.items()}
        return pa.Table.from_batches([X.pack(A.doc_block(out["doc"], blocks), out)])

    cols = ["doc_id", "text", *(("pos", "tag") if anchored else ("start", "tag", "end"))]
    moved = docs.select(*cols).mapInArrow(X.giving_back(emit), X.binary_schema(*cold, *A.WINDOWS, *A.SETTLED))
    found = X.by_block(moved, judge, X.binary_schema("doc", "start", "end", "tag"), blocks=blocks)
    return A.by_document(found, {"start": np.int32, "end": np.int32, "tag": np.uint32}, blocks, joined=0 if last else window)


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns of op2."""
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
