"""Content-selected positions shared by the two repeated-passage operators.

A window of `window` words holds window - half + 1 runs of `half` words; the
run with the smallest hash is the window's anchor.  Equal windows have equal
anchors at the same place inside, so comparing what surrounds anchors finds
every repeated window while only about 2 / (window - half + 2) of all
positions are moved.

A half window can stand in a third of all documents.  A batch that holds it in
two documents knows that it repeats: its places go straight to their documents
and one counted row stands for them, so no task gathers them.  Half windows
counted `hot_count` times or more are listed, and what surrounds them is dealt
finer by each operator; a batch sends only what its earliest document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from . import textvec as T

U = np.uint64
TOP = U(T.MASK)
#: occurrences of a half window that one task may gather, at least, and hot half windows at most, about
GATHERED, LISTED = 20_000, 1_000_000
#: columns of anchors on the way to their half window's block, and of those known to repeat, to their document's
FOUND = {"sig": U, "doc": np.int64, "pos": np.int32, "tag": np.uint32}
KNOWN = {"doc_k": np.int64, "pos_k": np.int32, "tag_k": np.uint32}
#: columns of whole windows around hot half windows, and of spans that a batch settled
WINDOWS = {"whole_h": U, "check_h": np.uint32, "doc_h": np.int64, "start_h": np.int32, "tag_h": np.uint32}
SETTLED = {"doc_s": np.int64, "start_s": np.int32, "end_s": np.int32, "tag_s": np.uint32}


def tags(w: T.Words) -> np.ndarray:
    """32 bits of each text's word sequence: tells rows with one doc_id and other texts apart."""
    n = int(w.offs[-1])
    total = np.zeros(n + 1, U)
    np.cumsum(w.hashes[0] * T.powers(T.GRAM_BASES[0], n), out=total[1:])
    inv = T.powers(pow(T.GRAM_BASES[0], -1, 1 << 64), n + 1)
    whole = (total[w.offs[1:]] - total[w.offs[:-1]]) * inv[w.offs[:-1]]
    return (T.mix(whole) >> U(32)).astype(np.uint32)


def minima(w: T.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half-window hashes, each window's smallest of them, which windows lie in one text)."""
    half = window // 2
    h = T.grams(w.hashes[0], half)
    ok = T.inside(w.offs, window)
    low = T.sliding(h, window - half + 1, np.minimum) if len(ok) else np.zeros(0, U)
    return h, low, ok


def anchor_mask(h: np.ndarray, low: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Which half-window runs are the smallest of some window."""
    if not len(low):
        return np.zeros(len(h), bool)
    edge = np.zeros(width - 1, U)
    top = T.sliding(np.concatenate([edge, np.where(ok, low, U(0)), edge]), width, np.maximum)
    return (top == h) & (h > 0)


def rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """doc_id and text of a batch's rows that have a doc_id."""
    ids = batch.column(0)
    if ids.null_count:
        batch = batch.filter(ids.is_valid())
    if batch.num_rows:
        yield batch.column(0).to_numpy(), batch.column(1)


def hot_count(blocks: int) -> int:
    """Occurrences from which a half window is hot; grows with the input so that the list stays bounded."""
    return max(GATHERED, blocks * X.BLOCK_BYTES // 27 // LISTED)


def repeated_anchors(ws: X.Workspace, docs: DataFrame, window: int, blocks: int, hot: int, name: str = "anchors") -> np.ndarray:
    """Anchors that occur in two documents or more: written as (doc_id, pos, tag) arrays by document.

    Returns the half windows that occur `hot` times or more, sorted.
    """
    moved = X.block_schema(*FOUND, *KNOWN)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = window - window // 2 + 1
        for batch in batches:
            for ids, texts in rows(batch):
                got = []
                for lo, _, buf, offs in T.chunks(texts):
                    w = T.words(buf, offs, T.SPACED)
                    h, low, ok = minima(w, window)
                    at = np.flatnonzero(anchor_mask(h, low, ok, width))
                    if len(at):
                        doc = np.searchsorted(w.offs, at, "right") - 1
                        got.append((h[at], ids[lo + doc], (at - w.offs[doc]).astype(np.int32), tags(w)[doc]))
                if not got:
                    continue
                sig, doc, pos, tag = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(sig, kind="stable")
                cut, size = X.runs(sig[order])
                twice = np.minimum.reduceat(doc[order], cut) < np.maximum.reduceat(doc[order], cut)
                known, one = order[np.repeat(twice, size)], order[cut[twice]]
                sent = np.concatenate([order[np.repeat(~twice, size)], one])
                at = pos[sent]
                at[len(sent) - len(one) :] = -size[twice]  # stands for so many
                yield X.padded(X.pack((sig[sent] >> U(32)) % U(blocks), {"sig": sig[sent], "doc": doc[sent], "pos": at, "tag": tag[sent]}), moved)
                yield X.padded(X.pack(doc_block(doc[known], blocks), {"doc_k": doc[known], "pos_k": pos[known], "tag_k": tag[known]}), moved)

    def repeats(table: pa.Table) -> pa.Table:
        c, k = X.unpack(table, FOUND), X.unpack(table, KNOWN)
        order = np.argsort(c["sig"], kind="stable")
        doc, pos = c["doc"][order], c["pos"][order]
        cut, size = X.runs(c["sig"][order])
        stands = np.add.reduceat(np.where(pos < 0, -pos.astype(np.int64), 1), cut) if len(cut) else size
        some = (np.minimum.reduceat(pos, cut) < 0) | (np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut)) if len(cut) else np.zeros(0, bool)
        keep = order[np.repeat(some, size) & (pos >= 0)]
        out = {x: np.concatenate([c[x][keep], k[f"{x}_k"]]) for x in ("doc", "pos", "tag")}
        busy = c["sig"][order][cut[some & (stands >= hot)]] if len(cut) else c["sig"]
        schema = X.block_schema("doc", "pos", "tag", "hot")
        return pa.Table.from_batches([X.padded(X.pack(doc_block(out["doc"], blocks), out), schema), X.padded(X.pack(np.zeros(len(busy), U), {"hot": busy}), schema)])

    found = X.by_block(docs.mapInArrow(X.giving_back(emit), X.binary_schema(*FOUND, *KNOWN)), repeats, X.binary_schema("doc", "pos", "tag", "hot"), blocks=blocks)
    found = ws.write(f"{name}-found", found)
    ws.write(name, by_document(found.filter("hot IS NULL").drop("hot"), {"pos": np.int32, "tag": np.uint32}, blocks))
    # at most about LISTED values of 8 bytes, see hot_count
    listed_ = [np.frombuffer(r.hot, U) for r in found.filter("hot IS NOT NULL").select("hot").collect()]
    ws.drop(f"{name}-found")
    return np.unique(np.concatenate([np.zeros(0, U), *listed_]))


def among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values of x stand in the sorted array."""
    if not len(few):
        return np.zeros(len(x), bool)
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def earliest(doc: np.ndarray, key: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """The smallest doc among the rows with the same key (and check)."""
    out = np.empty(len(doc), doc.dtype)
    if not len(doc):
        return out
    order = np.argsort(key, kind="stable")
    new = key[order][1:] != key[order][:-1]
    if check is not None and np.any(~new & (check[order][1:] != check[order][:-1])):  # two sequences share one hash
        order = np.lexsort((check, key))
        new = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    cut = np.flatnonzero(np.concatenate([[True], new]))
    out[order] = np.repeat(np.minimum.reduceat(doc[order], cut), np.diff(np.append(cut, len(key))))
    return out


def twice(doc: np.ndarray, key: np.ndarray, check: np.ndarray, later: bool) -> np.ndarray:
    """Which rows have the key (and check) of a row of a smaller doc, or of any other doc."""
    first = earliest(doc, key, check)
    return doc > first if later else (doc > first) | (-doc > earliest(-doc, key, check))


def spans(doc: np.ndarray, start: np.ndarray, tag: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Windows as spans, those that follow each other by one word joined."""
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(doc)))
    return {"doc": doc[head], "start": start[head].astype(np.int32), "end": (start[head] + size - 1 + window).astype(np.int32), "tag": tag[head]}


def deal_windows(w: T.Words, first: np.ndarray, ids: np.ndarray, own: np.ndarray, window: int, blocks: int, schema: pa.Schema, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Windows (by ascending first word; two hash lanes) to blocks of their own hash, less those that an earlier text of w settles.

    If also the earliest of a window's places counts (not last), that of a settled window settles with it, and goes on too.
    """
    if not len(first):
        return
    whole, check = T.grams(w.hashes[0], window)[first], (T.grams(w.hashes[1], window, 1)[first] >> U(32)).astype(np.uint32)
    of = np.searchsorted(w.offs, first, "right") - 1
    doc, start, tag = ids[of], (first - w.offs[of]).astype(np.int32), own[of]
    later, settled = doc > earliest(doc, whole, check), twice(doc, whole, check, last)
    go = ~later
    yield X.padded(X.pack((whole[go] >> U(32)) % U(blocks), dict(zip(WINDOWS, (whole[go], check[go], doc[go], start[go], tag[go]), strict=True))), schema)
    out = spans(doc[settled], start[settled], tag[settled], window)
    yield X.padded(X.pack(doc_block(out["doc"], blocks), dict(zip(SETTLED, out.values(), strict=True))), schema)


def judge_windows(table: pa.Table, window: int, last: bool = True) -> dict[str, np.ndarray]:
    """Spans of the dealt windows whose sequence also stands in an earlier (or any other) document, and the settled ones."""
    c, s = X.unpack(table, WINDOWS), X.unpack(table, SETTLED)
    later = twice(c["doc_h"], c["whole_h"], c["check_h"], last)
    out = spans(c["doc_h"][later], c["start_h"][later], c["tag_h"][later], window)
    return {k: np.concatenate([v, s[f"{k}_s"]]) for k, v in out.items()}


def doc_block(doc: np.ndarray, blocks: int) -> np.ndarray:
    return T.mix(doc.astype(U)) % U(blocks)


def by_document(packed: DataFrame, kinds: dict[str, type], blocks: int, joined: int = 0) -> DataFrame:
    """Packed rows regrouped to one row of arrays for each document, ordered by the first column; joined: runs of windows of so many words that follow each other become one."""
    names = list(kinds)

    def gather(table: pa.Table) -> pa.Table:
        c = X.unpack(table, {"doc": np.int64, **kinds})
        order = np.lexsort((c[names[0]], c["doc"]))
        c = {k: v[order] for k, v in c.items()}
        if joined:
            c = united(c, joined)
        cut, size = X.runs(c["doc"])
        cols = [pa.array(c["doc"][cut], pa.int64())]
        cols += [pa.array([c[k][i : i + n].tobytes() for i, n in zip(cut, size, strict=True)], pa.binary()) for k in names]
        return pa.Table.from_arrays(cols, ["doc_id", *names])

    return X.by_block(packed, gather, ", ".join(["doc_id long", *(f"{k} binary" for k in names)]), blocks=blocks)


def united(c: dict[str, np.ndarray], window: int) -> dict[str, np.ndarray]:
    """Runs of windows that lie in one text with no window missing between them, as one span."""
    order = np.lexsort((c["start"], c["tag"], c["doc"]))
    c = {k: v[order] for k, v in c.items()}
    if not len(order):
        return c
    new = np.ones(len(order), bool)
    new[1:] = (c["doc"][1:] != c["doc"][:-1]) | (c["tag"][1:] != c["tag"][:-1])
    base = (np.cumsum(new) - 1) * (int(c["end"].max()) + 1)
    reach = np.maximum.accumulate(c["end"] + base)
    new[1:] |= (c["start"] + base)[1:] + window - 1 > reach[:-1]
    at = np.flatnonzero(new)
    out = {k: v[at] for k, v in c.items()}
    out["end"] = np.maximum.reduceat(c["end"], at).astype(np.int32)
    order = np.lexsort((out["start"], out["doc"]))
    return {k: v[order] for k, v in out.items()}


def listed(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's arrays end to end, and the row of each value."""
    buf, offs = T.flatten(col)
    n = np.diff(offs) // np.dtype(kind).itemsize
    return np.frombuffer(buf.tobytes(), kind), np.repeat(np.arange(len(n)), n)


def without_spans(ws: X.Workspace, docs: DataFrame, spans: str, bound: int) -> DataFrame:
    """Every document less the word spans of the written table `spans` (doc_id, start, end, tag)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, row = listed(batch.column(2), np.int32)
            end, _ = listed(batch.column(3), np.int32)
            tag, _ = listed(batch.column(4), np.uint32)
            for lo, hi, buf, offs in T.chunks(batch.column(1)):
                i, j = np.searchsorted(row, [lo, hi])
                w = T.words(buf, offs, T.SPACED, lanes=int(j > i))
                n = int(w.offs[-1])
                gone = np.zeros(n, bool)
                if j > i:
                    doc = row[i:j] - lo
                    own = tag[i:j] == tags(w)[doc]
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, (w.offs[doc] + start[i:j])[own], 1)
                    np.add.at(edge, (w.offs[doc] + end[i:j])[own], -1)
                    gone = np.cumsum(edge)[:n] > 0
                data, at = T.kept_bytes(buf, w, ~gone)
                lost = np.add.reduceat(np.append(gone, False).astype(np.int64), w.offs[:-1]) * (w.counts > 0)
                text = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), pa.array(lost), text], ["doc_id", "n_words", "n_removed", "text"])

    joined = X.attach(ws, docs, spans, how="left", bound=bound).select("doc_id", "text", "start", "end", "tag")
    return joined.mapInArrow(X.giving_back(cut), "doc_id long, n_words long, n_removed long, text string")
