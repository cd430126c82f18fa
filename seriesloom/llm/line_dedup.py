"""Removal of lines that repeat or nearly repeat an earlier line.

Lines are ordered by (doc_id, line number).  A line goes if the same line
occurs earlier, or if some earlier line lies within `edits` character edits of
it (both of `shortest` characters or more).  Lines of white space only stay.

Near lines are found by a segment-partition join: a line is cut into edits + 1
segments, of which an edit of a near line leaves one whole.  Each distinct line
is indexed under its own length, segment number and segment, and probes the
indexes of its own and the `edits` smaller lengths with the substrings that
can be aligned with a segment (the multi-match-aware range).  Candidates are
verified with a banded bit-parallel edit distance, vectorised over pairs.

A bucket's lines are first checked against its earliest line only.  Lines not
settled by that meet all earlier lines of their buckets whose character counts
are near enough to allow so few edits; none is left out.

A segment that a third of all lines share would fill one task.  A task that has
met it LOCAL times sends a mark for the segment, and the lines themselves under
finer keys; a bucket with a mark, or with over CROWD lines, sends its own lines
there too.  The finer keys rest on the character counts: `edits` edits change at
most 2 * edits of the 16, so of 2 * edits + 2 groups of counts two agree, and a
line goes under its segment with each pair of groups.  What is left of a bucket's
pairs is dealt over tasks in slices of about WORK comparisons.

Defined cases: null texts have one empty line; a null doc_id is kept whole and
judges nothing; rows that repeat a doc_id and text count as one document, ties
between rows that share a doc_id go by line number; very long texts are cut into
lines like others; bytes that are not UTF-8 are replaced; other columns,
whatever their names, are left out; an empty table gives no rows.
Output: doc_id, n_lines, n_removed, text (kept lines joined by newlines).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import exchange as X
from . import textvec as T

U = np.uint64
BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)
SEEN, FIRST, OPEN, FINER = 0, 1, 2, 3
INDEX, PROBE, MARK, FINE = 1, 2, 4, 8
#: lines of one segment that a task sends plainly, and lines of a bucket that are not dealt finer
LOCAL, CROWD = 100, 2000
#: bytes of text whose lines are cut at once
CHUNK = 1 << 20
#: comparisons of one slice of a bucket, and pairs that one group verifies, about
WORK, PAIRS = 20_000_000, 5000


class Lines:
    """Lines of a chunk of texts as code points, with their hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        at = chars[offs]
        breaks = np.flatnonzero(self.points == 10)
        self.starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([at[1:], breaks]), kind="stable")
        self.ends = ends
        self.offs = np.searchsorted(breaks, at) + np.arange(len(at))
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.offs))
        self.number = np.arange(len(self.starts)) - self.offs[self.doc]
        self.sums, self.inverse = [], []
        for base, salt in zip(T.GRAM_BASES, (1, 2), strict=True):
            n = len(self.points)
            total = np.zeros(n + 1, U)
            np.cumsum(T.mix(self.points.astype(U) + U(salt << 40)) * T.powers(base, n), out=total[1:])
            self.sums.append(total)
            self.inverse.append(T.powers(pow(base, -1, 1 << 64), n + 1))
        self.one, self.two = (self.substring(self.starts, self.ends, k) for k in (0, 1))
        ink = np.concatenate([[0], np.cumsum(~np.isin(self.points, BLANK))])
        self.inked = ink[self.ends] > ink[self.starts]

    def substring(self, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
        return T.mix((self.sums[lane][hi] - self.sums[lane][lo]) * self.inverse[lane][lo] + (hi - lo).astype(U))

    def bags(self, which: np.ndarray) -> np.ndarray:
        """16 four-bit character counts of each line (modulo 16)."""
        size = (self.ends - self.starts)[which]
        line = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[which], size)
        slot = (T.mix(self.points[at].astype(U)) >> U(60)).astype(np.int64)
        count = np.bincount(line * 16 + slot, minlength=16 * len(which)).reshape(-1, 16) & 15
        return (count.astype(U) << (U(4) * np.arange(16, dtype=U))).sum(1, dtype=U)


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the even cut into edits + 1 segments, the longer ones last."""
    k = edits + 1
    short, longer = length // k, length % k
    out, at = [], np.zeros_like(length)
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at = at + size
    return out


def signatures(lines: Lines, which: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, role, place in `which`) of index segments and probing substrings."""
    start, size = lines.starts[which], (lines.ends - lines.starts)[which]
    sig, role, of = [], [], []
    for less in range(edits + 1):
        length = size - less
        for i, (at, seg) in enumerate(segments(length, edits)):
            lo = max(-i, less - (edits - i))
            hi = min(i, less + (edits - i))
            for shift in range(lo, hi + 1):
                ok = np.flatnonzero((at + shift >= 0) & (at + shift + seg <= size) & (length > edits))
                h = lines.substring((start + at + shift)[ok], (start + at + shift + seg)[ok])
                sig.append(T.mix(h + T.mix((length[ok] * (edits + 1) + i).astype(U))))
                role.append(np.full(len(ok), PROBE | (INDEX if less == 0 and shift == 0 else 0), np.uint8))
                of.append(ok)
    return np.concatenate(sig), np.concatenate(role), np.concatenate(of)


def finer(sig: np.ndarray, bag: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(finer signature, place of its row): each segment with two groups of character counts, all pairs of groups."""
    groups = 2 * edits + 2
    masks = [0]
    if groups <= 16:
        part = [sum(0xF << (4 * k) for k in range(g, 16, groups)) for g in range(groups)]
        masks = [x | y for x, y in itertools.combinations(part, 2)]
    out = [T.mix(T.mix(sig + U(k + 1)) ^ T.mix(bag & U(m))) for k, m in enumerate(masks)]
    return np.concatenate(out), np.tile(np.arange(len(sig)), len(masks))


def near(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether character counts allow so few edits: one edit changes two counts by one at most."""
    total = np.zeros(len(a), np.int64)
    for k in range(16):
        d = ((a >> U(4 * k)) - (b >> U(4 * k))).astype(np.int64) & 15
        total += np.minimum(d, 16 - d)
    return total <= 2 * edits


def within(xs: list[str], ys: list[str], edits: int) -> np.ndarray:
    """Which pairs lie within `edits` character edits: bit-parallel along a diagonal band."""
    if not xs:
        return np.zeros(0, bool)
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(xs, ys, strict=True)]
    n1, n2 = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    flat = [np.frombuffer("".join(p[k] for p in pairs).encode("utf-32-le", "surrogatepass"), np.uint32) for k in (0, 1)]
    base = [np.cumsum(n) - n for n in (n1, n2)]
    top, good = 63, n1 - n2 <= edits
    plus = np.full(len(pairs), U(T.MASK) << U(top - edits))
    minus = np.zeros(len(pairs), U)
    dist = np.full(len(pairs), edits)
    flat = [np.append(f, np.uint32(0)) for f in flat]
    for i in range(int(n2.max(initial=0))):
        text = flat[1][np.minimum(base[1] + i, len(flat[1]) - 1)]
        match = np.zeros(len(pairs), U)
        for b in range(2 * edits + 2):
            row = i + edits - b
            if row >= 0:
                same = (row < n1) & (flat[0][np.minimum(base[0] + row, len(flat[0]) - 1)] == text)
                match |= same.astype(U) << U(top - b)
        zero = (((match & plus) + plus) ^ plus) | match | minus
        hplus, hminus = minus | ~(zero | plus), zero & plus
        live = i < n2
        diagonal = i < n1 - edits
        down = (U(1) << (np.clip(top - 1 - (i - (n1 - edits)), 0, top)).astype(U))
        step = np.where(diagonal, (zero >> U(top) & U(1)) == 0, False).astype(np.int64)
        step += np.where(diagonal, 0, ((hplus & down) > 0).astype(np.int64) - ((hminus & down) > 0))
        dist += np.where(live, step, 0)
        plus, minus = hminus | ~((zero >> U(1)) | hplus), (zero >> U(1)) & hplus
    return good & (dist <= edits)


MOVED = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("one", "two", "doc", "line", "sig", "role", "bag", "doc_s", "line_s", "tag_s"))])
FOUND = pa.schema([("kind", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "c", "d", "e", "f", "g"))])
FOUND_SQL = "kind int, block long, " + ", ".join(f"{c} binary" for c in "abcdefg")


def line_dedup(docs: DataFrame, edits: int = 2, shortest: int = 20, broadcast_bytes: int = X.BROADCAST_BYTES, local: int = LOCAL, crowd: int = CROWD, work: int = WORK) -> DataFrame:
    """See the module's text.  One row for each input row."""
    if not 1 <= edits <= 20 or shortest <= 2 * edits:
        raise ValueError("edits must be 1 to 20, and shortest more than twice that")
    docs = X.ensure_text(docs)
    ws, blocks = X.Workspace(docs.sparkSession, "lines", docs), X.blocks_for(docs)
    schema = ", ".join(["block long", *(f"{f.name} binary" for f in list(MOVED)[1:])])
    ws.write("found", X.by_block(docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(X.giving_back(emitter(edits, shortest, blocks, local)), schema), bucketer(edits, blocks, crowd), FOUND_SQL, blocks=blocks), by=("kind",))
    first = ws.read("found", FOUND_SQL)
    fine = first.filter(F.col("kind") == FINER).select("block", *(F.col(x).alias(y) for x, y in zip("abcdef", ROW, strict=True)))
    found = first.filter(F.col("kind") != FINER)
    if not fine.isEmpty():
        ws.write("finer", X.by_block(fine, fine_bucketer(edits, blocks), FOUND_SQL, blocks=blocks), by=("kind",))
        found = found.union(ws.read("finer", FOUND_SQL).select(*found.columns))
    ws.write("links1", verify(ws, docs, unique_pairs(found.filter(F.col("kind") == FIRST), blocks), "v1", edits, broadcast_bytes))
    settled = ws.read("links1").select(F.col("a").alias("node"), F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).distinct()
    rest = open_pairs(ws, found.filter(F.col("kind") == OPEN), settled, edits, blocks, work)
    ws.write("links2", verify(ws, docs, rest, "v2", edits, broadcast_bytes))
    near_lines = ws.read("links1").union(ws.read("links2"))

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(0).to_numpy()
            cols = {"doc": doc, "line": b.column(1).to_numpy().astype(np.int32), "tag": b.column(2).to_numpy().view(U).astype(np.uint32)}
            yield X.pack(A.doc_block(doc, blocks), cols)

    packed = X.binary_schema("doc", "line", "tag")
    gone = near_lines.select("doc_a", "line_a", "a").distinct().mapInArrow(flagged, packed)
    seen = found.filter(F.col("kind") == SEEN).select("block", F.col("a").alias("doc"), F.col("b").alias("line"), F.col("c").alias("tag"))
    ws.write("gone", A.by_document(seen.union(gone), {"line": np.int32, "tag": np.uint32}, blocks))
    ws.drop("found", "finer", "open", "links1", "links2")
    return without_lines(ws, docs, broadcast_bytes)


#: a signature's row on its way to its bucket
ROW = {"sig": U, "role": np.uint8, "one": U, "bag": U, "doc": np.int64, "line": np.int32}


def block_of(sig: np.ndarray, blocks: int) -> np.ndarray:
    return (sig >> U(32)) % U(blocks)


def emitter(edits: int, shortest: int, blocks: int, local: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = X.Met(local)
        for batch in batches:
            for ids, texts in A.rows(batch):
                for lo, _, buf, offs in T.chunks(T.valid(texts), CHUNK):
                    w = Lines(buf, offs)
                    at = np.flatnonzero(w.inked)
                    if not len(at):
                        continue
                    cols = {"one": w.one[at], "two": w.two[at], "doc": ids[lo + w.doc[at]], "line": w.number[at].astype(np.int32)}
                    order, head, later = repeats(cols)  # what repeats in this chunk is settled here
                    gone = {"doc_s": cols["doc"][order][later], "line_s": cols["line"][order][later], "tag_s": cols["one"][order][later].astype(np.uint32)}
                    yield X.padded(X.pack(A.doc_block(gone["doc_s"], blocks), gone), MOVED)
                    sent = order[head == np.arange(len(order))]
                    yield X.padded(X.pack(T.mix(cols["one"][sent]) % U(blocks), {k: v[sent] for k, v in cols.items()}), MOVED)
                    order = np.lexsort((cols["line"], cols["doc"], cols["two"], cols["one"]))
                    new = np.ones(len(order), bool)
                    new[1:] = (cols["one"][order][1:] != cols["one"][order][:-1]) | (cols["two"][order][1:] != cols["two"][order][:-1])
                    first = order[new]
                    which = at[first][(w.ends - w.starts)[at[first]] >= shortest]
                    if len(which):
                        sig, role, of = signatures(w, which, edits)
                        own = {"sig": sig, "role": role, "one": w.one[which][of], "bag": w.bags(which)[of], "doc": ids[lo + w.doc[which]][of], "line": w.number[which].astype(np.int32)[of]}
                        busy = met.often(sig)
                        if busy.any():
                            marks = np.unique(sig[busy])
                            fine = refined({k: v[busy] for k, v in own.items()}, edits)
                            fine["role"] = fine["role"] | np.uint8(FINE)
                            more = {k: np.zeros(len(marks), v.dtype) for k, v in own.items()} | {"sig": marks, "role": np.full(len(marks), MARK, np.uint8)}
                            own = {k: np.concatenate([v[~busy], more[k], fine[k]]) for k, v in own.items()}
                        yield X.padded(X.pack(block_of(own["sig"], blocks), own), MOVED)

    return emit


def refined(c: dict[str, np.ndarray], edits: int) -> dict[str, np.ndarray]:
    """Rows under their finer signatures."""
    sig, of = finer(c["sig"], c["bag"], edits)
    return {k: v[of] for k, v in c.items()} | {"sig": sig}


def repeats(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by line, then place; the first of each line in it; which follow the first at another place)."""
    order = np.lexsort((c["line"], c["doc"], c["two"], c["one"]))
    one, two, doc, line = (c[k][order] for k in ("one", "two", "doc", "line"))
    same = np.zeros(len(order), bool)
    same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    return order, head, same & ((doc != doc[head]) | (line != line[head]))


def bucketer(edits: int, blocks: int, crowd: int):
    """Repeats of the same line; of each bucket what `buckets` gives; rows for finer buckets."""

    def gather(table: pa.Table) -> pa.Table:
        out = []
        plain = table.filter(table.column("two").is_valid())
        c = X.unpack(plain, {"one": U, "two": U, "doc": np.int64, "line": np.int32})
        order, _, later = repeats(c)
        at = order[later]
        add(out, SEEN, A.doc_block(c["doc"][at], blocks), {"a": c["doc"][at], "b": c["line"][at], "c": c["one"][at].astype(np.uint32)})
        c = X.unpack(table, {"doc_s": np.int64, "line_s": np.int32, "tag_s": np.uint32})
        add(out, SEEN, A.doc_block(c["doc_s"], blocks), dict(zip("abc", c.values(), strict=True)))

        c = X.unpack(table.filter(table.column("sig").is_valid()), ROW)
        fine = (c["role"] & FINE) > 0
        known = {k: v[fine] for k, v in c.items()}
        known["role"] = known["role"] & np.uint8(INDEX | PROBE)
        c = several({k: v[~fine] for k, v in c.items()})
        cut, size = X.runs(c["sig"])
        busy = np.repeat((size > crowd) | (np.maximum.reduceat(c["role"] & MARK, cut) > 0), size) if len(cut) else np.zeros(0, bool)
        more = refined({k: v[busy & ((c["role"] & MARK) == 0)] for k, v in c.items()}, edits)
        forth = {k: np.concatenate([known[k], more[k]]) for k in ROW}
        add(out, FINER, block_of(forth["sig"], blocks), dict(zip("abcdef", forth.values(), strict=True)))
        buckets(out, {k: v[~busy] for k, v in c.items()}, edits, blocks)
        return pa.Table.from_batches(out, FOUND)

    return gather


def fine_bucketer(edits: int, blocks: int):
    """What `buckets` gives for the finer buckets."""

    def gather(table: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        buckets(out, several(X.unpack(table, ROW)), edits, blocks)
        return pa.Table.from_batches(out, FOUND)

    return gather


def add(out: list[pa.RecordBatch], kind: int, block: np.ndarray, cols: dict[str, np.ndarray]) -> None:
    if len(block):
        b = X.pack(block, cols)
        out.append(X.padded(b.append_column("kind", pa.array([kind] * b.num_rows, pa.int32())), FOUND))


def buckets(out: list[pa.RecordBatch], c: dict[str, np.ndarray], edits: int, blocks: int) -> None:
    """Pairs with each bucket's earliest line, and the buckets as they are."""
    if not len(c["sig"]):
        return
    order = np.lexsort((c["line"], c["doc"], (c["role"] & INDEX) == 0, c["sig"]))
    c = {k: v[order] for k, v in c.items()}
    cut, size = X.runs(c["sig"])
    hub = np.repeat(cut, size)
    x = np.flatnonzero((hub != np.arange(len(hub))) & ((c["role"][hub] & INDEX) > 0))
    x = x[near(c["bag"][x], c["bag"][hub[x]], edits)]
    add(out, FIRST, *directed(c, x, hub[x], blocks))
    add(out, OPEN, block_of(c["sig"], blocks), dict(zip("abcdef", c.values(), strict=True)))


def several(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of buckets with two distinct lines or more, one of them indexed, or a mark; a line once, at its first place.

    Lines of a bucket are told apart by hash and character counts.
    """
    order = np.argsort(c["sig"])
    cut, size = X.runs(c["sig"][order])
    order = order[np.repeat(size > 1, size)]
    c = {k: v[order] for k, v in c.items()}
    order = np.lexsort((c["line"], c["doc"], -(c["role"].astype(np.int64) & INDEX), c["bag"], c["one"], c["role"] & MARK, c["sig"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("sig", "one", "bag")] + [(c["role"][1:] ^ c["role"][:-1]) & MARK > 0])
    c = {k: v[new] for k, v in c.items()}
    cut, size = X.runs(c["sig"])
    good = (size > 1) & (np.maximum.reduceat(c["role"] & (INDEX | MARK), cut) > 0) if len(cut) else np.zeros(0, bool)
    keep = np.repeat(good, size)
    return {k: v[keep] for k, v in c.items()}


def directed(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, blocks: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(block, later line a and earlier line b with their places), each pair once."""
    swap = (c["doc"][x] < c["doc"][y]) | ((c["doc"][x] == c["doc"][y]) & (c["line"][x] < c["line"][y]))
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    keys = [c[k][v] for v in (x, y) for k in ("one", "doc", "line")]
    order = np.lexsort(keys)
    new = np.ones(len(x), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    x, y = x[order][new], y[order][new]
    return T.mix(c["one"][x]) % U(blocks), {"a": c["one"][x], "b": c["one"][y], "c": c["doc"][x], "d": c["doc"][y], "e": c["line"][x], "f": c["line"][y]}


PAIRS_SQL = "a long, b long, doc_a long, doc_b long, line_a int, line_b int"


def unique_pairs(found: DataFrame, blocks: int) -> DataFrame:
    """Pairs of all blocks, each once."""

    def once(table: pa.Table) -> pa.Table:
        c = X.unpack(table, {"a": U, "b": U, "c": np.int64, "d": np.int64, "e": np.int32, "f": np.int32})
        order = np.lexsort((c["f"], c["d"], c["e"], c["c"], c["b"], c["a"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in c.values()])
        cols = [c[k][new] for k in "abcdef"]
        return pa.table(dict(zip(("a", "b", "doc_a", "doc_b", "line_a", "line_b"), [cols[0].view(np.int64), cols[1].view(np.int64), *cols[2:]], strict=True)))

    return X.by_block(found.select("block", "a", "b", "c", "d", "e", "f"), once, PAIRS_SQL, blocks=blocks)


#: a line's row in an open bucket; mine: whether a slice is to compare it with those before
SLICE = {"sig": np.int64, "role": np.uint8, "node": np.int64, "bag": np.int64, "doc": np.int64, "line": np.int32, "mine": bool}


def open_pairs(ws: X.Workspace, found: DataFrame, settled: DataFrame, edits: int, blocks: int, work: int) -> DataFrame:
    """All pairs of a bucket whose later line is not settled and whose counts allow a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"a": np.int64, "b": np.uint8, "c": np.int64, "d": np.int64, "e": np.int64, "f": np.int32}
        for batch in batches:
            for r in batch.to_pylist():
                cols = {k: np.frombuffer(r[k], v) for k, v in kinds.items()}
                n = len(cols["a"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["block"])), pa.array(cols["a"]), pa.array(cols["b"].astype(np.int32)), *(pa.array(cols[k]) for k in "cdef")], ["place", "sig", "role", "node", "bag", "doc", "line"])

    flat = found.select("block", "a", "b", "c", "d", "e", "f").mapInArrow(rows, "place long, sig long, role int, node long, bag long, doc long, line int")
    flat = flat.join(settled.withColumn("done", F.lit(True)), ["node", "doc", "line"], "left").select("place", "sig", "role", "node", "bag", "doc", "line", F.coalesce("done", F.lit(False)).alias("done"))
    names = (*"abcdef", *SLICE)

    def compared(c: dict[str, np.ndarray], x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Pairs of the rows x with all before them in their bucket."""
        c["one"], bag = c["node"].view(U), np.ascontiguousarray(c["bag"]).view(U)
        many = x - head[x]
        out, lo, done = [], 0, np.cumsum(many)
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 2_000_000, "right")))
            n = many[lo:hi]
            a = np.repeat(x[lo:hi], n)
            b = np.repeat(head[x[lo:hi]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            ok = np.flatnonzero((c["role"][a] | c["role"][b]) & INDEX > 0)
            ok = ok[near(bag[a[ok]], bag[b[ok]], edits)]
            out.append((a[ok], b[ok]))
            lo = hi
        a, b = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return directed(c, a, b, blocks)

    def pairs(table: pa.Table) -> pa.Table:
        c = {k: table.column(k).to_numpy() for k in ("sig", "role", "node", "bag", "doc", "line", "done")}
        order = np.lexsort((c["line"], c["doc"], c["sig"]))
        c = {k: v[order] for k, v in c.items()}
        cut, size = X.runs(c["sig"])
        head = np.repeat(cut, size)
        todo = np.where(c["done"], 0, np.arange(len(head)) - head)
        total = np.add.reduceat(todo, cut) if len(cut) else todo
        large = total > work
        block, cols = compared(c, np.flatnonzero((todo > 0) & ~np.repeat(large, size)), head)
        out = [X.padded(X.pack(block, cols), X.block_schema(*names))]
        for k in np.flatnonzero(large):  # a bucket in slices of its later lines, each with all lines before
            own = todo[cut[k] : cut[k] + size[k]]
            number = (np.cumsum(own) - own) // work
            for t in np.unique(number[own > 0]):
                mine = (number == t) & (own > 0)
                at = np.arange(cut[k], cut[k] + int(np.flatnonzero(mine)[-1]) + 1)
                own_sig = T.mix(c["sig"][at].view(U) + U(int(t) + 1))
                part = {k_: c[k_][at].astype(v) for k_, v in SLICE.items() if k_ not in ("sig", "mine")}
                part = {"sig": own_sig.view(np.int64)} | part | {"mine": mine[: len(at)]}
                out.append(X.padded(X.pack(block_of(own_sig, blocks), part), X.block_schema(*names)))
        return pa.Table.from_batches(out)

    def slices(table: pa.Table) -> pa.Table:
        c = X.unpack(table, SLICE)
        order = np.lexsort((c["line"], c["doc"], c["sig"]))
        c = {k: v[order] for k, v in c.items()}
        cut, size = X.runs(c["sig"])
        block, cols = compared(c, np.flatnonzero(c["mine"]), np.repeat(cut, size))
        return pa.Table.from_batches([X.padded(X.pack(block, cols), X.block_schema(*"abcdef"))])

    both = ws.write("open", X.by_block(flat, pairs, X.binary_schema(*names), key="place", blocks=blocks))
    packed = ["block", *"abcdef"]
    done = both.filter("sig IS NULL").select(*packed)
    if not (sliced := both.filter("sig IS NOT NULL").select("block", *SLICE)).isEmpty():
        done = done.union(X.by_block(sliced, slices, X.binary_schema(*"abcdef"), blocks=blocks).select(*packed))
    return unique_pairs(done, blocks)


def verify(ws: X.Workspace, docs: DataFrame, pairs: DataFrame, name: str, edits: int, bound: int) -> DataFrame:
    """Pairs within the edits; a group gets some pairs and the lines they name.

    Pairs are grouped by their earlier line; a line of more than PAIRS goes to as many groups as that takes.
    """
    pairs = ws.write(f"{name}-pairs", pairs)
    groups = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS)
    ws.write(f"{name}-hubs", pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS))
    spread = F.pmod(F.xxhash64("a"), F.coalesce(1 + F.expr(f"n div {PAIRS}"), F.lit(1)))
    pairs = X.attach(ws, pairs, f"{name}-hubs", "b", "left", bound).withColumn("grp", F.pmod(F.xxhash64("b", spread), F.lit(groups))).select(*pairs.columns, "grp")
    side = lambda k: pairs.select("grp", F.col(f"doc_{k}").alias("doc_id"), F.col(f"line_{k}").alias("line"), F.col(k).alias("node"))
    need = side("a").union(side("b")).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("grp", "line", "node")).alias("want"))
    ws.write(f"{name}-need", need)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grps, nodes, numbers, docs_, texts = [], [], [], [], []
            for doc, text, want in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = text.decode("utf-8", "replace").split("\n") if text else [""]
                for w in want:
                    if w["line"] < len(lines):
                        grps.append(w["grp"]), nodes.append(w["node"]), numbers.append(w["line"]), docs_.append(doc), texts.append(lines[w["line"]])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in (grps, nodes, docs_, numbers)), pa.array(texts, pa.string())], ["own", "node", "doc", "number", "line"])

    texts = X.attach(ws, docs, f"{name}-need", bound=bound).select("doc_id", F.col("text").cast("binary"), "want").mapInArrow(X.giving_back(cut), "own long, node long, doc long, number long, line string")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        # a repeated doc_id can bring a line of another text: its hash tells
        text: dict[tuple[int, int, int], str] = {}
        for *key, line in zip(*(left.column(c).to_pylist() for c in ("node", "doc", "number", "line")), strict=True):
            if tuple(key) not in text or _hash(line) == key[0]:
                text[tuple(key)] = line
        xs, ys = ([text[k] for k in zip(*(right.column(c).to_pylist() for c in (v, f"doc_{v}", f"line_{v}")), strict=True)] for v in "ab")
        good = np.zeros(len(xs), bool)
        order = np.argsort([len(x) for x in xs], kind="stable")
        for k in range(0, len(order), 4096):
            at = order[k : k + 4096]
            good[at] = within([xs[i] for i in at], [ys[i] for i in at], edits)
        return right.select(["a", "b", "doc_a", "line_a"]).filter(pa.array(good))

    return texts.groupBy("own").cogroup(pairs.groupBy("grp")).applyInArrow(X.both(check), "a long, b long, doc_a long, line_a int")


def _hash(line: str) -> int:
    raw = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8)
    return int(Lines(raw, np.array([0, len(raw)])).one.view(np.int64)[0])


def without_lines(ws: X.Workspace, docs: DataFrame, bound: int) -> DataFrame:
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, row = A.listed(batch.column(2), np.int32)
            tag, _ = A.listed(batch.column(3), np.uint32)
            for lo, hi, buf, offs in T.chunks(T.valid(batch.column(1)), CHUNK):
                i, j = np.searchsorted(row, [lo, hi])
                breaks = np.searchsorted(np.flatnonzero(buf == 10), offs)
                count = np.diff(breaks) + 1
                lost = np.zeros(hi - lo, np.int64)
                texts = [buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8") for k in range(hi - lo)]
                if j > i:
                    w = Lines(buf, offs)
                    doc = row[i:j] - lo
                    inside = line[i:j] < np.diff(w.offs)[doc]
                    at = (w.offs[doc] + line[i:j])[inside]
                    at = np.unique(at[w.one[at].astype(np.uint32) == tag[i:j][inside]])
                    gone = np.zeros(len(w.one), bool)
                    gone[at] = True
                    for d in np.unique(w.doc[at]).tolist():
                        own = gone[w.offs[d] : w.offs[d + 1]]
                        lost[d] = own.sum()
                        texts[d] = "\n".join(x for x, g in zip(texts[d].split("\n"), own.tolist(), strict=True) if not g)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.array(lost), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    joined = X.attach(ws, docs, "gone", how="left", bound=bound).select("doc_id", F.col("text").cast("binary"), "line", "tag")
    return joined.mapInArrow(X.giving_back(drop), "doc_id long, n_lines long, n_removed long, text string")


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
