"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

A document's set holds the hashes of its distinct n-word shingles.  Sets fall
into size bands; a band's universe is dealt by hash into segments, one more
than the largest symmetric difference that a linked pair can have there (plus
a slack for segments that are empty on both sides), so linked sets agree on
all of a segment somewhere.  A segment can instead be indexed with its
one-deletion neighbourhood, which absorbs two differences; `allocation` picks
the cheaper mix for each band from the corpus size.  A set is indexed in its
own band and probes the one band below that linked smaller sets can be in.

Identical sets are one node throughout.  Work then goes in three steps, none
of which forms all pairs of a group:

1. each node is checked against a few hubs of its buckets, those that it shares
   the most buckets with, and verified links are merged into components;
2. while buckets hold many pairs across components, nodes of a bucket's smaller
   components are checked against other hubs in its largest component;
3. every pair that still lies across components, and shares as many segments as
   a link of such sizes must, is verified, so no link between components is
   lost, whenever the rounds before ended; components are labelled by the
   smallest doc_id.

A bucket of over CROWD nodes that are still apart, as dissimilar texts with one
passage in common make, is divided before step 3: a link of its band differs in
so many members at most, and so do the sets' parity sketches in bits, so of one
group of bits more one agrees, and nodes meet under the signature with a group's
bits.  What stays crowded is compared in slices, each with the whole bucket.

Sets are named by 64 bits and checked by 64 more.  Where two sets have one name
(rare below 10**9 sets), the first pass is made again with the second value in
these names, so no class is merged or lost.  Verification counts intersections
of whole 64-bit shingle sets; its groups hold about PAIRS_EACH pairs, and a hub
of more is spread over as many groups as that takes.

Defined cases: null text or no words: the empty set, linked with nothing;
fewer words than a shingle: the whole sequence is the one shingle; a null
doc_id links with nothing and gets a null component; rows that repeat a doc_id
each get a row, and count as one node of all their sets; very long texts are one
set each; an empty table gives no rows; other columns, whatever their names, are
left out.  Output: doc_id, n_shingles, component_id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textvec as T

U = np.uint64
#: chance that a shingle of one text also stands in an unrelated one, for the cost of a bucket
COMMON = 0.02
#: pairs that one group verifies, about
PAIRS_EACH = 500
#: nodes of an open bucket that are compared as they are, and groups of sketch bits that a bucket is divided by, at most
CROWD, GROUPS = 2000, 64
#: what a pair of a divided bucket counts for: as many shared segments as any link needs
ENOUGH = 1 << 20
#: hubs of a bucket, partners that a node is checked against in a round, and rounds at most
HUBS, PARTNERS, ROUNDS = 3, 2, 2
#: 64-bit words of a parity sketch
SKETCH = 32


class Bands:
    """Size bands, and for each band how its universe is divided."""

    def __init__(self, num: int, den: int, population: int):
        self.num, self.den = num, den
        tops = [1]
        while tops[-1] < 1 << 31:
            tops.append(max(tops[-1] + 1, tops[-1] * den // num))
        self.tops = np.array(tops)
        plans = [self.allocation(int(u), population) for u in tops]
        self.most = np.array([(den - num) * (u + u * den // num) // (den + num) for u in tops])
        self.exact, self.double, self.slack = (np.array(x) for x in zip(*plans, strict=True))
        self.segments = self.exact + self.double

    def allocation(self, top: int, population: int) -> tuple[int, int, int]:
        """(exact segments, segments with deletions, empty segments to ignore) of the least cost."""
        most = (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)
        best = (math.inf, 1, 0, 0)
        for double in {0, 1, (most + 2) // 2}:
            exact = max(0, most + 1 - 2 * double)
            slack = 0
            if not double and exact >= 8:
                bare = exact * math.exp(-top / exact)
                slack = math.ceil(bare + 2 * math.sqrt(bare))
            count = exact + slack + double
            if not count or 2 * (double - 1) >= most + 1:
                continue
            each = top / count
            mates = population * COMMON ** max(1.0, each)
            nearly = population * COMMON ** max(1.0, each - 1)
            bare = math.exp(-each)
            mates += 0 if slack else bare * bare * population
            nearly += bare * bare * population
            cost = (exact + slack) * (1 + mates) + double * (1 + each) * (1 + nearly)
            best = min(best, (cost, exact + slack, double, slack))
        return best[1:]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)

    def probes_below(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        least = -(-sizes * self.num // self.den)
        return (band > 0) & (least <= self.tops[np.maximum(band - 1, 0)])

    def with_most(self):
        """Adds to each node its band's largest difference; -1 where deletions are indexed too."""
        tops, most, double = self.tops, self.most, self.double

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                band = np.searchsorted(tops, b.column(2).to_numpy())
                yield b.append_column("most", pa.array(np.where(double[band] == 0, most[band], -1)))

        return add

    @staticmethod
    def _sizes(num: int, den: int) -> Column:
        return (F.col("size_a") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size_a") * num)

    def near(self) -> Column:
        """Whether sizes allow a link."""
        return self._sizes(self.num, self.den)

    def may_link(self) -> Column:
        """Whether sizes and the number of shared segments allow a link.

        Two sets that differ in d places agree on all but d of a band's
        segments, so a pair must share that many signatures less the empty
        segments that neither shows.
        """
        a, b = F.col("size_a"), F.col("size_b")
        most = F.when(a <= b, F.col("most_a")).otherwise(F.col("most_b"))
        differ = F.floor((self.den - self.num) * (a + b) / (self.den + self.num) + F.lit(1e-9))
        return self.near() & ((most < 0) | (F.col("shared") > most - differ))

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, end to end, and their offsets."""
    w = T.words(buf, offs, T.SPACED_LOWER)
    h, count = w.hashes[0], w.counts
    vals, doc = T.grams(h, n), w.docs()
    ok = T.inside(w.offs, n)
    vals, doc = vals[ok], doc[: len(ok)][ok]
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        short = np.array([T.grams(h[w.offs[d] : w.offs[d + 1]], int(count[d]))[0] + U(count[d]) for d in few], U)
        doc = np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        vals, doc = T.mix(np.concatenate([vals, short]))[order], doc[order]
    else:
        vals = T.mix(vals)
    at = np.searchsorted(doc, np.arange(len(count) + 1))
    for i in range(len(count)):
        vals[at[i] : at[i + 1]].sort()
    new = np.ones(len(vals), bool)
    new[1:] = (vals[1:] != vals[:-1]) | (doc[1:] != doc[:-1])
    return vals[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(count)))])


def fingerprints(vals: np.ndarray, at: np.ndarray, apart: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A name (of so many bits) and an independent check of each set; 0 for the empty set.

    Sets whose names are in `apart` are named by both values.
    """
    out = []
    for salt in (U(0x9AE16A3B2F90404F), U(0xC3A5C85C97CB3127)):
        total = np.concatenate([np.zeros(1, U), np.cumsum(T.mix(vals ^ salt))])
        got = T.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U))
        out.append(np.where(np.diff(at) > 0, got | U(1), U(0)))
    name, check = out
    name = name & U((1 << bits) - 1)
    if apart is not None and len(apart):
        twice = (name > 0) & (apart[np.minimum(np.searchsorted(apart, name), len(apart) - 1)] == name)
        name = np.where(twice, T.mix(name ^ T.mix(check)) | U(1), name)
    return name, check


def sketches(vals: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bitmaps of sets; two of them differ in no more bits than the sets in members."""
    n, bits = len(at) - 1, 64 * SKETCH
    place = np.repeat(np.arange(n), np.diff(at)) * bits + (T.mix(vals ^ U(0xA0761D6478BD642F)) % U(bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(U).reshape(n, SKETCH)


def divided(sig: np.ndarray, size: np.ndarray, sketch: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(finer signature, place of its row) of rows of crowded buckets, by groups of their sketches' bits.

    A pair meets in the smaller set's band: the larger one's own, or the one below that.
    """
    rng = T.splitmix(31, 64 * SKETCH)
    band = bands.of(size)
    out_sig, out_row = [], []
    for less in (0, 1):
        rows = np.flatnonzero(bands.probes_below(size, band)) if less else np.arange(len(sig))
        parts = np.minimum(bands.most[band[rows] - less] + 1, GROUPS + 1)
        for g in np.unique(parts):
            same = rows[parts == g]
            for k in range(0, len(same), 2000):
                at = same[k : k + 2000]
                tag = T.mix(sig[at] + (band[at] - less).astype(U) * U(0x9E3779B97F4A7C15))[:, None]
                if g > GROUPS:  # too many places differ for bits to tell
                    out_sig.append(tag[:, 0]), out_row.append(at)
                    continue
                bits = np.unpackbits(sketch[at].view(np.uint8), axis=1)
                value = np.zeros((len(at), -(-bits.shape[1] // g) * g), U)
                value[:, : bits.shape[1]] = np.where(bits > 0, rng, U(0))
                total = value.reshape(len(at), -1, g).sum(1, dtype=U)
                out_sig.append(T.mix(tag + T.mix(total + np.arange(1, g + 1, dtype=U))).ravel())
                out_row.append(np.repeat(at, g))
    return np.concatenate([np.zeros(0, U), *out_sig]), np.concatenate([np.zeros(0, np.int64), *out_row])


def signatures(vals: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of all segment subsets that the sets index or probe."""
    size = np.diff(at)
    own = bands.of(size)
    out_sig, out_set = [], []
    lo, hi = (vals & U(0xFFFFFFFF)).astype(np.float64), (vals >> U(32)).astype(np.float64)
    of = np.repeat(np.arange(len(size)), size)
    for shift, take in ((0, size > 0), (1, bands.probes_below(size, own) & (size > 0))):
        band = np.maximum(own - shift, 0)
        pick = take[of]
        if not pick.any():
            continue
        m = np.where(take, bands.segments[band], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        v, s = vals[pick], of[pick]
        b = band[s]
        seg = ((T.mix(v + b.astype(U)) >> U(33)) % m[s].astype(U)).astype(np.int64)
        key = base[s] + seg
        low, high = np.bincount(key, lo[pick], base[-1]), np.bincount(key, hi[pick], base[-1])
        count = np.bincount(key, minlength=base[-1])
        owner = np.repeat(np.arange(len(size)), m)
        place = np.arange(base[-1]) - base[owner]
        tag = (band[owner].astype(U) << U(40)) + place.astype(U)
        bare = np.bincount(owner[count == 0], minlength=len(size))
        plain = bands.double[band] == 0
        shown = (count > 0) | (~plain | (bare > bands.slack[band]))[owner]
        out_sig.append(sealed(low, high, tag)[shown])
        out_set.append(owner[shown])
        dropped = seg < bands.double[b]
        if dropped.any():
            k = key[dropped]
            out_sig.append(sealed(low[k] - lo[pick][dropped], high[k] - hi[pick][dropped], tag[k]))
            out_set.append(s[dropped])
    if not out_sig:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def sealed(low: np.ndarray, high: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return T.mix(T.mix(low.astype(U) + T.mix(high.astype(U))) + tag)


def pack_nodes(block: np.ndarray, sig: np.ndarray, of: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Like exchange.pack, with nodes as 16-bit places in a short table of the row's own."""
    order = np.argsort(block, kind="stable")
    b, sig, of = block[order], sig[order], of[order]
    cut, size = X.runs(b)
    cols = [[], [], []]
    for i, n in zip(cut, size, strict=True):
        own = of[i : i + n]
        there = np.flatnonzero(np.bincount(own))
        place = np.zeros(int(own.max()) + 1, np.uint16)
        place[there] = np.arange(len(there))
        for c, x in zip(cols, (sig[i : i + n], place[own], nodes[there]), strict=True):
            c.append(x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int64)), *(pa.array(c, pa.binary()) for c in cols)], ["block", "sig", "place", "node"])


def unpack_nodes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sigs, nodes = [np.zeros(0, U)], [np.zeros(0, U)]
    for s, p, n in zip(*(table.column(c).to_pylist() for c in ("sig", "place", "node")), strict=True):
        if s:
            sigs.append(np.frombuffer(s, U))
            nodes.append(np.frombuffer(n, U)[np.frombuffer(p, np.uint16)])
    return np.concatenate(sigs), np.concatenate(nodes)


MOVED = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("sig", "place", "node", "doc", "size", "fp", "check", "sketch", "own", "own_size", "own_fp"))])
FOUND = pa.schema([("kind", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "c", "d", "e"))])
MOVED_SQL = X.binary_schema(*MOVED.names[1:])
FOUND_SQL = "kind int, block long, a binary, b binary, c binary, d binary, e binary"
SETS, STARS, BUCKETS, OWN = 0, 1, 2, 3


def jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, broadcast_bytes: int = X.BROADCAST_BYTES, crowd: int = CROWD, name_bits: int = 64) -> DataFrame:
    """Classes of documents whose shingle sets have Jaccard similarity num/den or more."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be in (0, 1]")
    docs = X.ensure_text(docs)
    spark = docs.sparkSession
    ws, blocks = X.Workspace(spark, "jaccard", docs), X.blocks_for(docs)
    bands, apart = Bands(num, den, docs.count()), np.zeros(0, U)
    while True:
        name = functools.partial(fingerprints, apart=apart, bits=name_bits)
        found = X.by_block(docs.mapInArrow(X.giving_back(emitter(n, bands, blocks, name)), MOVED_SQL), bucketer(blocks), FOUND_SQL, blocks=blocks)
        ws.write("found", found, by=("kind",))
        sets = ws.write("sets", set_rows(ws, blocks))
        twice = sets.filter("clash").select("fp").distinct().toArrow()  # of n sets about n * n / 2**65 names
        if not twice.num_rows:
            break
        apart = np.unique(np.concatenate([apart, twice.column("fp").to_numpy().view(U)]))
    ws.write("sketches", sets.filter("sketch IS NOT NULL AND fp <> 0").select("fp", F.col("n_shingles").alias("size"), "sketch"))
    nodes = sets.filter("sketch IS NOT NULL AND fp <> 0").select("fp", "rep", F.col("n_shingles").alias("size"))
    nodes = ws.write("nodes", nodes.mapInArrow(bands.with_most(), "fp long, rep long, size long, most long"))
    links, node_labels = None, nodes.withColumn("component", F.col("rep"))

    def settle(pairs: DataFrame, step: str) -> int:
        """Verify pairs, and label anew; how many links were new."""
        nonlocal links, node_labels
        new = ws.write(f"{step}-links", verify(ws, docs, pairs, step, n, bands, broadcast_bytes, name))
        count = new.count()
        if count:
            links = new if links is None else links.union(new)
            labels = X.components(ws, step, links.select("a", "b")).withColumnRenamed("node", "rep")
            node_labels = ws.write(f"{step}-labels", nodes.join(labels, "rep", "left").select("fp", "rep", "size", "most", F.coalesce("component", "rep").alias("component")))
        return count

    settle(named(best_stars(of_kind(ws, STARS).select("block", "a", "b", "c"), blocks), nodes).filter(bands.near()), "star0")
    for k in range(1, ROUNDS + 1):  # these rounds only save comparisons: the step after them is exact
        rows = open_buckets(ws, node_labels, blocks, f"open{k}")  # the last serves the exact step
        if k == ROUNDS or cross_count(rows) <= 2 * rows.count():
            break
        if settle(named(star_round(rows, blocks, k), nodes).filter(bands.near()), f"star{k}") < 100:
            break
    rows = uncrowded(ws, rows, bands, blocks, crowd, broadcast_bytes)
    settle(named(cross_pairs(rows, ws.read("sketches"), bands, blocks), nodes).filter(bands.may_link()), "across")
    rows = ws.write("rows", of_kind(ws, OWN).select("a", "b", "c").mapInArrow(own_rows, "doc_id long, n_shingles long, fp long"))
    out = rows.join(node_labels.select("fp", "component"), "fp", "left")
    ws.drop("found", "sketches", "sets", "crowded", *(f"open{k}" for k in range(1, ROUNDS + 1)))
    known = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return known.union(nameless(docs, n))


def emitter(n: int, bands: Bands, blocks: int, name: Callable):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(0).is_valid()) if whole.column(0).null_count else whole
            for k in range(0, whole.num_rows, 50_000):
                batch = whole.slice(k, 50_000)
                ids = batch.column(0).to_numpy()
                sigs, owners, fps, checks, sizes, marks = [], [], [], [], [], []
                seen: set[int] = set()
                for lo, _, buf, offs in T.chunks(batch.column(1)):
                    vals, at = shingle_sets(buf, offs, n)
                    fp, check = name(vals, at)
                    size = np.diff(at)
                    marks.extend(sketches(vals[at[k] : at[m]], at[k : m + 1] - at[k]) for k in range(0, len(size), 256) for m in [min(len(size), k + 256)])
                    new = np.zeros(len(size), bool)
                    for i, f in enumerate(fp.tolist()):
                        if f and f not in seen:
                            seen.add(f)
                            new[i] = True
                    if not new.all():
                        vals, at = vals[np.repeat(new, size)], np.concatenate([[0], np.cumsum(np.where(new, size, 0))])
                    sig, of = signatures(vals, at, bands)
                    sigs.append(sig), owners.append(lo + of), fps.append(fp), checks.append(check), sizes.append(size)
                fp, sig, of = np.concatenate(fps), np.concatenate(sigs), np.concatenate(owners)
                if len(sig):
                    yield X.padded(pack_nodes((sig >> U(32)) % U(blocks), sig, of, fp), MOVED)
                size, check = np.concatenate(sizes).astype(np.int64), np.concatenate(checks)
                yield X.padded(X.pack(T.mix(ids.astype(U)) % U(blocks), {"own": ids, "own_size": size, "own_fp": fp}), MOVED)
                order = np.lexsort((ids, check, fp))  # of copies, one goes on
                lead = order[np.concatenate([[True], (fp[order][1:] != fp[order][:-1]) | (check[order][1:] != check[order][:-1])])[: len(order)]]
                yield X.padded(X.pack(T.mix(fp[lead]) % U(blocks), {"doc": ids[lead], "size": size[lead], "fp": fp[lead], "check": check[lead], "sketch": np.concatenate(marks)[lead]}), MOVED)

    return emit


def bucketer(blocks: int):
    """Of each block: the documents and the sets it was sent, star pairs with counts, and buckets of two nodes or more."""

    def gather(table: pa.Table) -> pa.Table:
        out = []

        def add(kind: int, block: np.ndarray, cols: dict[str, np.ndarray]) -> None:
            if len(block):
                b = X.pack(block, cols)
                out.append(X.padded(b.append_column("kind", pa.array([kind] * b.num_rows, pa.int32())), FOUND))

        info = X.unpack(table, {"doc": np.int64, "size": np.int64, "fp": U, "check": U, "sketch": U})
        info["sketch"] = info["sketch"].reshape(-1, SKETCH)
        add(SETS, T.mix(info["fp"]) % U(blocks), dict(zip("abcde", info.values(), strict=True)))
        own = X.unpack(table, {"own": np.int64, "own_size": np.int64, "own_fp": U})
        add(OWN, np.zeros(len(own["own"]), U), dict(zip("abc", own.values(), strict=True)))
        sig, node = unpack_nodes(table)
        order = np.argsort(sig)
        cut, size = X.runs(sig[order])
        keep = order[np.repeat(size > 1, size)]
        sig, node = sig[keep], node[keep]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        cut, size = X.runs(sig)
        many = np.repeat(size > 1, size)
        sig, node = sig[many], node[many]
        if len(sig):
            _, which, degree = np.unique(node, return_inverse=True, return_counts=True)
            add(STARS, *stars(sig, node, np.zeros(len(sig), bool), -degree[which], blocks))
            add(BUCKETS, (sig >> U(32)) % U(blocks), {"a": sig, "b": node})
        return pa.Table.from_batches(out, FOUND)

    return gather


def stars(sig: np.ndarray, node: np.ndarray, never: np.ndarray, order: np.ndarray, blocks: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(block, pairs with counts) of a bucket's other nodes and its first HUBS by `order`.

    Rows come sorted by sig.  Nodes marked `never` are hubs only; if there are
    any in a bucket, its hubs are of them.
    """
    cut, size = X.runs(sig)
    run = np.repeat(np.arange(len(cut)), size)
    ranked = np.lexsort((node, order, ~never, run))
    pairs = []
    for k in range(HUBS):
        has = size > k
        hub = np.zeros(len(cut), np.int64)
        hub[has] = ranked[cut[has] + k]
        mixed = np.zeros(len(cut), bool)
        np.logical_or.at(mixed, run, never)
        has &= never[hub] | ~mixed
        far = has[run] & (node != node[hub[run]]) & ~never
        pairs.append(np.stack([node[far], node[hub[run[far]]]], 1))
    pair, count = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    return T.mix(pair[:, 0]) % U(blocks), {"a": pair[:, 0], "b": pair[:, 1], "c": count.astype(np.int64)}


def of_kind(ws: X.Workspace, kind: int) -> DataFrame:
    return ws.read("found", FOUND_SQL).filter(F.col("kind") == kind)


def set_rows(ws: X.Workspace, blocks: int) -> DataFrame:
    """n_shingles, fp and the class's smallest doc_id for every set, once for each batch that holds it."""

    def name(table: pa.Table) -> pa.Table:
        c = X.unpack(table, {"a": np.int64, "b": np.int64, "c": U, "d": U, "e": U})
        c["e"] = c["e"].reshape(-1, SKETCH)
        order = np.lexsort((c["a"], c["c"]))
        c = {k: v[order] for k, v in c.items()}
        cut, size = X.runs(c["c"])
        rep, first = np.repeat(c["a"][cut], size), np.repeat(c["d"][cut], size)
        lead = np.zeros(len(rep), bool)
        lead[cut] = True
        sketch = pa.array([x.tobytes() if k else None for k, x in zip(lead.tolist(), c["e"], strict=True)], pa.binary())
        return pa.table({"doc_id": c["a"], "n_shingles": c["b"], "fp": c["c"].view(np.int64), "rep": rep, "clash": first != c["d"], "sketch": sketch})

    return X.by_block(of_kind(ws, SETS), name, "doc_id long, n_shingles long, fp long, rep long, clash boolean, sketch binary", blocks=blocks)


def own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles and fp for every document."""
    for batch in batches:
        c = X.unpack(pa.Table.from_batches([batch]), {"a": np.int64, "b": np.int64, "c": np.int64})
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in c.values()], ["doc_id", "n_shingles", "fp"])


def best_stars(found: DataFrame, blocks: int) -> DataFrame:
    """Each node with the PARTNERS hubs that it shares the most buckets with."""

    def best(table: pa.Table) -> pa.Table:
        c = X.unpack(table, {"a": U, "b": U, "c": np.int64})
        order = np.lexsort((c["b"], c["a"]))
        a, b, n = c["a"][order], c["b"][order], c["c"][order]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, cut) if len(cut) else n
        a, b = a[cut], b[cut]
        order = np.lexsort((b, -total, a))
        a, b = a[order], b[order]
        head, size = X.runs(a)
        top = np.arange(len(a)) - np.repeat(head, size) < PARTNERS
        return pa.table({"fa": a[top].view(np.int64), "fb": b[top].view(np.int64)})

    return X.by_block(found, best, "fa long, fb long", blocks=blocks)


def named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of set fingerprints with each set's document and size."""
    a = nodes.select(F.col("fp").alias("fa"), F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("most").alias("most_a"))
    b = nodes.select(F.col("fp").alias("fb"), F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("most").alias("most_b"))
    return pairs.join(a, "fa").join(b, "fb")


def open_buckets(ws: X.Workspace, labels: DataFrame, blocks: int, name: str) -> DataFrame:
    """(block, sig, fp, component) of buckets whose nodes lie in two components or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["sig", "fp"])

    labelled = of_kind(ws, BUCKETS).select("a", "b").mapInArrow(rows, "sig long, fp long").join(labels.select("fp", "component"), "fp")

    def mixed(table: pa.Table) -> pa.Table:
        sig, comp = (table.column(c).to_numpy() for c in ("sig", "component"))
        order = np.argsort(sig, kind="stable")
        cut, size = X.runs(sig[order])
        if not len(cut):
            return table
        lo, hi = np.minimum.reduceat(comp[order], cut), np.maximum.reduceat(comp[order], cut)
        return table.take(pa.array(order[np.repeat(lo < hi, size)]))

    block = F.pmod(F.shiftright("sig", 20), F.lit(blocks)).alias("block")
    return ws.write(name, X.by_block(labelled.select(block, "sig", "fp", "component"), mixed, "block long, sig long, fp long, component long", blocks=blocks))


def uncrowded(ws: X.Workspace, rows: DataFrame, bands: Bands, blocks: int, crowd: int, bound: int) -> DataFrame:
    """The open buckets' rows with `weight` and `mine`; crowded buckets divided, and what stays crowded in slices."""
    block = F.pmod(F.shiftright("sig", 20), F.lit(blocks)).alias("block")
    plain = [F.lit(1).cast("long").alias("weight"), F.lit(True).alias("mine")]
    ws.write("crowds", rows.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("sig"))  # a row for over `crowd` rows
    if ws.read("crowds").isEmpty():
        return rows.select("block", "sig", "fp", "component", *plain)

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                sig, size = batch.column(0).to_numpy().view(U), batch.column(3).to_numpy()
                sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), U).reshape(-1, SKETCH)
                finer, of = divided(sig, size, sketch, bands)
                yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), *(batch.column(c).take(pa.array(of)) for c in (1, 2))], ["sig", "fp", "component"])

    crowded = X.attach(ws, rows, "crowds", "sig", "leftsemi", bound).select("sig", "fp", "component").join(ws.read("sketches"), "fp")
    fine = ws.write("crowded", crowded.select("sig", "fp", "component", "size", "sketch").mapInArrow(divide, "sig long, fp long, component long"))
    open_ = fine.groupBy("sig").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    fine = fine.join(open_.select("sig", F.expr(f"CAST((n + {crowd} - 1) div {crowd} AS int)").alias("slices")), "sig")
    fine = fine.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    mine = (F.pmod(F.xxhash64("fp"), F.col("slices")) == F.col("slice")).alias("mine")
    fine = fine.select(F.xxhash64("sig", "slice").alias("sig"), "fp", "component", F.lit(ENOUGH).cast("long").alias("weight"), mine)
    small = X.attach(ws, rows, "crowds", "sig", "leftanti", bound).select("block", "sig", "fp", "component", *plain)
    return small.union(fine.select(block, "sig", "fp", "component", "weight", "mine"))


def ordered(table: pa.Table) -> tuple[np.ndarray, ...]:
    """sig, node and component of a block's rows, by sig and component, and their order."""
    sig, node, comp = (table.column(c).to_numpy() for c in ("sig", "fp", "component"))
    order = np.lexsort((node, comp, sig))
    return sig[order].view(U), node[order].view(U), comp[order], order


def component_runs(sig: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each component within each bucket."""
    head = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (comp[1:] != comp[:-1])])) if len(sig) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(sig)))


def cross_count(rows: DataFrame) -> int:
    """How many pairs the open buckets hold across components, with repetition."""
    each = rows.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("p"))
    return int(each.agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]) // 2


def star_round(rows: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Star pairs of every open bucket: nodes of its smaller components with some of its largest."""

    def spread(table: pa.Table) -> pa.Table:
        sig, node, comp, _ = ordered(table)
        head, size = component_runs(sig, comp)
        by_size = np.lexsort((head, -size, sig[head]))
        largest, _ = X.runs(sig[head][by_size])
        main = np.zeros(len(head), bool)
        main[by_size[largest]] = True
        block, cols = stars(sig, node, np.repeat(main, size), T.mix(node + U(seed)), blocks)
        return pa.Table.from_batches([X.pack(block, cols)])

    return best_stars(X.by_block(rows, spread, X.binary_schema("a", "b", "c"), blocks=blocks), blocks)


def cross_pairs(rows: DataFrame, marks: DataFrame, bands: Bands, blocks: int) -> DataFrame:
    """All pairs across components of a bucket that may link, with the number of buckets they share.

    A pair whose sketches differ in more places than linked sets of such sizes
    can is left out before it is written anywhere.
    """
    num, den = bands.num, bands.den

    def possible(a: np.ndarray, b: np.ndarray, known: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> np.ndarray:
        x, y = np.searchsorted(known, a), np.searchsorted(known, b)
        n, m = size[x], size[y]
        good = np.flatnonzero((n * den >= m * num) & (m * den >= n * num))
        keep = np.zeros(len(a), bool)
        for k in range(0, len(good), 50_000):
            g = good[k : k + 50_000]
            apart = np.bitwise_count(sketch[x[g]] ^ sketch[y[g]]).sum(1, dtype=np.int64)
            keep[g] = apart * (den + num) <= (den - num) * (n[g] + m[g])
        return keep

    def pairs(left: pa.Table, table: pa.Table) -> pa.Table:
        known = left.column("node").to_numpy().view(U)
        order = np.argsort(known)
        known, bound = known[order], left.column("size").to_numpy()[order]
        sketch = np.frombuffer(b"".join(left.column("sketch").to_pylist()), U).reshape(-1, SKETCH)[order]
        sig, node, comp, order = ordered(table)
        weight, mine = (table.column(c).to_numpy()[order] for c in ("weight", "mine"))
        head, size = component_runs(sig, comp)
        cut, total = X.runs(sig)
        end = np.repeat(cut + total, total)
        first = np.repeat(head + size, size)  # the first row of the bucket's next component
        many = np.where(mine, end - first, 0)
        out, lo = [], 0
        done = np.cumsum(many)
        while lo < len(sig):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 4_000_000, "right")))
            n = many[lo:hi]
            x = np.repeat(np.arange(lo, hi), n)
            y = np.repeat(first[lo:hi], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            a, b, n = a[at], b[at], np.add.reduceat(weight[x][order], at) if len(at) else np.zeros(0, np.int64)
            keep = possible(a, b, known, bound, sketch)
            out.append((a[keep], b[keep], n[keep]))
            lo = hi
        a, b, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))
        return pa.Table.from_batches([X.pack(T.mix(a ^ T.mix(b)) % U(blocks), {"a": a, "b": b, "c": n})])

    def total(table: pa.Table) -> pa.Table:
        c = X.unpack(table, {"a": U, "b": U, "c": np.int64})
        order = np.lexsort((c["b"], c["a"]))
        a, b = c["a"][order], c["b"][order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        n = np.add.reduceat(c["c"][order], at) if len(at) else c["c"]
        return pa.table({"fa": a[at].view(np.int64), "fb": b[at].view(np.int64), "shared": n})

    there = rows.select("block", "fp").distinct().join(marks, "fp").select(F.col("block").alias("place"), F.col("fp").alias("node"), "size", "sketch")
    found = X.spread(there, blocks, "place").groupBy("place").cogroup(X.spread(rows, blocks).groupBy("block")).applyInArrow(X.both(pairs), X.binary_schema("a", "b", "c"))
    return X.by_block(found, total, "fa long, fb long, shared long", blocks=blocks)


def verify(ws: X.Workspace, docs: DataFrame, pairs: DataFrame, name: str, n: int, bands: Bands, bound: int, named_by: Callable) -> DataFrame:
    """The pairs (a, b) whose whole sets link.  A group holds some pairs of one hub and their texts."""
    pairs = ws.write(f"{name}-pairs", pairs.select("fa", "fb", "a", "b"))
    groups = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // PAIRS_EACH)
    ws.write(f"{name}-hubs", pairs.groupBy("fb").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRS_EACH))  # a row for so many pairs
    part = F.pmod(F.xxhash64("fa"), F.coalesce(1 + F.expr(f"n div {PAIRS_EACH}"), F.lit(1)))
    pairs = X.attach(ws, pairs, f"{name}-hubs", "fb", "left", bound).withColumn("grp", F.pmod(F.xxhash64("fb", part), F.lit(groups))).select("fa", "fb", "a", "b", "grp")
    ends = pairs.select("grp", F.col("a").alias("doc_id")).union(pairs.select("grp", F.col("b").alias("doc_id")))
    ws.write(f"{name}-need", ends.groupBy("doc_id").agg(F.collect_set("grp").alias("grps")))
    texts = X.attach(ws, docs, f"{name}-need", bound=bound).select(F.explode("grps").alias("grp"), "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for _, _, buf, offs in T.chunks(left.column("text").combine_chunks() if left.num_rows else pa.array([], pa.string())):
            vals, at = shingle_sets(buf, offs, n)
            fp, _ = named_by(vals, at)
            for i, f in enumerate(fp.view(np.int64).tolist()):
                sets.setdefault(f, vals[at[i] : at[i + 1]])
        good = []
        for i, (fa, fb) in enumerate(zip(right.column("fa").to_pylist(), right.column("fb").to_pylist(), strict=True)):
            x, y = sets[fa], sets[fb]
            if len(x) > len(y):
                x, y = y, x
            if bands.linked(len(x), len(y), len(x)):
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                if bands.linked(len(x), len(y), int((y[at] == x).sum())):
                    good.append(i)
        return right.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return texts.groupBy("grp").cogroup(pairs.groupBy("grp")).applyInArrow(X.both(check), "a long, b long")


def nameless(docs: DataFrame, n: int) -> DataFrame:
    """Rows without a doc_id: counted, linked with nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in T.chunks(batch.column(0)):
                size = np.diff(shingle_sets(buf, offs, n)[1])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(size), pa.int64()), pa.array(size.astype(np.int64)), pa.nulls(len(size), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return docs.filter("doc_id IS NULL").select("text").mapInArrow(X.giving_back(count), "doc_id long, n_shingles long, component_id long")
