"""Benchmark passages in training documents, found with FM-indexes.

Documents are read in shards of some MB, whole documents each.  A shard's words
become one sequence with a separator after each text, and that sequence, in
pieces of bounded length that overlap by the longest phrase, gets an FM-index:
suffix array, Burrows-Wheeler transform as a wavelet matrix with popcount ranks,
and sampled suffix positions.  All phrases are searched backwards at once
through the wavelet matrix's ranks; occurrences are located by walking to the
next sampled position, and overlapping ones merge into removal spans.

Phrases are the windows of `window` consecutive words of each item, or the
whole item if it has fewer words.  They are made and grouped on the executors
and written as files of bounded size under the workspace.  A shard's indexes
are built once and searched for the phrases of one file after the other, so
there is one pass over the documents whatever the benchmark's size; a worker
keeps the files in memory while they are few.

Defined cases: null texts have no words; an item without words or with a null
item_id is no phrase; repeated items and documents each count as they stand; a
document that is null or empty has no hits; a null doc_id is an ordinary row; an
empty benchmark hits nothing; very long texts are cut into overlapping pieces;
other columns, whatever their names, are left out, or go along if named.
Output: doc_id, n_words, starts and ends (word spans, merged, in order) and
items (ids of occurring items, ascending).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import exchange as X
from . import textvec as T

U = np.uint64
#: bytes of texts in a shard, and words in one index
SHARD_BYTES, PIECE = 1 << 20, 1 << 18
#: phrases in one file, and bytes of files that a worker keeps
PHRASES, KEPT_BYTES = 100_000, 256 << 20
#: every so many suffix positions is stored
SAMPLE = 16


class Phrases:
    """A file of phrases: by length, a grid of places in the file's vocabulary and the owners' lists."""

    def __init__(self, table: pa.Table):
        raw, at = T.flatten(table.column("words"))
        words, at = np.frombuffer(raw.tobytes(), U), at // 8
        self.vocab, code = np.unique(words, return_inverse=True)
        own = table.column("items").combine_chunks()
        owners, first = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
        size = np.diff(at)
        self.by_length = {}
        for n in np.unique(size):
            mine = np.flatnonzero(size == n)
            self.by_length[int(n)] = code[at[mine][:, None] + np.arange(n)], first[mine], first[mine + 1]
        self.owners = owners
        self.nbytes = words.nbytes + owners.nbytes


class PhraseFiles:
    """The phrase files of a folder, read once for each worker if they are small enough together."""

    def __init__(self, uri: str):
        self.fs, root = pafs.FileSystem.from_uri(uri)
        self.paths = sorted(f.path for f in self.fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".parquet"))
        self.kept: dict[str, Phrases] = {}
        self.held = 0

    def __iter__(self) -> Iterator[Phrases]:
        for path in self.paths:
            if (found := self.kept.get(path)) is None:
                found = Phrases(pq.read_table(path, filesystem=self.fs, columns=["words", "items"]))
                if self.held + found.nbytes <= KEPT_BYTES:
                    self.kept[path] = found
                    self.held += found.nbytes
            yield found


def write_phrases(ws: X.Workspace, benchmark: DataFrame, window: int) -> str:
    """Distinct windows with the ids of the items that hold them; the folder's URI."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in T.chunks(batch.column(1)):
                w = T.words(buf, offs, T.ALNUM_LOWER)
                item, grams = [], []
                for d, own in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                    h = w.hashes[0][w.offs[d] : w.offs[d + 1]]
                    mine = {h[k : k + window].tobytes() for k in range(max(1, len(h) - window + 1) if len(h) else 0)}
                    item.extend([own] * len(mine))
                    grams.extend(mine)
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), pa.array(item, pa.int64())], ["words", "item"])

    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item"), "text")
    found = items.mapInArrow(X.giving_back(windows), "words binary, item long").groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found.write.mode("overwrite").option("maxRecordsPerFile", PHRASES).parquet(ws.path("phrases"))
    return ws.path("phrases")


class Bits:
    """Ranks in a bit sequence by popcounts of 64-bit words."""

    def __init__(self, bit: np.ndarray):
        raw = np.packbits(bit, bitorder="little")
        self.words = np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)]).view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & ((U(1) << (i & 63).astype(U)) - U(1)))


class FMIndex:
    """Count and locate word sequences in `seq` (values from 1; 0 is the end mark, added here)."""

    def __init__(self, seq: np.ndarray):
        s = np.append(seq, 0).astype(np.int64)
        self.n = n = len(s)
        sa = suffix_array(s)
        self.bwt = x = s[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s))])
        self.levels = range(max(1, int(s.max()).bit_length()) - 1, -1, -1)
        self.bits, self.zeros = [], []
        for level in self.levels:
            bit = (x >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        marked = sa % SAMPLE == 0
        self.marked, self.samples = Bits(marked), sa[marked]
        self.there = marked

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the transform's first i symbols are c."""
        lo = np.zeros(len(c), np.int64)
        for bits, zeros, level in zip(self.bits, self.zeros, self.levels, strict=True):
            bit = (c >> level & 1).astype(bool)
            a, b = bits.ones(lo), bits.ones(i)
            lo, i = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, i - b)
        return i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: each phrase's rows [lo, hi) of the suffix order."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for c in phrases.T[::-1]:
            known = c < len(self.first) - 1
            c = np.where(known, c, 0)
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            hi = np.where(known, hi, lo)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-order rows."""
        out, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            there = self.there[rows]
            out[open_[there]] = self.samples[self.marked.ones(rows[there])] + steps
            open_, rows = open_[~there], rows[~there]
            c = self.bwt[rows]
            rows, steps = self.first[c] + self.rank(c, rows), steps + 1
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling from as many values as fit a word; only suffixes that still tie are sorted again."""
    n, width = len(s), max(1, int(s.max()).bit_length())
    k = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for j in range(k):
        key <<= width
        key[: max(0, n - j)] |= s[j:]
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = head[np.cumsum(new) - 1]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = sa[open_]
        own, nxt = rank[at], np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        order = np.lexsort((nxt, own))
        at, own, nxt = at[order], own[order], nxt[order]
        sa[open_] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])])
        rank[at] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = open_[~(new & np.append(new[1:], True))]
        k *= 2
    return sa


def hits(texts: pa.Array, phrases: PhraseFiles, longest: int) -> tuple[np.ndarray, ...]:
    """Of a shard: words of each text; row, start and end of occurrences (merged); row and item of occurring items."""
    buf, offs = T.flatten(texts)
    w = T.words(buf, offs, T.ALNUM_LOWER)
    n, doc = w.counts.astype(np.int64), w.docs()
    vocab, code = np.unique(w.hashes[0], return_inverse=True)
    seq = np.ones(len(code) + len(n), np.int64)  # a separator follows each text
    place = np.arange(len(code)) + doc
    seq[place] = code + 2
    row, word = np.repeat(np.arange(len(n)), n + 1), np.zeros(len(seq), np.int64)
    word[place] = np.arange(len(code)) - w.offs[doc]
    spans, owned = [], []
    for lo in range(0, len(seq), PIECE):
        index = FMIndex(seq[lo : lo + PIECE + longest - 1])
        for file in phrases:
            at = np.minimum(np.searchsorted(vocab, file.vocab), max(0, len(vocab) - 1))
            known = np.where(vocab[at] == file.vocab, at + 2, 0) if len(vocab) else np.zeros(len(file.vocab), np.int64)
            for length, (grid, first, last) in file.by_length.items():
                codes = known[grid]
                there = np.flatnonzero((codes > 0).all(1))
                if not len(there):
                    continue
                a, b = index.search(codes[there])
                some = b > a
                there, a, many = there[some], a[some], (b - a)[some]
                which = np.repeat(np.arange(len(there)), many)
                spot = lo + index.locate(np.repeat(a - np.cumsum(many) + many, many) + np.arange(len(which)))
                spans.append((row[spot], word[spot], word[spot] + length))
                pair = np.unique(row[spot] * len(grid) + there[which])
                r, p = pair // len(grid), pair % len(grid)
                count = (last - first)[p]
                owner = file.owners[np.repeat(first[p] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
                owned.append(np.unique(np.stack([np.repeat(r, count), owner], 1), axis=0))
    span = [np.concatenate(x) for x in zip(*spans, strict=True)] if spans else [np.zeros(0, np.int64)] * 3
    own = np.unique(np.concatenate(owned), axis=0) if owned else np.zeros((0, 2), np.int64)
    return n, *merged(*span), own[:, 0], own[:, 1]


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a row as one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    head = np.concatenate([[True], (start + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(head)
    return row[at], start[at], np.maximum.reduceat(end, at)


def lists(row: np.ndarray, vals: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of values sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(vals, kind))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """See the module's text.  One row for each document; carry: columns that go along."""
    ws = X.Workspace(docs.sparkSession, "decontaminate")
    uri = write_phrases(ws, benchmark, window)
    names = ["doc_id", "n_words", "starts", "ends", "items"]
    also = [c for c in carry if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = PhraseFiles(uri)
        for batch in batches:
            for lo, hi, *_ in T.chunks(batch.column(1), SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                n, row, start, end, who, item = hits(part.column(1), phrases, window)
                cols = [part.column(0), pa.array(n), lists(row, start, hi - lo, pa.int32()), lists(row, end, hi - lo, pa.int32()), lists(who, item, hi - lo, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(1 if c == "text" else 2 + also.index(c)) for c in carry)], [*names, *carry])

    kinds = [Y.LongType(), Y.LongType(), *(Y.ArrayType(t) for t in (Y.IntegerType(), Y.IntegerType(), Y.LongType()))]
    schema = Y.StructType([Y.StructField(n, k) for n, k in zip(names, kinds, strict=True)] + [docs.schema[c] for c in carry])
    return docs.select("doc_id", "text", *also).mapInArrow(X.giving_back(run), schema)


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns of op9."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))
