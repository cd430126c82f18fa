"""Token-id output: whole corpora as rANS-coded files in doc_id order.

Documents are dealt by ranges of (doc_id, hash of the text) and sorted, so files
follow each other in ascending order and rows that share a doc_id can be spread.
A task tokenizes its range and closes a segment of whole documents when it holds
`segment` ids; segments are kept plainly until all are counted, in one file for
each task, which later tasks read a segment at a time.  The counts of all tasks make one frequency table for the corpus (a row for each id that
occurs, so the vocabulary bounds it), and the parts' totals give each segment's
place in the whole: sums of runs of parts first, then inside each run.  A second
pass codes every segment under that table (see `rans`).

The files are two Parquet tables written by Spark, hence on any file system and
safe against lost executors: `table`, and `segments` with one row for each
segment: part, seg, its first id's place in the whole, its documents' ids and
lengths, and the coded bytes.  Readers decode segments independently.

Defined cases: a null text is empty (its end id alone); null doc_ids come
first; rows that repeat a doc_id follow each other, ordered by their text's
xxhash64, equal rows as they come; an empty table gives no rows; bytes that are
not UTF-8 are replaced as the library would; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange as X
from . import pieces, rans
from . import textvec as T

#: ids in a segment, at least
SEGMENT = 1 << 18
#: parts in a run of parts, whose places are summed apart
RUN = 1024
PLAIN = "part int, seg int, n_ids long, docs binary, known binary, sizes binary, ids binary, counts binary"
FILES = "part int, seg int, first long, n_ids long, docs binary, known binary, sizes binary, ids binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment: int = SEGMENT) -> None:
    """Tokenize documents and write their ids under path."""
    spark = docs.sparkSession
    ws = X.Workspace(spark, "ids")
    plain = ws.write("plain", tokenized(docs, tokenizer, end_id, segment))
    files = ws.write("files", plain.groupBy(F.input_file_name().alias("file")).agg(F.min("part").alias("part"), F.sum("n_ids").alias("n")).coalesce(X.FEWEST))
    tasks = max(1, files.count())  # one file each
    ws.write("counts", plain.filter("counts IS NOT NULL").select("counts").mapInArrow(X.giving_back(counted), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).coalesce(X.FEWEST))
    ws.read("counts").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    freq = read_table(spark, path)
    names, kinds = [c.split()[0] for c in FILES.split(", ")], [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for row in segments(file):
                    ids = np.frombuffer(row["ids"], f"<u{len(row['ids']) // row['n_ids']}" if row["n_ids"] else "<u4").astype(np.uint32)
                    row |= {"first": first, "ids": rans.encode(ids, freq)}
                    yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(names, kinds, strict=True)], names)
                    first += row["n_ids"]

    runs = files.groupBy(F.expr(f"part div {RUN}").alias("run")).agg(F.sum("n").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("base"))  # a row for RUN parts
    own = F.sum("n").over(Window.partitionBy("run").orderBy("part")) - F.col("n")
    placed = files.withColumn("run", F.expr(f"part div {RUN}")).withColumn("own", own).join(runs, "run").select("file", (F.col("base") + F.col("own")).alias("first"))
    placed.repartition(tasks).mapInArrow(X.giving_back(code), FILES).write.mode("overwrite").option("compression", "none").parquet(f"{path}/segments")
    ws.close()


def segments(uri: str) -> Iterator[dict]:
    """The segments of one task's file in order, one in memory at a time."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=[c.split()[0] for c in PLAIN.split(", ")][:-1]):
            yield from batch.to_pylist()


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, segment: int) -> DataFrame:
    """Segments in order, with their ids as they are."""
    X.on_workers(docs.sparkSession)
    names = [c.split()[0] for c in PLAIN.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        X.cpu_threads()
        enc = pieces.encoder(tokenizer)
        part, seg = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size, total = 0, np.zeros(0, np.int64)

        def close(last: bool) -> pa.RecordBatch:
            """A segment's row; the task's last one has the counts of all its ids."""
            nonlocal seg, size, total
            docs_, known, sizes, ids = (np.concatenate(x) if held else np.zeros(0, np.uint32) for x in (zip(*held, strict=True) if held else [()] * 4))
            n = np.bincount(ids)
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
            narrow = ids.astype("<u4" if len(total) > 1 << 16 else "<u2")
            row = [part, seg, len(ids), docs_.tobytes(), known.tobytes(), sizes.tobytes(), narrow.tobytes(), total.astype("<i8").tobytes() if last else None]
            seg, size = seg + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids_ = batch.column(0).fill_null(0).to_numpy()
            for lo, hi, buf, offs in T.chunks(batch.column(1), pieces.CHUNK):
                ids, count = enc.encode(buf, offs)
                ids = np.insert(ids, np.cumsum(count), np.uint32(end_id))
                held.append((ids_[lo:hi], known[lo:hi], count + 1, ids))
                size += len(ids)
                if size >= segment:
                    yield close(False)
        if held or seg:
            yield close(True)

    order = ["doc_id", F.xxhash64("text")]
    ordered = X.ensure_text(docs).repartitionByRange(X.blocks_for(docs, 2 * X.BLOCK_BYTES), *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(X.giving_back(run), PLAIN)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each id that occurs in some tasks' counts."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            n = np.frombuffer(raw, "<i8")
            total = np.pad(total, (0, max(0, len(n) - len(total))))
            total[: len(n)] += n
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["symbol", "n"])


def read_table(spark: SparkSession, path: str) -> rans.Table:
    """The corpus's frequency table: at most the vocabulary's rows."""
    rows = spark.read.parquet(f"{path}/table").toArrow()
    return rans.table_of(rows.column("symbol").to_numpy(), rows.column("n").to_numpy())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents back from the files: doc_id, start, n_tokens, ids (as little-endian uint32 bytes)."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    X.on_workers(spark)
    freq = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids = rans.decode(r["ids"], freq)
                sizes, known = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["known"], bool)
                end = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(end.tolist(), sizes.tolist(), strict=True)]
                last = pa.array([x.tobytes() for x in own], pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in own], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["docs"], np.int64), mask=~known), pa.array(r["first"] + end - sizes), pa.array(sizes), last],
                    ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"],
                )

    cols = "doc_id long, start long, n_tokens long, " + ("ids binary" if with_ids else "ids_crc32 long")
    return spark.read.schema(FILES).parquet(f"{path}/segments").select("first", "docs", "known", "sizes", "ids").mapInArrow(X.giving_back(run), cols)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files into a workspace, and per document what they say."""
    ws = X.Workspace(docs.sparkSession, "tokens")
    write_ids(docs, ws.path("files"), tokenizer, end_id)
    return _decoded(docs.sparkSession, ws.path("files"), False)
