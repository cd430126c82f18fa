"""How the operators of this subpackage move and keep data.

* `Workspace` holds written tables in the folder that ``spark.checkpoint.dir``
  names (shared by driver and executors): they cut lineage and survive lost
  executors.
* `pack`/`unpack` move numpy columns in blocks: a map task sorts its rows by
  block number and ships one row of raw arrays for each block, so the JVM
  handles a few rows of binary in place of millions of small ones.
* `attach` joins documents with a side table: broadcast if its values' bytes in
  memory, counted here, are under a stated bound, by shuffle beyond it.
* `components` labels connected components with DataFrame rounds.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: a side table is broadcast up to this many bytes of values in memory
BROADCAST_BYTES = 64 << 20
#: input bytes for each block of an exchange
BLOCK_BYTES = 8 << 20
#: blocks that one task takes one after the other, about, and tasks that write a table, at least
BLOCKS_EACH, FEWEST = 16, 8


#: Python workers: few heaps, and Arrow's memory on them
FRUGAL = {"MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def give_back() -> None:
    """Return free memory to the system: idle workers of an earlier stage count against the executor."""
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own ways
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(fn: Callable) -> Callable:
    """fn over a partition's batches, after which the worker returns its free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(":"):
        env["PYTHONPATH"] = f"{root}:{have}" if have else root
    for name, value in FRUGAL.items():
        env.setdefault(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set here only if a local session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: links that one task may merge (16 bytes each)
ONE_TASK = 500_000


class Workspace:
    """Written tables of one call of an operator.

    What an operator returns reads them when it is evaluated, so they stay until
    `close`, or until the driver's process ends.  With the input `docs` given, a
    table is written by one task for each block of the input at most (and some at
    least), so that many small partitions do not become as many files.
    """

    def __init__(self, spark: SparkSession, name: str, docs: DataFrame | None = None):
        on_workers(spark)
        size = estimated(docs) if docs is not None else None
        self.tasks = None if size is None else max(FEWEST, -(-size // BLOCK_BYTES))
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Write df, and return what reads it back."""
        w = (df.coalesce(self.tasks) if self.tasks else df).write.mode("overwrite")
        (w.partitionBy(*by) if by else w).option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        r = self.spark.read
        return (r.schema(schema) if schema is not None else r).parquet(self.path(name))

    def memory(self, name: str) -> int:
        """Bytes of a written table's values: eight for each fixed one, the lengths of the others."""
        df = self.read(name)
        wide = [F.col(f.name) for f in df.schema if f.dataType.typeName() in ("binary", "string")]
        wide += [F.to_json(F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        each = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in wide), F.lit(16 * len(df.columns)).cast("long"))
        return int(df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0])

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Delete all its tables; whatever still reads them fails from then on."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # at the process's end the JVM may be gone, and its folders stay
            _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def estimated(df: DataFrame) -> int | None:
    """Spark's own estimate of a frame's bytes; None for frames made from driver rows."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size <= 1 << 60 else None


def blocks_for(df: DataFrame, bytes_each: int = BLOCK_BYTES) -> int:
    """Blocks for an exchange: in proportion to the input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated(df)
    return least if size is None else max(least, -(-size // bytes_each))


def attach(ws: Workspace, docs: DataFrame, name: str, key: str = "doc_id", how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join docs with the written table `name` on key (null-safe keys are not matched)."""
    side = ws.read(name)
    return docs.join(F.broadcast(side) if bound > 0 and ws.memory(name) <= bound else side, key, how)


def binary_schema(*cols: str, key: str = "block") -> str:
    return ", ".join([f"{key} long", *(f"{c} binary" for c in cols)])


def block_schema(*cols: str, key: str = "block") -> pa.Schema:
    """binary_schema() for Arrow."""
    return pa.schema([(key, pa.int64()), *((c, pa.binary()) for c in cols)])


def pack(block: np.ndarray, cols: dict[str, np.ndarray], key: str = "block") -> pa.RecordBatch:
    """One row for each block number, with the raw bytes of its rows' columns."""
    order = np.argsort(block, kind="stable")
    b = block[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    end = np.append(cut[1:], len(b))[: len(cut)]
    out = [pa.array(b[cut].astype(np.int64), pa.int64())]
    for x in cols.values():
        x = np.ascontiguousarray(x[order])
        out.append(pa.array([x[i:j].tobytes() for i, j in zip(cut, end, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, [key, *cols])


def unpack(table: pa.Table, kinds: dict[str, type | str]) -> dict[str, np.ndarray]:
    """The columns of a block's rows, each as one array."""
    return {c: np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), k) for c, k in kinds.items()}


def padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with the schema's other columns as nulls."""
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


class Met:
    """How often a task has met a 64-bit signature, by hashed counters; tells those met over `local` times."""

    def __init__(self, local: int, cells: int = 1 << 20):
        self.local, self.count, self.total = local, np.zeros(cells, np.uint32), 0

    def often(self, sig: np.ndarray) -> np.ndarray:
        """Counts the signatures in; which of them are met too often to be sent plainly.

        A rare one that shares its counter may be among them: that costs more rows, never a result.
        """
        cell = (sig >> np.uint64(40)).astype(np.int64) % len(self.count)
        self.total += len(cell)
        self.count += np.bincount(cell, minlength=len(self.count)).astype(np.uint32)
        return self.count[cell] > self.local + 4 * self.total // len(self.count)


def runs(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of each run of equal values."""
    if not len(sorted_key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    return cut, np.diff(np.append(cut, len(sorted_key)))


def spread(df: DataFrame, blocks: int, key: str = "block") -> DataFrame:
    """df dealt by key to tasks of BLOCKS_EACH blocks; Spark's own number serves where it is larger."""
    tasks = -(-blocks // BLOCKS_EACH)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def by_block(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, key: str = "block", blocks: int = 0) -> DataFrame:
    """fn over all rows of each block; `blocks`, their number, sets that of the tasks."""

    def run(table: pa.Table) -> pa.Table:
        out = fn(table)
        give_back()
        return out

    return spread(df, blocks, key).groupBy(key).applyInArrow(run, schema)


def both(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """fn over two tables of a group, after which the worker returns its free memory."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        give_back()
        return out

    return run


def components(ws: Workspace, name: str, links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): smallest node reachable, for the nodes of `links` (a, b).

    Up to `one_task` distinct links, by size checked here, one task merges them
    all.  Beyond it, alternating large-star and small-star rounds; each is two aggregations
    and its result is written, so lineage and memory stay flat.
    """
    edges = ws.write(f"{name}-e0", links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.count() <= one_task:
        return edges.repartition(1).mapInArrow(merge_links, "node long, component long")
    step, before = 0, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step += 1
        edges = ws.write(f"{name}-e{step}", small.filter("u <> v").distinct())
        ws.drop(f"{name}-e{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == before or now[0] == 0:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())


def merge_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of one task: smallest labels spread until none changes."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def ensure_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select("doc_id", "text")


def cpu_threads() -> None:
    """One thread for each Python worker: Spark schedules the cores."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
