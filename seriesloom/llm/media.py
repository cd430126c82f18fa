"""Media columns: lossless images in archives, read by a Spark data source.

`write_archives` stores one payload for each row as a member of an archive: an
8-bit grey PNG, 64 samples wide.  An archive is a ZIP file with stored members,
so its central directory gives every member's byte range.

`MediaArchives` (format name ``media_archives``) plans byte ranges of the
archives, as splits of a file are planned: the driver sees names and sizes only,
of the archives that the manifest lists (so that what a dead attempt left behind
is not read), or of the whole folder without one.  Each task reads the directory
of its archive, which a worker keeps for the archive's next range, and takes the
members that begin in its range.  Payloads stream through Arrow in batches of
bounded bytes.  Every member is read by its own offset and checked against the
directory's CRC-32; a failed read is repeated for that member alone, on a fresh
handle, and a member that still fails becomes a row with `error` set and no
payload, so one bad member costs neither its neighbours nor the task.  Likewise
a directory that stays unreadable becomes one error row for each of its ranges.

Files are reached by pyarrow's file systems, from the URI of the shared folder.

Defined cases: a null text is the empty text; an empty payload is padded to one
block; null doc_ids are kept; repeated rows become members of their own; equal
texts give equal stored bytes, digests and features; a very long text is one
member, held whole by its task; an empty table gives no archive and no rows;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import exchange as X
from . import textvec as T

#: samples in a row of the image, and the padding unit
WIDTH = 64
#: bytes of members in one archive, and of one planned range
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
#: bytes of members in one Arrow batch, and rows at most
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
TRIES = 3
LOCAL_HEADER = struct.Struct("<4s5H3L2H")


def padded(raw: bytes) -> bytes:
    """Zeros up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">L", len(body)) + kind + body + struct.pack(">L", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """The payload as grey samples, rows of WIDTH, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">LLBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", head) + _png_chunk(b"IDAT", zlib.compress(lines, 1)) + _png_chunk(b"IEND", b"")


def from_png(raw: bytes) -> bytes:
    """Samples of a PNG made by to_png; every chunk's CRC is checked."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(raw):
        n, kind = struct.unpack_from(">L4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">L", raw, at + 8 + n)[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">LLBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:4] != (8, 0):
        raise ValueError("not a grey image of the right width")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Height, mean sample and a 64-bit average hash over an 8 by 8 grid."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    h = len(rows)
    cols = rows.reshape(h, 8, WIDTH // 8).sum(2, dtype=np.int64)
    edge = np.arange(9) * h // 8
    total = np.concatenate([np.zeros((1, 8), np.int64), np.cumsum(cols, 0)])
    lo, hi = np.minimum(edge[:-1], h - 1), np.maximum(edge[1:], np.minimum(edge[:-1], h - 1) + 1)
    cell = (total[hi] - total[lo]) / ((hi - lo) * (WIDTH // 8))[:, None]
    bits = np.packbits((cell > cell.mean()).ravel()).tobytes().hex()
    return f"{h}x{WIDTH}:{int(cols.sum()) / (h * WIDTH):.4f}:{bits}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(docs: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a PNG member for each row; returns (archive, members, bytes) of all archives, lazily.

    An archive is written under a name of the attempt's own and renamed when
    whole; its final name depends only on the task and its place there, so
    what a repeated task writes replaces the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(uri)
        fs.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        state: dict = {"n": 0}

        def begin() -> None:
            state["tmp"] = f"{root}/.part-{part:06d}-{state['n']:04d}-{attempt}"
            state["sink"] = fs.open_output_stream(state["tmp"])
            state["zip"] = zipfile.ZipFile(_Counted(state["sink"]), "w", zipfile.ZIP_STORED, allowZip64=True)
            state["rows"] = state["bytes"] = 0

        def end() -> pa.RecordBatch:
            state["zip"].close()
            state["sink"].close()
            name = f"part-{part:06d}-{state['n']:04d}.zip"
            fs.move(state["tmp"], f"{root}/{name}")
            state["n"] += 1
            out = [pa.array([name]), pa.array([state["rows"]], pa.int64()), pa.array([state["bytes"]], pa.int64())]
            state["zip"] = None
            return pa.RecordBatch.from_arrays(out, ["archive", "members", "bytes"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, buf, offs in T.chunks(batch.column(1)):
                for i in range(lo, hi):
                    text = buf[offs[i - lo] : offs[i - lo + 1]].tobytes()
                    png = to_png(padded(text))
                    if not state.get("zip"):
                        begin()
                    name = f"{state['rows']:09d}_{'' if ids[i] is None else ids[i]}_{len(text)}.png"
                    state["zip"].writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), png)
                    state["rows"], state["bytes"] = state["rows"] + 1, state["bytes"] + len(png)
                    if state["bytes"] >= archive_bytes:
                        yield end()
        if state.get("zip"):
            yield end()

    return X.ensure_text(docs).mapInArrow(X.giving_back(run), "archive string, members long, bytes long")


class _Counted(io.RawIOBase):
    """A forward-only file for zipfile over an output stream."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class Range(InputPartition):
    """Members of one archive whose local headers begin in [lo, hi)."""

    def __init__(self, uri: str, lo: int, hi: int):
        self.uri, self.lo, self.hi = uri, lo, hi


class MediaArchives(DataSource):
    """Options: path (a folder URI), manifest (the URI of write_archives' rows as Parquet, if only those archives count), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.manifest = options["path"].rstrip("/"), options.get("manifest")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """Byte ranges of all archives; no archive is opened here."""
        fs, root = open_fs(self.uri)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        size = {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(".zip") and not f.base_name.startswith(".")}
        names = sorted(size)
        if self.manifest:
            mfs, path = open_fs(self.manifest)
            files = [f.path for f in mfs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.base_name.endswith(".parquet")]
            names = sorted(n for f in files for n in pq.read_table(f, filesystem=mfs, columns=["archive"]).column(0).to_pylist())
        # a listed archive that is missing is one range, whose task says so
        return [Range(f"{self.uri}/{n}", lo, lo + self.range_bytes) for n in names for lo in range(0, size.get(n) or 1, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.uri:
            yield from read_range(part.uri, part.lo, part.hi)


#: what can go wrong while bytes of an archive are read or understood
BROKEN = (OSError, ValueError, struct.error, zipfile.BadZipFile, EOFError, pa.ArrowException)
#: the directory of the archive that this worker read last
_LAST: dict[str, list[tuple[int, str, int, int]]] = {}


def directory(fs: pafs.FileSystem, path: str) -> list[tuple[int, str, int, int]]:
    """(offset, name, bytes, CRC) of an archive's members."""
    if path not in _LAST:
        with fs.open_input_file(path) as handle, zipfile.ZipFile(handle) as z:
            found = [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist()]
        _LAST.clear()
        _LAST[path] = found
    return _LAST[path]


def read_range(uri: str, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Batches of the members that begin in the range."""
    fs, path = open_fs(uri)
    archive, handle, members = uri.rsplit("/", 1)[1], None, None
    for k in range(TRIES):
        try:
            members = [m for m in directory(fs, path) if lo <= m[0] < hi]
            handle = fs.open_input_file(path)
            break
        except BROKEN as e:
            error = f"directory: {type(e).__name__}: {e}"[:200]
            time.sleep(0.05 * k)
    if handle is None:
        yield batch_of([(archive, lo, None, None, error)])
        return
    rows: list[tuple] = []
    held = 0
    for offset, name, size, crc in members:
        raw, error = None, None
        for k in range(TRIES):
            try:
                raw, error = member(handle, offset, size, crc), None
                break
            except BROKEN as e:
                error = f"{type(e).__name__}: {e}"[:200]
                time.sleep(0.05 * k)
                with contextlib.suppress(*BROKEN):
                    handle = fs.open_input_file(path)
        rows.append((archive, offset, name, raw, error))
        held += size
        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield batch_of(rows)
            rows, held = [], 0
    if rows:
        yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "member", "media", "error"])


def member(handle: pa.NativeFile, offset: int, size: int, crc: int) -> bytes:
    """One stored member's bytes, by its local header's offset."""
    head = LOCAL_HEADER.unpack(handle.read_at(LOCAL_HEADER.size, offset))
    if head[0] != b"PK\x03\x04":
        raise ValueError("no local header here")
    raw = handle.read_at(size, offset + LOCAL_HEADER.size + head[9] + head[10])
    if len(raw) != size or zlib.crc32(raw) != crc:
        raise ValueError("a damaged member")
    return raw


def media_table(docs: DataFrame) -> DataFrame:
    """Store every row's text, and read the archives back: doc_id, n_bytes, media."""
    spark = docs.sparkSession
    ws = X.Workspace(spark, "media", docs)
    uri = ws.path("archives")
    ws.write("manifest", write_archives(docs, uri))
    return read_media(spark, uri, ws.path("manifest")).selectExpr(
        "CAST(NULLIF(split_part(member, '_', 2), '') AS long) doc_id",
        "CAST(split_part(split_part(member, '_', 3), '.', 1) AS long) n_bytes",
        "media",
        "error",
    )


def read_media(spark: SparkSession, uri: str, manifest: str | None = None) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives").option("path", uri)
    return (reader.option("manifest", manifest) if manifest else reader).load()


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digest(media: DataFrame) -> DataFrame:
    """The contract's columns of op3, from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in batches:
            out = []
            for doc, n, raw, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [None] * 6
                if raw is not None:
                    try:
                        p = from_png(raw)
                        row = [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(p)]
                    except (ValueError, struct.error, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                out.append((doc, n, *row, error))
            cols = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.mapInArrow(X.giving_back(run), DIGEST)
