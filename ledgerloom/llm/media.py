"""Media columns: payloads as grey images in archives, and a Spark data source that reads them back.

``store`` writes each payload as a PNG image, 64 samples of 8 bits a row, into ZIP archives in a folder, one
or more a task. An archive is written under a name of its own and counts only if the table of archives that
``store`` returns names it, so that what a lost or repeated task leaves behind is never read.

The data source ``archive_media`` plans from a written index of names and sizes, one row an archive: each archive is
cut into byte ranges. A task gets its range alone. A reader takes the members whose headers start in its range, by the
directory at the archive's end, streams them in Arrow batches of bounded size, and retries each member on its own, by its
offset, with a file opened anew.

A null text counts as empty; an empty payload is one row of zeros. Members keep the key of their row, null
keys too, and rows that repeat are members of their own. An archive of no members is not written.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import as_texts, checkpoint, fresh_path, small_batches

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(data: bytes) -> bytes:
    """Data, with zero bytes to the next positive multiple of the width."""
    n = max(1, -(-len(data) // WIDTH)) * WIDTH
    return data + bytes(n - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image; the unpadded length is kept in a text chunk."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length; ValueError if a checksum or a size is wrong."""
    if image[:8] != _SIGNATURE:
        raise ValueError("no image")
    at, chunks = 8, {}
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if len(body) != n or struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        chunks[kind] = chunks.get(kind, b"") + body
        at += 12 + n
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    raw = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if (width, depth, colour) != (WIDTH, 8, 0) or raw[:, 0].any():
        raise ValueError("another kind of image")
    return raw[:, 1:].tobytes(), int(chunks[b"tEXt"].split(b"\0")[1])


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples and a difference hash of an 8 x 9 grid of block means."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    mean, dev = float(x.mean()), float(x.std())
    rows = np.linspace(0, len(x), 9).astype(int)
    columns = np.linspace(0, WIDTH, 10).astype(int)
    sums = np.zeros((len(x) + 1, 9), np.int64)
    by_column = np.stack([x[:, a:b].sum(1, dtype=np.int64) for a, b in zip(columns[:-1], columns[1:])], 1)
    np.cumsum(by_column, 0, out=sums[1:])
    widths = np.diff(columns)
    # An image of fewer than 8 rows has bands without rows; each takes at least one.
    low, high = np.minimum(rows[:-1], len(x) - 1), np.maximum(rows[1:], np.minimum(rows[:-1], len(x) - 1) + 1)
    grid = (sums[high] - sums[low]) / ((high - low)[:, None] * widths[None, :])
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{mean:.4f},{dev:.4f},{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below ``folder``; returns the table of archives: path, n_members, n_bytes."""
    folder = _plain(folder)
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        done, sink, archive, out = [], None, None, None

        def close():
            archive.close()
            size = sink.tell()
            sink.close()
            done.append((out, len(archive.infolist()), size))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    out = f"{folder}/{uuid.uuid4().hex}.zip"
                    sink = fs.open_output_stream(_filesystem(out)[1])
                    archive = zipfile.ZipFile(_Sink(sink), "w", zipfile.ZIP_STORED)
                data = (text or "").encode("utf-8", "replace")
                name = f"{len(archive.filelist):08d}_{'null' if key is None else key}.png"
                archive.writestr(zipfile.ZipInfo(name), to_png(payload(data), len(data)))
                if sink.tell() >= archive_bytes:
                    close()
                    archive = None
        if archive is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "n_members", "n_bytes"])

    return checkpoint(as_texts(docs, id_col, text_col).mapInArrow(write, "path string, n_members long, n_bytes long"))


class _Sink(io.RawIOBase):
    """An output stream as a file that zipfile can write to without seeking."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveMedia(DataSource):
    """Options: ``index`` (a folder of Parquet files with path and n_bytes of each archive) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return "doc_id long, member string, offset long, media binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.index = options["index"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        archives = sorted(zip(*(c.to_pylist() for c in read_index(self.index).columns)))
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in archives for at in range(0, size, self.range_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where none is planned
            return
        members = [m for m in _retried(lambda: directory(partition.path)) if partition.start <= m.header_offset < partition.end]
        rows, size = [], 0
        for m in members:
            data = _retried(lambda m=m: read_member(partition.path, m))
            key = m.filename.split("_")[1].removesuffix(".png")
            rows.append((None if key == "null" else int(key), m.filename, m.header_offset, data))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "member", "offset", "media"])


def read_index(folder: str) -> pa.Table:
    """path and n_bytes of all archives of an index."""
    fs, at = _filesystem(folder)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(".parquet")]
    parts = [pq.read_table(p, columns=["path", "n_bytes"], filesystem=fs) for p in sorted(files)]
    return pa.concat_tables(parts) if parts else pa.table({"path": pa.array([], pa.string()), "n_bytes": pa.array([], pa.int64())})


@lru_cache(maxsize=2)
def directory(path: str) -> list[zipfile.ZipInfo]:
    """Members of an archive, from the directory at its end."""
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        return z.infolist()


def read_member(path: str, member: zipfile.ZipInfo) -> bytes:
    """One stored member by its offset; ValueError if it is damaged."""
    fs, at = _filesystem(path)
    with fs.open_input_file(at) as f:
        f.seek(member.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{path}: no member at {member.header_offset}")
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(member.header_offset + 30 + name + extra)
        data = f.read(member.compress_size)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise ValueError(f"{path}: member at {member.header_offset} is damaged")
    return data


def _retried(what, tries: int = TRIES):
    """Tries again after errors of the store; the last error stands, as a member must not be lost silently."""
    for i in range(tries):
        try:
            return what()
        except (OSError, ValueError, zipfile.BadZipFile):
            if i == tries - 1:
                raise
            time.sleep(0.1 * 2**i)


def read_archives(spark: SparkSession, archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Members of the archives that the table names: doc_id, member, offset, media.

    The index is written to the shared folder; planning reads it there, one row for ``ARCHIVE_BYTES`` of payload.
    """
    spark.dataSource.register(ArchiveMedia)
    index = fresh_path(spark, "index")
    archives.select("path", "n_bytes").write.parquet(index)
    return spark.read.format("archive_media").option("index", _plain(index)).option("range_bytes", range_bytes).load()


def _plain(path: str) -> str:
    """A local path without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def features(media: DataFrame) -> DataFrame:
    """Per member: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    small_batches(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, image in zip(batch.column(0), batch.column(1)):
                image = image.as_py()
                samples, n = from_png(image)
                rows.append((key.as_py(), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = [f.split()[0] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def media_features(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as media, reads them back and computes their features."""
    spark = docs.sparkSession
    archives = store(docs, folder or fresh_path(spark, "media"), id_col, text_col)
    return features(read_archives(spark, archives))
