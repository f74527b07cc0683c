"""Compressed logs (S2-S4): codec by content, streaming decode, ingest to Parquet.

The codec is decided by the leading bytes, never by the file name:

* gzip  -- 2 bytes ``1f 8b``
* bzip2 -- ``BZh`` and a block-size digit ``1``..``9`` (4 bytes at least)
* xz    -- the 6-byte magic ``fd 37 7a 58 5a 00``
* anything else, or fewer than 2 bytes -> ``none``

Spark's text reader picks a codec by extension and cannot read xz, so files
whose content does not match their name are decoded in Python tasks: Spark's
binary file scan (metadata only) lists the files and packs small ones into one
task, and each task streams its files through the stdlib decoder -- whole
multi-member gzip, multi-stream bzip2 and concatenated xz -- and emits Arrow
batches of ``(file, line_no, value)``; nothing is held beyond one batch. Large
ones are decoded in parallel by their blocks (``blocks``). All other files,
plain ones above all, are read by Spark's own reader in splits.
"""

from __future__ import annotations

import io
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.session import ship_package

# Codec names and magic numbers.
CODECS = ("none", "gzip", "bzip2", "xz")
GZIP_MAGIC = b"\x1f\x8b"
BZIP2_MAGIC = b"BZh"
XZ_MAGIC = b"\xfd7zXZ\x00"

BATCH_LINES = 8192


def codec_of(head: bytes) -> str:
    if len(head) < 2:
        return "none"
    if head[:2] == GZIP_MAGIC:
        return "gzip"
    if len(head) >= 4 and head[:3] == BZIP2_MAGIC and 0x31 <= head[3] <= 0x39:
        return "bzip2"
    if len(head) >= 6 and head[:6] == XZ_MAGIC:
        return "xz"
    return "none"


def _open(path: str):
    """Binary, seekable stream for a Spark path (local ``file:`` or any pyarrow filesystem)."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def _decoded(raw, codec: str):
    if codec == "gzip":
        import gzip
        return gzip.GzipFile(fileobj=raw)
    if codec == "bzip2":
        import bz2
        return bz2.BZ2File(raw)
    if codec == "xz":
        return _XzStreams(raw)
    return raw


class _XzStreams(io.RawIOBase):
    """Decoded bytes of concatenated xz streams with padding between them, which ``LZMAFile`` takes for
    the end. What is no stream after the first one is ignored, as there."""

    def __init__(self, raw):
        self.raw, self.dec, self.ahead = raw, None, b""

    def readable(self):
        return True

    def _begin(self) -> bool:
        import lzma

        data = self.ahead
        while self.dec is not None and not data.lstrip(b"\0"):  # padding
            data = self.raw.read(1 << 16)
            if not data:
                return False
        if self.dec is not None:
            data = data.lstrip(b"\0")
            data += self.raw.read(6) if len(data) < 6 else b""
            if not data.startswith(XZ_MAGIC):
                return False
        self.ahead, self.dec = data, lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
        return True

    def readinto(self, into):
        while True:
            if self.dec is None or self.dec.eof:
                if self.dec is not None:
                    self.ahead = self.dec.unused_data
                if not self._begin():
                    return 0
            data = (self.ahead or self.raw.read(1 << 16)) if self.dec.needs_input else b""
            if self.dec.needs_input and not data:
                raise EOFError("an xz stream ends early")
            self.ahead = b""
            out = self.dec.decompress(data, len(into))
            if out:
                into[: len(out)] = out
                return len(out)


def _peek(path: str) -> bytes:
    try:
        with _open(path) as f:
            return f.read(6)
    except OSError:
        return b""


def list_files(spark: SparkSession, paths) -> DataFrame:
    """``(path, length)`` of every file under ``paths``; Spark's binary scan without its content."""
    if isinstance(paths, str):
        paths = [paths]
    return spark.read.format("binaryFile").load(list(paths)).select("path", "length")


def detect_codec(spark: SparkSession, paths) -> DataFrame:
    """``(file, codec)`` from the first six bytes of every file, read in tasks."""
    ship_package(spark)

    def peek(batches):
        import pyarrow as pa

        for b in batches:
            codecs = [codec_of(_peek(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codecs, pa.string())], names=["file", "codec"])

    return list_files(spark, paths).select("path").mapInArrow(peek, "file string, codec string")


#: Files of at least so many bytes are decoded piece by piece; smaller ones whole, packed together.
WHOLE_BYTES = 8 << 20


def read_compressed(spark: SparkSession, paths, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """S3: ``(file, line_no, value, codec)`` from files of any codec, by content.

    Files below ``whole_bytes`` are one stream each, small ones packed into one task.
    Larger ones are decoded piece by piece in parallel (``blocks.directory``): xz and
    bzip2 blocks, gzip members, ranges of plain files; only a file that is one piece
    stays one task's. Rows are the same either way.
    """
    ship_package(spark)
    files = list_files(spark, paths)
    largest = files.agg(F.max("length")).first()[0]
    if largest is None or largest < whole_bytes:
        return _read_whole(files.select("path"))
    from ldaplens.sources import blocks

    large = blocks.codecs(files.where(F.col("length") >= whole_bytes))
    pieces, alone = blocks.directory(spark, large)
    rest = files.where(F.col("length") < whole_bytes).select("path").union(alone)
    return _read_whole(rest).union(blocks.read_pieces(spark, pieces))


def _read_whole(files: DataFrame) -> DataFrame:
    """Every file of ``(path)`` as one stream for one task."""
    def decode(batches):
        import pyarrow as pa

        def batch(path, codec, first, values):
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()),
                 pa.array(values, pa.string()), pa.array([codec] * n, pa.string())],
                names=["file", "line_no", "value", "codec"])

        for b in batches:
            for path in b.column(0).to_pylist():
                codec = codec_of(_peek(path))
                values, first = [], 0
                with _open(path) as raw:
                    for line in io.BufferedReader(_decoded(raw, codec), buffer_size=1 << 20):  # splits on b"\n" only
                        values.append(_text(line))
                        if len(values) >= BATCH_LINES:
                            yield batch(path, codec, first, values)
                            first, values = first + len(values), []
                if values:
                    yield batch(path, codec, first, values)

    return files.mapInArrow(decode, "file string, line_no bigint, value string, codec string")


def _text(line: bytes) -> str:
    """A line without its newline and one CR before it."""
    if line.endswith(b"\n"):
        line = line[:-1]
    if line.endswith(b"\r"):
        line = line[:-1]
    return line.decode("utf-8", errors="replace")


def tail_scan(spark: SparkSession, paths, n: int) -> DataFrame:
    """``(file, back, byte_pos, value)`` of the last ``n`` terminated lines; see ``tail_lines``."""
    ship_package(spark)
    chunk = 1 << 16

    def from_end(f, size):
        """``(byte_pos, line)`` of the last terminated lines, reading backwards."""
        data, at = b"", size
        while at > 0 and data.count(b"\n") <= n:  # one more newline ends the line before
            step = min(chunk, at)
            at -= step
            f.seek(at)
            data = f.read(step) + data
        lines = data.split(b"\n")[:-1]  # what follows the last newline is not a line yet
        out, pos = [], at
        for line in lines:
            out.append((pos, line))
            pos += len(line) + 1
        return (out if at == 0 else out[1:])[-n:]

    def from_start(stream):
        held, pos = deque(maxlen=n), 0
        for line in stream:
            if line.endswith(b"\n"):
                held.append((pos, line[:-1]))
            pos += len(line)
        return list(held)

    def tail(batches):
        import pyarrow as pa

        for b in batches:
            files, backs, places, values = [], [], [], []
            for path, size in zip(*(c.to_pylist() for c in b.columns)):
                codec = codec_of(_peek(path))
                with _open(path) as raw:
                    found = from_end(raw, size) if codec == "none" else from_start(io.BufferedReader(_decoded(raw, codec)))
                for i, (pos, line) in enumerate(found):
                    files.append(path)
                    backs.append(len(found) - i)
                    places.append(pos)
                    values.append(_text(line))
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(backs, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(values, pa.string())], names=["file", "back", "byte_pos", "value"])

    found = list_files(spark, paths)
    return (found if n > 0 else found.where(F.lit(False))).mapInArrow(
        tail, "file string, back bigint, byte_pos bigint, value string")


def named_codec(path: Column) -> Column:
    """The codec that Spark's reader takes a file's name for."""
    return F.when(path.endswith(".gz"), "gzip").when(path.endswith(".bz2"), "bzip2").otherwise("none")


# Bytes of input per output partition, and lines of one file that stay together in it.
INGEST_BYTES = 128 << 20
INGEST_LINES = 1 << 18


def with_blooms(df: DataFrame):
    """A writer that adds Bloom filters of connections and threads, sized by what a row group holds."""
    writer = df.write.mode("overwrite").option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in {"conn_id", "thread_id"} & set(df.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def write_clustered(parsed: DataFrame, out: str, partitions: int | None = None) -> DataFrame:
    """Write parsed lines as Parquet clustered by ``(file, line_no)`` and read them back.

    Runs of ``INGEST_LINES`` lines of a file go to one output file and are sorted
    there: a huge file is spread over many, and the row groups' line ranges are
    narrow. The runs are a rule on the line number, so no sampling pass is needed.
    Connections and threads get Bloom filters sized by what a row group holds, so a
    filter on one of them skips the row groups without it.
    """
    run = F.floor(F.col("line_no") / INGEST_LINES)
    spread = parsed.repartition(partitions, "file", run) if partitions else parsed.repartition("file", run)
    with_blooms(spread.sortWithinPartitions("file", "line_no")).parquet(out)
    return parsed.sparkSession.read.parquet(out)


def ingest_logs(spark: SparkSession, paths, out: str, fmt: str = "auto", as_of=None, tz=None,
                partitions: int | None = None) -> DataFrame:
    """Read, parse and write the log as Parquet clustered by ``(file, line_no)``.

    Files are read as by ``read_logs(codec="auto")``: plain ones in splits. The
    output has a partition for each ``INGEST_BYTES`` of input, or the session's
    number of shuffle partitions where that is more. Returns the written table.
    """
    from ldaplens.functions.fields import parse_logs
    from ldaplens.sources.text import read_logs

    if partitions is None:
        size = list_files(spark, paths).agg(F.sum("length")).first()[0] or 0
        wanted = -(-size // INGEST_BYTES)
        partitions = wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
    parsed = parse_logs(read_logs(spark, paths, codec="auto"), fmt=fmt, as_of=as_of, tz=tz)
    return write_clustered(parsed, out, partitions)
