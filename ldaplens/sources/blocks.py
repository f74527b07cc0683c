"""Parallel decode of large compressed files (S3): block directories and stitched line edges.

A compressed file is a chain of pieces that can be decoded by themselves: xz blocks, bzip2 blocks, gzip
members, and for plain files any byte range. ``directory`` finds them with Spark tasks:

* **xz**: the indexes at the end of its streams name every block; only they are read.
* **bzip2**: blocks begin with a 48-bit mark at any bit. Tasks look for it in byte ranges.
* **gzip**: members begin with a header that may also occur by chance. Tasks look for it in byte ranges.

Each found place is decoded once by a task of its own, which checks the piece's checksum and tells where
it ends, how many newlines it holds and the text before its first and after its last newline. A walk over
the places of a file in order then keeps those that begin where the one before ended, so a mark or header
that occurs by chance is never taken for a piece, and gives each its first line number. The directory is
written to the shared folder: one row for a piece.

``read_pieces`` decodes the pieces once more, in parallel, for the lines that lie within one piece. Lines
that cross edges are put together from the directory alone, grouped by their number.

A damaged piece, or bytes between pieces that belong to none, raise an error. An empty file has no lines.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.operators.joins import sized
from ldaplens.session import ship_package
from ldaplens.sources.codec import BATCH_LINES, BZIP2_MAGIC, GZIP_MAGIC, XZ_MAGIC, _open, _text, codec_of

# Fixed values of the formats: bzip2's marks of a block and of a stream's end (48 bits each).
BLOCK_MARK = 0x314159265359
END_MARK = 0x177245385090

#: Bytes of a file that one task searches for marks, and of a plain file's piece.
RANGE_BYTES = 16 << 20
#: Compressed bytes of one decode task; pieces larger than that have a task each.
TASK_BYTES = 16 << 20
_CHUNK = 1 << 20

PLACES = "file string, codec string, size bigint, start bigint, stop bigint, flags int"
FACTS = PLACES + ", next bigint, newlines bigint, head binary, tail binary, error string"
PIECES = PLACES + ", base bigint, newlines bigint, head binary, tail binary"
LINES = "file string, line_no bigint, value string, codec string"


def _batch(rows: list, schema: str):
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


# ------------------------------------------------------------------ places
def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length integer of the xz format and the place after it."""
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 0x80:
            return value, at


def xz_blocks(f, size: int):
    """``(start, stop, flags)`` of a file's blocks, from its streams' indexes read backwards; None
    where the bytes do not end in a whole stream."""
    out, end = [], size
    while end > 0:
        if end < 32:
            return None
        f.seek(end - 12)
        foot = f.read(12)
        if foot[8:] == bytes(4):  # padding between streams
            end -= 4
            continue
        crc, words = struct.unpack("<II", foot[:8])
        length = 4 * (words + 1)
        if foot[10:] != b"YZ" or zlib.crc32(foot[4:10]) != crc or length + 24 > end:
            return None
        f.seek(end - 12 - length)
        index = f.read(length)
        if index[0] or zlib.crc32(index[:-4]) != struct.unpack("<I", index[-4:])[0]:
            return None
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            unpadded, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append(-(-unpadded // 4) * 4)
        flags = int.from_bytes(foot[8:10], "big")
        start = end - 12 - length - sum(sizes)
        head = max(start - 12, 0)
        f.seek(head)
        if start < 12 or f.read(12) != _xz_head(flags):
            return None
        blocks = []
        for s in sizes:
            blocks.append((start, start + s, flags))
            start += s
        out[:0], end = blocks, head
    return out


def _xz_head(flags: int) -> bytes:
    kind = flags.to_bytes(2, "big")
    return XZ_MAGIC + kind + struct.pack("<I", zlib.crc32(kind))


def marks(data: bytes, mark: int):
    """Bit places of a 48-bit mark in ``data``, at any bit."""
    out = []
    for shift in range(8):
        word = (mark << (8 - shift) % 8).to_bytes(7 if shift else 6, "big")
        core = word[1:6]  # whole bytes; the outer ones hold only a part of the mark
        first, last = (0xFF >> shift, 0xFF << (8 - shift) & 0xFF) if shift else (0xFF, None)
        at = data.find(core)
        while at >= 0:
            if at and data[at - 1] & first == word[0] and (
                    last is None or at + 5 < len(data) and data[at + 5] & last == word[6]):
                out.append((at - 1) * 8 + shift)
            at = data.find(core, at + 1)
    return sorted(out)


def headers(data: bytes):
    """Places where a gzip member may begin."""
    out, at = [], data.find(GZIP_MAGIC + b"\x08")
    while at >= 0:
        if at + 3 < len(data) and not data[at + 3] & 0xE0:
            out.append(at)
        at = data.find(GZIP_MAGIC + b"\x08", at + 1)
    return out


def _bits(f, start: int, stop: int) -> int:
    f.seek(start // 8)
    data = f.read(-(-stop // 8) - start // 8)
    value = int.from_bytes(data, "big") >> (-stop % 8)
    return value & ((1 << (stop - start)) - 1)


def _bzip2_next(f, at: int, size: int) -> int:
    """Bit place of the first block of the stream at byte ``at``, empty streams skipped; the file's end
    where none follows (what is not a stream there is ignored, as the decoder does)."""
    while True:
        f.seek(at)
        head = f.read(10)
        if len(head) < 10 or head[:3] != BZIP2_MAGIC or not 0x31 <= head[3] <= 0x39:
            return size * 8
        mark = int.from_bytes(head[4:], "big")
        if mark != END_MARK:
            return (at + 4) * 8
        at += 14


# ------------------------------------------------------------------ decoding
def _xz_chunks(f, start, stop, flags):
    dec = lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
    dec.decompress(_xz_head(flags))
    f.seek(start)
    left = stop - start
    while left or not dec.needs_input:
        data = f.read(min(_CHUNK, left)) if dec.needs_input else b""
        if dec.needs_input and not data:
            raise EOFError("an xz block ends early")
        left -= len(data)
        out = dec.decompress(data, _CHUNK)
        if out:
            yield out


def _bzip2_chunks(f, start, stop):
    """One block as a stream of its own: header, the block's bits, end mark and checksum."""
    n = stop - start
    body = _bits(f, start, stop)
    crc = body >> (n - 80) & 0xFFFFFFFF
    whole = (body << 80) | (END_MARK << 32) | crc
    pad = -(n + 80) % 8
    data = BZIP2_MAGIC + b"9" + (whole << pad).to_bytes((n + 80 + pad) // 8, "big")
    yield bz2.decompress(data)


def _gzip_chunks(f, start, end_at: list):
    """A member's bytes; its end is put into ``end_at``."""
    dec = zlib.decompressobj(31)
    f.seek(start)
    data = b""
    while not dec.eof:
        data = dec.unconsumed_tail or f.read(_CHUNK)
        if not data:
            out = dec.flush()
            if not dec.eof:
                raise EOFError("a gzip member ends early")
        else:
            out = dec.decompress(data, _CHUNK)
        if out:
            yield out
    end_at.append(f.tell() - len(dec.unused_data))


def _plain_chunks(f, start, stop):
    f.seek(start)
    while start < stop:
        data = f.read(min(_CHUNK, stop - start))
        if not data:
            raise EOFError("a file became shorter while it was read")
        start += len(data)
        yield data


def _chunks(f, codec, start, stop, flags):
    if codec == "xz":
        return _xz_chunks(f, start, stop, flags)
    if codec == "bzip2":
        return _bzip2_chunks(f, start, stop)
    if codec == "gzip":
        return _gzip_chunks(f, start, [])
    return _plain_chunks(f, start, stop)


def edges(chunks):
    """``(newlines, head, tail)``: the text before the first newline and after the last one."""
    newlines, head, tail = 0, [], []
    for c in chunks:
        n = c.count(b"\n")
        if not n:
            (tail if newlines else head).append(c)
            continue
        if not newlines:
            head.append(c[: c.find(b"\n")])
        newlines += n
        tail = [c[c.rfind(b"\n") + 1 :]]
    return newlines, b"".join(head), b"".join(tail)


def _bzip2_facts(f, start, size):
    """A block ends at the first mark after which its checksum agrees."""
    found, at, step = [], start // 8, _CHUNK
    error = ValueError("no end of a bzip2 block")
    while at < size:
        f.seek(at)
        data = f.read(step + 8)
        block = set(marks(data, BLOCK_MARK))
        found = sorted((at * 8 + m, m in block) for m in (*block, *marks(data, END_MARK))
                       if at * 8 + m > start and m < step * 8)
        for stop, goes_on in found:
            try:
                facts = edges(_bzip2_chunks(f, start, stop))
            except (OSError, ValueError) as e:
                error = e
                continue
            return stop, stop if goes_on else _bzip2_next(f, -(-(stop + 80) // 8), size), facts
        at += step
    raise error


def _gzip_facts(f, start, size):
    end = []
    facts = edges(_gzip_chunks(f, start, end))
    at = end[0]
    f.seek(at)
    while True:  # zero bytes may follow a member
        data = f.read(_CHUNK)
        rest = data.lstrip(b"\0")
        at += len(data) - len(rest)
        if rest or not data:
            return end[0], at, facts


# ------------------------------------------------------------------ the directory
def _search(batches):
    """Places of pieces in byte ranges; rows of known pieces pass."""
    for b in batches:
        out = []
        for file, codec, size, start, stop, flags in zip(*(c.to_pylist() for c in b.columns)):
            if codec not in ("gzip", "bzip2"):
                out.append((file, codec, size, start, stop, flags))
                continue
            with _open(file) as f:
                f.seek(start)
                data = f.read(stop - start + 7)  # the last mark may begin at the range's last bit
            if codec == "gzip":
                out += [(file, codec, size, start + at, -1, 0) for at in headers(data) if start + at < stop]
            else:
                # a mark found from the next range's first byte on belongs to that range
                out += [(file, codec, size, start * 8 + at, -1, 0) for at in marks(data, BLOCK_MARK) if start * 8 + at < stop * 8]
        yield _batch(out, PLACES)


def _ranges(batches):
    """xz blocks of whole files; byte ranges of all others."""
    for b in batches:
        out = []
        for file, codec, size in zip(*(c.to_pylist() for c in b.columns)):
            if codec == "xz":
                with _open(file) as f:
                    found = xz_blocks(f, size)
                if found is None:
                    out.append((file, "none", size, -1, -1, 0))
                else:
                    out += [(file, codec, size, *block) for block in found]
            else:
                out += [(file, codec, size, at, min(at + RANGE_BYTES, size), 0) for at in range(0, size, RANGE_BYTES)]
        yield _batch(out, PLACES)


def _facts(batches):
    for b in batches:
        for file, codec, size, start, stop, flags in zip(*(c.to_pylist() for c in b.columns)):
            follows, facts, error = -1, (0, b"", b""), None
            with _open(file) as f:
                if codec == "gzip" or codec == "bzip2":
                    try:
                        stop, follows, facts = (_gzip_facts if codec == "gzip" else _bzip2_facts)(f, start, size)
                    except (zlib.error, OSError, EOFError, ValueError) as e:
                        error = str(e)
                else:
                    facts = edges(_chunks(f, codec, start, stop, flags))
            yield _batch([(file, codec, size, start, stop, flags, follows, *facts, error)], FACTS)


def _walk(batches):
    """Keep the places that begin where the piece before ended; number lines. Rows come by file and start."""
    now, want, base, end, codec = None, None, 0, 0, None

    def whole():
        if now is not None and codec in ("gzip", "bzip2") and want != end:
            raise ValueError(f"{now}: no {codec} piece at {want}")

    for b in batches:
        out = []
        for row in b.to_pylist():
            if row["file"] != now:
                whole()
                now, codec, base = row["file"], row["codec"], 0
                end = row["size"] * (8 if codec == "bzip2" else 1)
                want = 0
                if codec == "bzip2":
                    with _open(now) as f:
                        want = _bzip2_next(f, 0, row["size"])
            if codec in ("gzip", "bzip2"):
                if row["start"] < want:
                    continue  # looks like a beginning, within a piece
                if row["start"] > want or row["error"] is not None:
                    raise ValueError(f"{now}: no {codec} piece at {want}: {row['error']}")
                want = row["next"]
            out.append((*(row[k] for k in ("file", "codec", "size", "start", "stop", "flags")), base,
                        row["newlines"], row["head"], row["tail"]))
            base += row["newlines"]
        yield _batch(out, PIECES)
    whole()


def _spread(df: DataFrame, total: int, rows: int) -> DataFrame:
    """As many tasks as the bytes ask for, one row each at the least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, max(cores, -(-total // TASK_BYTES)))))


def directory(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pieces, whole)`` of ``files`` ``(file, codec, length)``: the written directory, and the files
    ``(file)`` that are one piece, or not whole streams, and go to one task each.

    Two tables of one row for a piece are written; nothing of them comes to the driver but their size.
    """
    ship_package(spark)
    ranges = sized(files.select("file", "codec", "length").mapInArrow(_ranges, PLACES), "ranges")
    known = ranges.agg(F.count(F.lit(1)), F.sum(F.when(F.col("start") >= 0, F.col("stop") - F.col("start")))).first()
    if not known[0]:
        return spark.createDataFrame([], PIECES), files.select("file").where(F.lit(False))
    total = known[1] or 0
    places = sized(_spread(ranges.where("start >= 0"), total, known[0]).mapInArrow(_search, PLACES), "places")
    counts = places.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    several = counts.where("n > 1").select("file")
    whole = files.join(several, "file", "left_anti").where("length > 0").select("file")
    mine = places.join(several, "file", "left_semi")
    facts = _spread(mine, total, max(1, places.count())).mapInArrow(_facts, FACTS)
    pieces = facts.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_walk, PIECES)
    return sized(pieces, "pieces"), whole


# ------------------------------------------------------------------ lines
def _inner(batches):
    """The lines that begin and end within one piece."""
    for b in batches:
        for file, codec, start, stop, flags, base, newlines in zip(*(c.to_pylist() for c in b.columns)):
            out, rest, number, skipped = [], [], base + 1, False
            with _open(file) as f:
                for c in _chunks(f, codec, start, stop, flags):
                    if not skipped:
                        at = c.find(b"\n")
                        if at < 0:
                            continue
                        c, skipped = c[at + 1 :], True
                    *lines, last = c.split(b"\n")
                    if not lines:
                        rest.append(last)
                        continue
                    lines[0], rest = b"".join((*rest, lines[0])), [last]
                    for line in lines:
                        out.append((file, number, _text(line), codec))
                        number += 1
                        if len(out) >= BATCH_LINES:
                            yield _batch(out, LINES)
                            out = []
            if number != base + newlines:
                raise ValueError(f"{file} changed while it was read")
            yield _batch(out, LINES)


def _joined(batches):
    for b in batches:
        yield _batch([(file, number, _text(b"".join(parts)), codec)
                      for file, number, codec, parts in zip(*(c.to_pylist() for c in b.columns))], LINES)


def read_pieces(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """``(file, line_no, value, codec)`` of the files of a directory, decoded piece by piece in parallel."""
    known = pieces.where("newlines > 1").agg(
        F.count(F.lit(1)), F.sum((F.col("stop") - F.col("start")) / F.when(F.col("codec") == "bzip2", 8).otherwise(1))).first()
    inner = _spread(pieces.where("newlines > 1").select("file", "codec", "start", "stop", "flags", "base", "newlines"),
                    int(known[1] or 0), max(1, known[0])).mapInArrow(_inner, LINES)
    one = F.lit(1) == 1
    fragments = pieces.select("file", "codec", "start", F.explode(F.array(
        F.struct(F.col("base").alias("line_no"), F.col("head").alias("part"), (F.col("newlines") > 0).alias("ended"), one.alias("is")),
        F.struct((F.col("base") + F.col("newlines")).alias("line_no"), F.col("tail").alias("part"), F.lit(False).alias("ended"),
                 (F.col("newlines") > 0).alias("is")))).alias("x")).select("file", "codec", "start", "x.*").where("is")
    # the tail of one piece and the heads of the next ones carry the same number
    crossing = fragments.groupBy("file", "line_no").agg(
        F.first("codec").alias("codec"), F.max("ended").alias("ended"), F.sum(F.length("part")).alias("size"),
        F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"),
    ).where("ended OR size > 0").select("file", "line_no", "codec", F.col("parts.part").alias("parts"))
    return inner.union(crossing.mapInArrow(_joined, LINES))


def codecs(files: DataFrame) -> DataFrame:
    """``(file, codec, length)`` of ``(path, length)``, by the files' first bytes."""
    def peek(batches):
        for b in batches:
            out = []
            for path, length in zip(*(c.to_pylist() for c in b.columns)):
                with _open(path) as f:
                    out.append((path, codec_of(f.read(6)), length))
            yield _batch(out, "file string, codec string, length bigint")

    return files.mapInArrow(peek, "file string, codec string, length bigint")
