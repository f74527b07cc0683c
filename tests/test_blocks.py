"""Parallel decode of compressed files: the same lines as the stdlib decoders, piece by piece."""

import bz2
import gzip
import lzma
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from ldaplens.sources import blocks
from ldaplens.sources.codec import list_files, read_compressed


def _dir():
    return tempfile.mkdtemp(prefix="ldaplens-blocks-")


def _xz(data, step):
    """One stream of several blocks, put together from one-block streams."""
    body, records = b"", b""

    def number(n):
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    n = 0
    for at in range(0, len(data), step):
        one = lzma.compress(data[at : at + step], check=lzma.CHECK_CRC64)
        size = (int.from_bytes(one[-8:-4], "little") + 1) * 4
        index = one[-12 - size : -12]
        unpadded, _ = blocks._number(index, 2)
        body += one[12 : -12 - size]
        records += number(unpadded) + number(len(data[at : at + step]))
        head, flags, n = one[:12], one[-4:-2], n + 1
    index = b"\0" + number(n) + records
    index += bytes(-len(index) % 4)
    index += blocks.zlib.crc32(index).to_bytes(4, "little")
    foot = (len(index) // 4 - 1).to_bytes(4, "little") + flags
    return head + body + index + blocks.zlib.crc32(foot).to_bytes(4, "little") + foot + b"YZ"


def _text(n, seed=3):
    r = random.Random(seed)
    return b"".join(b"conn=%d op=%d " % (i, r.randrange(99)) + r.randbytes(r.randrange(40)).hex().encode()
                    + (b"\r\n" if i % 7 == 0 else b"\n") for i in range(n))


def _lines(data):
    found = data.split(b"\n")
    return [(i, (x[:-1] if x.endswith(b"\r") else x).decode("utf-8", errors="replace"))
            for i, x in enumerate(found[:-1] if not found[-1] else found)]


def _read(spark, d, **kw):
    out = {}
    for r in read_compressed(spark, d, **kw).collect():
        out.setdefault(os.path.basename(r.file), []).append((r.line_no, r.value))
    return {k: sorted(v) for k, v in out.items()}


def test_pieces_give_the_decoders_lines(spark, monkeypatch):
    monkeypatch.setattr(blocks, "RANGE_BYTES", 3000)
    d, data = _dir(), _text(4000)
    cut = len(data) // 3 + 5  # within a line
    files = {
        "xz-blocks": _xz(data, 20_000),
        "xz-streams": lzma.compress(data[:cut]) + bytes(8) + _xz(data[cut:], 30_000),
        "xz-plain": lzma.compress(data),
        "bz-one": bz2.compress(data, 1),
        "bz-streams": bz2.compress(data[:cut], 1) + bz2.compress(b"") + bz2.compress(data[cut:]),
        "gz-one": gzip.compress(data),
        "gz-members": b"".join(gzip.compress(data[i : i + 7001]) for i in range(0, len(data), 7001)) + bytes(5),
        # members kept as they are within a member: headers that are no beginnings
        "gz-nested": gzip.compress(gzip.compress(data[:900]) * 3 + b"\n", 0) + gzip.compress(data),
        "plain": data,
        "no-newline": gzip.compress(b"x" * 5000) + gzip.compress(b"y" * 10) + gzip.compress(b"z"),
        "open-end": gzip.compress(b"a\nb") + gzip.compress(b"c\n\n") + gzip.compress(b"\nd"),
        "empty": b"",
        "empty-gz": gzip.compress(b"") + gzip.compress(b""),
        "empty-bz": bz2.compress(b"") + bz2.compress(b""),
        "empty-xz": lzma.compress(b""),
    }
    plain = {"gz-nested": gzip.compress(data[:900]) * 3 + b"\n" + data, "no-newline": b"x" * 5000 + b"y" * 10 + b"z",
             "open-end": b"a\nbc\n\n\nd"}
    for name, content in files.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(content)
    got = _read(spark, d, whole_bytes=0)
    for name in files:
        want = b"" if name.startswith("empty") else plain.get(name, data)
        assert got.get(name, []) == _lines(want), name
    assert got == _read(spark, d)  # as read whole


def test_a_large_bzip2_block_and_bit_marks(spark):
    d, r = _dir(), random.Random(5)
    data = b"".join(r.randbytes(300).replace(b"\n", b" ") + b"\n" for _ in range(9000))
    with open(f"{d}/b", "wb") as f:
        f.write(bz2.compress(data))
    assert len(blocks.marks(open(f"{d}/b", "rb").read(), blocks.BLOCK_MARK)) > 2
    assert _read(spark, d, whole_bytes=0)["b"] == _lines(data)


def test_four_blocks_are_read_by_four_tasks(spark):
    d, data = _dir(), _text(4000)
    with open(f"{d}/x", "wb") as f:
        f.write(_xz(data, -(-len(data) // 4)))
    pieces, whole = blocks.directory(spark, blocks.codecs(list_files(spark, d)))
    assert pieces.count() == 4 and whole.count() == 0
    tasks = blocks.read_pieces(spark, pieces).where("line_no % 100 = 50").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 4


def test_damage_is_an_error(spark):
    data = _text(3000)
    for content in (gzip.compress(data) + gzip.compress(data)[:-30], gzip.compress(data) * 2 + b"rest",
                    bz2.compress(data * 9, 1)[:-400]):
        d = _dir()
        with open(f"{d}/f", "wb") as f:
            f.write(content)
        with pytest.raises(Exception):
            read_compressed(spark, d, whole_bytes=0).collect()


def test_no_files_of_any_size(spark):
    d = _dir()
    open(f"{d}/e", "wb").close()
    assert read_compressed(spark, d, whole_bytes=0).collect() == []
