"""Operator 7: WARC archives compressed record by record with a dictionary of their own records.

Every archive with a record starts with a skippable frame that holds a Zstandard dictionary built from
the archive's first records; every record is one frame compressed with it. Payloads that occur several times are
written once, as the response with the largest page id; the other pages revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common
from ldaplens.session import scratch_path

# fixed values of the formats
DICT_FRAME = 0x184D2A5D  # magic number of the skippable frame that holds the dictionary
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Sample for the dictionary: an archive's first records, up to so many bytes; and its size.
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
#: Stretches that fewer records than this are cut into for training.
PIECE_BYTES = 256
PIECE_RECORDS = 64
#: Uncompressed bytes of an archive, after which the next one is begun.
ARCHIVE_BYTES = 64 << 20

FILES = "file string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """The bytes of one record. Line breaks and other controls in a URL are percent-encoded."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(sample: list[bytes]):
    """A dictionary from the sample, None only where there are no records: trained on the records, or on
    stretches of them where they are too few, or else the first of their bytes as they are."""
    import zstandard

    size = sum(map(len, sample)) // 8
    pieces = [r[i : i + PIECE_BYTES] for r in sample for i in range(0, len(r), PIECE_BYTES)] if len(sample) < PIECE_RECORDS else sample
    for part in (sample, pieces):
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, size), part, dict_id=1)
        except (zstandard.ZstdError, ValueError):
            continue
    content = b"".join(sample)[: max(8, min(DICT_BYTES, size))]  # begins as a record does, not as a trained dictionary
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None


def save(uri: str, records) -> tuple[int, int]:
    """Write one archive; returns its records and bytes. ``records`` is read as it is written, but
    for the sample, which is held until the dictionary is built."""
    import zstandard

    from ldaplens.llm.store import publish

    done = [0, 0]

    def write(out):
        rest, sample, size = iter(records), [], 0
        for r in rest:
            sample.append(r)
            size += len(r)
            if size >= SAMPLE_BYTES:
                break
        words = dictionary(sample)
        if words is not None:
            content = words.as_bytes()
            done[1] += out.write(struct.pack("<II", DICT_FRAME, len(content)) + content)
        squeeze = zstandard.ZstdCompressor(dict_data=words) if words is not None else zstandard.ZstdCompressor()
        for part in (sample, rest):
            for r in part:
                done[0] += 1
                done[1] += out.write(squeeze.compress(r))

    publish(uri, write)
    return done[0], done[1]


def load(uri: str):
    """``(fields, block)`` of an archive's records, read as a stream."""
    import zstandard

    from ldaplens.llm.store import opened

    place, path = opened(uri)
    with place.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        words, lead = None, head
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_FRAME:
            words, lead = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", head)[1])), b""

        class Joined(io.RawIOBase):
            """What was read ahead, then the rest of the file."""

            def readable(self):
                return True

            def readinto(self, into):
                nonlocal lead
                got = lead[: len(into)] if lead else f.read(len(into))
                lead = lead[len(got) :] if lead else b""
                into[: len(got)] = got
                return len(got)

        plain = zstandard.ZstdDecompressor(dict_data=words) if words is not None else zstandard.ZstdDecompressor()
        with plain.stream_reader(Joined(), read_across_frames=True) as stream:
            lines = io.BufferedReader(stream, 1 << 18)
            while first := lines.readline():
                if first.strip() != VERSION:
                    raise ValueError(f"{uri}: not at the start of a record: {first[:40]!r}")
                fields = {}
                while line := lines.readline().rstrip(b"\r\n"):
                    k, _, v = line.decode().partition(": ")
                    fields[k] = v
                block = lines.read(int(fields["Content-Length"]))
                if len(block) != int(fields["Content-Length"]) or lines.read(4) != b"\r\n\r\n":
                    raise ValueError(f"{uri}: a record ends early")
                yield fields, block


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, refers_to`` of the pages that revisit another: of equal payloads of at least
    ``least`` bytes, all but the largest page id. Only ids and digests are shuffled. Rows without
    an id, or with the largest one repeated, are responses."""
    slim = pages.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("size")).where((F.col("size") >= least) & F.col("page_id").isNotNull())
    groups = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    return slim.join(groups, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, root: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row of ``pages`` to archives under ``root`` (default: a new folder in the shared
    folder) and return ``file, records, bytes``, one row for each archive.

    Each task writes the archives of its partition; a task that runs again writes the same files.
    Null html is an empty payload, a null URL leaves its field out, a null id gives an unnamed
    record. Repeated rows are written each; an empty table gives no archive; other columns are ignored.
    The revisits are written first, so the planner broadcasts them only if their size allows.
    """
    spark = pages.sparkSession
    common.python_ready(spark)
    root = root or scratch_path(spark, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    back = common.written(revisits(slim, least), "revisits").withColumnRenamed("page_id", "other")
    sent = slim.join(back, (F.col("page_id") == F.col("other")) & (F.sha2("html", 256) == F.col("sha")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches):
        from pyspark import TaskContext

        from ldaplens.llm.warc import record, save

        part = TaskContext.get().partitionId()
        rows = (record(i, u, h.encode(), r, date) for b in batches for i, u, h, r in zip(*(c.to_pylist() for c in b.columns)))
        number, held = 0, next(rows, None)
        while held is not None:
            def archive():
                nonlocal held
                size = 0
                while held is not None and size < ARCHIVE_BYTES:
                    size += len(held)
                    yield held
                    held = next(rows, None)

            uri = f"{root}/{part:06d}-{number:04d}.warc.zst"
            n, size = save(uri, archive())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return common.written(sent.mapInArrow(write, FILES), "warc-files")


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives, one task for a file: ``page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, payload`` (without the last unless ``payload``).

    The digest of every response is computed anew; one that differs from its field is an error. A
    revisit gives length and digest of the full payload, and no content.
    """
    common.python_ready(files.sparkSession)
    schema = RECORDS if payload else RECORDS.rpartition(",")[0]

    def read(batches):
        from ldaplens.llm.warc import digest, load

        number = lambda name: int(x) if name and (x := name[len("<urn:x-page:") : -1]) else None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 7 if payload else 6]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"][: len(kinds)]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows, size = [], 0
                for fields, block in load(uri):
                    head, _, content = block.partition(b"\r\n\r\n")
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(content) != said:
                        raise ValueError(f"{uri}: the payload of {fields['WARC-Record-ID']} does not have its digest")
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    row = (number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")), length, said, None if revisit else content)
                    rows.append(row[: len(kinds)])
                    size += len(content) if payload else 0
                    if len(rows) >= 1000 or size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, min(files.count(), 20_000))  # tasks, not files: a task may read several
    return files.select("file").repartition(n, "file").mapInArrow(read, schema)
