"""Log lines derived by Spark from the driver's tables.

The driver's tables hold no directory-server logs, so slapd-shaped lines are
derived from ``events`` (one line per event: ``user_id`` plays the
connection) and literal-search text from ``documents`` (one line per text
line). The derivation is a pure projection, so it scales with the tables and
an independent SQL engine can derive the very same rows for an oracle.

Layout: log files of ``FILE_LINES`` lines each (``slapd-<event_id div FILE_LINES>.log``),
``line_no = event_id % FILE_LINES``: more events make more files, not longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.functions.fields import strip_cr
from ldaplens.operators.joins import sized
from ldaplens.session import ensure_compiled, ensure_parallelism

FILE_LINES = 2500
# Fixed "now" for syslog year inference, so derived syslog lines are reproducible.
SYSLOG_AS_OF = "2024-06-30T00:00:00+00:00"
HEADS = ("debug", "syslog", "rfc3339", "mixed")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lower_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _body(e: Column, u: Column, err: Column) -> Column:
    """The message after the connection marker; six shapes by ``event_id % 6``."""
    k = e % 6
    op = F.concat(F.lit("op="), (e % 50).cast("string"))
    return (
        F.when(k == 0, F.concat(
            F.lit("fd="), (e % 64).cast("string"), F.lit(" ACCEPT from IP=10.0."), (u % 256).cast("string"),
            F.lit("."), (e % 256).cast("string"), F.lit(":"), (1024 + e % 60000).cast("string"),
            F.lit(" (IP=0.0.0.0:389)")))
        .when(k == 1, F.concat(F.lit('op=0 BIND dn="uid=u'), u.cast("string"),
                               F.lit(',ou=People,dc=example" method=128')))
        .when(k == 2, F.concat(op, F.lit(' SRCH base="ou=g'), (u % 7).cast("string"),
                               F.lit(',dc=example" scope=2 deref=0 filter="(uid=u'), u.cast("string"), F.lit(')"')))
        .when(k == 3, F.concat(op, F.lit(" SRCH attr=cn uid mail")))
        .when(k == 4, F.concat(op, F.lit(" SEARCH RESULT tag=101 err="), err,
                               F.lit(" qtime=0.000012 etime=0.000345 nentries="), (e % 20).cast("string"),
                               F.lit(" text=")))
        .otherwise(F.concat(op, F.lit(" UNBIND")))
    )


def event_log_lines(events: DataFrame, head: str = "debug") -> DataFrame:
    """``(file, line_no, value)``: one slapd-shaped line per event.

    ``head`` picks the timestamp shape: ``debug`` (hex epoch + thread),
    ``syslog`` (``Mon dd HH:MM:SS host slapd[pid]:``), ``rfc3339`` (+ thread),
    or ``mixed`` (the three by ``event_id % 3``).
    """
    if head not in HEADS:
        raise ValueError(f"head must be one of {HEADS}")
    e = F.col("event_id")
    u = F.col("user_id")
    # epoch microseconds of a TIMESTAMP_NTZ, independent of the session zone
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
    err = F.when(F.col("event_type") == "error", F.lit("49")).otherwise(F.lit("0"))
    thread = F.concat(F.lit("0x7f"), F.lpad(_lower_hex(u), 10, "0"))
    tail = F.concat(F.lit(" conn="), u.cast("string"), F.lit(" "), _body(e, u, err))
    debug = F.concat(
        _lower_hex(F.floor(us / 1000000).cast("bigint")), F.lit("."),
        F.lpad(_lower_hex((us % 1000000).cast("bigint")), 5, "0"), F.lit(" "), thread, tail)
    syslog = F.concat(
        F.date_format(F.col("ts"), "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.lit(" "), F.date_format(F.col("ts"), "HH:mm:ss"),
        F.lit(" ldap"), (u % 3).cast("string"), F.lit(" slapd["), (100 + u % 5).cast("string"), F.lit("]:"), tail)
    rfc = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "), thread, tail)
    value = {"debug": debug, "syslog": syslog, "rfc3339": rfc}.get(head)
    if value is None:
        value = F.when(e % 3 == 0, debug).when(e % 3 == 1, syslog).otherwise(rfc)
    return events.select(
        F.concat(F.lit("slapd-"), F.floor(e / FILE_LINES).cast("string"), F.lit(".log")).alias("file"),
        (e % FILE_LINES).cast("bigint").alias("line_no"),
        value.alias("value"),
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """``(file, line_no, value)``: every ``\\n``-separated line of every document.

    One trailing CR is dropped per line, as a text reader would.
    """
    exploded = documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "value"),
    )
    return exploded.select("file", F.col("line_no").cast("bigint").alias("line_no"), strip_cr("value").alias("value"))


def event_logs(spark: SparkSession, sf_dir: str, head: str = "debug") -> DataFrame:
    ensure_compiled(spark)
    return ensure_parallelism(event_log_lines(load(spark, sf_dir, "events"), head))


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_parallelism(document_lines(load(spark, sf_dir, "documents")))


# ------------------------------------------------------------ file fixtures
def _create(path: str, mode: str = "wb"):
    """Writable binary stream for a local or pyarrow-reachable path (``ab`` appends)."""
    if path.startswith("file:"):
        path = path[5:]
    if "://" not in path:
        import os

        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(path)
    if mode == "ab":
        return filesystem.open_append_stream(inner)
    return filesystem.open_output_stream(inner)


class _MemberWriter:
    """Streams lines into ``codec`` members of at most ``member_lines`` lines each."""

    def __init__(self, raw, codec: str, member_lines: int):
        self.raw, self.codec, self.member_lines = raw, codec, member_lines
        self.enc, self.in_member = None, 0

    def _encoder(self):
        import bz2
        import zlib
        import lzma

        if self.codec == "gzip":
            return zlib.compressobj(6, zlib.DEFLATED, 31)
        if self.codec == "bzip2":
            return bz2.BZ2Compressor()
        return lzma.LZMACompressor(format=lzma.FORMAT_XZ)

    def write(self, data: bytes) -> None:
        if self.codec == "none":
            self.raw.write(data)
            return
        if self.enc is None:
            self.enc, self.in_member = self._encoder(), 0
        self.raw.write(self.enc.compress(data))
        self.in_member += 1
        if self.in_member >= self.member_lines:
            self.close_member()

    def close_member(self) -> None:
        if self.enc is not None:
            self.raw.write(self.enc.flush())
            self.enc = None


def write_log_files(lines: DataFrame, out_dir: str, codec=lambda name: "none", crlf=lambda name: False,
                    unterminated=lambda name: False, member_lines: int = 1000, append: bool = False) -> DataFrame:
    """Write ``(file, line_no, value)`` as real log files under ``out_dir``.

    One task writes each file (a file is one ordered byte stream), streaming
    line by line; files are spread over tasks by hash. ``codec`` gives for a file
    name ``none``, ``gzip``, ``bzip2`` or ``xz`` (content only: names are
    kept as given, so a compressed file can be misnamed on purpose);
    compressed files are written as concatenated members of ``member_lines``
    lines (multi-member gzip, multi-stream bzip2, concatenated xz). Files for which
    ``crlf`` holds end lines with CR LF; those for which ``unterminated`` holds have no
    final newline. ``append`` adds to existing files (a growing log) instead of
    replacing them. Returns ``(file, path, n_lines)``.
    """
    base = out_dir.rstrip("/")

    def write(batches):
        import pandas as pd

        done = []
        state = {"name": None, "out": None, "writer": None, "count": 0, "pending": None}

        def close():
            if state["name"] is None:
                return
            name, w = state["name"], state["writer"]
            if state["pending"] is not None:  # the last line: newline unless unterminated
                eol = b"" if unterminated(name) else (b"\r\n" if crlf(name) else b"\n")
                w.write(state["pending"] + eol)
            w.close_member()
            state["out"].close()
            done.append((name, f"{base}/{name}", state["count"]))

        for pdf in batches:
            for name, value in zip(pdf["file"], pdf["value"]):
                if name != state["name"]:
                    close()
                    out = _create(f"{base}/{name}", "ab" if append else "wb")
                    state.update(name=name, out=out, count=0, pending=None,
                                 writer=_MemberWriter(out, codec(name), member_lines))
                if state["pending"] is not None:
                    state["writer"].write(state["pending"] + (b"\r\n" if crlf(name) else b"\n"))
                state["pending"] = value.encode("utf-8")
                state["count"] += 1
        close()
        yield pd.DataFrame(done, columns=["file", "path", "n_lines"])

    written = (lines.repartition("file").sortWithinPartitions("file", "line_no")
               .mapInPandas(write, "file string, path string, n_lines long"))
    return sized(written, "written")


def basename(col: str = "file") -> Column:
    return F.element_at(F.split(F.col(col), "/"), -1)
