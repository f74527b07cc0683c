"""Follow growing log files with Structured Streaming.

Spark's stock file stream tracks files by name and never re-reads a file
that grows, so following a live log needs its own source. ``ldaplens_follow``
is a Python streaming data source:

* the offset holds one entry per followed stream of lines, keyed
  ``<name>#<generation>``: where its bytes are now, their identity, and ``pos``,
  always just after a newline -- a partial last line is held back until its
  newline arrives;
* the first offset starts ``tail`` complete lines before the end (a viewer
  shows the last lines first), every later batch reads
  ``[previous pos, latest pos)`` -- each completed line exactly once, also
  across restarts, since Spark logs both offsets before the batch runs;
* an entry is found again by identity (inode and birth, and a chain of digests of what
  was read, see ``identity``). A renamed file is read on where it is now, and its
  new name is not taken for a new file; a file that was copied and truncated is
  read on in the copy;
* what then stands under the name starts a new generation, read from byte 0, also
  when it begins like the old file; a missing file keeps its offset until it is back;
* a file untouched since the last look (same size and time of change) costs one
  ``stat``: nothing of it is read.

Each batch has input partitions of at most ``SPLIT_BYTES`` new bytes; executors
read them as Arrow batches of ``(file, generation, byte_pos, value)`` with one
trailing CR removed per line.
"""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ldaplens.sources.codec import codec_of
from ldaplens.streaming.identity import COPY, SAME, decide, extend, look

SCHEMA = "file string, generation int, byte_pos bigint, value string"
DEFAULT_TAIL = 10
_CHUNK = 1 << 16
BATCH_LINES = 8192


def _local(path: str) -> str:
    """The local form of a path or ``file:`` URI; other URIs cannot be followed."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"only paths of a mounted file system can be followed, not {path}")
    return path


def _last_newline_end(path: str, size: int, floor: int) -> int:
    """Position just after the last newline in ``[floor, size)``, else ``floor``."""
    with open(path, "rb") as f:
        end = size
        while end > floor:
            start = max(floor, end - _CHUNK)
            f.seek(start)
            buf = f.read(end - start)
            i = buf.rfind(b"\n")
            if i >= 0:
                return start + i + 1
            end = start
    return floor


def _tail_start(path: str, end: int, n: int) -> int:
    """Start of the ``n``-th complete line before ``end`` (0 when fewer lines)."""
    if n <= 0 or end <= 0:
        return end
    seen = 0
    with open(path, "rb") as f:
        pos = end - 1  # byte end-1 is the newline closing the last complete line
        while pos > 0:
            start = max(0, pos - _CHUNK)
            f.seek(start)
            buf = f.read(pos - start)
            i = len(buf)
            while True:
                i = buf.rfind(b"\n", 0, i)
                if i < 0:
                    break
                seen += 1
                if seen == n:
                    return start + i + 1
            pos = start
    return 0


# New bytes of one file are cut into splits of this size; each split emits the
# lines that start inside it, so a big append is read by many tasks.
SPLIT_BYTES = 64 << 20


class _Range(InputPartition):
    """Lines starting in ``[start, end)`` of one file; ``first`` is where the batch
    range begins (a line start), ``last`` where it ends (after a newline)."""

    def __init__(self, entry: dict, first: int, start: int, end: int, last: int):
        super().__init__((entry["name"], entry["gen"], start, end))
        self.name, self.generation, self.at, self.id = entry["name"], entry["gen"], entry["at"], entry["id"]
        self.first, self.start, self.end, self.last = first, start, end, last


def _logged_offset(checkpoint: str | None) -> dict | None:
    """This source's part of the last offset that Spark logged in ``checkpoint``."""
    if not checkpoint:
        return None
    from pyarrow import fs as pafs

    place, root = pafs.FileSystem.from_uri(checkpoint if "://" in checkpoint else "file://" + _local(checkpoint))
    logged = place.get_file_info(pafs.FileSelector(f"{root.rstrip('/')}/offsets", allow_not_found=True))
    batches = sorted((int(f.base_name), f.path) for f in logged if f.base_name.isdigit())
    if not batches:
        return None
    with place.open_input_stream(batches[-1][1]) as f:
        for line in f.read().decode().splitlines():
            if line.startswith("{") and "files" in (offset := json.loads(line)):
                return offset
    return None


class FollowReader(DataSourceStreamReader):
    """Offsets: ``{"files": {"<name>#<gen>": {"name", "gen", "at", "id", "size", "mtime", "chain",
    "pos", "from"}}}``; ``id``, ``size`` and ``mtime`` are as last seen, ``chain`` holds the digests of
    the bytes before ``pos``, ``from`` is where the entry's output begins."""

    def __init__(self, options):
        self.pattern = _local(options["path"])
        self.tail = int(options.get("tail", DEFAULT_TAIL))
        self.checkpoint = options.get("checkpoint")
        self._last = None

    def _files(self) -> list[str]:
        p = os.path.join(self.pattern, "*") if os.path.isdir(self.pattern) else self.pattern
        return sorted(f for f in glob.glob(p) if os.path.isfile(f))

    @staticmethod
    def _plain(path: str) -> bool:
        """Rotated files that were compressed hold nothing new to follow."""
        try:
            with open(path, "rb") as f:
                return codec_of(f.read(6)) == "none"
        except OSError:
            return False

    def initialOffset(self) -> dict:
        out = {}
        for f in self._files():
            seen = look(f)
            if seen and self._plain(f):
                end = _last_newline_end(f, seen["size"], 0)
                start = _tail_start(f, end, self.tail)  # the first batch reads the tail
                out[f"{f}#0"] = {"name": f, "gen": 0, "at": f, **seen, "chain": extend({}, f, end), "pos": start, "from": start}
        return {"files": out}

    def latestOffset(self) -> dict:
        base = self._last or _logged_offset(self.checkpoint) or self.initialOffset()
        entries = {k: dict(e) for k, e in base["files"].items()}
        followed = self._files()
        folders = {os.path.dirname(p) for p in [*followed, *(e["at"] for e in entries.values())]}
        paths = sorted({*followed, *(f for d in folders for f in glob.glob(os.path.join(glob.escape(d), "*")))})
        seen = {p: x for p in paths if (x := look(p))}
        by_id = {x["id"]: p for p, x in seen.items()}
        claimed: dict[str, str] = {}
        for key, e in entries.items():  # the same file, wherever it is now
            p = by_id.get(e["id"])
            if p is not None and decide(e, p, seen[p]) == SAME:
                claimed[p] = key
        for key, e in entries.items():  # else a copy of it
            if key not in claimed.values():
                p = next((p for p in seen if p not in claimed and decide(e, p, seen[p]) == COPY), None)
                if p is not None:
                    claimed[p] = key
        for p in followed:
            if p in seen and p not in claimed and self._plain(p):
                gens = [e["gen"] for e in entries.values() if e["name"] == p]
                gen = max(gens) + 1 if gens else 0
                key = f"{p}#{gen}"
                entries[key] = {"name": p, "gen": gen, "at": p, "id": seen[p]["id"], "size": -1, "mtime": -1,
                                "chain": extend({}, p, 0), "pos": 0, "from": 0}
                claimed[p] = key
        for p, key in claimed.items():
            e, x = entries[key], seen[p]
            if (e["id"], e["size"], e["mtime"]) != (x["id"], x["size"], x["mtime"]):
                e["pos"] = _last_newline_end(p, x["size"], max(e["pos"], e["chain"]["pos"]))
                if e["pos"] != e["chain"]["pos"]:
                    e["chain"] = extend(e["chain"], p, e["pos"])
            else:
                e["pos"] = max(e["pos"], e["chain"]["pos"])  # the first look starts a tail before the chain's end
            e.update(x, at=p)
        newest = {}
        for e in entries.values():
            newest[e["name"]] = max(e["gen"], newest.get(e["name"], 0))
        # a generation that is gone and has a successor will not come back
        kept = {k: e for k, e in entries.items() if k in claimed.values() or e["gen"] == newest[e["name"]]}
        self._last = {"files": kept}
        return self._last

    def partitions(self, start: dict, end: dict):
        parts = []
        before = start.get("files", {})
        for key, e in end.get("files", {}).items():
            lo, hi = before[key]["pos"] if key in before else e["from"], e["pos"]
            for a in range(lo, hi, SPLIT_BYTES):
                parts.append(_Range(e, lo, a, min(a + SPLIT_BYTES, hi), hi))
        return parts

    def read(self, partition):
        import pyarrow as pa

        r = partition
        path = r.at
        if (look(path) or {}).get("id") != r.id:  # renamed since the batch was planned
            near = glob.glob(os.path.join(glob.escape(os.path.dirname(path)), "*"))
            path = next((p for p in near if (look(p) or {}).get("id") == r.id), None)
            if path is None:
                raise FileNotFoundError(f"{r.at} is gone before it was read")

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(["file:" + r.name] * len(rows), pa.string()), pa.array([r.generation] * len(rows), pa.int32()),
                 pa.array([p for p, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())],
                names=["file", "generation", "byte_pos", "value"])

        with open(path, "rb") as fh:
            pos = r.start
            if r.start > r.first:  # skip the line that began in the previous split
                fh.seek(r.start - 1)
                pos = r.start - 1 + len(fh.readline())
            else:
                fh.seek(pos)
            rows = []
            while pos < r.end and pos < r.last:
                line = fh.readline()  # the batch range ends just after a newline
                if not line.endswith(b"\n"):
                    raise EOFError(f"{path} ends at {pos + len(line)}, before {r.last}")
                body = line[:-2] if line.endswith(b"\r\n") else line[:-1]
                rows.append((pos, body.decode("utf-8", errors="replace")))
                pos += len(line)
                if len(rows) >= BATCH_LINES:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def commit(self, end: dict) -> None:
        pass


class FollowSource(DataSource):
    """Streaming source ``ldaplens_follow``; options ``path`` (file, folder or glob), ``tail``."""

    @classmethod
    def name(cls):
        return "ldaplens_follow"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return FollowReader(self.options)


def follow_logs(spark: SparkSession, path: str, tail: int = DEFAULT_TAIL, checkpoint: str | None = None) -> DataFrame:
    """An unbounded ``(file, generation, byte_pos, value)`` stream of new lines.

    The path must be a file, folder or glob on a mounted file system that the
    executors see too. ``checkpoint`` names the query's checkpoint folder: a
    restarted query takes up the entries of the last offset that Spark logged
    there. Without it, a restart takes the files it finds for the same ones.
    """
    _local(path)
    spark.dataSource.register(FollowSource)
    reader = spark.readStream.format("ldaplens_follow").option("path", path).option("tail", str(tail))
    if checkpoint:
        reader = reader.option("checkpoint", checkpoint)
    return reader.load()


def new_line_count(query) -> int:
    """Lines delivered by the last micro-batch (0 when nothing grew)."""
    progress = query.lastProgress
    return int(progress["numInputRows"]) if progress else 0


def follow_into_table(spark: SparkSession, path: str, table: str, checkpoint: str, fmt: str = "auto",
                      as_of=None, tz=None, tail: int = DEFAULT_TAIL, trigger_seconds: float | None = None,
                      compact_after: int | None = None):
    """Keep a parsed Parquet table up to date with the followed files.

    Each micro-batch is parsed and written to ``table/batch_id=<id>`` with
    overwrite, so a batch retried after a failure replaces its own output
    instead of duplicating lines (exactly-once on top of the logged offsets).
    ``new_line_count(query)`` gives the lines the last refresh added.

    With ``compact_after``, every so many batches are merged into a clustered run, and the
    table is read by ``read_table``; see ``table``.
    """
    from ldaplens.functions.fields import parse_logs
    from ldaplens.streaming.table import compact

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        parse_logs(batch, fmt=fmt, as_of=as_of, tz=tz).write.mode("overwrite").parquet(
            f"{table.rstrip('/')}/batch_id={batch_id}")
        if compact_after:
            compact(batch.sparkSession, table, compact_after)

    stream = follow_logs(spark, path, tail=tail, checkpoint=checkpoint)
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()
