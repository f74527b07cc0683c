"""A kept line index over plain log files, extended as they grow, and random access through it.

``read_logs`` numbers lines by scanning the text twice. Here the first scan is kept: one row for every
``BLOCK`` bytes of a file with the number of lines that start in the block and before it. The table is a
folder of versions in the shared storage; ``refresh_index`` adds one:

* a file not known, or changed in what was indexed, is scanned whole and starts a new ``epoch``;
* a file that grew (its last bytes before the old end still agree) is scanned from its last block;
* an untouched file (same size and time of change) costs nothing.

Blocks are counted by tasks of equal shares of bytes, whatever files they belong to, so one huge file
scales like many small ones; a version appears when its commit marker does, and readers of an older one
keep their files. After ``MERGE_AFTER`` additions the valid rows are written as one full version.

``read_indexed`` is a data source over index and files. A partition is a run of blocks; lines get their
numbers from the index in the one pass that reads them. Conditions on ``file`` and ``line_no`` choose the
blocks before anything is read, so fifty lines of a huge file cost one block, and the last lines of every
file, with their numbers, cost its last blocks.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains

from ldaplens.session import ship_package
from ldaplens.sources.codec import _open, codec_of

BLOCK = 8 << 20
MERGE_AFTER = 8
_PRINT = 1 << 16  # bytes before the old end that a grown file must still have
_CHUNK = 1 << 20
_MOST = 128 << 20  # bytes of one read task
_OPEN_COST = 1 << 20  # what opening a file counts for

ROWS = ("file string, epoch int, start bigint, stop bigint, lines bigint, before bigint, size bigint, mtime bigint, "
        "print string, ver int")
LINES = "file string, line_no bigint, byte_pos bigint, value string"


# ------------------------------------------------------------------ versions
def _place(path: str):
    from pyarrow import fs as pafs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _versions(index: str) -> list[tuple[int, bool, str]]:
    """Committed versions ``(number, full, path)`` in use: the last full one and the additions after it."""
    from pyarrow import fs as pafs

    place, root = _place(index)
    found = []
    for f in place.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        kind, _, number = f.base_name.partition("-")
        if kind in ("full", "add") and place.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File:
            found.append((int(number), kind == "full", f"{index.rstrip('/')}/{f.base_name}"))
    found.sort()
    first = max((i for i, v in enumerate(found) if v[1]), default=0)
    return found[first:]


def _valid(rows: DataFrame) -> DataFrame:
    """Of every file's last epoch, the newest row of each block."""
    last = rows.groupBy("file").agg(F.max("epoch").alias("epoch"))
    return (rows.join(last, ["file", "epoch"]).groupBy("file", "epoch", "start")
            .agg(F.max_by(F.struct("stop", "lines", "before", "size", "mtime", "print", "ver"), "ver").alias("r")).select("file", "epoch", "start", "r.*"))


def load_index(spark: SparkSession, index: str) -> DataFrame:
    """The valid rows of an index, one for each block; none when there is no index yet."""
    return _valid(_rows(spark, _versions(index)))


def _facts(rows: DataFrame) -> DataFrame:
    """One row a file from all rows of an index: its last valid block, and size, time and print with it."""
    last = F.max_by(F.struct("epoch", "start", "stop", "lines", "before", "size", "mtime", "print"), F.struct("epoch", "start", "ver"))
    return rows.groupBy("file").agg(last.alias("r")).select("file", "r.*", (F.col("r.before") + F.col("r.lines")).alias("n_lines"))


def _rows(spark: SparkSession, versions) -> DataFrame:
    return spark.read.schema(ROWS).parquet(*[v[2] for v in versions]) if versions else spark.createDataFrame([], ROWS)


# ------------------------------------------------------------------ building
def _read(f, start: int, stop: int) -> bytes:
    f.seek(start)
    return f.read(stop - start)


def _resume(batches):
    """Where the scan of each changed file begins: at its last block if it only grew, else at 0 in a new epoch."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            grown = False
            if r["old_size"] is not None and r["size"] > r["old_size"]:
                with _open(r["file"]) as f:
                    old = r["old_size"]
                    grown = hashlib.blake2b(_read(f, max(0, old - _PRINT), old), digest_size=8).hexdigest() == r["print"]
            if grown and r["stop"] - r["start"] < BLOCK:  # the last block was not full
                begin = r["epoch"], r["start"], r["before"], r["lines"]
            elif grown:
                begin = r["epoch"], r["stop"], r["n_lines"], 0
            else:
                begin = 0 if r["epoch"] is None else r["epoch"] + 1, 0, 0, 0
            out.append((r["file"], r["size"], r["mtime"], *begin))
        columns = zip(*out) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(columns)],
                                         names=["file", "size", "mtime", "epoch", "begin", "base", "again"])


def _count(batches):
    """Lines that start in each block: at the file's start, and after every newline before the block's end."""
    for b in batches:
        lines, prints = [], []
        for r in b.to_pylist():
            with _open(r["file"]) as f:
                if r["start"] == 0 and codec_of(f.read(6)) != "none":
                    raise ValueError(f"{r['file']} is compressed: a byte index needs plain text, ingest it instead")
                at, end, n = max(r["start"] - 1, 0), r["stop"] - 1, int(r["start"] == 0)
                f.seek(at)
                while at < end:
                    data = f.read(min(_CHUNK, end - at))
                    if not data:
                        raise EOFError(f"{r['file']} ends at {at}, before {end}")
                    n += data.count(b"\n")
                    at += len(data)
                lines.append(n)
                prints.append(hashlib.blake2b(_read(f, max(0, r["stop"] - _PRINT), r["stop"]), digest_size=8).hexdigest() if r["stop"] == r["size"] else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, pa.int64()), pa.array(prints, pa.string())], names=[*b.schema.names, "lines", "print"])


def refresh_index(spark: SparkSession, paths, index: str) -> int:
    """Bring the index up to date with the files; returns the number of lines that are new since the last
    refresh (0 when nothing grew, all lines of a file that was rewritten).

    Empty files have no blocks. A file that is gone keeps its rows; reading it then fails. One refresh of an
    index runs at a time.
    """
    ship_package(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    versions = _versions(index)
    number = versions[-1][0] + 1 if versions else 0
    files = spark.read.format("binaryFile").load(paths).where("length > 0").select(
        F.col("path").alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    if versions:
        known = _facts(_rows(spark, versions)).select("file", "epoch", "start", "stop", "lines", "before", "n_lines", "print",
                                                      F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
        same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
        changed = files.join(known, "file", "left").where(~same).drop("old_mtime")
        if changed.isEmpty():
            return 0
        files = changed.mapInArrow(_resume, "file string, size bigint, mtime bigint, epoch int, begin bigint, base bigint, again bigint")
    else:
        zero = F.lit(0).cast("bigint")
        files = files.select("*", F.lit(0).alias("epoch"), zero.alias("begin"), zero.alias("base"), zero.alias("again"))
    blocks = files.select("*", F.explode(F.sequence("begin", F.col("size") - 1, F.lit(BLOCK))).alias("start")).withColumn(
        "stop", F.least(F.col("start") + BLOCK, F.col("size")))
    counted = blocks.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(
        _count, "file string, size bigint, mtime bigint, epoch int, begin bigint, base bigint, again bigint, start bigint, stop bigint, lines bigint, print string")
    # the window sorts one small row a block
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = Observation()
    rows = counted.withColumn("before", F.col("base") + F.coalesce(F.sum("lines").over(earlier), F.lit(0))).observe(
        new, F.coalesce(F.sum(F.col("lines") - F.when(F.col("start") == F.col("begin"), F.col("again")).otherwise(0)), F.lit(0)).alias("lines"))
    rows.select("file", "epoch", "start", "stop", "lines", "before", "size", "mtime", "print", F.lit(number).alias("ver")).write.mode("overwrite").parquet(
        f"{index.rstrip('/')}/{'add' if versions else 'full'}-{number:09d}")
    if len(versions) >= MERGE_AFTER:
        merge_index(spark, index)
    return int(new.get["lines"])


def merge_index(spark: SparkSession, index: str) -> None:
    """Write the valid rows as one full version; versions before the last full one are deleted."""
    versions = _versions(index)
    if len(versions) < 2:
        return
    load_index(spark, index).select(*[f.split()[0] for f in ROWS.split(", ")]).sort("file", "start").write.mode("overwrite").parquet(
        f"{index.rstrip('/')}/full-{versions[-1][0] + 1:09d}")
    from pyarrow import fs as pafs

    place, root = _place(index)
    for f in place.get_file_info(pafs.FileSelector(root)):
        if int(f.base_name.partition("-")[2]) < versions[0][0]:
            place.delete_dir(f.path)


def indexed_counts(spark: SparkSession, index: str) -> DataFrame:
    """S6 from the index alone: ``(file, n_lines)`` of every file with lines."""
    return _facts(_rows(spark, _versions(index))).select("file", "n_lines")


# ------------------------------------------------------------------ reading
class _Blocks(InputPartition):
    """Runs ``(file, start, stop, before, size)`` of blocks for one task, and the asked line numbers."""

    def __init__(self, runs: list, low: int, high: int | None, needle: bytes):
        super().__init__(len(runs))
        self.runs, self.low, self.high, self.needle = runs, low, high, needle


def _hits(data: bytes, cut: int, needle: bytes, starts: np.ndarray) -> np.ndarray:
    """Indices of the lines that contain ``needle``, by one search of the bytes."""
    found, at = [], data.find(needle, 0, cut)
    while at >= 0:
        found.append(at)
        end = data.find(b"\n", at, cut)
        at = data.find(needle, end, cut) if end >= 0 else -1
    return np.searchsorted(starts, np.array(found, np.int64), "right") - 1


def lines_of(f, start: int, stop: int, before: int, size: int, low: int = 0, high: int | None = None, needle: bytes = b""):
    """Arrow columns ``line_no, byte_pos, value`` of the lines that start in ``[start, stop)``, in batches.

    One trailing CR is dropped; the last line may lack its newline; bytes are passed on as they are. With a
    ``needle`` (no line break in it) only lines that contain it come.
    """
    at, number = start, before
    f.seek(max(start - 1, 0))
    if start and f.read(1) != b"\n":  # the line before goes on: skip its rest
        while at < size:
            data = f.read(min(_CHUNK, size - at))
            end = data.find(b"\n")
            if end >= 0:
                at += end + 1
                f.seek(at)
                break
            at += len(data)
    held = b""
    while at < stop and (high is None or number < high):
        data = f.read(min(_CHUNK, size - at - len(held)))
        if not data and not held:
            break
        held += data
        cut = len(held) if at + len(held) >= size or not data else held.rfind(b"\n") + 1
        if not cut:
            continue  # a line longer than what was read so far
        b = np.frombuffer(held, np.uint8, cut)
        ends = np.flatnonzero(b == 10)
        if not len(ends) or ends[-1] != cut - 1:
            ends = np.append(ends, cut)
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = int(np.searchsorted(starts, stop - at))
        first, last = max(low - number, 0), n if high is None else min(n, high - number)
        if needle:
            chosen = _hits(held, cut, needle, starts)
            chosen = chosen[(chosen >= first) & (chosen < last)]
        else:
            chosen = np.arange(first, max(first, last))
        if len(chosen):
            s, e = starts[chosen], ends[chosen]
            stops = e - ((e > s) & (b[np.maximum(e - 1, 0)] == 13))
            if needle:
                body = b"".join([held[i:j] for i, j in zip(s.tolist(), stops.tolist())])
            else:
                body = b[s[0]:e[-1]]
                mask = body != 10
                mask[(stops - s[0])[stops < e]] = False
                body = body[mask]
            offsets = np.concatenate([[0], np.cumsum(stops - s)]).astype(np.int32)
            yield pa.array(number + chosen), pa.array(at + s), pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets), pa.py_buffer(body))
        number += len(starts)
        at, held = at + cut, held[cut:]


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.index, self.files = options["index"], set(json.loads(options.get("files", "[]")))
        self.tail, self.parallel = int(options.get("tail", 0)), int(options.get("parallel", 8))
        self.low, self.high, self.needle = 0, None, b""

    def pushFilters(self, filters):
        """Conditions on file and line number choose blocks; Spark still applies them to the rows."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("line_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = value + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
            elif column == ("file",) and isinstance(f, (EqualTo, In)):
                asked = set(f.value) if isinstance(f, In) else {value}
                self.files = self.files & asked if self.files else asked or {None}
                self.files = self.files or {None}
            elif column == ("value",) and isinstance(f, StringContains) and not {"\n", "\r"} & set(value):
                self.needle = max(self.needle, value.encode(), key=len)
            yield f

    def blocks(self):
        """The chosen blocks ``(file, start, stop, before, lines, size)``, in order."""
        import pyarrow.dataset as ds

        paths = _versions(self.index)
        if not paths or self.files == {None}:
            return []
        place, _ = _place(self.index)
        wanted = ds.field("file").isin(pa.array(sorted(self.files), pa.string())) if self.files else None
        columns = ["file", "epoch", "start", "stop", "before", "lines", "size", "ver"]
        rows = pa.concat_tables([ds.dataset(_place(p)[1], filesystem=place, format="parquet").to_table(columns=columns, filter=wanted) for *_, p in paths], promote_options="permissive")
        t = rows.to_pandas()
        t = t[t["epoch"] == t.groupby("file")["epoch"].transform("max")]
        t = t.sort_values(["file", "start", "ver"]).drop_duplicates(["file", "start"], keep="last")
        t["size"] = t.groupby("file")["stop"].transform("max")
        if self.tail:
            total = (t["before"] + t["lines"]).groupby(t["file"]).transform("max")
            t = t[t["before"] + t["lines"] > total - self.tail - 1]
        t = t[t["before"] + t["lines"] > self.low]
        if self.high is not None:
            t = t[t["before"] < self.high]
        return list(t[["file", "start", "stop", "before", "lines", "size"]].itertuples(index=False, name=None))

    def partitions(self):
        blocks = self.blocks()
        share = min(max(sum(b[2] - b[1] for b in blocks) // (2 * self.parallel), 1), _MOST)
        tasks, runs, weight = [], [], 0
        for file, start, stop, before, _, size in blocks:
            if weight >= share:
                tasks.append(runs)
                runs, weight = [], 0
            if runs and runs[-1][0] == file and runs[-1][2] == start:
                runs[-1][2] = stop
            else:
                runs.append([file, start, stop, before, size])
                weight += _OPEN_COST if len(runs) > 1 else 0
            weight += stop - start
        if runs:
            tasks.append(runs)
        return [_Blocks([tuple(r) for r in t], self.low, self.high, self.needle) for t in tasks] or [_Blocks([], 0, 0, b"")]

    def read(self, partition):
        for file, start, stop, before, size in partition.runs:
            with _open(file) as f:
                for number, pos, value in lines_of(f, start, stop, before, size, partition.low, partition.high, partition.needle):
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(value), pa.string()), number, pos, value],
                                                     names=["file", "line_no", "byte_pos", "value"])


class LineSource(DataSource):
    """Batch source ``ldaplens_lines``; options ``index``, ``files`` (JSON list), ``tail``, ``parallel``."""

    @classmethod
    def name(cls):
        return "ldaplens_lines"

    def schema(self):
        return LINES

    def reader(self, schema):
        return LineReader(self.options)


def read_indexed(spark: SparkSession, index: str, files=None, tail: int | None = None) -> DataFrame:
    """``(file, line_no, byte_pos, value)`` of the indexed files as of the last refresh, one pass
    over the asked blocks. ``files`` (as the index names them) limits the files."""
    ship_package(spark)
    spark.dataSource.register(LineSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("ldaplens_lines").option("index", index).option("parallel", str(spark.sparkContext.defaultParallelism))
    if files is not None:
        reader = reader.option("files", json.dumps(list(files) or [None]))
    if tail is not None:
        reader = reader.option("tail", str(tail))
    return reader.load()


def tail_indexed(spark: SparkSession, index: str, n: int = 10) -> DataFrame:
    """S8 with numbers: ``(file, line_no, byte_pos, value)`` of the last ``n`` newline-terminated lines of
    every file; only last blocks are read. An unterminated last line is not part of a tail."""
    lines = read_indexed(spark, index, tail=n)
    whole = _facts(_rows(spark, _versions(index))).select("file", F.col("stop").alias("size"), "n_lines")
    end = F.col("byte_pos") + F.octet_length("value")  # less than the size when a newline follows
    last = lines.join(whole, "file").withColumn("open", (F.col("line_no") == F.col("n_lines") - 1) & (end >= F.col("size")))
    back = F.col("n_lines") - F.col("line_no") - F.max("open").over(Window.partitionBy("file")).cast("int")
    return last.withColumn("back", back).where(F.col("back").between(1, n)).select("file", "line_no", "byte_pos", "value")
