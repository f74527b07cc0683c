"""The followed table: micro-batches, compacted into clustered runs behind a manifest.

``follow_into_table`` writes each micro-batch to ``batch_id=<id>``. Left alone, these small files pile up
for ever. ``compact`` merges the batches since the last compaction into one run, clustered by
``(file, generation, byte_pos)``, under ``_runs``; earlier runs of up to twice its size are merged with it,
so there are logarithmically many and a line is rewritten logarithmically often.

A manifest says what the table consists of: the runs, and the id up to which batches are in them. A new
version of it is one file that appears whole, and that is the switch: a reader takes the newest version and
the finished batches after its id, so it sees each line once, before, during and after a compaction. Files
that a version no longer names stay for ``KEEP_SECONDS`` for readers of older versions. A compaction that
dies leaves a run that no version names; the next one does its work anew. A batch that Spark runs again
after it was compacted writes the same lines to a folder that readers pass over.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.sources.codec import INGEST_BYTES, with_blooms
from ldaplens.sources.line_index import _place

COMPACT_AFTER = 64
KEEP_SECONDS = 3600.0
#: A run that no version names is a dead compaction's when it is that old.
DEAD_SECONDS = 7 * 86400.0

EMPTY = {"version": 0, "through": -1, "runs": [], "retired": []}


# ------------------------------------------------------------------ the manifest
def manifest(table: str) -> dict:
    """The newest version; of a table never compacted, one without runs."""
    from pyarrow import fs as pafs

    place, root = _place(table)
    found = [int(f.base_name[:-5]) for f in place.get_file_info(pafs.FileSelector(f"{root}/_manifest", allow_not_found=True))
             if f.base_name.endswith(".json") and f.base_name[:-5].isdigit()]
    if not found:
        return dict(EMPTY)
    with place.open_input_stream(f"{root}/_manifest/{max(found):010d}.json") as f:
        return json.loads(f.read())


def _publish(table: str, state: dict) -> None:
    place, root = _place(table)
    place.create_dir(f"{root}/_manifest", recursive=True)
    part = f"{root}/_manifest/.{uuid.uuid4().hex}"
    with place.open_output_stream(part) as f:
        f.write(json.dumps(state).encode())
    place.move(part, f"{root}/_manifest/{state['version']:010d}.json")


def _batches(table: str, after: int) -> list[int]:
    """Ids of the finished batches after ``after``; one still being written has no marker yet."""
    from pyarrow import fs as pafs

    place, root = _place(table)
    ids = [int(f.base_name[9:]) for f in place.get_file_info(pafs.FileSelector(root, allow_not_found=True))
           if f.base_name.startswith("batch_id=")]
    ids = sorted(i for i in ids if i > after)
    marks = place.get_file_info([f"{root}/batch_id={i}/_SUCCESS" for i in ids])
    return [i for i, m in zip(ids, marks) if m.type == pafs.FileType.File]


def _size(table: str, name: str) -> int:
    from pyarrow import fs as pafs

    place, root = _place(table)
    return sum(f.size or 0 for f in place.get_file_info(pafs.FileSelector(f"{root}/{name}", recursive=True)))


# ------------------------------------------------------------------ reading
def _open(spark: SparkSession, table: str, names: list[str], schema) -> DataFrame:
    base = table.rstrip("/")
    return spark.read.schema(schema).parquet(*[f"{base}/{n}" for n in names])


def _schema(spark: SparkSession):
    from ldaplens.functions.fields import parse_logs
    from ldaplens.streaming.follow import SCHEMA

    return parse_logs(spark.createDataFrame([], SCHEMA)).schema


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The lines of a followed table, each once; none of a table without batches.

    The files are fixed when this is called; lines that come later are in the next call's.
    """
    state, schema = manifest(table), _schema(spark)
    names = [r["name"] for r in state["runs"]] + [f"batch_id={i}" for i in _batches(table, state["through"])]
    return _open(spark, table, names, schema) if names else spark.createDataFrame([], schema)


# ------------------------------------------------------------------ compaction
def _write_run(lines: DataFrame, path: str, size: int) -> None:
    """One shuffle: stretches of a file go to one output file and are sorted there."""
    stretch = F.floor(F.col("byte_pos") / INGEST_BYTES)
    spread = lines.repartition(max(1, -(-size // INGEST_BYTES)), "file", "generation", stretch)
    with_blooms(spread.sortWithinPartitions("file", "generation", "byte_pos")).parquet(path)


def compact(spark: SparkSession, table: str, at_least: int = 1, keep_seconds: float = KEEP_SECONDS) -> int:
    """Merge the finished batches into a run if there are ``at_least`` so many; gives their number.

    One compaction of a table at a time; the follow query calls it between its batches. Every version
    names whole runs, so if two meet, the version written last stands and no line is lost.
    """
    state = manifest(table)
    ids = _batches(table, state["through"])
    if len(ids) < at_least or not ids:
        return 0
    names = [f"batch_id={i}" for i in ids]
    size = sum(_size(table, n) for n in names)
    runs = list(state["runs"])
    while runs and runs[-1]["bytes"] <= 2 * size:
        last = runs.pop()
        names.append(last["name"])
        size += last["bytes"]
    name = f"_runs/run-{state['version'] + 1:010d}-{uuid.uuid4().hex}"
    _write_run(_open(spark, table, names, _schema(spark)), f"{table.rstrip('/')}/{name}", size)
    now = time.time()
    _publish(table, {"version": state["version"] + 1, "through": ids[-1],
                     "runs": [*runs, {"name": name, "bytes": size}],  # of its batches as they came
                     "retired": state["retired"] + [[n, now] for n in names]})
    clean(table, keep_seconds)
    return len(ids)


def clean(table: str, keep_seconds: float = KEEP_SECONDS) -> int:
    """Delete what has been out of the table for ``keep_seconds``; gives the number of folders deleted."""
    from pyarrow import fs as pafs

    place, root = _place(table)
    state, now = manifest(table), time.time()
    gone = [n for n, since in state["retired"] if now - since >= keep_seconds]
    named = {r["name"] for r in state["runs"]} | {n for n, _ in state["retired"]}
    for f in place.get_file_info(pafs.FileSelector(f"{root}/_runs", allow_not_found=True)):
        if f"_runs/{f.base_name}" not in named and f.mtime and now - f.mtime.timestamp() >= max(DEAD_SECONDS, keep_seconds):
            gone.append(f"_runs/{f.base_name}")
    for n in gone:
        if place.get_file_info(f"{root}/{n}").type == pafs.FileType.Directory:
            place.delete_dir(f"{root}/{n}")
    if any(n in gone for n, _ in state["retired"]):
        _publish(table, {**state, "version": state["version"] + 1, "retired": [r for r in state["retired"] if r[0] not in gone]})
    versions = sorted(f.path for f in place.get_file_info(pafs.FileSelector(f"{root}/_manifest", allow_not_found=True))
                      if f.base_name.endswith(".json"))
    for path in versions[:-COMPACT_AFTER]:
        place.delete_file(path)
    return len(gone)
