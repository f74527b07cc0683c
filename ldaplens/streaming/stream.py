"""Line streams from any source, parsed and filtered.

``parse_logs`` and the filter predicates are pure projections / filters, so
they run unchanged on a streaming DataFrame. These helpers wire up a stock
file stream and a parquet sink with a checkpoint (exactly-once for
stateless queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.functions.fields import parse_logs, strip_cr
from ldaplens.operators.filters import FilterStack, apply_filters_stream


def stream_lines(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None,
                 max_batches: int | None = None) -> DataFrame:
    """``(file, value)`` from every new file dropped into ``folder``.

    A batch has a fixed cost (listing, logs, planning), so a fixed number of files a batch makes a
    backlog of small files cost by their number. ``max_batches`` bounds the batches of the files
    that lie in ``folder`` now: where ``max_files_per_trigger`` would need more, it is raised.
    """
    if max_files_per_trigger and max_batches:
        waiting = len(spark.read.text(folder).inputFiles())
        max_files_per_trigger = max(max_files_per_trigger, -(-waiting // max_batches))
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(folder)
    return df.select(F.col("_metadata.file_path").alias("file"), strip_cr(F.col("value")).alias("value"))


def parse_stream(lines: DataFrame, fmt: str = "auto", as_of=None, tz=None,
                 stack: FilterStack | None = None) -> DataFrame:
    """S11 + F15: parse a line stream, optionally keeping only lines passing ``stack``."""
    if stack is not None and not stack.empty:
        return apply_filters_stream(lines, stack, lambda d: parse_logs(d, fmt=fmt, as_of=as_of, tz=tz))
    return parse_logs(lines, fmt=fmt, as_of=as_of, tz=tz)


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, query_name: str | None = None):
    """Start an append-mode parquet sink with its checkpoint folder."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    return w.start(out)


def drain(query) -> None:
    """Process everything available now, then stop the query."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
