"""Plain text log scans.

A log file is an ordered sequence of ``\\n``-terminated lines with a dense,
0-based line number per file. Spark's text reader splits large files across
tasks, so the line number is rebuilt with a two-pass prefix sum over the file
splits instead of one task per file (see ``with_line_no``).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ldaplens.functions.fields import strip_cr

# Split tables above this many rows are joined back with a shuffle instead of a broadcast.
MAX_BROADCAST_SPLITS = 2_000_000


def _scan(spark: SparkSession, paths) -> DataFrame:
    if isinstance(paths, str):
        paths = [paths]
    # lineSep="\n": the default reader would also break on a bare CR
    return spark.read.option("lineSep", "\n").text(list(paths))


def read_logs(spark: SparkSession, paths, line_numbers: bool = True, codec: str = "name") -> DataFrame:
    """``(file, line_no, value)`` from log files.

    One trailing CR is dropped per line; blank lines are kept; an unterminated
    last line is a line; an empty file has no lines. ``codec="name"`` trusts the
    files' extensions (plain, ``.gz``, ``.bz2``), as Spark's reader does;
    ``codec="auto"`` looks at their first bytes and gives the files whose content
    does not match their name, and xz, to ``read_compressed``.
    """
    if codec == "auto":
        return _read_by_content(spark, paths, line_numbers)
    if codec != "name":
        raise ValueError(f"codec is 'name' or 'auto', not {codec!r}")
    scan = _scan(spark, paths)
    df = scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
        strip_cr(F.col("value")).alias("value"),
    )
    if not line_numbers:
        return df.drop("_block", "_mid")
    return with_line_no(df, _split_bound(scan) <= MAX_BROADCAST_SPLITS)


def _read_by_content(spark: SparkSession, paths, line_numbers: bool) -> DataFrame:
    from ldaplens.sources.codec import detect_codec, named_codec, read_compressed

    found = detect_codec(spark, paths).where(F.col("codec") != named_codec(F.col("file")))
    odd = {r["file"] for r in found.select("file").collect()}  # the exceptions; all names are in the scan's index anyway
    if not odd:
        return read_logs(spark, paths, line_numbers)
    columns = ["file", "line_no", "value"] if line_numbers else ["file", "value"]
    decoded = read_compressed(spark, sorted(odd)).select(*columns)
    rest = [f for f in map(_canonical, _scan(spark, paths).inputFiles()) if f not in odd]
    return read_logs(spark, rest, line_numbers).select(*columns).union(decoded) if rest else decoded


@contextmanager
def small_splits(spark: SparkSession, paths, split_bytes: int):
    """Scans of ``paths`` planned inside read splits of ``split_bytes``, many to a task.

    By itself a small split size gives every split a task of its own, so scheduling outgrows the
    reading. The tasks are held to what the session's own split size gives (four a core at least);
    the splits stay as small as asked, and each lies in one task.
    """
    tasks = max(4 * spark.sparkContext.defaultParallelism, _scan(spark, paths).rdd.getNumPartitions())
    keys = {"spark.sql.files.maxPartitionBytes": str(split_bytes), "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _split_bound(scan: DataFrame) -> int:
    """Upper bound on the splits of a text scan: every partition adds one cut at most to its files."""
    return len(scan.inputFiles()) + 2 * scan.rdd.getNumPartitions()


def with_line_no(df: DataFrame, few_splits: bool = False) -> DataFrame:
    """Dense 0-based ``line_no`` per file over split files.

    Pass 1 counts the rows of every file split ``(file, _block)`` and keeps
    the smallest row id seen in it; a running sum over the splits of one file
    gives each split's first line number. Pass 2 joins that small table back:
    ``line_no = base + (_mid - min_mid)``. Rows of one split are consecutive
    within a task, so their ids are contiguous. Nothing is computed here: both
    passes are scans of one query, planned together, so they see the same
    splits whatever the split size is by then. A line whose split is unknown
    to pass 1, or that lies past its end, is an error, never dropped.

    The split table has one row per ~128 MB of input; ``few_splits`` (a bound
    the caller has checked) broadcasts it.
    """
    splits = df.groupBy("file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_min_mid")
    )
    w = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_block", "_min_mid", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    joined = df.join(F.broadcast(splits) if few_splits else splits, ["file", "_block"], "left")
    at = F.col("_mid") - F.col("_min_mid")
    line_no = F.when((at >= 0) & (at < F.col("_n")), F.col("_base") + at).otherwise(
        F.raise_error(F.concat(F.lit("the splits of "), "file", F.lit(" changed while its lines were numbered"))).cast("bigint"))
    rest = [c for c in df.columns if c not in ("file", "_block", "_mid")]
    return joined.select("file", line_no.alias("line_no"), *rest)


def _canonical(uri: str) -> str:
    """File-index URIs spell local files ``file:///p``; row metadata says ``file:/p``."""
    return "file:/" + uri[len("file:///"):] if uri.startswith("file:///") else uri


def line_counts(spark: SparkSession, paths) -> DataFrame:
    """``(file, n_lines)``; empty files are listed with 0.

    Lines are counted with a partial aggregate per file. Empty files produce
    no split (and so no row) in any file scan, so the file list comes from the
    scan's file index (metadata only, one entry per file).
    """
    scan = _scan(spark, paths)
    files = spark.createDataFrame([(_canonical(f),) for f in scan.inputFiles()], "file string")
    counts = scan.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))
    return files.join(counts, "file", "left").select(
        "file", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines")
    )


def slice_lines(df: DataFrame, start: int, count: int) -> DataFrame:
    """Up to ``count`` lines from ``start`` in every file; out of range -> empty.

    A plain range predicate, so on ingested Parquet it prunes row groups.
    """
    if count <= 0 or start < 0:
        return df.where(F.lit(False))
    return df.where((F.col("line_no") >= start) & (F.col("line_no") < start + count))


def tail_lines(spark: SparkSession, paths, n: int = 10) -> DataFrame:
    """``(file, back, byte_pos, value)`` -- the last ``n`` newline-terminated lines of
    every file; ``back`` counts from 1 at the last one.

    An unterminated last line is not part of the tail (a follower has not seen
    its end yet). One task per file reads backwards from its end and stops
    after ``n`` lines; only a compressed file, by its content, has to be decoded from
    the start, with the last ``n`` lines held. ``byte_pos`` is the line's
    place in the (decoded) file.
    """
    from ldaplens.sources.codec import tail_scan

    return tail_scan(spark, paths, n)
