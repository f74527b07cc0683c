"""Visible ordinals and paging (V1-V5).

The visible set is a filtered DataFrame; a viewer addresses it by ordinal.
``with_ordinal`` numbers rows densely per file without a window over a
whole file (which would put one file -- possibly a third of the data -- in
one task): rows are cut into buckets of ``bucket`` line numbers, bucket
sizes are counted (a small table), a running sum over buckets gives each
bucket's first ordinal, and ``row_number`` runs within a bucket only.
The window and the join back share the ``(file, _bucket)`` partitioning,
so the large side is shuffled once. ``page_at`` and ``goto_at`` number only the
buckets that hold the asked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ldaplens.operators.joins import sized

DEFAULT_BUCKET = 1 << 20
PAGE_BUCKET = 1 << 16  # line numbers of a bucket of the page directory


def bucket_of(order: str, bucket: int = DEFAULT_BUCKET) -> Column:
    return F.floor(F.col(order) / F.lit(bucket)).cast("bigint")


def with_ordinal(df: DataFrame, name: str = "ord", order: str = "line_no", bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """V1: dense 0-based position of each row within its file, in ``order`` order."""
    tagged = df.withColumn("_bucket", bucket_of(order, bucket))
    sizes = tagged.groupBy("file", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_sum = Window.partitionBy("file").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_bucket", F.coalesce(F.sum("_n").over(w_sum), F.lit(0)).alias("_first"))
    w_rn = Window.partitionBy("file", "_bucket").orderBy(order)
    numbered = tagged.withColumn("_rn", F.row_number().over(w_rn))
    out = numbered.join(starts, ["file", "_bucket"])
    return out.select(*df.columns, (F.col("_first") + F.col("_rn") - 1).alias(name))


def page(df: DataFrame, offset: int, height: int, ord_col: str = "ord") -> DataFrame:
    """V2: rows ``[offset, offset + height)`` of the visible set, per file."""
    if height <= 0:
        return df.where(F.lit(False))
    return df.where((F.col(ord_col) >= offset) & (F.col(ord_col) < offset + height))


def goto(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """V3: the n-th (1-based) visible row; 0 or past the end gives no row."""
    if n <= 0:
        return df.where(F.lit(False))
    return df.where(F.col(ord_col) == n - 1)


def page_at(df: DataFrame, offset: int, height: int, name: str = "ord", order: str = "line_no", bucket: int = PAGE_BUCKET) -> DataFrame:
    """V2 without numbering the whole visible set: its rows ``[offset, offset + height)`` with their ordinal, per file.

    A directory of visible rows per ``(file, bucket)`` (one narrow read, partial counts) tells which buckets
    hold the asked ordinals; only their range of line numbers is read again, so row groups outside it are
    skipped, and only their rows are sorted and numbered. The directory is written, so the join
    with the few chosen buckets is planned by their true size.
    """
    if height <= 0 or offset < 0:
        return df.where(F.lit(False)).withColumn(name, F.lit(None).cast("bigint"))
    sizes = df.groupBy("file", bucket_of(order, bucket).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chosen = sized(starts.where((F.col("_first") < offset + height) & (F.col("_first") + F.col("_n") > offset)).select("file", "_bucket", "_first"), "page")
    low, high = chosen.agg(F.min("_bucket"), F.max("_bucket")).first()
    if low is None:
        return df.where(F.lit(False)).withColumn(name, F.lit(None).cast("bigint"))
    near = df.where((F.col(order) >= low * bucket) & (F.col(order) < (high + 1) * bucket)).withColumn("_bucket", bucket_of(order, bucket))
    at = F.row_number().over(Window.partitionBy("file", "_bucket").orderBy(order))
    numbered = near.join(chosen, ["file", "_bucket"]).withColumn(name, F.col("_first") + at - 1)
    return numbered.where((F.col(name) >= offset) & (F.col(name) < offset + height)).select(*df.columns, name)


def goto_at(df: DataFrame, n: int, **how) -> DataFrame:
    """V3 by ``page_at``: the n-th (1-based) visible row of every file; 0 or past the end gives no row."""
    return page_at(df, n - 1, 1, **how)


def first_last(df: DataFrame, value: str = "value") -> DataFrame:
    """V4: first and last visible rows of each file (partial aggregates, no sort)."""
    return df.groupBy("file").agg(
        F.min("line_no").alias("first_line_no"),
        F.min_by(value, "line_no").alias("first_value"),
        F.max("line_no").alias("last_line_no"),
        F.max_by(value, "line_no").alias("last_value"),
    )


def line_status(df: DataFrame, totals: DataFrame) -> DataFrame:
    """V5: 1-based line number, file total, connection and DN of each row.

    ``totals`` is ``(file, n_lines)`` (``line_counts`` or a count of the
    log): one row per file, written first so that it is broadcast by its true size.
    """
    return df.join(sized(totals.select("file", "n_lines"), "totals"), "file").select(
        "file",
        "line_no",
        (F.col("line_no") + 1).alias("line_number"),
        F.col("n_lines").alias("total_lines"),
        "conn_id",
        "dn",
    )
