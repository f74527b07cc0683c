"""Join helpers: the planner broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ldaplens.session import scratch_path


def sized(df: DataFrame, name: str = "keys") -> DataFrame:
    """``df`` as a written table, so that joins with it are planned by its true size.

    A key table's size cannot be told from its plan. Written to the shared folder and
    read back it is known to the byte: the planner broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise shuffles, where AQE
    splits hot keys. The table is computed once, by all executors, and outlives any of them.
    Streams are returned as they are.
    """
    if df.isStreaming:
        return df
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
