"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldaplens.session import scratch_path, ship_package

#: Rows in one Arrow batch handed to Python: bounds a worker's memory where texts are long.
BATCH_ROWS = 1000

#: The white space that separates words in every contract of this folder.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)``, a null text read as empty; other columns are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in Python tasks and keep their Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps survive lost executors
    and the planner knows the table's true size (so it broadcasts by measured bytes only)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(df: DataFrame) -> None:
    """Delete the files behind a table of ``written`` that nothing reads any more."""
    from ldaplens.llm.store import opened

    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place, path = opened(name)
        place.delete_dir(path)


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: its cleaner acts once the driver
    has collected its garbage, which a driver with little to do may put off for half an hour."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
