"""Session helpers: a tuned local/cluster session and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "ldaplens", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every ldaplens job relies on.

    The session time zone is pinned to UTC: the timestamp normaliser formats
    instants as RFC3339 UTC text, and ``ts`` columns are compared in UTC.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS")
    parts = shuffle_partitions or int(cpus or 8)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LDAPLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_compiled(spark)


def ensure_compiled(spark: SparkSession) -> None:
    """Keep generated code where the JVM compiles it.

    A JVM interprets methods of over 8000 bytes of code for good. The long projections of this
    library (line shapes, head normalisation, 16 fields) make such methods when fused into one
    stage; below this limit Spark generates them per operator, in small methods.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is used as is. Only a session without one (tests, local runs)
    gets a private folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    local = tempfile.mkdtemp(prefix="ldaplens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ldaplens-{name}-{uuid.uuid4().hex}"


def ensure_parallelism(df):
    """Spread a scan that came back in fewer partitions than the cluster has cores.

    A small single-file table is one split (one task) however many cores
    exist; a round-robin repartition then costs one small shuffle and buys
    full parallelism for the per-line regex work. Large inputs already have
    more splits than cores and are returned untouched (no shuffle).
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ldaplens`` importable on every executor (once per SparkContext).

    Python tasks (file writer, decoder and follow sources, Aho-Corasick
    drill) unpickle functions by module name, so the package must be on the
    executors' path. It is zipped into the shared checkpoint folder and
    registered with ``addPyFile``, which distributes it with the job; its
    functions and classes are also pickled by value.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    # Python data sources are planned in a separate driver-side Python process
    # that does not see addPyFile; pickling the package's functions and classes
    # by value makes them self-contained wherever they are unpickled.
    import ldaplens
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ldaplens)
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = scratch_path(spark, "pyfiles") + "/ldaplens.zip"
    local = target[5:] if target.startswith("file:") else target
    if "://" in local:  # remote shared folder: build locally, then copy through Hadoop FS
        local = os.path.join(tempfile.mkdtemp(prefix="ldaplens-zip-"), "ldaplens.zip")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("ldaplens", os.path.relpath(full, pkg)))
    sc.addPyFile(local)
    _SHIPPED.add(key)
