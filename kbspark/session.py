"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "kbspark") -> SparkSession:
    """Session for tests, the bench and local runs.

    On a cluster the session comes from the launcher; this helper only fills
    settings that are unset.  The UI stays off (no server is opened).
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; create a scratch one only in local mode.

    On a cluster an unset ``spark.checkpoint.dir`` is an error: a machine-local
    folder would not survive the loss of an executor.
    """
    found = checkpoint_dir(spark)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="kbspark-ckpt-")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir()


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal a small input over the cluster's cores.

    Used in front of heavy per-row work (text extraction, tokenizing).  A landed file with one row group is one task
    whatever it costs; an input that the planner takes to be smaller than one full scan partition a core is dealt anew,
    so what is moved is bounded.  A larger one has more partitions than cores already and stays as it is.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    full = spark._jvm.org.apache.spark.sql.internal.SQLConf.get().filesMaxPartitionBytes()
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(target) if planned < target * full else df


def forget_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nobody refers to any more.

    The cleaner acts when the driver's garbage collector finds such plans, which on a large driver may be long after
    a checkpoint has made a big shuffle useless; asking for a collection frees the disk at once.  What Python has let go
    reaches the JVM a moment later, and the files go a moment after that, so it is asked twice.
    """
    gc.collect()
    for _ in range(2):
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.2)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kbspark`` importable in the Python workers of every executor.

    Functions run in tasks (``mapInPandas``, ``applyInPandas``, pandas UDFs)
    are pickled by reference to this package, so executors need it: the
    package is zipped once per application into the shared checkpoint folder
    and added with ``addPyFile``.  Idempotent per application.
    """
    import io
    import uuid
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, top))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/kbspark-{uuid.uuid4().hex}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
