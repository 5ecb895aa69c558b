"""Spark session helpers.

The library never builds its own cluster configuration: jobs receive the
session from the caller.  ``local_session`` exists for tests, the bench and
the smoke entry point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None,
                  app: str = "tripwire") -> SparkSession:
    """A local[N] session for tests and benchmarks (UI off, AQE on, UTC)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        # small test tables: split files finely enough to use every core
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("TRIPWIRE_MAX_PART_BYTES", "8m"))
        .config("spark.tripwire.rowGroupBytes", str(4 * 1024 * 1024))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIPWIRE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is respected as is.
    Only when it is unset (local tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tripwire-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised state tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tripwire-state/{name}"


#: folders that ``materialize`` wrote in this process
_WRITTEN: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process wrote; to be called when the
    results that read them are written.  Stored tables and models stay."""
    n = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())  # noqa: SLF001
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))  # noqa: SLF001
    return n


def materialize(df, name: str = "table"):
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back: cuts the lineage (a lost executor re-reads files instead of
    recomputing hashes, sorts and UDFs) and later passes get columnar,
    pruned scans."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    block = spark.conf.get("spark.tripwire.rowGroupBytes", str(64 * 1024 * 1024))
    # row groups are the unit of read parallelism: keep them bounded
    df.write.mode("overwrite").option("parquet.block.size", block).parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)
