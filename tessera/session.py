"""Session helpers: the shared folder for cut lineage, materialised tables, settings for local runs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tessera", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "16m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests on one machine) a temporary folder is set; a session
    with another master than ``local`` or ``local[n]`` must bring the setting.
    """
    sc = spark.sparkContext
    if folder := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own, too
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir("file://" + folder)
    return "file://" + folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder; partitions and their order stay.

    Its files are removed when the driver's Python ends.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    before = _checkpoints(spark, folder)
    out = df.checkpoint(eager=True)
    for path in _checkpoints(spark, folder) - before:
        atexit.register(_remove, spark, path)
    return out


def _checkpoints(spark: SparkSession, folder: str) -> set[str]:
    sc = spark.sparkContext
    pattern = sc._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, "rdd-*"))
    return {str(s.getPath().toString()) for s in pattern.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(pattern) or []}


def materialized(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The table is the cut of lineage that survives the loss of executors; columns are
    pruned on every later read. The folder is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tessera_path = path
    return table


def scratch_path(spark: SparkSession, name: str) -> str:
    """The path of a new table in the shared folder; it is removed when the driver's Python ends."""
    path = os.path.join(shared_dir(spark), f"tessera-{name}-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, path)
    return path


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``materialized`` that nothing reads any more, so that loops don't fill the disk."""
    for t in tables:
        if path := getattr(t, "_tessera_path", None):
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have ended before
        pass
