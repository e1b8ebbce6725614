"""Session construction and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "folioscope",
                  shuffle_partitions: int | None = None, scan_partitions: int | None = None) -> SparkSession:
    """The active session as it is, if there is one; else a local session for
    tests and the bench. On a cluster the submitter starts the session and its
    settings stay untouched.

    ``scan_partitions`` sets ``folioscope.scanPartitions`` (see
    ``sources.tables``)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or os.environ.get("SPARK_MASTER") or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scan_partitions:
        builder = builder.config("folioscope.scanPartitions", str(scan_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (master ``local[...]``) gets a
    fresh temporary folder. Anywhere else that is an error: executors would
    write to their own disks."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="folioscope-")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder."""
    return "/".join([shared_folder(spark), *parts])


def read_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads; 0 for rows that come from none."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def reliable(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Used where an expensive pass leaves something small: a lost executor then
    costs a re-read, and the planner knows the table's real size, so a small
    one is broadcast by Spark's own threshold. (Never ``localCheckpoint``: that
    lives on executor disks and is lost with them.)"""
    path = shared_path(df.sparkSession, "stages", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
