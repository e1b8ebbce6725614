"""Reading the crawl / document tables.

Every read goes through ``read_table`` so column pruning and filter push-down
reach the Parquet scan (``ReadSchema`` / ``PushedFilters`` in ``explain``). Scans
are split by Spark (``spark.sql.files.maxPartitionBytes``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

#: Session setting, off by default: deal the rows of every scan to so many
#: partitions. For small test files of a single row group only, which one
#: task would read and work on alone; it shuffles the raw rows.
SCAN_PARTITIONS = "folioscope.scanPartitions"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def table_landing(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    """(folder, glob of file names) under which a file stream finds all files of a
    table, be it a single file or a folder of part files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return table_path(sf_dir, name), "*"
    return sf_dir, f"{name}.parquet"
