"""Folders that driver and executors share, and tables in them that stand in the catalogue only while they are used."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; without one, with a local master alone, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "SPARKQUILL_SCRATCH" not in os.environ:
        os.environ["SPARKQUILL_SCRATCH"] = tempfile.mkdtemp(prefix="sparkquill-")
    return f"file://{os.environ['SPARKQUILL_SCRATCH']}"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sparkquill/{name}-{uuid.uuid4().hex[:12]}"
    hadoop, fs = _fs(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _fs(spark, path)
    fs.delete(hadoop, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no such folder."""
    hadoop, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again, so that it is computed once and its lineage ends there."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """Folders of bucketed, sorted rows, named in the catalogue while a ``with`` block lasts."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, key: list[str], buckets: int):
        self.spark, self.folder, self.columns, self.key, self.buckets = spark, folder, columns, key, buckets
        self.names: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.names:
            self.names[name] = f"sparkquill_{uuid.uuid4().hex}"
            by = ", ".join(self.key)
            self.spark.sql(f"CREATE TABLE {self.names[name]} ({self.columns}) USING parquet CLUSTERED BY ({self.key[0]}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.names[name])

    def save(self, rows: DataFrame, name: str) -> None:
        """Deals ``rows`` to one task and file a bucket, sorted by the whole key."""
        table = f"sparkquill_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, self.key[0]).sortWithinPartitions(*self.key)
        dealt.write.option("compression", "zstd").bucketBy(self.buckets, self.key[0]).sortBy(*self.key).option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")


@contextmanager
def bucketed(spark: SparkSession, folder: str, columns: str, key: list[str], buckets: int) -> Iterator[Bucketed]:
    tables, before = Bucketed(spark, folder, columns, key, buckets), spark.conf.get(_SORTED)
    spark.conf.set(_SORTED, "true")
    try:
        yield tables
    finally:
        for name in tables.names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.set(_SORTED, before)
