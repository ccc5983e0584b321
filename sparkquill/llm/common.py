"""What the operators of this package share: inputs, scratch tables, number of rows in order."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = (
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "spark.sql.shuffleDependency.fileCleanup.enabled",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a local master) a folder of this machine is taken
    and set, since there the driver and the executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.environ.setdefault("SPARKQUILL_SCRATCH", tempfile.mkdtemp(prefix="sparkquill-"))
    return f"file://{path}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sparkquill/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``new_folder`` made."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def files_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of the shared file system holds; none where there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, each action's shuffle files go as the action ends (they are of no use after a write)."""
    before = {k: spark.conf.get(k, None) for k in _CLEANUP}
    for k in _CLEANUP:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> F.Column:
    """Tells rows apart that repeat a doc_id with another text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: Rows that one task numbers, and the fewest slices of a group.
SLICE_ROWS, SLICES = 500_000, 64


#: Rows of one slice beyond which rows that are alike in all are counted before they are numbered.
MOST_ALIKE = 4 * SLICE_ROWS


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, n_rows: int, most_alike: int | None = None) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... without gaps inside each ``group``, whatever the group's size.

    A row_number over a group would take the whole group to one task. Here rows are first dealt to slices
    of each group by a hash of ``order``, numbered inside the slice, and moved up by the sizes of the slices before.
    The slices follow from ``n_rows``, the rows of all groups. The table of sizes is broadcast: it has groups x
    slices rows, callers have a fixed number of groups (shards, buckets), and ten billion rows make 20 000 slices. The
    order inside a group is thus (slice, order): fixed by the rows alone. Rows that repeat share a slice; where that makes one
    of more than MOST_ALIKE rows, rows alike in all columns are first counted, numbered as one, and given out again.
    """
    bins = max(SLICES, -(-n_rows // SLICE_ROWS))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(bins)).cast("int"))
    sizes = materialize(sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n")), "slices")
    largest = sizes.agg(F.max("_n").alias("n")).first()["n"] or 0
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    if largest > (MOST_ALIKE if most_alike is None else most_alike):
        alike = sliced.groupBy(*sliced.columns).agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*group, "_slice").orderBy(*order, *[c for c in df.columns if c not in order]).rowsBetween(Window.unboundedPreceding, -1)
        firsts = alike.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        rows = firsts.withColumn("_at", F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1))).drop("_first", "_n")
    else:
        rows = sliced.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        rows.join(F.broadcast(starts), [*group, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_at"))
        .drop("_slice", "_at", "_before")
    )


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; looks at no more than one row beyond."""
    return df.limit(limit + 1).count() <= limit
