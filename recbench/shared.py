"""What the driver and all executors share: a folder, and this package's code."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    told = tempfile.mkdtemp(prefix="recbench-shared-")
    spark.conf.set("spark.checkpoint.dir", f"file://{told}")
    return f"file://{told}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session, wherever it was imported from."""
    context = spark.sparkContext
    if getattr(context, "_recbench_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="recbench-code-")  # the driver serves the file from here for as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{package.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    context._recbench_shipped = True


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is then left to its owner
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/recbench-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def written(rows: DataFrame, name: str, most: int = 0) -> DataFrame:
    """rows from a table in the shared folder, where more than one pass needs them; runs as it is called. most: rows of a
    file, if they are large."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("maxRecordsPerFile", most).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place from 1 in a total order, without a task that holds all rows.

    Rows are dealt out by ranges of the order and written; a row's place is the number of rows in earlier ranges plus
    its place in its own. Where the ranges begin makes no difference to any place.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ranked")
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(sizes, "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_range", "_before")
