"""Shared folder, written intermediate tables and small expressions for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, scratch, ship

#: A word: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch for a Python worker while a table is written.
ROWS = 1_000


class Tables:
    """Intermediate tables written to the shared folder, so that a lost executor costs no lineage.

    Tables that a returned plan still reads live until the session's process ends; others go with drop().
    """

    #: Where tables are gathered, if anywhere, to be deleted together.
    gathered: ClassVar[list[Tables] | None] = None

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root = spark, scratch(spark, "tables")
        if Tables.gathered is not None:
            Tables.gathered.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self._small_batches():
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def _small_batches(self) -> Iterator[None]:
        """Rows with whole texts and sets are large, so fewer of them go to a worker at a time than the session says."""
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, str(ROWS if int(before) <= 0 else min(int(before), ROWS)))
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")

    def settle(self) -> None:
        """Let Spark's cleaner delete the shuffle files of jobs that are over: it does once the driver has forgotten them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes at the end all tables that operators made inside; what they return must have been written by then."""
    before, Tables.gathered = Tables.gathered, []
    try:
        yield
    finally:
        made, Tables.gathered = Tables.gathered, before
        for x in made:
            delete(x.spark, x.root)


def text_of(col: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(id_col: Column, modulus: int, remainder: int = 2) -> Column:
    """Whether a row belongs to the held-out fold; a null id belongs to the training fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def released(run: Callable) -> Callable:
    """run, for mapInArrow; at the end of a task what it freed goes back to the machine, as workers live on for other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            return

    return task


def sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A large batch in parts, so that little of it is held outside the heap at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
