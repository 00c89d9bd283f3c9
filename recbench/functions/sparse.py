"""Sparse vectors as STRUCT<size, indices, values> columns: rising indices from 0 and the components there, which aren't 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE = "struct<size:bigint,indices:array<bigint>,values:array<double>>"


def sparse(size: Column, entries: Column) -> Column:
    """From an array of (index, value) in any order, each index once; zeros and nulls are left out."""
    kept = F.array_sort(F.filter(entries, lambda e: e["index"].isNotNull() & (e["value"] != 0)))
    return F.struct(size.cast("long").alias("size"), F.transform(kept, lambda e: e["index"].cast("long")).alias("indices"), F.transform(kept, lambda e: e["value"].cast("double")).alias("values"))


def from_dense(v: Column) -> Column:
    return sparse(F.size(v), F.transform(v, lambda x, i: F.struct(i.cast("long").alias("index"), x.alias("value"))))


def to_dense(s: Column) -> Column:
    """As an array of its whole size, for vectors that are short enough."""
    held = F.map_from_arrays(s["indices"], s["values"])
    places = F.when(s["size"] > 0, F.sequence(F.lit(0).cast("long"), s["size"] - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda i: F.coalesce(F.element_at(held, i), F.lit(0.0)))


def entries(s: Column) -> Column:
    """The array of (index, value), to be exploded."""
    return F.arrays_zip(s["indices"].alias("index"), s["values"].alias("value"))


def total(s: Column) -> Column:
    return F.aggregate(s["values"], F.lit(0.0), lambda a, x: a + x)


def squares(s: Column) -> Column:
    return F.aggregate(s["values"], F.lit(0.0), lambda a, x: a + x * x)
