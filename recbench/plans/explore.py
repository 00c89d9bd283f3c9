"""Questions to a table of results: selections, axes, groups, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_runs(results: DataFrame, n: int | None = None, algorithm: str = "All", dataset: str = "All", user_vector: str = "All", content_vector: str = "All") -> DataFrame:
    """algorithm: All, CF, CB or a part of a name; dataset: All or a part, "All X" for every data set with X in its name."""
    out = results
    if n is not None:
        out = out.filter(F.col("N") == n)
    if algorithm in ("CF", "CB"):
        out = out.filter(F.col("CF_CB") == algorithm)
    elif algorithm != "All":
        out = out.filter(F.col("alg_type").contains(algorithm))
    if dataset != "All":
        out = out.filter(F.lower("dataset").contains(dataset.removeprefix("All ").lower()))
    for column, value in (("user_vector", user_vector), ("content_vector", content_vector)):
        if value != "All":
            out = out.filter(F.col(column) == value)
    return out


def axes(results: DataFrame, x: str, y: str, labels: dict[str, str]) -> DataFrame:
    """Two metrics under their labels' columns, with what tells the rows apart."""
    return results.select("dataset", "alg_type", F.col(labels.get(x, x)).alias("x"), F.col(labels.get(y, y)).alias("y"))


def choices(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).distinct().orderBy(column)


def configurable(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(axes, groups) of a label table, each with an id from 0 in the order of the names."""
    numbered = lambda rows: rows.select((F.row_number().over(Window.orderBy("raw")) - 1).cast("long").alias("id"), "raw", "label")
    return numbered(labels.filter("axes")), numbered(labels.filter("groups"))


def nested(results: DataFrame, metrics: list[str], by: str = "alg_type") -> DataFrame:
    """(group, rows): JSON of the chosen metrics of each group's rows, in the order of their values."""
    rows = F.array_sort(F.collect_list(F.struct(*metrics)))
    return results.groupBy(F.col(by).alias("group")).agg(F.to_json(rows).alias("rows"))


def columns(results: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there."""
    return results.select(*[c for c in wanted if c in results.columns])


def answer(results: DataFrame, structure: str, wanted: list[str]) -> DataFrame:
    """radar: nested by recommender; parallel: the wanted columns; basic: all."""
    if structure == "radar":
        return nested(results, wanted)
    if structure == "parallel":
        return columns(results, wanted)
    if structure == "basic":
        return results
    raise ValueError(f"unknown structure: {structure!r}")


def brush(results: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows within all ranges, ends included."""
    out = results
    for c, (low, high) in ranges.items():
        out = out.filter(F.col(c).between(low, high))
    return out


def extents(results: DataFrame, column: str, by: str | None = None) -> DataFrame:
    return (results.groupBy(by) if by else results).agg(F.min(column).alias("low"), F.max(column).alias("high"))
