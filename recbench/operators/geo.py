"""Points in polygons, by a join on the cells of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: A polygon's cells are so small that 2 ** STEPS of them span the longer side of its box.
STEPS = 3
#: The least exponent of two of a cell's width, also against that of the largest coordinate, so that places are exact.
LEAST, WITHIN = -30, 50


def sides_of(polygon: Column) -> Column:
    """Sides (ax, ay, bx, by) of a polygon, an array of (x, y); the last one leads back to the first point."""
    n = F.size(polygon)
    after = F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, after, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def crossed_by_ray(x: Column, y: Column, sides: Column) -> Column:
    """Whether a ray from the point to the right crosses an odd number of sides."""

    def crosses(s: Column) -> Column:
        spans = (s["ay"] > y) != (s["by"] > y)
        return spans & (x < s["ax"] + F.try_divide((s["bx"] - s["ax"]) * (y - s["ay"]), s["by"] - s["ay"]))

    return F.size(F.filter(sides, crosses)) % 2 == 1


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a ray from the point crosses the sides of a polygon, an array of (x, y), an odd number of times."""
    return crossed_by_ray(x, y, sides_of(polygon))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def cover(polygons: DataFrame) -> DataFrame:
    """Rows (level, cx, cy, index, sides) of the grid cells that polygons (index, polygon) reach into.

    A cell of level e is 2 ** e wide and high, and (cx, cy) are its place; a polygon takes the level that its box has at
    most 2 ** STEPS + 2 cells of to a side. Cells that no side comes near lie inside a polygon or outside it as their
    middle does: those inside have null sides, those outside are left out. The others have the sides that a ray from the
    cell to the right may cross, so that a point in the cell can be tested by these alone.

    Of what a cell has only the polygons before the first that it lies in, and that one, are kept. Polygons with
    coordinates that are null or not finite hold nothing.
    """
    good = F.forall("polygon", lambda p: _finite(p["x"]) & _finite(p["y"])) & (F.size("polygon") > 0)
    boxes = polygons.filter(good).select("index", sides_of(F.col("polygon")).alias("sides"), *[f(f"polygon.{c}").alias(f"{name}_{c}") for c in "xy" for name, f in (("low", F.array_min), ("high", F.array_max))])
    span = F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y"))
    largest = F.greatest(*[F.abs(F.col(f"{k}_{c}")) for k in ("low", "high") for c in "xy"])
    exponent = lambda c: F.when(c > 0, F.ceil(F.log2(c))).otherwise(LEAST)
    boxes = boxes.withColumn("level", F.greatest(F.lit(LEAST), exponent(span) - STEPS, exponent(largest) - WITHIN).cast("int")).withColumn("width", F.pow(F.lit(2.0), "level"))
    # Rounding moves a crossing by far less than this.
    boxes = boxes.withColumn("near", F.greatest(F.col("width") * 1e-6, largest * 1e-12))
    place = lambda c: F.floor(c / F.col("width")).cast("long")
    reach = lambda c: F.explode(F.sequence(place(F.col(f"low_{c}") - F.col("near")), place(F.col(f"high_{c}") + F.col("near"))))
    cells = boxes.withColumn("cx", reach("x")).withColumn("cy", reach("y"))
    edge = lambda c, i: F.col(c) * F.col("width") + (F.col("width") + F.col("near") if i else -F.col("near"))
    cells = cells.select("level", "cx", "cy", "index", "sides", *[edge(f"c{c}", i).alias(f"{c}{i}") for c in "xy" for i in (0, 1)])

    def beside(s: Column) -> Column:
        """Whether a side may be crossed by a ray from the cell."""
        return (F.least(s["ay"], s["by"]) <= F.col("y1")) & (F.greatest(s["ay"], s["by"]) >= F.col("y0")) & (F.greatest(s["ax"], s["bx"]) >= F.col("x0"))

    def touches(s: Column) -> Column:
        """Whether a side that is beside the cell comes into it: its box does, and the corners aren't all on one side of its line."""
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        corner = lambda x, y: dx * (F.col(y) - s["ay"]) - dy * (F.col(x) - s["ax"])
        corners = [corner(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
        return (F.least(s["ax"], s["bx"]) <= F.col("x1")) & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    cells = cells.withColumn("sides", F.filter("sides", beside)).withColumn("border", F.exists("sides", touches))
    inside = crossed_by_ray((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("sides"))
    cells = cells.filter(F.col("border") | inside).withColumn("sides", F.when(F.col("border"), F.col("sides")))
    first = cells.filter("not border").groupBy("level", "cx", "cy").agg(F.min("index").alias("first"))
    cells = cells.join(first, ["level", "cx", "cy"], "left").filter(F.col("first").isNull() | (F.col("index") <= F.col("first")))
    return cells.select("level", "cx", "cy", "index", "sides")


def divisions(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", one_hot: bool = True) -> DataFrame:
    """points with `division`, the index of the first polygon that holds them (null: none), and with one_hot the
    one-hot of it, as long as the largest index says.

    polygons: (index from 0, polygon). Distinct places are joined with the polygons' cells (see cover) on the cell, once
    for each level in use, of which there is one for each doubling of the polygons' sizes. Polygons are tested in the
    cells that their sides cross only, and never against points elsewhere. Points without finite coordinates are in no
    polygon; no polygons: no division and empty one-hots. Covering runs as this is called; points are read twice.
    """
    kind = dict(polygons.dtypes)["index"]
    covered = written(cover(polygons.select("index", "polygon")), "cells")
    levels = [r["level"] for r in covered.select("level").distinct().collect()]
    px, py = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    places = points.select(px.alias("_x"), py.alias("_y")).filter(_finite(F.col("_x")) & _finite(F.col("_y"))).distinct()
    cell = lambda e: F.struct(F.lit(e).alias("level"), *[F.floor(F.col(c) / F.lit(2.0**e)).cast("long").alias(to) for c, to in (("_x", "cx"), ("_y", "cy"))])
    at = F.explode(F.array(*map(cell, sorted(levels))) if levels else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>"))
    met = places.select("_x", "_y", at.alias("_cell")).select("_x", "_y", "_cell.*").join(covered, ["level", "cx", "cy"])
    held = met.filter(F.col("sides").isNull() | crossed_by_ray(F.col("_x"), F.col("_y"), F.col("sides")))
    found = held.groupBy("_x", "_y").agg(F.min("index").cast(kind).alias("division"))
    out = points.withColumns({"_px": px, "_py": py}).join(found, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")), "left").drop("_px", "_py", "_x", "_y")
    if not one_hot:
        return out
    n = polygons.agg(F.coalesce(F.max("index") + 1, F.lit(0)).cast("int")).first()[0]
    flags = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == F.col("division")).cast("double"), F.lit(0.0))) if n else F.array().cast("array<double>")
    return out.withColumn("division_vector", flags)
