"""Places: points in polygons by ray casting, grid cells, distances, ring geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (x, y), by the parity of crossings. An edge counts where exactly one end lies above the point."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        return F.when((a["y"] > y) != (b["y"] > y), ((b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] > x).cast("int")).otherwise(0)

    return F.when(n >= 3, F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i)), F.lit(2)) == 1).otherwise(False)


def locate(points: DataFrame, key: str, x: str, y: str, shapes: DataFrame, shape_id: str, ring: str, cell: float = 0.5) -> DataFrame:
    """key, shape_id of the first shape by id that holds the point, null if none does.

    Shapes are laid out in the grid cells their bounding boxes touch and met by
    an equi-join on the cell, so a point is held only against shapes near it.
    """
    s = shapes.select(shape_id, ring, F.array_min(F.transform(ring, lambda p: p["x"])).alias("_x0"), F.array_max(F.transform(ring, lambda p: p["x"])).alias("_x1"), F.array_min(F.transform(ring, lambda p: p["y"])).alias("_y0"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("_y1"))
    s = s.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_x0") / cell), F.floor(F.col("_x1") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_y0") / cell), F.floor(F.col("_y1") / cell))))
    p = points.select(F.col(key), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / cell).alias("_cx"), F.floor(F.col(y) / cell).alias("_cy"))
    hit = p.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).join(s, ["_cx", "_cy"]).where(F.col("_x").between(F.col("_x0"), F.col("_x1")) & F.col("_y").between(F.col("_y0"), F.col("_y1")))
    hit = hit.where(inside(F.col("_x"), F.col("_y"), F.col(ring))).groupBy(key).agg(F.min(shape_id).alias(shape_id))
    return points.select(key).join(hit, key, "left")


def cell_neighbours(places: DataFrame, key: str, lat: str, lon: str, d_lat: float = 0.5, d_lon: float = 0.625) -> DataFrame:
    """key and the other keys of its model cell, sorted; cell numbers are rounded half to even."""
    x = places.select(key, F.bround(F.col(lat) / d_lat).alias("_a"), F.bround(F.col(lon) / d_lon).alias("_b"))
    cells = x.groupBy("_a", "_b").agg(F.collect_set(key).alias("_all"))
    return x.join(cells, ["_a", "_b"]).select(key, F.array_sort(F.array_except("_all", F.array(key))).alias("shares_cell_with"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace rule."""
    n = F.size(ring)
    cross = lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, F.pmod(i, n) + 1)["y"] - F.element_at(ring, F.pmod(i, n) + 1)["x"] * F.element_at(ring, i)["y"]
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + cross(i)) / 2


def star_rings(places: DataFrame, key: str, x: str, y: str, radius: float, corners: int = 10) -> DataFrame:
    """A star-shaped, concave ring around each place; a stand-in for boundaries."""
    point = lambda i: F.struct((F.col(x) + F.lit(radius) * F.when(i % 2 == 0, 1.0).otherwise(0.45) * F.cos(i * F.lit(2 * math.pi / corners))).alias("x"), (F.col(y) + F.lit(radius) * F.when(i % 2 == 0, 1.0).otherwise(0.45) * F.sin(i * F.lit(2 * math.pi / corners))).alias("y"))
    return places.select(key, F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), point).alias("ring"))
