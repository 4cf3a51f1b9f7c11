"""Operators on boxes and points of pages: grid joins instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import box_area, box_intersection


def _cells(box: Column, size: float) -> Column:
    """Grid cells that a box touches."""
    span = lambda i: F.sequence(F.floor(box[i] / size).cast("int"), F.floor(box[i + 2] / size).cast("int"))
    return F.flatten(F.transform(span(0), lambda x: F.transform(span(1), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def overlapping(a: DataFrame, b: DataFrame, page: str, key_a: str, key_b: str, box_a: str, box_b: str, cell: float = 0.05) -> DataFrame:
    """(page, key_a, key_b, intersection, iou, of_smaller): pairs of boxes of a page that overlap. Boxes meet in grid cells; each pair once."""
    left = a.select(page, key_a, box_a, F.explode(_cells(F.col(box_a), cell)).alias("_cell")).select(page, key_a, box_a, "_cell.*")
    right = b.select(page, key_b, box_b, F.explode(_cells(F.col(box_b), cell)).alias("_cell")).select(page, key_b, box_b, "_cell.*")
    inter = box_intersection(F.col(box_a), F.col(box_b))
    first = (F.col("cx") == F.greatest(F.floor(F.col(box_a)[0] / cell), F.floor(F.col(box_b)[0] / cell))) & (F.col("cy") == F.greatest(F.floor(F.col(box_a)[1] / cell), F.floor(F.col(box_b)[1] / cell)))
    met = left.join(right, [page, "cx", "cy"]).where(first & (inter > 0))
    small = F.least(box_area(F.col(box_a)), box_area(F.col(box_b)))
    return met.select(page, key_a, key_b, inter.alias("intersection"), (inter / (box_area(F.col(box_a)) + box_area(F.col(box_b)) - inter)).alias("iou"), F.try_divide(inter, small).alias("of_smaller"))


def coverage(boxes: DataFrame, cover: DataFrame, page: str, key: str, cover_key: str, cell: float = 0.05) -> DataFrame:
    """(page, key, covered): share of each box under others, at most 1; 0 for none."""
    over = overlapping(boxes.select(page, key, F.col("box").alias("_a")), cover.select(page, cover_key, F.col("box").alias("_b")), page, key, cover_key, "_a", "_b", cell)
    sums = over.groupBy(page, key).agg(F.sum("intersection").alias("_s"))
    return boxes.join(sums, [page, key], "left").select(page, key, F.least(F.lit(1.0), F.coalesce(F.try_divide("_s", box_area(F.col("box"))), F.lit(0.0))).alias("covered"))


def nearest(points: DataFrame, labels: DataFrame, page: str, key: str, label: str, radius: float) -> DataFrame:
    """(page, key, label, distance): nearest label within the radius, ties to the lower label. Points meet labels of their cell and the eight about it."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = points.select(page, key, "x", "y", around.alias("_o")).select(page, key, "x", "y", (cell("x") + F.col("_o.i")).alias("cx"), (cell("y") + F.col("_o.j")).alias("cy"))
    right = labels.select(page, label, F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2))
    met = left.join(right, [page, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(page, key).orderBy("distance", label))).where("_n = 1").select(page, key, label, "distance")


def inside(tokens: DataFrame, zones: DataFrame, page: str, token: str, zone: str, cell: float = 0.1) -> DataFrame:
    """(page, token, zone): zones that hold a token's centre."""
    at = tokens.select(page, token, "x", "y", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy"))
    of = zones.select(page, zone, "box", F.explode(_cells(F.col("box"), cell)).alias("_cell")).select(page, zone, "box", "_cell.*")
    b = F.col("box")
    return at.join(of, [page, "cx", "cy"]).where(F.col("x").between(b[0], b[2]) & F.col("y").between(b[1], b[3])).select(page, token, zone)
