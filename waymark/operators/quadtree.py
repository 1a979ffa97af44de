"""Cells that follow the data: a box is cut in four while it holds more than so many points.

One pass counts points by the smallest cell that there can be (4^depth at most), and all larger cells are sums of those; which of them are leaves then follows from their own count and their
parent's, without going down level by level over the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 5  # fixed value: how often a box is cut in four at most


def _place(value: Column, low: float, high: float, depth: int) -> Column:
    """Which of 2^depth equal strips from low to high; the upper edge belongs to the last."""
    return F.least(F.lit(2**depth - 1), F.floor((value - low) / (high - low) * 2**depth)).cast("int")


def _within(points: DataFrame, box: tuple[float, float, float, float], depth: int) -> DataFrame:
    """points in the box (west, south, east, north), with iy and ix: their smallest cell."""
    if not 0 <= depth <= 10:
        raise ValueError("a depth from 0 to 10: the leaves are broadcast, four times as many for each step")
    west, south, east, north = box
    inside = points.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))
    return inside.withColumns({"iy": _place(F.col("lat"), south, north, depth), "ix": _place(F.col("lng"), west, east, depth)})


def _above(depth: Column, deepest: int, iy: Column, ix: Column) -> Column:
    """The cell at a depth that holds a smallest cell."""
    up = F.pow(F.lit(2), F.lit(deepest) - depth).cast("int")
    return F.struct(depth.alias("depth"), F.floor(iy / up).cast("int").alias("iy"), F.floor(ix / up).cast("int").alias("ix"))


def leaves(points: DataFrame, box: tuple[float, float, float, float], most: int, depth: int = DEPTH) -> DataFrame:
    """(depth, iy, ix, s, w, n, e, points): the cells that the box is cut into so that none holds more than `most` points, or is of the last depth. Leaves without points are there too; together they cover the box once.

    points: lat, lng; those outside the box, or without a position, count nowhere."""
    west, south, east, north = box
    smallest = _within(points, box, depth).groupBy("iy", "ix").agg(F.count("*").alias("c"))
    every = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: _above(d, depth, F.col("iy"), F.col("ix")))
    counts = smallest.select("c", F.explode(every).alias("cell")).groupBy("cell").agg(F.sum("c").alias("points"))
    split = counts.where((F.col("points") > most) & (F.col("cell.depth") < depth))
    kid = lambda y, x: F.struct((F.col("cell.depth") + 1).alias("depth"), (F.col("cell.iy") * 2 + y).alias("iy"), (F.col("cell.ix") * 2 + x).alias("ix"))
    spark = points.sparkSession
    root = spark.range(1).select(F.struct(F.lit(0).alias("depth"), F.lit(0).alias("iy"), F.lit(0).alias("ix")).alias("cell"))
    cells = root.unionAll(split.select(F.explode(F.array(*[kid(y, x) for y in (0, 1) for x in (0, 1)])).alias("cell")))
    whole = cells.join(split.select("cell"), "cell", "left_anti").join(counts, "cell", "left").select("cell.*", F.coalesce("points", F.lit(0).cast("long")).alias("points"))
    cut = F.pow(F.lit(2.0), F.col("depth"))
    edge = lambda low, high, k: low + (high - low) * k / cut
    y, x = F.col("iy"), F.col("ix")
    return whole.select("depth", "iy", "ix", edge(south, north, y).alias("s"), edge(west, east, x).alias("w"), edge(south, north, y + 1).alias("n"), edge(west, east, x + 1).alias("e"), "points")


def leaf_of(points: DataFrame, found: DataFrame, box: tuple[float, float, float, float], depth: int = DEPTH) -> DataFrame:
    """points with leaf (depth, iy, ix): the one of `found` (see leaves, same box and depth) that each lies in. The leaves, at most 4^depth, are broadcast; points don't move."""
    marked = _within(points, box, depth)
    chain = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: _above(d, depth, F.col("iy"), F.col("ix"))))
    return marked.withColumn("leaf", chain).join(F.broadcast(found.select(F.struct("depth", "iy", "ix").alias("leaf"))), "leaf", "left_semi").drop("iy", "ix")
