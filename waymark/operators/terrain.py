"""Heights on a grid: tiles with their neighbours' borders, hillshade, coarser levels, heights between cells.

Cells are rows (row, col, h), rows run south; tiles are rows (ty, tx, h: the tile's cells, row by row, null where nothing is known). A tile is one row of bounded size, and all that crosses tiles is
one shuffle of borders: a tile of 256 cells a side sends eight strips of 1,028 cells in all to its neighbours, besides itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where the light stands (east, north, up), how much slopes are steepened, heights below which nothing is known, metres around the equator.
LIGHT = (-0.5, 0.5, math.sqrt(0.5))
EXAGGERATE = 2.0
LEAST_HEIGHT = -1000.0
EQUATOR_M = 40_075_016.686
SIDES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def known(h: Column, nodata: float | None = None) -> Column:
    """The height, or null where the grid says that it has none."""
    bad = (h < LEAST_HEIGHT) | F.isnan(h)
    return F.when(~(bad if nodata is None else bad | (h == nodata)), h)


def tiled(cells: DataFrame, size: int) -> DataFrame:
    """Cells in tiles of size x size. Of several rows of one cell the greatest counts; null rows and columns are left out."""
    one = cells.where("row is not null and col is not null").groupBy("row", "col").agg(F.max("h").alias("h"))
    at = F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))
    held = one.groupBy(F.floor(F.col("row") / size).alias("ty"), F.floor(F.col("col") / size).alias("tx")).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), "h"))).alias("m"))
    return held.select("ty", "tx", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.try_element_at("m", i)).alias("h"))


def cells_of(tiles: DataFrame, size: int, *values: str) -> DataFrame:
    """Tiles as cells (row, col and the values), without those whose first value is null."""
    each = tiles.select("ty", "tx", F.posexplode(F.arrays_zip(*values)).alias("i", "v")).where(f"v.{values[0]} is not null")
    return each.select((F.col("ty") * size + F.floor(F.col("i") / size)).alias("row"), (F.col("tx") * size + F.col("i") % size).alias("col"), *[f"v.{v}" for v in values])


def with_borders(tiles: DataFrame, size: int) -> DataFrame:
    """(ty, tx, h: size + 2 cells a side): tiles with the cells around them, null where no neighbour is. One shuffle: each tile goes to itself whole, and its border strips to its eight neighbours."""
    h = F.col("h")
    row = lambda r: F.slice(h, r * size + 1, size)
    column = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.get(h, r * size + c))
    cell = lambda r, c: F.array(F.get(h, F.lit(r * size + c)))
    end = size - 1
    # what a tile is to the one that lies (dy, dx) of it, counted from there: the southern neighbour sees its last row to the north
    strips = {(0, 0): h, (-1, 0): row(end), (1, 0): row(0), (0, -1): column(end), (0, 1): column(0), (-1, -1): cell(end, end), (-1, 1): cell(end, 0), (1, -1): cell(0, end), (1, 1): cell(0, 0)}
    sent = F.array(*[F.struct((F.col("ty") - dy).alias("ty"), (F.col("tx") - dx).alias("tx"), F.lit(k).alias("side"), strips[dy, dx].alias("part")) for k, (dy, dx) in enumerate(SIDES)])
    parts = tiles.select(F.explode(sent).alias("p")).select("p.*")
    around = parts.groupBy("ty", "tx").agg(*[F.max(F.when(F.col("side") == k, F.col("part"))).alias(f"s{k}") for k in range(9)]).where("s4 is not null")
    blank = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    side = lambda dy, dx, n: F.coalesce(F.col(f"s{SIDES.index((dy, dx))}"), blank(n))
    outer = lambda dy: F.concat(side(dy, -1, 1), side(dy, 0, size), side(dy, 1, 1))
    west, east = side(0, -1, size), side(0, 1, size)
    inner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.concat(F.array(F.get(west, r)), F.slice("s4", r * size + 1, size), F.array(F.get(east, r)))))
    return around.select("ty", "tx", F.concat(outer(-1), inner, outer(1)).alias("h"))


def shade(h: np.ndarray, metres: float) -> np.ndarray:
    """Light from 0 to 255 on the inner cells of grids (n, side + 2, side + 2), by Horn's slopes; a missing neighbour counts as level, NaN where the cell itself is missing."""
    middle = h[:, 1:-1, 1:-1]
    side = h.shape[1]
    near = {(dy, dx): (part := h[:, 1 + dy : side - 1 + dy, 1 + dx : side - 1 + dx], np.where(np.isnan(part), middle, part))[1] for dy, dx in SIDES}
    spacing = 8 * metres / EXAGGERATE
    east = ((near[-1, 1] + 2 * near[0, 1] + near[1, 1]) - (near[-1, -1] + 2 * near[0, -1] + near[1, -1])) / spacing
    south = ((near[1, -1] + 2 * near[1, 0] + near[1, 1]) - (near[-1, -1] + 2 * near[-1, 0] + near[-1, 1])) / spacing
    x, y, z = LIGHT
    lit = (x * -east + y * south + z) / np.sqrt(1 + east * east + south * south)
    return np.where(np.isnan(middle), np.nan, np.clip(np.trunc(255 * lit), 0, 255))


def hillshade(tiles: DataFrame, size: int, metres: float) -> DataFrame:
    """(ty, tx, shade: array<int>, null where nothing is known). Whole tiles go through numpy, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 16):
                b = whole.slice(at, 16)
                h = b.column("h").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size + 2, size + 2)
                lit = shade(h, metres).reshape(-1)
                values = pa.array(np.nan_to_num(lit).astype(np.int32), mask=np.isnan(lit))
                yield pa.RecordBatch.from_arrays([b.column("ty"), b.column("tx"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size * size), values)], ["ty", "tx", "shade"])

    return with_borders(tiles, size).mapInArrow(run, "ty long, tx long, shade array<int>")


def coarser(cells: DataFrame) -> DataFrame:
    """Cells of twice the side: the mean of the heights known in each."""
    return cells.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("h").alias("h"))


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """(level, row, col, h): the cells themselves (0) and ever coarser ones; sums and numbers of a level are made from those of the one before, so the cells are read once for each level and means are those of all cells beneath."""
    own = cells.where("h is not null").select("row", "col", F.col("h").alias("s"), F.lit(1).cast("long").alias("n"))
    out = None
    for level in range(levels):
        told = own.select(F.lit(level).alias("level"), "row", "col", (F.col("s") / F.col("n")).alias("h"))
        out = told if out is None else out.unionAll(told)
        own = own.groupBy(F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return out


def best_level(scale: float, levels: int, metres: Column) -> Column:
    """The coarsest level (cells of scale * 2^level metres) that isn't coarser than wanted, a hundredth aside; 0 where all are."""
    return F.greatest(*[F.when(F.lit(scale * 2**k) <= metres * 1.01, k).otherwise(0) for k in range(levels)]) if levels > 1 else F.lit(0)


def heights_at(points: DataFrame, cells: DataFrame, smooth: bool) -> DataFrame:
    """points (id, x, y in cells from the grid's corner; other columns stay) with h, null where nothing is known.

    smooth: the four nearest cells blended, or the point's own where one of them is missing. The cells are looked up by key, four for a point, and meet again by id."""
    own = F.struct(F.floor("y").alias("row"), F.floor("x").alias("col"), F.lit(1.0).alias("w"), F.lit(True).alias("own"))
    left, top = F.floor(F.col("x") - 0.5), F.floor(F.col("y") - 0.5)
    tx, ty = F.col("x") - 0.5 - left, F.col("y") - 0.5 - top
    corner = lambda dy, dx: F.struct((top + dy).alias("row"), (left + dx).alias("col"), ((tx if dx else 1 - tx) * (ty if dy else 1 - ty)).alias("w"), F.lit(False).alias("own"))
    wanted = F.array(own, *[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]) if smooth else F.array(own)
    asked = points.select("id", F.explode(wanted).alias("c")).select("id", "c.*")
    found = asked.join(cells.where("h is not null").select("row", "col", "h"), ["row", "col"]).groupBy("id").agg(
        F.max(F.when(F.col("own"), F.col("h"))).alias("plain"), F.count_if(~F.col("own")).alias("n"), F.sum(F.when(~F.col("own"), F.col("w") * F.col("h"))).alias("blend"),
    )
    return points.join(found.select("id", F.when(F.col("n") == 4, F.col("blend")).otherwise(F.col("plain")).alias("h")), "id", "left")


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    """Width of a pixel of a web map's tiles of 256 pixels."""
    return EQUATOR_M * F.cos(F.radians(lat)) / (256 * F.pow(F.lit(2.0), zoom))
