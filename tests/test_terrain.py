"""Relief, levels and heights against a plain walk over cells; cells that follow the data against splitting one by one."""

import math
import random

import pytest

from waymark.operators import quadtree, terrain

RANDOM = random.Random(8)
GRID = {(r, c): None if RANDOM.random() < 0.15 else RANDOM.uniform(0, 40) for r in range(-5, 14) for c in range(-7, 9)}
SCHEMA = "row long, col long, h double"


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(r, c, h) for (r, c), h in GRID.items()] + [(None, 1, 2.0), (2, None, 3.0)], SCHEMA).repartition(3)


def plain_shade(r, c, metres):
    if (h := GRID.get((r, c))) is None:
        return None
    at = lambda dy, dx: h if (x := GRID.get((r + dy, c + dx))) is None else x
    slope = lambda plus, minus: sum(w * at(*p) for w, p in zip((1, 2, 1), plus)) - sum(w * at(*p) for w, p in zip((1, 2, 1), minus))
    east = slope([(-1, 1), (0, 1), (1, 1)], [(-1, -1), (0, -1), (1, -1)]) / (4 * metres)
    south = slope([(1, -1), (1, 0), (1, 1)], [(-1, -1), (-1, 0), (-1, 1)]) / (4 * metres)
    return max(0, min(255, int(255 * (0.5 * east + 0.5 * south + math.sqrt(0.5)) / math.sqrt(1 + east**2 + south**2))))


@pytest.mark.parametrize("size", [1, 4, 5, 32])
def test_relief_crosses_tiles(spark, cells, size):
    lit = terrain.cells_of(terrain.hillshade(terrain.tiled(cells, size), size, 1.5), size, "shade")
    assert {(r.row, r.col): r.shade for r in lit.collect()} == {k: s for k in GRID if (s := plain_shade(*k, 1.5)) is not None}


def test_borders_come_by_one_shuffle(spark, cells):
    plan = terrain.with_borders(terrain.tiled(cells, 4), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4 and "Join" not in plan  # cells, tiles, borders
    assert terrain.hillshade(terrain.tiled(cells.limit(0), 4), 4, 1.0).count() == 0


def test_levels_and_heights_between_cells(spark, cells):
    want = {}
    for k in range(3):
        held = {}
        for (r, c), h in GRID.items():
            if h is not None:
                held.setdefault((k, r // 2**k, c // 2**k), []).append(h)
        want |= {at: sum(x) / len(x) for at, x in held.items()}
    got = {(r.level, r.row, r.col): r.h for r in terrain.pyramid(cells.where("row is not null and col is not null"), 3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    points = [(i, RANDOM.uniform(-9, 11), RANDOM.uniform(-7, 16)) for i in range(300)] + [(900, 2.5, 3.5), (901, 2.0, 3.0), (902, None, 1.0)]
    df = spark.createDataFrame(points, "id long, x double, y double")

    def plain(x, y, smooth):
        if x is None:
            return None
        own, (cx, cy) = GRID.get((math.floor(y), math.floor(x))), (math.floor(x - 0.5), math.floor(y - 0.5))
        around = [GRID.get((cy + a, cx + b)) for a in (0, 1) for b in (0, 1)]
        if not smooth or None in around:
            return own
        u, v = x - 0.5 - cx, y - 0.5 - cy
        return (around[0] * (1 - u) + around[1] * u) * (1 - v) + (around[2] * (1 - u) + around[3] * u) * v

    for smooth in (True, False):
        for r in terrain.heights_at(df, cells, smooth).collect():
            h = plain(r.x, r.y, smooth)
            assert (r.h is None) == (h is None) and (h is None or math.isclose(r.h, h)), r


def split_one_by_one(points, box, most, depth, at=(0, 0, 0)):
    w, s, e, n = box
    if len(points) <= most or at[0] == depth:
        return {at: len(points)}
    my, mx, out = (s + n) / 2, (w + e) / 2, {}
    for y in (0, 1):
        for x in (0, 1):
            part = [p for p in points if (p[0] >= my) == bool(y) and (p[1] >= mx) == bool(x)]
            out |= split_one_by_one(part, (mx if x else w, my if y else s, e if x else mx, n if y else my), most, depth, (at[0] + 1, at[1] * 2 + y, at[2] * 2 + x))
    return out


@pytest.mark.parametrize(("most", "depth"), [(5, 5), (1, 3), (1000, 5), (0, 2), (3, 0)])
def test_leaves_and_who_lies_in_them(spark, most, depth):
    box = (-8.0, 48.0, 8.0, 64.0)
    points = [(48 + 16 * RANDOM.random() ** 3, -8 + 16 * RANDOM.random()) for _ in range(200)] + [(50.0, 0.0)] * 60 + [(48.0, -8.0), (64.0, 8.0), (56.0, 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*points, (70.0, 0.0), (50.0, 9.0), (None, 1.0)])], "i long, lat double, lng double")
    want = split_one_by_one(points, box, most, depth)
    found = quadtree.leaves(df, box, most, depth).cache()
    rows = found.collect()
    assert {(r.depth, r.iy, r.ix): r.points for r in rows} == want
    assert math.isclose(sum((r.n - r.s) * (r.e - r.w) for r in rows), 256.0)
    placed = quadtree.leaf_of(df, found, box, depth).collect()
    edges = {(r.depth, r.iy, r.ix): r for r in rows}
    assert len(placed) == len(points)
    for r in placed:
        at = edges[tuple(r.leaf)]
        assert at.s <= r.lat <= at.n and at.w <= r.lng <= at.e
