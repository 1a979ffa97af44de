"""Queries of heights and of cells that follow the data, beside those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import quadtree, terrain
from waymark.plans import views as v
from waymark.plans.queries import query, rounded

SIDE, METRES, ACROSS = 16, 2.0, 150


def height_cells(spark, sf):
    """Orders as a grid of heights, 150 cells wide; every 23rd holds nothing."""
    k = F.col("o_orderkey")
    h = F.when(k % 23 == 0, -9999.0).otherwise(F.pmod(k * 7, F.lit(31)) / 7 + k % 150 / 10 + F.pmod(F.floor(F.col("o_totalprice")), F.lit(64)) / 13)
    return v.table(spark, sf, "orders").select(F.floor(k / ACROSS).alias("row"), (k % ACROSS).alias("col"), terrain.known(h, -9999.0).alias("h"))


CELLS = f"""(select o_orderkey // {ACROSS} as row, o_orderkey % {ACROSS} as col, case when o_orderkey % 23 = 0 then null else ((o_orderkey * 7) % 31)::double / 7 + (o_orderkey % 150)::double / 10 + (floor(o_totalprice)::bigint % 64)::double / 13 end as h from orders)"""
_NAMES = {(dy, dx): f"h{'nms'[dy + 1]}{'wme'[dx + 1]}" for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
_JOINS = " ".join(f"left join c {n} on {n}.row = m.row + {dy} and {n}.col = m.col + {dx}" for (dy, dx), n in _NAMES.items() if (dy, dx) != (0, 0))
_AROUND = ", ".join(f"coalesce({n}.h, m.h) {n}" for (dy, dx), n in _NAMES.items() if (dy, dx) != (0, 0))


@query(f"""with c as (select * from {CELLS} where h is not null), a as (select m.row, m.col, {_AROUND} from c m {_JOINS}),
 d as (select row, col, ((hne + 2 * hme + hse) - (hnw + 2 * hmw + hsw)) / {8 * METRES / 2}::double dx, ((hsw + 2 * hsm + hse) - (hnw + 2 * hnm + hne)) / {8 * METRES / 2}::double dy from a)
 select row, col, greatest(0, least(255, trunc(255 * ((-0.5::double * -dx + 0.5::double * dy + sqrt(0.5::double)) / sqrt(1 + dx * dx + dy * dy)))))::int as shade from d""")
def hillshade(spark, sf):
    """Shaded relief in tiles; its SQL joins each cell with its eight neighbours."""
    lit = terrain.hillshade(terrain.tiled(height_cells(spark, sf), SIDE), SIDE, METRES)
    return terrain.cells_of(lit, SIDE, "shade")


@query(" union all ".join(f"select {k} as level, row // {2**k} as row, col // {2**k} as col, round(avg(h), 6) as h from {CELLS} where h is not null group by all" for k in range(4)))
def height_levels(spark, sf):
    """Heights at four scales."""
    return rounded(terrain.pyramid(height_cells(spark, sf), 4), "h")


_AT = f"(select c_custkey as id, ((c_custkey * 37) % {ACROSS * 10})::double / 10 + 0.03::double as x, ((c_custkey * 53) % 1000)::double / 10 + 0.03::double as y from customer)"


@query(f"""with c as (select * from {CELLS} where h is not null), p as (select *, floor(x - 0.5::double)::bigint l, floor(y - 0.5::double)::bigint t from {_AT}), q as (select *, x - 0.5::double - l as u, y - 0.5::double - t as w from p)
 select id, round(case when a.h is null or b.h is null or d.h is null or e.h is null then o.h else (a.h + (b.h - a.h) * u) + ((d.h + (e.h - d.h) * u) - (a.h + (b.h - a.h) * u)) * w end, 6) as h from q left join c a on a.row = t and a.col = l left join c b on b.row = t and b.col = l + 1
 left join c d on d.row = t + 1 and d.col = l left join c e on e.row = t + 1 and e.col = l + 1 left join c o on o.row = floor(y)::bigint and o.col = floor(x)::bigint""")
def heights_at(spark, sf):
    """Heights between cells, blended from the four nearest."""
    k = F.col("c_custkey")
    points = v.table(spark, sf, "customer").select(k.alias("id"), (F.pmod(k * 37, F.lit(ACROSS * 10)) / 10 + 0.03).alias("x"), (F.pmod(k * 53, F.lit(1000)) / 10 + 0.03).alias("y"))
    return rounded(terrain.heights_at(points, height_cells(spark, sf), True).select("id", "h"), "h")


@query(f"select key, zoom, greatest({', '.join(f'case when {2.0**k} <= m * 1.01::double then {k} else 0 end' for k in range(6))})::int as level from (select key, z.zoom, 40075016.686::double * cos(radians(lat)) / (256 * pow(2, zoom)) m from {v.SITES}, generate_series(12, 17) z(zoom))")
def level_of_view(spark, sf):
    """The level that a map of a place is drawn from, at each zoom."""
    spots = v.sites(spark, sf).select("key", "lat", F.explode(F.sequence(F.lit(12).cast("long"), F.lit(17).cast("long"))).alias("zoom"))
    return spots.select("key", "zoom", terrain.best_level(1.0, 6, terrain.metres_per_pixel(F.col("lat"), F.col("zoom"))).alias("level"))


QUARTERS = (-2.4, 51.25, -2.05, 51.55)
_W, _S, _E, _N = QUARTERS
_PLACED = f"(select key, least(31, floor((lat - {_S}::double) / ({_N}::double - {_S}::double) * 32))::int iy, least(31, floor((lng - {_W}::double) / ({_E}::double - {_W}::double) * 32))::int ix from {v.DENSE})"
_NODES = f"(select depth, iy >> (5 - depth) as y, ix >> (5 - depth) as x, count(*) c from {_PLACED}, generate_series(0, 5) d(depth) group by all)"


@query(f"""with n as (select * from {_NODES}), s as (select * from n where c > 40 and depth < 5), k as (select 0::bigint as depth, 0 as y, 0 as x union all select depth + 1, y * 2 + a, x * 2 + b from s, (values (0, 0), (0, 1), (1, 0), (1, 1)) v(a, b))
 select k.depth::int as depth, k.y::int as iy, k.x::int as ix, round({_S}::double + ({_N}::double - {_S}::double) * k.y / pow(2, k.depth), 6) as s, round({_W}::double + ({_E}::double - {_W}::double) * k.x / pow(2, k.depth), 6) as w, coalesce(n.c, 0)::bigint as points
 from k left join n on n.depth = k.depth and n.y = k.y and n.x = k.x where not exists (select 1 from s where s.depth = k.depth and s.y = k.y and s.x = k.x)""")
def quadtree_leaves(spark, sf):
    """Cells of at most forty places, or of the fifth cut."""
    return rounded(quadtree.leaves(v.dense(spark, sf), QUARTERS, 40).drop("n", "e"), "s", "w")


@query(f"""with n as (select * from {_NODES}) select key, min(depth)::int as depth from {_PLACED} p join n on n.y = p.iy >> (5 - n.depth) and n.x = p.ix >> (5 - n.depth) where c <= 40 or depth = 5 group by key""")
def quadtree_depths(spark, sf):
    """The depth of the leaf that each place lies in."""
    d = v.dense(spark, sf)
    return quadtree.leaf_of(d, quadtree.leaves(d, QUARTERS, 40), QUARTERS).select("key", "leaf.depth")
