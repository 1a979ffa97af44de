"""Queries over sites: key, name, lat, lng, score, strength, category, condition, kind, sources, reasons, added, first_seen, aliases, entrances, dates (struct of any and all, as ISO text)."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions import vocabulary as V
from waymark.functions.geo import haversine_m
from waymark.operators.staging import staged


@dataclass
class Filters:
    """The filter algebra; all given parts must hold. date_kind: any (sources) or all (with visitors' reports); dates are ISO text, the upper one excluded."""

    bbox: tuple[float, float, float, float] | None = None  # west, south, east, north
    min_score: int | None = None
    categories: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    added_since: str | None = None
    text: str | None = None
    best: bool = False
    date_kind: str | None = None
    date_from: str | None = None
    date_to: str | None = None

    def where(self) -> Column:
        out = F.lit(True)
        if self.bbox:
            w, s, e, n = self.bbox
            out = out & F.col("lat").between(s, n) & F.col("lng").between(w, e)
        if self.min_score is not None or self.best:
            out = out & (F.col("score") >= max(self.min_score or 0, V.GOOD_SCORE if self.best else 0))
        if self.categories:
            out = out & F.col("category").isin(self.categories)
        if self.sources:
            out = out & F.arrays_overlap(F.split("sources", r"\+"), F.array(*map(F.lit, self.sources)))
        if self.added_since:
            out = out & (F.col("added") > F.to_timestamp_ntz(F.lit(self.added_since)))
        if self.text:
            out = out & _told(self.text)
        if self.best:
            out = out & best_spot()
        if self.date_kind in ("any", "all") and (self.date_from or self.date_to):
            when = F.col("dates")[self.date_kind]
            out = out & when.isNotNull()
            out = out & (when >= self.date_from) if self.date_from else out
            out = out & (when < self.date_to) if self.date_to else out
        return out


def _told(text: str) -> Column:
    """The name or an alias holds the text, as it stands or with spaces and hyphens left out of both."""
    short = re.sub(r"[\s-]+", "", text)
    held = lambda n: n.ilike(f"%{text}%") | F.regexp_replace(n, "[ -]+", "").ilike(f"%{short}%")
    return held(F.col("name")) | F.exists("aliases", held)


def best_spot() -> Column:
    """Standing, empty or derelict, and somewhere to go and see: by condition and kind; unnamed places by what is known of them."""
    kind = F.lower("kind")
    state = F.col("condition").isin(V.BEST_CONDITIONS) | F.col("condition").rlike(V.BEST_CLOSED)
    known = ~F.col("name").startswith("Unnamed ") | F.col("category").isin(V.UNNAMED_OK) | ~kind.isin(V.VAGUE_KINDS)
    return state & ~kind.isin(V.SKIP_KINDS) & known


def active(items: DataFrame) -> DataFrame:
    """Items that their source still has."""
    return items.where("gone_at is null")


def by_keys(sites: DataFrame, keys: list[str], most: int = 200) -> DataFrame:
    """Particular places, in order of key; a request that names more than `most` is refused."""
    if len(keys) > most:
        raise ValueError(f"{len(keys)} keys; a request names {most} at most")
    return sites.where(F.col("key").isin(keys)).orderBy("key")


def cluster_cells(bbox: tuple[float, float, float, float], zoom: int) -> tuple[float, float]:
    """(lat, lng) size of a cluster cell; the view's middle latitude is rounded half to even."""
    lng = 360 / (256 * 2**zoom) * 80
    return lng * math.cos(math.radians(round((bbox[1] + bbox[3]) / 2))), lng


def clusters(sites: DataFrame, filters: Filters, zoom: int) -> DataFrame:
    """Grid cells of the view: count, mean position, bounds, and the commonest category (ties: the first in the alphabet). One shuffle by cell."""
    cy, cx = cluster_cells(filters.bbox, zoom)
    cells = sites.where(filters.where()).select("*", ((F.col("lat") + 90) / cy).cast("int").alias("gy"), ((F.col("lng") + 180) / cx).cast("int").alias("gx"))
    sums = [F.sum("lat").alias("sy"), F.sum("lng").alias("sx"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"), F.min("key").alias("key")]
    by = cells.groupBy("gy", "gx", "category").agg(F.count("*").alias("c"), *sums)
    joined = by.groupBy("gy", "gx").agg(
        F.sum("c").alias("n"), (F.sum("sy") / F.sum("c")).alias("lat"), (F.sum("sx") / F.sum("c")).alias("lng"), F.min("south").alias("south"), F.max("north").alias("north"),
        F.min("west").alias("west"), F.max("east").alias("east"), F.min("key").alias("key"), F.min_by("category", F.struct(-F.col("c"), "category")).alias("category"),
    )
    return joined


def cluster_view(sites: DataFrame, filters: Filters, zoom: int) -> DataFrame:
    """Clusters of two or more sites, and each site that is alone in its cell under its own key and name (count 1). One row has both kinds' columns."""
    found = clusters(sites, filters, zoom)
    alone = found.where("n = 1").select("key").join(sites.select("key", F.col("name").alias("own_name"), F.col("score").alias("own_score")), "key", "left")
    return found.join(alone, "key", "left").select("gy", "gx", "n", "lat", "lng", "category", F.when(F.col("n") == 1, F.col("key")).alias("site"), "own_name", "own_score")


def map_view(sites: DataFrame, filters: Filters, zoom: int, few: int = 400, most: int = 2000) -> tuple[str, DataFrame]:
    """("sites", the sites themselves) if the view holds few or is close, else ("clusters", its cluster view)."""
    seen = sites.where(filters.where())
    if zoom >= 15 or seen.limit(few + 1).count() <= few:
        return "sites", top(seen, most)
    return "clusters", cluster_view(sites, filters, zoom)


LISTED = ["key", "name", "lat", "lng", "score", "strength", "category", "condition", "kind", "sources", "added", "first_seen", "aliases"]


def listed(sites: DataFrame) -> DataFrame:
    """What lists show of each site: its fields, how many ways in, and its first reason."""
    return sites.select(*LISTED, F.size("entrances").alias("n_entrances"), F.coalesce(F.get("reasons", F.lit(0)), F.lit("")).alias("summary"))


def index(sites: DataFrame) -> DataFrame:
    """Every site in brief, positions to about a metre, in order of key: what a device keeps."""
    return listed(sites).withColumns({c: F.round(c, 5) for c in ("lat", "lng")}).orderBy("key")


def by_square(sites: DataFrame) -> DataFrame:
    """sites with sq_lat and sq_lng, the one-degree square that each lies in: columns to partition a written copy by."""
    return sites.withColumns({"sq_lat": F.floor("lat").cast("int"), "sq_lng": F.floor("lng").cast("int")})


def with_pointers(sites: DataFrame) -> DataFrame:
    """sites with nation, and grid_ref where that is in Great Britain."""
    found = geo.to_grid(sites.withColumn("nation", geo.nation(F.col("lat"), F.col("lng"))))
    ref = F.when(F.col("nation").isNotNull() & (F.col("nation") != "northern_ireland"), geo.grid_ref(F.col("easting"), F.col("northing")))
    return found.withColumn("grid_ref", ref).drop("easting", "northing")


def watched(saved: DataFrame, sites: DataFrame) -> DataFrame:
    """(key, changes): what has changed about saved places (key, condition, visited, reported) since they were looked at; those that haven't are left out."""
    old = saved.select("key", *[F.col(c).alias(f"old_{c}") for c in ("condition", "visited", "reported")])
    both = old.join(sites.select("key", "condition", "visited", "reported"), "key")
    later = lambda c: F.col(c).isNotNull() & (F.coalesce(f"old_{c}", F.lit("")) < F.col(c))
    told = F.array(
        F.when(~F.col("condition").eqNullSafe(F.col("old_condition")), F.concat(F.lit("condition: "), "condition")), F.when(later("visited"), F.concat(F.lit("visited: "), "visited")), F.when(later("reported"), F.concat(F.lit("reported: "), "reported")),
    )
    return both.select("key", F.filter(told, lambda x: x.isNotNull()).alias("changes")).where("size(changes) > 0")


def top(sites: DataFrame, n: int) -> DataFrame:
    return sites.orderBy(F.desc("score"), "key").limit(n)


def nearest(sites: DataFrame, lat: float, lng: float, n: int) -> DataFrame:
    """By equirectangular distance, ties by key; distance_m is the great-circle distance, rounded half to even."""
    dy, dx = F.col("lat") - lat, F.col("lng") - lng
    square = dy * dy + dx * dx * math.cos(math.radians(lat)) ** 2
    far = F.bround(haversine_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")), 0).cast("bigint")
    return sites.withColumn("distance_m", far).orderBy(square, "key").limit(n)


def newest(sites: DataFrame, n: int) -> DataFrame:
    return sites.orderBy(F.coalesce("added", "first_seen").desc_nulls_last(), F.desc("score"), "key").limit(n)


def page(sites: DataFrame, after: str, n: int) -> DataFrame:
    """The n sites after a key."""
    return sites.where(F.col("key") > after).orderBy("key").limit(n)


def statistics(sites: DataFrame) -> DataFrame:
    """Sites by category that aren't weak."""
    return sites.where("score >= 20").groupBy("category").agg(F.count("*").alias("n"))


# --- joins by place


#: Pairs to compare in one task, about; and how many rows around each a search for the nearest looks at first.
TASK_PAIRS, FEW = 50_000_000, 8


def _cells_around(gy: Column, cell: float) -> Column:
    """How many cells a band of latitude has: fewer towards the poles, so that all are about as wide as high."""
    return F.greatest(F.lit(1), F.floor(360 / cell * F.cos(F.radians(F.least(F.lit(90.0), F.abs(gy * cell)))))).cast("long")


def _along(lng: Column, gy: Column, cell: float) -> Column:
    return F.floor(lng / 360 * _cells_around(gy, cell))


def row_of(lat: Column, cell: float) -> Column:
    return F.floor(lat / cell)


def column_of(lng: Column, gy: Column, cell: float) -> Column:
    return F.pmod(_along(lng + 180, gy, cell), _cells_around(gy, cell))


def own_cell(df: DataFrame, lat: str, lng: str, cell: float) -> DataFrame:
    """df with the cell (gy, gx) that each row lies in."""
    return df.withColumn("gy", row_of(F.col(lat), cell)).withColumn("gx", column_of(F.col(lng), F.col("gy"), cell))


def circle_cells(df: DataFrame, metres: float, cell: float) -> DataFrame:
    """df's rows (lat, lng) in every cell (gy, gx) that a circle around them can touch."""
    reach = metres / geo.EARTH_M * (1 + 1e-9)
    dy = math.degrees(reach) + 1e-9
    # a circle reaches farthest to the side where it comes nearest to a pole
    side = F.sin(F.lit(reach / 2)) / F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + dy)))
    dx = F.when(side < 1, F.degrees(2 * F.asin(F.least(F.lit(1.0), side))) + 1e-9).otherwise(180.0)
    gy = F.col("gy")
    many = _cells_around(gy, cell)
    around = df.withColumn("gy", F.explode(F.sequence(F.floor((F.col("lat") - dy) / cell), F.floor((F.col("lat") + dy) / cell))))
    first, last = _along(F.col("lng") + 180 - dx, gy, cell), _along(F.col("lng") + 180 + dx, gy, cell)
    return around.withColumn("gx", F.explode(F.sequence(first, F.least(last, first + many - 1)))).withColumn("gx", F.pmod("gx", many))


def leg_cells(legs: DataFrame, cell: float) -> DataFrame:
    """Legs (a_lat, a_lng, b_lat, b_lng: straight in degrees, not across the 180th meridian) in every cell (gy, gx) that they run through: band by band of latitude, and in each from where they come in to where they leave."""
    a, b, gy, slack = F.col("a_lat"), F.col("b_lat"), F.col("gy"), 1e-9
    rows = legs.withColumn("gy", F.explode(F.sequence(F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell))))
    up, east = b - a, F.col("b_lng") - F.col("a_lng")
    flat = F.abs(up) <= 1e-4 * F.abs(east)  # where it crosses a parallel can't be told well, and it crosses few
    at = lambda edge, none: F.when(flat, F.lit(none)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (edge * cell - a) / F.when(up != 0, up).otherwise(F.lit(1.0)))))
    lng = lambda edge, none: F.col("a_lng") + at(edge, none) * east + 180
    one, other = lng(gy, 0.0), lng(gy + 1, 1.0)
    first, last = _along(F.least(one, other) - slack, gy, cell), _along(F.greatest(one, other) + slack, gy, cell)
    return rows.withColumn("gx", F.explode(F.sequence(first, last))).withColumn("gx", F.pmod("gx", _cells_around(gy, cell)))


def _by_cell(left: DataFrame, right: DataFrame, metres: float, cell: float) -> tuple[DataFrame, DataFrame, Column]:
    """Left rows in every cell (gy, gx) that their circle can touch, right rows (columns with r_) in their own, and whether a pair is within the circle's box."""
    other = own_cell(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_lat", "r_lng", cell)
    dy = math.degrees(metres / geo.EARTH_M * (1 + 1e-9)) + 1e-9
    return circle_cells(left, metres, cell), other, F.abs(F.col("lat") - F.col("r_lat")) <= dy


def _load(around: DataFrame, other: DataFrame) -> DataFrame:
    """(gy, gx, l, r, pairs) of the cells that both have rows in."""
    count = lambda df, n: df.groupBy("gy", "gx").agg(F.count("*").alias(n))
    return count(around, "l").join(count(other, "r"), ["gy", "gx"]).select("gy", "gx", "l", "r", (F.col("l") * F.col("r")).alias("pairs"))


def pairs_to_compare(left: DataFrame, right: DataFrame, metres: float, cell: float) -> int:
    """How many pairs `near_pairs` has to measure."""
    return _load(*_by_cell(left, right, metres, cell)[:2]).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]


def meet(around: DataFrame, other: DataFrame, plain: list[str], rows: int | None = None, dear: int = 1) -> DataFrame:
    """Rows of both that share a cell (gy, gx). Tasks are as many as there are pairs to compare, about TASK_PAIRS each; a cell with more is dealt over several, by the columns `plain` of around. dear: how many times the usual a caller spends on each pair.

    rows: no more rows of around than this, about, come to a task, so that it can hold them as a hash table while those of other go by."""
    on, load, most = ["gy", "gx"], _load(around, other), max(1, TASK_PAIRS // dear)
    parts = F.greatest(F.ceil(F.col("pairs") / most), F.ceil(F.col("l") / rows) if rows else F.lit(1))
    pairs, held, split = load.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pairs", "l")], F.coalesce(F.max(parts), F.lit(0))).first()
    tasks = max(-(-pairs // most), -(-held // rows) if rows else 1)
    if split > 1:
        hot = F.broadcast(load.select(*on, parts.alias("__parts")).where("__parts > 1"))  # no more rows than tasks
        parts = F.coalesce("__parts", F.lit(1))
        around = around.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*plain), parts)).drop("__parts")
        other = other.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        on = ["gy", "gx", "__part"]
    if tasks > 1:
        # numbers given here stay: tables of few bytes would else be read in few tasks, whatever their pairs
        tasks = max(tasks, int(around.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        around, other = around.repartition(tasks, *on), other.repartition(tasks, *on)
    return (around.hint("shuffle_hash") if rows else around).join(other, on).drop("__part")


def near_pairs(left: DataFrame, right: DataFrame, metres: float, cell: float) -> DataFrame:
    """Pairs of left and right (lat, lng; other columns keep their names, right's with r_) within `metres`: all of them, at any latitude and across the 180th meridian. A hash join by cell, see `meet`.

    Cells are `cell` degrees high and about as wide in metres: each band of latitude has a number of its own, fewer towards the poles. A left row goes to every cell that its circle can touch."""
    around, other, near = _by_cell(left, right, metres, cell)
    plain = [c for c in left.columns if "map<" not in left.schema[c].dataType.simpleString()]
    far = haversine_m(F.col("lat"), F.col("lng"), F.col("r_lat"), F.col("r_lng"))
    return meet(around, other, plain).where(near).withColumn("metres", far).where(F.col("metres") <= metres).drop("gy", "gx")


def nearest_of(left: DataFrame, right: DataFrame, metres: float, cell: float, key: str = "key", same: bool = True) -> DataFrame:
    """Each left row's nearest right row within reach; ties to the smaller right key. Rows without one are left out. same: whether a row may be its own nearest (of one table with itself).

    Where many rows stand within reach, those that have another close by are settled first, within a reach that FEW rows share; the rest look four times as far, and so on: the work grows with the rows, not with their pairs."""
    # of right rows at one spot only the two smallest keys can be a nearest one
    rank = F.dense_rank().over(Window.partitionBy("lat", "lng").orderBy(key))
    right = right.where("lat is not null and lng is not null").withColumn("__rank", rank).where(F.col("__rank") <= 2).drop("__rank")

    def within(left: DataFrame, reach: float, cell: float) -> DataFrame:
        pairs = near_pairs(left, right, reach, cell)
        rank = F.row_number().over(Window.partitionBy(key).orderBy("metres", f"r_{key}"))
        return pairs.where(F.lit(same) | (F.col(key) != F.col(f"r_{key}"))).withColumn("rank", rank).where("rank = 1").drop("rank")

    pairs = pairs_to_compare(left, right, metres, cell)
    if pairs <= TASK_PAIRS:
        return within(left, metres, cell)
    reach, found = metres * math.sqrt(FEW * left.count() / pairs), []
    while reach < metres / 2:
        settled = staged(within(left, reach, math.degrees(2 * reach / geo.EARTH_M)), "nearest")
        left = staged(left.alias("l").join(settled.select(F.col(key).alias("__key")), F.col(f"l.{key}").eqNullSafe(F.col("__key")), "left_anti"), "without")
        found.append(settled)
        reach *= 4
    return functools.reduce(DataFrame.unionAll, [*found, within(left, metres, cell)])


def without_near(left: DataFrame, right: DataFrame, metres: float, cell: float, key: str = "key") -> DataFrame:
    """Left rows with no right row within reach."""
    return left.join(near_pairs(left, right, metres, cell).select(key).distinct(), key, "left_anti")


# --- change tracking


def apply_snapshot(store: DataFrame, snapshot: DataFrame, key: str, values: list[str], seen_at: str, incremental: bool = False, keep: list[str] = ()) -> DataFrame:
    """The store after a crawl: rows seen are overwritten and come back, others are marked gone (never by an incremental crawl). One full outer join.

    A value of `keep` that the crawl doesn't tell stays as it was. A crawl that saw nothing at all takes nothing as gone."""
    now = F.to_timestamp_ntz(F.lit(seen_at))
    both = store.alias("o").join(snapshot.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    seen = F.col(f"n.{key}").isNotNull()
    told = lambda v: F.coalesce(f"n.{v}", f"o.{v}") if v in keep else F.col(f"n.{v}")
    fields = [F.when(seen, told(v)).otherwise(F.col(f"o.{v}")).alias(v) for v in values]
    gone = F.col("o.gone_at") if incremental or snapshot.isEmpty() else F.coalesce(F.col("o.gone_at"), now)
    return both.select(
        F.coalesce(f"o.{key}", f"n.{key}").alias(key), *fields, F.coalesce("o.first_seen", F.lit(now)).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen"), F.when(~seen, gone).alias("gone_at"),
    )


def due(crawls: DataFrame, every_days: dict[str, int], as_of: str, days: int = 7, retry_hours: int = 1) -> DataFrame:
    """(source, status) of the sources whose next crawl is due. crawls: source, id, started_at, status. Never run: due. Failed: an hour after it began. Unfinished: at once. Done: after `days`, or what its own entry says."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    last = crawls.groupBy("source").agg(F.max_by(F.struct("status", "started_at"), "id").alias("l"))
    known = crawls.sparkSession.createDataFrame(list(every_days.items()), "source string, own int").join(last, "source", "left")
    hours = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("l.started_at").cast("timestamp"))
    wait = F.when(F.col("l.status") == "done", F.greatest(F.lit(days), F.coalesce("own", F.lit(0))) * 86_400).when(F.col("l.status") == "failed", retry_hours * 3600).otherwise(0)
    return known.where(F.col("l").isNull() | (hours >= wait)).select("source", F.col("l.status").alias("status"))


# --- exports


def category_label(category: Column) -> Column:
    labels = {k: label for k, label, _ in V.CATEGORIES} | {V.OTHER_CATEGORY[0]: V.OTHER_CATEGORY[1]}
    return F.coalesce(*[F.when(category == k, v) for k, v in labels.items()], category)


def links(lat: Column, lng: Column, osm_id: Column, wikipedia: Column, wikidata: Column) -> Column:
    """struct of links out of a place; those without something to point at are null."""
    at = lambda form: F.format_string(form, *[c for _ in range(form.count("%") // 2) for c in (lat, lng)])
    made = {
        "openstreetmap": at("https://www.openstreetmap.org/?mlat=%.6f&mlon=%.6f#map=18/%.6f/%.6f"), "streetview": at("https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=%.6f,%.6f"),
        "mapillary": at("https://www.mapillary.com/app/?lat=%.6f&lng=%.6f&z=18"), "osm_element": F.concat(F.lit("https://www.openstreetmap.org/"), osm_id), "wikipedia": wikipedia, "wikidata": wikidata,
    }
    return F.struct(*[v.alias(k) for k, v in made.items()])


def way_label(e: Column) -> Column:
    return F.coalesce(F.nullif(e["name"], F.lit("")), e["kind"])


def _at(c: Column) -> Column:
    return F.format_string("%.6f", c)


def csv_rows(sites: DataFrame) -> DataFrame:
    """The thirteen columns of the export; lists are joined. sites also have osm_id and wikipedia (or null)."""
    way = lambda e: F.concat(way_label(e), F.lit(" ("), _at(e["lat"]), F.lit(", "), _at(e["lng"]), F.lit(")"))
    out = links(F.col("lat"), F.col("lng"), F.col("osm_id"), F.col("wikipedia"), F.lit(None).cast("string"))
    return sites.select(
        "name", category_label(F.col("category")).alias("category"), "condition", F.col("strength").alias("evidence"), _at(F.col("lat")).alias("latitude"), _at(F.col("lng")).alias("longitude"), "sources",
        F.array_join("reasons", " | ").alias("reasons"), F.coalesce(out["osm_element"], out["openstreetmap"]).alias("openstreetmap"), F.coalesce("wikipedia", F.lit("")).alias("wikipedia"),
        F.coalesce(F.date_format("added", "yyyy-MM-dd"), F.lit("")).alias("added"), F.array_join("aliases", "; ").alias("also_known_as"), F.array_join(F.transform("entrances", way), "; ").alias("entrances"),
    )


def escaped(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def _marks(sites: DataFrame, own: Column, way) -> DataFrame:
    """(key, n, line): a line for each site (0) and for each way into it."""
    label = lambda e: F.when((e["name"] != "") & F.contains(F.lower(e["name"]), F.lower("name")), e["name"]).otherwise(F.concat("name", F.lit(": "), way_label(e)))
    lines = F.concat(F.array(own), F.transform("entrances", lambda e: way(e, label(e))))
    return sites.select("key", F.posexplode(lines).alias("n", "line"))


def kml_rows(sites: DataFrame) -> DataFrame:
    """A placemark for each site and each way in; a document is these lines in order of key and n."""
    point = lambda lng, lat: F.concat(F.lit("<Point><coordinates>"), _at(lng), F.lit(","), _at(lat), F.lit(",0</coordinates></Point></Placemark>"))
    head = F.concat(F.lit("<Placemark><name>"), escaped(F.col("name")), F.lit(" ("), escaped(F.col("condition")), F.lit(")</name><description><![CDATA["), F.array_join(F.transform("reasons", escaped), "<br>"), F.lit("]]></description>"))
    way = lambda e, label: F.concat(F.lit("<Placemark><name>"), escaped(label), F.lit("</name><description>"), escaped(e["kind"]), F.lit("</description>"), point(e["lng"], e["lat"]))
    return _marks(sites, F.concat(head, point(F.col("lng"), F.col("lat"))), way)


def gpx_rows(sites: DataFrame) -> DataFrame:
    """A waypoint for each site and each way in."""
    begin = lambda lat, lng, name: F.concat(F.lit('<wpt lat="'), _at(lat), F.lit('" lon="'), _at(lng), F.lit('"><name>'), escaped(name), F.lit("</name><desc>"))
    told = escaped(F.concat("condition", F.lit(": "), F.array_join("reasons", " | ")))
    own = F.concat(begin(F.col("lat"), F.col("lng"), F.col("name")), told, F.lit("</desc><type>"), escaped(category_label(F.col("category"))), F.lit("</type></wpt>"))
    way = lambda e, label: F.concat(begin(e["lat"], e["lng"], label), escaped(e["kind"]), F.lit(" of "), escaped(F.col("name")), F.lit("</desc><type>Entrance</type></wpt>"))
    return _marks(sites, own, way)
