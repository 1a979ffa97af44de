"""What register readers share: rows chosen by rank, votes, semi and anti joins by place, lookups, digests."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo, judges, names
from waymark.functions import vocabulary as V
from waymark.functions.names import given, says
from waymark.operators import sites
from waymark.operators.sites import near_pairs, without_near
from waymark.operators.staging import staged


def with_and_without(subjects: DataFrame, wanted: DataFrame, unwanted: DataFrame, metres: float, cell: float, key: str = "key") -> DataFrame:
    """(key, n): subjects with n >= 1 of the wanted and none of the unwanted within reach."""
    counted = near_pairs(subjects, wanted, metres, cell).groupBy(key).agg(F.count("*").alias("n"))
    return counted.join(without_near(subjects, unwanted, metres, cell, key).select(key), key, "left_semi")


def first_of(df: DataFrame, keys: list[str], order: list, many: int = 1) -> DataFrame:
    """The first `many` rows of each key in an order that the caller makes total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= many).drop("__rank")


def agreed_names(members: DataFrame, place: str, name: str = "name", seq: str = "key") -> DataFrame:
    """(place, name, votes): the commonest name in lower case; ties to the one met first. Votes are counted before places meet."""
    votes = members.where(F.col(name).isNotNull()).groupBy(place, F.lower(name).alias("name")).agg(F.count("*").alias("votes"), F.min(seq).alias("__first"))
    best = votes.groupBy(place).agg(F.min_by(F.struct("name", "votes"), F.struct(-F.col("votes"), "__first")).alias("b"))
    return best.select(place, "b.name", "b.votes")


def best_members(members: DataFrame, keys: list[str], seq: str = "key") -> DataFrame:
    """The heaviest member of each group; ties to the one met first."""
    return members.groupBy(*keys).agg(F.min_by(seq, F.struct(-F.col("weight"), seq)).alias(seq), F.max("weight").alias("weight"))


def remembered(df: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """df with what a memory (one row a key) holds on its keys; `asked` tells keys that it knows, found or not."""
    return df.join(memory.withColumn("asked", F.lit(True)), key, "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def outline_extents(members: DataFrame, positions: DataFrame, outline: str, member: str) -> DataFrame:
    """(outline, lat, lng, extent_m): the middle of each outline's box and half its diagonal, rounded half to even."""
    box = members.join(positions, member).groupBy(outline).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for f, n in ((F.min, "low"), (F.max, "high"))])
    middle = [((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(c) for c in ("lat", "lng")]
    across = geo.haversine_m(F.col("low_lat"), F.col("low_lng"), F.col("high_lat"), F.col("high_lng"))
    return box.select(outline, *middle, F.bround(across / 2, 0).cast("bigint").alias("extent_m"))


def photos_of(photos: DataFrame, lat: float, lng: float, metres: float, n: int = 6, within: float = 60.0, close: float = 5.0) -> DataFrame:
    """The n photos (key, lat, lng, azimuth and perhaps thumb) of a box around a point, the nearest first, those that face away last.

    facing: whether it is turned to the point; null without an azimuth, and within `close` metres, where a bearing says nothing. Where the table has thumbs, photos without one are left out."""
    at = (F.lit(lat), F.lit(lng))
    west, south, east, north = (round(x, 6) for x in geo.box_around(lat, lng, metres))
    seen = photos.where(F.col("lat").between(south, north) & F.col("lng").between(west, east))
    if "thumb" in photos.columns:
        seen = seen.where(F.coalesce(F.col("thumb") != "", F.lit(False)))
    seen = seen.withColumn("metres", geo.haversine_m(F.col("lat"), F.col("lng"), *at))
    facing = F.when(F.col("metres") > close, geo.turned(geo.bearing_deg(F.col("lat"), F.col("lng"), *at), F.col("azimuth")) <= within)
    return seen.withColumns({"facing": facing, "away": F.coalesce(~facing, F.lit(False))}).orderBy("away", "metres", "key").limit(n)


def grid_boxes(df: DataFrame, box: tuple[float, float, float, float], step: float) -> DataFrame:
    """df's rows with each box (w, s, e, n) of a grid over a box, clipped to it, in degrees rounded to six places."""
    import math

    west, south, east, north = box
    many = lambda a, b: max(1, math.ceil(round((b - a) / step, 6)))
    out = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(many(west, east) - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(many(south, north) - 1))))
    low = lambda base, k: F.round(base + F.col(k) * step, 6)
    high = lambda base, k, most: F.round(F.least(base + (F.col(k) + 1) * step, F.lit(most)), 6)
    return out.withColumns({"w": low(west, "__i"), "s": low(south, "__j"), "e": high(west, "__i", east), "n": high(south, "__j", north)}).drop("__i", "__j")


def tag_counts(reports: DataFrame, key: str, tag: Column) -> DataFrame:
    """(key, tags): `tag:n` of each tag, commonest first, ties in the tags' order."""
    counted = reports.select(key, tag.alias("tag")).where("tag is not null").groupBy(key, "tag").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag")))
    return counted.groupBy(key).agg(ordered.alias("t")).select(key, F.array_join(F.transform("t", lambda x: F.concat_ws(":", x["tag"].cast("string"), (-x["o"]).cast("string"))), ",").alias("tags"))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, total, more) that is the same for the same rows in any order: rows, and the sums of the first and second 32 bits of each row's hash. Nulls differ from empty texts."""
    row = F.concat_ws("|", *[F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\0")) for c in columns])
    bits = lambda at: F.conv(F.substring(F.md5(row), at, 8), 16, 10).cast("bigint")
    return df.select(bits(1).alias("h"), bits(9).alias("i")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0).cast("bigint")).alias("total"), F.coalesce(F.sum("i"), F.lit(0).cast("bigint")).alias("more"))


# --- what single registers keep


def closed_care(closed: DataFrame, active: DataFrame) -> DataFrame:
    """Closed care homes, hospitals and day centres with nothing registered in their place now.

    closed: ref, name, street, line2, city, postcode, uprn, care_home, beds, category, sector, ended (date), lat, lng; active: postcode, address, name.
    Of one building (by its number, or postcode and street) the last to close counts, of equal days the first ref. One join by postcode; a building is out if any of its neighbours there has its street or name."""
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    hospital = ~F.col("care_home") & says(col("category"), V.CARE_HOSPITALS) & (F.contains(col("sector"), F.lit("NHS")) | says(col("name"), V.CARE_HOSPITAL_NAMES))
    centre = ~F.col("care_home") & ~hospital & (says(col("street"), V.CARE_CENTRE) | says(col("name"), V.CARE_CENTRE))
    wanted = closed.where(((F.col("care_home") & (F.col("beds") >= V.LEAST_BEDS)) | hospital | centre) & F.col("ended").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    named = F.when(centre, F.when(says(col("street"), V.CARE_CENTRE), F.trim(col("street"))).otherwise(F.trim(col("name")))).otherwise("")
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    post = lambda c: F.regexp_replace(F.upper(c), r"\s", "")
    building = F.coalesce(given(F.col("uprn")), F.concat(post(col("postcode")), bare(col("street"))))
    first = F.get(F.filter(F.array(col("street"), col("line2"), col("city")), lambda x: x != ""), F.lit(0))
    rows = wanted.withColumns({"centre": named, "building": building, "pc": post(col("postcode")), "line": bare(F.substring_index(F.coalesce(first, F.lit("")), ",", 1)), "bare_name": bare(F.trim(col("name")))})
    last = first_of(rows, ["building"], [F.desc("ended"), "ref"])
    now = active.select(post(col("postcode")).alias("pc"), bare(F.substring_index(col("address"), ",", 1)).alias("a_line"), bare(col("name")).alias("a_name"))
    line, other = F.col("line"), F.col("a_line")
    same = ((line != "") & (other != "") & (F.contains(line, other) | F.contains(other, line))) | ((F.col("bare_name") != "") & (F.col("bare_name") == F.col("a_name")))
    still = last.join(now, "pc").where(same).select("ref").distinct()
    return last.join(still, "ref", "left_anti").drop("building", "pc", "line", "bare_name")


def standing_empty(rows: DataFrame) -> DataFrame:
    """Estates that are wholly unoccupied or mostly empty, with `whole`: unoccupied_m2, empty_m2, floor_m2 (numbers) and site_type."""
    whole = (F.col("unoccupied_m2") > 0) | F.coalesce(F.col("site_type") == "Unoccupied", F.lit(False))
    mostly = (F.col("floor_m2") != 0) & (F.col("empty_m2") >= V.LEAST_EMPTY_M2) & (F.try_divide("empty_m2", "floor_m2") >= V.MOSTLY_EMPTY)
    return rows.withColumn("whole", whole).where(whole | F.coalesce(mostly, F.lit(False)))


def disposals(rows: DataFrame) -> DataFrame:
    """Parcels with something on them, the first ref of each establishment and parcel: ref, establishment, parcel."""
    land = says(F.col("parcel"), V.DISPOSAL_LAND) & ~says(F.col("parcel"), V.DISPOSAL_BUILDINGS)
    named = rows.where((F.trim("ref") != "") & ~land).withColumns({"e": F.upper(F.trim("establishment")), "p": F.upper(F.trim("parcel"))})
    return first_of(named, ["e", "p"], ["ref"]).drop("e", "p")


def still_closed(closed: DataFrame, open_: DataFrame, metres: float = 100.0, apart: float = 60.0, tile: int | None = None) -> DataFrame:
    """Closed schools (key, lat, lng, closed) with no open one within `metres`; of those within `apart` of each other the last to close stays, in that order one by one."""
    from waymark.operators.resolve import Places, settle
    from waymark.operators.resolve import metres as far

    class Kept(Places):
        def decide(self, r: dict) -> tuple[str, str | None]:
            return next((p["key"] for p in self.near(r) if far(r, p) < apart), r["key"]), None

    left = without_near(closed, open_.select("lat", "lng"), metres, 0.002)
    made = {"f": F.lit(2), "name": F.lit(None).cast("string"), "kind": F.lit(""), "weight": F.lit(0), "aliases": F.lit(None).cast("array<string>"), "reach": F.lit(apart), "decides": F.lit(True), "w": -F.coalesce(F.unix_date("closed"), F.lit(-1_000_000))}
    rows = left.select("key", "lat", "lng", *[v.alias(k) for k, v in made.items()])
    kept = settle(rows, ["w", "key"], Kept, 0.002, tile, 50, "schools")
    return left.join(kept.where("to = key").select("key"), "key", "left_semi")


def shafts_of_quarries(labels: DataFrame) -> DataFrame:
    """Quarry labels (pin_id, final_text, lat, lng) with how many air shafts lie within 500 m; those with a mine's workings as near are left out."""
    text = F.trim(F.coalesce("final_text", F.lit("")))
    shaft = says(text, V.SHAFT_LABEL)
    at = labels.select(F.col("pin_id").alias("key"), "lat", "lng", shaft.alias("shaft"), (~shaft & says(text, V.MINE_LABEL)).alias("mine"), F.lower(text).isin(V.QUARRY_LABELS).alias("quarry"))
    spot = lambda c: at.where(c).select("key", "lat", "lng")
    found = with_and_without(spot("quarry"), spot("shaft").drop("key").withColumn("key", F.lit("")), spot("mine"), V.UNDERGROUND_WITHIN_M, 0.01)
    return labels.join(found.select(F.col("key").alias("pin_id"), F.col("n").alias("air_shafts")), "pin_id")


def converted_again(applications: DataFrame) -> DataFrame:
    """Houses approved for conversion into three flats or more and applied for again 548 days or more after: ref of the last application, house, how many approvals lapsed, their years, weight.

    applications: ref, council, address, description, app_state, start_date, decided_date. A house's applications are put in order by a window; approvals are counted before they meet."""
    said = judges.squashed(F.col("description"))
    fits = ~says(said, V.FOLLOW_UP) & ~says(said, V.NO_DECISION) & (F.coalesce(names.units(said), F.lit(3)) >= 3)
    rows = applications.where(fits).withColumn("house", names.house_key(F.col("council"), F.col("address"))).where("house is not null")
    w = Window.partitionBy("house").orderBy(F.asc_nulls_first("start_date"), "ref")
    later = F.max("start_date").over(w.rowsBetween(1, Window.unboundedFollowing))
    approved = F.col("app_state").isin([k for k, v in V.DECIDED.items() if v == "approved"])
    marked = rows.withColumn("lapsed", F.coalesce(approved & (later >= F.date_add("decided_date", V.DONE_AFTER_DAYS)), F.lit(False)))
    years = F.array_join(F.array_sort(F.collect_set(F.when(F.col("lapsed"), F.year("decided_date")))).cast("array<string>"), " and ")
    found = marked.groupBy("house").agg(F.count_if("lapsed").alias("lapses"), years.alias("years"), F.max_by("ref", F.struct(F.coalesce("start_date", F.lit("0001-01-01").cast("date")), "ref")).alias("ref"))
    return found.where("lapses > 0").withColumn("weight", F.when(F.col("lapses") > 1, 16).otherwise(12))


def later_applications(applications: DataFrame) -> DataFrame:
    """(ref, later): for each application those made afterwards about the same house, as `judges.planning` takes them. Houses meet by council and the first three words of their address."""
    rows = applications.withColumn("house", names.house_key(F.col("council"), F.col("address"))).where("house is not null")
    other = F.struct(judges.squashed(F.col("description")).alias("said"), F.col("start_date").alias("started"), F.col("decided_date").alias("decided"), F.col("app_state").alias("state"), F.substring_index("ref", "/", -2).alias("ref"))
    after = rows.select("house", F.col("start_date").alias("after"), other.alias("o"))
    pairs = rows.select("ref", "house", "start_date").join(after, "house").where("after > start_date")
    return pairs.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct(F.col("o.started").alias("started"), F.col("o").alias("o")))).alias("l")).select("ref", F.transform("l", lambda x: x["o"]).alias("later"))


def planning_committees(committees: DataFrame, name: str = "name") -> DataFrame:
    """Committees that decide planning applications, by their name; not those that write policy, nor those whose years ended long ago."""
    from waymark.operators.papers import wound_up

    return committees.where(says(F.col(name), V.PLANNING_COMMITTEE) & ~says(F.col(name), V.OTHER_COMMITTEE) & ~wound_up(F.col(name)))


def stale_intros(titles: DataFrame, intros: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Titles without an introduction fetched in the last `days`."""
    fresh = intros.where(F.col("fetched_at") >= F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))
    return titles.select("title").distinct().join(fresh.select("title"), "title", "left_anti")


PIECE_M = 200.0
#: What it takes to send a row to a cell, and to measure what is near, told in pairs looked at; legs near a place that are likely to have its nearest among them; places that a task holds while legs go by.
SENT, MEASURED, ENOUGH, HELD = 20, 50, 8, 100_000


def line_legs(features: DataFrame) -> DataFrame:
    """features (line: array of lat, lng; other columns stay) as legs from point to point: a_lat, a_lng, b_lat, b_lng. A lone point is a leg of its own; features without points give none."""
    points = F.col("line")
    ends = F.when(F.size(points) == 1, F.array(F.struct(points[0].alias("a"), points[0].alias("b")))).otherwise(F.zip_with(points, F.slice(points, 2, F.greatest(F.lit(1), F.size(points))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    legs = features.withColumn("leg", F.explode(ends)).where("leg.b is not null").drop("line")
    return legs.withColumns({f"{end}_{c}": F.col(f"leg.{end}.{c}") for end in "ab" for c in ("lat", "lng")}).drop("leg")


def line_pieces(features: DataFrame) -> DataFrame:
    """features (line: array of lat, lng; other columns stay) as pieces of at most PIECE_M: a_lat, a_lng, b_lat, b_lng and the middle's lat and lng. A lone point is a piece of its own; features without points give none.

    So an index by cell holds a line wherever it runs, and one of any length is many rows. Lines across the 180th meridian are to be cut there."""
    ends = {end: F.struct(F.col(f"{end}_lat").alias("lat"), F.col(f"{end}_lng").alias("lng")) for end in "ab"}
    legs = line_legs(features).withColumns(ends).drop("a_lat", "a_lng", "b_lat", "b_lng")
    long = geo.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    cut = legs.withColumn("n", F.greatest(F.lit(1), F.ceil(long / PIECE_M)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c, i: F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * i / F.col("n")
    made = {f"{end}_{c}": at(c, F.col("i") + k) for k, end in enumerate("ab") for c in ("lat", "lng")} | {c: at(c, F.col("i") + 0.5) for c in ("lat", "lng")}
    return cut.withColumns(made).drop("a", "b", "n", "i")


def nearest_of_piece(lat: Column, lng: Column) -> Column:
    """struct<lat, lng>: the nearest point of a joined piece (r_a_lat ...), on the plane in which longitudes are scaled by the place's own latitude."""
    k = F.cos(F.radians(lat))
    x = lng - F.col("r_a_lng")
    x = F.when(F.abs(x) > 180, x - 360 * F.signum(x)).otherwise(x)
    dx, dy = (F.col("r_b_lng") - F.col("r_a_lng")) * k, F.col("r_b_lat") - F.col("r_a_lat")
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x * k * dx + (lat - F.col("r_a_lat")) * dy) / long))).otherwise(F.lit(0.0))
    return F.struct((F.col("r_a_lat") + t * dy).alias("lat"), (F.col("r_a_lng") + t * (F.col("r_b_lng") - F.col("r_a_lng"))).alias("lng"))


def near_legs(spots: DataFrame, legs: DataFrame, metres: float, cell: float) -> DataFrame:
    """Pairs of spots (lat, lng) and legs (a_lat, a_lng, b_lat, b_lng; all columns get r_) within `metres`: all of them, with p, the leg's nearest point, and metres.

    A leg stands in the cells that it runs through (`cell` degrees), and a spot in those that its circle touches: the smaller both are, the fewer pairs are looked at in vain."""
    edge = (F.abs("lat") > (80 if metres <= 5_000 else -1)) | (F.abs("lng") > 179)
    around = sites.circle_cells(spots.where("lat is not null and lng is not null").withColumns({"k": F.cos(F.radians("lat")), "edge": edge}), metres, cell)
    other = sites.leg_cells(legs.where(" and ".join(f"{c} is not null" for c in ("a_lat", "a_lng", "b_lat", "b_lng"))), cell)
    other = other.select(*[F.col(c).alias(f"r_{c}") for c in legs.columns], "gy", "gx")
    # the plane tells most pairs off: its error is below a hundredth here, but not close to a pole nor far away. A box along the leg, which for a point is a circle
    x, y = (F.col("lng") - F.col("r_a_lng")) * F.col("k"), F.col("lat") - F.col("r_a_lat")
    dx, dy = (F.col("r_b_lng") - F.col("r_a_lng")) * F.col("k"), F.col("r_b_lat") - F.col("r_a_lat")
    close, long = 1.02 * metres / 111_194 + 1e-9, F.hypot(dx, dy)
    beside, along = F.abs(dx * y - dy * x) <= close * long, F.abs(2 * (dx * x + dy * y) - long * long) <= long * (long + 2 * close)
    met = sites.meet(around, other, spots.columns, HELD, 10).where(F.col("edge") | (beside & along & (F.hypot(x, y) <= long + close)))
    pairs = met.select("*", F.explode(F.array(nearest_of_piece(F.col("lat"), F.col("lng")))).alias("p"))
    far = pairs.withColumn("metres", geo.haversine_m(F.col("lat"), F.col("lng"), F.col("p.lat"), F.col("p.lng"))).where(F.col("metres") <= metres)
    # of all cells that both touch, the one with p has the pair
    return far.where((F.col("gy") == sites.row_of(F.col("p.lat"), cell)) & (F.col("gx") == sites.column_of(F.col("p.lng"), F.col("gy"), cell))).drop("k", "edge", "gy", "gx")


def reach_and_cell(spots: DataFrame, legs: DataFrame, metres: float, last: float, enough: float) -> tuple[float, float] | None:
    """How far to look for legs around spots so that `enough` of them are found there on average, half a metre beyond a whole number and farther than last; `metres` itself where that is no dearer. And the size of cells, in degrees, with the least work. None where no spots are left.

    All from six sums over a coarse grid: a circle meets legs by their length and number, and so does a cell."""
    side = 0.005
    count = lambda df: df.groupBy("gy", "gx")
    a, b = (F.col("a_lat"), F.col("a_lng")), (F.col("b_lat"), F.col("b_lng"))
    middle = legs.select(((a[0] + b[0]) / 2).alias("lat"), ((a[1] + b[1]) / 2).alias("lng"), geo.haversine_m(*a, *b).alias("long"))
    here, there = count(sites.own_cell(spots, "lat", "lng", side)).agg(F.count("*").alias("p")), count(sites.own_cell(middle, "lat", "lng", side)).agg(F.count("*").alias("n"), F.sum("long").alias("m"))
    p, n, m = (F.coalesce(c, F.lit(0.0)) for c in "pnm")
    sums = here.join(there, ["gy", "gx"], "full").agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in (p, n, m, p * n, p * m, F.when(n > 0, p))]).first()
    places, number, length, by_number, by_length, beside = sums
    if last and not places:
        return None
    area = (side * 111_194) ** 2
    met = lambda r: (2 * r * by_length + math.pi * r * r * by_number) / area
    looked = lambda w: (w * w * by_number + 4 / math.pi * w * by_length) / area
    work = lambda r, c: SENT * (number + 4 / math.pi * length / c + places * (1 + 2 * r / c) ** 2) + looked(c + 2 * r)
    best = lambda r: min((r * 2.0 ** (i / 2) for i in range(-2, 24)), key=lambda c: work(r, c))
    reach = next((r for r in (n * 2.0**i + 0.5 for i in range(20) for n in (1, 1.5)) if r % 1 and r > last and met(r) >= enough * beside), metres)
    if reach > metres / 2 or looked(best(metres) + 2 * metres) + MEASURED * met(metres) <= 4 * sites.TASK_PAIRS:
        reach = metres
    return reach, best(reach) / 111_194


def access_summary(places: DataFrame, features: DataFrame) -> DataFrame:
    """Of each place (key, lat, lng): the nearest public right of way, the nearest other path if nearer, the nearest public car park, and up to three things that are private next to it. A row for every place.

    features: line (array of lat, lng; one point for a node), tags. Paths count within 400 m, parking within 800 m, private things within 50 m. A class is joined by cell with its own reach; where much stands around, what is close by settles most places, and the rest looks farther."""
    t = lambda k: F.col(f"__{k}")
    yes = lambda c: F.coalesce(c, F.lit(False))
    shut = yes(t("access").isin("private", "no")) | yes(t("foot").isin("private", "no"))
    way, parking = F.size("line") > 1, yes(t("amenity") == "parking")
    path, right = yes(t("highway").isin(V.PATH_HIGHWAYS)), F.coalesce(*[F.when(t("designation") == k, v) for k, v in V.RIGHTS_OF_WAY.items()])
    words = lambda k: F.replace(given(t(k)), F.lit("_"), F.lit(" "))
    thing = F.coalesce(F.concat(F.lit("a "), words("barrier")), F.concat(F.lit("a "), words("highway")), F.concat(F.coalesce(words("landuse"), words("leisure")), F.lit(" land")), F.concat(F.lit("a "), words("amenity")), F.lit("something"))
    label = F.coalesce(*[F.when(t("highway") == k, v) for k, v in V.PATH_LABELS.items()], F.lit("Path"))
    classes = {
        "parking": (V.PARKING_M, parking & ~shut & ~yes(t("access") == "customers"), F.coalesce(given(t("name")), F.lit("parking"))), "right": (V.PATH_M, ~parking & ~shut & way & right.isNotNull(), right),
        "path": (V.PATH_M, ~parking & ~shut & way & path & right.isNull(), label), "private": (V.PRIVATE_M, ~parking & shut, thing),
    }
    kind = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("class"), what.alias("what"), F.coalesce(given(t("prow_ref")), given(t("ref"))).alias("ref"), yes(t("fee") == "yes").alias("fee"))) for k, (_, c, what) in classes.items()])
    # tags are looked up once; legs are read once for each reach, and by all cores: a file of few bytes would else be one task, though each of its legs goes to many cells
    cores = places.sparkSession.sparkContext.defaultParallelism
    asked = features.select("line", *[names.tag(F.col("tags"), k).alias(f"__{k}") for k in ("access", "foot", "amenity", "highway", "designation", "barrier", "landuse", "leisure", "name", "prow_ref", "ref", "fee")])
    legs = staged(line_legs(asked.select("line", judges.leads(kind))).repartition(cores, "a_lat", "a_lng"), "legs")
    spots = staged(places.select("key", "lat", "lng").repartition(cores, "key"), "spots")

    def nearest(pairs: DataFrame) -> DataFrame:
        wind = geo.compass(geo.bearing_deg(F.col("lat"), F.col("lng"), F.col("p.lat"), F.col("p.lng")))
        far = pairs.withColumn("d", F.bround("metres", 0).cast("bigint"))
        return far.groupBy("key").agg(F.min(F.struct("d", F.col("r_what").alias("what"), wind.alias("direction"), F.col("r_ref").alias("ref"), F.col("r_fee").alias("fee"))).alias("n"))

    def three(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("key", F.col("r_what").alias("what")).agg(F.min(F.bround("metres", 0).cast("bigint")).alias("d"))
        return least.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "what"))), 1, 3).alias("n"))  # as many as there are kinds of things

    def told(k: str, reach: float) -> DataFrame:
        own, left, close, found = legs.where(F.col("class") == k).drop("class"), spots, 0.0, []
        own = own.drop("ref", "fee") if k == "private" else own
        most = own.select("what").distinct().limit(3).count() if k == "private" else 1
        while close < reach and (planned := reach_and_cell(left, own, reach, close, ENOUGH * most)):
            close, cell = planned
            near = (three if k == "private" else nearest)(near_legs(left, own, close, cell))
            if close < reach:
                near = staged(near, "close-by")
                # what isn't found yet is farther off than any of these, and of equal metres all are found
                near = near.where((F.get("n", F.lit(most - 1))["d"] if k == "private" else F.col("n.d")) <= close - 0.5)
                left = staged(left.join(near.select("key"), "key", "left_anti"), "without")
            found.append(near)
        return functools.reduce(DataFrame.unionAll, found).withColumnRenamed("n", k)

    by = functools.reduce(lambda by, k: by.join(told(k, classes[k][0]), "key", "left"), classes, places.select("key"))
    nearer = F.when(F.col("right").isNull() | (F.col("path.d") < F.col("right.d")), F.col("path"))
    private = F.coalesce(F.transform("private", lambda x: x["what"]), F.array().cast("array<string>"))
    return by.select("key", F.col("right").alias("right_of_way"), nearer.alias("path"), "parking", private.alias("private"))


def railway_structures(rows: DataFrame) -> DataFrame:
    """Tunnels and viaducts with lat and lng, the first of each ref: ref, kind, os_ref (a grid reference) and whatever else rows have. Malformed references are left out."""
    kept = rows.where(F.col("kind").isin("Tunnel", "Viaduct")).withColumn("__g", geo.grid_ref_metres(F.col("os_ref"))).where("__g is not null")
    once = first_of(kept.withColumn("kind", F.lower("kind")), ["ref"], ["os_ref", "kind"])
    return geo.from_grid(once.withColumns({"easting": F.col("__g.easting"), "northing": F.col("__g.northing")})).drop("__g", "easting", "northing")


def placed_by_postcode(rows: DataFrame, centroids: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """rows with the lat and lng of their postcode; those whose postcode isn't known are left out. centroids: postcode, lat, lng, one row each; retired: postcodes no longer in use, asked where the first table has no position."""
    bare = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s", "")
    known = lambda df, to: df.where((bare(F.col("postcode")) != "") & F.col("lat").isNotNull() & F.col("lng").isNotNull()).select(bare(F.col("postcode")).alias("__p"), F.struct("lat", "lng").alias(to))
    at = known(centroids, "__at")
    if retired is not None:
        at = at.join(known(retired, "__old"), "__p", "full").select("__p", F.coalesce("__at", "__old").alias("__at"))
    return rows.withColumn("__p", bare(F.col("postcode"))).join(at, "__p").select(*[F.col(f"`{c}`") for c in rows.columns], "__at.lat", "__at.lng")


def estates_return(rows: DataFrame, file: str = "") -> DataFrame:
    """A yearly return's sites as `standing_empty` takes them: ref, name, trust, site_type, postcode, unoccupied_m2, empty_m2, floor_m2, pre_1948, year.

    Editions spell the units differently, so areas are the first column whose name starts as expected; none: naught, as for what isn't a number. The year is in the file's name."""
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`") if c in rows.columns else F.lit(""), F.lit("")))
    area = lambda start: F.coalesce(F.replace(text(next((c for c in rows.columns if c.startswith(start)), start)), F.lit(",")).try_cast("double"), F.lit(0.0))
    year = re.search(r"(\d{4})_(\d{2})", file)
    told = {"ref": F.coalesce(given(text("Site Code")), text("Site Name")), "name": text("Site Name"), "trust": text("Trust Name"), "site_type": text("Site Type"), "postcode": text("Post Code")}
    areas = {c: area(start) for c, start in V.ESTATE_AREAS.items()}
    return rows.select(*[c.alias(k) for k, c in (told | areas).items()], F.lit("/".join(year.groups()) if year else "").alias("year"))



def notices(pages: DataFrame) -> DataFrame:
    """Disclaimer notices of saved pages (id, html), parsed: id and the fields of `judges.parse_notice`; pages without one are left out."""
    from waymark.functions.text import html_text

    plain = html_text(F.col("html"))
    start, end = F.instr(F.upper(plain), "NOTICE OF DISCLAIMER"), F.instr(plain, " Actions Save notice")
    words = F.when(start > 0, F.substr(plain, start, F.when(end > start, end - start).otherwise(F.length(plain))))
    return pages.select("id", judges.parse_notice(words).alias("n")).where("n is not null").select("id", "n.*")


def unread(listed: DataFrame, read: DataFrame, key: str = "id") -> DataFrame:
    """What is listed and hasn't been read: keys with no row of `read` that has a text."""
    return listed.join(read.where(given(F.col("text")).isNotNull()).select(key), key, "left_anti")
