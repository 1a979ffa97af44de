"""Queries of the register operators, beside those of `queries`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import registers
from waymark.operators.staging import shared_folder
from waymark.plans import samples as S
from waymark.plans import views as v
from waymark.plans.queries import HAV, RING, query
from waymark.plans.samples import picked, picked_sql
from waymark.sources import versions
from waymark.streaming import changes

PLACE = "round(lat / 0.01::double, 0) || ',' || round(lng / 0.01::double, 0)"


def placed(spark, sf):
    at = lambda c: F.round(F.col(c) / 0.01, 0).cast("string")
    return v.dense(spark, sf).withColumn("place", F.concat_ws(",", at("lat"), at("lng")))


def _within(source: str) -> str:
    return f"select 1 from {v.DENSE} b where {source} and {HAV.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} <= 500"


@query(f"select * from (select a.key, (select count(*) from ({_within(chr(98) + '.source = ' + repr('nhs'))})) n from {v.DENSE} a where a.source = 'osm' and not exists ({_within('b.source = ' + repr('schools') + ' and b.weight >= 36')})) where n > 0")
def shafts_without_mines(spark, sf):
    """Places with some of one kind and none of another within 500 m."""
    d = v.dense(spark, sf)
    some = lambda where: d.where(where).select("key", "lat", "lng")
    return registers.with_and_without(some("source = 'osm'"), some("source = 'nhs'"), some("source = 'schools' and weight >= 36"), 500, 0.01)


@query(f"select place, name, votes from (select *, row_number() over (partition by place order by votes desc, f) r from (select {PLACE} as place, lower(name) as name, count(*) votes, min(key) f from {v.DENSE} group by all)) where r = 1")
def agreed_names(spark, sf):
    return registers.agreed_names(placed(spark, sf), "place")


@query(f"select place, source, key, weight from (select {PLACE} as place, source, key, weight, row_number() over (partition by {PLACE}, source order by weight desc, key) r from {v.DENSE}) where r = 1")
def best_members(spark, sf):
    return registers.best_members(placed(spark, sf), ["place", "source"])


@query(f"select id, key from (select *, row_number() over (partition by key order by seen desc, id desc) r from {v.REPORTS}) where r <= 12")
def report_history(spark, sf):
    return registers.first_of(v.reports(spark, sf), ["key"], [F.desc("at"), F.desc("id")], 12).select("id", "key")


@query("select event_type, status, event_id, ts from (select *, row_number() over (partition by event_type, status order by ts desc, event_id desc) r from (select *, case when event_id % 5 = 0 then 'failed' when event_id % 7 = 0 then 'paused' else 'done' end as status from events)) where r = 1")
def latest_runs(spark, sf):
    """The last run of each source with each status."""
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 7 == 0, "paused").otherwise("done")
    runs = v.table(spark, sf, "events").withColumn("status", status)
    return registers.first_of(runs, ["event_type", "status"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "status", "event_id", "ts")


@query("select l_partkey, l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_orderkey, l_linenumber) r from lineitem) where r = 1")
def first_per_pair(spark, sf):
    rows = v.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("f"))
    return rows.select("l_partkey", "l_suppkey", "f.l_orderkey", "f.l_linenumber")


@query(f"select id, start from (select *, case when id % 4 <> 0 then decided end checked from {v.APPLICATIONS}) order by checked nulls first, start desc, id limit 90")
def next_checks(spark, sf):
    """Never checked first, then the oldest check; of those the newest application."""
    queue = v.applications(spark, sf).withColumn("checked", F.when(F.col("id") % 4 != 0, F.col("decided")))
    return queue.orderBy(F.asc_nulls_first("checked"), F.desc("start"), "id").limit(90).select("id", "start")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, s.s_name as name, s.s_suppkey is not null as asked from lineitem left join supplier s on s.s_suppkey = l_partkey")
def remembered_lookups(spark, sf):
    """Lookups by key in a memory that knows some of the keys."""
    memory = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_partkey"), F.col("s_name").alias("name"))
    return registers.remembered(v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), memory, "l_partkey")


@query(f"""select o, round((a + b) / 2, 6) lat, round((c + d) / 2, 6) lng, cast(round_even({HAV.format(a='a', b='c', c='b', d='d')} / 2, 0) as bigint) extent_m
 from (select l_orderkey o, min(lat) a, max(lat) b, min(lng) c, max(lng) d from lineitem join {v.DENSE} on key = 'p:' || l_partkey group by l_orderkey)""")
def outline_extents(spark, sf):
    members = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("key"))
    found = registers.outline_extents(members, v.dense(spark, sf).select("key", "lat", "lng"), "o", "key")
    return found.withColumns({c: F.round(c, 6) for c in ("lat", "lng")})


@query(f"""with p as (select key, lat, lng, case when weight % 5 <> 0 then weight * 9.0::double end azimuth, {HAV.format(a='lat', b='lng', c='51.4::double', d='-2.2::double')} m from {v.DENSE}
  where weight <> 20 and abs(lat - 51.4::double) <= 3000::double / 111320 and abs(lng + 2.2::double) <= 3000::double / 111320 / cos(radians(51.4::double))),
 b as (select *, (degrees(atan2(sin(radians(-2.2::double - lng)) * cos(radians(51.4::double)), cos(radians(lat)) * sin(radians(51.4::double)) - sin(radians(lat)) * cos(radians(51.4::double)) * cos(radians(-2.2::double - lng)))) + 720 - azimuth) % 360 turn from p),
 f as (select key, m, case when m > 5 then least(turn, 360 - turn) <= 60 end facing from b)
 select key, facing, coalesce(not facing, false) away, round(m, 4) metres from f order by away, m, key limit 200""")
def photos_of_place(spark, sf):
    photos = v.dense(spark, sf).withColumns({"azimuth": F.when(F.col("weight") % 5 != 0, F.col("weight") * 9.0), "thumb": F.when(F.col("weight") != 20, F.col("key"))})
    return registers.photos_of(photos, 51.4, -2.2, 3000, 200).select("key", "facing", "away", F.round("metres", 4).alias("metres"))


@query("""select r_regionkey, round(-6 + i * 0.7::double, 6) w, round(50 + j * 0.7::double, 6) s, round(least(-6 + (i + 1) * 0.7::double, -2), 6) e, round(least(50 + (j + 1) * 0.7::double, 53), 6) n
 from region, generate_series(0, 5) a(i), generate_series(0, 4) b(j)""")
def grid_boxes(spark, sf):
    return registers.grid_boxes(v.table(spark, sf, "region").select("r_regionkey"), (-6.0, 50.0, -2.0, 53.0), 0.7)


@query(f"""select key, string_agg(tag || ':' || n, ',' order by n desc, tag) tags from (select user_id % 50 as key, cast(json_extract_string(props, '$.k') as int) % 5 as tag, count(*) n from events group by all) where tag is not null group by key""")
def report_tags(spark, sf):
    tagged = v.table(spark, sf, "events").select((F.col("user_id") % 50).alias("key"), "props")
    return registers.tag_counts(tagged, "key", F.get_json_object("props", "$.k").cast("int") % 5)


@query(f"select count(*) n, cast(sum(cast('0x' || substr(h, 1, 8) as bigint)) as bigint) total, cast(sum(cast('0x' || substr(h, 9, 8) as bigint)) as bigint) more from (select md5(key || '|' || name || '|' || category) h from {v.SITES})")
def site_digest(spark, sf):
    return registers.digest(v.sites(spark, sf), ["key", "name", "category"])


@query(f"select count(*) || '@' || strftime(max(coalesce(added, first_seen)), '%Y-%m-%d %H:%M:%S') as stamp, min(first_seen) as earliest from {v.SITES}")
def site_stamp(spark, sf):
    latest = F.date_format(F.max(F.coalesce("added", "first_seen")), "yyyy-MM-dd HH:mm:ss")
    return v.sites(spark, sf).agg(F.concat(F.count("*").cast("string"), F.lit("@"), latest).alias("stamp"), F.min("first_seen").alias("earliest"))


@query(f"select split_part(key, ':', 1) as label, count(*) n from (select key from {v.SITES} union all select key from {v.DENSE}) group by all")
def label_counts(spark, sf):
    keys = v.sites(spark, sf).select("key").unionAll(v.dense(spark, sf).select("key"))
    return keys.groupBy(F.substring_index("key", ":", 1).alias("label")).agg(F.count("*").alias("n"))


@query("select l_partkey k from lineitem where l_quantity > 45 union select l_partkey from lineitem where l_discount > 0.09")
def ids_of_terms(spark, sf):
    """Distinct ids over several search terms: the terms are one filter, so the table is read once."""
    return v.table(spark, sf, "lineitem").where("l_quantity > 45 or l_discount > 0.09").select(F.col("l_partkey").alias("k")).distinct()


@query("select page_id, count(distinct link) links from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) link from pages) group by page_id")
def page_links(spark, sf):
    links = v.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id").agg(F.count_distinct("link").alias("links"))


@query("select doc_id, nullif(regexp_extract(text, '(^|[^A-Z0-9])([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})($|[^A-Z0-9])', 2), '') postcode from documents")
def postcodes(spark, sf):
    found = F.regexp_extract("text", "(^|[^A-Z0-9])([A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2})($|[^A-Z0-9])", 2)
    return v.table(spark, sf, "documents").select("doc_id", F.nullif(found, F.lit("")).alias("postcode"))


@query(f"select key, round(lng, 6) lng, round(lat, 6) lat from {v.SITES}")
def wkt_points(spark, sf):
    text = v.sites(spark, sf).select("key", F.format_string("POINT (%.8f %.8f)", "lng", "lat").alias("t"))
    return text.select("key", geo.wkt_point(F.col("t")).alias("p")).select("key", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


_SEGMENTS = " union all ".join(f"select {x1}::double x1, {y1}::double y1, {x2}::double x2, {y2}::double y2" for (x1, y1), (x2, y2) in zip(RING, RING[1:]))


@query(f"""select key, round(min(pow((lng - x1 - t * (x2 - x1)) * k, 2) + pow(lat - y1 - t * (y2 - y1), 2)), 6) square from (select *, least(1, greatest(0, ((lng - x1) * k * (x2 - x1) * k + (lat - y1) * (y2 - y1)) / (pow((x2 - x1) * k, 2) + pow(y2 - y1, 2)))) t
 from (select *, cos(radians(lat)) k from {v.SITES}), ({_SEGMENTS})) group by key""")
def nearest_on_line(spark, sf):
    found = geo.nearest_on_line(F.col("lat"), F.col("lng"), RING)
    return v.sites(spark, sf).select("key", F.round(found["square"], 6).alias("square"))


SQUARES = (-5.5, 50.25, -1.25, 53.75)


@query(f"select key, floor(lat)::int sq_lat, floor(lng)::int sq_lng from {v.SITES} where lng between -5.5 and -1.25 and lat between 50.25 and 53.75")
def squares_in_box(spark, sf):
    """Sites of a box, read from a copy that is laid out by squares."""
    path = f"{shared_folder(spark)}/squares-{uuid.uuid4().hex}"
    versions.write_squares(v.sites(spark, sf).select("key", "lat", "lng"), path)
    return versions.read_squares(spark, path, SQUARES).select("key", "sq_lat", "sq_lng")


@query()
def grid_references(spark, sf):
    """British grid metres and reference of each site; golden points and a round trip are tested."""
    return geo.to_grid(v.sites(spark, sf).select("key", "lat", "lng")).select("key", "easting", "northing", geo.grid_ref(F.col("easting"), F.col("northing")).alias("ref"))


# --- what single registers keep

CARE = [
    {"home": True, "beds": 25, "category": "Residential", "sector": "Social", "street": "1 Elm Road", "shift": 0}, {"home": True, "beds": 19, "category": "Residential", "sector": "Social", "street": "2 Elm Road", "shift": 0},
    {"home": False, "beds": 0, "category": "Hospital services", "sector": "NHS", "street": "3 Oak Way", "shift": 1}, {"home": False, "beds": 0, "category": "Hospital services", "sector": "Private", "street": "4 Oak Way", "shift": 1},
    {"home": False, "beds": 0, "category": "Community", "sector": "Social", "street": "Five Ways Day Centre, Low Street", "shift": 2}, {"home": True, "beds": 60, "category": "Nursing", "sector": "Social", "street": "6 Fir Court", "shift": 3}, {"home": True, "beds": 60, "category": "Nursing", "sector": "Social", "street": "", "shift": 3},
]
_CLOSED = f"""(select id as ref, pname as name, street, home, beds, category, sector, 'BA' || (id % 50) || ' 1AA' as postcode, date '2010-01-01' + ((id * 37) % 3000)::int as ended from {picked_sql(CARE)})"""
_ACTIVE = "(select 'ba' || (s_suppkey % 60) || '1aa' as postcode, case s_suppkey % 4 when 0 then '1 elm road, Bath' when 1 then 'Oak Way' when 2 then '' else 'Five Ways Day Centre' end as address, s_name as name from supplier)"


@query(f"""with w as (select *, not home and regexp_matches(category, '(?i)hospital|hospice') and (sector = 'NHS' or regexp_matches(name, '(?i)hospital|hospice|infirmary|asylum|nursing home|sanatorium')) hosp from {_CLOSED}),
 k as (select *, not home and not hosp and regexp_matches(street || '|' || name, '(?i)\\b(?:resource|day|training|activity|activities|respite|social education|adult education)\\s+(?:centre|center)\\b') centre from w),
 l as (select * from (select *, row_number() over (partition by replace(postcode, ' ', '') || regexp_replace(lower(street), '[^a-z0-9]', '', 'g') order by ended desc, ref) r from k where (home and beds >= 20) or hosp or centre) where r = 1),
 a as (select replace(upper(postcode), ' ', '') pc, regexp_replace(lower(split_part(address, ',', 1)), '[^a-z0-9]', '', 'g') al, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') an from {_ACTIVE}),
 m as (select *, regexp_replace(lower(split_part(coalesce(nullif(street, ''), 'Bath'), ',', 1)), '[^a-z0-9]', '', 'g') line from l)
 select ref, case when centre then street else '' end as centre, strftime(ended, '%Y-%m-%d') as ended from m where not exists (select 1 from a where a.pc = replace(m.postcode, ' ', '') and ((line <> '' and al <> '' and (contains(line, al) or contains(al, line))) or an = regexp_replace(lower(m.name), '[^a-z0-9]', '', 'g')))""")
def closed_care(spark, sf):
    """Closed care buildings with nothing registered there now."""
    k = F.col("id")
    rows = picked(spark, sf, CARE).select(
        k.alias("ref"), F.col("pname").alias("name"), "street", F.lit("").alias("line2"), F.lit("Bath").alias("city"), F.concat(F.lit("BA"), (k % 50).cast("string"), F.lit(" 1AA")).alias("postcode"), F.lit("").alias("uprn"), F.col("home").alias("care_home"), "beds", "category", "sector",
        F.date_add(F.lit("2010-01-01").cast("date"), ((k * 37) % 3000).cast("int")).alias("ended"), F.lit(51.0).alias("lat"), F.lit(-2.0).alias("lng"),
    )
    s = F.col("s_suppkey")
    at = F.when(s % 4 == 0, "1 elm road, Bath").when(s % 4 == 1, "Oak Way").when(s % 4 == 2, "").otherwise("Five Ways Day Centre")
    active = v.table(spark, sf, "supplier").select(F.concat(F.lit("ba"), (s % 60).cast("string"), F.lit("1aa")).alias("postcode"), at.alias("address"), F.col("s_name").alias("name"))
    return registers.closed_care(rows, active).select("ref", "centre", F.col("ended").cast("string").alias("ended"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity > 45 or l_returnflag = 'A') as whole from lineitem where l_quantity > 45 or l_returnflag = 'A' or (l_extendedprice <> 0 and l_discount * 100000 >= 1000 and l_discount * 100000 / l_extendedprice >= 0.5)")
def empty_estates(spark, sf):
    """Estates wholly or mostly empty, over line items: quantity as unoccupied floor, discount as empty floor, price as the whole."""
    li = v.table(spark, sf, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(F.col("l_quantity") - 45, F.lit(0.0)).alias("unoccupied_m2"), (F.col("l_discount") * 100000).alias("empty_m2"), F.col("l_extendedprice").alias("floor_m2"), F.when(F.col("l_returnflag") == "A", "Unoccupied").alias("site_type"))
    return registers.standing_empty(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "whole")


PARCELS = [{"parcel": p} for p in ("Land at Hill", "Misc land", "Playing fields", "Main buildings and land at Hill", "Barracks", "Training Area", "Mess", "", "Sewage works", "Island")]


@query(f"""select ref, parcel from (select *, row_number() over (partition by upper(pname), upper(parcel) order by ref) r from (select 'r' || lpad(id::varchar, 9, '0') as ref, * from {picked_sql(PARCELS)}) where parcel not in ('Land at Hill', 'Misc land', 'Playing fields', 'Training Area', 'Sewage works', 'Island')) where r = 1""")
def kept_parcels(spark, sf):
    rows = picked(spark, sf, PARCELS).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("ref"), F.col("pname").alias("establishment"), "parcel")
    return registers.disposals(rows).select("ref", "parcel")


@query()
def closed_schools_kept(spark, sf):
    """Closed schools with none open near, the last to close of each spot; tested against a one-by-one choice."""
    k = F.substr("key", F.lit(3)).cast("bigint")
    d = v.dense(spark, sf).withColumn("closed", F.date_add(F.lit("2000-01-01").cast("date"), (k % 1000).cast("int")))
    return registers.still_closed(d.where("source <> 'nhs'").select("key", "lat", "lng", "closed"), d.where("source = 'nhs'").select("lat", "lng")).select("key", "closed")


SPOTS = [{"final_text": x} for x in ("Quarry", "Air Shaft", "Old Quarry", "Air Shafts", "Old Level", "Ventilating Shaft", "Quarry (disused)", "Mill", "Quarries", "Level Crossing")]
_SPOTS = f"(select s.id::varchar as pin_id, s.final_text as t, d.lat, d.lng from {picked_sql(SPOTS)} s join {v.DENSE} d on d.key = 'p:' || s.id)"


def _around(what: str) -> str:
    return f"(select count(*) from {_SPOTS} b where b.t in {what} and {HAV.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} <= 500)"


@query(f"select pin_id, n as air_shafts from (select a.pin_id, {_around(chr(40) + repr('Air Shaft') + ', ' + repr('Air Shafts') + ', ' + repr('Ventilating Shaft') + chr(41))} n, {_around(chr(40) + repr('Old Level') + chr(41))} m from {_SPOTS} a where a.t in ('Quarry', 'Old Quarry', 'Quarry (disused)', 'Quarries')) where n > 0 and m = 0")
def quarries_with_shafts(spark, sf):
    """Quarry labels with air shafts and no mine near."""
    d = v.dense(spark, sf).select(F.substr("key", F.lit(3)).cast("bigint").alias("id"), "lat", "lng")
    labels = picked(spark, sf, SPOTS).join(d, "id").select(F.col("id").cast("string").alias("pin_id"), "final_text", "lat", "lng")
    return registers.shafts_of_quarries(labels).select("pin_id", "air_shafts")


_SAID = "(['Conversion into 4 flats', 'Change into two flats', 'Discharge of condition 2: conversion into 5 flats', 'Conversion into six dwellings', 'New porch'])[1 + o_orderkey % 5]"


@query(f"""with a as (select 'X/' || lpad(o_orderkey::varchar, 9, '0') as ref, o_orderdate::date as start, (o_orderdate + to_days((o_orderkey % 200)::int))::date as decided, o_orderstatus as st, 'C' || o_custkey % 7 || '|' || o_custkey || ' mill lane' as house from orders where o_orderkey % 5 not in (1, 2)),
 l as (select *, coalesce(st in ('F', 'O') and max(start) over (partition by house order by start, ref rows between 1 following and unbounded following) >= decided + 548, false) lapsed from a)
 select house, max_by(ref, {{'s': start, 'r': ref}}) as ref, count(*) filter (lapsed) as lapses, array_to_string(list_sort(list_distinct(list(year(decided)) filter (lapsed))), ' and ') as years, cast(case when count(*) filter (lapsed) > 1 then 16 else 12 end as int) as weight from l group by house having count(*) filter (lapsed) > 0""")
def converted_again(spark, sf):
    """Houses approved for conversion and applied for again, over orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.get(F.array(*map(F.lit, ("Conversion into 4 flats", "Change into two flats", "Discharge of condition 2: conversion into 5 flats", "Conversion into six dwellings", "New porch"))), (k % 5).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "Permitted").when(F.col("o_orderstatus") == "O", "Conditions").otherwise("Rejected")
    rows = v.table(spark, sf, "orders").select(
        F.concat(F.lit("X/"), F.lpad(k.cast("string"), 9, "0")).alias("ref"), F.concat(F.lit("C"), (c % 7).cast("string")).alias("council"), F.concat(F.lit("Land at "), c.cast("string"), F.lit(" Mill Lane, Bath BA1 1AA")).alias("address"), said.alias("description"), state.alias("app_state"),
        F.to_date("o_orderdate").alias("start_date"), F.to_date(F.col("o_orderdate") + F.make_dt_interval(days=(k % 200).cast("int"))).alias("decided_date"),
    )
    return registers.converted_again(rows).select("house", "ref", "lapses", "years", "weight")


@query("select a.o_orderkey as id, count(*) as later from orders a join orders b on a.o_custkey = b.o_custkey and b.o_orderdate::date > a.o_orderdate::date group by a.o_orderkey")
def same_house_later(spark, sf):
    """How many applications about the same house came after each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = v.table(spark, sf, "orders").select(
        k.cast("string").alias("ref"), F.lit("C").alias("council"), F.concat(c.cast("string"), F.when(k % 2 == 0, " Mill Lane, Bath").otherwise(" Mill Lane Bath BA1 1AA")).alias("address"), F.lit("x").alias("description"), F.lit("Permitted").alias("app_state"), F.to_date("o_orderdate").alias("start_date"), F.to_date("o_orderdate").alias("decided_date"),
    )
    return registers.later_applications(rows).select(F.col("ref").cast("bigint").alias("id"), F.size("later").cast("bigint").alias("later"))


COMMITTEES = [{"name": x} for x in ("Southern Area Planning Committee", "Development Control", "Plans Sub-Committee", "Planning Policy Working Group", "Regulatory Committee", "Cabinet", "Scrutiny of Planning", "DC North", "Local Development Framework", "Licensing")]


@query(f"select id, name from {picked_sql(COMMITTEES)} where name in ('Southern Area Planning Committee', 'Development Control', 'Plans Sub-Committee', 'Regulatory Committee', 'DC North')")
def planning_committees(spark, sf):
    return registers.planning_committees(picked(spark, sf, COMMITTEES)).select("id", "name")


@query("select distinct p_name as title from part where p_name not in (select p_name from (select p_name, timestamp '2025-01-01' + to_days((p_partkey % 400)::int) as fetched from part where p_size <= 4 and p_retailprice > 905) where fetched >= timestamp '2025-12-01' - interval 90 days)")
def stale_intros(spark, sf):
    """Titles whose introduction is missing or older than ninety days."""
    p = v.table(spark, sf, "part")
    at = F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("p_partkey") % 400).cast("int"))
    return registers.stale_intros(p.select(F.col("p_name").alias("title")), p.where("p_size <= 4 and p_retailprice > 905").select(F.col("p_name").alias("title"), at.alias("fetched_at")), "2025-12-01 00:00:00")


@query(f"select source, count(*) n from (select source, k % 9 = 0 as gone from {v.RECORDS}) where not gone group by source")
def active_by_source(spark, sf):
    from waymark.operators import sites

    k = F.element_at(F.split("key", ":"), -1).cast("bigint")
    items = v.records(spark, sf).withColumn("gone_at", F.when(k % 9 == 0, F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")))
    return sites.active(items).groupBy("source").agg(F.count("*").alias("n"))


@query("select l_returnflag as status, count(*) n, min_by(l_orderkey || ':' || l_linenumber || ':' || l_partkey, {'d': l_quantity, 's': l_extendedprice, 'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey}) as next from lineitem group by l_returnflag")
def tile_queue(spark, sf):
    """Tiles by status, and the next one of each: least depth, then position."""
    li = v.table(spark, sf, "lineitem")
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    return li.groupBy(F.col("l_returnflag").alias("status")).agg(F.count("*").alias("n"), F.min_by(name, F.struct("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")).alias("next"))


AROUND = [
    "highway=footway|designation=public_footpath|prow_ref=BA 7", "highway=track", "amenity=parking|name=Quarry car park|fee=yes", "amenity=parking|access=private", "landuse=quarry|access=private", "highway=path|foot=no", "highway=cycleway|foot=permissive", "amenity=parking|access=customers", "designation=core_path", "leisure=golf_course|access=no",
    "barrier=lift_gate|access=private", "amenity=parking", "designation=permissive", "access=no",
]
#: Lines of up to some kilometres: from each place three legs, or one point where i is 2, 3, 7, 10 or 11.
_POINTS = "(2, 3, 7, 10, 11)"
_LINES = f"""(select id, i, case when i in {_POINTS} then [[lat, lng]] else [[lat, lng], [lat + (id % 7 - 3) * 0.004::double, lng + (id % 5 - 2) * 0.006::double], [lat + 0.01::double, lng + (id % 11 - 5) * 0.002::double]] end as line
 from (select p_partkey as id, p_partkey % {len(AROUND)} as i, d.lat, d.lng from part join {v.DENSE} d on d.key = 'p:' || p_partkey where d.source <> 'osm'))"""


def around_lines(spark, sf):
    """Features around places: lines and points with tags."""
    rows = v.dense(spark, sf).where("source <> 'osm'").withColumn("k", F.substr("key", F.lit(3)).cast("bigint"))
    i = (F.col("k") % len(AROUND)).cast("int")
    spot = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    lat, lng, k = F.col("lat"), F.col("lng"), F.col("k")
    legs = F.array(spot(lat, lng), spot(lat + (k % 7 - 3) * 0.004, lng + (k % 5 - 2) * 0.006), spot(lat + 0.01, lng + (k % 11 - 5) * 0.002))
    line = F.when(i.isin(2, 3, 7, 10, 11), F.slice(legs, 1, 1)).otherwise(legs)
    return rows.select(line.alias("line"), F.call_function("str_to_map", F.get(F.array(*map(F.lit, AROUND)), i), F.lit("[|]"), F.lit("=")).alias("tags"))


_T = "least(1, greatest(0, case when l2 > 0 then ((lng - ax) * k * (bx - ax) * k + (lat - ay) * (by_ - ay)) / l2 else 0 end))"


@query(f"""with s as (select id, i, unnest(case when len(line) = 1 then [[line[1][1], line[1][2], line[1][1], line[1][2]]] else list_transform(range(1, len(line)), lambda j: [line[j][1], line[j][2], line[j + 1][1], line[j + 1][2]]) end) as q from {_LINES}),
 g as (select id, i, q[1] ay, q[2] ax, q[3] by_, q[4] bx from s), o as (select key, lat, lng, cos(radians(lat)) k from {v.DENSE} where source = 'osm'),
 c as (select *, pow((bx - ax) * k, 2) + pow(by_ - ay, 2) l2 from o, g where abs((ay + by_) / 2 - lat) < 0.02 + abs(by_ - ay) and abs((ax + bx) / 2 - lng) < 0.03 + abs(bx - ax)), t as (select *, {_T} t from c), n as (select key, i, lat, lng, ay + t * (by_ - ay) y, ax + t * (bx - ax) x from t),
 m as (select *, {HAV.format(a='lat', b='lng', c='y', d='x')} m from n), d as (select key, i, m, cast(round_even(m, 0) as bigint) d from m),
 p as (select key, min(d) filter (i in (0, 8) and m <= 400) rd, min(d) filter (i in (1, 6) and m <= 400) pd, min(d) filter (i in (2, 11) and m <= 800) cd from d group by key),
 w as (select key, case i when 4 then 'quarry land' when 5 then 'a path' when 9 then 'golf course land' when 10 then 'a lift gate' else 'something' end as what, min(d) d from d where i in (4, 5, 9, 10, 13) and m <= 50 group by all),
 v as (select key, string_agg(what, '|' order by d, what) private from (select *, row_number() over (partition by key order by d, what) r from w) where r <= 3 group by key)
 select o.key, rd as right_m, case when rd is null or pd < rd then pd end as path_m, cd as parking_m, coalesce(private, '') as private from o left join p using (key) left join v using (key)""")
def access_around(spark, sf):
    """The ways to each place, from lines and points around it; its SQL has no cells."""
    found = registers.access_summary(v.dense(spark, sf).where("source = 'osm'"), around_lines(spark, sf))
    return found.select("key", F.col("right_of_way.d").alias("right_m"), F.col("path.d").alias("path_m"), F.col("parking.d").alias("parking_m"), F.array_join("private", "|").alias("private"))


@query()
def railway_positions(spark, sf):
    """Structures placed by grid reference; golden points are tested."""
    k = F.col("p_partkey")
    ref = F.concat(F.get(F.array(*map(F.lit, ("SU", "NN", "TQ", "ZZ", "SN"))), (k % 5).cast("int")), F.lit(" "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" "), F.lpad((k * 7 % 1000).cast("string"), 3, "0"))
    rows = v.table(spark, sf, "part").select((k % 900).cast("string").alias("ref"), F.when(k % 3 == 0, "Tunnel").when(k % 3 == 1, "Viaduct").otherwise("Bridge").alias("kind"), ref.alias("os_ref"))
    return registers.railway_structures(rows).select("ref", "kind", "os_ref", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("select s_suppkey as id, c_custkey as at from supplier join customer on c_custkey = s_suppkey")
def placed_by_postcode(spark, sf):
    rows = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("ba"), F.col("s_suppkey").cast("string"), F.lit(" 1aa")).alias("postcode"))
    known = v.table(spark, sf, "customer").select(F.concat(F.lit("BA"), F.col("c_custkey").cast("string"), F.lit("1AA")).alias("postcode"), F.col("c_custkey").cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    return registers.placed_by_postcode(rows, known).select("id", F.col("lat").cast("bigint").alias("at"))


@query("select p_partkey as id from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 44)")
def unread_records(spark, sf):
    read = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 44), "read").otherwise("").alias("text"))
    return registers.unread(v.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), read)


@query("""with c as (select * from (select l_partkey k, l_returnflag rf, l_orderkey * 10 + l_linenumber as seq, l_suppkey, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey * 10 + l_linenumber desc, l_suppkey desc) r from lineitem) where r = 1)
 select coalesce(p.p_partkey, c.k) as k, case when c.k is not null and c.rf <> 'R' then c.rf else p.p_name end as nm, c.k is not null and c.rf = 'R' as gone from part p full outer join c on p.p_partkey = c.k""")
def merged_changes(spark, sf):
    """A store after a batch of changes and deletions; the part keys that no change names stay as they are."""
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    store = v.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("nm"), at.alias("first_seen"), at.alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("gone_at"))
    li = v.table(spark, sf, "lineitem")
    seq = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_suppkey")
    changed = li.select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("nm"), (F.col("l_returnflag") == "R").alias("deleted"), F.col("l_shipdate").alias("at"), seq.alias("seq"))
    return changes.merged(store, changed, "k", ["nm"], "2024-02-01 00:00:00").select("k", "nm", F.col("gone_at").isNotNull().alias("gone"))


@query("""with live as (select c_custkey k, case when c_mktsegment <> 'BUILDING' then c_custkey end x from customer where c_acctbal >= 0), gone as (select c_custkey k, -c_custkey x from customer where c_nationkey < 12)
 select o_orderkey as id, coalesce(live.x, gone.x) as at from orders left join live on live.k = o_custkey left join gone on gone.k = o_custkey where coalesce(live.x, gone.x) is not null""")
def retired_postcodes(spark, sf):
    """Orders placed by a postcode in use, or else by one that no longer is; some in use have no position."""
    c, code = v.table(spark, sf, "customer"), lambda k: F.concat(F.lit("BA"), F.col(k).cast("string"), F.lit("1AA")).alias("postcode")
    at = lambda x: (x.cast("double").alias("lat"), F.lit(0.0).alias("lng"))
    live = c.where("c_acctbal >= 0").select(code("c_custkey"), *at(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey"))))
    gone = c.where("c_nationkey < 12").select(code("c_custkey"), *at(-F.col("c_custkey")))
    rows = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lower(code("o_custkey")).alias("postcode"))
    return registers.placed_by_postcode(rows, live, gone).select("id", F.col("lat").cast("bigint").alias("at"))


@query("""with e as (select l_orderkey o, l_linenumber n, case when l_returnflag = 'A' then 'Unoccupied' else 'Clinic' end site_type, greatest(l_quantity - 45, 0)::double unoccupied_m2, round(l_discount * 100000)::double empty_m2, case when l_linestatus = 'O' then round(l_extendedprice)::double else 0.0::double end floor_m2 from lineitem)
 select case when n = 1 then 'Site ' || o else o || '-' || n end as ref, 'Site ' || o as name, '2023/24' as year, unoccupied_m2 > 0 or site_type = 'Unoccupied' as whole, unoccupied_m2, empty_m2, floor_m2 from e
 where unoccupied_m2 > 0 or site_type = 'Unoccupied' or (floor_m2 > 0 and empty_m2 >= 1000 and empty_m2 / floor_m2 >= 0.5)""")
def estates_returned(spark, sf):
    """A return's sites that stand empty, over line items told as a return tells them: numbers with commas, areas found by how their columns start."""
    comma, whole = lambda c: F.format_number(c, 0), lambda c: c.cast("string")
    rows = v.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") > 1, F.concat(whole(F.col("l_orderkey")), F.lit("-"), whole(F.col("l_linenumber")))).alias("Site Code"), F.concat(F.lit(" Site "), whole(F.col("l_orderkey"))).alias("Site Name"),
        F.when(F.col("l_returnflag") == "A", "Unoccupied").otherwise("Clinic").alias("Site Type"), whole(F.greatest(F.col("l_quantity") - 45, F.lit(0.0))).alias("Internal floor area - unoccupied (m²)"),
        comma(F.round(F.col("l_discount") * 100000)).alias("Floor area - empty (m2)"), F.when(F.col("l_linestatus") == "O", comma(F.round("l_extendedprice"))).otherwise("Not Applicable").alias("Gross internal floor area (sqm)"),
    )
    return registers.standing_empty(registers.estates_return(rows, "ERIC_2023_24 Site data.csv")).select("ref", "name", "year", "whole", "unoccupied_m2", "empty_m2", "floor_m2")
