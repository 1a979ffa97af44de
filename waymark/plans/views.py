"""Views of the driver's tables that give the operators something to work on; the same in SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.vocabulary import REPORT_TAGS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One evidence text at least for every branch of the condition cascade, and near misses.
PHRASES = [
    "Listed as heritage at risk", "Heritage site open to visitors", "Demolition approved in spring", "Ownerless since the dissolution", "Kept as cleared vacant land", "Found a new use", "A single shop unit",
    "Ruins of a mill", "Boarded up and derelict", "In a poor state of repair", "A part-built block", "A part built block", "Partially completed", "It has stood empty", "Stand empty now", "Never been occupied", "It has not been occupied",
    "Uninhabited", "Unfit for human habitation", "They couldn't be lived in", "Due to close", "Closed in 2019", "Now disused", "Decommissioned", "Closed for good", "Enclosed yard", "Surplus land", "Surpluses only", "A brownfield plot",
    "A cave entrance", "Worked underground", "Underground quarries", "An old quarry", "The adit", "A habitat radit", "A mine_shaft", "A Cold War bunker", "A roc post", "A rocky post", "The former works", "Nothing told",
]
KINDS = ["school", "brownfield land", "structure", "Quarry", "mill", "roof", "adit"]


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    name = F.when(k % 11 == 0, F.concat(F.lit("Unnamed "), pick(KINDS, 7))).otherwise(F.concat("c_name", F.when(k % 10 == 3, ' <Old> & "Co"').otherwise("")))
    lat, lng = 49.8 + ((k * 7919) % 11150) / 1000.0, -8.7 + ((k * 7927) % 10600) / 1000.0
    way = lambda n, kind, up: F.struct(n.alias("name"), F.lit(kind).alias("kind"), (lat + up).alias("lat"), lng.alias("lng"))
    ways = F.when(k % 9 == 0, F.array(way(F.concat("c_name", F.lit(" Portal")), "Entrance", 0.001), way(F.lit(""), "Air shaft", 0.002))).otherwise(F.slice(F.array(way(F.lit(""), "Adit", 0.0)), 1, 0))
    day = lambda d: F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), d.cast("int")), "yyyy-MM-dd")
    any_day = F.when(k % 6 != 0, day(k % 500))
    none = F.array().cast("array<string>")
    score = k % 101
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c:"), k.cast("string")).alias("key"), name.alias("name"), lat.alias("lat"), lng.alias("lng"), score.alias("score"), F.when(score >= 35, "strong").when(score >= 20, "good").otherwise("weak").alias("strength"),
        F.when(k % 8 == 5, "tunnels").otherwise(F.lower("c_mktsegment")).alias("category"), pick(("Abandoned", "Ruin", "Empty", "Closed 2019", "Closed", "Historic", "Cave", "Closed 20", "Ownerless"), 9).alias("condition"), pick(KINDS, 7).alias("kind"),
        pick(("osm", "osm+wikidata", "schools", "osm+schools"), 4).alias("sources"), F.when(k % 5 == 0, none).otherwise(F.array(F.concat(F.lit("Listed "), k.cast("string")), F.lit("Agreed & more"))).alias("reasons"),
        F.when(k % 7 != 0, base + F.make_dt_interval(days=(k % 300).cast("int"))).alias("added"), (base + F.make_dt_interval(days=(k % 13).cast("int"))).alias("first_seen"),
        F.when(k % 5 == 0, F.array(F.lit("Bethel Quarry"), F.concat(F.lit("The-Old Works "), k.cast("string")))).otherwise(none).alias("aliases"), ways.alias("entrances"),
        F.struct(any_day.alias("any"), F.when(k % 3 == 0, day(k % 700)).otherwise(any_day).alias("all")).alias("dates"), F.when(k % 2 == 0, F.concat(F.lit("node/"), k.cast("string"))).alias("osm_id"),
        F.when(k % 6 == 1, F.lit("https://en.wikipedia.org/wiki/X")).alias("wikipedia"),
    )


_K = f"([{', '.join(repr(x) for x in KINDS)}])[1 + k % 7]"
SITES = f"""(select 'c:' || k as key, nm as name, lat, lng, k % 101 as score, case when k % 101 >= 35 then 'strong' when k % 101 >= 20 then 'good' else 'weak' end as strength, case when k % 8 = 5 then 'tunnels' else lower(c_mktsegment) end as category,
 (['Abandoned','Ruin','Empty','Closed 2019','Closed','Historic','Cave','Closed 20','Ownerless'])[1 + k % 9] as condition, {_K} as kind, (['osm','osm+wikidata','schools','osm+schools'])[1 + k % 4] as sources,
 case when k % 5 = 0 then [] else ['Listed ' || k, 'Agreed & more'] end as reasons, case when k % 7 <> 0 then timestamp '2024-01-01' + to_days((k % 300)::int) end as added, timestamp '2024-01-01' + to_days((k % 13)::int) as first_seen,
 case when k % 5 = 0 then ['Bethel Quarry', 'The-Old Works ' || k] else [] end as aliases,
 case when k % 9 = 0 then [{{'name': c_name || ' Portal', 'kind': 'Entrance', 'lat': lat + 0.001::double, 'lng': lng}}, {{'name': '', 'kind': 'Air shaft', 'lat': lat + 0.002::double, 'lng': lng}}] else [] end as entrances,
 case when k % 6 <> 0 then strftime(date '2023-01-01' + (k % 500)::int, '%Y-%m-%d') end as any_day, case when k % 3 = 0 then strftime(date '2023-01-01' + (k % 700)::int, '%Y-%m-%d') when k % 6 <> 0 then strftime(date '2023-01-01' + (k % 500)::int, '%Y-%m-%d') end as all_day,
 case when k % 2 = 0 then 'node/' || k end as osm_id, case when k % 6 = 1 then 'https://en.wikipedia.org/wiki/X' end as wikipedia
 from (select *, case when k % 11 = 0 then 'Unnamed ' || {_K} else c_name || case when k % 10 = 3 then ' <Old> & "Co"' else '' end end as nm from (select *, c_custkey as k, 49.8::double + ((c_custkey*7919) % 11150)::double/1000 as lat, -8.7::double + ((c_custkey*7927) % 10600)::double/1000 as lng from customer)))"""


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lat = 51.3 + ((k * k * 31 + k * 7919) % 9973) / 50000.0
    lng = -2.3 + ((k * k * 17 + k * 104729) % 9967) / 50000.0
    source = F.get(F.array(*map(F.lit, ("osm", "wikidata", "schools", "nhs"))), (k % 4).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), k.cast("string")).alias("key"), F.col("p_name").alias("name"), lat.alias("lat"), lng.alias("lng"), (10 + k % 30).alias("weight"), source.alias("source"))


DENSE = """(select 'p:' || p_partkey as key, p_name as name, 51.3::double + ((p_partkey*p_partkey*31 + p_partkey*7919) % 9973)::double/50000 as lat,
 -2.3::double + ((p_partkey*p_partkey*17 + p_partkey*104729) % 9967)::double/50000 as lng, 10 + p_partkey % 30 as weight, (['osm','wikidata','schools','nhs'])[1 + p_partkey % 4] as source from part)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    access = F.when(e % 3 == 0, "accessible").when(e % 3 == 1, "inaccessible")
    tag = lambda n: F.get(F.array(*map(F.lit, REPORT_TAGS)), (n % len(REPORT_TAGS)).cast("int"))
    tags = F.when(e % 4 == 0, F.array(tag(e), tag(e + 3))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (F.col("user_id") % 50).alias("key"), F.col("user_id").alias("reporter"), F.when(e % 7 != 0, 1 + e % 5).alias("difficulty"), access.alias("access"), tags.alias("tags"), F.col("ts").alias("at"),
    )


REPORTS = f"""(select event_id as id, user_id % 50 as key, user_id as reporter, case when event_id % 7 <> 0 then 1 + event_id % 5 end as difficulty,
 case event_id % 3 when 0 then 'accessible' when 1 then 'inaccessible' end as access, case when event_id % 4 = 0 then list_transform([event_id, event_id + 3], lambda n: ([{', '.join(repr(t) for t in REPORT_TAGS)}])[1 + n % 13]) else [] end as tags, ts as seen from events)"""


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("house"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.make_dt_interval(days=(k % 200).cast("int"))).alias("decided"), F.col("o_orderstatus").alias("state"))


APPLICATIONS = "(select o_orderkey as id, o_custkey as house, o_orderdate as start, o_orderdate + to_days((o_orderkey % 200)::int) as decided, o_orderstatus as state from orders)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.get(F.array(*map(F.lit, PHRASES)), (k % len(PHRASES)).cast("int")), F.lit(" "), F.col("p_name")).alias("text"))


_SAID = ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES)
EVIDENCE = f"(select p_partkey as id, ([{_SAID}])[1 + p_partkey % {len(PHRASES)}] || ' ' || p_name as text from part)"


# --- records of three families, densely placed: what a place is, and how it is told

RECORD_KINDS = ["hospital", "railway tunnel", "mill", "underground quarry", "quarry", "school", "house", "adit"]
RECORD_NAMES = ["Old Mill", "Manod Granite Quarry", "Former Chapel", "Ivy Hospital", "Quarry II, Bwlch", "Tunnel Lane House"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (n % len(xs)).cast("int"))
    family, source = pick(("osm", "wikidata", "open", "open"), k), pick(("osm", "wikidata", "schools", "nhs_estates"), k)
    base = dense(spark, sf_dir).select(F.substr("key", F.lit(3)).cast("bigint").alias("p_partkey"), "lat", "lng")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 13 == 1, F.lit(None)).otherwise(pick(RECORD_NAMES, k))
    kind = pick(RECORD_KINDS, F.floor(k / 4))
    said = F.concat(pick(PHRASES, F.floor(k / 2)), F.lit(" of "), kind)
    evidence = F.when(family == "osm", F.concat(F.lit("OSM: "), said)).when(family == "wikidata", F.concat(F.lit("Wikidata: old "), said)).otherwise(said)
    entrance = F.when((family != "osm") & (k % 17 == 2), "Shaft").when((family == "osm") & (kind == "adit"), "Adit")
    first_seen = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 9).cast("int"))
    dates = F.array(F.struct(F.lit("last edited").alias("what"), F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (k % 999).cast("int")), "yyyy-MM-dd").alias("when")))
    prefix = F.when(family == "wikidata", "wd").otherwise(source)
    return table(spark, sf_dir, "part").join(base, "p_partkey").select(
        F.concat(prefix, F.lit(":"), k.cast("string")).alias("key"), family.alias("family"), source.alias("source"), F.lpad(k.cast("string"), 9, "0").alias("id"), name.alias("name"), kind.alias("kind"), evidence.alias("evidence"), (5 + k % 31).cast("int").alias("weight"),
        "lat", "lng", F.when(k % 19 == 0, F.array(F.lit("Bethel Quarry"))).otherwise(F.array().cast("array<string>")).alias("aliases"), entrance.alias("entrance"), first_seen.alias("first_seen"), dates.alias("dates"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("url"),
    )


def _of(xs, n: str) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"])[1 + {n} % {len(xs)}]"


RECORDS = f"""(select *, case family when 'osm' then 'OSM: ' when 'wikidata' then 'Wikidata: old ' else '' end || {_of(PHRASES, '(k // 2)')} || ' of ' || kind as evidence from (select k, {_of(('osm', 'wikidata', 'open', 'open'), 'k')} as family, {_of(('osm', 'wikidata', 'schools', 'nhs_estates'), 'k')} as source,
 lpad(k::varchar, 9, '0') as id, case when k % 3 = 0 then p_name when k % 13 = 1 then null else {_of(RECORD_NAMES, 'k')} end as name, {_of(RECORD_KINDS, '(k // 4)')} as kind, cast(5 + k % 31 as int) as weight, least(k % 4, 2) as f, d.lat, d.lng from (select *, p_partkey as k from part) p join {DENSE} d on d.key = 'p:' || p.k))"""


def attractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size as something open to visitors: an outline, or a point."""
    d = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").alias("k")).join(dense(spark, sf_dir).select("key", "lat", "lng"), "key")
    return d.select("lat", "lng", F.when(F.col("k") % 80 == 0, 120.0).alias("reach"), F.lit("Museum").alias("kind"), F.lit("Old Mill Museum").alias("name"), F.lit("OpenStreetMap").alias("source"))


def demolished(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").where("p_size = 9").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("key")).join(dense(spark, sf_dir).select("key", "lat", "lng"), "key")
    return d.select("lat", "lng", F.lit(None).cast("double").alias("reach"), F.lit("Demolished").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit("OpenStreetMap").alias("source"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where("p_size <= 12").select(F.concat(F.lit("osm:"), k.cast("string")).alias("key"), F.lit("2025-02-03").alias("latest"))
