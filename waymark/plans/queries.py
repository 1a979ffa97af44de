"""A query for each operator on the views of the driver's tables, with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.functions import vocabulary as V
from waymark.operators import resolve, sites
from waymark.operators.sites import Filters
from waymark.plans import views as v
from waymark.streaming import reports

BOX = (-6.0, 50.5, 1.0, 58.0)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


IN_BOX = "lng between -6 and 1 and lat between 50.5 and 58"
CY, CX = sites.cluster_cells(BOX, 7)


@query(f"""with c as (select *, cast(trunc((lat + 90) / {CY!r}::double) as int) gy, cast(trunc((lng + 180) / {CX!r}::double) as int) gx from {v.SITES} where {IN_BOX} and score >= 20),
 n as (select gy, gx, category, count(*) c from c group by all), m as (select *, row_number() over (partition by gy, gx order by c desc, category) r from n)
 select c.gy, c.gx, count(*) n, round(avg(lat), 6) lat, round(avg(lng), 6) lng, round(min(lat), 6) south, round(max(lat), 6) north, round(min(lng), 6) west, round(max(lng), 6) east, min(key) as key, any_value(m.category) as category
 from c join m on c.gy = m.gy and c.gx = m.gx and m.r = 1 group by c.gy, c.gx""")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Grid clusters of a view, with their commonest category."""
    return rounded(sites.clusters(v.sites(spark, sf), Filters(bbox=BOX, min_score=20), 7), "lat", "lng", "south", "north", "west", "east")


@query(f"select key, score, round(lat, 6) lat, round(lng, 6) lng from {v.SITES} where {IN_BOX} and score >= 20 and category in ('building', 'machinery') order by score desc, key limit 3000")
def filtered_top(spark, sf):
    return rounded(sites.top(v.sites(spark, sf).where(Filters(bbox=BOX, min_score=20, categories=["building", "machinery"]).where()), 3000).select("key", "score", "lat", "lng"), "lat", "lng")


_SKIP = "('" + "', '".join(x.replace("'", "''") for x in V.SKIP_KINDS) + "')"


@query(f"""select key, condition, score, kind, name from {v.SITES} where score >= 20 and (condition in ('Abandoned', 'Disused', 'Ruin', 'At risk', 'Empty', 'Unfinished', 'Old military', 'Cave', 'Demolition approved', 'Closing', 'Underground', 'Ownerless') or regexp_full_match(condition, 'Closed [0-9][0-9][0-9][0-9]'))
 and lower(kind) not in {_SKIP} and (name not like 'Unnamed %' or category in ('bunkers', 'tunnels', 'military') or lower(kind) not in ('structure', 'building', 'abandoned', 'ruins', 'yes', 'roof', 'wall', 'citywalls', 'disused', 'historic'))""")
def best_spots(spark, sf):
    return v.sites(spark, sf).where(Filters(best=True).where()).select("key", "condition", "score", "kind", "name")


@query(f"select key, sources, added from {v.SITES} where list_has_any(string_split(sources, '+'), ['schools', 'nhs']) and added > timestamp '2024-03-01'")
def by_source_and_date(spark, sf):
    return v.sites(spark, sf).where(Filters(sources=["schools", "nhs"], added_since="2024-03-01 00:00:00").where()).select("key", "sources", "added")


@query(f"select key, any_day as day from {v.SITES} where any_day is not null and any_day >= '2023-03-01' and any_day < '2024-02-01' union all select key, all_day from {v.SITES} where all_day is not null and all_day < '2023-06-01'")
def dated(spark, sf):
    """Sites by their last update from any source, and by that or a visitor's report."""
    s = v.sites(spark, sf)
    first = s.where(Filters(date_kind="any", date_from="2023-03-01", date_to="2024-02-01").where()).select("key", F.col("dates.any").alias("day"))
    return first.unionAll(s.where(Filters(date_kind="all", date_to="2023-06-01").where()).select("key", F.col("dates.all").alias("day")))


def _held(text: str, short: str) -> str:
    one = lambda x: f"({x} ilike '%{text}%' or replace(replace({x}, ' ', ''), '-', '') ilike '%{short}%')"
    return f"({one('name')} or len(list_filter(aliases, lambda a: {one('a')})) > 0)"


@query(f"select key, name from {v.SITES} where {_held('00-1', '001')} union all select key, name from {v.SITES} where {_held('the old-works', 'theoldworks')}")
def text_search(spark, sf):
    s = v.sites(spark, sf)
    return s.where(Filters(text="00-1").where()).select("key", "name").unionAll(s.where(Filters(text="the old-works").where()).select("key", "name"))


@query(f"select key, name from {v.SITES} where key in ('c:1', 'c:7', 'c:20', 'none')")
def sites_by_key(spark, sf):
    return sites.by_keys(v.sites(spark, sf), ["c:7", "c:1", "none", "c:20"]).select("key", "name")


@query(f"""with c as (select *, cast(trunc((lat + 90) / {CY!r}::double) as int) gy, cast(trunc((lng + 180) / {CX!r}::double) as int) gx from {v.SITES} where {IN_BOX} and score >= 20),
 n as (select gy, gx, category, count(*) c from c group by all), m as (select *, row_number() over (partition by gy, gx order by c desc, category) r from n), g as (select gy, gx, count(*) n, round(avg(lat), 6) lat, round(avg(lng), 6) lng, min(key) k from c group by gy, gx)
 select g.gy, g.gx, g.n, g.lat, g.lng, m.category, case when g.n = 1 then k end as site, case when g.n = 1 then s.name end as own_name, case when g.n = 1 then s.score end as own_score from g join m on g.gy = m.gy and g.gx = m.gx and m.r = 1 join {v.SITES} s on s.key = k""")
def cluster_view(spark, sf):
    """Clusters, with sites that are alone in their cell as sites."""
    return rounded(sites.cluster_view(v.sites(spark, sf), Filters(bbox=BOX, min_score=20), 7), "lat", "lng")


@query(f"select key, score from {v.SITES} where lat between 52 and 52.5 and lng between -2 and -1 order by score desc, key limit 2000")
def map_of_few(spark, sf):
    """A close view shows its sites themselves."""
    mode, found = sites.map_view(v.sites(spark, sf), Filters(bbox=(-2.0, 52.0, -1.0, 52.5)), 15)
    return found.select("key", "score")


@query(f"select key, name, round(lat, 5) lat, round(lng, 5) lng, score, strength, category, condition, kind, sources, added, first_seen, array_to_string(aliases, '|') aliases, len(entrances)::int n_entrances, coalesce(reasons[1], '') summary from {v.SITES}")
def site_index(spark, sf):
    return sites.index(v.sites(spark, sf)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"select floor(lat)::int sq_lat, floor(lng)::int sq_lng, count(*) n from {v.SITES} group by all")
def site_squares(spark, sf):
    return sites.by_square(v.sites(spark, sf)).groupBy("sq_lat", "sq_lng").agg(F.count("*").alias("n"))


def _ring_sql(ring) -> str:
    edges = zip(ring, ring[1:] + ring[:1])
    return " + ".join(f"case when ({y1}::double > lat) <> ({y2}::double > lat) and lng < {x1}::double + (lat - {y1}::double) * ({x2}::double - {x1}::double) / ({y2}::double - {y1}::double) then 1 else 0 end" for (x1, y1), (x2, y2) in edges if y1 != y2)


@query(f"""select key, case when ({_ring_sql(V.NORTHERN_IRELAND)}) % 2 = 1 then 'northern_ireland' when ({_ring_sql(V.SCOTLAND)}) % 2 = 1 then 'scotland' when ({_ring_sql(V.WALES)}) % 2 = 1 then 'wales' when lat > 54.04 and lat < 54.43 and lng > -4.85 and lng < -4.30 then null
 when lat > 49.85 and lat < 55.85 and lng > -6.5 and lng < 1.8 then 'england' end as nation from {v.SITES}""")
def nations(spark, sf):
    return v.sites(spark, sf).select("key", geo.nation(F.col("lat"), F.col("lng")).alias("nation"))


@query()
def site_pointers(spark, sf):
    """Country and grid reference of each site; golden points are tested."""
    return sites.with_pointers(v.sites(spark, sf)).select("key", "nation", "grid_ref")


@query(f"""with o as (select key, condition, case when score % 3 = 0 then all_day end visited, any_day as reported from {v.SITES}), s as (select key, case when score % 4 = 0 then 'Reused' else condition end old_condition, case when score % 2 = 0 then '2023-06-01' end old_visited, '2023-09-01' as old_reported from {v.SITES} where score > 50)
 select key, array_to_string(list_filter([case when condition <> old_condition then 'condition: ' || condition end, case when visited is not null and coalesce(old_visited, '') < visited then 'visited: ' || visited end, case when reported is not null and old_reported < reported then 'reported: ' || reported end], lambda x: x is not null), '; ') as changes from o join s using (key)
 where condition <> old_condition or (visited is not null and coalesce(old_visited, '') < visited) or (reported is not null and old_reported < reported)""")
def watch_list(spark, sf):
    s = v.sites(spark, sf)
    now = s.select("key", "condition", F.when(F.col("score") % 3 == 0, F.col("dates.all")).alias("visited"), F.col("dates.any").alias("reported"))
    saved = s.where("score > 50").select("key", F.when(F.col("score") % 4 == 0, "Reused").otherwise(F.col("condition")).alias("condition"), F.when(F.col("score") % 2 == 0, "2023-06-01").alias("visited"), F.lit("2023-09-01").alias("reported"))
    return sites.watched(saved, now).withColumn("changes", F.array_join("changes", "; "))


HAV = "(2 * 6371008.8::double * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


@query(f"select key, cast(round_even({HAV.format(a='52.5::double', b='-1.5::double', c='lat', d='lng')}, 0) as bigint) distance_m from {v.SITES} order by (lat - 52.5::double) * (lat - 52.5::double) + (lng + 1.5::double) * (lng + 1.5::double) * pow(cos(radians(52.5::double)), 2), key limit 500")
def nearest(spark, sf):
    return sites.nearest(v.sites(spark, sf), 52.5, -1.5, 500).select("key", "distance_m")


@query(f"select key, coalesce(added, first_seen) as at, score from {v.SITES} order by coalesce(added, first_seen) desc, score desc, key limit 500")
def newest(spark, sf):
    return sites.newest(v.sites(spark, sf), 500).select("key", F.coalesce("added", "first_seen").alias("at"), "score")


@query(f"select key, name from {v.SITES} where key > 'c:2' order by key limit 200")
def keyset_page(spark, sf):
    return sites.page(v.sites(spark, sf), "c:2", 200).select("key", "name")


@query(f"select category, count(*) n from {v.SITES} where score >= 20 group by category")
def site_statistics(spark, sf):
    return sites.statistics(v.sites(spark, sf))


_LABEL = "case category when 'tunnels' then 'Tunnels & caves' else category end"


@query(f"""select name, {_LABEL} as category, condition, strength as evidence, printf('%.6f', lat) latitude, printf('%.6f', lng) longitude, sources, array_to_string(reasons, ' | ') reasons,
 case when osm_id is not null then 'https://www.openstreetmap.org/' || osm_id else 'https://www.openstreetmap.org/?mlat=' || printf('%.6f', lat) || '&mlon=' || printf('%.6f', lng) || '#map=18/' || printf('%.6f', lat) || '/' || printf('%.6f', lng) end openstreetmap,
 coalesce(wikipedia, '') wikipedia, coalesce(strftime(added, '%Y-%m-%d'), '') added, array_to_string(aliases, '; ') also_known_as, array_to_string(list_transform(entrances, lambda e: coalesce(nullif(e.name, ''), e.kind) || ' (' || printf('%.6f', e.lat) || ', ' || printf('%.6f', e.lng) || ')'), '; ') entrances from {v.SITES}""")
def export_csv(spark, sf):
    return sites.csv_rows(v.sites(spark, sf))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


_WAY = "(select key, name, unnest(entrances) e, generate_subscripts(entrances, 1) n from " + v.SITES + ")"
_WAY_LABEL = _esc("case when e.name <> '' and contains(lower(e.name), lower(name)) then e.name else name || ': ' || coalesce(nullif(e.name, ''), e.kind) end")


@query(f"""select key, 0 as n, '<Placemark><name>' || {_esc('name')} || ' (' || {_esc('condition')} || ')</name><description><![CDATA[' || array_to_string(list_transform(reasons, lambda r: {_esc('r')}), '<br>') || ']]></description><Point><coordinates>' || printf('%.6f,%.6f', lng, lat) || ',0</coordinates></Point></Placemark>' as line from {v.SITES}
 union all select key, n, '<Placemark><name>' || {_WAY_LABEL} || '</name><description>' || {_esc('e.kind')} || '</description><Point><coordinates>' || printf('%.6f,%.6f', e.lng, e.lat) || ',0</coordinates></Point></Placemark>' from {_WAY}""")
def export_kml(spark, sf):
    return sites.kml_rows(v.sites(spark, sf))


@query(f"""select key, 0 as n, '<wpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lng) || '"><name>' || {_esc('name')} || '</name><desc>' || {_esc("condition || ': ' || array_to_string(reasons, ' | ')")} || '</desc><type>' || {_esc(_LABEL)} || '</type></wpt>' as line from {v.SITES}
 union all select key, n, '<wpt lat="' || printf('%.6f', e.lat) || '" lon="' || printf('%.6f', e.lng) || '"><name>' || {_WAY_LABEL} || '</name><desc>' || {_esc('e.kind')} || ' of ' || {_esc('name')} || '</desc><type>Entrance</type></wpt>' from {_WAY}""")
def export_gpx(spark, sf):
    return sites.gpx_rows(v.sites(spark, sf))


NEAR = f"""(select a.key, a.lat, a.lng, b.key as r_key, {HAV.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} as metres from {v.DENSE} a join {v.DENSE} b on a.key <> b.key)"""


@query(f"select key, r_key, round(metres, 4) metres from {NEAR} where metres <= 120 and key < r_key")
def near_pairs(spark, sf):
    d = v.dense(spark, sf).select("key", "lat", "lng")
    return sites.near_pairs(d, d, 120, 0.002).where("key < r_key").select("key", "r_key", F.round("metres", 4).alias("metres"))


@query(f"select key, r_key, round(metres, 4) metres from (select *, row_number() over (partition by key order by metres, r_key) r from {NEAR} where metres <= 120) where r = 1")
def nearest_neighbour(spark, sf):
    d = v.dense(spark, sf).select("key", "lat", "lng")
    return sites.nearest_of(d, d, 120, 0.002, same=False).select("key", "r_key", F.round("metres", 4).alias("metres"))


@query(f"""select a.key from {v.DENSE} a where a.source = 'osm' and not exists (select 1 from {v.DENSE} b where b.source = 'nhs' and {HAV.format(a='a.lat', b='a.lng', c='b.lat', d='b.lng')} <= 100)""")
def without_near(spark, sf):
    d = v.dense(spark, sf)
    return sites.without_near(d.where("source = 'osm'").select("key", "lat", "lng"), d.where("source = 'nhs'").select("key", "lat", "lng"), 100, 0.002).select("key")


@query(f"select key, round(d, 6) bearing, (['N','NE','E','SE','S','SW','W','NW'])[1 + cast(round_even(d / 45, 0) as int) % 8] wind from (select key, (degrees(atan2(sin(radians(lng + 1.5::double)) * cos(radians(lat)), cos(radians(52.5::double)) * sin(radians(lat)) - sin(radians(52.5::double)) * cos(radians(lat)) * cos(radians(lng + 1.5::double)))) + 360) % 360 d from {v.SITES})")
def bearings(spark, sf):
    b = geo.bearing_deg(F.lit(52.5), F.lit(-1.5), F.col("lat"), F.col("lng"))
    return v.sites(spark, sf).select("key", F.round(b, 6).alias("bearing"), geo.compass(b).alias("wind"))


RING = [(-5.0, 50.0), (1.5, 51.0), (0.0, 55.0), (-2.5, 53.0), (-4.0, 58.0)]
_EDGES = " union all ".join(f"select {x1}::double x1, {y1}::double y1, {x2}::double x2, {y2}::double y2" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1]))


@query(f"select key, sum(case when (y1 > lat) <> (y2 > lat) and lng < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1 then 1 else 0 end) % 2 = 1 as inside from {v.SITES} s cross join ({_EDGES}) group by key")
def inside_ring(spark, sf):
    return v.sites(spark, sf).select("key", geo.inside(F.col("lat"), F.col("lng"), RING).alias("inside"))


_T = "lower(text)"
_CONDITION = f"""case when contains({_T}, 'heritage at risk') then 'At risk' when contains({_T}, 'heritage site open to visitors') then 'Heritage site' when contains({_T}, 'demolition approved') then 'Demolition approved' when contains({_T}, 'ownerless') then 'Ownerless'
 when contains({_T}, 'as cleared vacant land') then 'Vacant land' when contains({_T}, 'new use') then 'Reused' when contains({_T}, 'single shop unit') then 'Closed' when regexp_matches({_T}, '\\bruin') then 'Ruin'
 when regexp_matches({_T}, 'abandoned|derelict|boarded up|disrepair|dilapidated|poor state of repair') then 'Abandoned' when regexp_matches({_T}, 'unfinished|partially constructed|partially built|partially completed|part-built|part built|partly built|incomplete dwelling') then 'Unfinished'
 when regexp_matches({_T}, 'never occupied|never been occupied|not been occupied|unoccupied|stood empty|stands empty|stand empty|been empty|remained empty|uninhabitable|uninhabited|unfit for habitation|unfit for human habitation|couldn''t be lived in') then 'Empty'
 when contains({_T}, 'due to close') then 'Closing' when regexp_matches({_T}, 'closed in [0-9]{{4}}') then 'Closed ' || regexp_extract({_T}, 'closed in ([0-9]{{4}})', 1)
 when regexp_matches({_T}, 'disused|decommission|mothball|out of use|\\bclosed\\b|vacant|inactive|redundant|\\bsurplus\\b') then 'Disused' when contains({_T}, 'brownfield') then 'Brownfield' when contains({_T}, 'cave entrance') then 'Cave'
 when regexp_matches({_T}, 'worked underground|underground quarr|underground mine|underground workings|underground galler') then 'Underground' when regexp_matches({_T}, 'old mine|old quarry|old colliery|adit|mineshaft|mine_shaft') then 'Old workings'
 when regexp_matches({_T}, 'bunker|pillbox|observation post|observer corps|monitoring post|\\broc\\b post') then 'Old military' when contains({_T}, 'former') then 'Former' end"""


@query(f"select id, {_CONDITION} as condition from {v.EVIDENCE}")
def conditions(spark, sf):
    """The state that each evidence text tells, by the ordered cascade."""
    return v.evidence(spark, sf).select("id", text.condition(F.col("text")).alias("condition"))


@query(f"select key, case when score >= 35 then 'strong' when score >= 20 then 'good' else 'weak' end strength from {v.SITES}")
def strengths(spark, sf):
    return v.sites(spark, sf).select("key", text.strength(F.col("score")).alias("strength"))


@query(f"select id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') norm, case when regexp_matches(lower(text), '^[aeiou]') then 'an ' else 'a ' end || text as noun from {v.EVIDENCE}")
def names(spark, sf):
    return v.evidence(spark, sf).select("id", text.norm(F.col("text")).alias("norm"), text.article(F.col("text")).alias("noun"))


@query(f"select key, 'list:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || ':' || printf('%.5f,%.5f', lat, lng) as ref from {v.SITES}")
def slugs(spark, sf):
    return v.sites(spark, sf).select("key", text.slug(F.lit("list"), F.col("name"), F.col("lat"), F.col("lng")).alias("ref"))


@query()
def page_text(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages")
def page_titles(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(f"select id, house, exists (select 1 from {v.APPLICATIONS} b where b.house = a.house and b.start >= a.decided + interval 548 days and (b.start > a.start or b.start = a.start and b.id > a.id)) later from {v.APPLICATIONS} a where state = 'F'")
def applied_again(spark, sf):
    """Approved applications, and whether their house applied again 548 days or more after."""
    w = Window.partitionBy("house").orderBy("start", "id").rowsBetween(1, Window.unboundedFollowing)
    last = F.max("start").over(w)
    found = v.applications(spark, sf).withColumn("later", F.coalesce(last >= F.col("decided") + F.expr("INTERVAL 548 DAYS"), F.lit(False)))
    return found.where("state = 'F'").select("id", "house", "later")


@query(f"select house, id, decided from (select *, row_number() over (partition by house order by decided desc, id) r from {v.APPLICATIONS}) where r = 1")
def latest_per_house(spark, sf):
    w = Window.partitionBy("house").orderBy(F.desc("decided"), "id")
    return v.applications(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("house", "id", "decided")


_TAGGED = f"(select key, unnest(tags) tag from {v.REPORTS} where seen::date >= date '2027-01-10' - 1096)"
_TAG_ORDER = f"list_position([{', '.join(repr(t) for t in V.REPORT_TAGS)}], tag)"


@query(f"""with s as (select key, count(*) n, count(difficulty) rated, sum(difficulty) total, {', '.join(f'count(*) filter (difficulty = {n}) level_{n}' for n in range(1, 6))}, count(*) filter (access = 'accessible') accessible,
 count(*) filter (access = 'inaccessible') inaccessible, max(seen)::date latest from {v.REPORTS} where seen::date >= date '2027-01-10' - 1096 group by key), t as (select key, string_agg(tag || ':' || n, ',' order by n desc, {_TAG_ORDER}) tags from (select key, tag, count(*) n from {_TAGGED} group by all) group by key)
 select s.* exclude (total), coalesce(t.tags, '') tags, printf('%.1f', total::double / rated)::double mean from s left join t using (key)""")
def report_summary(spark, sf):
    """Means are rounded as printed decimals are: the oracle prints them."""
    return reports.summary(v.reports(spark, sf), "2027-01-10")


@query(f"select id, key, reporter from (select *, row_number() over (partition by key, reporter order by seen desc, id desc) r from {v.REPORTS}) where r = 1")
def report_latest(spark, sf):
    return reports.latest_reports(v.reports(spark, sf)).select("id", "key", "reporter")


@query(f"""select id, key, reporter, access from (select *, lag(seen) over w pa, lag(access) over w pc from {v.REPORTS} window w as (partition by key, reporter order by seen, id))
 where access is not null and (pa is null or access is distinct from pc or seen::date <> pa::date)""")
def report_log(spark, sf):
    return reports.log(v.reports(spark, sf)).select("id", "key", "reporter", "access")


_SECONDS = f"(select *, epoch_us(seen) / 1e6 as at_s, row_number() over (partition by reporter order by seen, id) i from {v.REPORTS})"


@query(f"""with recursive r as (select * from {_SECONDS}), w as (select id, reporter, i, [at_s] as kept, true as allowed from r where i = 1
 union all select r.id, r.reporter, r.i, case when len(list_filter(w.kept, lambda k: r.at_s - k < 3600)) < 30 then list_append(list_filter(w.kept, lambda k: r.at_s - k < 3600), r.at_s) else list_filter(w.kept, lambda k: r.at_s - k < 3600) end,
 len(list_filter(w.kept, lambda k: r.at_s - k < 3600)) < 30 from w join r on r.reporter = w.reporter and r.i = w.i + 1) select id, allowed from w""")
def report_limit(spark, sf):
    """Thirty accepted reports an hour from a device; the oracle goes through them one by one."""
    return reports.allowed(v.reports(spark, sf)).select("id", "allowed")


@query(f"select key, date_trunc('hour', seen) as hour, count(*) n from {v.REPORTS} group by all")
def report_hours(spark, sf):
    return reports.hourly(v.reports(spark, sf)).select("key", F.col("hour.start").cast("timestamp_ntz").alias("hour"), "n")


@query("""with o as (select p_partkey k, p_name nm from part where p_size <= 35), n as (select p_partkey k, p_name || '!' nm from part where p_size > 12)
 select coalesce(o.k, n.k) k, coalesce(n.nm, o.nm) nm, case when o.k is null then timestamp '2024-02-01' else timestamp '2024-01-01' end first_seen,
 case when n.k is null then timestamp '2024-01-01' else timestamp '2024-02-01' end last_seen, case when n.k is null then timestamp '2024-02-01' end gone_at from o full outer join n on o.k = n.k""")
def snapshot_merge(spark, sf):
    """A store of the smaller parts after a crawl that saw the larger ones."""
    part = v.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("nm"), "p_size")
    at = lambda d: F.to_timestamp_ntz(F.lit(d)) if d else F.lit(None).cast("timestamp_ntz")
    store = part.where("p_size <= 35").drop("p_size").withColumns({"first_seen": at("2024-01-01 00:00:00"), "last_seen": at("2024-01-01 00:00:00"), "gone_at": at(None)})
    return sites.apply_snapshot(store, part.where("p_size > 12").withColumn("nm", F.concat("nm", F.lit("!"))), "k", ["nm"], "2024-02-01 00:00:00")


@query("select o_orderkey rel, count(*) n, min(l_partkey) low, max(l_partkey) high from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def outline_boxes(spark, sf):
    """Relation to member positions: the box of each outline."""
    members = v.table(spark, sf, "orders").join(v.table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return members.groupBy(F.col("o_orderkey").alias("rel")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))


@query("select distinct o_custkey k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P'")
def only_approved(spark, sf):
    o = v.table(spark, sf, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct().join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct(), "k", "left_anti")


@query()
def resolved_places(spark, sf):
    """Each record's place; tested against a one-by-one merge."""
    return resolve.places(v.records(spark, sf))


@query()
def built_sites(spark, sf):
    """The whole rebuild: records resolved, named, scored and described; tested against its own rules on small tables."""
    return resolve.build(v.records(spark, sf), v.attractions(spark, sf), v.demolished(spark, sf), v.visits(spark, sf), {"osm": "2024-01-03 00:00:00", "schools": "2024-01-01 00:00:00"}, F.lit("2026-01-10")).select(
        "key", "name", "lat", "lng", "score", "strength", "category", "condition", "kind", "sources", F.array_join("reasons", " | ").alias("reasons"), F.array_join("aliases", "|").alias("aliases"), F.size("entrances").alias("n_entrances"), "first_seen", "added",
        F.col("dates.any").alias("any_day"), F.col("dates.all").alias("all_day"), F.size("members").alias("n_members"),
    )


def _flat(family: str, what: str) -> str:
    return f"(select place, {what} from (select *, row_number() over (partition by place order by weight desc, source, id) r from m where family = '{family}') where r = 1)"


_SITE_TEXT = "coalesce(g.name, '') || coalesce(' ' || g.said, '')"
_CATEGORY = " ".join(f"when regexp_matches(tx, '(?i){p}') then '{k}'" for k, _, p in V.CATEGORIES)
_DEAD = " ".join(f"when regexp_matches(lower(name), '\\b{w}\\b') then '{w}'" for w in V.DEAD_NAME_WORDS)
_EXPLORE = "|".join(V.EXPLORABLE_WORDS)
_TYPES = "('" + "', '".join(V.EXPLORABLE_TYPES) + "')"


@query(f"""with m as (select *, round(lat / 0.01::double, 0) || ',' || round(lng / 0.01::double, 0) as place from {v.RECORDS}),
 g as (select place, nullif(min_by(coalesce(name, ''), {{'f': f, 's': source, 'i': id}}), '') as name, string_agg(kind || ' ' || evidence, ' ' order by f, source, id) said, string_agg(distinct source, '+') srcs, bool_or(f < 2 and replace(lower(kind), ' ', '_') in {_TYPES}) explorable, bool_or(regexp_matches(lower(evidence), 'worked underground|underground (quarr|mine|workings|galler)')) deep, count(*) n from m group by place),
 o as ({_flat('osm', 'weight w, kind k')[1:-1]}), d as ({_flat('wikidata', 'weight w')[1:-1]}), r as ({_flat('open', 'weight w, source s')[1:-1]}), k as (select place, count(distinct case when family = 'open' then source end) n from m group by place),
 b as (select place, kind from (select *, row_number() over (partition by place order by weight desc, f, source, id) r from m) where r = 1), c as (select place, condition from (select place, {_CONDITION.replace('text', 'evidence')} condition, row_number() over (partition by place order by weight desc, f, source, id) r from m) where condition is not null qualify row_number() over (partition by place order by r) = 1),
 s as (select g.*, {_SITE_TEXT} tx, b.kind, c.condition as told, case {_DEAD} end word, coalesce(o.w, 0) + case when o.w is null then coalesce(d.w, 0) else coalesce(d.w, 0) // 2 end + case when o.w is null and d.w is null then coalesce(r.w, 0) else coalesce(r.w, 0) // 2 end as base,
  (o.w is not null)::int + (d.w is not null)::int + k.n as agree from g left join o using (place) left join d using (place) left join r using (place) join k using (place) join b using (place) left join c using (place))
 select place as key, name, cast(least(100, base + case when agree > 2 then least(10, 5 * (agree - 2)) else 0 end + case when word is not null then 15 else 0 end + case when explorable or regexp_matches(lower(name), '\\b({_EXPLORE})\\b') then 10 else 0 end) as int) score,
 case when regexp_matches(kind, '(?i)\\bschool|\\bcollege\\b|\\bacademy\\b|care home|nursing home|\\bhospital\\b|hospice|\\bnhs\\b|day centre') then 'institutional' when regexp_matches(kind, '(?i)^railway tunnel$') then 'tunnels' when regexp_matches(kind, '(?i)^railway viaduct$') then 'rail' {_CATEGORY.replace('when', 'when', 1)} else 'other' end category,
 case when deep then 'Underground' when told is not null then told else coalesce(case word when 'abandoned' then 'Abandoned' when 'derelict' then 'Abandoned' when 'disused' then 'Disused' when 'defunct' then 'Disused' when 'ruin' then 'Ruin' when 'ruins' then 'Ruin' when 'former' then 'Former' when 'closed down' then 'Closed' end, 'Historic') end condition,
 array_to_string(list_sort(list_transform(string_split(srcs, '+'), lambda x: case x when 'osm' then '0osm' when 'wikidata' then '1wikidata' else '2' || x end)), '+') sources from s""")
def place_scores(spark, sf):
    """Scores, categories and conditions over records gathered by grid cell."""
    at = lambda c: F.round(F.col(c) / 0.01, 0).cast("string")
    rows = v.records(spark, sf).withColumns({"place": F.concat_ws(",", at("lat"), at("lng")), "f": F.array_position(F.array(*map(F.lit, resolve.FAMILIES)), F.col("family")).cast("int") - 1})
    member = F.struct("f", F.col("source").alias("o1"), F.col("id").alias("o2"), *[F.col(c) for c in resolve.MEMBER])
    gathered = rows.groupBy(F.col("place").alias("key")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    none = F.lit(None).cast("struct<kind:string,name:string,source:string>")
    scored = resolve.with_scores(gathered.withColumns({"name": F.col("members")[0]["name"], "in_use": none, "gone": none}))
    ranked = F.transform(F.split("sources", r"\+"), lambda x: F.concat(F.when(x == "osm", "0").when(x == "wikidata", "1").otherwise("2"), x))
    return scored.select("key", "name", "score", "category", "condition", F.array_join(ranked, "+").alias("sources"))
