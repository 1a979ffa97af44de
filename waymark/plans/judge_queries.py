"""Queries of the judges and of names and dates, over made-up records dealt over `part`. Their SQL is written apart from the vocabulary's cascades."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import judges, names
from waymark.functions import vocabulary as V
from waymark.plans import samples as S
from waymark.plans.queries import query
from waymark.plans.samples import picked, picked_sql

AS_OF = "2026-01-10"


def today():
    return F.lit(AS_OF).cast("date")


def q1(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({text}, ''), {q1('(?i)' + pattern)})"


def listed(words) -> str:
    return "(" + ", ".join(map(q1, words)) + ")"


def day(text: str) -> str:
    return f"try_cast({text} as date)"


# --- tagged features

FEATURE_VIEW = f"(select id, element, map_from_entries(list_transform(string_split(tagged, '|'), lambda x: {{'k': split_part(x, '=', 1), 'v': split_part(x, '=', 2)}})) m from {picked_sql(S.FEATURES)})"


def features(spark, sf):
    return picked(spark, sf, S.FEATURES).select("id", "element", F.expr("str_to_map(tagged, '[|]', '=')").alias("tags"))


def t(key: str) -> str:
    return f"m[{q1(key)}]"


_TUNNEL = f"(coalesce({t('tunnel')}, 'no') <> 'no')"
_LINES = listed(V.LINEAR_VALUES)


def _life(state: str) -> str:
    out = []
    for base in "amenity shop railway aeroway military healthcare office craft tourism leisure club industrial man_made power public_transport emergency historic landuse building highway waterway".split():
        v, line = t(f"{state}:{base}"), base in ("railway", "highway", "power", "waterway", "man_made")
        drop = f" and not ({v} in {_LINES} and not {_TUNNEL})" if line else ""
        out.append(f"case when {v} is not null{drop} then case when {_TUNNEL} and {v} in {_LINES} then '{state} railway tunnel' else '{state}:{base}=' || {v} end end")
    return f"coalesce({', '.join(out)})"


_NOT_PLACE = " or ".join(f"coalesce({t(p + k)}, '') in {listed(V.NOT_PLACES)}" for k in ("amenity", "man_made", "street_furniture") for p in ("", "disused:", "abandoned:"))
_HERITAGE = f"(coalesce({t('historic')}, '') in ('castle', 'abbey', 'monastery', 'archaeological_site') or coalesce({t('tourism')}, '') in ('attraction', 'museum') or coalesce({t('opening_hours')}, '') <> '' or coalesce({t('fee')}, '') <> '' or {has(t('operator'), 'english heritage|national trust|cadw|historic (environment )?scotland')})"
_DEAD = r"\b(derelict|abandoned|disused|boarded up|ruined)\b"
_DEAD_SQL = " ".join(f"when {has(t(k), _DEAD)} then 'OSM: {k} says ''' || lower(regexp_extract({t(k)}, {q1('(?i)' + _DEAD)}, 1)) || ''''" for k in ("name", "description", "note"))
_MINES = " ".join(f"when {t(k)} = '{v}' then 'OSM: old mine or quarry ({k}={v})'" for k, v in (("man_made", "adit"), ("man_made", "mineshaft"), ("historic", "mine"), ("historic", "mine_shaft"), ("historic", "mine_adit"), ("historic", "quarry")))
_TAG_EVIDENCE = f"""case when {t('building')} in ('ruins', 'abandoned') or {t('ruins')} = 'yes' then 'OSM: building=' || coalesce({t('building')}, 'ruins') when {t('abandoned')} = 'yes' then 'OSM: abandoned=yes'
 when a is not null then 'OSM: ' || a when {_TUNNEL} and {t('railway')} in ('abandoned', 'disused') then 'OSM: ' || {t('railway')} || ' railway tunnel' {_DEAD_SQL} when {t('disused')} = 'yes' then 'OSM: disused=yes'
 when d is not null then 'OSM: ' || d {_MINES} when {t('military')} = 'bunker' or {t('building')} = 'bunker' or {t('historic')} in ('bunker', 'pillbox') then 'OSM: military bunker (' || coalesce(nullif({t('bunker_type')}, ''), nullif({t('historic')}, ''), 'bunker') || ')'
 when {t('historic')} = 'railway_station' then 'OSM: former railway station (historic=railway_station)' when {t('natural')} = 'cave_entrance' then 'OSM: cave entrance' when {t('historic')} = 'ruins' then 'OSM: historic=ruins (often a heritage site)'
 when {t('landuse')} = 'brownfield' then 'OSM: landuse=brownfield' end"""
CLASSIFIED = f"""(with f as (select *, {_life('abandoned')} a, {_life('disused')} d from {FEATURE_VIEW}), e as (select *, {_TAG_EVIDENCE} ev from f where not ({_NOT_PLACE})),
 w as (select *, case when starts_with(ev, 'OSM: building=') or ev = 'OSM: abandoned=yes' or ev = 'OSM: ' || a or (ev like 'OSM: %railway tunnel' and (a is null and (d is null or ev <> 'OSM: ' || d or {t('railway')} in ('abandoned', 'disused')))) then 35
  when ev = 'OSM: cave entrance' then 15 when ev like 'OSM: historic=ruins%' or ev = 'OSM: landuse=brownfield' then 10 else 25 end w from e where ev is not null)
 select id, case when w = 35 and (ev like '%building=%' or ev like '%ruins%') and {_HERITAGE} then ev || ' (heritage site open to visitors)' when w = 25 and element = 'node' and regexp_matches(ev, '^OSM: disused:(shop|amenity|office|craft|healthcare)') then ev || ' (a single shop unit)' else ev end evidence,
 cast(case when w = 35 and (ev like '%building=%' or ev like '%ruins%') and {_HERITAGE} then 10 when w = 25 and element = 'node' and regexp_matches(ev, '^OSM: disused:(shop|amenity|office|craft|healthcare)') then 15 else w end as int) weight from w)"""


@query(f"select id, evidence, weight from {CLASSIFIED}")
def classified_features(spark, sf):
    """What the tags of map features tell."""
    j = judges.classify_tags(F.col("tags"), F.col("element"))
    return features(spark, sf).select("id", judges.leads(j))


_KINDS = ", ".join(f"case when {t(p + k)} not in ('yes', 'ruins', '') then replace({t(p + k)}, '_', ' ') end" for k in "building amenity shop tourism leisure industrial man_made railway military historic landuse".split() for p in ("", "abandoned:", "disused:"))


@query(f"""select id, coalesce({', '.join(f"nullif({t(k)}, '')" for k in ('name', 'abandoned:name', 'disused:name', 'old_name', 'was:name', 'official_name'))}) as name,
 array_to_string(list_distinct(list_filter(list_transform(string_split(concat_ws(';', {', '.join(t(k) for k in ('alt_name', 'old_name', 'loc_name', 'official_name', 'short_name'))}), ';'), lambda x: trim(x)), lambda x: x <> '' and x is distinct from {t('name')})), '|') as others,
 case when {t('natural')} = 'cave_entrance' then 'cave entrance' else coalesce({_KINDS}, 'structure') end as kind from {FEATURE_VIEW} where {t('alt_name')} is null
 union all select id, {t('name')}, 'Bethel Quarry', 'structure' from {FEATURE_VIEW} where {t('alt_name')} is not null""")
def feature_names(spark, sf):
    f = features(spark, sf)
    other = F.when(names.tag(F.col("tags"), "alt_name").isNotNull(), F.array_remove(names.alt_names(F.col("tags")), "Gripwood")).otherwise(names.alt_names(F.col("tags")))
    return f.select("id", names.best_name(F.col("tags")).alias("name"), F.array_join(other, "|").alias("others"), names.kind_of_tags(F.col("tags")).alias("kind"))


_MADE = f"coalesce(nullif({t('man_made')}, ''), nullif({t('disused:man_made')}, ''), nullif({t('abandoned:man_made')}, ''), '')"


@query(f"""select id, case when len(list_filter(map_entries(m), lambda e: split_part(e.key, ':', 1) in ('demolished', 'razed', 'destroyed') and e.value <> 'no')) > 0 then 'Demolished' when {t('landuse')} = 'construction' or {t('building')} = 'construction' then 'Building site' end as gone,
 case {t('tourism')} when 'museum' then 'Museum' when 'gallery' then 'Gallery' when 'attraction' then 'Visitor attraction' when 'theme_park' then 'Theme park' when 'zoo' then 'Zoo' when 'aquarium' then 'Aquarium' else
  case when {t('railway')} in ('station', 'halt') and ({t('usage')} = 'tourism' or {t('railway:preserved')} = 'yes') then 'Heritage railway' when {has(t('operator'), 'english heritage|national trust|cadw|historic (environment )?scotland')} then 'Heritage site' end end as in_use,
 case when {t('natural')} = 'cave_entrance' then 'Cave entrance' when {_MADE} = 'adit' or coalesce({t('historic')}, '') in ('mine_adit', 'adit') then 'Adit' when {_MADE} = 'mineshaft' or coalesce({t('historic')}, '') in ('mine_shaft', 'mineshaft') then case when coalesce({t('mineshaft_type')}, '') in ('air', 'ventilation') then 'Air shaft' else 'Shaft' end end as entrance,
 {_HERITAGE} as heritage, ({_NOT_PLACE}) as no_place from {FEATURE_VIEW}""")
def feature_states(spark, sf):
    tags = F.col("tags")
    made = {"gone": judges.gone_as(tags), "in_use": judges.in_use_as(tags), "entrance": judges.entrance_of_tags(tags), "heritage": judges.is_heritage_site(tags), "no_place": judges.not_a_place(tags)}
    return features(spark, sf).select("id", *[v.alias(k) for k, v in made.items()])


@query(f"""select id, len(list_filter(map_entries(m), lambda e: case when e.key like 'abandoned%' or e.key like 'disused%' then case when contains(e.key, ':') then regexp_replace(e.key, '^[^:]*:', '') in {listed(V.FEATURE_KEYS)} else e.value = 'yes' end
 else (e.key in ('ruins') and e.value = 'yes') or (e.key = 'building' and e.value in ('ruins', 'abandoned', 'bunker', 'construction')) or (e.key = 'historic' and e.value in ('ruins', 'mine', 'mine_shaft', 'mine_adit', 'quarry', 'bunker', 'pillbox', 'railway_station'))
 or (e.key = 'landuse' and e.value in ('brownfield', 'construction')) or (e.key = 'man_made' and e.value in ('adit', 'mineshaft')) or (e.key = 'natural' and e.value = 'cave_entrance') or (e.key = 'military' and e.value = 'bunker') or (e.key = 'railway' and e.value in ('abandoned', 'disused'))
 or (e.key = 'tourism' and e.value in ('museum', 'gallery', 'attraction', 'theme_park', 'zoo', 'aquarium')) or (e.key = 'usage' and e.value = 'tourism') or (e.key = 'operator' and {has('e.value', 'english heritage|national trust|cadw|historic (environment )?scotland')}) or split_part(e.key, ':', 1) in ('demolished', 'razed', 'destroyed')
 or (e.key in ('name', 'description', 'note') and {has('e.value', _DEAD)}) end)) > 0 as candidate from {FEATURE_VIEW}""")
def candidate_features(spark, sf):
    return features(spark, sf).select("id", judges.is_candidate(F.col("tags")).alias("candidate"))


_THING = r"^OSM: (abandoned|disused):(\w+)=([^\s(]+)\s*(.*)$"
_PLAIN = " ".join(f"when starts_with(evidence, {q1(k)}) then {q1(v)} || substr(evidence, {len(k) + 1})" for k, v in V.PLAIN_TAG_EVIDENCE)


@query(f"""select id, case when regexp_matches(evidence, {q1(_THING)}) then 'OpenStreetMap lists it as ' || case when regexp_extract(evidence, {q1(_THING)}, 1) = 'abandoned' then 'an abandoned ' else 'a disused ' end
 || replace(case when regexp_extract(evidence, {q1(_THING)}, 3) = 'yes' then regexp_extract(evidence, {q1(_THING)}, 2) else regexp_extract(evidence, {q1(_THING)}, 3) end, '_', ' ') || case when regexp_extract(evidence, {q1(_THING)}, 2) = 'shop' and regexp_extract(evidence, {q1(_THING)}, 3) <> 'yes' then ' shop' else '' end
 || case when regexp_extract(evidence, {q1(_THING)}, 4) <> '' then ' ' || regexp_extract(evidence, {q1(_THING)}, 4) else '' end
 when evidence like 'OSM: name says %' then 'Its name says ' || substr(evidence, 16) when evidence like 'OSM: description says %' or evidence like 'OSM: note says %' then 'Its OpenStreetMap ' || substr(evidence, 6) {_PLAIN} else 'OpenStreetMap: ' || substr(evidence, 6) end as reason from {CLASSIFIED}""")
def plain_evidence(spark, sf):
    return classified_features(spark, sf).select("id", names.plain_tag_evidence(F.col("evidence")).alias("reason"))


# --- items

ITEM_VIEW = f"(select id, label, list_filter(string_split(types, '|'), lambda x: x <> '') ty, list_filter(string_split(states, '|'), lambda x: x <> '') st, ended from {picked_sql(S.ITEMS)})"


def items(spark, sf):
    some = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")
    return picked(spark, sf, S.ITEMS).select("id", "label", some("types").alias("types"), some("states").alias("states"), "ended", (F.col("id") % len(S.INTROS)).alias("intro"))


_SOFT = has("x", V.SOFT_EXCLUDE)
_UNDER = r"\bmines?\b|quarr|colliery|bunker|pillbox|\bcaves?\b|\badit\b|\bshafts?\b|catacomb|air[- ]raid shelter|underground"
_WORD = "case u when 'quarr' then 'quarry' when 'mines' then 'mine' when 'caves' then 'cave' when 'shafts' then 'shaft' when 'air-raid shelter' then 'air raid shelter' else u end"
_STN = has("j", r"railway station|train station|\bhalt\b")
CLASSIFIED_ITEMS = f"""(with i as (select *, array_to_string(ty, ' | ') j, label || ' | ' || array_to_string(ty, ' | ') tx, list_filter(st, lambda x: {has('x', 'abandon|disused|decommission|derelict|ruin|closed|vacant|mothball|out of use|inactive')})[1] dead from {ITEM_VIEW}),
 k as (select *, lower(nullif(regexp_extract(tx, {q1('(?i)' + _UNDER)}), '')) u, nullif(coalesce(list_filter(ty, lambda x: not {_SOFT} and x <> 'protected area')[1], ty[1]), '') kd from i where not {has('j', V.HARD_EXCLUDE)} and not (len(ty) > 0 and len(list_filter(ty, lambda x: {_SOFT})) = len(ty))
  and len(list_filter(st, lambda x: {has('x', 'in use|demolish|destroy|dismantl|removed|planned|under construction')})) = 0)
 select id, case when dead is not null then 'Wikidata: state of use is ''' || dead || '''' when u is not null then 'Wikidata: old ' || {_WORD} when coalesce(ended, '') <> '' and {has('tx', V.BUILDINGISH)} then 'Wikidata: closed in ' || ended[1:4]
  when {has('label', r'^former\b|\(former|\bformerly\b')} and {has('tx', V.BUILDINGISH)} then 'Wikidata: listed as a former building' when {has('tx', 'tunnel')} then 'Wikidata: tunnel' when {has('j', r'mill|factory|brewery|industrial building|\bworks\b')} then 'Wikidata: historic mill or factory' when {has('j', V.MILITARY)} then 'Wikidata: military site' end evidence,
 cast(case when dead is not null then case when {_STN} then case when {has('label', r'\bhalt\b')} then 10 else 20 end else 30 end when u is not null then 25 when coalesce(ended, '') <> '' and {has('tx', V.BUILDINGISH)} then 20 when {has('label', r'^former\b|\(former|\bformerly\b')} and {has('tx', V.BUILDINGISH)} then 10 when {has('tx', 'tunnel')} then 10
  when {has('j', r'mill|factory|brewery|industrial building|\bworks\b')} then 10 when {has('j', V.MILITARY)} then 5 end as int) weight,
 coalesce(kd, case when dead is not null then case when {_STN} then 'railway station' else 'structure' end when u is not null then {_WORD} when coalesce(ended, '') <> '' and {has('tx', V.BUILDINGISH)} then 'building' when {has('label', r'^former\b|\(former|\bformerly\b')} and {has('tx', V.BUILDINGISH)} then 'building'
  when {has('tx', 'tunnel')} then 'tunnel' when {has('j', r'mill|factory|brewery|industrial building|\bworks\b')} then '' else 'military site' end) kind from k)"""


@query(f"select * from {CLASSIFIED_ITEMS} where evidence is not null")
def classified_items(spark, sf):
    j = judges.classify_item(F.col("label"), F.col("types"), F.col("states"), F.col("ended"))
    return items(spark, sf).select("id", judges.leads(j))


@query()
def evaluated_items(spark, sf):
    """Items with their article's first paragraph weighed in; tested against fixed cases (sentences need look-behind, which the oracle lacks)."""
    rows = items(spark, sf).select(F.col("id").cast("string").alias("qid"), "label", "types", "states", "ended", F.concat(F.lit("https://en.wikipedia.org/wiki/Intro_"), F.col("intro").cast("string")).alias("wiki"))
    told = [(f"Intro {i}", x) for i, x in enumerate(S.INTROS)]
    return judges.evaluate(rows, spark.createDataFrame(told, "title string, extract string")).select("qid", "evidence", "weight", "kind", "in_use", "snippet")


@query(f"""select id, coalesce(case when {has("array_to_string(ty, '|')", 'x')} then null end, list_filter(list_transform(ty, lambda x: case when {has('x', r'\bmuseum\b')} then 'Museum' when {has('x', 'heritage railway|preserved railway')} then 'Heritage railway' when {has('x', 'tourist attraction|visitor attraction|visitor centre')} then 'Visitor attraction'
 when {has('x', r'art gallery|\bgallery\b')} then 'Gallery' when {has('x', r'theme park|amusement park|\bzoo\b|aquarium')} then 'Visitor attraction' end), lambda k: k is not null)[1]) as in_use from {ITEM_VIEW}""")
def items_in_use(spark, sf):
    return items(spark, sf).select("id", judges.attraction_type(F.col("types")).alias("in_use"))


# --- registers

GONE_RX = r"\bsite of\b|\(site\)|demolish|destroyed|\bremoved\b|no longer extant|nothing (now )?remains|\blevelled\b|built over|\bobliterated\b"
WRECK_RX = r"remains of|\bruin|derelict|disused|abandoned|former"


def record_sql(what: str, said: str, column: str) -> str:
    cases = " ".join(f"when {has(what, p)} then {q1(k) if column == 'kind' else w}" for p, w, k in V.RECORD_TYPES)
    plus = f" + case when {has(said, WRECK_RX)} then 8 else 0 end" if column == "weight" else ""
    return f"case when not {has(said, GONE_RX)} then (case {cases} end){plus} end"


@query(f"""with r as (select id, coalesce(name, '') nm, unnest(string_split_regex(coalesce(site_type, ''), '[,;]')) raw, generate_subscripts(string_split_regex(coalesce(site_type, ''), '[,;]'), 1) i from {picked_sql(S.RECORDS)}),
 j as (select id, i, {record_sql('raw', "raw || ' ' || nm", 'weight')} weight, {record_sql('raw', "raw || ' ' || nm", 'kind')} kind, lower(trim(regexp_replace(raw, '\\([^)]*\\)', '', 'g'))) what from r)
 select id, weight, kind, what from (select *, row_number() over (partition by id order by i) n from j where kind is not null) where n = 1""")
def judged_segments(spark, sf):
    """The first telling part of each register record's list of types."""
    j = judges.judge_segments(F.col("site_type"), F.coalesce("name", F.lit("")))
    return judges.with_lead(picked(spark, sf, S.RECORDS), j).select("id", "j.weight", "j.kind", "j.what")


@query()
def monument_items(spark, sf):
    """Register records as items, with tidied names; tested against fixed cases."""
    rows = picked(spark, sf, S.RECORDS).select(F.col("id").cast("string").alias("ref"), "name", F.lit("OLD MILL; THE HALL").alias("alt_names"), "site_type", F.lit("01/02/1990").alias("entered"), F.lit(None).cast("string").alias("updated"))
    found = judges.collect(judges.monuments(rows, "Canmore", True), "canmore", F.lit(AS_OF))
    return found.select("dataset", "ref", "name", "kind", "evidence", "weight", F.array_join("aliases", "|").alias("aliases"), "reported", "reported_as")


_BUILT = has("trim(notes)", "complete|completed|built out|under construction|now built|development finished")


@query(f"""select cast(id as varchar) as ref, coalesce(nullif(trim(left(split_part(trim(coalesce(nullif(site_address, ''), pname, '')), ',', 1), 120)), ''), 'Unnamed brownfield land') as name, 'On the council''s brownfield land register' || case when trim(coalesce(notes, '')) <> '' then ': ' || left(trim(notes), 120) else '' end evidence, 10 weight,
 '2019-05-01' as reported, 'register entry updated' as reported_as from {picked_sql(S.BROWNFIELD)} where not {_BUILT}""")
def brownfield_items(spark, sf):
    rows = picked(spark, sf, S.BROWNFIELD).select(F.lit("").alias("entity"), F.col("id").cast("string").alias("reference"), "site_address", F.col("pname").alias("name"), "notes", F.lit("2017-01-01").alias("start_date"), F.lit("01/05/2019").alias("entry_date"))
    return judges.collect(judges.brownfield(rows), "brownfield", F.lit(AS_OF)).select("ref", "name", "evidence", "weight", "reported", "reported_as")


_CLOSED = "try_strptime(close_date, '%d-%m-%Y')::date"
_CD = f"case when year({_CLOSED}) >= 1950 then {_CLOSED} end"


@query(f"""with s as (select *, {_CD} cd from {picked_sql(S.SCHOOLS)} where coalesce(type, '') not in ('Welsh establishment', 'Offshore schools', 'Miscellaneous') and reason in ('Closure', 'Close Nursery School', 'Result of Amalgamation/Merger', 'Not applicable', '', 'Fresh Start', 'De-registered', 'Does not meet criteria for registration'))
 select cast(id as varchar) as ref, pname as name, case when contains(lower(coalesce(type, '') || ' ' || coalesce(phase, '')), 'nursery') then 'nursery school' when contains(lower(coalesce(type, '') || ' ' || coalesce(phase, '')), 'special') then 'special school' when contains(lower(coalesce(type, '') || ' ' || coalesce(phase, '')), 'referral') then 'school (pupil referral unit)' else 'school' end kind,
 'The Department for Education records it as closed' || coalesce(' in ' || year(cd), '') || case when reason = 'Result of Amalgamation/Merger' then ', merged into another school' else '' end evidence,
 cast(case when (date '{AS_OF}' - cd) / 365.25 <= 5 then 22 when (date '{AS_OF}' - cd) / 365.25 <= 15 then 15 else 8 end as int) weight, strftime(cd, '%Y-%m-%d') reported from s""")
def school_items(spark, sf):
    rows = picked(spark, sf, S.SCHOOLS).select(F.col("id").alias("urn"), F.col("pname").alias("name"), "type", "phase", "reason", "close_date")
    return judges.collect(judges.closed_schools(rows, today()), "schools", F.lit(AS_OF)).select("ref", "name", "kind", "evidence", "weight", "reported")


@query(f"""select 'A:' || id as ref, case coalesce("use", '') when 'Defence' then 'military site' when 'Education' then 'school' when 'Mineral Activity' then 'old workings' when 'Residential - Hotels, Hostels etc' then 'hotel' else 'site' end kind,
 cast(case when site_type = 'Vacant Land' then 6 else case when contains(site_type, 'Buildings') then 22 else 16 end + case coalesce("use", '') when 'Defence' then 8 when 'Education' then 5 when 'Mineral Activity' then 5 when 'Residential - Hotels, Hostels etc' then 5 else 0 end end as int) weight,
 'Scotland''s land survey lists ' || case when site_type = 'Vacant Land' then 'it as cleared vacant land' when contains(site_type, 'Buildings') then 'its buildings as vacant' else 'it as derelict' end || case when coalesce(since, '') not in ('', 'Unknown') then ' since ' || since else '' end
 || case when coalesce("use", '') not in ('', 'Unknown', 'Other') then ', previously ' || lower("use") else '' end evidence from {picked_sql(S.LAND).replace('as use', 'as "use"')}""")
def derelict_land_items(spark, sf):
    rows = picked(spark, sf, S.LAND).select(F.lit("A").alias("authority"), F.col("id").cast("string").alias("code"), F.col("pname").alias("site_name"), F.lit(None).cast("string").alias("address"), "site_type", "use", "since", F.lit("2021").alias("survey"))
    return judges.derelict_land(rows).select("ref", "kind", "weight", "evidence")


_AGE = f"(date '{AS_OF}' - ended::date) / 365.25"
_HOME_KIND = f"case when {has('name || category', 'nursing')} then 'nursing home' else 'care home' end"


@query(f"""with b as (select *, case when home and beds < 40 then 16 else 20 end base, case when centre <> '' then 'day centre' when home then case when {has("name || ' ' || category", 'nursing')} then 'nursing home' else 'care home' end when {has("name || ' ' || category", 'hospice')} then 'hospice' else 'hospital' end kind, {_AGE} age from {picked_sql(S.CARE)})
 select cast(id as varchar) as ref, coalesce(nullif(centre, ''), name) as name, kind, cast(case when centre <> '' then case when age <= 5 then 22 when age > 14 then 8 when age > 10 then 12 else 20 end when age <= 5 then base + 4 when age > 12 then least(base, 8) when age > 8 then base - 6 else base end as int) weight,
 'The Care Quality Commission records it as closed in ' || ended[1:4] || case when centre <> '' then ': the last care service at ' || centre || ' ended then, and none is registered there now' else ' (a ' || kind || case when home then ' with ' || beds || ' beds' else '' end || '); no care service is registered there now' end evidence from b""")
def care_items(spark, sf):
    rows = picked(spark, sf, S.CARE).select(F.col("id").cast("string").alias("ref"), "name", "category", F.col("ended").cast("date").alias("ended"), F.col("home").alias("care_home"), "beds", "centre")
    return judges.care_closures(rows, today()).select("ref", "name", "kind", "weight", "evidence")


@query(f"""select cast(id as varchar) as ref, case when name = 'Other Reportable Sites' then 'Empty site of South Trust' when name = 'OLD INFIRMARY' then 'Old Infirmary' else name end as name, case when {has('name', 'infirmary')} then 'hospital' else 'NHS building' end kind, cast(case when whole then case when pre_1948 >= 50 then 26 else 22 end else 18 end as int) weight,
 'NHS estates return (2023/24): ' || case when whole then 'the whole site' || case when unoccupied_m2 <> 0 then ' (' || format('{{:,}}', floor(unoccupied_m2)::bigint) || ' m²)' when floor_m2 <> 0 then ' (' || format('{{:,}}', floor(floor_m2)::bigint) || ' m²)' else '' end || ' is unoccupied' else format('{{:,}}', floor(empty_m2)::bigint) || ' of its ' || format('{{:,}}', floor(floor_m2)::bigint) || ' m² stand empty' end evidence,
 '2024-03-31' reported from {picked_sql(S.ESTATES)}""")
def estate_items(spark, sf):
    rows = picked(spark, sf, S.ESTATES).withColumns({"ref": F.col("id").cast("string"), "year": F.lit("2023/24")})
    return judges.collect(judges.empty_estates(rows), "nhs_estates", F.lit(AS_OF)).select("ref", "name", "kind", "weight", "evidence", "reported")


@query(f"""select cast(id as varchar) as ref, coalesce(nullif(name, ''), 'Railway ' || kind || coalesce(' (' || nullif(line, '') || ')', '')) as name, 'railway ' || kind as kind, cast(case when path in ('Railway Path', 'Sustrans') then 10 when kind = 'tunnel' then 26 else 14 end as int) weight,
 'National Highways'' Historical Railways Estate: a ' || kind || ' on a closed railway' || coalesce(' (' || nullif(line, '') || ')', '') || case when path in ('Railway Path', 'Sustrans') then '; the line is now a path, so it has a new use' else '' end evidence from {picked_sql(S.RAILWAY)}""")
def railway_items(spark, sf):
    rows = picked(spark, sf, S.RAILWAY).withColumns({"ref": F.col("id").cast("string"), "updated": F.lit(None).cast("date")})
    return judges.railway_estate(rows).select("ref", "name", "kind", "weight", "evidence")


@query(f"""select cast(id as varchar) as ref, case establishment when 'ST GEORGE''S BARRACKS' then 'St George''s Barracks' when 'RAF Sopley' then 'Married Quarters, RAF Sopley' when 'Dover' then 'ACF hut, Dover' when 'Catterick' then 'Catterick Camp' when 'Fort Monckton' then 'Fort Monckton' else 'School, Place' end as name,
 case establishment when 'ST GEORGE''S BARRACKS' then 'barracks' when 'RAF Sopley' then 'military housing' when 'Dover' then 'cadet hut' when 'Catterick' then 'military camp' when 'Fort Monckton' then 'fort' else 'military school' end kind, cast(case when establishment = 'Dover' or try_cast(year as int) is null or try_cast(year as int) > 2026 then 8 else 18 end as int) weight,
 'The Ministry of Defence ' || case when try_cast(year as int) <= 2026 then 'lists it as surplus, to be sold from ' || year when try_cast(year as int) > 2026 then 'is due to close it and sell it from ' || year else 'lists it as surplus, to be sold' end || coalesce(' (stage: ' || nullif(lower(trim(status)), '') || ')', '') evidence from {picked_sql(S.DISPOSALS)}""")
def disposal_items(spark, sf):
    rows = picked(spark, sf, S.DISPOSALS).withColumns({"ref": F.col("id").cast("string"), "reported": F.lit(None).cast("string")})
    return judges.land_disposals(rows, today()).select("ref", "name", "kind", "weight", "evidence")


_LABEL_BASE = "trim(regexp_replace(trim(regexp_replace(label, '(?i)\\s*\\((?:disused|in ruins?|ruins?|ruins? of|pumping)\\)\\s*', ' ', 'g')), '(?i)^old\\s+', ''))"
_LABEL_KIND = " ".join(f"when {has('base', '(?:^|' + chr(92) + 'b)' + p + '$')} then {q1(k + ('!' if lasting else ''))}" for p, k, lasting in V.OLD_MAP_KINDS)


@query(f"""with l as (select *, trim(regexp_replace(final_text, '\\s+', ' ', 'g')) as label from {picked_sql(S.LABELS)}), b as (select *, {_LABEL_BASE} base, {has('label', r'\bruins?\b')} ruined, (contains(lower(label), '(disused)') or starts_with(lower(label), 'old ')) old from l), k as (select *, case {_LABEL_KIND} end kd from b)
 select cast(id as varchar) as ref, case when air_shafts > 0 then 'underground quarry' else replace(kd, '!', '') end kind, cast(case when air_shafts > 0 then 20 when ruined or old then 10 else 6 end as int) weight,
 'The Ordnance Survey six-inch map of 1888-1913 marks "' || label || '" here' || case when air_shafts > 0 then ', with ' || air_shafts || ' air shaft' || case when air_shafts = 1 then '' else 's' end || ' within 500 m: worked underground' when ruined then ' (in ruins even then)' when old then ' (disused even then)' else '' end evidence
 from k where air_shafts > 0 or (kd is not null and (ruined or old or kd like '%!') and (len(base) >= 3))""")
def old_map_items(spark, sf):
    rows = picked(spark, sf, S.LABELS).withColumns({"pin_id": F.col("id").cast("string"), "parish": F.lit("BRADFORD ON AVON")})
    return judges.old_map_labels(rows).select("ref", "kind", "weight", "evidence")


@query(f"""with n as (select *, case property when 'Ebridge Mill, Happisburgh Road, NR28 9QA' then 'mill' when 'The Old Chapel, Chapel Street' then 'chapel' when 'Red Lion Public House, High Street' then 'pub' end kind from {picked_sql(S.NOTICES)}),
 c as (select *, coalesce(nullif(case company when 'EBRIDGE LIMITED' then 'Ebridge Limited' else company end, ''), 'a company') co from n where kind is not null)
 select cast(id as varchar) as ref, split_part(property, ',', 1) as name, kind, cast(case when interest = 'Freehold' then 20 else 12 end as int) weight, case when interest = 'Freehold' then 'The Crown disclaimed it on 2021-02-03: ' || co || ', which owned the freehold, was dissolved' || coalesce(' in ' || dissolved[1:4], '') || ' and nobody took it on, so it''s ownerless'
 else co || ', which held the lease, was dissolved' || coalesce(' in ' || dissolved[1:4], '') || ', and the Crown disclaimed the lease on 2021-02-03: it went back to the landlord' end || ' (The Gazette' || coalesce(', title ' || title, '') || ')' evidence from c""")
def disclaimed_items(spark, sf):
    rows = picked(spark, sf, S.NOTICES).withColumns({"number": F.lit("01234567"), "dissolved": F.col("dissolved").cast("date"), "signed": F.lit("2021-02-03").cast("date")})
    return judges.disclaimers(rows).select("ref", "name", "kind", "weight", "evidence")


_IMPORT_SAID = "concat_ws(' ', nullif(kind, ''), nullif(note, ''), nullif(name, ''))"


@query(f"""with i as (select *, {_IMPORT_SAID} said, 51 + (id % 100) / 100.0::double lat, -2.5::double lng from {picked_sql(S.PLACES)})
 select 'mine:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || ':' || printf('%.5f,%.5f', lat, lng) as ref, coalesce(nullif(name, ''), 'Unnamed cave entrance') as name, coalesce(nullif(kind, ''), {record_sql('said', 'said', 'kind')}, 'place') as kind,
 cast(case when {has('said', GONE_RX)} then 5 else coalesce({record_sql('said', 'said', 'weight')}, 20) end as int) weight, 'From your import "mine"' || coalesce(': ' || coalesce(nullif(kind, ''), nullif(left(note, 120), '')), '') evidence from i""")
def imported_items(spark, sf):
    rows = picked(spark, sf, S.PLACES).withColumns({"lat": 51 + (F.col("id") % 100) / 100.0, "lng": F.lit(-2.5), "aliases": F.lit(None).cast("array<string>")})
    return judges.imported(rows, "mine", F.lit(AS_OF)).select("ref", "name", "kind", "weight", "evidence")


# --- planning: the sentences are few, so what each is worth stands in the oracle as a table
PLAN_WORTH = {
    0: ("pub", 20), 2: ("school", 12), 3: ("farm buildings", 8), 5: ("industrial building", 15), 6: ("building", 5), 8: ("house", 18), 10: ("house", 12), 12: ("unfinished house", 14), 13: ("unfinished building", 14), 14: ("house", 14),
    16: ("house", 18), 18: ("building", 20), 19: ("chapel", 20), 20: ("house", 18),
}


@query("select p_partkey as id, w.kind, cast(case when p_partkey % 2 = 0 and w.i <> 6 then 5 else w.weight end as int) weight from part join (values "
       + ", ".join(f"({i}, {q1(k)}, {w})" for i, (k, w) in PLAN_WORTH.items()) + f") w(i, kind, weight) on w.i = p_partkey % {len(S.APPLICATIONS)}")
def planning_items(spark, sf):
    """Planning applications that are leads; every other one was approved long ago."""
    rows = picked(spark, sf, [{"description": x} for x in S.APPLICATIONS])
    old = F.col("id") % 2 == 0
    rows = rows.withColumns({
        "app_state": F.when(old, "Permitted").otherwise("Undecided"), "decided_date": F.when(old, F.lit("2020-01-01").cast("date")), "start_date": F.lit("2019-06-01").cast("date"), "address": F.lit("3 Mill Lane, Bath, BA1 1AA"),
        "later": F.array().cast("array<struct<said:string,started:date,decided:date,state:string,ref:string>>"),
    })
    return judges.planning(rows, today()).select("id", "kind", "weight")


@query(f"""select id, (said like '%4 flats' or said like '%twelve%' or said like '%2 no%' or said like '%Three flats%') as told, cast(case when said like '%4 flats' then 4 when said like '%twelve%' then 12 when said like '%2 no%' then 2 when said like '%Three flats%' then 3 end as int) units from {picked_sql([{'said': s} for s in S.SAID])}""")
def flats_of(spark, sf):
    u = names.units(F.col("said"))
    return picked(spark, sf, [{"said": s} for s in S.SAID]).select("id", u.isNotNull().alias("told"), u.alias("units"))


# --- dates, numbers, names

_ISO = "nullif(regexp_extract(trim(d), '^\\d{4}-\\d{2}-\\d{2}'), '')"
_DMY = "try_strptime(regexp_replace(nullif(regexp_extract(trim(d), '^\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{4}'), ''), '[.-]', '/', 'g'), '%d/%m/%Y')"


@query(f"select id, coalesce({_ISO}, strftime({_DMY}, '%Y-%m-%d'), nullif(regexp_extract(trim(d), '^\\d{{4}}$'), '')) as dated from {picked_sql([{'d': d} for d in S.DATES])}")
def register_dates(spark, sf):
    return picked(spark, sf, [{"d": d} for d in S.DATES]).select("id", names.dated(F.col("d")).alias("dated"))


@query(f"select id, coalesce(try_cast(replace(n, ',', '') as double), 0) as number, greatest(0, least(100, cast(coalesce(try_cast(replace(n, ',', '') as double), 0) as int))) as clamped from {picked_sql([{'n': n} for n in S.NUMBERS])}")
def register_numbers(spark, sf):
    n = names.number(F.col("n"))
    return picked(spark, sf, [{"n": n} for n in S.NUMBERS]).select("id", n.alias("number"), names.clamped(n.cast("int")).alias("clamped"))


_LATEST = "(values ('built', strftime(date '2020-01-01' + (id % 900)::int, '%Y-%m-%d'), 0), ('listed', (2019 + id % 9)::varchar, 1), ('edited', case when id % 4 > 0 then strftime(date '2025-01-01' + (id % 700)::int, '%Y-%m-%d') end, 2)) v(w, x, i)"


@query(f"""with a as (select p_partkey as id from part), d as (select id, w, x, i from a, lateral (select * from {_LATEST}) where x is not null and case when len(x) > 4 then x else x || '-01-01' end <= '{AS_OF}')
 select id, x as reported, w as reported_as from (select *, row_number() over (partition by id order by x || case when len(x) = 4 then '-12-31' else '' end desc, i) r from d) where r = 1""")
def latest_dates(spark, sf):
    k = F.col("p_partkey")
    dates = judges.dates_of(("built", F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int"))), ("listed", 2019 + k % 9), ("edited", F.when(k % 4 > 0, F.date_add(F.lit("2025-01-01").cast("date"), (k % 700).cast("int")))))
    rows = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), names.latest_date(dates, F.lit(AS_OF)).alias("l"))
    return rows.where("l is not null").select("id", F.col("l.when").alias("reported"), F.col("l.what").alias("reported_as"))


@query(f"""with a as (select p_partkey as id from part), d as (select id, case when len(x) = 4 then least(x || '-12-31', '{AS_OF}') else x end as dd from a, lateral (select * from {_LATEST}) where x is not null),
 m as (select id, max(dd) filter (dd <= '{AS_OF}') as any_day from d group by id), v as (select *, case when id % 3 = 0 then strftime(date '2025-06-01' + (id % 400)::int, '%Y-%m-%d') end visited from m)
 select id, any_day, case when visited <= '{AS_OF}' then greatest(any_day, visited) else any_day end as all_day from v""")
def days_of_sites(spark, sf):
    k = F.col("p_partkey")
    dates = judges.dates_of(("built", F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int"))), ("listed", 2019 + k % 9), ("edited", F.when(k % 4 > 0, F.date_add(F.lit("2025-01-01").cast("date"), (k % 700).cast("int")))))
    visited = F.when(k % 3 == 0, F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), (k % 400).cast("int")), "yyyy-MM-dd"))
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), names.site_dates(dates, visited, F.lit(AS_OF)).alias("d")).select("id", F.col("d.any").alias("any_day"), F.col("d.all").alias("all_day"))


_NAME_VIEW = picked_sql([{"nm": n} for n in S.NAMES])
_WORDS = "list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda w: not regexp_full_match(w, '[ivx]+|\\d+'))"
_KINDS_L, _COMMON_L = listed(V.COMPLEX_KINDS), listed(V.COMPLEX_KINDS + V.COMPLEX_PARTS)


@query(f"""select id, array_to_string({_WORDS.format(x='nm')}, ' ') as words, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(nm, ','), lambda p: case when len(list_filter({_WORDS.format(x='p')}, lambda w: w in {_KINDS_L})) > 0 and len(list_filter({_WORDS.format(x='p')}, lambda w: w not in {_COMMON_L})) > 0 then array_to_string({_WORDS.format(x='p')}, ' ') end), lambda x: x is not null))), '|') as complexes,
 case when len(string_split(nm, ',')) = 2 and regexp_matches(trim(split_part(nm, ',', 1)), '(?i)\\s+(?:[ivx]+|\\d+)$') then array_to_string({_WORDS.format(x="split_part(nm, ',', 1)")}, ' ') || '|' || array_to_string({_WORDS.format(x="split_part(nm, ',', 2)")}, ' ') end as numbered,
 len(list_filter(regexp_extract_all(lower(nm), '[a-z'']+'), lambda w: len(w) > 3 and w in ('wilton', 'royal', 'carpet', 'factory', 'minera'))) > 0 as alike from {_NAME_VIEW}""")
def name_words(spark, sf):
    n = F.col("nm")
    return picked(spark, sf, [{"nm": x} for x in S.NAMES]).select("id", F.array_join(names.words(n), " ").alias("words"), F.array_join(F.array_sort(names.complex_parts(n)), "|").alias("complexes"), names.numbered(n).alias("numbered"), names.share_a_name(n, F.lit("Wilton Royal Carpet Factory Museum, Minera")).alias("alike"))


@query(f"""select id, coalesce(nullif(trim(regexp_replace(nm, '(?i)\\s*(?:[(\\[]\\s*(?:disused|derelict|abandoned|closed|ruined?|ruins)\\s*[)\\]]|[-–,]\\s*(?:disused|derelict|abandoned)\\s*$)', '', 'g')), ''), nm) as shown,
 case when {has('nm', r'\babandoned\b')} then 'abandoned' when {has('nm', r'\bderelict\b')} then 'derelict' when {has('nm', r'\bdisused\b')} then 'disused' when {has('nm', r'\bdefunct\b')} then 'defunct' when {has('nm', r'\bruin\b')} then 'ruin' when {has('nm', r'\bruins\b')} then 'ruins' when {has('nm', r'\bformer\b')} then 'former' when {has('nm', r'\bclosed down\b')} then 'closed down' end as dead,
 case when {has('nm', r'\basylum\b')} then 'asylum' when {has('nm', r'\bmill\b')} then 'mill' when {has('nm', r'\bfactory\b')} then 'factory' when {has('nm', r'\btheatre\b')} then 'theatre' when {has('nm', r'\bquarry\b')} then 'quarry' when {has('nm', r'\bmine\b')} then 'mine' end as explorable from {_NAME_VIEW}""")
def shown_names(spark, sf):
    n = F.col("nm")
    return picked(spark, sf, [{"nm": x} for x in S.NAMES]).select("id", names.shown_name(n).alias("shown"), names.listed_word(n, V.DEAD_NAME_WORDS).alias("dead"), names.listed_word(n, V.EXPLORABLE_WORDS).alias("explorable"))


TIDY = {
    "LOCH OF BRECK, NORSE MILL": "Norse Mill, Loch of Breck", "ROC POST NO. IV, COWES": "ROC Post No. IV, Cowes", "Coetgae, Abertillery, Former Opencast Mine": "Former Opencast Mine, Abertillery", "Manod Granite Quarries, Track II": "Track II, Manod Granite Quarries",
    "Minera Lead Mine, Taylor's Shaft": "Minera Lead Mine, Taylor's Shaft", "THE HALL OF ST ANN'S": "The Hall of St Ann's", "Ruin [Disused], Hill": "Ruin, Hill",
}


@query("select id, coalesce(t.y, case when nm = 'Quarry II, Bwlch y Bi' then 'Quarry II, Bwlch y Bi' else nm end) as tidy from " + _NAME_VIEW + " left join (values " + ", ".join(f"({q1(k)}, {q1(v)})" for k, v in TIDY.items()) + ") t(x, y) on t.x = nm")
def tidy_names(spark, sf):
    """Register names with the thing first; what each must read as stands in the oracle as a table."""
    shouted = F.col("nm").rlike(r"\p{Lu}") & ~F.col("nm").rlike(r"\p{Ll}")
    return picked(spark, sf, [{"nm": x} for x in S.NAMES]).select("id", F.when(shouted, names.tidy_name(F.col("nm"), True)).otherwise(names.tidy_name(F.col("nm"))).alias("tidy"))
