"""Made-up records that reach every branch of the judges, dealt over the rows of `part`; the same in SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans.views import table


def picked(spark: SparkSession, sf_dir: str, rows: list[dict]) -> DataFrame:
    """part's key as id and name as pname, with the fields of one of the rows for each."""
    k = F.col("p_partkey")
    of = lambda f: F.get(F.array(*[F.lit(r.get(f)) for r in rows]), (k % len(rows)).cast("int")).alias(f)
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("pname"), *[of(f) for f in fields(rows)])


def fields(rows: list[dict]) -> list[str]:
    return list(dict.fromkeys(f for r in rows for f in r))


def sql_value(x) -> str:
    return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x!r}::double" if isinstance(x, float) else str(x)


def picked_sql(rows: list[dict]) -> str:
    of = ", ".join(f"([{', '.join(sql_value(r.get(f)) for r in rows)}])[1 + p_partkey % {len(rows)}] as {f}" for f in fields(rows))
    return f"(select p_partkey as id, p_name as pname, {of} from part)"


# features: element, and tags as key=value between vertical bars
TAGS = [
    "building=ruins|name=Old Hall", "building=ruins|historic=castle|name=Keep", "building=yes|ruins=yes", "ruins=yes|tourism=attraction", "abandoned=yes|name=Depot", "abandoned:amenity=hospital|name=St Mary",
    "abandoned:railway=rail", "abandoned:railway=rail|tunnel=yes", "abandoned:building=house|operator=National Trust", "railway=disused|tunnel=yes", "railway=abandoned|tunnel=no", "name=Derelict Mill|building=industrial",
    "description=A boarded up shop|shop=yes", "note=now Ruined|name=Tower", "disused=yes", "disused:shop=clothes", "disused:amenity=pub|name=The Bear", "disused:railway=station", "disused:railway=rail", "disused:railway=rail|tunnel=culvert",
    "disused:website=x", "man_made=adit", "historic=mine_shaft|man_made=mineshaft|mineshaft_type=air", "historic=quarry", "military=bunker|bunker_type=pillbox", "historic=pillbox", "building=bunker|historic=", "historic=railway_station",
    "natural=cave_entrance", "historic=ruins", "landuse=brownfield", "amenity=telephone|disused=yes", "disused:amenity=post_box", "building=house", "demolished:building=house", "razed=no", "landuse=construction", "tourism=museum|name=Mill Museum",
    "railway=station|usage=tourism", "railway=halt|railway:preserved=yes", "operator=English Heritage", "building=construction", "abandoned:man_made=pipeline", "abandoned:highway=road|disused:shop=yes", "disused:man_made=mineshaft",
    "historic=mine_adit", "abandoned:building=ruins|fee=yes", "alt_name=Bethel Quarry;Gripwood|old_name=Bethel Quarry|name=Gripwood", "was:name=Works|disused:craft=yes", "tourism=zoo|abandoned=no", "highway=footway|name=Abandoned Lane",
]
FEATURES = [{"element": ("node", "way", "relation")[i % 3], "tagged": t} for i, t in enumerate(TAGS)] + [{"element": "node", "tagged": t} for t in TAGS[15:21]]

# items: types and states between vertical bars
ITEMS = [
    {"label": "Box Mine", "types": "mine", "states": "", "ended": None}, {"label": "Wall of Bath", "types": "wall|bridge", "states": "", "ended": None}, {"label": "Old town", "types": "village", "states": "", "ended": None},
    {"label": "Foo Halt", "types": "railway station", "states": "closed down", "ended": None}, {"label": "Foo Station", "types": "railway station|protected area", "states": "abandoned", "ended": "1966-03-07"},
    {"label": "Ash House", "types": "house|manor", "states": "derelict", "ended": None}, {"label": "Elm House", "types": "", "states": "ruined", "ended": None}, {"label": "Gas Works", "types": "gasworks", "states": "demolished", "ended": None},
    {"label": "Air-raid shelter, Dover", "types": "structure", "states": "", "ended": None}, {"label": "Ivy Hospital", "types": "hospital", "states": "", "ended": "1994-01-01"}, {"label": "Former chapel", "types": "building", "states": "", "ended": None},
    {"label": "Sodbury Tunnel", "types": "tunnel", "states": "", "ended": None}, {"label": "Albion", "types": "brewery", "states": "", "ended": None}, {"label": "Camp 9", "types": "army camp", "states": "in use", "ended": None},
    {"label": "Camp 10", "types": "army camp", "states": "", "ended": None}, {"label": "Plain thing", "types": "thing", "states": "", "ended": None}, {"label": "Cwm Quarries", "types": "slate quarry|museum", "states": "", "ended": None},
    {"label": "The Caves", "types": "protected area", "states": "", "ended": None}, {"label": "Steam line", "types": "heritage railway|tunnel", "states": "mothballed", "ended": None}, {"label": "Gallery Pit", "types": "art gallery|coal mine", "states": "", "ended": None},
]

# records: what a register says a place is, and its name
RECORDS = [
    {"site_type": "FARMSTEAD (18TH CENTURY), OBSERVATION POST (20TH CENTURY)", "name": "ACKERGILL, QUADRANT OBSERVATION TOWER"}, {"site_type": "MILL (SITE OF)", "name": "LOCH OF BRECK, NORSE MILL"}, {"site_type": "Quarry; Mill", "name": "Ruin of the Quarry"},
    {"site_type": "Castle", "name": "Former Castle [Disused]"}, {"site_type": "Tunnel", "name": "Tunnel, demolished 1960"}, {"site_type": "Pillbox", "name": "RAF HQ PILLBOX NO. II, COWES"}, {"site_type": "Lime Kiln", "name": "Coetgae, Abertillery, Former Opencast Mine"},
    {"site_type": "Airfield hangar", "name": "Sopley"}, {"site_type": "Workhouse", "name": "UNION OF THE SOUTH"}, {"site_type": "Garden", "name": "Rose"}, {"site_type": "brewery", "name": "Victoria's Brewery"}, {"site_type": "Viaduct, Signal Box", "name": "Nothing now remains"},
    {"site_type": None, "name": "No type"}, {"site_type": "Folly", "name": None},
]
BROWNFIELD = [
    {"site_address": "22 High Street, Bath", "notes": "Former depot"}, {"site_address": "", "notes": "Now built"}, {"site_address": None, "notes": None}, {"site_address": " Old Yard ", "notes": "Development FINISHED"}, {"site_address": "Mill Lane", "notes": "  "},
]
SCHOOLS = [
    {"type": "Community school", "phase": "Primary", "reason": "Closure", "close_date": "31-08-2022"}, {"type": "Welsh establishment", "phase": "Primary", "reason": "Closure", "close_date": "31-08-2022"},
    {"type": "Special school", "phase": "", "reason": "Result of Amalgamation/Merger", "close_date": "01-09-2012"}, {"type": "Free school", "phase": "Nursery", "reason": "Fresh Start", "close_date": "01-01-1900"},
    {"type": "Pupil referral unit", "phase": None, "reason": "", "close_date": "20-07-1998"}, {"type": "Academy", "phase": "Secondary", "reason": "Academy Converter", "close_date": "20-07-2020"}, {"type": "Community school", "phase": "Primary", "reason": "Closure", "close_date": "32-07-2020"},
    {"type": "Community school", "phase": "Primary", "reason": None, "close_date": None},
]
LAND = [
    {"site_type": "Vacant Land", "use": "Defence", "since": "1981"}, {"site_type": "Vacant Land and Buildings", "use": "Education", "since": "Unknown"}, {"site_type": "Derelict", "use": "Mineral Activity", "since": "2001-2005"},
    {"site_type": "Derelict", "use": "Unknown", "since": ""}, {"site_type": "Buildings", "use": "Other", "since": None}, {"site_type": "Derelict", "use": "Residential - Hotels, Hostels etc", "since": "1999"},
]
CARE = [
    {"home": True, "beds": 45, "category": "Residential social care", "centre": "", "name": "The Elms", "ended": "2022-05-01"}, {"home": True, "beds": 20, "category": "Nursing", "centre": "", "name": "Oak", "ended": "2016-05-01"},
    {"home": False, "beds": 0, "category": "Hospital", "centre": "", "name": "St John", "ended": "2010-01-01"}, {"home": False, "beds": 0, "category": "Hospice services", "centre": "", "name": "Ivy", "ended": "2018-01-01"},
    {"home": False, "beds": 0, "category": "x", "centre": "Five Ways Day Centre", "name": "Agency", "ended": "2023-01-01"}, {"home": False, "beds": 0, "category": "x", "centre": "Elm Day Centre", "name": "Agency", "ended": "2013-01-01"},
    {"home": False, "beds": 0, "category": "x", "centre": "Ash Day Centre", "name": "Agency", "ended": "2009-01-01"}, {"home": False, "beds": 0, "category": "x", "centre": "Fir Day Centre", "name": "Agency", "ended": "2017-01-01"},
    {"home": True, "beds": 30, "category": "Residential", "centre": "", "name": "Nursing at Low", "ended": "2011-03-01"},
]
ESTATES = [
    {"name": "OLD INFIRMARY", "trust": "NORTH TRUST", "whole": True, "unoccupied_m2": 5400.0, "empty_m2": 0.0, "floor_m2": 5400.0, "pre_1948": 80.0}, {"name": "Annexe", "trust": "T", "whole": True, "unoccupied_m2": 0.0, "empty_m2": 0.0, "floor_m2": 1234.7, "pre_1948": 10.0},
    {"name": "Other Reportable Sites", "trust": "SOUTH TRUST", "whole": True, "unoccupied_m2": 0.0, "empty_m2": 0.0, "floor_m2": 0.0, "pre_1948": 0.0}, {"name": "Ward Block", "trust": "T", "whole": False, "unoccupied_m2": 0.0, "empty_m2": 6000.0, "floor_m2": 9000.0, "pre_1948": 90.0},
]
RAILWAY = [
    {"name": "", "kind": "tunnel", "line": "Bath Branch", "path": ""}, {"name": "Combe Down", "kind": "tunnel", "line": "", "path": "Sustrans"}, {"name": None, "kind": "viaduct", "line": None, "path": None}, {"name": "Low", "kind": "viaduct", "line": "North", "path": "Railway Path"},
]
DISPOSALS = [
    {"establishment": "ST GEORGE'S BARRACKS", "parcel": "VARIOUS PARCELS", "status": "Planning", "year": "2020"}, {"establishment": "RAF Sopley", "parcel": "Married Quarters", "status": "", "year": "2031"}, {"establishment": "Dover", "parcel": "ACF hut", "status": None, "year": "2019"},
    {"establishment": "Catterick", "parcel": "Catterick Camp", "status": "Sold", "year": "TBC"}, {"establishment": "Fort Monckton", "parcel": "", "status": "x", "year": None}, {"establishment": "Place", "parcel": "School", "status": "x", "year": "2026"},
]
LABELS = [
    {"final_text": "Butserhill Lime Works", "air_shafts": None}, {"final_text": "Corn Mill (Disused)", "air_shafts": None}, {"final_text": "Old  Brewery", "air_shafts": None}, {"final_text": "Kiln Lane", "air_shafts": None}, {"final_text": "Mill", "air_shafts": None},
    {"final_text": "Engine House (Pumping)", "air_shafts": None}, {"final_text": "Castle (in Ruins)", "air_shafts": None}, {"final_text": "Quarry", "air_shafts": 3}, {"final_text": "Bethel Quarries", "air_shafts": 1}, {"final_text": "old chapel", "air_shafts": None},
    {"final_text": "Brick & Tile Works", "air_shafts": None}, {"final_text": "Ruin of St Ann", "air_shafts": None}, {"final_text": "Old Level", "air_shafts": None}, {"final_text": "Chimney", "air_shafts": None}, {"final_text": "Old Colliery Row", "air_shafts": None},
]
NOTICES = [
    {"property": "Ebridge Mill, Happisburgh Road, NR28 9QA", "interest": "Freehold", "company": "EBRIDGE LIMITED", "title": "NK1234", "dissolved": "2019-03-04"}, {"property": "12 Church Street, Bath", "interest": "Freehold", "company": "A LTD", "title": None, "dissolved": None},
    {"property": "The Old Chapel, Chapel Street", "interest": "Leasehold", "company": "", "title": None, "dissolved": "2020-01-02"}, {"property": "Flat 2, Mill House", "interest": "Freehold", "company": "B Ltd", "title": None, "dissolved": None},
    {"property": "Parking space at Town Hall", "interest": "Freehold", "company": "C Ltd", "title": None, "dissolved": None}, {"property": "26 Swainby Road, Trimdon Station", "interest": "Freehold", "company": "D Ltd", "title": None, "dissolved": None},
    {"property": "Red Lion Public House, High Street", "interest": "Freehold", "company": "E Pubs", "title": "X1", "dissolved": "2018-05-06"}, {"property": None, "interest": None, "company": None, "title": None, "dissolved": None},
]
PLACES = [
    {"name": "Pillbox 9", "kind": "", "note": "by the river"}, {"name": "", "kind": "cave entrance", "note": ""}, {"name": "Low Mill", "kind": "mill", "note": "demolished 1970"}, {"name": "Somewhere", "kind": "", "note": ""}, {"name": "Hut", "kind": "", "note": "Remains of an airfield"},
]
APPLICATIONS = [
    "Demolition of derelict public house and erection of 9 flats", "Demolition of existing garage", "Demolition of the former school", "Renovation of dilapidated barn", "Works to abandoned windows", "Conversion of fire-damaged mill to flats", "Discharge of condition 8: demolition of disused bus depot",
    "Certificate of lawful use of derelict yard", "The dwelling is uninhabitable and needs repair", "Uninhabitable loft space", "Siting of a caravan whilst the house is renovated", "Caravan at holiday park during refurbishment", "Completion of part-built dwelling", "Completion of unfinished building", "The house was never occupied",
    "Fell a tree by derelict wall", "Pre-application advice on an uninhabited cottage", "New porch", "Demolition of dangerous structure", "Reuse of ruinous chapel", "Demolish uninhabitable house and outbuildings",
]
NAMES = [
    "Dive Test Facility (Disused)", "LOCH OF BRECK, NORSE MILL", "ROC POST NO. IV, COWES", "Coetgae, Abertillery, Former Opencast Mine", "Manod Granite Quarries, Track II", "Quarry II, Bwlch y Bi", "Disused Quarry", "Wilton Royal Carpet Factory", "The Bear", "Old Mill - derelict", "Closed Down Theatre",
    "Minera Lead Mine, Taylor's Shaft", "Asylum (closed)", "Unnamed structure", "THE HALL OF ST ANN'S", "Ruin [Disused], Hill",
]
INTROS = [
    "It is a mine. It was demolished in 1970. Now gone.", "The disused mine lies near Bath. It is now a museum.", "It is still in use today.", "A working quarry! It was a quarry once.", "It was converted to flats in 1990.", "Nothing special is told here.", "It fell into disuse. The line reopened later?", None, "",
]
DATES = ["2024-06-28", "28/06/2024", "28.06.2024", "28-06-2024 10:00", "1998", "31/02/2020", "June 2024", "", None, " 1/2/2003 ", "2024-06-28T10:00:00Z", "99"]
NUMBERS = ["1,234", "12.5", "x", "", None, "-3", "1,234,567.25"]
SAID = [
    "Conversion into 4 flats", "Change into twelve self-contained dwellings", "into 2 no. units", "into a house", "Split into Three flats and 5 homes", "nothing",
]
