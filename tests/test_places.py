"""The library's queries beside SQL on the smallest tables, and golden facts."""

import math
import random
from datetime import date, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, judges, names, text
from waymark.functions import vocabulary as V
from waymark.operators import resolve, sites
from waymark.plans import judge_queries, queries, register_queries  # noqa: F401
from waymark.sources import files
from waymark.streaming import reports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", [*queries.SQL])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(queries.SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns and got
    assert got == sorted((tuple(r[found.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_grid_refs(spark):
    rows = [("SN693694",), ("HT 97429 38889",), ("tq 30 80",), ("NY 12 34",), ("XX",), ("S1",), ("ZZ12",), ("AA12",), ("HT 97429 388",), (None,)]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame(rows, "r string").select(geo.grid_ref_metres(F.col("r"))).collect()]
    assert got == [(269350.0, 269450.0), (397429.5, 1138889.5), (530500.0, 180500.0), (312500.0, 534500.0), *[None] * 6]


def test_british_grid(spark):
    rows = [("SU 1431 3007", 51.069824, -1.797089), ("NN 1667 7128", 56.79685, -5.00360)]
    out = geo.to_grid(spark.createDataFrame(rows, "want string, lat double, lng double")).select("*", geo.grid_ref(F.col("easting"), F.col("northing")).alias("ref")).collect()
    assert [r.ref for r in out] == [r.want for r in out]
    assert abs(out[0].easting - 414313) < 3 and abs(out[0].northing - 130075) < 3
    back = geo.from_grid(spark.createDataFrame([(r.lat, r.lng, r.easting, r.northing) for r in out], "a double, b double, easting double, northing double")).collect()
    assert all(abs(r.lat - r.a) < 2e-6 and abs(r.lng - r.b) < 2e-6 for r in back)
    assert spark.range(1).select(geo.grid_ref(F.lit(-5.0), F.lit(100.0))).first()[0] is None
    assert spark.range(1).select(geo.grid_ref(F.lit(414313.0), F.lit(130075.0), 3)).first()[0] == "SU 143 300"


def test_nations(spark):
    rows = [(51.35, -2.25, "england"), (55.95, -3.19, "scotland"), (51.5, -3.5, "wales"), (54.6, -5.93, "northern_ireland"), (54.2, -4.5, None), (49.2, -2.1, None)]
    df = spark.createDataFrame(rows, "lat double, lng double, want string")
    assert all(r.got == r.want for r in df.select("want", geo.nation(F.col("lat"), F.col("lng")).alias("got")).collect())


def test_offset_and_mercator(spark):
    import inspect

    lat, lng = spark.range(1).select(*geo.web_mercator(F.lit(128.0), F.lit(128.0), 0)).first()
    assert abs(lat) < 1e-9 and abs(lng) < 1e-9
    assert inspect.isfunction(geo.offset)


def test_photos_that_face_away_come_last(spark):
    from waymark.operators import registers

    rows = [("a", 52.0, -1.0005, 270.0), ("b", 52.0, -1.0006, 90.0), ("c", 52.0, -1.0007, None), ("far", 52.1, -1.0, 180.0)]
    got = registers.photos_of(spark.createDataFrame(rows, "key string, lat double, lng double, azimuth double"), 52.0, -1.0, 80).collect()
    assert [r.key for r in got] == ["b", "c", "a"]


def test_conditions_and_days(spark):
    cases = [
        ("Closed in 2019, now derelict", "Abandoned"), ("closed in 2019", "Closed 2019"), ("ruinous", "Ruin"), ("abandoned ruin", "Ruin"), ("Enclosed yard", None), ("Stand empty now", "Empty"), ("Never been occupied", "Empty"), ("A part built block", "Unfinished"),
        ("Unfit for human habitation", "Empty"), ("Underground quarries", "Underground"), ("surplus", "Disused"), ("surpluses", None), ("a ROC post", "Old military"), ("a croc post", None), ("nothing", None), (None, None),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r[0] for r in df.select(text.condition(F.col("t"))).collect()] == [w for _, w in cases]
    days = [("2024-03-05T10:00", "2024-03-05"), ("5/3/2024", "2024-03-05"), ("28.06.2024", "2024-06-28"), ("28-06-2024", "2024-06-28"), ("28/06/2024 10:00", "2024-06-28"), ("1998", "1998"), ("31/02/2020", None), ("soon", None), (None, None)]
    df = spark.createDataFrame(days, "t string, want string")
    assert [r[0] for r in df.select(text.day(F.col("t"))).collect()] == [w for _, w in days]
    assert spark.range(1).select(names.dated_ms(F.lit(1719532800000))).first()[0] == "2024-06-28"
    assert spark.sql("select 1").select(text.html_text(F.lit("<p>a&amp;b<script>x</script> <b>c</b></p>"))).first()[0] == "a&b c"


def test_intros(spark):
    cases = [
        ("It opened in 1900. The mill was demolished in 1970.", -999, "The mill was demolished in 1970."), ("A disused mine. It is near Bath.", 15, "A disused mine."), ("The site is still in use.", -20, "The site is still in use."),
        ("A derelict chapel; it was converted to flats.", 0, "A derelict chapel; it was converted to flats."), ("Plain.", 0, None),
    ]
    out = spark.createDataFrame(cases, "t string, d int, s string").select("d", "s", judges.judge_intro(F.col("t")).alias("j")).collect()
    assert all((r.j.delta, r.j.snippet) == (r.d, r.s) for r in out)


def test_tidied_names_and_titles(spark):
    shout = [("LOCH OF BRECK, NORSE MILL", "Norse Mill, Loch of Breck"), ("CAFÉ, VICTORIA’S MILL", "Victoria’s Mill, Café"), ("RAF POST III", "RAF Post III"), (None, "")]
    out = spark.createDataFrame(shout, "t string, w string").select("w", names.tidy_name(F.col("t"), True).alias("g")).collect()
    assert all(r.g == r.w for r in out), out
    assert spark.range(1).select(names.title(F.lit("ST GEORGE'S BARRACKS")), names.title(F.lit("Abc DEF"))).first()[:] == ("St George's Barracks", "Abc DEF")
    starts = [(["Gripwood Quarry Main Entrance", "Gripwood quarry Entrance 1"], "Gripwood Quarry"), (["A B", "A B C"], "A B"), (["X"], "X"), (["P", "Q"], "")]
    out = spark.createDataFrame(starts, "n array<string>, w string").select("w", names.common_start(F.col("n")).alias("g")).collect()
    assert all(r.g == r.w for r in out), out
    long = "x" * 100 + " the long empty and derelict barn " + "y" * 200
    at = long.index("derelict")
    assert spark.range(1).select(names.excerpt(F.lit(long), "derelict")).first()[0] == long[:160] + "…" and at + 8 <= 140
    long = "x" * 40 + long
    assert spark.range(1).select(names.excerpt(F.lit(long), "derelict")).first()[0] == "…" + long[at - 20 : at + 140] + "…"


def test_notices(spark):
    said = (
        "NOTICE OF DISCLAIMER Company Name: EBRIDGE LIMITED Company Number: 01234567 Title number: NK12345 Interest: Freehold Property: The Property situated at Ebridge Mill, Happisburgh Road NR28 9QA being the land comprised in the above title "
        "Dissolution Date: 4 March 2019 1. In this notice ... Signed 3 February 2021"
    )
    p = spark.range(1).select(judges.parse_notice(F.lit(said)).alias("p")).first().p
    assert (p.company, p.number, p.interest, p.title, p.property, p.postcode) == ("EBRIDGE LIMITED", "01234567", "Freehold", "NK12345", "Ebridge Mill, Happisburgh Road NR28 9QA", "NR28 9QA")
    assert (p.dissolved, p.signed) == (date(2019, 3, 4), date(2021, 2, 3))
    assert spark.range(1).select(judges.parse_notice(F.lit("nothing"))).first()[0] is None


def test_planning_later_applications(spark):
    later = [("Demolish the existing house", date(2021, 5, 1), date(2021, 9, 1), "Permitted", "21/1"), ("New porch", date(2022, 1, 1), None, "Undecided", "22/1")]
    rows = [("C/19/1", "3 Mill Lane, Bath, BA1 1AA", "The dwelling is uninhabitable", "Permitted", date(2019, 1, 1), date(2019, 3, 1), later), ("C/19/2", "4 Mill Lane", "The dwelling is uninhabitable", "Permitted", date(2019, 1, 1), date(2019, 3, 1), [])]
    schema = "name string, address string, description string, app_state string, start_date date, decided_date date, later array<struct<said:string,started:date,decided:date,state:string,ref:string>>"
    a, b = judges.planning(spark.createDataFrame(rows, schema), F.lit("2026-01-10").cast("date")).orderBy("name").collect()
    assert (a.weight, a.kind, a.place) == (12, "house", "3 Mill Lane, Bath") and "then, in 2021, another application here (21/1, approved on 2021-09-01)" in a.evidence and a.evidence.endswith("never finished, and it may since have gone")
    assert b.weight == 5 and "so the work may well be done" in b.evidence


def test_empty_crawl_takes_nothing_as_gone(spark):
    store = spark.createDataFrame([(1, "a", "2020", datetime(2024, 1, 1), datetime(2024, 1, 1), None)], "k long, nm string, edited string, first_seen timestamp_ntz, last_seen timestamp_ntz, gone_at timestamp_ntz")
    none = store.select("k", "nm", "edited").limit(0)
    assert sites.apply_snapshot(store, none, "k", ["nm", "edited"], "2024-02-01 00:00:00").first().gone_at is None
    seen = spark.createDataFrame([(1, "b", None), (2, "c", None)], "k long, nm string, edited string")
    out = {r.k: r for r in sites.apply_snapshot(store, seen, "k", ["nm", "edited"], "2024-02-01 00:00:00", keep=["edited"]).collect()}
    assert (out[1].nm, out[1].edited, out[1].gone_at, out[2].edited) == ("b", "2020", None, None)
    other = sites.apply_snapshot(store, seen.where("k = 2"), "k", ["nm", "edited"], "2024-02-01 00:00:00")
    assert other.where("k = 1").first().gone_at == datetime(2024, 2, 1)
    assert sites.apply_snapshot(store, seen.where("k = 2"), "k", ["nm", "edited"], "2024-02-01 00:00:00", incremental=True).where("k = 1").first().gone_at is None


def test_due_sources(spark):
    crawls = [("a", 1, datetime(2024, 1, 1), "done"), ("b", 2, datetime(2024, 1, 9), "done"), ("c", 3, datetime(2024, 1, 9, 23, 30), "failed"), ("d", 4, datetime(2024, 1, 9, 20), "failed"), ("e", 5, datetime(2024, 1, 9, 23), "paused"), ("f", 6, datetime(2023, 12, 20), "done"), ("a", 0, datetime(2023, 1, 1), "failed")]
    df = spark.createDataFrame(crawls, "source string, id long, started_at timestamp_ntz, status string")
    got = {r.source for r in sites.due(df, {k: None for k in "abcdeg"} | {"f": 30}, "2024-01-10 00:00:00").collect()}
    assert got == {"a", "d", "e", "g"}


def test_map_modes(spark):
    rows = [(f"s{i}", f"n{i}", 50.5 + 0.7 * (i // 5) + 0.0001 * i, 0.4 * (i % 5 == 4), 30 + i % 3, "good", ("mill", "mine")[i % 2]) for i in range(23)]
    df = spark.createDataFrame(rows, "key string, name string, lat double, lng double, score int, strength string, category string").withColumn("aliases", F.array().cast("array<string>"))
    view = sites.Filters(bbox=(-1.0, 50.0, 1.0, 55.0))
    mode, found = sites.map_view(df, view, 8)
    assert mode == "sites" and found.count() == 23
    mode, found = sites.map_view(df, view, 8, few=10)
    got = found.collect()
    assert mode == "clusters" and sum(r.n for r in got) == 23 and {r.own_name for r in got if r.n == 1} == {r.site.replace("s", "n") for r in got if r.n == 1}
    assert any(r.n > 1 for r in got) and all((r.site is None) == (r.n > 1) for r in got)


# --- resolution


ITEM = "family string, source string, id string, name string, kind string, evidence string, weight int, lat double, lng double, aliases array<string>, entrance string"


def as_items(spark, rows):
    df = spark.createDataFrame(rows, ITEM)
    prefix = F.when(F.col("family") == "wikidata", "wd").otherwise(F.col("source"))
    none = {"snippet": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "first_seen": F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), "dates": F.array().cast("array<struct<what:string,when:string>>")}
    return df.withColumns({"key": F.concat(prefix, F.lit(":"), "id"), **none})


def complexes(name):
    """({words of a part that names a complex: as spelt}, (what tells a numbered part's complex, its name) or None), letter by letter."""
    bare = lambda p: p.rsplit(" ", 1)[0].strip() if " " in p and (p.rsplit(" ", 1)[1].isdigit() or set(p.rsplit(" ", 1)[1].lower()) <= set("ivx")) else p
    ws = lambda p: [w for w in "".join(c if c.isalnum() or c == "'" else " " for c in p.lower()).split() if not (w.isdigit() or set(w) <= set("ivx"))]
    parts, out = [p.strip() for p in (name or "").split(",")], {}
    for p in parts:
        kinds = [w in V.COMPLEX_KINDS for w in ws(p)]
        if any(kinds) and any(not k and w not in V.COMPLEX_PARTS for k, w in zip(kinds, ws(p))):
            out.setdefault(" ".join(ws(p)), bare(p))
    several = len(parts) == 2 and bare(parts[0]) != parts[0]
    return out, ("|".join(" ".join(ws(p)) for p in parts), f"{bare(parts[0])}, {parts[1]}") if several else None


def one_by_one(rows):
    """The rules, applied to one record after the other."""
    order = {"osm": 0, "wikidata": 1, "open": 2}
    cell = lambda r: (math.floor(r["lat"] / 0.002), math.floor(r["lng"] / 0.002))
    found, out = [], {}
    for r in sorted(rows, key=lambda r: (order[r["family"]], -r["weight"] if r["family"] == "osm" else 0, r["source"], r["id"])):
        cy, cx = cell(r)
        key = ("wd" if r["family"] == "wikidata" else r["source"]) + ":" + r["id"]
        near = [p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in found if p["cell"] == (cy + i, cx + j)]
        far = lambda p: resolve.metres(r, p["at"])
        every = lambda p: {n for m in p["in"] for n in [m["name"], *m["aliases"]] if n} | ({p["name"]} - {None})
        joined = None
        if r["family"] == "osm":
            joined = next((p for p in near if far(p) <= 40 and (not r["name"] or not p["osm"] or r["name"] in every(p))), None)
            if joined and r["name"] and not joined["osm"]:
                joined["osm"] = joined["name"] = r["name"]
        else:
            if r["family"] == "open":
                mine, number = complexes(r["name"])
                best = 120.0
                for p in near:
                    if far(p) > best or any(m["family"] != "open" for m in p["in"]):
                        continue
                    theirs, other = complexes(p["name"])
                    both = sorted(set(mine) & set(theirs))
                    if both:
                        joined, whole, best = p, mine[both[0]], far(p)
                    elif number and other and number[0] == other[0]:
                        joined, whole, best = p, number[1], far(p)
                if joined:
                    joined["name"] = whole
            if not joined:
                top = 0.0
                for p in near:
                    d, kinds = far(p), [m["kind"] for m in p["in"]]
                    deep, mine_like = "underground quarry", lambda k: any(w in k for w in ("quarr", "mine", "adit", "shaft", "tunnel"))
                    if d > 80 or (r["kind"] == deep and not any(map(mine_like, kinds))) or (deep in kinds and not mine_like(r["kind"])):
                        continue
                    like = max((resolve.alike(a, b) for a in [r["name"], *r["aliases"]] if a for b in every(p)), default=0.0)
                    if (d <= 25 or like >= 0.6 or (d <= 60 and min(r["weight"], max(m["weight"] for m in p["in"])) < 20)) and like + 1 - d / 80 > top:
                        joined, top = p, like + 1 - d / 80
                if joined and joined["name"] is None and r["name"]:
                    joined["name"] = r["name"]
        if joined is None:
            joined = {"key": key, "at": r, "cell": (cy, cx), "name": r["name"], "osm": r["name"] if r["family"] == "osm" else None, "in": []}
            found.append(joined)
        joined["in"].append(r)
        out[key] = joined["key"]
    return out


@pytest.mark.parametrize("tile", [2, 5, 50])
def test_merge_is_the_one_by_one_merge(spark, tile):
    r = random.Random(tile)
    pool = ["Old Mill", "Old Mill Site", "St Ann's Church", "Quarry II, Bwlch", "Quarry III, Bwlch", "Manod Granite Quarries, Track", "Manod Granite Quarries", None, "Bethel Works"]
    rows = []
    for i in range(260):
        family = r.choice(["osm", "wikidata", "open", "open"])
        name = r.choice(pool) or ("X" if family != "osm" else None)
        rows.append((family, {"osm": "osm", "wikidata": "wikidata"}.get(family) or r.choice(["schools", "nhs"]), f"{i:04d}", name, r.choice(["mill", "quarry", "underground quarry", "church", "adit"]), "e", r.choice([10, 19, 22, 35]), 52 + r.random() * 0.012, -1 + r.random() * 0.02, r.choice([[], [], ["Bethel Quarry"]]), None))
    want = one_by_one([dict(zip([c.split()[0] for c in ITEM.split(", ")], x)) for x in rows])
    got = {x.key: x.place for x in resolve.places(as_items(spark, rows), tile).collect()}
    assert got == want and len(rows) > len(set(want.values())) + 40


def test_ways_in_join_their_place(spark):
    at = lambda n: 52 + n / 111_195
    rows = [
        ("open", "coflein", "1", "Gripwood Quarry", "quarry", "x", 22, at(0), -1.0, [], None), ("open", "imported", "2", "Gripwood Main Entrance", "way", "x", 20, at(300), -1.0, [], "Entrance"), ("osm", "osm", "3", None, "adit", "OSM: x", 25, at(-70), -1.0, [], "Adit"),
        ("osm", "osm", "4", "Hidden Swallet", "cave", "OSM: x", 15, at(3000), -1.0, [], "Cave entrance"), ("open", "imported", "5", "Hidden Swallet Two", "way", "x", 12, at(3200), -1.0, [], "Shaft"), ("osm", "osm", "6", None, "adit", "OSM: x", 25, at(9000), -1.0, [], "Adit"),
    ]
    out = {s.key: s for s in resolve.sites_of(as_items(spark, rows)).collect()}
    assert {k: {m.id for m in s.members} for k, s in out.items()} == {"coflein:1": {"1", "2", "3"}, "imported:5": {"4", "5"}, "osm:6": {"6"}}
    assert out["imported:5"].name == "Hidden Swallet" and out["coflein:1"].name == "Gripwood Quarry"
    ways = {r.key: [(w.name, w.kind) for w in r.w] for r in resolve.sites_of(as_items(spark, rows)).select("key", resolve.ways_in(F.col("members")).alias("w")).collect()}
    assert ways == {"coflein:1": [("Gripwood Main Entrance", "Entrance"), ("", "Adit")], "imported:5": [("Hidden Swallet", "Cave entrance"), ("Hidden Swallet Two", "Shaft")], "osm:6": []}


def test_agreed_names_and_aliases(spark):
    rows = [
        ("osm", "osm", "1", "Bethel Quarry", "quarry", "OSM: x", 25, 52.0, -1.0, ["Gripwood Quarry"], None), ("wikidata", "wikidata", "Q1", "Gripwood Quarry", "quarry", "Wikidata: x", 25, 52.0, -1.0, [], None), ("open", "coflein", "3", "Stone Pit", "quarry", "x", 25, 52.0, -1.0, [], None),
        ("open", "brownfield", "4", "22 High Street", "brownfield land", "x", 10, 53.0, -1.0, [], None), ("open", "heritage_at_risk", "5", "The Guildhall", "listed building", "x", 25, 53.0, -1.0, [], None),
    ]
    out = {s.key: s for s in resolve.agreed_names(resolve.sites_of(as_items(spark, rows))).withColumn("also", resolve.aliases(F.col("name"), F.col("members"))).collect()}
    assert out["osm:1"].name == "Gripwood Quarry" and out["osm:1"].also == ["Bethel Quarry", "Stone Pit"]
    assert out["brownfield:4"].name == "The Guildhall" and out["brownfield:4"].also == []


def test_scores_and_reasons(spark):
    rows = [
        ("osm", "osm", "1", "Ivy Hospital", "hospital", "OSM: disused:amenity=hospital", 25, 52.0, -1.0, [], None), ("osm", "osm", "2", None, "building", "OSM: building=ruins", 20, 52.0, -1.0, [], None), ("wikidata", "wikidata", "Q1", "Ivy Hospital", "hospital", "Wikidata: closed in 1994; Wikipedia describes it as disused", 35, 52.0, -1.0, [], None),
        ("open", "nhs_estates", "3", "Ivy Hospital", "hospital", "the whole site is unoccupied", 22, 52.0, -1.0, [], None), ("open", "coflein", "4", "Ivy", "institution", "Coflein records a hospital here", 12, 52.0, -1.0, [], None),
        ("osm", "osm", "9", "Former Mill", "mill", "OSM: abandoned=yes", 35, 53.0, -1.0, [], None),
    ]
    found = resolve.sites_of(as_items(spark, rows))
    museum = spark.createDataFrame([(53.0, -1.0, 50.0, "Museum", "Mill Museum", "OpenStreetMap"), (53.0, -1.0, 60.0, "Gallery", "Other", "OpenStreetMap")], "lat double, lng double, reach double, kind string, name string, source string")
    out = {s.key: s for s in resolve.with_scores(resolve.covered(resolve.covered(found, museum, "in_use"), museum.limit(0), "gone")).collect()}
    a, b = out["osm:1"], out["osm:9"]
    assert a.score == 25 + 35 // 2 + 22 // 2 + 10 + 10 and (a.strength, a.category, a.condition, a.sources) == ("strong", "institutional", "Closed 1994", "osm+wikidata+coflein+nhs_estates")
    assert a.reasons == [
        "OpenStreetMap lists it as a disused hospital", "1 more OpenStreetMap feature here agree", "Wikidata says it closed in 1994", "Wikipedia describes it as disused", "the whole site is unoccupied", "Also recorded by Coflein (Wales)",
    ]
    assert (b.score, b.strength, b.condition) == (19, "weak", "Gallery") or (b.score, b.condition) == (19, "Museum")
    assert b.reasons[1:] == ["OpenStreetMap tags it as abandoned", "Its name says 'former'"] and b.reasons[0].startswith("OpenStreetMap maps ")


def test_covers(spark):
    at = lambda n: 52 + n / 111_195
    by = spark.createDataFrame([(52.0, -1.0, None, "Museum", "Wilton Factory Museum", "OpenStreetMap"), (53.0, -1.0, 300.0, "Zoo", "Zoo", "OpenStreetMap")], "lat double, lng double, reach double, kind string, name string, source string")
    cases = [("a", "The Bear", at(10), True), ("b", "The Bear", at(30), False), ("c", "Wilton Factory", at(30), True), ("d", "Wilton Factory", at(50), False), ("e", "X", 53 + 290 / 111_195, True), ("f", "X", 53 + 310 / 111_195, False)]
    out = resolve.covered(spark.createDataFrame([(k, n, y, -1.0, w) for k, n, y, w in cases], "key string, name string, lat double, lng double, want boolean"), by, "use").collect()
    assert all((r.use is not None) == r.want for r in out)


def test_new_places(spark):
    df = spark.createDataFrame([("a", [("osm", datetime(2024, 2, 1))]), ("b", [("osm", datetime(2024, 2, 1)), ("nhs", datetime(2024, 2, 1))]), ("c", [("osm", datetime(2023, 1, 1))])], "key string, members array<struct<source:string,first_seen:timestamp_ntz>>")
    assert [r[0] for r in df.select(resolve.is_new(F.col("members"), {"osm": "2024-01-01 00:00:00"})).collect()] == [True, False, False]


# --- sources


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Site Name,Type,Latitude,Longitude,Notes,Label,AKA\nMill,mill,52.1,-1.5,old,,A;B|C\nBad,x,,,,,\n,x,53,-2,,Kiln,\n")
    (tmp_path / "a.geojson").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"Title":"Pit","website":"http://x"},"geometry":{"type":"Point","coordinates":[-1.5,52.5]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}]}'
    )
    (tmp_path / "a.gpx").write_text('<gpx><wpt lat="52.5" lon="-1.5"><name>Adit</name><type>adit</type><desc>wet</desc></wpt><wpt lat="99" lon="0"><name>No</name></wpt></gpx>')
    (tmp_path / "a.kml").write_text("<kml><Placemark><name>Fort</name><Point><coordinates>-1.5,52.5,0</coordinates></Point></Placemark></kml>")
    read = lambda f, p: [tuple(r) for r in f(spark, str(tmp_path / p)).collect()]
    assert read(files.read_csv, "a.csv") == [("Mill", 52.1, -1.5, "mill", "old", "", ["A", "B", "C"]), ("Kiln", 53.0, -2.0, "x", "", "", [])]
    assert read(files.read_geojson, "a.geojson") == [("Pit", 52.5, -1.5, "", "", "http://x", [])]
    assert read(files.read_gpx, "a.gpx") == [("Adit", 52.5, -1.5, "adit", "wet", "", [])] and read(files.read_kml, "a.kml") == [("Fort", 52.5, -1.5, "", "", "", [])]


def test_register_files(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes('Some register,,\n"Published, 2024",,\n Postcode ,Name,\nBA1 1AA,"Caf\xe9, Bath",\n,,\nBA2,x,\n'.encode("cp1252"))
    out = files.read_register(spark, str(tmp_path / "r.csv"), "Postcode", "windows-1252")
    assert out.columns == ["Postcode", "Name"] and [tuple(r) for r in out.where("Postcode like 'BA%'").collect()] == [("BA1 1AA", "Caf\xe9, Bath"), ("BA2", "x")]
    (tmp_path / "p.csv").write_text("entity,end-date,point\n1,,POINT (-1.5 52.5)\n2,2020-01-01,POINT (0 0)\n3,,nowhere\n")
    assert [(r.entity, r.lat, r.lng) for r in files.planning_data(spark, str(tmp_path / "p.csv")).collect()] == [("1", 52.5, -1.5)]


def test_map_extract(spark, tmp_path):
    (tmp_path / "x.osm").write_text(
        '<osm><node id="1" lat="52.0" lon="-1.0" timestamp="2024-05-06T00:00:00Z"><tag k="abandoned" v="yes"/></node><node id="2" lat="52.001" lon="-1.0"/><node id="3" lat="52.0" lon="-1.002"/>'
        '<way id="10"><nd ref="2"/><nd ref="3"/><tag k="building" v="ruins"/></way><way id="11"><nd ref="1"/><nd ref="3"/></way><relation id="20"><member type="way" ref="11" role="outer"/><tag k="disused" v="yes"/></relation><way id="12"><nd ref="1"/><tag k="highway" v="road"/></way></osm>'
    )
    out = {r.osm_id: r for r in files.osm_features(*files.read_osm_xml(spark, str(tmp_path / "x.osm")), judges.is_candidate).collect()}
    assert set(out) == {"node/1", "way/10", "relation/20"} and out["node/1"].edited == "2024-05-06" and out["node/1"].extent_m == 0
    assert abs(out["way/10"].lat - 52.0005) < 1e-9 and abs(out["relation/20"].lng + 1.001) < 1e-9 and out["way/10"].extent_m == 88


# --- reports


def test_reports_as_sent(spark):
    ok = "a" * 16
    cases = [
        ("k", ok, None, 3, None, [], None), ("", ok, None, 3, None, [], "Which place?"), ("k", "short", None, 3, None, [], "This device has no id"), ("k", ok, True, None, None, [], None), ("k", ok, None, 6, None, [], "Access difficulty is 1 to 5"),
        ("k", ok, None, None, "maybe", [], "Accessible or inaccessible"), ("k", ok, None, None, None, ["sealed", "nice"], "Unknown tag"), ("k", ok, None, None, None, None, "Nothing to report"), ("k", ok, None, None, None, ["sealed", "trashed", "sealed"], None), (None, ok, None, 3, None, [], "Which place?"),
    ]
    out = reports.parsed(spark.createDataFrame(cases, "key string, device string, clear boolean, difficulty int, access string, tags array<string>, want string")).collect()
    assert all(r.error == r.want for r in out), out
    assert [list(r.tags) for r in out if r.tags and r.error is None] == [["trashed", "sealed"]]


def test_means_are_rounded_as_printed(spark):
    cases = [n / d for d in range(1, 41) for n in range(d, 5 * d + 1)]
    out = spark.createDataFrame([(x,) for x in cases], "x double").select("x", reports.printed(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x, 1) for r in out)


def test_a_devices_reports(spark):
    device = "b" * 20
    rows = [("k1", device), ("k2", device), ("k1", "c" * 20)]
    df = spark.createDataFrame(rows, "key string, device string").withColumn("reporter", reports.reporter_id(F.col("device"), F.col("key")))
    assert {r.key for r in reports.own_reports(df, device).collect()} == {"k1", "k2"} and df.select("reporter").distinct().count() == 3
    log = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 3))], "key string, at timestamp_ntz")
    assert [r.key for r in reports.touched_since(log, "2024-01-02 00:00:00").collect()] == ["b"]


def test_refused_reports_do_not_count(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, 1, start + timedelta(seconds=60 * i)) for i in range(100)] + [(200, 2, start), (201, 2, start)]
    out = {r.id: r.allowed for r in reports.allowed(spark.createDataFrame(rows, "id long, reporter long, at timestamp_ntz")).collect()}
    assert out[200] and out[201] and [out[i] for i in range(100)] == [i % 60 < 30 for i in range(100)]


def test_reports_as_a_stream(spark, tmp_path):
    from waymark.plans import views

    views.reports(spark, SF).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = reports.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == views.reports(spark, SF).count()


def test_the_log_of_a_stream_is_the_log_of_the_table(spark, tmp_path):
    from waymark.plans import views

    table = views.reports(spark, SF).select(F.col("key").cast("string").alias("key"), F.col("reporter").cast("string").alias("reporter"), F.col("at").cast("timestamp").alias("at"), "access", F.col("difficulty").cast("int").alias("difficulty"), F.lit(False).alias("clear"), "id")
    days = sorted({r.d for r in table.select(F.to_date("at").alias("d")).collect()})
    cut = days[len(days) // 2]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for part in (table.where(F.to_date("at") < cut), table.where(F.to_date("at") >= cut)):  # two runs: the second goes on from the first's state
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = reports.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = sorted((r.key, r.reporter, r.at, r.access) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.key, r.reporter, r.at, r.access) for r in reports.log(table).collect())


def test_a_taken_back_report_clears_its_log(spark, tmp_path):
    t = datetime(2024, 1, 1, 10)
    rows = [("k", "r", t, "accessible", 1, False), ("k", "r", t + timedelta(hours=1), None, None, True), ("k", "r", t + timedelta(hours=2), "accessible", 2, False), ("k", "r", t + timedelta(hours=3), "accessible", None, False)]
    df = spark.createDataFrame(rows, "key string, reporter string, at timestamp, access string, difficulty int, clear boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = reports.follow(stream).writeStream.format("memory").queryName("back").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.change, r.difficulty) for r in spark.table("back").orderBy("at").collect()] == [("log", 1), ("clear", None), ("log", 2)]


def test_overlapping_reads_let_a_record_through_once(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2)), ("a", datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "ref string, at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = reports.once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ref", "at").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.ref for r in spark.table("once").collect()) == ["a", "b"]


def test_closed_schools_one_by_one(spark):
    from waymark.operators import registers

    r = random.Random(2)
    rows = [(f"s{i:03d}", 52 + r.random() * 0.01, -1 + r.random() * 0.01, date(2000, 1, 1) + timedelta(days=r.randrange(40))) for i in range(150)]
    open_ = [(52 + r.random() * 0.01, -1 + r.random() * 0.01) for _ in range(20)]
    at = lambda x: {"lat": x[1], "lng": x[2]}
    left = [x for x in rows if not any(resolve.metres(at(x), {"lat": a, "lng": b}) <= 100 for a, b in open_)]
    kept = []
    for x in sorted(left, key=lambda x: (-x[3].toordinal(), x[0])):
        if not any(resolve.metres(at(x), at(y)) < 60 for y in kept):
            kept.append(x)
    got = registers.still_closed(spark.createDataFrame(rows, "key string, lat double, lng double, closed date"), spark.createDataFrame(open_, "lat double, lng double"), tile=3).collect()
    assert {x.key for x in got} == {x[0] for x in kept} and 0 < len(kept) < len(left) < 150


def test_notices_of_pages(spark):
    from waymark.operators import registers

    page = "<html><style>x</style><h1>NOTICE OF DISCLAIMER</h1><p>Company Name: A &amp; B LTD Company Number: 01234567</p> Interest: Leasehold Property: The Old Chapel, Chapel Street. Dissolution Date: 1 May 2020 <b>Actions</b> Save notice Property: other</html>"
    out = registers.notices(spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id int, html string")).collect()
    assert [(r.id, r.company, r.interest, r.property, r.dissolved) for r in out] == [(1, "A & B LTD", "Leasehold", "The Old Chapel, Chapel Street", date(2020, 5, 1))]


def test_structures_by_grid_reference(spark):
    from waymark.operators import registers

    rows = [("1", "Tunnel", "SU 1431 3007"), ("1", "Tunnel", "SU 1431 3007"), ("2", "Bridge", "SU 1431 3007"), ("3", "Viaduct", "ZZ 12 34")]
    out = registers.railway_structures(spark.createDataFrame(rows, "ref string, kind string, os_ref string")).collect()
    assert [(r.ref, r.kind, round(r.lat, 3), round(r.lng, 3)) for r in out] == [("1", "tunnel", 51.07, -1.797)]


def test_a_folder_of_changes(spark, tmp_path):
    from waymark.sources import versions
    from waymark.streaming import changes

    at, store = datetime(2024, 1, 1), str(tmp_path / "store")
    versions.replace(spark.createDataFrame([(1, "a", at, at, None), (2, "b", at, at, None)], "k long, nm string, first_seen timestamp_ntz, last_seen timestamp_ntz, gone_at timestamp_ntz"), "k", store)
    schema = "k long, nm string, deleted boolean, at timestamp_ntz, seq long"
    for n, rows in enumerate(([(1, "x", False, datetime(2024, 1, 2), 1), (1, "y", False, datetime(2024, 1, 2), 2), (3, "c", False, datetime(2024, 1, 2), 3)], [(2, None, True, datetime(2024, 1, 3), 1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes.follow_folder(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "cp"), "k", ["nm"]).awaitTermination(120)
        assert versions.current(spark, store) == n + 2
    out = {r.k: (r.nm, r.gone_at) for r in versions.read(spark, store).collect()}
    assert out == {1: ("y", None), 2: ("b", datetime(2024, 1, 3)), 3: ("c", None)}
    assert {r.k: r.gone_at for r in versions.read(spark, store, 2).collect()} == {1: None, 2: None, 3: None}
