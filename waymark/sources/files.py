"""Places from files: CSV and TSV, GeoJSON, GPX, KML and KMZ, all as (name, lat, lng, kind, note, url, aliases array), and registers' own files.

GeoJSON is read a file to a task (a collection is one document); the others are split by rows or tags."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import vocabulary as V
from waymark.functions.names import given


# The letters of Windows-1252 where Latin-1 has control characters; Spark reads Latin-1 alone of the two.
_LATIN = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _csv(spark: SparkSession, path: str, encoding: str, **options) -> DataFrame:
    windows = encoding.lower() in ("cp1252", "windows-1252")
    df = spark.read.csv(path, encoding="ISO-8859-1" if windows else encoding, escape='"', **options)
    return df.select(*[F.translate(f"`{c}`", _LATIN, _WINDOWS).alias(c) for c in df.columns]) if windows else df


def _placed(df: DataFrame) -> DataFrame:
    """Rows with a position on the globe; aliases split at semicolons and bars."""
    good = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    parts = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda a: a != "")
    text = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("name", "kind", "note", "url")}
    return df.where(good).withColumns({**text, "aliases": parts}).select("name", "lat", "lng", "kind", "note", "url", "aliases")


def _picker(columns: dict[str, Column]):
    """The first field, in the order of the names that stand for it, that a row fills."""
    by = {c.strip().lower().replace(" ", "_"): v for c, v in columns.items()}
    return lambda names: F.coalesce(*[given(F.trim(by[n])) for n in names if n in by], F.lit(None).cast("string"))


def _fields(pick, lat: Column | None = None, lng: Column | None = None) -> list[Column]:
    at = [(pick(V.IMPORT_LAT) if lat is None else lat).try_cast("double"), (pick(V.IMPORT_LNG) if lng is None else lng).try_cast("double")]
    made = {"name": pick(V.IMPORT_NAME), "lat": at[0], "lng": at[1], "kind": pick(V.IMPORT_KIND), "note": pick(V.IMPORT_NOTE), "url": pick(V.IMPORT_URL), "aliases": pick(V.IMPORT_ALIAS)}
    return [v.alias(k) for k, v in made.items()]


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """By header, whatever the field is called; rows without a position are left out. TSV: delimiter a tab; old registers: encoding windows-1252."""
    df = _csv(spark, path, encoding, header=True, sep=delimiter, multiLine=True)
    return _placed(df.select(*_fields(_picker({c.lstrip(chr(0xFEFF)): F.col(f"`{c}`") for c in df.columns}))))


def read_register(spark: SparkSession, path: str, must_have: str, encoding: str = "UTF-8") -> DataFrame:
    """A register's CSV whose header stands below other lines: the first row with a field `must_have` names the columns; that row, nameless columns and empty rows are left out. Rows above the header stay: a table of many splits has no order to drop them by, so the caller filters by a field that they lack."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(must_have))).limit(50).collect()
    widths = [len(fields) for fields in csv.reader([r["value"] for r in lines]) if must_have in [f.strip() for f in fields]]
    columns = [f"_c{i}" for i in range(widths[0] if widths else 1)]  # as many as the header has
    rows = _csv(spark, path, encoding, schema=", ".join(f"{c} string" for c in columns))
    # one field of all: Spark's optimiser goes through all combinations of renamed columns of which a condition speaks
    rows = rows.select(F.explode(F.array(F.array(*[F.coalesce(F.trim(c), F.lit("")) for c in columns]))).alias("cells"))
    found = rows.where(F.array_contains("cells", must_have)).first()  # one row
    if found is None:
        raise ValueError(f"no line of {path} has {must_have!r}")
    names = [*found["cells"]]
    while not names[-1]:
        names.pop()
    named = [i for i, n in enumerate(names) if n]
    told = F.exists(F.transform(F.array(*map(F.lit, named)), lambda i: F.get("cells", i)), lambda c: c != "")
    kept = rows.where((F.array_join(F.slice("cells", 1, len(names)), "|") != "|".join(names)) & told)
    return kept.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(names[i]) for i in named])


def planning_data(spark: SparkSession, path: str) -> DataFrame:
    """A planning dataset's CSV: entries that haven't ended, with lat and lng from their point."""
    from waymark.functions.geo import wkt_point

    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.select(*[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in df.columns])
    ended = given(F.trim("end_date")).isNotNull() if "end_date" in df.columns else F.lit(False)
    at = df.where(~ended).withColumn("__p", wkt_point(F.col("point"))).where("__p is not null")
    return at.withColumns({"lat": F.col("__p.lat"), "lng": F.col("__p.lng")}).drop("__p")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features of a feature collection."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    at = F.from_json("f.geometry.coordinates", "array<double>")
    held = features.withColumn("p", F.map_from_entries(F.transform(F.map_entries("f.properties"), lambda e: F.struct(F.replace(F.lower(F.trim(e["key"])), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")))))
    pick = lambda names: F.coalesce(*[given(F.trim(F.try_element_at("p", F.lit(n)))) for n in names])
    return _placed(held.select(*_fields(pick, F.get(at, F.lit(1)), F.get(at, F.lit(0)))))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "wpt").schema("_lat double, _lon double, name string, desc string, type string, link string").load(path)
    none = F.lit(None).cast("string")
    return _placed(df.select("name", F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), F.col("type").alias("kind"), F.col("desc").alias("note"), F.col("link").alias("url"), none.alias("aliases")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, description string, Point struct<coordinates: string>").load(path)
    return _marked(df.select("name", "description", F.col("Point.coordinates").alias("coordinates")))


def _marked(df: DataFrame) -> DataFrame:
    """Places of placemarks (name, description, coordinates)."""
    at = F.split(F.get(F.split(F.trim(F.replace("coordinates", F.lit("\n"), F.lit(" "))), r"\s+"), F.lit(0)), ",")
    none = F.lit(None).cast("string")
    where = [F.get(at, F.lit(i)).try_cast("double").alias(c) for i, c in ((1, "lat"), (0, "lng"))]
    return _placed(df.select("name", *where, none.alias("kind"), F.col("description").alias("note"), none.alias("url"), none.alias("aliases")))


def _placemarks(packed: bytes) -> Iterator[dict[str, str | None]]:
    """Name, note and coordinates of the placemarks of an archive's first KML; a mark is let go once told."""
    with zipfile.ZipFile(io.BytesIO(packed)) as archive:
        inner = next((n for n in archive.namelist() if n.lower().endswith(".kml")), None)
        if inner is None:
            raise ValueError("an archive with no KML in it")
        with archive.open(inner) as xml:
            for _, el in ElementTree.iterparse(xml):
                if el.tag.rpartition("}")[2] == "Placemark":
                    yield {c: next((e.text for e in el.iterfind(f".//{{*}}{c}")), None) for c in ("name", "description", "coordinates")}
                    el.clear()


def read_kmz(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of zipped KML: of each archive the first KML. An archive is a task; one that has none fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("content"):
                marks = _placemarks(packed.as_py())
                while some := [*itertools.islice(marks, 1000)]:
                    yield pa.RecordBatch.from_pylist(some, pa.schema([(c, pa.string()) for c in ("name", "description", "coordinates")]))

    return _marked(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, description string, coordinates string"))


def read_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (id, lat, lng, tags), ways (id, refs, tags) and relations (id, members: the ways, tags) of an extract in XML."""
    tag = "tag array<struct<_k: string, _v: string>>"
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(f"_id long, _timestamp string, {schema}, {tag}").load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))).alias("tags")
    edited = F.substr("_timestamp", F.lit(1), F.lit(10)).alias("edited")
    nodes = read("node", "_lat double, _lon double").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lng"), tags, edited)
    ways = read("way", "nd array<struct<_ref: long>>").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"), tags, edited)
    member = "member array<struct<_type: string, _ref: long, _role: string>>"
    relations = read("relation", member).select(F.col("_id").alias("id"), F.transform(F.filter("member", lambda m: m["_type"] == "way"), lambda m: m["_ref"]).alias("members"), tags, edited)
    return nodes, ways, relations


def osm_features(nodes: DataFrame, ways: DataFrame, relations: DataFrame, wanted) -> DataFrame:
    """(osm_id, lat, lng, tags, extent_m, edited) of the features that `wanted` (tags -> condition) picks: a node's own position, the middle of the box of a way's or relation's nodes and half its diagonal.

    Three hash joins: relations to ways, ways to nodes, boxes by outline."""
    from waymark.functions.geo import haversine_m

    own = nodes.where(wanted(F.col("tags"))).select(F.concat(F.lit("node/"), "id").alias("osm_id"), "lat", "lng", "tags", F.lit(0).cast("bigint").alias("extent_m"), "edited")
    lines = ways.where(wanted(F.col("tags"))).select(F.concat(F.lit("way/"), "id").alias("osm_id"), "tags", "edited", F.explode("refs").alias("ref"))
    areas = relations.where(wanted(F.col("tags"))).select(F.concat(F.lit("relation/"), "id").alias("osm_id"), "tags", "edited", F.explode("members").alias("way"))
    parts = areas.join(ways.select(F.col("id").alias("way"), "refs"), "way").select("osm_id", "tags", "edited", F.explode("refs").alias("ref"))
    at = nodes.select(F.col("id").alias("ref"), "lat", "lng")
    box = [f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for f, n in ((F.min, "low"), (F.max, "high"))]
    outlines = lines.unionAll(parts).join(at, "ref").groupBy("osm_id").agg(F.first("tags").alias("tags"), F.first("edited").alias("edited"), *box)
    across = haversine_m(F.col("low_lat"), F.col("low_lng"), F.col("high_lat"), F.col("high_lng"))
    middle = [((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2).alias(c) for c in ("lat", "lng")]
    return own.unionAll(outlines.select("osm_id", *middle, "tags", F.bround(across / 2, 0).cast("bigint").alias("extent_m"), "edited"))


# --- spreadsheets

# Names of an OpenDocument spreadsheet's elements and attributes.
_TABLE, _TEXT = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % x for x in ("table", "text"))


def _sheet_rows(packed: bytes, sheet: str) -> Iterator[list[str]]:
    """The rows of one sheet, in order; an element is let go as soon as its row is told, so a sheet of any length takes little room. Blank cells at the end of a row aren't kept, however often they are repeated."""
    inside, held = False, []
    with zipfile.ZipFile(io.BytesIO(packed)).open("content.xml") as xml:
        for event, el in ElementTree.iterparse(xml, events=("start", "end")):
            if event == "start":
                held.append(el)
                if el.tag == f"{_TABLE}table":
                    inside = el.get(f"{_TABLE}name") == sheet
                continue
            held.pop()
            if el.tag == f"{_TABLE}table-row":
                if inside:
                    told = [(c, "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p"))) for c in el if c.tag in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell")]
                    while told and not told[-1][1]:
                        told.pop()
                    yield [text for c, text in told for _ in range(int(c.get(f"{_TABLE}number-columns-repeated", "1")))]
                if held:
                    held[-1].remove(el)  # the table forgets it


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(file, row from 0, cells) of a sheet of each OpenDocument spreadsheet under a path. A file is a task: it is read packed, and its XML as it comes, a thousand rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, packed in zip(batch.column("path"), batch.column("content"), strict=True):
                at, some = 0, []
                for cells in _sheet_rows(packed.as_py(), sheet):
                    some.append(cells)
                    if len(some) == 1000:
                        yield _as_batch(file.as_py(), at, some)
                        at, some = at + len(some), []
                yield _as_batch(file.as_py(), at, some)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row long, cells array<string>")


def _as_batch(file: str, at: int, some: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(some), pa.string()), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], ["file", "row", "cells"])


def under_header(rows: DataFrame, must_have: str) -> DataFrame:
    """Rows (file, row, cells) below the first that has a cell `must_have`, with their fields by its names: file, row, and fields (a map). Nameless columns and rows without a field are left out; each file has a header of its own."""
    bare = F.transform("cells", lambda c: F.trim(c))
    heads = rows.where(F.array_contains(bare, must_have)).groupBy("file").agg(F.min_by(F.struct("row", bare.alias("names")), "row").alias("h"))  # one row a file
    below = rows.join(F.broadcast(heads), "file").where(F.col("row") > F.col("h.row"))
    pairs = F.filter(F.arrays_zip(F.col("h.names").alias("k"), F.transform("cells", lambda c: F.trim(c)).alias("v")), lambda x: F.coalesce(x["k"] != "", F.lit(False)) & F.coalesce(x["v"] != "", F.lit(False)))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)  # of columns of one name the first that is filled
    return below.select("file", "row", F.map_from_entries(first).alias("fields")).where(F.size("fields") > 0)
