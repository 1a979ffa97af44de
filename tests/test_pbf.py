"""Binary map extracts against the same extract in XML, and KMZ against KML."""

import random
import zipfile
import zlib
from datetime import UTC, datetime
from xml.sax.saxutils import quoteattr

import pyarrow as pa
import pytest

from waymark.functions import judges
from waymark.sources import files, pbf


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def zigzag(n):
    return varint(n << 1 if n >= 0 else ((-n) << 1) - 1)


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(numbers):
    return b"".join(zigzag(b - a) for a, b in zip([0, *numbers], numbers, strict=False))


def blob(kind, raw, packing):
    packed = {"raw": lambda: field(1, raw), "zlib": lambda: field(2, len(raw)) + field(3, zlib.compress(raw)), "zstd": lambda: field(2, len(raw)) + field(7, pa.Codec("zstd").compress(raw, asbytes=True)), "lz4": lambda: field(2, len(raw)) + field(6, pa.Codec("lz4_raw").compress(raw, asbytes=True))}[packing]()
    head = field(1, kind) + field(3, len(packed))
    return len(head).to_bytes(4, "big") + head + packed


def block(objects, step, lat0, lng0, dense):
    """A block of objects: (kind, id, place or refs or members, tags, seconds)."""
    words = {"": 0}
    word = lambda w: words.setdefault(w, len(words))
    unit = lambda at, base: (round(at * 1e9) - base) // step
    tagged = lambda tags: field(2, b"".join(varint(word(k)) for k in tags)) + field(3, b"".join(varint(word(v)) for v in tags.values()))
    info = lambda when: field(4, field(1, 7) + field(2, when)) if when else b""
    nodes, group = [o for o in objects if o[0] == "node"], b""
    if dense and nodes:
        told = b"".join(b"".join(varint(word(k)) + varint(word(v)) for k, v in o[3].items()) + b"\x00" for o in nodes) if any(o[3] for o in nodes) else b""
        group += field(2, field(1, deltas([o[1] for o in nodes])) + field(5, field(2, deltas([o[4] for o in nodes]))) + field(8, deltas([unit(o[2][0], lat0) for o in nodes])) + field(9, deltas([unit(o[2][1], lng0) for o in nodes])) + field(10, told))
    else:
        for _, i, (lat, lng), tags, when in nodes:
            group += field(1, varint(8) + zigzag(i) + tagged(tags) + info(when) + varint(64) + zigzag(unit(lat, lat0)) + varint(72) + zigzag(unit(lng, lng0)))
    for kind, i, inner, tags, when in objects:
        if kind == "way":
            group += field(3, field(1, i) + tagged(tags) + info(when) + field(8, deltas(inner)))
        elif kind == "relation":
            kinds = b"".join(varint(["node", "way", "relation"].index(k)) for k, _ in inner)
            group += field(4, field(1, i) + tagged(tags) + info(when) + field(8, b"\x00" * len(inner)) + field(9, deltas([r for _, r in inner])) + field(10, kinds))
    table = field(1, b"".join(field(1, w.encode()) for w in words))
    return table + field(2, group) + field(17, step) + field(19, lat0) + field(20, lng0)


HEADER = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")


def extract(seed=3):
    r = random.Random(seed)
    tags = lambda: r.choice([{}, {}, {"building": "ruins", "name": "Señor's \"Mill\" & Co"}, {"disused:amenity": "school"}, {"highway": "road"}, {"abandoned": "yes", "name": "x" * 300}])
    when = lambda: r.choice([0, r.randrange(1_100_000_000, 1_750_000_000)])
    nodes = [("node", i * r.choice([1, 5]) + 10**10 * (i % 3), (round(r.uniform(-60, 60), 7), round(r.uniform(-180, 180), 7)), tags(), when()) for i in range(1, 400)]
    nodes = list({o[1]: o for o in nodes}.values())
    some = lambda of, n: [r.choice(of)[1] for _ in range(r.randrange(n))]
    ways = [("way", 5_000 - 7 * i, some(nodes, 9), tags(), when()) for i in range(150)]
    relations = [("relation", i, [(k, x) for k, of in (("way", ways), ("node", nodes), ("way", ways)) for x in some(of, 4)], tags(), when()) for i in range(1, 60)]
    return nodes, ways, relations


def as_xml(objects):
    out = ["<osm>"]
    for kind, i, inner, tags, when in objects:
        at = f' lat="{inner[0]:.7f}" lon="{inner[1]:.7f}"' if kind == "node" else ""
        stamp = f' timestamp="{datetime.fromtimestamp(when, UTC):%Y-%m-%dT%H:%M:%SZ}"' if when else ""
        told = [] if kind == "node" else [f'<nd ref="{x}"/>' for x in inner] if kind == "way" else [f'<member type="{k}" ref="{x}" role=""/>' for k, x in inner]
        out.append(f'<{kind} id="{i}"{at}{stamp}>' + "".join(told + [f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in tags.items()]) + f"</{kind}>")
    return "\n".join([*out, "</osm>"])


def as_pbf(parts):
    """Blocks of 40 objects, packed and scaled in turn in each way that the format knows."""
    out = [blob(b"OSMHeader", HEADER, "zlib")]
    for n, at in enumerate(range(0, max(len(p) for p in parts), 40)):
        for part in parts:
            if part[at : at + 40]:
                raw = block(part[at : at + 40], [100, 1][n % 2], [0, -7_000_000_000][n % 2], [0, 9_000_000_000][n % 2], dense=n % 3 != 2)
                out.append(blob(b"OSMData", raw, ["zlib", "raw", "zstd", "lz4"][n % 4]))
    return b"".join(out)


def told(df, inner):
    # ways without refs are null in XML, empty here
    return sorted((r.id, tuple(r[c] if c != "list" else 0 for c in inner), sorted((r.tags or {}).items()), r.edited) for r in df.collect())


def test_binary_extract_is_the_xml_one(spark, tmp_path):
    parts = extract()
    (tmp_path / "x.osm").write_text(as_xml([o for p in parts for o in p]))
    (tmp_path / "x.osm.pbf").write_bytes(as_pbf(parts))
    xml = files.read_osm_xml(spark, str(tmp_path / "x.osm"))
    expected = [told(xml[0], ("lat", "lng")), *[sorted((r.id, r[c] or [], sorted(r.tags.items()), r.edited) for r in df.collect()) for df, c in zip(xml[1:], ("refs", "members"), strict=True)]]
    for run in (16 * 1024 * 1024, 3_000, 211):  # a task to the file, to some blobs, and far more tasks than blobs
        binary = pbf.read_osm_pbf(spark, f"file://{tmp_path}/x.osm.pbf", run_bytes=run)
        assert told(binary[0], ("lat", "lng")) == expected[0]
        for k, c in ((1, "refs"), (2, "members")):
            assert sorted((r.id, r[c], sorted(r.tags.items()), r.edited) for r in binary[k].collect()) == expected[k]
        if run == 3_000:
            assert binary[0].rdd.getNumPartitions() > 5
    features = lambda three: sorted(map(str, files.osm_features(*three, judges.is_candidate).collect()))
    some = features(xml)
    assert len(some) > 50 and features(binary) == some
    asked = pbf.read_osm_pbf(spark, str(tmp_path), keys=("building", "abandoned", "disused:*"), run_bytes=3_000)
    assert features(asked) == some and {k for r in asked[0].collect() for k in r.tags} == {"building", "abandoned", "disused:amenity", "name"}
    assert asked[0].count() == len(parts[0])


def test_odd_files(spark, tmp_path):
    nodes, ways, relations = extract()
    whole = as_pbf((nodes, ways, relations))
    for name, data in {"cut": whole[:-5], "empty": b"", "new": blob(b"OSMHeader", HEADER + field(4, b"HistoricalInformation"), "raw"), "bare": blob(b"OSMHeader", HEADER, "raw")}.items():
        (tmp_path / f"{name}.pbf").write_bytes(data)
    count = lambda name, run=2_000: pbf.read_osm_pbf(spark, f"{tmp_path}/{name}.pbf", run_bytes=run)[2].count()
    assert (count("empty"), count("bare")) == (0, 0)
    with pytest.raises(Exception, match="ends within a blob"):
        count("cut", 16_000_000)
    with pytest.raises(Exception, match="HistoricalInformation"):
        count("new")
    # a blob whose words look like a header is passed over: what comes after it isn't one
    trap = ("node", 1, (1.0, 2.0), {"note": "\x00\x00\x00\x0d\n\x07OSMData\x18\x05abcde"}, 0)
    (tmp_path / "trap.pbf").write_bytes(blob(b"OSMHeader", HEADER, "raw") + blob(b"OSMData", block([trap] * 40, 100, 0, 0, True), "raw") + blob(b"OSMData", block(nodes[:40], 100, 0, 0, True), "raw"))
    for run in (40, 97, 1_000_000):
        assert pbf.read_osm_pbf(spark, f"{tmp_path}/trap.pbf", run_bytes=run)[0].count() == 80


def test_zipped_places(spark, tmp_path):
    marks = "".join(f"<Placemark><name>Place {i} &amp; more</name><description>d{i}</description><Point><coordinates>-1.{i},52.{i},0</coordinates></Point></Placemark>" for i in range(5))
    kml = f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{marks}<Placemark><name>No place</name></Placemark></Document></kml>'
    (tmp_path / "a.kml").write_text(kml)
    with zipfile.ZipFile(tmp_path / "a.kmz", "w") as z:
        z.writestr("images/x.png", b"\x89PNG")
        z.writestr("doc.KML", kml)
        z.writestr("other.kml", kml.replace("Place ", "Other "))
    assert sorted(files.read_kmz(spark, str(tmp_path / "a.kmz")).collect()) == sorted(files.read_kml(spark, str(tmp_path / "a.kml")).collect())
    with zipfile.ZipFile(tmp_path / "b.kmz", "w") as z:
        z.writestr("x.txt", "nothing")
    with pytest.raises(Exception, match="no KML"):
        files.read_kmz(spark, str(tmp_path / "b.kmz")).count()
