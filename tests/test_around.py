"""Joins by place against all pairs, at any latitude; ways to a place from lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import registers, sites


def metres(a, b):
    dy, dx = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    h = math.sin(dy) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dx) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


@pytest.mark.parametrize(("lat", "lng", "reach", "cell"), [(0.0, 0.0, 700, 0.01), (60.2, -1.3, 800, 0.01), (57.0, -2.0, 2500, 0.002), (-77.5, 179.9995, 900, 0.01), (89.99, 20.0, 3000, 0.05), (-90.0, 0.0, 500, 0.05), (51.4, -2.2, 60, 0.002)])
def test_near_pairs_are_all_there(spark, lat, lng, reach, cell):
    rnd, n = random.Random(4), 150
    wide = reach / 111195 * 3
    spot = lambda: (max(-90.0, min(90.0, lat + rnd.uniform(-wide, wide))), (lng + rnd.uniform(-wide, wide) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180)
    left, right = [(i, *spot()) for i in range(n)], [(i, *spot()) for i in range(n)]
    want = {(a, b) for a, *p in left for b, *q in right if metres(p, q) <= reach}
    df = [spark.createDataFrame(x, "key long, lat double, lng double") for x in (left, right)]
    got = [(r.key, r.r_key) for r in sites.near_pairs(*df, reach, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nearest_and_keys(spark):
    d = spark.createDataFrame([("a", 60.0, -1.0), ("b", 60.0, -1.013), ("c", 61.0, 0.0)], "key string, lat double, lng double")
    assert [(r.key, r.r_key) for r in sites.nearest_of(d, d, 800, 0.01, same=False).orderBy("key").collect()] == [("a", "b"), ("b", "a")]
    with pytest.raises(ValueError, match="at most"):
        sites.by_keys(d, [str(i) for i in range(201)])


def way(*points, **tags):
    return ([{"lat": a, "lng": b} for a, b in points], {k.replace("_", "_"): v for k, v in tags.items()})


def test_ways_to_a_place(spark):
    """At 60 N a degree of longitude is 55.6 km: a line passes 300 m west, its ends are kilometres off."""
    west = -1.0 - 300 / 55_597
    features = [
        way((59.9, west), (60.1, west), designation="public_bridleway", highway="track", prow_ref="X 1"), way((60.0018, -1.1), (60.0018, -0.9), highway="steps"), way((60.0, -0.9873), amenity="parking", name="Quay", fee="yes"), way((60.0, -0.98), amenity="parking"), way((60.0, -1.0), amenity="parking", access="private"),
        way((60.0003, -1.01), (60.0003, -0.99), highway="service_road", access="no"), way((60.0, -1.0002), barrier="lift_gate", foot="no"), way((60.0, -1.0), landuse="quarry_pit", access="private"), way((60.0, -1.0), access="no"), way((60.001, -1.0), (60.001, -1.0), barrier="wall", access="no"), way((60.0, -1.0), highway="path"), way(),
    ]
    places = spark.createDataFrame([("a", 60.0, -1.0), ("far", 10.0, 10.0)], "key string, lat double, lng double")
    df = spark.createDataFrame(features, "line array<struct<lat:double,lng:double>>, tags map<string,string>")
    got = {r.key: r for r in registers.access_summary(places, df).collect()}
    a = got["a"]
    assert (a.right_of_way.d, a.right_of_way.what, a.right_of_way.direction, a.right_of_way.ref) == (300, "Public bridleway", "W", "X 1")
    assert (a.path.d, a.path.what, a.path.direction) == (200, "Steps", "N") and (a.parking.d, a.parking.what, a.parking.fee) == (706, "Quay", True)
    assert a.private == ["quarry pit land", "something", "a lift gate"]
    assert got["far"].right_of_way is None and got["far"].path is None and got["far"].parking is None and got["far"].private == []
    pieces = registers.line_pieces(df)
    assert pieces.where(F.greatest(F.abs(F.col("a_lat") - F.col("b_lat")) * 111_195, F.abs(F.col("a_lng") - F.col("b_lng")) * 55_600) > 201).count() == 0


def test_crowds_are_settled_close_by_and_dealt_over_tasks(spark, monkeypatch):
    """With few pairs to a task, what takes many tasks gives the rows of one; of many copies at a spot two keys are looked at."""
    monkeypatch.setattr(sites, "TASK_PAIRS", 200)
    rnd = random.Random(7)
    spots = [(i, 51.4 + rnd.random() ** 3 * 0.01, -2.2 + rnd.random() ** 3 * 0.01) for i in range(300)] + [(i, 51.4, -2.2) for i in range(300, 360)]
    d = spark.createDataFrame(spots, "key long, lat double, lng double")
    far = {(a, b): metres(p, q) for a, *p in spots for b, *q in spots}
    pairs = sites.near_pairs(d, d, 150, 0.002)
    assert sorted((r.key, r.r_key) for r in pairs.collect()) == sorted(k for k, m in far.items() if m <= 150)
    assert pairs.columns == ["key", "lat", "lng", "r_key", "r_lat", "r_lng", "metres"]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    for same in (True, False):
        want = {a: min((m, b) for (x, b), m in far.items() if x == a and (same or b != a)) for a, *_ in spots}
        got = {r.key: (r.metres, r.r_key) for r in sites.nearest_of(d, d, 150, 0.002, same=same).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: b for k, (m, b) in want.items() if m <= 150}


def test_ways_to_a_place_in_a_crowd(spark, monkeypatch):
    rnd = random.Random(3)
    near = lambda: (51.4 + rnd.uniform(0, 0.01), -2.2 + rnd.uniform(0, 0.01))
    kinds = [{"designation": "public_footpath", "highway": "path"}, {"highway": "track"}, {"amenity": "parking"}, {"highway": "path", "access": "private"}, {"barrier": "gate", "access": "no"}, {"highway": "steps"}, {"designation": "public_bridleway"}]
    features = [way(near(), *([near()] if "amenity" not in k and "barrier" not in k else []), **k) for _ in range(12) for k in kinds]
    df = spark.createDataFrame(features, "line array<struct<lat:double,lng:double>>, tags map<string,string>")
    places = spark.createDataFrame([(str(i), *near()) for i in range(40)], "key string, lat double, lng double")
    read = lambda: sorted(map(str, registers.access_summary(places, df).collect()))
    want = read()
    monkeypatch.setattr(sites, "TASK_PAIRS", 100)
    assert read() == want


def on_leg(p, a, b):
    """A leg's point nearest to a place, on the plane scaled by the place's latitude."""
    k, x = math.cos(math.radians(p[0])), (p[1] - a[1] + 180) % 360 - 180
    dx, dy, y = (b[1] - a[1]) * k, b[0] - a[0], p[0] - a[0]
    long = dx * dx + dy * dy
    t = min(1, max(0, (x * k * dx + y * dy) / long)) if long else 0
    return a[0] + t * dy, a[1] + t * (b[1] - a[1])


@pytest.mark.parametrize(("lat", "lng", "reach", "cell"), [(0.0, 0.0, 300, 0.003), (51.4, -2.2, 1.5, 0.00005), (60.2, -1.3, 400, 0.02), (-77.5, 179.9, 900, 0.001), (-77.5, -179.9999, 700, 0.01), (89.8, 20.0, 800, 0.005)])
def test_near_legs_are_all_there_once(spark, lat, lng, reach, cell):
    rnd, n = random.Random(5), 120
    wide = reach / 111195 * 3
    spot = lambda: (max(-90.0, min(90.0, lat + rnd.uniform(-wide, wide))), (lng + rnd.uniform(-wide, wide) / max(0.02, math.cos(math.radians(lat))) + 180) % 360 - 180)
    legs = [(spot(), spot()) for _ in range(n)]
    legs = [(a, b) for a, b in legs if abs(a[1] - b[1]) < 180]
    legs += [(a, a) for a, _ in legs[:20]] + [(a, (a[0], b[1])) for a, b in legs[20:40]] + [(a, (b[0], a[1])) for a, b in legs[40:60]] + [(a, (a[0] + 1e-9, b[1])) for a, b in legs[60:70]]
    spots = [(i, *spot()) for i in range(n)] + [(n, *legs[0][0]), (n + 1, None, 1.0)]
    want = {(i, j) for i, *p in spots[:-1] for j, (a, b) in enumerate(legs) if metres(p, on_leg(p, a, b)) <= reach}
    left = spark.createDataFrame(spots, "key long, lat double, lng double")
    right = spark.createDataFrame([(j, *a, *b) for j, (a, b) in enumerate(legs)], "key long, a_lat double, a_lng double, b_lat double, b_lng double")
    got = [(r.key, r.r_key) for r in registers.near_legs(left, right, reach, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_a_crowd_of_private_things_is_not_met_pair_by_pair(spark, monkeypatch):
    """Where hundreds of lines cross within reach of each place, few pairs are looked at, and the result is that of all pairs."""
    monkeypatch.setattr(sites, "TASK_PAIRS", 20_000)
    looked, load = [], sites._load
    monkeypatch.setattr(sites, "_load", lambda *a: looked.append(load(*a).agg(F.sum("pairs")).first()[0] or 0) or load(*a))
    rnd = random.Random(6)
    near = lambda: (51.4 + rnd.uniform(0, 0.0054), -2.2 + rnd.uniform(0, 0.0086))
    kinds = {"a gate": {"barrier": "gate"}, "a path": {"highway": "path"}, "quarry land": {"landuse": "quarry"}, "a parking space": {"amenity": "parking_space"}, "something": {}}
    lines = [(near(), near(), k) for _ in range(100) for k in kinds]
    df = spark.createDataFrame([way(a, b, access="no", **kinds[k]) for a, b, k in lines], "line array<struct<lat:double,lng:double>>, tags map<string,string>")
    spots = [(i, *near()) for i in range(400)]
    got = {r.key: r.private for r in registers.access_summary(spark.createDataFrame(spots, "key long, lat double, lng double"), df).collect()}
    for i, *p in spots:
        least = {k: min(metres(p, on_leg(p, a, b)) for a, b, x in lines if x == k) for k in kinds}
        assert got[i] == [k for _, k in sorted((round(m), k) for k, m in least.items() if m <= 50)[:3]]
    assert max(looked) < 150_000  # 181,626 pairs when all within reach were met
