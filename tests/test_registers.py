"""Photos around a place, postcodes that are no longer in use, a yearly return of estates."""

from waymark.operators import registers


def test_photos_close_by_face_nowhere(spark):
    rows = [("here", 52.0, -1.00002, 90.0, "t"), ("away", 52.0, -1.0005, 270.0, "t"), ("to", 52.0, -1.0006, 90.0, "t"), ("unknown", 52.0, -1.0007, None, "t"), ("bare", 52.0, -1.0003, 90.0, None), ("blank", 52.0, -1.0003, 90.0, ""), ("corner", 52.0007, -1.00115, 90.0, "t"), ("far", 52.1, -1.0, 180.0, "t")]
    photos = spark.createDataFrame(rows, "key string, lat double, lng double, azimuth double, thumb string")
    got = [(r.key, r.facing) for r in registers.photos_of(photos, 52.0, -1.0, 80).collect()]
    assert got == [("here", None), ("to", True), ("unknown", None), ("corner", True), ("away", False)]  # the corner of the box is farther than 80 m
    assert {r.key for r in registers.photos_of(photos.drop("thumb"), 52.0, -1.0, 80, n=20).collect()} == {"here", "away", "to", "unknown", "bare", "blank", "corner"}


def test_postcodes_in_use_go_first(spark):
    at = "postcode string, lat double, lng double"
    live = spark.createDataFrame([("AB1 1AA", 1.0, 1.0), ("AB2 2AA", None, None), (None, 9.0, 9.0)], at)
    gone = spark.createDataFrame([("ab11aa", 5.0, 5.0), ("AB2 2AA", 2.0, 2.0), ("AB3\t3AA", 3.0, 3.0), ("", 8.0, 8.0)], at)
    rows = spark.createDataFrame([(1, "ab1 1aa"), (2, "AB22AA"), (3, " AB3 3AA "), (4, "ZZ1 1ZZ"), (5, None), (6, "")], "id int, postcode string")
    assert sorted((r.id, r.lat) for r in registers.placed_by_postcode(rows, live, gone).collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert sorted((r.id, r.lat) for r in registers.placed_by_postcode(rows, live).collect()) == [(1, 1.0)]


def test_a_return_as_editions_spell_it(spark):
    rows = [("A1", " Old Hospital ", "Trust", "Unoccupied", "AB1 1AA", "0", "Not Applicable", "12,000", "55.5"), ("", "No code", None, "Clinic", None, None, "1,000", "2,000", None), ("A3", "Small", "T", "Clinic", "", "", "999", "999", ""), ("A4", "Busy", "T", "Clinic", "", "0", "1,000", "2,001", ""), ("A5", "Part", "T", "Clinic", "", "0.5", "0", "0", "")]
    names = ["Site Code", "Site Name", "Trust Name", "Site Type", "Post Code", "Internal floor area - unoccupied (m²)", "Floor area - empty (sqm)", "Gross internal floor area (m²)", "Age profile - pre 1948 (%)"]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    out = {r.name: r for r in registers.standing_empty(registers.estates_return(table, "https://x/ERIC - 2022_23 - Site data.csv")).collect()}
    assert {n: (r.ref, r.whole) for n, r in out.items()} == {"Old Hospital": ("A1", True), "No code": ("No code", False), "Part": ("A5", True)}
    first = out["Old Hospital"]
    assert (first.floor_m2, first.empty_m2, first.pre_1948, first.year, first.trust) == (12000.0, 0.0, 55.5, "2022/23", "Trust")
    bare = registers.estates_return(table.select("Site Name")).first()
    assert (bare.ref, bare.floor_m2, bare.year, bare.postcode) == ("Old Hospital", 0.0, "", "")
