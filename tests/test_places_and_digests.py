"""Nearest places, digests of folders and scopes against brute force."""

import math
import random
import re

from vitrine.operators import catalogue as C
from vitrine.operators import digests as DIG
from vitrine.operators import places as PLC

PLACES = "city string, latitude double, longitude double, area string"


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return round(2 * PLC.KM * math.asin(math.sqrt(min(1.0, h))), 6)


def test_nearest_places_near_and_far(spark):
    rnd = random.Random(1)
    cities = [(f"c{i}", rnd.gauss(45, 4), rnd.gauss(10, 6), f"a{i % 3}") for i in range(300)] + [("pole", 90.0, 0.0, "n"), ("fiji", -18.0, 179.9, "f"), ("suva", -18.0, -179.9, "f"), ("twin b", 10.0, 10.0, "t"), ("twin a", 10.0, 10.0, "t"), ("nowhere", None, 1.0, "x")]
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(80)] + [(100 + i, rnd.gauss(45, 5), rnd.gauss(10, 8)) for i in range(80)]
    points += [(200, 10.0, 10.0), (201, 90.0, 77.0), (202, -90.0, 0.0), (203, -18.0, 180.0), (204, None, 1.0), (205, float("nan"), 1.0)]
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    for leaf in (8, 64, 1000):
        got = {r["id"]: (r["distance_km"], r["city"], r["area"]) for r in PLC.nearest_city(df, spark.createDataFrame(cities, PLACES), ("area",), leaf=leaf).collect()}
        want = {i: min((km(a, b, x, y), c, g) for c, x, y, g in cities if x is not None) for i, a, b in points if a is not None and not math.isnan(a)}
        assert got.keys() == want.keys()
        assert all(got[i][1:] == want[i][1:] and abs(got[i][0] - want[i][0]) < 2e-6 for i in want)
    assert PLC.nearest_city(df, spark.createDataFrame([], PLACES)).count() == 0


def snapshot(spark, files):
    return spark.createDataFrame([(p, s, m) for p, (s, m) in files.items()], "path string, size long, mtime long")


def test_digests_lead_to_the_changes(spark):
    rnd = random.Random(2)
    files = {f"/r/{a}/{b}/{i}.jpg": (rnd.randint(1, 9), 1) for a in "abc" for b in "xyz" for i in range(5)} | {"/r/top.jpg": (1, 1), "/other/q.jpg": (None, 2)}
    now = dict(files)
    del now["/r/a/x/0.jpg"]
    now |= {"/r/a/x/9.jpg": (3, 3), "/r/b/y/2.jpg": (files["/r/b/y/2.jpg"][0], 7), "/new/deep/n.jpg": (1, 1)}
    a, b = snapshot(spark, now), snapshot(spark, files)
    da, db = DIG.folder_digests(a), DIG.folder_digests(b)
    assert {r["folder"] for r in DIG.differing(da, db).collect()} == {"", "/r", "/r/a", "/r/a/x", "/r/b", "/r/b/y", "/new", "/new/deep"}
    assert {r["folder"] for r in DIG.visited(da, db).collect()} == {"", "/r", "/other", "/new", "/new/deep", "/r/a", "/r/b", "/r/c", *(f"/r/{x}/{y}" for x in "ab" for y in "xyz")}
    assert sorted(map(tuple, DIG.changes(a, b, da, db).collect())) == sorted(tuple(r) for r in C.snapshot_diff(a, b).collect() if r["state"] != "same")
    assert DIG.differing(db, DIG.folder_digests(snapshot(spark, files).repartition(5))).count() == 0
    swapped = {"/r/1.jpg": (2, 1), "/r/2.jpg": (1, 1)}
    other = {"/r/1.jpg": (1, 1), "/r/2.jpg": (2, 1)}
    assert DIG.differing(DIG.folder_digests(snapshot(spark, swapped)), DIG.folder_digests(snapshot(spark, other))).count() == 2


def test_innermost_scopes(spark):
    folders = ["/lib/a", "/lib/a/x/y", "/lib/a/x", "/lib//b/", "/lib/b/z", "/lib/ab", "", None, "C:\\Pics\\New", "/other"]
    scopes = [("/lib/", True), ("/lib/a/", True), ("/lib/a/x", False), ("/lib//b", False), ("c:/pics", True), ("", True), ("  ", True), (None, True)] + [(f"/many/{i}", True) for i in range(3000)]
    out = C.innermost_scope(spark.createDataFrame([(i, f) for i, f in enumerate(folders)], "id int, folder string"), spark.createDataFrame(scopes, "scope string, recursive boolean"))
    assert {r["id"]: r["scope"] for r in out.collect()} == {0: "/lib/a/", 1: "/lib/a/", 2: "/lib/a/x", 3: "/lib//b", 4: "/lib/", 5: "/lib/", 6: None, 7: None, 8: "c:/pics", 9: None}


def test_no_row_is_made_for_a_pair_of_point_and_place(spark):
    """Many places to a leaf and many points to a place: only those that may be the nearest leave a block."""
    rnd = random.Random(5)
    cities = [(f"c{i % 900}", rnd.uniform(-80, 80), rnd.uniform(-180, 180), "a") for i in range(3000)] + [(f"s{i}", 5.0, 5.0, "a") for i in range(2000)]
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(400)] + [(1000 + i, 5.0, 5.0) for i in range(50)]
    df, places = spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(cities, PLACES)
    out = PLC.nearest_city(df, places, ("area",), leaf=2000)
    got = {r["id"]: (r["distance_km"], r["city"]) for r in out.collect()}
    want = {i: min((km(a, b, x, y), c) for c, x, y, _ in cities) for i, a, b in points}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 2e-6 for i in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search(r"Aggregate \[id#[^\n]*\n[^\n]*(Project[^\n]*\n[^\n]*)?Join", plan)
