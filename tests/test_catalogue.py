"""Operators on small fixtures, and every query with a SQL twin at the smallest size."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.functions import dates as D
from vitrine.functions import metadata as M
from vitrine.functions import paths as P
from vitrine.functions import predicates as PR
from vitrine.functions import scalars as S
from vitrine.functions import stems as ST
from vitrine.functions import vectors as V
from vitrine.operators import catalogue as C
from vitrine.operators import coverage as COV
from vitrine.operators import geometry as G
from vitrine.operators import ingest as I
from vitrine.operators import people as PPL
from vitrine.operators import search as Q
from vitrine import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in tuple("iufb") else str(v)


def rows(df):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(c.execute(plans.ORACLE_SQL[name]).df())


DATES = [
    ("2009-02-07 trip", "2009-02-07", None, "day"), ("IMG_20200306_185130", "2020-03-06", None, "day"), ("summer 1999 best", "1999", None, "year"),
    ("1994-09 lake", "1994-09", None, "month"), ("1992-1998", "1992", "1998", "year"), ("1992 - 1998", "1992", "1998", "year"), ("1982--91", "1982", "1991", "year"),
    ("1982 -- 91", "1982", "1991", "year"), ("1997-01-15 -- 18", "1997-01-15", "1997-01-18", "day"), ("2009-02-07 -- 03-14", "2009-02-07", "2009-03-14", "day"),
    ("2009-02-07 -- 2009-03-01", "2009-02-07", "2009-03-01", "day"), ("2009-02-07 - 2009-03-01", "2009-02-07", "2009-03-01", "day"), ("1998--03", "1998", "2003", "year"),
    ("1998-1992", "1998", None, "year"), ("2009-02-07 -- 9", "2009-02-07", "2009-02-09", "day"), ("2009-02-07 -- 2009-13-01", "2009-02-07", None, "day"), ("no date", None, None, None), ("", None, None, None),
]


def test_dates_in_names(spark):
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(DATES)], "id int, name string")
    for r in d.select("id", D.date_in(F.col("name")).alias("p")).collect():
        _, start, end, precision = DATES[r["id"]]
        assert (r["p"] and (r["p"]["start"], r["p"]["end"], r["p"]["precision"])) == ((start, end, precision) if start else None)


def test_titles(spark):
    want = {"IMG_1234.jpg": None, "3 cats.jpg": "3 cats", "garden 1.png": "garden", "scan 12.tif": None, "sea_side.jpg": "sea_side", "DSC_0001 harbour.jpg": "harbour", "a.b.c": "a.b", ".hidden": "hidden", "1999": None}
    d = spark.createDataFrame([(k,) for k in want], "name string")
    assert {r[0]: r[1] for r in d.select("name", P.display_title(F.col("name"))).collect()} == want
    only = {r[0] for r in d.where(P.only_camera_id(F.col("name"))).collect()}
    assert only == {"IMG_1234.jpg", "scan 12.tif"}


def test_fusion(spark):
    a = spark.createDataFrame([("piano", 1), ("dress", 2), ("full", 3)], "id string, rank int")
    b = spark.createDataFrame([("full", 1), ("dress", 2), ("other", 3)], "id string, rank int")
    out = Q.fuse([a, b]).collect()
    assert [r["id"] for r in out[:2]] == ["full", "dress"]
    assert math.isclose(out[0]["score"], 1 / 63 + 1 / 61)


def test_cosine_of_a_zero_vector_and_other_lengths(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, None]


def test_stems_are_porters():
    want = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit vietnamization:vietnam hopefulness:hope sensibiliti:sensibl triplicate:triplic formalize:formal electrical:electr goodness:good revival:reviv adjustable:adjust replacement:replac adoption:adopt homologous:homolog probate:probat rate:rate cease:ceas controll:control roll:roll licenses:licens licensed:licens"
    for pair in want.split():
        word, stem = pair.split(":")
        assert ST.stem(word) == stem


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    x = np.random.RandomState(1).randn(70, 5)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, [0.0] * 5), (101, None)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if u[i] @ u[j] >= 0.5}
    assert {(r["a"], r["b"]) for r in Q.similar_pairs(d, 0.5, rows=9).collect()} == want
    assert {(r["a"], r["b"]) for r in Q.similar_across(d.where("id < 20"), d.where("id >= 20"), 0.5, rows=9).collect()} == {(i, j) for i, j in want if i < 20 <= j}
    assert Q.similar_pairs(d.where("id < 0"), 0.5).count() == 0


def test_metadata_keeps_what_it_does_not_know():
    old = {"title": "T", "number_of_people": 2, "unknown": {"a": [1]}, "photo_estetic_quality": 7, "star_rating_1_5": 3}
    n = M.normal(old)
    assert n["image_analysis"]["title"] == "T" and n["people"]["vlm_analysis"]["number_of_people"] == 2 and n["unknown"] == {"a": [1]} and "star_rating_1_5" not in n
    m = M.merge(n, {"image_analysis": {"title": "U"}, "people": {"vlm_analysis": {"has_children": True}}, "unknown": 5})
    assert m["image_analysis"]["title"] == "U" and m["image_analysis"]["photo_estetic_quality"] == 7 and m["people"]["vlm_analysis"]["number_of_people"] == 2 and m["unknown"] == 5
    assert M.normal(None) == {"schema_version": "2.0"} and M.normal(n) == n
    assert M.normal({"schema_version": "2.0", "provenance": {"metadata_version": "m"}})["metadata_version"] == "m"


def test_small_columns(spark):
    d = spark.createDataFrame([("[1, 2.5, 3e1]",), ('[1, "x"]',), ("[1, null]",), ("{}",), (None,)], "v string")
    assert [r[0] for r in d.select(V.parse(F.col("v"))).collect()] == [[1.0, 2.5, 30.0], None, None, None, None]
    docs = ['{"schema_version":"2.0","file_data":{"metadata_extracted_at":"t"},"own":1,"people":{}}', '{"title":"T","own":"x","camera":"c"}', '{"provenance":{"metadata_extracted_at":"p"}}', None, "broken"]
    m = spark.createDataFrame([(t,) for t in docs], "d string").select(M.extracted_at(F.col("d")).alias("at"), M.extras(F.col("d")).alias("more")).collect()
    assert [r["at"] for r in m] == ["t", None, "p", None, None]
    assert [dict(r["more"]) if r["more"] is not None else None for r in m][:3] == [{"own": "1"}, {"own": "x", "camera": "c"}, {}]
    a = spark.createDataFrame([(1.25,), (1.255,), (None,), (3.0,)], "a double")
    assert [r[0] for r in a.select(S.many_digits(F.col("a"))).collect()] == [False, True, False, False]


def test_quick_filter_edges():
    f = PR.QuickFilter(people="none", years=(None, 1999), location="  Rome ")
    assert f.active() == 3 and f.search_range() == {"event_date_end": "1999-12-31", "location_query": "Rome"}
    assert D.month_bound("2024-02", True) == "2024-02-29T23:59:59.999Z" and D.month_bound("2024-13", True) is None and D.month_bound("2024", False) == "2024-01-01"
    assert D.day_bound("2023-02", True) == "2023-02-28" and D.day_bound("2023-02-05", True) == "2023-02-05" and D.day_bound("x", False) is None


def test_stale_rules(spark):
    side = "content_hash string, width int, height int, orientation int, byte_size long, mtime long"
    cases = [((None, 1, 1, 1, 5, 5), ("h", 2, 1, 1, 6, 6), False), (("h", 1, 1, 1, 5, 5), (None, 1, 1, 1, 5, 5), True), (("h", 1, 1, 1, 5, 5), ("g", 1, 1, 1, 9, 9), False), (("h", 1, 1, 1, 5, 5), ("g", 1, 2, 1, 5, 5), True), ((None, 1, 1, 1, 5, 5), (None, 1, 1, 1, 6, 5), True), ((None, 1, None, 1, 5, 5), (None, 1, None, 1, 5, 5), False)]
    for a, b, want in cases:
        old, new = spark.createDataFrame([a], side).alias("old"), spark.createDataFrame([b], side).alias("new")
        assert old.crossJoin(new).select(I.stale("old", "new")).first()[0] == want


def test_observed_files(spark):
    columns = "id long, path string, volume_id string, file_id long, fingerprint string, strong_hash string, deleted_at string, duplicate_group string"
    known = spark.createDataFrame([(1, "/a/x", "v", 11, "1:1", "h1", None, None), (2, "/a/y", "v", 12, "2:2", "h2", None, "dup:h2"), (3, "/b/z", "v", 13, "3:3", "h2", None, "dup:h2"), (4, "/a/old", "v", 14, "9:9", "h9", "2026-02-28", None)], columns)
    files = spark.createDataFrame([("/a/moved", "v", 11, "1:1", "h2"), ("/a/back", "v", 99, "9:9", "h9"), ("/a/new", "v", 77, "7:7", "h7")], "path string, volume_id string, file_id long, fingerprint string, strong_hash string")
    got = {(r["id"], r["path"]): (r["deleted_at"], r["duplicate_group"]) for r in I.observed(known, files, "/a", "2026-02-27", "now").collect()}
    assert got == {(1, "/a/moved"): (None, "dup:h2"), (2, "/a/y"): ("now", None), (3, "/b/z"): (None, "dup:h2"), (4, "/a/back"): (None, None), (None, "/a/new"): (None, None)}


def test_albums_keep_positions_and_move(spark):
    m = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "album_id long, item_id long, position int")
    added = spark.createDataFrame([(1, 11, 1), (1, 13, 2), (1, 14, 1), (2, 5, 1)], "album_id long, item_id long, nth int")
    got = {(r["album_id"], r["item_id"]): r["position"] for r in I.album_with(m, added).collect()}
    assert got == {(1, 10): 0, (1, 11): 1, (1, 12): 2, (1, 14): 3, (1, 13): 4, (2, 5): 0}
    moved = I.album_moved(m, spark.createDataFrame([(1, 12, 10)], "album_id long, item_id long, before_id long"))
    assert [r["item_id"] for r in moved.orderBy("position").collect()] == [12, 10, 11]


def test_faces_keep_their_tags(spark):
    box = "image long, id long, tag_id long, x1 double, y1 double, x2 double, y2 double"
    old = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 10.0, 10.0), (1, 2, None, 50.0, 50.0, 60.0, 60.0), (1, 3, 8, 80.0, 80.0, 90.0, 90.0)], box)
    new = spark.createDataFrame([(1, 101, 1.0, 0.0, 11.0, 10.0), (1, 102, 20.0, 20.0, 30.0, 30.0)], "image long, id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["id"], r["new_id"], r["tag_id"], r["state"]) for r in I.redetected_faces(old, new).collect()}
    assert got == {(1, 101, 7, "updated"), (2, None, None, "deleted"), (3, None, 8, "kept"), (None, 102, None, "new")}


def test_nearest_city_over_the_date_line_and_far_away(spark):
    cities = spark.createDataFrame([("a", 0.0, 179.9), ("b", 0.0, 170.0), ("c", 60.0, 0.0)], "city string, latitude double, longitude double")
    points = spark.createDataFrame([(1, 0.0, -179.9), (2, -80.0, 10.0), (3, 60.1, 0.1), (4, None, 1.0)], "id long, latitude double, longitude double")
    got = {r["id"]: r["city"] for r in COV.nearest_city(points, cities).collect()}
    far = lambda lat, lon, la, lo: math.acos(max(-1, min(1, math.sin(math.radians(lat)) * math.sin(math.radians(la)) + math.cos(math.radians(lat)) * math.cos(math.radians(la)) * math.cos(math.radians(lon - lo)))))
    assert got == {1: "a", 2: min("abc", key=lambda c: far(-80.0, 10.0, *{"a": (0.0, 179.9), "b": (0.0, 170.0), "c": (60.0, 0.0)}[c])), 3: "c"}


def test_turns_undo_each_other(spark):
    d = spark.createDataFrame([(a,) for a in (90, 180, 270)], "a int")
    box = F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(5.0).alias("width"), F.lit(7.0).alias("height"))
    w, h = F.lit(100.0), F.lit(60.0)
    size = G.turned_size(w, h, F.col("a"))
    back = G.turned(G.turned(box, w, h, F.col("a")), size["width"], size["height"], 360 - F.col("a"))
    assert {tuple(r[0]) for r in d.select(back).collect()} == {(10.0, 20.0, 5.0, 7.0)}
    points = F.array(F.array(F.lit(3.0), F.lit(4.0)))
    there = G.turned_points(points, w, h, F.col("a"))
    assert {tuple(r[0][0]) for r in d.select(G.turned_points(there, w, h, F.col("a"), back=True)).collect()} == {(3.0, 4.0)}


def test_five_points_of_98_and_decoded_boxes(spark):
    flat = [float(v) for p in range(98) for v in (p, 2 * p)]
    r = spark.createDataFrame([(flat,), (flat[:10],)], "p array<double>").select(G.five_of_98(F.col("p"))).collect()
    assert r[0][0] == [[63.5, 127.0], [71.5, 143.0], [54.0, 108.0], [76.0, 152.0], [82.0, 164.0]] and r[1][0] is None
    d = spark.createDataFrame([(0.5, 0.5, 0.2, 0.4, [1.0, 0.0, 0.0, 0.0], [0.0] * 10)], "cx double, cy double, w double, h double, d array<double>, p array<double>")
    out = d.select(G.decoded_box(F.col("d")).alias("b"), G.decoded_points(F.col("p")).alias("p")).first()
    assert [round(v, 6) for v in out["b"]] == [0.42, 0.3, 0.62, 0.7] and out["p"] == [[0.5, 0.5]] * 5


def test_marks_and_tags(spark):
    tags = spark.createDataFrame([(1, "bea", False), (2, "Al", False), (3, "cy", True)], "tag_id long, name string, pinned boolean")
    faces = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 2)], "id long, item_id long, tag_id long")
    c = PPL.tag_counts(tags, faces)
    assert [r["tag_id"] for r in PPL.tag_options(c, 3, 2).orderBy("place").collect()] == [3, 1]
    assert [r["name"] for r in PPL.tag_search(c, " A ").collect()] == ["Al", "bea"]
    assert {r["tag_id"] for r in PPL.visible_tags(c.withColumn("pinned", F.lit(False)), [], [2], top=1).collect()} == {1, 2}


def test_moves_pair_by_name_and_size(spark):
    old = spark.createDataFrame([("/a/x.jpg", 100)], "path string, size long")
    assert C.moves(old, spark.createDataFrame([("/b/X.jpg", 100)], "path string, size long")).collect()[0]["new_path"] == "/b/X.jpg"
    assert C.moves(old, spark.createDataFrame([("/b/x.jpg", 200)], "path string, size long")).count() == 0


def test_moves_by_hash_look_at_the_first_candidate_only(spark):
    rows = "path string, size long, strong_hash string"
    old = spark.createDataFrame([("/a/x", 1, "h1"), ("/b/x", 1, "h2"), ("/c/x", 1, "h3"), ("/a/y", None, "h")], rows)
    new = spark.createDataFrame([("/n/X", 1, "h2"), ("/o/x", 1, "h1"), ("/p/x", 1, "h3"), ("/n/y", None, "h")], rows)
    assert {(r[0], r[1]) for r in C.moves_by_hash(old, new).collect()} == {("/b/x", "/n/X")}


def test_suppression_is_strict_and_keeps_the_best(spark):
    boxes = [(1, 1, 0.0, 0.0, 9.0, 9.0, 0.9), (1, 2, 0.0, 0.0, 9.0, 9.0, 0.8), (1, 3, 50.0, 50.0, 59.0, 59.0, 0.1), (2, 1, 0.0, 0.0, 9.0, 9.0, 0.5)]
    d = spark.createDataFrame(boxes, "image long, id long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted((r["image"], r["id"]) for r in G.suppress(d, 0.5).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_ages(spark):
    d = spark.createDataFrame([("2000-06-15", "2020-06-15"), ("2000-06-16", "2020-06-15"), ("2021-01-01", "2020-06-15"), (None, "2020-06-15")], "b string, d string")
    assert [r[0] for r in d.select(S.age_at(F.col("b"), F.col("d"))).collect()] == [20, 19, None, None]


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_counters_of_cameras_are_no_years(spark):
    names = {"IMG_2001": None, "dsc_1999": None, "PANO-1850 pier": None, "pier_2001": "2001", "IMG_1 2001": "2001", "BIMG_2001": "2001", "IMG_20200306": "2020-03-06", "2001": "2001"}
    d = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r[0]: r[1] for r in d.select("name", D.date_in(F.col("name"))["start"]).collect()} == names


def test_a_path_is_read_once_for_its_date(spark):
    d = spark.createDataFrame([("C:\\a\\1994-09 lake\\sub\\IMG_20200306.JPG", None), ("/x/misc (2002)/y.jpg", "2009"), (None, None), ("C:\\", "1999")], "path string, taken string")
    e = d.select(D.event_date(F.col("taken"), F.lit("year"), D.date_in_path(F.col("path"))["date"], F.lit(False), F.lit("2020-01-01")).alias("e"))
    assert [(r[0]["start"], r[0]["source"]) for r in e.collect()] == [("2020-03-06", "path_script"), ("2002", "path_script"), ("2020-01-01", "file_mtime"), ("1999", "xmp")]
    assert sum(e._jdf.queryExecution().optimizedPlan().toString().count(f"{f}(") for f in ("regexp_extract", "RLIKE")) < 400  # no part of a path is read once for each use


def test_albums_of_odd_members_are_dealt_once(spark):
    """Repeated members, unknown and deleted items, null items and places; members are shuffled by album once, unaggregated."""
    members = spark.createDataFrame([(1, 10, 5), (1, 10, 2), (1, 11, 3), (1, None, 1), (1, 99, 0), (2, None, 1), (3, 12, None), (3, 11, None), (4, 13, 1)], "album_id long, item_id long, position int")
    items = spark.sql("select cast(id as bigint) as id, taken, deleted_at from values (10, '2020', null), (11, '2022', null), (12, null, null), (13, '2023', '2026'), (null, '2030', null) as t(id, taken, deleted_at)")
    df = C.albums(members, items)
    assert sorted(map(tuple, df.collect())) == [(1, 3, "2022", 10), (2, 0, None, None), (3, 2, "2022", 11), (4, 1, None, None)]
    assert str(df._jdf.queryExecution().executedPlan().toString()).split("== Initial Plan ==")[-1].count("hashpartitioning(album_id") == 1


def test_documents_are_merged_a_few_at_a_time(spark, monkeypatch):
    """A batch stays in Arrow; only a slice of it is objects, and results keep their rows, nulls among them."""
    import pyarrow as pa

    taken = []

    class Column:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, i, n):
            taken.append(len(self.a.slice(i, n)))
            return self.a.slice(i, n)

    a = pa.array([None if i % 7 == 0 else str(i) for i in range(1000)])
    assert M._in_slices(lambda x: x and x + "!", Column(a)).to_pylist() == [x and x + "!" for x in a.to_pylist()]
    assert max(taken) <= 256 and sum(taken) == 1000
    assert M._in_slices(lambda x: x, a.slice(0, 0)).to_pylist() == []
    d = spark.range(600).selectExpr("id", "case when id % 5 > 0 then concat('{\"a\":', id, '}') end as x", "case when id % 3 > 0 then '{\"b\":1}' else '{' end as y")
    got = {r["id"]: r["m"] for r in d.select("id", M.merged("x", "y").alias("m")).collect()}
    assert got == {r["id"]: M._dump(M.merge(M._load(r["x"]), M._load(r["y"]))) for r in d.collect()}
