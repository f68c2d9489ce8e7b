"""Vector search in cells and the stored text index against brute force: bounds, skipping, upkeep, filters."""

import math
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import stems as ST
from vitrine.operators import balls as B
from vitrine.operators import search as Q
from vitrine.operators import store
from vitrine.operators.textindex import TextIndex

VECTORS = "id long, embedding array<double>, cell int, cos double"


def vectors(spark, x, more=()):
    return spark.createDataFrame([*((i, r.tolist(), 1, 2.0) for i, r in enumerate(x)), *((i, v, 1, 2.0) for i, v in more)], VECTORS)


def clustered(rnd, groups=12, each=60, dims=8, width=0.05):
    c = rnd.randn(groups, dims)
    return np.concatenate([m + width * rnd.randn(each, dims) for m in c])


def brute(x, q, limit, least=-2.0, allowed=None):
    u = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    s = u @ (q / (np.linalg.norm(q) or 1))
    rows = sorted((-round(float(v), 9), i) for i, v in enumerate(s) if v >= least - 1e-12 and (allowed is None or i in allowed))
    return rows[:limit] if limit else rows


def got(df):
    return [(-round(r["similarity"], 9), r["id"]) for r in df.collect()]


def test_search_skips_far_cells_and_finds_the_same(spark):
    rnd = np.random.RandomState(1)
    x = clustered(rnd)
    x = np.concatenate([x, np.zeros((3, 8)), x[:4]])  # zero vectors and repeats, which tie
    odd = [(5000, None), (5001, [1.0]), (5002, [float("nan")] * 8), (5003, [None] + [1.0] * 7), (5004, [float("inf")] * 8), (5005, [])]
    cells = B.cells_of(vectors(spark, x, odd), rows=40)
    assert cells.size.sum() == len(x) and len(cells.cell) > 10
    for q in (x[0], x[200], -x[3], rnd.randn(8)):
        for limit, least in ((5, None), (70, None), (0, 0.9), (25, 0.2), (2000, None)):
            df, report = B.search(cells, q.tolist(), limit, least)
            assert sorted(got(df)) == brute(x, q, limit, -2 if least is None else least)
    _, report = B.search(cells, x[0].tolist(), 5)
    assert report["cells_read"] < report["cells"] and report["vectors_in_cells_read"] < len(x) / 2
    allowed = spark.createDataFrame([(i,) for i in range(300, 700)], "id long")
    assert got(B.search(cells, x[0].tolist(), 9, allowed=allowed)[0]) == brute(x, x[0], 9, allowed=range(300, 700))
    assert got(B.search(cells, [0.0] * 8, 3)[0]) == [(0.0, 0), (0.0, 1), (0.0, 2)]
    assert B.search(cells, [1.0, 2.0], 3)[0].count() == 0 and B.search(B.cells_of(vectors(spark, x).limit(0)), x[0].tolist(), 3)[0].count() == 0


@pytest.mark.parametrize("width,least", [(0.05, 0.9), (3.0, 0.5), (3.0, -0.2)])
def test_joins_skip_far_blocks_and_find_the_same(spark, width, least):
    rnd = np.random.RandomState(2)
    x = np.concatenate([clustered(rnd, width=width, each=30), np.zeros((2, 8))])
    cells = B.cells_of(vectors(spark, x), rows=16)
    u = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    s = u @ u.T
    df, report = B.joined(cells, cells, least, rows=16, upper=True)
    pairs = [(r["a"], r["b"]) for r in df.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least}
    assert report["block_pairs_joined"] < report["block_pairs"] / 2 or width > 1
    half = len(x) // 2
    left, right = (B.cells_of(vectors(spark, x).where(w), rows=16) for w in (f"id < {half}", f"id >= {half}"))
    df, _ = B.joined(left, right, least, rows=16)
    assert Counter((r["a"], r["b"]) for r in df.collect()) == Counter((i, j) for i in range(half) for j in range(half, len(x)) if s[i, j] >= least)


def test_components(spark):
    rnd = np.random.RandomState(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rnd.randint(200, 260, (40, 2))] + [(7, 7), (8, 8), (8, 9), (300, 301), (300, 301)]
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    out = Q.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(up) and {r["id"]: r["component"] for r in out} == {n: root(n) for n in up}
    assert Q.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --------------------------------------------------------------------------- text


FIELDS = ("title", "text")
DOCS = "id long, title string, text string, score double, docs int"


def bm25(docs, words, weights=(1.0, 1.0), stem=False, every=False):
    f, length = {}, {}
    for i, fields in docs.items():
        own = [ST.terms_of(t, stem) for t in fields]
        length[i] = sum(map(len, own))
        f[i] = Counter()
        for t, w in zip(own, weights):
            for x in t:
                f[i][x] += w
    words = {t for w in words for t in ST.terms_of(w, stem)}
    n, mean, out = len(docs), sum(length.values()) / len(docs), {}
    for i in docs:
        if (all if every else any)(f[i][w] for w in words):
            s = 0.0
            for w in words:
                k = sum(f[j][w] > 0 for j in docs)
                s += max(1e-6, math.log((n - k + 0.5) / (k + 0.5))) * f[i][w] * 2.2 / (f[i][w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) if k else 0.0
            out[i] = round(s, 12)
    return sorted(((-s, i) for i, s in out.items()))


def found(df):
    return [(-r["score"], r["id"]) for r in df.collect()]


def frame(spark, docs):
    return spark.createDataFrame([(i, *t, 1.0, 2) for i, t in docs.items()], DOCS)


def new_index(spark, **more):
    return TextIndex(spark, store.fresh_path(spark, f"test-{uuid.uuid4().hex}"), FIELDS, **more)


def test_terms_and_stems(spark):
    assert ST.terms_of("Crème BRÛLÉE, l'œuf n°3 Ångström über_ÑANDÚ") == ["creme", "brulee", "l", "œuf", "n", "3", "angstrom", "uber", "nandu"]
    assert ST.terms_of(None) == ST.terms_of("") == [] and ST.terms_of("Licensed LICENSES", True) == ["licens", "licens"]
    index = new_index(spark, stem=True, weights=(3.0, 1.0))
    docs = {1: ("Licenses for the café", ""), 2: ("x", "licensed, licensed"), 3: (None, "the CAFE"), 4: (None, None), 5: ("", "")}
    index.upsert(frame(spark, docs))
    for words in (["license"], ["licensing cafés"], ["nothing"], []):
        for every in (False, True):
            assert found(index.search(words, 0, every)[0]) == (bm25(docs, words, (3.0, 1.0), True, every) if words else [])


def test_best_documents_without_reading_all_regions(spark):
    rnd = np.random.RandomState(5)
    docs = {i: (f"t{i % 7}", " ".join(f"w{int(k)}" for k in rnd.zipf(1.4, int(rnd.randint(1, 200))) if k < 500)) for i in range(1500)}
    docs |= {2000 + i: ("same", "w1 w2 rare") for i in range(30)}  # equal documents tie
    index = new_index(spark, region=50)
    index.upsert(frame(spark, docs))
    for words, every in ((["w1", "w5"], False), (["rare"], False), (["w1", "w2", "t3"], True), (["w400", "w2"], False), (["absent", "w7"], False), (["absent", "w7"], True)):
        want = bm25(docs, words, every=every)
        for limit in (10, 100, 0):
            assert found(index.search(words, limit, every, first=2)[0]) == (want[:limit] if limit else want)
    _, report = index.search(["rare", "w2"], 10, first=2)
    assert report["regions_read"] < report["regions"]
    some = spark.createDataFrame([(i,) for i in range(0, 1500, 3)], "id long")
    assert found(index.search(["w1", "w5"], 20, allowed=some, first=2)[0]) == [x for x in bm25(docs, ["w1", "w5"]) if x[1] % 3 == 0 and x[1] < 1500][:20]


def test_upkeep_equals_a_rebuild(spark):
    rnd = np.random.RandomState(6)
    text = lambda: (f"t{rnd.randint(5)}", " ".join(f"w{k}" for k in rnd.randint(0, 20, rnd.randint(0, 12))))
    index, docs = new_index(spark, region=8), {}
    assert index.search(["w1"])[0].count() == 0 and index.merge() == []
    for step in range(4):
        new = {int(i): text() for i in rnd.choice(60, 25, replace=False)}
        docs |= new
        index.upsert(frame(spark, new))
        gone = [int(i) for i in rnd.choice(80, 9, replace=False)]
        docs = {i: t for i, t in docs.items() if i not in gone}
        index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        if step % 2:
            assert index.merge()
        for words in (["w1", "t2"], ["w3"]):
            assert found(index.search(words, 0)[0]) == bm25(docs, words) and found(index.search(words, 7, first=1)[0]) == bm25(docs, words)[:7]
    index.merge(factor=100)
    state = index._state()
    assert len(state["live"]) == 1 and state["live"] == state["log"] and index._dead(state).count() == 0
    assert found(index.search(["w2", "t1"], 0)[0]) == bm25(docs, ["w2", "t1"])


def test_an_index_follows_its_files(spark, tmp_path):
    at, made = f"file://{tmp_path}/t.parquet", []
    spark.range(3).write.parquet(at)
    get = lambda: store.once(spark.read.parquet(at), str(tmp_path), lambda: made.append(1) or len(made))
    assert (get(), get()) == (1, 1)
    spark.range(5).write.mode("overwrite").parquet(at)
    assert (get(), get()) == (2, 2)


def test_regions_are_inverted_where_they_lie(spark, tmp_path):
    """Documents travel once, with their terms as they are: no row for each term of a document is shuffled; regions hold few postings."""
    from vitrine.operators import textindex as T

    docs = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 40)), None) for i in range(300)] + [(1000, None, None), (1001, "", "w1 w1 w1")]
    index = T.TextIndex(spark, f"file://{tmp_path}/x", ("a", "b"), region=50)
    index.upsert(spark.createDataFrame(docs, "id long, a string, b string"))
    p = spark.read.parquet(f"{tmp_path}/x/postings")
    got = {(r["term"], d["id"], d["f"], d["length"]) for r in p.collect() for d in r["docs"]}
    words = {i: f"{a or ''} {b or ''}".split() for i, a, b in docs}
    assert got == {(w, i, float(ws.count(w)), len(ws)) for i, ws in words.items() for w in ws}
    assert all((r["most"], r["least"], r["n"]) == (max(d["f"] for d in r["docs"]), min(d["length"] for d in r["docs"]), len(r["docs"])) for r in p.collect())
    assert len({(r["range"], r["piece"]) for r in p.collect()}) > 3
    assert T._inverted and T.ROWS <= 1000


def test_forests_keep_the_components_of_all_pairs(spark):
    from vitrine.operators import balls as B
    from vitrine.operators import search as Q

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.25 * r.normal(size=16)).tolist()) for i in range(600)] + [(1000 + i, r.normal(size=16).tolist()) for i in range(40)] + [(2000, [0.0] * 16), (2001, None)]
    cells = B.cells_of(spark.createDataFrame(rows, "id long, embedding array<double>"), 100)
    all_, some = (B.joined(cells, cells, 0.8, upper=True, linked=linked)[0] for linked in (False, True))
    assert sorted(map(tuple, Q.components(some).collect())) == sorted(map(tuple, Q.components(all_.select("a", "b")).collect()))
    assert some.count() < all_.count() / 4
    for n in (0, 1, 50):
        a, b = r.integers(0, 40, n), r.integers(0, 40, n)
        x, y = B.forest(a, b)
        assert len(x) == len(set(y.tolist())) and (x < y).all()


def test_blocks_travel_once_for_each_tile(spark):
    from vitrine.operators import balls as B

    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).tolist()) for i in range(500)]
    x = np.array([v for _, v in rows])
    s = (x / np.linalg.norm(x, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    cells = B.cells_of(spark.createDataFrame(rows, "id long, embedding array<double>"), 60)
    out, report = B.joined(cells, cells, 0.7, 20, upper=True)
    assert {(p["a"], p["b"]) for p in out.collect()} == {(i, j) for i in range(500) for j in range(i + 1, 500) if s[i, j] >= 0.7}
    assert out.select("a", "b").distinct().count() == out.count() and report["block_pairs_joined"] > 4 * B.TILE


def test_a_write_moves_terms_only_of_what_goes(spark, tmp_path):
    """Terms are stored flat; what a write replaces is found by ids, and its own terms are counted in its postings."""
    from vitrine.operators import textindex as T

    index = T.TextIndex(spark, f"file://{tmp_path}/x", ("a",))
    index.upsert(spark.createDataFrame([(1, "b a a"), (2, ""), (3, None), (4, "b c")], "id long, a string"))
    docs = spark.read.parquet(f"{tmp_path}/x/docs")
    assert not [f.name for f in docs.schema if f.dataType.typeName() in ("array", "struct")]
    assert {(r["id"], r["length"], r["n"], r["words"], tuple(np.frombuffer(r["f"]))) for r in docs.collect()} == {(1, 3, 2, "b a", (1.0, 2.0)), (2, 0, 0, "", ()), (3, 0, 0, "", ()), (4, 2, 2, "b c", (1.0, 1.0))}
    index.delete(spark.createDataFrame([(99,)], "id long"))
    index.upsert(spark.createDataFrame([(4, "c"), (2, "")], "id long, a string"))
    stats = lambda: {r["term"]: (r["df"], r["length"]) for r in index._stats(index._state()).groupBy("term").sum("df", "length").toDF("term", "df", "length").collect() if r["df"]}
    want = {None: (4, 4), "a": (1, 0), "b": (1, 0), "c": (1, 0)}
    assert stats() == want and {r["df"] for r in spark.read.parquet(f"{tmp_path}/x/stats/seg=3").where("term = 'b'").collect()} == {-1}
    assert not (tmp_path / "x/stats/seg=2").exists()
    index.merge(factor=100)
    assert stats() == want


def test_ranges_of_lengths_by_halving(spark):
    from vitrine.operators import textindex as T

    for borders in ([], [3], [0, 4], [1, 2, 3], list(range(0, 40, 3)), list(range(0, 2046, 2))):
        d = spark.range(-1, 60).unionByName(spark.range(2000, 2060)).withColumn("below", T._below(borders, F.col("id")))
        assert all(r["below"] == sum(b < r["id"] for b in borders) for r in d.collect()) and d.schema["below"].dataType.typeName() == "integer"
