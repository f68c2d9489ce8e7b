"""Greedy choices by rounds over grid cells against the same within tasks, and against a large image's brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.operators import geometry as G

BOXES = "image int, id long, x1 double, y1 double, x2 double, y2 double, score double"


def boxes(spark, seed, n, span, sides=(1, 30)):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = rnd.uniform(-span, span), rnd.uniform(-span, span), rnd.uniform(*sides), rnd.uniform(*sides)
        out.append((i % 3, i, x, y, x + w, y + h, None if i % 50 == 7 else rnd.randint(0, 20) / 20))
    out += [(0, n + i, 5.0, 5.0, 15.0, 15.0, 0.5) for i in range(15)] + [(1, n + 100, 3.0, 3.0, 3.0, 3.0, 0.9), (1, n + 101, 9.0, 9.0, 2.0, 2.0, 0.9)]  # copies, a point, a box inside out
    return spark.createDataFrame(out, BOXES)


def rows(df):
    return sorted(tuple(r) for r in df.select("image", "id").collect())


@pytest.mark.parametrize("threshold,sides", [(0.3, (1, 30)), (0.05, (0.5, 200)), (0.9, (8, 10))])
def test_suppression_by_rounds(spark, threshold, sides):
    b = boxes(spark, 1, 130, 45, sides)
    want = rows(G.suppress(b, threshold, small=10**6))
    assert rows(G.suppress_by_rounds(b, threshold)) == want and rows(G.suppress(b, threshold, small=45)) == want
    assert G.suppress_by_rounds(b.limit(0), threshold).count() == 0


@pytest.mark.parametrize("threshold,sides", [(0.3, (5, 30)), (0.05, (0.5, 100))])
def test_matching_by_rounds(spark, threshold, sides):
    old, new = boxes(spark, 2, 90, 30, sides), boxes(spark, 3, 90, 30, sides)
    pairs = lambda small: sorted((r["image"], r["old_id"], r["new_id"], round(r["iou"], 9)) for r in G.greedy_match(old, new, threshold, small).collect())
    assert pairs(10**6) == pairs(0) and pairs(0)


def test_suppression_of_a_very_large_image(spark):
    rnd = np.random.RandomState(4)
    n = 40_000
    x, y, score = rnd.randint(0, 2500, n), rnd.randint(0, 2500, n), rnd.randint(0, 1000, n)
    frame = spark.range(n).toPandas()
    frame["image"], frame["x1"], frame["y1"] = 1, x.astype(float), y.astype(float)
    frame["x2"], frame["y2"], frame["score"] = frame["x1"] + 40, frame["y1"] + 30, score / 1000
    got = {r["id"] for r in G.suppress(spark.createDataFrame(frame), 0.3).collect()}
    order, kept, grid = np.lexsort((np.arange(n), -score)), [], {}
    for i in order:  # brute force with the help of a coarse grid, as all boxes are 40 x 30
        cell = (x[i] // 41, y[i] // 31)
        near = [j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in grid.get((cell[0] + a, cell[1] + b), ())]
        w = [max(0, 41 - abs(int(x[i]) - int(x[j]))) * max(0, 31 - abs(int(y[i]) - int(y[j]))) for j in near]
        if not any(v / (2 * 41 * 31 - v) > 0.3 for v in w):
            kept.append(int(i))
            grid.setdefault(cell, []).append(i)
    assert got == set(kept)


def _plan(df, kind="optimizedPlan"):
    return str(getattr(df._jdf.queryExecution(), kind)().toString())


def test_face_votes_need_no_function_per_row(spark):
    """Points in columns are read as they are; missing, short and null points have no vote."""
    d = spark.createDataFrame([(1, 10.0, 2.0), (2, None, 2.0), (3, -10.0, 2.0)], "id int, x double, y double")
    p = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array("x", "y"), F.array("x"), F.array("x"))
    df = d.select("id", G.face_vote(p, F.lit(0.5)).alias("v")).select("id", "v.orientation", "v.confidence")
    assert "lambda" not in _plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, "rotated_270_cw", 0.5), (2, None, None), (3, "rotated_90_cw", 0.5)]
    short = [F.slice(p, 1, 4), F.array(*[F.array("x")] * 5), F.lit(None).cast("array<array<double>>")]
    assert d.where("id = 1").select(*[G.face_vote(s, F.lit(0.5)).isNull() for s in short]).first() == (True, True, True)


def test_images_of_few_boxes_are_settled_together(spark):
    """Without a large image boxes aren't read again to set some aside, and groups of a batch are settled in one call."""
    b = boxes(spark, 5, 200, 40).withColumn("image", F.col("id").cast("int") % 40)
    assert "Join" not in _plan(G.suppress(b, 0.3))
    calls = spark.sparkContext.accumulator(0)

    def first(frame, group):
        calls.add(1)
        return np.flatnonzero(np.append(True, group[1:] != group[:-1]))

    got = G._taken_by_group(b, "image", ["id"], first).collect()
    assert len(got) == len({r["image"] for r in got}) == b.select("image").distinct().count()
    assert calls.value <= 2 * spark.sparkContext.defaultParallelism


def test_sides_that_lie_by_image_meet_as_they_lie(spark):
    """Boxes numbered within their images are dealt by image once: their two sides share that shuffle, the pairs have the other."""
    n = F.row_number().over(W.partitionBy("image").orderBy("x1", "y1", "id"))
    b = boxes(spark, 6, 200, 40).withColumn("id", n)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        m = G.greedy_match(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.2)
        plan = _plan(m, "executedPlan")
        assert plan.count("Exchange hashpartitioning(image") <= 3
        by_rounds = G.greedy_match(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.2, small=0)
        key = lambda df: sorted((r["image"], r["old_id"], r["new_id"]) for r in df.collect())
        assert key(m) == key(by_rounds) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_boxes_are_shuffled_by_their_columns(spark):
    """What follows from a box's columns is computed after the shuffle that numbers boxes."""
    from vitrine.plans.registry import VIEWS, view

    d = "/root/testdata/sf0.001"
    lean, said = view(spark, d, "boxes"), spark.sql(VIEWS["boxes"].replace("from lineitem", "from {l}"), l=spark.read.parquet(f"{d}/lineitem.parquet"))
    assert lean.schema.simpleString() == said.schema.simpleString()
    assert lean.exceptAll(said).isEmpty() and said.exceptAll(lean).isEmpty()
    assert "% 40" in _plan(lean).split("Window")[0] and "% 40" not in _plan(lean).split("Window")[1]
