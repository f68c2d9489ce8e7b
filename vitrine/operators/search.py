"""Search: exact vector search, rank fusion, keyword re-ranking; people: centroids, matches, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import balls as B
from .store import dropped, written
from .textindex import TextIndex


def nearest(vectors: DataFrame, query: list[float], limit: int, least: float | None = None) -> DataFrame:
    """``vectors(id, embedding)`` most similar to the query by cosine; ties to the smaller id. Other columns stay.

    The query is a literal at length 1, so a row costs one product and its own norm. A zero vector's similarity is 0,
    vectors of another length take no part.
    """
    e, q = F.col("embedding"), np.array(query, float)
    size = float(np.linalg.norm(q))
    s = F.lit(0.0) if size == 0 else F.coalesce(F.try_divide(V.dot(e, V.literal((q / size).tolist())), V.norm(e)), F.lit(0.0))
    s = vectors.where(F.size("embedding") == len(query)).withColumn("similarity", s).where("similarity is not null")
    s = s if least is None else s.where(F.col("similarity") >= least)
    s = s.orderBy(F.desc("similarity"), "id")
    return s.limit(limit) if limit > 0 else s


def vector_of(vectors: DataFrame, id_: int) -> list[float]:
    """One stored vector; it becomes a literal of the plan."""
    return list(vectors.where(F.col("id") == id_).select("embedding").first()[0])


def similar_images(items: DataFrame, vectors: DataFrame, path: str, least: float, most: int = 99, cells: B.Cells | None = None) -> DataFrame:
    """``id, score``: the item at a path with score 1, and its at most ``most`` neighbours of similarity ``least`` or more.

    ``least`` must be above 0 and at most 1. ``items(id, source_path)`` are the ones to search, ``vectors(id, embedding)`` theirs, and
    ``cells`` the same vectors in cells, if there are such; a source without vector gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    have = items.select("id", "source_path").join(vectors.select("id", "embedding"), "id")
    source = have.where(F.col("source_path") == path).select("id", "embedding").first()
    if source is None:
        return have.select("id", F.lit(1.0).alias("score")).limit(0)
    others = have.where(F.col("id") != source["id"])
    near = nearest(others.select("id", "embedding"), list(source["embedding"]), most, least) if cells is None else B.search(cells, list(source["embedding"]), most, least, allowed=others.select("id"))[0]
    own = have.where(F.col("id") == source["id"]).select("id", F.lit(1.0).alias("score"))
    return own.unionByName(near.select("id", F.col("similarity").alias("score")))


def ranked(df: DataFrame, score: str, limit: int) -> DataFrame:
    top = df.orderBy(F.desc(score), "id").limit(limit)
    return top.select("id", F.row_number().over(W.orderBy(F.desc(score), "id")).alias("rank"))


def fuse(lists: list[DataFrame], k: int = 60, limit: int = 50) -> DataFrame:
    """Reciprocal rank fusion of ``(id, rank)`` lists."""
    both = lists[0].select("id", "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select("id", "rank"))
    return both.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def keyword_rerank(ranked_: DataFrame, vectors: DataFrame, keywords: list[list[float]], threshold: float, texts: DataFrame | None = None, text_threshold: float = 0.0, mode: str = "hybrid") -> DataFrame:
    """``id, score, hits, coverage, hit_scores`` of ranked ``(id, score)``, to be ordered by hits and then by score.

    A keyword (its vector) hits an item if the similarity to the item's vector reaches the threshold, by image (``vectors``) or
    by text (``texts``); a threshold of 0 switches that side off, and so does a ``mode`` of description-only or vlm-only. A hit
    is credited with the larger similarity of the sides that hit (``hit_scores``, in the keywords' order), and coverage is the credit
    over the number of keywords. The keywords are those of one query and become literals.
    """
    units = [(np.array(k, float) / (np.linalg.norm(k) or 1.0)).tolist() for k in keywords]
    with_text = texts is not None and text_threshold > 0 and mode != "vlm-only"
    with_image = threshold > 0 and mode != "description-only"
    r = ranked_.join(vectors.select("id", F.col("embedding").alias("__image")), "id", "left")
    r = r.join(texts.select("id", F.col("embedding").alias("__text")), "id", "left") if texts is not None else r.withColumn("__text", F.lit(None).cast("array<double>"))

    def credit(column: str, unit: list[float], least: float, on: bool) -> Column:
        s = F.coalesce(F.try_divide(V.dot(F.col(column), V.literal(unit)), V.norm(F.col(column))), F.when(F.col(column).isNotNull(), F.lit(0.0)))
        return F.when(s >= least, s) if on else F.lit(None).cast("double")

    credits = F.array(*[F.greatest(credit("__image", u, threshold, with_image), credit("__text", u, text_threshold, with_text)) for u in units]) if units else F.array().cast("array<double>")
    r = r.withColumn("__c", F.filter(credits, lambda c: c.isNotNull()))
    return r.select("id", "score", F.size("__c").cast("long").alias("hits"), (F.aggregate("__c", F.lit(0.0), lambda a, c: a + c) / max(1, len(units))).alias("coverage"), F.col("__c").alias("hit_scores"))


def hybrid_search(
    images: B.Cells,
    texts: B.Cells,
    query: list[float],
    keywords: list[list[float]] | None = None,
    index: TextIndex | None = None,
    words: list[str] | None = None,
    allowed: DataFrame | None = None,
    limit: int = 100,
    candidates: int = 100,
    mode: str = "hybrid",
    image_threshold: float = 0.0,
    text_threshold: float = 0.0,
) -> DataFrame:
    """A whole search: ``id, score, image_similarity, text_similarity, keyword_score, hits, coverage, hit_scores``, most keyword hits first,
    then by fused score, ties to the smaller id.

    The query's vector finds at least ``candidates`` items by image and as many by text among ``allowed(id)``; their ranks are fused
    (``mode`` may leave one list out, similarities are attached all the same), and the best ``limit`` stay. ``keywords``, vectors of what
    an analysis of the query named, reorder them (see ``keyword_rerank``; without any, or with both thresholds 0, nothing is
    reordered and hits are 0). ``words`` are looked up in the text index, whose scores are attached and change no order. The order
    is part of the result only as far as it is sorted; rows are at most ``limit``.
    """
    most = max(1, limit, candidates)
    by_image, by_text = (B.search(c, query, most, allowed=allowed)[0].withColumn("similarity", F.round("similarity", 9)) for c in (images, texts))
    lists = {"hybrid": [by_image, by_text], "vlm-only": [by_image], "description-only": [by_text]}[mode]
    fused = fuse([ranked(x, "similarity", most) for x in lists], limit=max(1, limit))
    asked = keywords if keywords and (image_threshold > 0 or text_threshold > 0) else []
    wanted = fused.select("id")
    vectors = lambda c: c.table.select("id", F.col("unit")).join(wanted, "id", "left_semi").mapInArrow(B.as_arrays(c.dims), "id long, embedding array<double>")
    r = keyword_rerank(fused, vectors(images), asked, image_threshold, vectors(texts), text_threshold, mode)
    attach = lambda x, as_: x.select("id", F.col("similarity").alias(as_))
    r = r.join(attach(by_image, "image_similarity"), "id", "left").join(attach(by_text, "text_similarity"), "id", "left")
    by_word = index.search(list(words), most, allowed=allowed)[0] if index is not None and words else None
    r = r.join(by_word.select("id", F.col("score").alias("keyword_score")), "id", "left") if by_word is not None else r.withColumn("keyword_score", F.lit(None).cast("double"))
    columns = ["id", "score", "image_similarity", "text_similarity", "keyword_score", "hits", "coverage", "hit_scores"]
    return r.select(*columns).orderBy(F.desc("hits"), F.desc("score"), "id")


def hybrid(images: DataFrame, texts: DataFrame, query: list[float], limit: int = 100, candidates: int = 100, mode: str = "hybrid") -> DataFrame:
    """``id, score, image_similarity, text_similarity``: the best items by image and by text, at least ``candidates`` of each, their
    ranks fused; ``mode`` may leave one of the lists out. Similarities of both lists are attached whatever the mode."""
    most = max(1, limit, candidates)
    by_image, by_text = nearest(images.select("id", "embedding"), query, most), nearest(texts.select("id", "embedding"), query, most)
    lists = {"hybrid": [by_image, by_text], "vlm-only": [by_image], "description-only": [by_text]}[mode]
    fused = fuse([ranked(x.withColumn("similarity", F.round("similarity", 9)), "similarity", most) for x in lists], limit=max(1, limit))
    attach = lambda x, as_: x.select("id", F.col("similarity").alias(as_))
    return fused.join(attach(by_image, "image_similarity"), "id", "left").join(attach(by_text, "text_similarity"), "id", "left")


def centroids(faces: DataFrame) -> DataFrame:
    """``tag_id, n, centroid``: the mean vector of each tag's faces at length 1 (a zero mean stays)."""
    e = faces.where("tag_id is not null").select("tag_id", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    mean = e.groupBy("tag_id", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    c = mean.groupBy("tag_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    return c.select("tag_id", "n", V.unit(F.col("mean")).alias("centroid"))


def recomputed_centroids(stored: DataFrame, faces: DataFrame, tags: DataFrame) -> DataFrame:
    """``stored(tag_id, n, centroid)`` after the centroids of ``tags(tag_id)`` are computed anew from ``faces``: written over or added where a tag has
    faces, deleted where it has none; those of other tags stay."""
    named = tags.select("tag_id").distinct()
    fresh = centroids(faces.join(named, "tag_id", "left_semi"))
    return stored.join(named, "tag_id", "left_anti").select("tag_id", "n", "centroid").unionByName(fresh)


def matches(faces: DataFrame, people: DataFrame, least: float) -> DataFrame:
    """``id, tag_id, similarity``: untagged faces and the persons whose centroid is similar enough, by blocks of matrices."""
    f = faces.where("tag_id is null").select("id", "embedding")
    p = people.select(F.col("tag_id").alias("id"), F.col("centroid").alias("embedding"))
    found = similar_across(f, p, least)
    return found.select(F.col("a").alias("id"), F.col("b").cast(people.schema["tag_id"].dataType).alias("tag_id"), "similarity")


def best_per(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The row of the highest score for each key, ties to the smaller ``tie`` (a pre-aggregated maximum)."""
    rest = [c for c in df.columns if c not in (key, score, tie)]
    top = df.groupBy(key).agg(F.max(F.struct(F.col(score), (-F.col(tie)).alias("less"), *rest)).alias("m"))
    return top.select(key, F.col(f"m.{score}").alias(score), (-F.col("m.less")).alias(tie), *[F.col(f"m.{c}").alias(c) for c in rest])


def similar_across(left: DataFrame, right: DataFrame, least: float, rows: int = 2048) -> DataFrame:
    """``a, b, similarity`` of all rows of ``left(id, embedding)`` and ``right(id, embedding)`` whose cosine is at least ``least``. Both
    are dealt to cells, and only blocks whose bounds allow it meet (see ``balls.joined``)."""
    return B.joined(B.cells_of(left, rows), B.cells_of(right, rows), least, rows)[0]


def similar_pairs(vectors: DataFrame, least: float, rows: int = 2048) -> DataFrame:
    """``a, b, similarity`` of all pairs a < b with cosine at least ``least``, see ``similar_across``."""
    cells = B.cells_of(vectors, rows)
    return B.joined(cells, cells, least, rows, upper=True)[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` (the smallest id reachable) of ``edges(a, b)``.

    Edges are redrawn until only stars are left (Kiveris and others 2014): in turn, each node's larger neighbours, and then the
    smaller ones with itself, are tied to its smallest. Rounds grow with the logarithm of the paths' length; each is written to
    the shared folder, and the one before is deleted. Loops are dropped.
    """
    edge = lambda x, y: F.struct(x.alias("u"), y.alias("v"))
    lone = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        ends = e.groupBy("u").agg(F.count("*").alias("out"))
        loose = ends.where("out > 1").limit(1).unionByName(ends.join(e.select(F.col("v").alias("u")).distinct(), "u").limit(1))
        if loose.isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = up.groupBy("u").agg(F.min("v").alias("m"))
        tied = up.join(down, "u").select(F.explode(F.array(edge(F.col("u"), F.col("m")), edge(F.col("v"), F.col("m")))).alias("p")).select("p.*")
        e, old = written(tied.where("u <> v").distinct(), "edges"), e
        dropped(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    return stars.unionByName(lone.join(stars, "id", "left_anti"))
