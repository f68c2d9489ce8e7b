"""People and albums: suggestions, confirmed and suggested marks, tag lists, albums' people, filters through members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import search as Q


def tagged(faces: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """``item_id, tag_id`` of items and the people on them: by confirmed faces, and by suggestions if given."""
    f = faces.where("tag_id is not null").select("item_id", "tag_id")
    return (f if suggestions is None else f.unionByName(suggestions.select("item_id", "tag_id"))).distinct()


def with_people(items: DataFrame, marks: DataFrame, tags: list) -> DataFrame:
    """Items with every one of the tags in ``marks(item_id, tag_id)``."""
    wanted = sorted(set(tags))
    have = marks.where(F.col("tag_id").isin(wanted)).groupBy("item_id").agg(F.countDistinct("tag_id").alias("n")).where(F.col("n") == len(wanted))
    return items.join(have.select(F.col("item_id").alias("id")), "id", "left_semi") if wanted else items


def with_groups(items: DataFrame, marks: DataFrame, groups: DataFrame, wanted: list, most: int = 3) -> DataFrame:
    """Items on which each of the wanted groups (at most three count) has someone; an unknown or empty group, or none at all, finds nothing."""
    names = list(dict.fromkeys(wanted))[:most]
    member = groups.where(F.col("group_id").isin(names)).select("group_id", "tag_id").distinct()
    met = marks.join(member, "tag_id").groupBy("item_id").agg(F.countDistinct("group_id").alias("n")).where(F.col("n") == len(names))
    return items.join(met.select(F.col("item_id").alias("id")), "id", "left_semi") if names else items.where(F.lit(False))


def confirmed_or_suggested(rows: DataFrame, faces: DataFrame, suggestions: DataFrame, tags: list) -> DataFrame:
    """``rows(id, ...)`` with ``mark``: ``confirmed`` if a face has one of the tags, ``suggested`` if a suggestion has, else ``none``."""
    ids = lambda df, name: df.where(F.col("tag_id").isin(tags)).select(F.col("item_id").alias("id")).distinct().withColumn(name, F.lit(True))
    both = rows.join(ids(faces, "__c"), "id", "left").join(ids(suggestions, "__s"), "id", "left")
    return both.withColumn("mark", F.when(F.col("__c"), "confirmed").when(F.col("__s"), "suggested").otherwise("none")).drop("__c", "__s")


def person_for(vectors: DataFrame, people: DataFrame, least: float) -> DataFrame:
    """``id, tag_id, similarity``: for each of ``vectors(id, embedding)`` the person whose centroid is most similar, if it is at least
    ``least``; ties to the smaller tag."""
    p = people.select(F.col("tag_id").alias("id"), F.col("centroid").alias("embedding"))
    found = Q.similar_across(vectors.select("id", "embedding"), p, least).withColumn("s", F.round("similarity", 9))
    best = found.groupBy("a").agg(F.max(F.struct("s", (-F.col("b")).alias("less"), "similarity")).alias("m"))
    return best.select(F.col("a").alias("id"), (-F.col("m.less")).cast(people.schema["tag_id"].dataType).alias("tag_id"), F.col("m.similarity").alias("similarity"))


def cluster_centroids(faces: DataFrame) -> DataFrame:
    """``id, embedding``: mean vectors of clusters at length 1; null where the mean is zero."""
    c = Q.centroids(faces.where("cluster_id is not null").select(F.col("cluster_id").alias("tag_id"), "embedding"))
    return c.select(F.col("tag_id").alias("id"), F.when(F.exists("centroid", lambda x: x != 0), F.col("centroid")).alias("embedding"))


def face_similarity(faces: DataFrame, ids: list, centroid: list[float]) -> DataFrame:
    """Similarity of the given faces to one centroid."""
    return Q.nearest(faces.where(F.col("id").isin(ids)).select("id", "embedding"), centroid, 0).select("id", "similarity")


def albums_where(members: DataFrame, items: DataFrame, condition: Column) -> DataFrame:
    """Albums with an active member for which the condition on ``items`` holds."""
    live = items.where("deleted_at is null").where(condition).select(F.col("id").alias("item_id"))
    return members.join(live, "item_id", "left_semi").select("album_id").distinct()


def albums_filtered(albums: DataFrame, members: DataFrame, items: DataFrame, conditions: list[Column]) -> DataFrame:
    """Albums that for each condition have a member for which it holds; the members may differ."""
    return reduce(lambda a, c: a.join(albums_where(members, items, c), "album_id", "left_semi"), conditions, albums)


def album_people(members: DataFrame, faces: DataFrame, direct: DataFrame) -> DataFrame:
    """``album_id, tag_id, source``: people named for an album (``direct``), on its items (``computed``), or ``both``."""
    a = direct.select("album_id", "tag_id", F.lit(1).alias("d"), F.lit(0).alias("c"))
    b = members.join(tagged(faces), "item_id").select("album_id", "tag_id").distinct().select("album_id", "tag_id", F.lit(0).alias("d"), F.lit(1).alias("c"))
    both = a.unionByName(b).groupBy("album_id", "tag_id").agg(F.max("d").alias("d"), F.max("c").alias("c"))
    return both.select("album_id", "tag_id", F.when((F.col("d") == 1) & (F.col("c") == 1), "both").when(F.col("d") == 1, "direct").otherwise("computed").alias("source"))


def tag_order() -> list[Column]:
    """Pinned first, then by name, letters in either case."""
    return [F.desc("pinned"), F.lower("name").asc(), F.asc("tag_id")]


def tag_counts(tags: DataFrame, faces: DataFrame) -> DataFrame:
    """Tags with their number of faces, 0 included."""
    n = faces.where("tag_id is not null").groupBy("tag_id").agg(F.count("*").alias("faces"))
    return tags.join(n, "tag_id", "left").withColumn("faces", F.coalesce("faces", F.lit(0)))


def tag_options(counted: DataFrame, selected=None, limit: int = 7) -> DataFrame:
    """The most used tags, the selected one always among them, with their ``place``: it comes first, then by use and name."""
    own = F.col("tag_id") == F.lit(selected) if selected is not None else F.lit(False)
    order = [F.desc(own.cast("int")), F.desc("faces"), F.lower("name"), F.col("tag_id")]
    top = counted.orderBy(*order).limit(max(1, limit))
    return top.withColumn("place", F.row_number().over(W.orderBy(*order)))


def tag_search(counted: DataFrame, text: str) -> DataFrame:
    """Tags whose name contains the text, by name and use; all of them without a text."""
    found = counted.where(F.lower("name").contains(text.strip().lower()))
    return found.orderBy(F.lower("name"), F.desc("faces"), "tag_id")


def visible_tags(counted: DataFrame, recent: list, selected: list, top: int = 5) -> DataFrame:
    """The tags shown: pinned and recent ones, or the ``top`` most used if there are none of these; selected ones always."""
    first = counted.where(F.col("pinned") | F.col("tag_id").isin(recent))
    most = counted.orderBy(F.desc("faces"), F.lower("name"), "tag_id").limit(top)
    some = first.agg((F.count("*") > 0).alias("some"))
    fallback = most.join(F.broadcast(some), F.lit(True)).where(~F.col("some")).drop("some")  # one row decides
    return first.unionByName(fallback).unionByName(counted.where(F.col("tag_id").isin(selected))).distinct()


def faces_of_items(faces: DataFrame, items: DataFrame) -> DataFrame:
    """Faces with their item's path and size, numbered in the order in which they were added; a box's reference size falls back to
    the item's."""
    i = items.select(F.col("id").alias("item_id"), "source_path", "width", "height")
    nth = F.row_number().over(W.partitionBy("item_id").orderBy("id"))
    ref = lambda a, b: F.coalesce(F.col(a), F.col(b)).alias(a)
    return faces.join(i, "item_id").select("id", "item_id", "tag_id", "source_path", ref("ref_width", "width"), ref("ref_height", "height"), nth.alias("nth"))


def faces_of_person(faces: DataFrame, tag) -> DataFrame:
    return faces.where(F.col("tag_id") == tag).orderBy(F.desc_nulls_last("confidence"), "id")


def confidence_page(faces: DataFrame, limit: int = 150, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of faces by confidence, unknown ones last."""
    return faces.orderBy(F.desc_nulls_last("confidence"), "id").offset(max(0, offset)).limit(max(1, min(limit, most)))


def albums_of_item(members: DataFrame, albums: DataFrame, item) -> DataFrame:
    return members.where(F.col("item_id") == item).select("album_id").distinct().join(albums, "album_id").orderBy(F.lower("name"), "album_id")


def cluster_pages(faces: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Clusters by size with their number of faces, of untagged ones, and the surest face."""
    sure = F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("id")).alias("less")))
    c = faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("members"), F.count_if(F.col("tag_id").isNull()).alias("untagged"), (-sure["less"]).alias("representative"))
    return c.orderBy(F.desc("members"), "cluster_id").offset(offset).limit(limit)


def representatives_by_tag(clusters: DataFrame) -> DataFrame:
    """For each person the clusters and their representative faces, as an array of (cluster_id, face_id)."""
    known = clusters.where("tag_id is not null and representative is not null")
    return known.groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.col("representative").alias("face_id")))).alias("representatives"))


def embedding_stats(faces: DataFrame) -> DataFrame:
    """Counts of faces by state of their vector, and of those in clusters."""
    s = F.col("embedding_status")
    ready = F.coalesce(s == "ready", F.lit(False))
    return faces.agg(
        F.count("*").alias("faces"), F.count_if(ready).alias("ready"), F.count_if(F.coalesce(s == "failed", F.lit(False))).alias("failed"), F.count_if(s.isNull() | (s == "pending")).alias("pending"),
        F.count_if(F.col("cluster_id").isNotNull()).alias("clustered"), F.count_if(ready & F.col("tag_id").isNull() & F.col("cluster_id").isNull()).alias("open"), F.countDistinct("cluster_id").alias("clusters"),
    )
