"""Lookups, pages and reports over the catalogue: by id or path, places and years of smart albums, failures, scopes, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import metadata as M
from ..functions import paths as P
from ..functions import predicates as C
from ..functions import scalars as S
from . import catalogue as CAT
from . import coverage as COV
from . import geometry as G

# --------------------------------------------------------------------------- lookups


def by_path(items: DataFrame, library: str, path: str) -> DataFrame:
    """The item at a path, the smallest id if there are several."""
    return items.where((F.col("library_id") == library) & (F.col("source_path") == path)).orderBy("id").limit(1)


def by_id_or_path(items: DataFrame, library: str, wanted: str) -> DataFrame:
    """The active item with an id or a path, given as text; blanks find nothing."""
    text = wanted.strip()
    hit = (F.col("id").cast("string") == text) | (F.col("source_path") == text)
    return CAT.active(items, library).where(hit if text else F.lit(False)).orderBy("id").limit(1)


def by_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """The rows whose key is among ``keys``, however many there are."""
    return df.join(keys.select(*([on] if isinstance(on, str) else on)).distinct(), on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is not among ``keys``; a null key stays."""
    return df.join(keys.select(on).distinct(), on, "left_anti")


def metadata_of_paths(items: DataFrame, wanted: DataFrame, sources: DataFrame, faces: DataFrame) -> DataFrame:
    """Active items at the wanted paths with the number of their active sources and their faces' confidences in the order of the
    faces' ids."""
    i = by_keys(items.where("deleted_at is null"), wanted.select(F.col("path").alias("source_path")), "source_path")
    sure = faces.join(i.select(F.col("id").alias("item_id")), "item_id", "left_semi").groupBy(F.col("item_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "confidence"))), lambda f: f["confidence"]).alias("confidences"))
    return COV.source_counts(i, sources).join(sure, "id", "left")


def all_keys(items: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of both lists, each once."""
    return items.select("id").unionByName(keys.select("id")).distinct()


# --------------------------------------------------------------------------- smart albums



def places(items: DataFrame, grouping: str = "year-city", gps: bool = True, patterns: tuple[str, ...] = C.EXCLUDED) -> DataFrame:
    """``country, place, group, parent, items`` of active items by ``grouping``: year-city, year-area, month-area or area-city.

    All but area-city name the area as the place (and need one) and group by the year or month of the picture; area-city names
    the city and groups by the smaller area, under the larger one if there is a smaller. Items count whose place comes from GPS
    (or, ``gps`` off, from elsewhere), whose city isn't their country, and whose category is no excluded one.
    """
    word = lambda c: F.nullif(F.trim(c), F.lit(""))
    area, area2, city, country = word("area"), word("area2"), word("city"), word("country")
    at = F.coalesce("photo_taken_at", "file_created_at")
    unknown = F.lit("Unknown area")
    if grouping == "area-city":
        label, group, parent, ok = city, F.coalesce(area2, area, unknown), F.when(area2.isNotNull(), area), city.isNotNull()
    else:
        size = 7 if grouping == "month-area" else 4
        label, group, parent = F.coalesce(area, unknown), F.substring(at, 1, size), F.lit(None).cast("string")
        ok = area.isNotNull() & F.substring(at, 1, size).rlike("^[0-9]{4}-[01][0-9]$" if size == 7 else "^[0-9]{4}$")
    own = items.where("deleted_at is null").where(C.from_gps(gps) & country.isNotNull() & ok & (city.isNull() | (country != city)))
    own = M.read_once(own, "category").where(~C.left_out(F.col("__read.category"), patterns))
    return own.groupBy(country.alias("country"), label.alias("place"), group.alias("group"), parent.alias("parent")).agg(F.count("*").alias("items"))


def nested_places(counted: DataFrame, grouping: str, source: str) -> DataFrame:
    """Counted places as one row per country: its items, and its groups (the latest first), each with items and entries (id,
    place, items) in the order of their names."""
    parent = F.coalesce("parent", F.lit(""))
    key = F.concat_ws(":", F.lit("place"), F.lit(source), F.lit(grouping), "country", "group", parent, "place")
    entry = F.struct(F.lower("place").alias("key"), "place", key.alias("id"), "items")
    groups = counted.groupBy("country", "group", "parent").agg(F.sum("items").alias("items"), F.array_sort(F.collect_list(entry)).alias("entries"))
    plain = F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["place"].alias("place"), e["items"].alias("items")))
    g = groups.select("country", F.struct("group", F.col("parent").alias("parent"), "items", plain.alias("entries")).alias("g"), "items")
    return g.groupBy("country").agg(F.sum("items").alias("items"), F.reverse(F.array_sort(F.collect_list("g"))).alias("groups"))


def years(items: DataFrame) -> DataFrame:
    """Active items by year, with those that have stars and those with a quality."""
    year = F.substring(F.coalesce("photo_taken_at", "file_created_at"), 1, 4)
    rated = F.coalesce(F.col("star_rating") > 0, F.lit(False))
    return items.where("deleted_at is null").where(year.rlike("^[0-9]{4}$")).groupBy(year.alias("year")).agg(F.count("*").alias("items"), F.count_if(rated).alias("rated"), F.count_if(F.coalesce(raw_quality() > 0, F.lit(False))).alias("ai_rated"))


def raw_quality(doc: str = "ai_metadata") -> Column:
    at = F.get_json_object
    return F.coalesce(at(doc, "$.image_analysis.photo_estetic_quality"), at(doc, "$.photo_estetic_quality")).try_cast("double")


def best_of(items: DataFrame, candidates: int, limit: int, offset: int = 0, seed: int | None = None) -> DataFrame:
    """A page of the best ``candidates`` items (by stars, quality, date, path), in that order, or shuffled by a seed."""
    order = [F.coalesce("star_rating", F.lit(-1)).desc(), F.coalesce(raw_quality(), F.lit(-1.0)).desc(), F.coalesce("photo_taken_at", "file_created_at").desc(), F.lower("source_path").asc(), F.asc("id")]
    best = items.orderBy(*order).limit(candidates)
    return CAT.page(CAT.shuffled(best, seed), [F.col("shuffle_key")], limit, offset).drop("shuffle_key") if seed is not None else CAT.page(best, order, limit, offset)


def shown(items: DataFrame) -> DataFrame:
    """``id, title, kind`` as a list shows items: the display title or the file name, an image if the kind isn't known."""
    title = F.coalesce(S.not_blank(F.col("display_title")), F.col("filename"))
    kind = F.when(F.col("mime_type").ilike("video/%"), "video").otherwise("image")
    return items.select("id", title.alias("title"), kind.alias("kind"))


def titled(albums: DataFrame, text: str) -> DataFrame:
    """Albums whose name contains the text, letters in either case, wildcards live; all without a text."""
    return albums.where(C.like(F.col("name"), text.strip())) if text.strip() else albums


# --------------------------------------------------------------------------- reports


def failures(items: DataFrame, done: str, failed: str) -> DataFrame:
    """Items that failed and weren't done since, the latest failure first. Deleted ones are listed as well."""
    return items.where(C.failed_since(F.col(done), F.col(failed))).select("id", "source_path", F.col(failed).alias("failed_at")).orderBy(F.desc("failed_at"), F.lower("source_path"), "id")


def face_scopes(images: DataFrame, faces: DataFrame, root: str) -> DataFrame:
    """Faces, tagged ones and images by scope: below the root (``recursive``), directly in it (``direct``), and by each of its
    subfolders, in one pass: an image enters each scope that it lies in."""
    base = root.rstrip("/") + "/"
    rest = F.substring(F.col("source_path"), len(base) + 1, 1 << 30)
    sub = F.nullif(F.regexp_extract(rest, r"^([^/]+)/", 1), F.lit(""))
    scopes = F.array(F.lit("recursive"), F.when(sub.isNull(), F.lit("direct")).otherwise(sub))
    per = faces.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"), F.count("tag_id").alias("t"))
    i = images.where(F.col("source_path").startswith(base)).join(per, "id", "left").withColumn("scope", F.explode(scopes))
    return i.groupBy("scope").agg(F.count("*").alias("images"), F.count("n").alias("with_faces"), F.coalesce(F.sum("n"), F.lit(0)).alias("faces"), F.coalesce(F.sum("t"), F.lit(0)).alias("tagged"))


def snapshot_times(snapshot: DataFrame, folders: DataFrame) -> DataFrame:
    """``folder, mtime`` of the asked folders that the snapshot knows."""
    return snapshot.join(folders.select("folder").distinct(), "folder", "left_semi").select("folder", "mtime")


def job_counts(jobs: DataFrame, skip_no_result: bool = False) -> DataFrame:
    """One row: jobs by status, and the mean seconds of those that ended: of the last 15, or of all where these are fewer
    than three (there are fewer than three then). ``jobs(seq, status, result, seconds)``; with ``skip_no_result`` a success without result
    counts as skipped and has no time."""
    s = F.col("status")
    empty = (s == "success") & F.col("result").isNull() & F.lit(skip_no_result)
    ended = s.isin("success", "failed", "cancelled") & ~empty & (F.col("seconds") > 0)
    recent = jobs.where(ended).orderBy(F.desc("seq")).limit(15).agg(F.avg("seconds").alias("mean_seconds"))
    count = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    return jobs.agg(*[count(s == x, x) for x in ("success", "failed", "cancelled", "running")], count(empty, "skipped")).join(recent, F.lit(True))  # single rows


def results(hits: DataFrame, items: DataFrame, quick: C.QuickFilter, least_image: float, least_text: float, mode: str = "hybrid") -> DataFrame:
    """Search hits (id, image_similarity, text_similarity) that are similar enough and pass the quick filter, with what a list shows."""
    ok = hits.where(C.passes_gate(F.col("image_similarity"), F.col("text_similarity"), least_image, least_text, mode))
    both = ok.join(items.where(quick.column()), "id")
    return both.select("id", F.coalesce(S.not_blank(F.col("display_title")), F.col("filename")).alias("title"), "image_similarity", "text_similarity")


def headline(text: Column) -> Column:
    """``white_balance_fix`` as ``White Balance Fix``."""
    parts = F.filter(F.split(text, "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), " ")


def label(text: Column, known: tuple[str, ...] = ("adult", "child", "baby", "male", "female", "unknown", "other")) -> Column:
    """A known word with a capital, other words as they are; null for blanks."""
    t = F.nullif(text, F.lit(""))
    return F.when(F.lower(t).isin(*known), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 100)))).otherwise(t)


# --------------------------------------------------------------------------- composed writes


def reconciled(items: DataFrame, disk: DataFrame, sources: DataFrame, folder: str, now: str) -> DataFrame:
    """What becomes of the items directly in a folder: ``id, source_path, action`` (deleted, restored, kept) and ``logged``: a deletion
    goes to the log if the item has no other active source."""
    direct = items.where(P.parent(F.col("source_path")) == folder.rstrip("/"))
    there = disk.select(F.col("path").alias("source_path")).distinct().withColumn("__on", F.lit(True))
    others = sources.where("status = 'active'").select(F.col("item_id").alias("id"), F.col("source_path").alias("__p"))
    n = direct.select("id", "source_path").join(others, "id").where("__p <> source_path").groupBy("id").agg(F.count("*").alias("others"))
    both = direct.join(there, "source_path", "left").join(n, "id", "left")
    action = F.when(F.col("__on").isNull() & F.col("deleted_at").isNull(), "deleted").when(F.col("__on") & F.col("deleted_at").isNotNull(), "restored").otherwise("kept")
    return both.select("id", "source_path", action.alias("action"), ((action == "deleted") & (F.coalesce("others", F.lit(0)) == 0)).alias("logged"))


def purged(items: DataFrame, before: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, rows``: how many rows go from the items and from each child table (its frame and the column with the item) when items
    that were deleted before a time are purged."""
    gone = items.where(F.col("deleted_at") < before).select("id")
    count = lambda df, name: df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
    out = count(gone, "items")
    for name, (df, key) in children.items():
        out = out.unionByName(count(df.join(gone.select(F.col("id").alias(key)), key, "left_semi"), name))
    return out


def refreshed_suggestions(suggestions: DataFrame, best: DataFrame, tags: list) -> DataFrame:
    """Suggestions with those of the given tags replaced by ``best`` (item_id, tag_id, face_id, similarity)."""
    columns = suggestions.columns
    return suggestions.where(~F.col("tag_id").isin(tags)).unionByName(best.where(F.col("tag_id").isin(tags)).select(*columns))


def reclustered(faces: DataFrame, members: DataFrame, kept: DataFrame) -> DataFrame:
    """Faces with the clusters of a new run: old ones are cleared, and members of kept clusters get theirs."""
    new = members.join(kept.select(F.col("cluster_id").alias("component")), "component", "left_semi").select("id", F.col("component").alias("__c"))
    return faces.drop("cluster_id").join(new, "id", "left").withColumnRenamed("__c", "cluster_id").select(*faces.columns)


def extracted_paths(items: DataFrame) -> DataFrame:
    """What the rules read in paths: ``id, start, end, source, title``; the title only if it differs from the file's stem."""
    path = F.col("source_path")
    name = P.file_name(path)
    date = D.date_in_path(path)
    title = P.display_title(name)
    e = D.event_date(F.col("photo_taken_at"), F.when(F.length("photo_taken_at") == 4, "year").otherwise("day"), date["date"], F.lit(False), F.col("file_created_at"))
    own = F.when(F.trim(title) != F.trim(P.stem(name)), title)
    return items.select("id", e.alias("e"), own.alias("title")).select("id", F.col("e.start").alias("start"), F.col("e.end").alias("end"), F.col("e.source").alias("source"), "title")


def with_folder_context(results_: DataFrame, folders: DataFrame) -> DataFrame:
    """Readings ``path, start, country, city`` of files, filled up from the reading of their folder ``(folder, start, country, city)``:
    the date if the file has none, the place as a whole if it has no part of one. ``asked`` tells whether the name says more than a
    camera's id."""
    f = folders.select("folder", F.col("start").alias("__s"), F.col("country").alias("__n"), F.col("city").alias("__c"))
    both = results_.withColumn("folder", P.parent(F.col("path"))).join(f, "folder", "left")
    placed = F.coalesce("country", "city").isNotNull()
    own = lambda c, other: F.when(placed, F.col(c)).otherwise(F.col(other)).alias(c)
    return both.select("path", F.coalesce("start", "__s").alias("start"), own("country", "__n"), own("city", "__c"), (~P.only_camera_id(P.file_name(F.col("path")))).alias("asked"))


def vector_targets(faces: DataFrame, detections: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """Faces whose vector isn't ready, each with the detection of its image that it overlaps best, one to one; null without."""
    need = faces.where(~F.col("embedding_status").eqNullSafe("ready"))
    found = G.greedy_match(need, detections.where("x2 > x1 and y2 > y1"), least_iou)
    return need.join(found.select("image", F.col("old_id").alias("id"), F.col("new_id").alias("detection")), ["image", "id"], "left").select("image", "id", "detection")


def open_vectors(faces: DataFrame) -> DataFrame:
    """Untagged faces with ready vectors for clustering; an unknown confidence counts as 0."""
    return faces.where(F.col("tag_id").isNull() & C.usable_face(strict=True)).select("id", "embedding", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def added_sources(items: DataFrame, sources: DataFrame, client: str, now: str) -> DataFrame:
    """Sources for active items that have none under their path: what a backfill inserts."""
    have = sources.select("library_id", "source_path").distinct()
    new = items.where("deleted_at is null").join(have, ["library_id", "source_path"], "left_anti")
    return new.select("library_id", "source_path", F.lit(client).alias("client_id"), F.col("id").alias("item_id"), F.lit(True).alias("is_primary"), F.lit("active").alias("status"), F.lit(now).alias("verified_at"))
