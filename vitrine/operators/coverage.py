"""Coverage of folders by analyses: places, faces, orientation, embeddings; labels, plans and job states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import predicates as C
from ..functions import scalars as S
from ..sources import files as SRC
from .places import nearest_city  # noqa: F401


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def analyses(items: DataFrame, embeddings: DataFrame, faces: DataFrame, model: str, least_confidence: float) -> DataFrame:
    """One row: images, and how many are done or failed for photo analysis, faces, embedding and rotation, wrongly rotated, with
    faces and with tagged faces.

    Embeddings of other kinds and models are left out before the join; faces are counted per item first.
    """
    e = embeddings.where((F.col("kind") == "image") & (F.col("model") == model)).select(F.col("item_id").alias("id"), F.col("status").alias("e"))
    f = faces.groupBy(F.col("item_id").alias("id")).agg(F.max(F.col("tag_id").isNotNull()).alias("has_tagged"), F.lit(True).alias("has_faces"))
    i = items.where(SRC.is_image(F.col("source_path"), F.col("mime_type"))).join(e, "id", "left").join(f, "id", "left")
    r = C.Rotation()
    col = F.col
    return i.agg(
        F.count("*").alias("total"),
        _count(C.analysed(col("photo_done_at"), col("photo_failed_at")), "photo_done"), _count(C.failed_since(col("photo_done_at"), col("photo_failed_at")), "photo_failed"),
        _count(C.analysed(col("face_done_at"), col("face_failed_at")), "face_done"), _count(C.failed_since(col("face_done_at"), col("face_failed_at")), "face_failed"),
        _count(col("e") == "ready", "semantic_done"), _count(col("e") == "failed", "semantic_failed"),
        _count(r.done, "rotation_done"), _count(r.wrong(least_confidence), "rotation_wrong"), _count(r.failed, "rotation_failed"),
        _count(col("has_faces"), "with_faces"), _count(col("has_tagged"), "with_tagged"),
    )


def rollup_label(photo: Column, face: Column, semantic: Column, total: Column) -> Column:
    """A folder's label in the sidebar from the labels of three analyses."""
    any_is = lambda what: (photo == what) | (face == what) | (semantic == what)
    rest_done = (face == "done") & (semantic == "done")
    return F.when(total == 0, "empty").when(rest_done & (photo != "done"), "photo_analysis_waiting").when(rest_done, "all_done").when(any_is("partial"), "partial").when(any_is("not_done"), "not_done").otherwise("all_done")


def folder_state(running: Column, done_at: Column) -> Column:
    return F.when(running, "in_progress").when(done_at.isNotNull(), "analyzed").otherwise("not_scanned")


def places(items: DataFrame) -> DataFrame:
    """One row: images and videos with GPS and with a place from it, and images whose path gave a model a place."""
    image, video = SRC.is_image(F.col("source_path"), F.col("mime_type")), SRC.is_video(F.col("source_path"), F.col("mime_type"))
    gps = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    named = F.lit(False)
    for c in ("country", "city", "area", "place", "location_name"):
        named = named | S.not_blank(F.col(c)).isNotNull()
    done = gps & (F.col("location_source") == "gps") & named
    return items.where(image | video).agg(
        _count(image, "images"), _count(image & gps, "images_gps"), _count(image & done, "images_placed"), _count(image & C.located_by_path(), "path_placed"),
        _count(image & C.located_by_path("country", "country_code"), "path_country"), _count(image & C.located_by_path("area"), "path_area"), _count(image & C.located_by_path("city"), "path_city"),
        _count(video, "videos"), _count(video & gps, "videos_gps"), _count(video & done, "videos_placed"), _count(done, "placed"),
    )


def faces_summary(images: DataFrame, faces: DataFrame, person_items: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row about the faces on ``images(id, face_done_at, face_failed_at)``: images analysed and failed, faces by tag, age and
    gender, histograms of faces and of main subjects per image (1, 2, 3, 4, 5 and more), images with a person's tag of their
    own, and untagged faces that a suggestion names. Faces are counted per image first."""
    known = F.col("age").isNotNull() & F.col("gender").isNotNull()
    f = faces.join(images.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    per = f.groupBy("item_id").agg(
        F.count("*").alias("n"), _count(F.col("tag_id").isNotNull(), "tagged"), _count(known, "known"), _count(F.col("age") < 18, "children"), _count(F.col("age") >= 18, "adults"), _count(F.col("role") == "main", "main")
    )
    per = per.withColumn("subjects", F.when(F.col("main") > 0, F.col("main")).otherwise(F.col("n")))
    names = ("one", "two", "three", "four")
    bins = lambda c, as_: [_count(F.col(c) == k + 1, f"{n}_{as_}") for k, n in enumerate(names)] + [_count(F.col(c) >= 5, f"five_plus_{as_}")]
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    a = per.agg(F.count("*").alias("images_with_faces"), total("n", "faces"), total("tagged", "tagged"), total(F.col("n") - F.col("tagged"), "untagged"), total("known", "with_age_gender"), total(F.col("n") - F.col("known"), "without_age_gender"), total("children", "children"), total("adults", "adults"), *bins("n", "faces"), *bins("subjects", "main"), _count((F.col("n") > 1) & (F.col("main") == 1), "one_main_with_background"))
    done, failed = C.analysed(F.col("face_done_at"), F.col("face_failed_at")), C.failed_since(F.col("face_done_at"), F.col("face_failed_at"))
    b = images.agg(F.count("*").alias("images"), _count(done, "analysed"), _count(failed, "failed"))
    here = images.select(F.col("id").alias("item_id"))
    c = person_items.join(here, "item_id", "left_semi").agg(F.countDistinct("item_id").alias("with_person_tag"))
    untagged = f.where("tag_id is null").select("item_id", F.col("id").alias("face_id"))
    d = suggestions.join(untagged, ["item_id", "face_id"], "left_semi").agg(F.countDistinct("face_id").alias("suggested"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).join(d, F.lit(True))  # four single rows


def main_buckets(summary: DataFrame) -> DataFrame:
    """The histogram of main subjects as one, two, three, and four or more."""
    return summary.select(F.col("one_main").alias("one"), F.col("two_main").alias("two"), F.col("three_main").alias("three"), (F.col("four_main") + F.col("five_plus_main")).alias("four_plus"))


def in_scope(items: DataFrame, folder: str, recursive: bool, path: str = "source_path") -> DataFrame:
    """One row: how many items lie in the folder."""
    return items.where(P.in_folder(F.col(path), folder, recursive)).agg(F.count("*").alias("items"))


def source_counts(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with the number of their active sources."""
    n = sources.where("status = 'active'").groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("sources"))
    return items.join(n, "id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def diff_by_subfolder(diff: DataFrame, root: str) -> DataFrame:
    """A snapshot diff counted by the folders directly in ``root`` (null: files in the root itself)."""
    base = root.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 30)
    sub = F.nullif(F.regexp_extract(rest, r"^([^/]+)/", 1), F.lit(""))
    return diff.where(F.col("path").startswith(base)).groupBy(sub.alias("subfolder")).agg(*[_count(F.col("state") == s, s) for s in ("new", "modified", "deleted")])


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: changes by kind, and the folders that have files directly."""
    there = F.when(F.col("state") != "deleted", P.parent(F.col("path")))
    return diff.agg(*[_count(F.col("state") == s, s) for s in ("new", "modified", "deleted")], F.countDistinct(there).alias("folders"))


def bundle_states(jobs: DataFrame) -> DataFrame:
    """``bundle_id, state`` of bundles of jobs: running beats queued, then failed, cancelled and done."""
    has = lambda s: F.max(F.col("state") == s)
    return jobs.groupBy("bundle_id").agg(
        F.when(has("running"), "running").when(has("queued") & F.max(F.col("state") != "queued"), "running").when(has("queued"), "queued").when(has("failed"), "failed").when(has("cancelled"), "cancelled").otherwise("done").alias("state")
    )


def geo_scan_plan(total: Column, with_gps: Column, scanned_at: Column, changed: Column) -> Column:
    """``skip`` an empty or unchanged folder, ``full`` if it was never scanned, else ``incremental``."""
    return F.when(total == 0, "skip").when(scanned_at.isNull(), "full").when((changed > 0) | (with_gps == 0), "incremental").otherwise("skip")


def last_scans(folders: DataFrame, states: DataFrame) -> DataFrame:
    """Requested folders with the time of their last scan, null if there was none; separators and letters' case don't matter."""
    key = lambda c: F.lower(P.comparable(F.col(c)))
    s = states.groupBy(key("folder").alias("key")).agg(F.max("done_at").alias("done_at"))
    return folders.join(s, key("folder") == F.col("key"), "left").select("folder", "done_at")


def found_by_path(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """``path, id`` of wanted paths: as they are, else in comparable form, else in lower case (the smallest id of several)."""
    forms = [lambda c: F.col(c), lambda c: P.comparable(F.col(c)), lambda c: F.lower(P.comparable(F.col(c)))]
    out = wanted.select("path")
    for k, form in enumerate(forms):
        ids = items.groupBy(form("source_path").alias(f"__k{k}")).agg(F.min("id").alias(f"__i{k}"))
        out = out.join(ids, form("path") == F.col(f"__k{k}"), "left")
    return out.select("path", F.coalesce("__i0", "__i1", "__i2").alias("id"))


def fresh_first(pending: DataFrame, failed: DataFrame, skip_failed: bool = False) -> DataFrame:
    """Pending files with their ``place``: those that failed before come last, or not at all."""
    p = pending.join(failed.select("path").distinct().withColumn("__f", F.lit(True)), "path", "left").withColumn("failed_before", F.coalesce("__f", F.lit(False))).drop("__f")
    return p.where(~F.col("failed_before")) if skip_failed else p
