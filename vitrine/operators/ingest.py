"""Writes to the catalogue, as functions from tables to the next table: scans, analyses, faces, locations, sources, albums,
people, logs. The key of an item is (library_id, source_path); rows that a write doesn't name stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import paths as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..sources import files as SRC
from . import geometry as G

KEYS = ["library_id", "source_path"]


def short_error(error: Column) -> Column:
    return F.substring(error, 1, 500)


def patched(base: DataFrame, delta: DataFrame, keys: list[str], columns: dict[str, Column], insert: bool = False) -> DataFrame:
    """``base`` with new values for the rows that ``delta`` names; in ``columns``, ``old.c`` is a row's own value and
    ``new.c`` that of ``delta``. With ``insert``, keys that only ``delta`` has become rows. ``delta`` has a key once."""
    b = base.withColumn("__in", F.lit(True)).alias("old")
    d = delta.withColumn("__hit", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = b.join(d, on, "full_outer" if insert else "left")
    own = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keys else F.when(F.col("new.__hit"), columns[c]).otherwise(F.col(f"old.{c}")) if c in columns else F.col(f"old.{c}")
    return both.select(*[own(c).alias(c) for c in base.columns])


def geometry_changed(prior: str, new: str) -> Column:
    return ~(F.col(f"{prior}.width").eqNullSafe(F.col(f"{new}.width")) & F.col(f"{prior}.height").eqNullSafe(F.col(f"{new}.height")) & F.col(f"{prior}.orientation").eqNullSafe(F.col(f"{new}.orientation")))


def stale(prior: str, new: str, trusted: bool = False) -> Column:
    """Whether what models said of a file no longer holds, for the aliases of two states (width, height, orientation,
    content_hash, byte_size, mtime).

    A hash that appears is no change, one that vanishes is. With both hashes, or equal ones, the geometry decides; without
    any, size and time do as well. A ``trusted`` write of embedded tags makes nothing stale unless the geometry changed.
    """
    a, b = (F.nullif(F.trim(F.col(f"{s}.content_hash")), F.lit("")) for s in (prior, new))
    shape = geometry_changed(prior, new)
    touched = ~F.col(f"{prior}.byte_size").eqNullSafe(F.col(f"{new}.byte_size")) | ~F.col(f"{prior}.mtime").eqNullSafe(F.col(f"{new}.mtime"))
    changed = F.when(a.isNull() & b.isNotNull(), False).when(a.isNotNull() & b.isNull(), True).when(a.isNull(), shape | touched).otherwise(shape)
    return changed & shape if trusted else changed


def scan(items: DataFrame, observed: DataFrame, version: str, now: str) -> DataFrame:
    """What a file scan writes: ``library_id, source_path, status, item_id, copy_of, stale, follow_up, deleted_at``.

    ``observed`` has the state of each file (mtime, byte_size, content_hash, width, height, orientation, mime_type). A known
    path is ``unchanged`` if time, size, metadata version and hash are; else it is ``updated`` (and no longer deleted). An
    unknown one is ``created``, a copy of the active item with its hash, if any (the smallest id). Models have work to do on
    new images that are no copies and on images whose results are stale.
    """
    known = items.select(*KEYS, "id", "mtime", "byte_size", "content_hash", "width", "height", "orientation", "metadata_version", "deleted_at")
    twins = items.where("deleted_at is null and content_hash is not null").groupBy("library_id", "content_hash").agg(F.min("id").alias("twin"))
    o = observed.join(twins, ["library_id", "content_hash"], "left").alias("new")
    both = o.join(known.alias("old"), [F.col(f"new.{k}") == F.col(f"old.{k}") for k in KEYS], "left")
    here = F.col("old.id").isNotNull()
    same = F.col("old.mtime").eqNullSafe(F.col("new.mtime")) & F.col("old.byte_size").eqNullSafe(F.col("new.byte_size")) & (F.col("old.metadata_version") == version)
    rehashed = (F.coalesce(F.col("new.content_hash"), F.lit("")) != "") & ~F.col("new.content_hash").eqNullSafe(F.col("old.content_hash"))
    status = F.when(~here, "created").when(F.coalesce(same, F.lit(False)) & ~rehashed, "unchanged").otherwise("updated")
    image = SRC.media_kind(F.col("new.source_path"), F.col("new.mime_type")) == "image"
    copy = F.when(~here, F.col("new.twin"))
    out = both.select(*[F.col(f"new.{k}").alias(k) for k in KEYS], status.alias("status"), F.col("old.id").alias("item_id"), copy.alias("copy_of"), F.coalesce((status == "updated") & image & stale("old", "new"), F.lit(False)).alias("stale"), image.alias("image"), F.when(status == "unchanged", F.col("old.deleted_at")).alias("deleted_at"))
    return out.withColumn("follow_up", F.col("image") & ((F.col("status") == "created") & F.col("copy_of").isNull() | F.col("stale"))).drop("image")


def without_results(items: DataFrame, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``items`` with the named columns empty for the given ids, whose vectors and faces go by ``catalogue.orphans``."""
    return patched(items, ids.select("id").distinct(), ["id"], {c: F.lit(None).cast(items.schema[c].dataType) for c in columns})


#: Sources of a place that a model's view of the picture doesn't replace.
FIRMER = ("gps", "embedded_xmp", "path_llm", "path_script")


def analysed_photos(items: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """``items`` with photo analyses ``(library_id, source_path, location, country, city, place, people, face_count, age_min,
    age_max)`` written at ``now``: a place from a firmer source stays, else new values fill in; faces counted before
    go before the model's count; an earlier failure is forgotten. Unknown paths become rows."""
    keeps = F.coalesce(F.col("old.location_source").isin(*FIRMER), F.lit(False))
    place = lambda c: F.when(keeps, F.col(f"old.{c}")).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")))
    seen = F.when(F.coalesce("new.country", "new.city", "new.place").isNotNull(), F.lit("ai_vision"))
    columns = {c: place(c) for c in ("country", "city", "place")}
    columns |= {"location_source": F.when(keeps, F.col("old.location_source")).otherwise(F.coalesce(seen, F.col("old.location_source"))), "location_name": F.coalesce("new.location", "old.location_name")}
    columns |= {"people": F.coalesce("new.face_count", "new.people"), "age_min": F.col("new.age_min"), "age_max": F.col("new.age_max"), "photo_done_at": F.lit(now), "photo_failed_at": F.lit(None).cast("string")}
    return patched(items, results, KEYS, {k: v for k, v in columns.items() if k in items.columns}, insert=True)


def failed(items: DataFrame, failures: DataFrame, at: str, now: str) -> DataFrame:
    """``items`` with a failure time (column ``at``) and the error's first 500 signs, for ``failures(library_id, source_path, error)``."""
    return patched(items, failures, KEYS, {at: F.lit(now), "error": short_error(F.col("new.error"))}, insert=True)


def embedding_state(embeddings: DataFrame, changes: DataFrame) -> DataFrame:
    """``embeddings`` with the state of ``changes(keys, status, error)`` put in by key; unknown keys become rows, a state other than
    failed has no error."""
    error = F.when(F.col("new.status") == "failed", short_error(F.col("new.error")))
    return patched(embeddings, changes, ["library_id", "item_id", "kind", "model"], {"status": F.col("new.status"), "error": error}, insert=True)




def orientation_results(now_has: DataFrame, results: DataFrame) -> DataFrame:
    """Orientations ``(id, source, angle, confidence)`` after new ones: a new result replaces one of at most its source's rank
    (the classifier's is higher than that of face landmarks), confidences keep three digits."""
    rank = lambda s: F.when(F.col(f"{s}.source") == "image-orientation-classifier", 2).when(F.col(f"{s}.source").isNotNull(), 1).otherwise(0)
    wins = rank("new") >= rank("old")
    pick = lambda c: F.when(wins, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    rounded = F.floor(F.col("new.confidence") * 1000 + 0.5) / 1000
    return patched(now_has, results, ["id"], {"source": pick("source"), "angle": pick("angle"), "confidence": F.when(wins, rounded).otherwise(F.col("old.confidence"))}, insert=True)


def orientation_state(doc: Column) -> Column:
    """struct(source, angle, confidence, processed_at) of a document's orientation; null unless all of it makes sense."""
    at = lambda p: F.get_json_object(doc, f"$.orientation_detection.{p}")
    source, angle, when = at("source"), at("correction_angle_clockwise").try_cast("int"), at("processed_at")
    ok = source.isin("image-orientation-classifier", "face_landmarks") & angle.isin(0, 90, 180, 270) & (F.trim(when) != "")
    return F.when(ok, F.struct(source.alias("source"), angle.alias("angle"), at("confidence").try_cast("double").alias("confidence"), when.alias("processed_at")))


def redetected_faces(old: DataFrame, new: DataFrame, least_iou: float = 0.5, keep_tagged: bool = True) -> DataFrame:
    """Faces after a new detection: ``image, id, new_id, tag_id, state``.

    ``old(image, id, tag_id, x1, y1, x2, y2)`` and ``new(image, id, x1, ...)`` are matched one to one by overlap. A new face
    takes over the tag and identity of its old one, which goes as a row of its own; the others are new. Old faces without match go,
    but for tagged ones (unless ``keep_tagged`` is off).
    """
    pairs = G.greedy_match(old, new, least_iou).select("image", F.col("old_id").alias("id"), "new_id")
    matched = old.join(pairs, ["image", "id"], "left").select("image", "id", "new_id", "tag_id")
    fresh = new.join(pairs.select("image", F.col("new_id").alias("id")), ["image", "id"], "left_anti").select("image", F.lit(None).cast(old.schema["id"].dataType).alias("id"), F.col("id").alias("new_id"), F.lit(None).cast(old.schema["tag_id"].dataType).alias("tag_id"))
    state = F.when(F.col("id").isNull(), "new").when(F.col("new_id").isNotNull(), "updated").when(F.lit(keep_tagged) & F.col("tag_id").isNotNull(), "kept").otherwise("deleted")
    return matched.unionByName(fresh).withColumn("state", state)


def located_by_gps(items: DataFrame, places: DataFrame) -> DataFrame:
    """``items`` with the places ``(id, country, city, area, area2)`` of their coordinates, and whether that ``changed`` them:
    it does unless they have the same from GPS already."""
    names = ("country", "city", "area", "area2")
    same = F.col("i.location_source").eqNullSafe("gps")
    for c in names:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"p.{c}"))
    both = items.alias("i").join(places.withColumn("__hit", F.lit(True)).alias("p"), F.col("i.id") == F.col("p.id"), "left")
    changed = F.coalesce(F.col("p.__hit") & ~same, F.lit(False))
    own = lambda c: F.when(changed, F.col(f"p.{c}") if c in names else F.lit("gps")).otherwise(F.col(f"i.{c}")) if c in (*names, "location_source") else F.col(f"i.{c}")
    return both.select(*[own(c).alias(c) for c in items.columns], changed.alias("changed"))


def sources_added(sources: DataFrame, added: DataFrame, now: str) -> DataFrame:
    """``sources(library_id, source_path, client_id, item_id, fs_object_id, is_primary, status, deleted_at, verified_at)`` with files
    seen at ``now``: they are active again, and keep a file object unless a new one is given."""
    columns = {"item_id": F.col("new.item_id"), "fs_object_id": F.coalesce("new.fs_object_id", "old.fs_object_id"), "is_primary": F.col("new.is_primary"), "status": F.lit("active"), "deleted_at": F.lit(None).cast("string"), "verified_at": F.lit(now)}
    return patched(sources, added, ["library_id", "source_path", "client_id"], columns, insert=True)


def sources_moved(sources: DataFrame, moves: DataFrame) -> DataFrame:
    """``sources`` with the paths of ``moves(library_id, client_id, old_path, new_path)``; moved ones are active."""
    on = ["library_id", "client_id"]
    both = sources.join(moves.withColumnRenamed("old_path", "source_path"), [*on, "source_path"], "left")
    hit = F.col("new_path").isNotNull()
    new = {"source_path": F.coalesce("new_path", "source_path"), "status": F.when(hit, "active").otherwise(F.col("status")), "deleted_at": F.when(~hit, F.col("deleted_at"))}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in sources.columns])


def sources_removed(sources: DataFrame, gone: DataFrame) -> DataFrame:
    """For the active sources among ``gone(library_id, source_path, client_id)``: their item, and whether it has other active ones."""
    active = sources.where("status = 'active'")
    leaving = active.join(gone, ["library_id", "source_path", "client_id"], "left_semi").groupBy("item_id").agg(F.count("*").alias("removed"))
    return leaving.join(active.groupBy("item_id").agg(F.count("*").alias("active")), "item_id").select("item_id", "removed", (F.col("active") > F.col("removed")).alias("has_others"))


def album_with(members: DataFrame, added: DataFrame) -> DataFrame:
    """``members(album_id, item_id, position)`` with ``added(album_id, item_id, nth)``: items that are in already stay where they
    are, the others follow the last position in the order of ``nth``."""
    last = members.groupBy("album_id").agg(F.max("position").alias("last"))
    fresh = added.dropDuplicates(["album_id", "item_id"]).join(members.select("album_id", "item_id"), ["album_id", "item_id"], "left_anti").join(last, "album_id", "left")
    place = F.coalesce("last", F.lit(-1)) + F.row_number().over(W.partitionBy("album_id").orderBy("nth", "item_id"))
    return members.unionByName(fresh.select("album_id", "item_id", place.cast(members.schema["position"].dataType).alias("position")))


def album_moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    """``members`` with new positions from 0, after ``moves(album_id, item_id, before_id)`` put an item before another (null: last)."""
    order = W.partitionBy("album_id").orderBy(F.coalesce("position", F.lit(2147483647)), "item_id")
    m = members.withColumn("nth", F.row_number().over(order).cast("double")).join(moves, ["album_id", "item_id"], "left")
    target = m.select("album_id", F.col("item_id").alias("before_id"), F.col("nth").alias("at"))
    hit = moves.select("album_id", "item_id", F.lit(True).alias("moves"))
    m = m.join(target, ["album_id", "before_id"], "left").join(hit, ["album_id", "item_id"], "left")
    key = F.when(F.col("moves"), F.coalesce(F.col("at") - 0.5, F.lit(1e18))).otherwise(F.col("nth"))
    place = F.row_number().over(W.partitionBy("album_id").orderBy(key, "item_id")) - 1
    return m.select("album_id", "item_id", place.alias("position"))


def person_deleted(tag_id: Column, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the rows of a person's tag; faces lose the tag only (the first table)."""
    faces, rest = tables[0], tables[1:]
    return [faces.withColumn("tag_id", F.when(~F.coalesce(F.col("tag_id") == tag_id, F.lit(False)), F.col("tag_id"))), *[t.where(~F.coalesce(F.col("tag_id") == tag_id, F.lit(False))) for t in rest]]


def faces_assigned(faces: DataFrame, assigned: DataFrame) -> DataFrame:
    """``faces`` with the tags of ``assigned(id, tag_id)``; a null tag clears."""
    return patched(faces, assigned, ["id"], {"tag_id": F.col("new.tag_id")})


def cluster_assigned(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    """Untagged faces of ``clusters(cluster_id, tag_id)`` get the cluster's person."""
    both = faces.join(clusters.withColumnRenamed("tag_id", "__tag"), "cluster_id", "left")
    return both.withColumn("tag_id", F.coalesce("tag_id", "__tag")).select(*faces.columns)


def clusters_kept(components: DataFrame, faces: DataFrame, least: int = 4) -> DataFrame:
    """Clusters ``cluster_id, members, representative`` of ``components(id, component)`` with at least ``least`` faces; the surest
    face represents its cluster, ties to the smaller id."""
    sure = F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("id")).alias("less")))
    return components.join(faces.select("id", "confidence"), "id").groupBy(F.col("component").alias("cluster_id")).agg(F.count("*").alias("members"), (-sure["less"]).alias("representative")).where(F.col("members") >= least)


def face_deleted(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs(id, boxes)`` without the n-th box (from 0) of each of ``gone(id, nth)``."""
    lost = gone.groupBy("id").agg(F.collect_set("nth").alias("lost"))
    kept = F.filter("boxes", lambda b, i: ~F.array_contains(F.coalesce("lost", F.array().cast("array<int>")), i))
    return docs.join(lost, "id", "left").withColumn("boxes", kept).drop("lost")


def missing_items(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """What is to be done so that all wanted paths are active items: ``library_id, source_path, action`` (insert, resurrect or none)."""
    known = items.select(*KEYS, "deleted_at", F.lit(True).alias("here"))
    action = F.when(F.col("here").isNull(), "insert").when(F.col("deleted_at").isNotNull(), "resurrect").otherwise("none")
    return wanted.select(*KEYS).distinct().join(known, KEYS, "left").select(*KEYS, action.alias("action"))


def folder_states(states: DataFrame, changes: DataFrame, under: str | None = None) -> DataFrame:
    """``states(library_id, folder, in_progress, done_at)`` after ``changes``; with ``under``, states below that folder that no change
    names go."""
    out = patched(states, changes, ["library_id", "folder"], {"in_progress": F.col("new.in_progress"), "done_at": F.coalesce("new.done_at", "old.done_at")}, insert=True)
    if under is None:
        return out
    here = changes.select("library_id", "folder").withColumn("__named", F.lit(True))
    below = P.covered(F.col("folder"), F.lit(under), F.lit(True))
    return out.join(here, ["library_id", "folder"], "left").where(~below | F.col("__named")).drop("__named")


def logged(log: DataFrame, operations: DataFrame) -> DataFrame:
    """The log with operations appended, each pending and numbered on from the last; an operation_id that is there stays."""
    fresh = operations.dropDuplicates(["operation_id"]).join(log.select("operation_id"), "operation_id", "left_anti")
    return log.unionByName(fresh.withColumn("state", F.lit("pending")).select(*log.columns))


def rated_items(items: DataFrame, ratings: DataFrame) -> DataFrame:
    """``items`` with the stars of ``ratings(id, star_rating)`` and the words that the text index has for them."""
    out = patched(items, ratings, ["id"], {"star_rating": F.col("new.star_rating")})
    return out.withColumn("rating_tokens", M.rating_tokens(F.col("star_rating")))


def turned_items(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Boxes ``(image, id, box, width, height)`` of the images in ``turns(image, angle)`` after the turn; the others as they are."""
    t = items.join(turns, "image", "left")
    some = F.coalesce("angle", F.lit(0)) != 0
    size = G.turned_size(F.col("width"), F.col("height"), F.col("angle"))
    return t.select("image", "id", F.when(some, G.turned(F.col("box"), F.col("width"), F.col("height"), F.col("angle"))).otherwise(F.col("box")).alias("box"), F.when(some, size["width"]).otherwise(F.col("width")).alias("width"), F.when(some, size["height"]).otherwise(F.col("height")).alias("height"))


def path_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """``items`` with what a model read in their paths (null: nothing): new values before old ones, titles only if they differ from
    the file's stem."""
    names = [c for c in ("event_start", "event_end", "country", "city", "area") if c in items.columns]
    columns = {c: F.coalesce(f"new.{c}", f"old.{c}") for c in names}
    own = F.nullif(F.trim("new.display_title"), F.lit(""))
    columns["display_title"] = F.coalesce(F.when(own != F.trim(P.stem(P.file_name(F.col("old.source_path")))), own), F.col("old.display_title"))
    return patched(items, results, ["id"], columns)


def stored_or_computed(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Each person's stored centroid, else the computed one: ``tag_id, centroid, is_stored``."""
    both = computed.select("tag_id", F.col("centroid").alias("now")).join(stored.select("tag_id", "centroid"), "tag_id", "full_outer")
    return both.select("tag_id", F.coalesce("centroid", "now").alias("centroid"), F.col("centroid").isNotNull().alias("is_stored"))


def written_vectors(faces: DataFrame, vectors: DataFrame) -> DataFrame:
    """``faces`` with ready vectors of ``vectors(id, embedding)``, at length 1; null vectors mark the face as failed."""
    status = F.when(F.col("new.embedding").isNotNull(), "ready").otherwise("failed")
    return patched(faces, vectors, ["id"], {"embedding": V.unit(F.col("new.embedding")).cast(faces.schema["embedding"].dataType), "embedding_status": status})


def identity(files: DataFrame, objects: DataFrame, since: str) -> DataFrame:
    """The known object that each observed file is: ``path, object_id, found_by, moved_from``.

    ``files(path, volume_id, file_id, fingerprint, strong_hash)``; ``objects(id, path, volume_id, file_id, fingerprint, strong_hash,
    deleted_at)``. By the system's id among active objects, else by path among active ones, else by the fingerprint among
    those deleted since ``since``: a lone candidate, or of several one with the same hash (the smallest id). Else it is new.
    """
    active, dead = objects.where("deleted_at is null"), objects.where(F.col("deleted_at") >= since)
    by_id = active.groupBy("volume_id", "file_id").agg(F.min(F.struct("id", "path")).alias("by_id"))
    by_path = active.groupBy("path").agg(F.min("id").alias("by_path"))
    lone = dead.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("lone"))
    hashed = dead.where("strong_hash is not null").groupBy("fingerprint", "strong_hash").agg(F.min("id").alias("hashed"))
    f = files.join(by_id, ["volume_id", "file_id"], "left").join(by_path, "path", "left").join(lone, "fingerprint", "left").join(hashed, ["fingerprint", "strong_hash"], "left")
    tomb = F.when(F.col("n") == 1, F.col("lone")).otherwise(F.col("hashed"))
    found = F.when(F.col("by_id.id").isNotNull(), "id").when(F.col("by_path").isNotNull(), "path").when(tomb.isNotNull(), "tombstone").otherwise("new")
    moved = F.when(F.col("by_id.path") != F.col("path"), F.col("by_id.path"))
    return f.select("path", F.coalesce("by_id.id", "by_path", tomb).alias("object_id"), found.alias("found_by"), moved.alias("moved_from"))


def scan_plan(diff: DataFrame, full: bool = False) -> DataFrame:
    """Paths whose metadata a scan reads: new and modified ones of a snapshot diff, or all that are there."""
    return diff.where(F.col("state") != "deleted" if full else F.col("state").isin("new", "modified")).select("path", "state")




def observed(objects: DataFrame, files: DataFrame, folder: str, since: str, now: str) -> DataFrame:
    """``objects`` (see ``identity``) after a look at the files directly in a folder.

    Files that are known objects take their new state, others become objects (``id`` null until one is given), active objects of
    the folder that no file is are deleted at ``now``, and ``duplicate_group`` is set anew: active objects whose hash another has.
    """
    found = identity(files, objects, since).select("path", F.col("object_id").alias("id"))
    seen = files.join(found, "path")
    columns = [c for c in objects.columns if c not in ("id", "deleted_at", "duplicate_group")]
    now_there = seen.select("id", *columns).withColumn("deleted_at", F.lit(None).cast("string"))
    rest = objects.join(seen.where("id is not null").select("id"), "id", "left_anti")
    lost = F.col("deleted_at").isNull() & (P.parent(F.col("path")) == folder.rstrip("/"))
    rest = rest.withColumn("deleted_at", F.when(lost, F.lit(now)).otherwise(F.col("deleted_at"))).select("id", *columns, "deleted_at")
    both = now_there.unionByName(rest)
    again = both.where("deleted_at is null and strong_hash is not null").groupBy("strong_hash").agg(F.count("*").alias("__n")).where("__n > 1").select("strong_hash", F.lit(True).alias("__dup"))
    group = F.when(F.col("__dup") & F.col("deleted_at").isNull(), F.concat(F.lit("dup:"), "strong_hash"))
    return both.join(again, "strong_hash", "left").withColumn("duplicate_group", group).drop("__dup")
