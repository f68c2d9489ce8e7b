"""Writes to the catalogue, duplicates, albums, people and boxes: registered queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import balls as B
from ..operators import catalogue as C
from ..operators import coverage as COV
from ..operators import duplicates as DUP
from ..operators import geometry as G
from ..operators import ingest as I
from ..operators import people as PPL
from ..operators import search as Q
from ..operators.store import once
from ..sources import files as SRC
from .queries import _bm25, captions_index, cells
from .registry import VIEWS, query, table, view

# ------------------------------------------------------------------ scans and analyses

VIEWS["observed"] = "select library_id, case when id % 12 = 0 then source_path || '.new.jpg' else source_path end as source_path, case when id % 12 = 0 then null else mime_type end as mime_type, mtime + case when id % 9 = 0 then 1 else 0 end as mtime, byte_size, case when id % 14 = 0 then 'changed' when id % 15 = 0 then null else content_hash end as content_hash, width + case when id % 14 = 0 and id % 4 = 0 then 1 else 0 end as width, height, orientation from media"

_same = "o.mtime is not distinct from n.mtime and o.byte_size is not distinct from n.byte_size and o.metadata_version = 'v2'"
_rehashed = "coalesce(n.content_hash, '') <> '' and n.content_hash is distinct from o.content_hash"
_shape = "(o.width is distinct from n.width or o.height is distinct from n.height or o.orientation is distinct from n.orientation)"
_image = "(case when n.mime_type ilike 'video/%' then false when n.mime_type ilike 'image/%' then true else not regexp_matches(lower(n.source_path), '[.](mp4|mov|mkv|avi|webm|m4v)$') end)"


@query("k3_scan", f"t as (select n.library_id, n.source_path, case when o.id is null then 'created' when {_same} and not ({_rehashed}) then 'unchanged' else 'updated' end as status, o.id as item_id, case when o.id is null then w.twin end as copy_of, {_image} as image, case when o.content_hash is null and n.content_hash is not null then false when o.content_hash is not null and n.content_hash is null then true when o.content_hash is null then {_shape} or o.byte_size is distinct from n.byte_size or o.mtime is distinct from n.mtime else {_shape} end as changed, o.deleted_at from observed n left join media o on o.library_id = n.library_id and o.source_path = n.source_path left join (select library_id, content_hash, min(id) as twin from media where deleted_at is null and content_hash is not null group by all) w on w.library_id = n.library_id and w.content_hash = n.content_hash) select library_id, source_path, status, item_id, copy_of, status = 'updated' and image and changed as stale, image and ((status = 'created' and copy_of is null) or (status = 'updated' and changed)) as follow_up, case when status = 'unchanged' then deleted_at end as deleted_at from t", ("media", "observed"))
def k3(spark, d):
    return I.scan(view(spark, d, "media"), view(spark, d, "observed"), "v2", "2026-03-01")


VIEWS["findings"] = "select library_id, source_path, case when id % 3 = 0 then 'Rome, Italy' end as location, case when id % 4 = 0 then 'Italy' end as country, case when id % 5 = 0 then 'Rome' end as city, null as place, id % 5 as people, case when id % 7 = 0 then id % 3 end as face_count, 20.0 as age_min, 30.0 as age_max from media where id % 2 = 0"


@query("k4_analysed_photos", "select m.id, case when f.source_path is null or coalesce(m.location_source in ('gps', 'embedded_xmp', 'path_llm', 'path_script'), false) then m.country else coalesce(f.country, m.country) end as country, case when f.source_path is null or coalesce(m.location_source in ('gps', 'embedded_xmp', 'path_llm', 'path_script'), false) then m.location_source else coalesce(case when coalesce(f.country, f.city) is not null then 'ai_vision' end, m.location_source) end as location_source, case when f.source_path is null then m.people else coalesce(f.face_count, f.people) end as people, case when f.source_path is null then m.photo_failed_at end as failed_at, case when f.source_path is null then m.photo_done_at else '2026-03-01' end as done_at, coalesce(f.location, m.location_name) as location_name from media m left join findings f on f.library_id = m.library_id and f.source_path = m.source_path", ("media", "findings"))
def k4(spark, d):
    f = view(spark, d, "findings").withColumn("place", F.col("place").cast("string"))
    out = I.analysed_photos(view(spark, d, "media"), f, "2026-03-01")
    return out.select("id", "country", "location_source", "people", F.col("photo_failed_at").alias("failed_at"), F.col("photo_done_at").alias("done_at"), "location_name")


@query("k2_embedding_states", "select v.item_id, v.kind, case when v.kind = 'image' and v.item_id % 3 = 0 then 'failed' else v.status end as status, case when v.kind = 'image' and v.item_id % 3 = 0 then left(repeat('e' || cast(v.item_id as string), 300), 500) else v.error end as error from vectors v", ("vectors",))
def k2(spark, d):
    v = view(spark, d, "vectors").withColumn("library_id", F.lit("L"))
    change = v.where("kind = 'image' and item_id % 3 = 0").select("library_id", "item_id", "kind", "model", F.lit("failed").alias("status"), F.repeat(F.concat(F.lit("e"), F.col("item_id").cast("string")), F.lit(300)).alias("error"))
    return I.embedding_state(v, change).select("item_id", "kind", "status", "error")


@query("k6_orientation_results", "select id, case when id % 2 = 0 then 'image-orientation-classifier' when id % 3 = 0 then 'image-orientation-classifier' else 'face_landmarks' end as source, case when id % 2 = 0 then 90 when id % 3 = 0 then 180 else 270 end as angle, case when id % 2 = 0 then 0.988 when id % 3 = 0 then 0.5 else 0.123 end as confidence from names", ("names",))
def k6(spark, d):
    n = view(spark, d, "names")
    has = n.where("id % 3 = 0").select("id", F.lit("image-orientation-classifier").alias("source"), F.lit(180).alias("angle"), F.lit(0.5).alias("confidence"))
    i = F.col("id") % 2 == 0
    new = n.select("id", F.when(i, "image-orientation-classifier").otherwise("face_landmarks").alias("source"), F.when(i, 90).otherwise(270).alias("angle"), F.when(i, 0.98765).otherwise(0.1234).alias("confidence"))
    return I.orientation_results(has, new)


@query("k9_gps_places", "select id, changed, case when changed then 'gps' else location_source end as location_source, case when changed then 'Land en' else country end as country from (select *, id % 2 = 0 and not (location_source is not distinct from 'gps' and country is not distinct from 'Land en' and trim(city) is not distinct from 'X' and area is null and area2 is null) as changed from media)", ("media",))
def k9(spark, d):
    m = view(spark, d, "media")
    places = m.where("id % 2 = 0").select("id", F.lit("Land en").alias("country"), F.lit("X").alias("city"), F.lit(None).cast("string").alias("area"), F.lit(None).cast("string").alias("area2"))
    return I.located_by_gps(m, places).select("id", "changed", "location_source", "country")


VIEWS["sources"] = "select id * 10 + 1 as source_id, library_id, source_path, 'c' || cast(id % 2 as string) as client_id, id - id % 3 as item_id, case when id % 4 = 0 then null else 'o' || cast(id as string) end as fs_object_id, id % 3 = 0 as is_primary, case when id % 5 = 0 then 'deleted' else 'active' end as status, case when id % 5 = 0 then '2026-01-01' end as deleted_at, '2026-01-02' as verified_at from media"


@query("k17_sources", "select source_id, case when source_id % 7 = 0 then source_path || '.moved' else source_path end as source_path, case when source_id % 7 = 0 or source_id % 3 = 0 then 'active' else status end as status, case when source_id % 7 = 0 or source_id % 3 = 0 then null else deleted_at end as deleted_at, case when source_id % 3 = 0 then '2026-03-01' else verified_at end as verified_at from sources", ("sources",))
def k17(spark, d):
    s = view(spark, d, "sources")
    seen = s.where("source_id % 3 = 0").select("library_id", "source_path", "client_id", "item_id", F.lit(None).cast("string").alias("fs_object_id"), "is_primary")
    moves = s.where("source_id % 7 = 0").select("library_id", "client_id", F.col("source_path").alias("old_path"), F.concat("source_path", F.lit(".moved")).alias("new_path"))
    return I.sources_moved(I.sources_added(s, seen, "2026-03-01"), moves).select("source_id", "source_path", "status", "deleted_at", "verified_at")


@query("k17_removed_sources", "select item_id, count(*) filter (source_id % 2 = 1 and source_id % 3 = 0) as removed, count(*) > count(*) filter (source_id % 2 = 1 and source_id % 3 = 0) as has_others from sources where status = 'active' group by item_id having count(*) filter (source_id % 2 = 1 and source_id % 3 = 0) > 0", ("sources",))
def k17r(spark, d):
    s = view(spark, d, "sources")
    return I.sources_removed(s, s.where("source_id % 2 = 1 and source_id % 3 = 0").select("library_id", "source_path", "client_id"))


@query("a29_source_counts", "select m.id, count(s.source_id) as sources from media m left join sources s on s.item_id = m.id and s.status = 'active' group by m.id", ("media", "sources"))
def a29(spark, d):
    return COV.source_counts(view(spark, d, "media").select("id"), view(spark, d, "sources"))


@query("k16_missing_items", "select library_id, source_path, case when deleted_at is null then 'none' else 'resurrect' end as action from media where id % 3 = 0 union all select library_id, source_path || '.x', 'insert' from media where id % 3 = 1", ("media",))
def k16m(spark, d):
    m = view(spark, d, "media")
    wanted = m.where("id % 3 = 0").select("library_id", "source_path").unionByName(m.where("id % 3 = 1").select("library_id", F.concat("source_path", F.lit(".x")).alias("source_path")))
    return I.missing_items(m, wanted)


@query("k23_rated_items", "select id, case when id % 4 = 0 then id % 5 else star_rating end as star_rating, case case when id % 4 = 0 then id % 5 else star_rating end when -1 then 'file_rating_rejected' when 0 then 'file_rating_unrated' else coalesce('file_rating_' || cast(case when id % 4 = 0 then id % 5 else star_rating end as string), '') end as rating_tokens from media", ("media",))
def k23(spark, d):
    m = view(spark, d, "media").select("id", "star_rating")
    return I.rated_items(m, m.where("id % 4 = 0").select("id", (F.col("id") % 5).alias("star_rating")))


@query("k20_operation_log", "select event_id as operation_id, case when event_id % 3 = 0 then 'done' else 'pending' end as state from events")
def k20(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("operation_id"), "event_type")
    return I.logged(e.where("operation_id % 3 = 0").withColumn("state", F.lit("done")), e).select("operation_id", "state")


@query("k21_folder_states", "select library_id, folder, id % 2 = 0 as in_progress, case when id % 3 = 0 then '2026-03-01' when id % 2 = 1 then '2026-01-01' end as done_at from (select id, 'L' as library_id, '/lib/' || cast(id as string) as folder from names) where id % 2 = 0 or not starts_with(folder, '/lib/1')", ("names",))
def k21(spark, d):
    n = view(spark, d, "names").select("id", F.lit("L").alias("library_id"), F.concat(F.lit("/lib/"), F.col("id").cast("string")).alias("folder"))
    states = n.where("id % 2 = 1").select("library_id", "folder", F.lit(False).alias("in_progress"), F.when(F.col("id") % 3 == 0, "2026-03-01").otherwise("2026-01-01").alias("done_at"))
    changes = n.where("id % 2 = 0").select("library_id", "folder", F.lit(True).alias("in_progress"), F.when(F.col("id") % 3 == 0, "2026-03-01").alias("done_at"))
    kept = I.folder_states(states, changes)
    below = F.col("folder").startswith("/lib/1")
    return kept.where(~below | F.col("in_progress"))


VIEWS["objects"] = "select id, source_path as path, 'v' || cast(id % 2 as string) as volume_id, id as file_id, cast(byte_size as string) || ':' || cast(mtime as string) as fingerprint, content_hash as strong_hash, case when id % 4 = 0 then '2026-02-28T12:00' when id % 9 = 0 then '2026-01-01' end as deleted_at from media"
VIEWS["seen"] = "select case when id % 3 = 0 then path || '.moved' else path end as path, volume_id, case when id % 5 = 0 then file_id + 1000000 else file_id end as file_id, fingerprint, strong_hash from objects"


@query("c4_file_identity", "a as (select * from objects where deleted_at is null), t as (select * from objects where deleted_at >= '2026-02-28'), bi as (select volume_id, file_id, min(id) as i, arg_min(path, id) as p from a group by all), bp as (select path, min(id) as i from a group by path), l as (select fingerprint, count(*) as n, min(id) as i from t group by 1), h as (select fingerprint, strong_hash, min(id) as i from t where strong_hash is not null group by all) select s.path, coalesce(bi.i, bp.i, case when l.n = 1 then l.i else h.i end) as object_id, case when bi.i is not null then 'id' when bp.i is not null then 'path' when coalesce(case when l.n = 1 then l.i else h.i end) is not null then 'tombstone' else 'new' end as found_by, case when bi.p <> s.path then bi.p end as moved_from from seen s left join bi on bi.volume_id = s.volume_id and bi.file_id = s.file_id left join bp on bp.path = s.path left join l on l.fingerprint = s.fingerprint left join h on h.fingerprint = s.fingerprint and h.strong_hash = s.strong_hash", ("objects", "seen"))
def c4(spark, d):
    return I.identity(view(spark, d, "seen"), view(spark, d, "objects"), "2026-02-28")


_diff = "t as (select path, case when k.path is null then 'new' when a.path is null then 'deleted' when a.size <> k.size or a.mtime <> k.mtime then 'modified' else 'same' end as state from disk a full join known k using (path))"


@query("c5_scan_plan", f"{_diff} select path, state from t where state in ('new', 'modified')", ("disk", "known"))
def c5(spark, d):
    return I.scan_plan(C.snapshot_diff(view(spark, d, "disk"), view(spark, d, "known")))


@query("a32_changes_by_subfolder", f"{_diff} select nullif(regexp_extract(substr(path, 6), '^([^/]+)/', 1), '') as subfolder, count(*) filter (state = 'new') as \"new\", count(*) filter (state = 'modified') as modified, count(*) filter (state = 'deleted') as deleted from t group by 1", ("disk", "known"))
def a32(spark, d):
    return COV.diff_by_subfolder(C.snapshot_diff(view(spark, d, "disk"), view(spark, d, "known")), "/lib")


@query("z18_scan_summary", f"{_diff} select count(*) filter (state = 'new') as \"new\", count(*) filter (state = 'modified') as modified, count(*) filter (state = 'deleted') as deleted, count(distinct regexp_extract(path, '^(.*)/[^/]*$', 1)) filter (state <> 'deleted') as folders from t", ("disk", "known"))
def z18(spark, d):
    return COV.diff_summary(C.snapshot_diff(view(spark, d, "disk"), view(spark, d, "known")))


# ------------------------------------------------------------------ duplicates

VIEWS["copies"] = "select id, path, size + case when id % 29 = 0 then 200000000 else 0 end as size, mtime, case when id % 4 = 0 then null when id % 29 = 0 then '' else strong_hash end as content_hash, case when id % 3 = 0 then null else strong_hash end as found_hash, id % 10 <> 0 as on_disk, case when id % 31 = 0 then '2026-01-01' end as deleted_at from files"
_scan = "s as (select *, coalesce(nullif(trim(content_hash), ''), case when size <= 134217728 and on_disk then nullif(found_hash, '') end) as hash from copies where deleted_at is null and starts_with(path, '/lib/src1')), k as (select id, path, size, nullif(trim(content_hash), '') as hash from copies where deleted_at is null and nullif(trim(content_hash), '') is not null), o as (select * from k union all select id, path, size, hash from s where hash is not null and id not in (select id from k)), p as (select s.id, s.path, o.id as other_id, o.path as other_path, o.size as other_size, 'hash' as basis from s join o on o.hash = s.hash and o.path <> s.path union all select a.id, a.path, b.id, b.path, b.size, 'weak' from s a join s b on a.hash is null and b.hash is null and lower(regexp_extract(a.path, '([^/]*)$', 1)) = lower(regexp_extract(b.path, '([^/]*)$', 1)) and a.size = b.size and a.mtime = b.mtime and a.path <> b.path)"
FOLDER = "/lib/src1"


def _found(spark, d):
    c = view(spark, d, "copies")
    return DUP.pairs(c, DUP.scanned(c, FOLDER, True))


def _members(spark, d):
    c = view(spark, d, "copies")
    return DUP.members(c, DUP.scanned(c, FOLDER, True))


@query("a23_duplicate_files", _scan.replace("'/lib/src1'", "'/lib/src1/'") + " select id, path, basis, count(*) as duplicates from p group by id, path, basis", ("copies",))
def a23(spark, d):
    return DUP.duplicate_files(_members(spark, d)).select("id", "path", "basis", "duplicates")


@query("z29_files_left", _scan.replace("'/lib/src1'", "'/lib/src1/'") + " select id, count(*) as duplicates from p where id % 2 <> 0 and other_id % 2 <> 0 group by id", ("copies",))
def z29_left(spark, d):
    return DUP.left_after_deletion(_members(spark, d), view(spark, d, "copies").where("id % 2 = 0")).select("id", "duplicates")


@query("c6_duplicate_scan", _scan.replace("'/lib/src1'", "'/lib/src1/'") + " select id, basis, count(*) as duplicates, string_agg(cast(other_id as string), ',' order by other_path, other_id) as ids from p group by id, basis", ("copies",))
def c6(spark, d):
    rows = DUP.listed(_found(spark, d))
    return rows.select("id", "basis", F.size("duplicates").cast("long").alias("duplicates"), F.array_join(F.transform("duplicates", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("c6_skipped_files", _scan.replace("'/lib/src1'", "'/lib/src1/'") + " select count(*) filter (hash is null) as unresolved, count(*) filter (hash is null and size > 134217728) as large, count(*) filter (hash is null and size <= 134217728 and not on_disk) as missing from s", ("copies",))
def c6_skips(spark, d):
    return DUP.skips(DUP.scanned(view(spark, d, "copies"), FOLDER, True))


@query("a24_folder_summaries", _scan.replace("'/lib/src1'", "'/lib/src1/'") + ", e as (select other_path as path, max(other_size) as size from p group by 1) select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, count(*) as paths, cast(sum(size) as bigint) as bytes, count(*) filter (starts_with(path, '/lib/src1/')) as inside, count(*) filter (not starts_with(path, '/lib/src1/')) as outside from e group by 1", ("copies",))
def a24f(spark, d):
    return DUP.folder_summaries(_members(spark, d), FOLDER, True)


@query("a25_inside_outside", _scan.replace("'/lib/src1'", "'/lib/src1/'") + ", e as (select lower(other_path) as path, max(other_size) as size, starts_with(lower(other_path), '/lib/src1/') as i from p group by 1, 3) select (select count(distinct id) from p where starts_with(other_path, '/lib/src1/')) as files_inside, (select count(distinct id) from p where not starts_with(other_path, '/lib/src1/')) as files_outside, cast(coalesce((select sum(size) from e where i), 0) as bigint) as bytes_inside, cast(coalesce((select sum(size) from e where not i), 0) as bigint) as bytes_outside", ("copies",))
def a25(spark, d):
    return DUP.inside_outside(_members(spark, d), FOLDER)


@query("a26_collapsed_pairs", _scan.replace("'/lib/src1'", "'/lib/src1/'") + ", a as (select id, count(*) as n, min(path) as path, min(other_id) as partner from p group by id), h as (select *, lower(regexp_extract(path, '^(.*)/[^/]*$', 1)) = '/lib/src1/en' as here from a) select a.id from h a left join h b on b.id = a.partner and b.n = 1 where not (a.n = 1 and coalesce(b.partner = a.id, false)) or case when a.here <> b.here then a.here else a.id < a.partner end", ("copies",))
def a26(spark, d):
    return DUP.collapsed(_members(spark, d), "/lib/src1/en")


@query("a27_marked_totals", _scan.replace("'/lib/src1'", "'/lib/src1/'") + ", e as (select other_id, min(other_path) as path, max(other_size) as size from p where other_id % 2 = 0 group by 1) select count(*) as files, count(distinct regexp_extract(path, '^(.*)/[^/]*$', 1)) as folders, cast(coalesce(sum(size), 0) as bigint) as bytes from e", ("copies",))
def a27(spark, d):
    return DUP.marked_totals(_members(spark, d), view(spark, d, "copies").where("id % 2 = 0"))


@query("z29_after_deletion", _scan.replace("'/lib/src1'", "'/lib/src1/'") + " select id, other_id from p where id % 2 <> 0 and other_id % 2 <> 0", ("copies",))
def z29(spark, d):
    return DUP.after_deletion(_found(spark, d), view(spark, d, "copies").where("id % 2 = 0")).select("id", "other_id")


# ------------------------------------------------------------------ people, albums, search

VIEWS["hints"] = "select vec_id % 200 as item_id, (vec_id * 3) % 10 as tag_id, vec_id as face_id, 0.5 as similarity from embeddings where vec_id % 3 = 1"
VIEWS["groups"] = "select vec_id % 3 as group_id, label as tag_id from embeddings where vec_id < 9"
VIEWS["persons"] = "select distinct label as tag_id, 'Person ' || chr(cast(75 - label as int)) as name, label % 4 = 0 as pinned from embeddings"


@query("j7_confirmed_or_suggested_items", "select id from items where id in (select item_id from faces where tag_id = 1 union all select item_id from hints where tag_id = 1) and id in (select item_id from faces where tag_id = 3 union all select item_id from hints where tag_id = 3)", ("items", "faces", "hints"))
def j7(spark, d):
    marks = PPL.tagged(view(spark, d, "faces"), view(spark, d, "hints"))
    return PPL.with_people(view(spark, d, "items"), marks, [1, 3]).select("id")


@query("j8_people_groups", "select id from items where id in (select f.item_id from faces f join groups g on g.tag_id = f.tag_id and g.group_id = 0) and id in (select f.item_id from faces f join groups g on g.tag_id = f.tag_id and g.group_id = 1)", ("items", "faces", "groups"))
def j8(spark, d):
    return PPL.with_groups(view(spark, d, "items"), PPL.tagged(view(spark, d, "faces")), view(spark, d, "groups"), [0, 1]).select("id")


@query("v13_confirmed_marks", "select id, case when id in (select item_id from faces where tag_id in (1, 2)) then 'confirmed' when id in (select item_id from hints where tag_id in (1, 2)) then 'suggested' else 'none' end as mark from items", ("items", "faces", "hints"))
def v13(spark, d):
    return PPL.confirmed_or_suggested(view(spark, d, "items").select("id"), view(spark, d, "faces"), view(spark, d, "hints"), [1, 2])


@query("j9_albums_by_members", "select distinct album_id from members where item_id in (select id from media where deleted_at is null and coalesce(photo_taken_at, file_created_at) >= '2012') and album_id in (select album_id from members where item_id in (select id from media where deleted_at is null and coalesce(photo_taken_at, file_created_at) <= '2009')) and album_id in (select album_id from members where item_id in (select id from media where deleted_at is null and (country ilike '%en%' or city ilike '%en%' or area ilike '%en%' or area2 ilike '%en%' or place ilike '%en%' or location_name ilike '%en%')))", ("members", "media"))
def j9(spark, d):
    from ..functions import predicates as PR

    members = view(spark, d, "members")
    conditions = [PR.taken_between("2012", None), PR.taken_between(None, "2009"), PR.place_like("en")]
    return PPL.albums_filtered(members.select("album_id").distinct(), members, view(spark, d, "media"), conditions)


@query("a35_album_people", "c as (select distinct m.album_id, f.tag_id from members m join faces f on f.item_id = m.item_id where f.tag_id is not null), dd as (select distinct l_orderkey as album_id, l_partkey % 10 as tag_id from lineitem where l_linenumber = 1) select coalesce(c.album_id, dd.album_id) as album_id, coalesce(c.tag_id, dd.tag_id) as tag_id, case when c.tag_id is null then 'direct' when dd.tag_id is null then 'computed' else 'both' end as source from c full join dd on c.album_id = dd.album_id and c.tag_id = dd.tag_id", ("members", "faces"))
def a35(spark, d):
    direct = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("album_id"), (F.col("l_partkey") % 10).alias("tag_id")).distinct()
    return PPL.album_people(view(spark, d, "members"), view(spark, d, "faces"), direct)


VIEWS["places"] = "select distinct l_orderkey as album_id, l_linenumber as item_id from lineitem"


@query("k14_album_with", "b as (select album_id, max(item_id) as last from places where item_id <= 2 group by 1), n as (select p.album_id, item_id, coalesce(last, -1) + row_number() over (partition by p.album_id order by item_id) as position from places p left join b on b.album_id = p.album_id where item_id > 2) select album_id, count(*) as items, cast(max(position) as bigint) as last from (select album_id, item_id, item_id as position from places where item_id <= 2 union all select * from n) group by album_id", ("places",))
def k14(spark, d):
    m = view(spark, d, "places").withColumn("position", F.col("item_id"))
    out = I.album_with(m.where("position <= 2"), m.select("album_id", "item_id", F.col("item_id").alias("nth")))
    return out.groupBy("album_id").agg(F.count("*").alias("items"), F.max("position").cast("long").alias("last"))


@query("k14_album_moved", "select album_id, item_id, row_number() over (partition by album_id order by k, item_id) - 1 as position from (select p.album_id, p.item_id, case when p.item_id = 1 then 1e18 when p.item_id = 3 then coalesce(f.nth - 0.5, 1e18) else nth0 end as k from (select *, row_number() over (partition by album_id order by item_id) as nth0 from places) p left join (select album_id, nth as nth from (select album_id, item_id, row_number() over (partition by album_id order by item_id) as nth from places) where item_id = 1) f on f.album_id = p.album_id)", ("places",))
def k14_moved(spark, d):
    m = view(spark, d, "places").withColumn("position", F.col("item_id"))
    moves = m.where("item_id in (1, 3)").select("album_id", "item_id", F.when(F.col("item_id") == 3, F.lit(1)).alias("before_id"))
    return I.album_moved(m, moves)


@query("k16_assigned_faces", "select id, case when id % 5 = 0 then null when id % 7 = 0 then 99 else tag_id end as tag_id from faces", ("faces",))
def k16(spark, d):
    f = view(spark, d, "faces")
    a = f.where("id % 5 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 5 != 0, F.lit(99)).alias("tag_id"))
    return I.faces_assigned(f, a).select("id", "tag_id")


@query("z10_cluster_assigned", "select id, coalesce(tag_id, case when cluster_id in (1, 2) then 70 + cluster_id end) as tag_id from faces", ("faces",))
def z10(spark, d):
    f = view(spark, d, "faces")
    clusters = f.where("cluster_id in (1, 2)").select("cluster_id", (F.col("cluster_id") + 70).alias("tag_id")).distinct()
    return I.cluster_assigned(f, clusters).select("id", "tag_id")


@query("k15_person_deleted", "select 'face' as kind, count(*) as n from faces where tag_id is not null and tag_id <> 3 union all select 'hint', count(*) from hints where tag_id <> 3 union all select 'group', count(*) from groups where tag_id <> 3", ("faces", "hints", "groups"))
def k15(spark, d):
    faces, hints, groups = I.person_deleted(F.lit(3), view(spark, d, "faces"), view(spark, d, "hints"), view(spark, d, "groups"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(faces.where("tag_id is not null"), "face").unionByName(count(hints, "hint")).unionByName(count(groups, "group"))


@query("l8_tag_options", "c as (select p.tag_id, name, pinned, (select count(*) from faces f where f.tag_id = p.tag_id) as faces from persons p) select tag_id, name, faces, row_number() over (order by cast(tag_id = 4 as int) desc, faces desc, lower(name), tag_id) as place from c order by cast(tag_id = 4 as int) desc, faces desc, lower(name), tag_id limit 7", ("persons", "faces"))
def l8(spark, d):
    c = PPL.tag_counts(view(spark, d, "persons"), view(spark, d, "faces"))
    return PPL.tag_options(c, 4).select("tag_id", "name", "faces", "place")


@query("z28_visible_tags", "c as (select p.tag_id, name, pinned, (select count(*) from faces f where f.tag_id = p.tag_id) as faces from persons p) select distinct tag_id, faces from c where pinned or tag_id in (2, 3) or tag_id = 9", ("persons", "faces"))
def z28(spark, d):
    c = PPL.tag_counts(view(spark, d, "persons"), view(spark, d, "faces"))
    return PPL.visible_tags(c, [2, 3], [9]).select("tag_id", "faces")


@query("z1_tag_list", "select tag_id, name, row_number() over (order by cast(pinned as int) desc, lower(name), tag_id) as place from persons", ("persons",))
def z1(spark, d):
    from pyspark.sql import Window as W

    p = view(spark, d, "persons")
    return p.orderBy(*PPL.tag_order()).select("tag_id", "name", F.row_number().over(W.orderBy(*PPL.tag_order())).alias("place"))


@query("z2_faces_of_items", "select f.id, f.item_id, source_path, width as ref_width, row_number() over (partition by f.item_id order by f.id) as nth from faces f join media m on m.id = f.item_id", ("faces", "media"))
def z2(spark, d):
    f = view(spark, d, "faces").withColumn("ref_width", F.lit(None).cast("int")).withColumn("ref_height", F.lit(None).cast("int"))
    return PPL.faces_of_items(f, view(spark, d, "media")).select("id", "item_id", "source_path", "ref_width", "nth")


@query("l6_confidence_page", "select id, round(confidence, 6)::double as confidence from faces order by round(faces.confidence, 6) desc nulls last, id limit 150 offset 20", ("faces",))
def l6(spark, d):
    return PPL.confidence_page(view(spark, d, "faces"), 150, 20).select("id", F.col("confidence").cast("double").alias("confidence"))


@query("z9_cluster_pages", "select cluster_id, count(*) as members, count(*) filter (tag_id is null) as untagged, arg_max(id, (confidence, -id)) as representative from faces group by 1 order by members desc, cluster_id limit 5", ("faces",))
def z9(spark, d):
    return PPL.cluster_pages(view(spark, d, "faces"), 5)


@query("a20_embedding_stats", "select count(*) as faces, count(*) filter (s = 'ready') as ready, count(*) filter (s = 'failed') as failed, count(*) filter (s is null or s = 'pending') as pending, count(cluster_id) as clustered, count(*) filter (s = 'ready' and tag_id is null and cluster_id is null) as open, count(distinct cluster_id) as clusters from (select case id % 4 when 0 then 'ready' when 1 then 'failed' when 2 then 'pending' end as s, tag_id, case when id % 3 = 0 then null else cluster_id end as cluster_id from faces)", ("faces",))
def a20(spark, d):
    i = F.col("id")
    f = view(spark, d, "faces").withColumn("embedding_status", F.when(i % 4 == 0, "ready").when(i % 4 == 1, "failed").when(i % 4 == 2, "pending")).withColumn("cluster_id", F.when(i % 3 != 0, F.col("cluster_id")))
    return PPL.embedding_stats(f)


CENTROIDS = """e as (select tag_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as pos from faces where tag_id is not null),
m as (select tag_id, pos, avg(x) as x from e group by all), c as (select tag_id, list(x order by pos) as v from m group by tag_id)"""


@query("v7_person_for_faces", f"{CENTROIDS}, s as (select f.id, c.tag_id, list_cosine_similarity(f.embedding::double[], c.v) as s from faces f, c where f.tag_id is null) select id, arg_max(tag_id, (round(s, 9), -tag_id)) as tag_id, round(max(s), 6) as similarity from s where s >= 0.15 group by id", ("faces",))
def v7(spark, d):
    f = view(spark, d, "faces")
    return PPL.person_for(f.where("tag_id is null"), Q.centroids(f), 0.15).select("id", "tag_id", F.round("similarity", 6).alias("similarity"))


@query("v7_person_for_clusters", f"{CENTROIDS}, e2 as (select cluster_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as pos from faces), k as (select cluster_id, list(x order by pos) as v from (select cluster_id, pos, avg(x) as x from e2 group by all) group by 1), s as (select k.cluster_id as id, c.tag_id, list_cosine_similarity(k.v, c.v) as s from k, c) select id, arg_max(tag_id, (round(s, 9), -tag_id)) as tag_id, round(max(s), 6) as similarity from s where s >= 0.3 group by id", ("faces",))
def v7c(spark, d):
    f = view(spark, d, "faces")
    return PPL.person_for(PPL.cluster_centroids(f), Q.centroids(f), 0.3).select("id", "tag_id", F.round("similarity", 6).alias("similarity"))


_q = "(select embedding::double[] from embeddings where vec_id = 5)"


@query("v2_description_search", f"select item_id as id, round(list_cosine_similarity(embedding::double[], {_q}), 6) as similarity from vectors join media on media.id = item_id where kind = 'text' and deleted_at is null and event_start >= '2000' order by round(list_cosine_similarity(embedding::double[], {_q}), 9) desc, item_id limit 30", ("vectors", "media"))
def v2(spark, d):
    v = view(spark, d, "vectors").where("kind = 'text'").select(F.col("item_id").alias("id"), "embedding")
    items = view(spark, d, "media").where("deleted_at is null and event_start >= '2000'").select("id")
    return Q.nearest(items.join(v, "id"), Q.vector_of(_images(spark, d), 5), 30).select("id", F.round("similarity", 6).alias("similarity"))


def _images(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query("v3_similar_images", "s as (select id, embedding::double[] as v from media join embeddings on vec_id = id where deleted_at is null and source_path like '%/IMG_12.%') select id, 1.0::double as score from s union all select * from (select m.id, round(list_cosine_similarity(e.embedding::double[], s.v), 6) as score from media m join embeddings e on e.vec_id = m.id, s where m.deleted_at is null and m.id <> s.id and list_cosine_similarity(e.embedding::double[], s.v) >= 0.1 order by list_cosine_similarity(e.embedding::double[], s.v) desc, m.id limit 99)", ("media",))
def v3(spark, d):
    items = view(spark, d, "media").where("deleted_at is null")
    path = items.where("id = 12").select("source_path").first()[0]
    return Q.similar_images(items, _images(spark, d), path, 0.1, cells=cells(spark, d)).select("id", F.round("score", 6).alias("score"))


@query("v12_hybrid_search", f"v as (select item_id as id, list_cosine_similarity(embedding::double[], {_q}) as s from vectors where kind = 'image'), t as (select item_id as id, list_cosine_similarity(embedding::double[], {_q}) as s from vectors where kind = 'text'), v2 as (select *, row_number() over (order by round(s, 9) desc, id) as k from v), t2 as (select *, row_number() over (order by round(s, 9) desc, id) as k from t), f as (select id, sum(1.0::double / (60 + k)) as score from (select id, k from v2 where k <= 100 union all select id, k from t2 where k <= 100) group by id order by score desc, id limit 60) select f.id, round(score, 9) as score, round(v2.s, 6) as image_similarity, round(t2.s, 6) as text_similarity from f left join v2 on v2.id = f.id and v2.k <= 100 left join t2 on t2.id = f.id and t2.k <= 100", ("vectors",))
def v12(spark, d):
    v = view(spark, d, "vectors")
    side = lambda kind: v.where(F.col("kind") == kind).select(F.col("item_id").alias("id"), "embedding")
    found = Q.hybrid(side("image"), side("text"), Q.vector_of(_images(spark, d), 5), limit=60)
    return found.select("id", F.round("score", 9).alias("score"), F.round("image_similarity", 6).alias("image_similarity"), F.round("text_similarity", 6).alias("text_similarity"))


def _side(spark, d, kind: str) -> B.Cells:
    """The vectors of one kind in cells, built once in an application."""
    v = view(spark, d, "vectors").where(F.col("kind") == kind).select(F.col("item_id").alias("id"), "embedding")
    return once(table(spark, d, "embeddings"), f"cells {kind} {d}", lambda: B.cells_of(v))


_kws = "(select embedding::double[] as e, row_number() over (order by vec_id) as n from embeddings where vec_id in (7, 8, 9))"


@query("v12_search_chain", f"ok as (select id from captions where library_id = 'L' and deleted_at is null and taken >= '2012'), v as (select item_id as id, round(list_cosine_similarity(embedding::double[], {_q}), 9) as s from vectors where kind = 'image' and item_id in (select id from ok)), t as (select item_id as id, round(list_cosine_similarity(embedding::double[], {_q}), 9) as s from vectors where kind = 'text' and item_id in (select id from ok)), v2 as (select *, row_number() over (order by s desc, id) as k from v), t2 as (select *, row_number() over (order by s desc, id) as k from t), f as (select id, sum(1.0::double / (60 + k)) as score from (select id, k from v2 where k <= 100 union all select id, k from t2 where k <= 100) group by id order by score desc, id limit 60), c as (select f.id, k.n, greatest(case when list_cosine_similarity(a.embedding::double[], k.e) >= 0.12 then list_cosine_similarity(a.embedding::double[], k.e) end, case when list_cosine_similarity(b.embedding::double[], k.e) >= 0.15 then list_cosine_similarity(b.embedding::double[], k.e) end) as credit from f cross join {_kws} k left join vectors a on a.item_id = f.id and a.kind = 'image' left join vectors b on b.item_id = f.id and b.kind = 'text'), h as (select id, count(credit) as hits, sum(coalesce(credit, 0)) / 3 as coverage, string_agg(cast(cast(round(credit * 10000) as bigint) as varchar), ',' order by n) as hit_scores from c group by id), {_bm25('captions', ['license', 'the', 'nature'])}, kw2 as (select id, score from kw where id in (select id from ok) order by score desc, id limit 100) select f.id, round(f.score, 9) as score, round(v2.s, 6) as image_similarity, round(t2.s, 6) as text_similarity, round(kw2.score, 6) as keyword_score, hits, round(coverage, 6) as coverage, coalesce(hit_scores, '') as hit_scores from f join h on h.id = f.id left join v2 on v2.id = f.id and v2.k <= 100 left join t2 on t2.id = f.id and t2.k <= 100 left join kw2 on kw2.id = f.id", ("vectors", "items", "captions"))
def v12_chain(spark, d):
    e = _images(spark, d)
    allowed = C.active(view(spark, d, "captions"), "L").where("taken >= '2012'").select("id")
    keywords = [list(r[0]) for r in e.where("id in (7, 8, 9)").orderBy("id").select("embedding").collect()]
    found = Q.hybrid_search(_side(spark, d, "image"), _side(spark, d, "text"), Q.vector_of(e, 5), keywords, captions_index(spark, d), ["license", "the", "nature"], allowed, limit=60, image_threshold=0.12, text_threshold=0.15)
    scores = F.array_join(F.transform("hit_scores", lambda s: F.round(s * 10000).cast("long").cast("string")), ",")
    rounded = [F.round(c, n).alias(c) for c, n in (("score", 9), ("image_similarity", 6), ("text_similarity", 6), ("keyword_score", 6), ("coverage", 6))]
    return found.select("id", *rounded, "hits", scores.alias("hit_scores"))


@query("a15_face_clusters", "recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35), r(id, c) as (select distinct a, a from e union select e.b, r.c from r join e on e.a = r.id), k as (select id, min(c) as c from r group by id) select c as cluster_id, count(*) as members, arg_max(k.id, (0.5 + (k.id % 50) / 100.0, -k.id)) as representative from k group by c having count(*) >= 4")
def a15(spark, d):
    pairs = B.joined(cells(spark, d), cells(spark, d), 0.35, upper=True, linked=True)[0]
    return I.clusters_kept(Q.components(pairs), view(spark, d, "faces"))


@query("a7_face_summary", "i as (select * from media where deleted_at is null), ff as (select f.*, case when f.id % 3 = 0 then null else f.id % 60 end as age, case when f.id % 4 = 0 then null else 'x' end as gender, case when f.id % 5 = 0 then 'main' else 'background' end as role from faces f join i on i.id = f.item_id), t as (select item_id, count(*) as n, count(tag_id) as tagged, count(*) filter (age is not null and gender is not null) as known, count(*) filter (age < 18) as children, count(*) filter (age >= 18) as adults, count(*) filter (role = 'main') as main from ff group by 1), u as (select *, case when main > 0 then main else n end as s from t) select count(*) as images_with_faces, sum(n)::bigint as faces, sum(tagged)::bigint as tagged, sum(n - tagged)::bigint as untagged, sum(known)::bigint as with_age_gender, sum(n - known)::bigint as without_age_gender, sum(children)::bigint as children, sum(adults)::bigint as adults, count(*) filter (n = 1) as one_faces, count(*) filter (n = 2) as two_faces, count(*) filter (n = 3) as three_faces, count(*) filter (n = 4) as four_faces, count(*) filter (n >= 5) as five_plus_faces, count(*) filter (s = 1) as one_main, count(*) filter (s = 2) as two_main, count(*) filter (s = 3) as three_main, count(*) filter (s = 4) as four_main, count(*) filter (s >= 5) as five_plus_main, count(*) filter (n > 1 and main = 1) as one_main_with_background, (select count(*) from i) as images, (select count(*) from i where face_done_at is not null and (face_failed_at is null or face_done_at > face_failed_at)) as analysed, (select count(*) from i where face_failed_at is not null and (face_done_at is null or face_failed_at >= face_done_at)) as failed, (select count(distinct item_id) from hints where item_id in (select id from i)) as with_person_tag, (select count(distinct face_id) from hints h join ff on ff.id = h.face_id and ff.item_id = h.item_id where ff.tag_id is null) as suggested from u", ("media", "faces", "hints"))
def a7(spark, d):
    i = F.col("id")
    f = view(spark, d, "faces").withColumn("age", F.when(i % 3 != 0, i % 60)).withColumn("gender", F.when(i % 4 != 0, "x")).withColumn("role", F.when(i % 5 == 0, "main").otherwise("background"))
    return COV.faces_summary(view(spark, d, "media").where("deleted_at is null"), f, view(spark, d, "hints"), view(spark, d, "hints"))


@query("a5_overview", "select count(*) as items, count(*) filter (star_rating >= 4) as starred, min(taken) as first, max(taken) as last, cast(sum(byte_size) as bigint) as bytes, count(*) filter (processed_at < '2026-02-04') as stale, (select count(*) from faces where tag_id is not null) as tagged_faces, (select count(distinct album_id) from members) as albums from items where deleted_at is null", ("items", "faces", "members"))
def a5(spark, d):
    i = C.active(view(spark, d, "items"), "L")
    one = i.agg(F.count("*").alias("items"), F.count_if(F.col("star_rating") >= 4).alias("starred"), F.min("taken").alias("first"), F.max("taken").alias("last"), F.sum("byte_size").alias("bytes"), F.count_if(F.col("processed_at") < "2026-02-04").alias("stale"))
    tagged = view(spark, d, "faces").where("tag_id is not null").agg(F.count("*").alias("tagged_faces"))
    return one.join(tagged, F.lit(True)).join(view(spark, d, "members").agg(F.countDistinct("album_id").alias("albums")), F.lit(True))  # single rows


@query("z33_found_by_path", "select w.path, coalesce((select min(id) from media m where m.source_path = w.path), (select min(id) from media m where lower(m.source_path) = lower(replace(w.path, '//', '/')))) as id from (select case when id % 3 = 0 then upper(source_path) when id % 3 = 1 then replace(source_path, '/lib', '//lib') else source_path end as path from media) w", ("media",))
def z33(spark, d):
    m = view(spark, d, "media")
    i = F.col("id") % 3
    wanted = m.select(F.when(i == 0, F.upper("source_path")).when(i == 1, F.replace("source_path", F.lit("/lib"), F.lit("//lib"))).otherwise(F.col("source_path")).alias("path"))
    return COV.found_by_path(wanted, m)


@query("p38_fresh_first", "select source_path as path, id % 4 = 0 as failed_before from media", ("media",))
def p38(spark, d):
    m = view(spark, d, "media").select("id", F.col("source_path").alias("path"))
    return COV.fresh_first(m, m.where("id % 4 = 0")).orderBy("failed_before", "id").select("path", "failed_before")


@query("z4_last_scans", "p as (select id, folder, '2026-01-' || lpad(cast(1 + length(url) % 28 as string), 2, '0') as done_at from sites), s as (select lower(rtrim(folder, '/')) as k, max(done_at) as done_at from p where id % 2 = 0 group by 1) select '/' || upper(folder) || '/' as folder, s.done_at from p left join s on s.k = lower(rtrim(p.folder, '/'))", ("sites",))
def z4(spark, d):
    """Folders of pages, asked for in other letters and separators, and the last scan of those that have one."""
    sites = view(spark, d, "sites")
    day = F.concat(F.lit("2026-01-"), F.lpad((1 + F.length("url") % 28).cast("string"), 2, "0"))
    asked = sites.select(F.concat(F.lit("/"), F.upper("folder"), F.lit("/")).alias("folder"))
    return COV.last_scans(asked, sites.where("id % 2 = 0").select("folder", day.alias("done_at")))


@query("a34_bundle_states", "select user_id as bundle_id, case when max(cast(event_type = 'view' as int)) = 1 then 'running' when max(cast(event_type = 'click' as int)) = 1 then case when count(distinct event_type) > 1 then 'running' else 'queued' end when max(cast(event_type = 'purchase' as int)) = 1 then 'failed' else 'done' end as state from events where event_id % 50 = 0 group by 1")
def a34(spark, d):
    e = table(spark, d, "events").where("event_id % 50 = 0")
    t = F.col("event_type")
    state = F.when(t == "view", "running").when(t == "click", "queued").when(t == "purchase", "failed").otherwise("done")
    return COV.bundle_states(e.select(F.col("user_id").alias("bundle_id"), state.alias("state")))


@query("r17_file_urls", "select id, 'file:///lib/' || source || '%20b/' || lang || '/' || cast(n_chars as string) || '%25' || cast(id as string) || '.jpg' as url, source || ' b/' || lang as relative from names", ("names",))
def r17(spark, d):
    path = F.concat(F.lit("/lib/"), "source", F.lit(" b/"), "lang", F.lit("/"), F.col("n_chars").cast("string"), F.lit("%"), F.col("id").cast("string"), F.lit(".jpg"))
    return view(spark, d, "names").select("id", P.file_url(path).alias("url"), P.relative_folder(path, "/lib").alias("relative"))


@query("s4_subfolders", "f as (select distinct regexp_extract(source_path, '^(/lib/[^/]+)/', 1) as folder from media) select folder, true as has_subfolders from f", ("media",))
def s4(spark, d):
    return SRC.folders(view(spark, d, "media").select(F.col("source_path").alias("path")), "/lib")


# ------------------------------------------------------------------ boxes

VIEWS["shapes"] = "select image, id, x1, y1, x2, y2, score, 100.0 as image_width, 80.0 as image_height from boxes"


@query("g9_box_roles", "select image, id, case when s / max(s) over (partition by image) >= 0.8 and (x2 - x1) * (y2 - y1) / 8000 >= 0.03 then 'main' else 'background' end as role, round(s / max(s) over (partition by image), 6) as side_ratio from (select *, least(x2 - x1, y2 - y1) as s from shapes)", ("shapes",))
def g9(spark, d):
    return G.roles(view(spark, d, "shapes"), 0.8, 0.03).select("image", "id", "role", F.round("side_ratio", 6).alias("side_ratio"))


_iou1 = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)))"


@query("g3_suppressed_boxes", f"recursive o as (select *, row_number() over (partition by image order by score desc, id) as k from boxes), c as (select a.image, a.k as k, b.k as over from o a join o b on b.image = a.image and b.k < a.k and {_iou1} > 0.3), r(image, k, kept) as (select image, 0::bigint, []::bigint[] from o group by image union all select r.image, r.k + 1, case when exists (select 1 from c where c.image = r.image and c.k = r.k + 1 and list_contains(r.kept, c.over)) then r.kept else list_append(r.kept, r.k + 1) end from r where exists (select 1 from o where o.image = r.image and o.k = r.k + 1)), last as (select image, arg_max(kept, k) as kept from r group by image) select o.image, o.id, o.score from o join last on last.image = o.image where list_contains(last.kept, o.k)", ("boxes",))
def g3(spark, d):
    return G.suppress(view(spark, d, "boxes"), 0.3).select("image", "id", "score")


_inter = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("g4_greedy_match", f"recursive p as (select a.image, a.id as old_id, b.id as new_id, {_inter} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_inter}) as iou from boxes a join boxes b on a.image = b.image and a.id % 2 = 0 and b.id % 2 = 1), o as (select *, row_number() over (partition by image order by iou desc, old_id, new_id) as k from p where iou >= 0.1), r(image, k, olds, news, took) as (select image, 0::bigint, []::bigint[], []::bigint[], false from o group by image union all select r.image, r.k + 1, case when list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id) then r.olds else list_append(r.olds, o.old_id) end, case when list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id) then r.news else list_append(r.news, o.new_id) end, not (list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id)) from r join o on o.image = r.image and o.k = r.k + 1) select o.image, o.old_id, o.new_id, round(o.iou, 6) as iou from r join o on o.image = r.image and o.k = r.k where r.took", ("boxes",))
def g4(spark, d):
    b = view(spark, d, "boxes")
    return G.greedy_match(b.where("id % 2 = 0"), b.where("id % 2 = 1"), 0.1).select("image", "old_id", "new_id", F.round("iou", 6).alias("iou"))


VIEWS["votes"] = "select image, id, case id % 3 when 0 then 'upright' when 1 then 'rotated_180' else 'rotated_90_cw' end as orientation, (round((score + 1) * 100) / 200) as confidence from boxes"


@query("a33_orientation_votes", "s as (select image, orientation, sum(confidence) as w, count(*) as n, min(id) as seen from votes group by all), b as (select image, arg_min(orientation, (-round(w, 9), seen)) as orientation, sum(n)::bigint as faces from s group by image) select b.image, b.orientation, case b.orientation when 'upright' then 0 when 'rotated_90_cw' then 270 else 180 end as angle, round(least(1.0, s.w / s.n + case when s.n = b.faces and b.faces > 1 then 0.1 else 0 end), 6) as confidence, faces, s.n = faces as unanimous from b join s on s.image = b.image and s.orientation = b.orientation", ("votes",))
def a33(spark, d):
    return G.orientation(view(spark, d, "votes").withColumn("confidence", F.col("confidence").cast("double"))).select("image", "orientation", "angle", F.round("confidence", 6).alias("confidence"), "faces", "unanimous")


_dx, _dy = "(x2 - (x1 + y1) / 2)", "(y1 - x2 * 0.4)"
_votes = f"vv as (select image, id, case when abs({_dy}) >= abs({_dx}) then case when {_dy} > 0 then 'upright' else 'rotated_180' end when {_dx} > 0 then 'rotated_270_cw' else 'rotated_90_cw' end as orientation, least(1.0, greatest(abs({_dx}), abs({_dy})) / greatest(least(abs({_dx}), abs({_dy})), 1e-6) / 5) * least(1.0, score + 0.5) as confidence from boxes where abs({_dx}) + abs({_dy}) > 0.001 and greatest(abs({_dx}), abs({_dy})) / greatest(least(abs({_dx}), abs({_dy})), 1e-6) >= 1.3)"


def _oriented(name: str, where: str) -> str:
    """DuckDB: ``geometry.orientation`` of some of the votes."""
    return f"{name}s as (select image, orientation, sum(confidence) as w, count(*) as n, min(id) as seen from vv where {where} group by all), {name}b as (select image, arg_min(orientation, (-round(w, 9), seen, orientation)) as orientation, sum(n) as faces from {name}s group by image), {name} as (select b.image, b.orientation, least(1.0, s.w / s.n + case when s.n = b.faces and b.faces > 1 then 0.1 else 0 end) as confidence, s.n = faces as unanimous from {name}b b join {name}s s on s.image = b.image and s.orientation = b.orientation)"


def _face_votes(spark, d):
    """Votes of faces whose points follow from their boxes."""
    b = view(spark, d, "boxes")
    points = F.array(F.array("x1", F.lit(0.0)), F.array("y1", F.col("x2") * 0.8), F.array("x2", "y1"), F.array("x1", "y1"), F.array("x1", "y1"))
    v = b.where((F.abs(F.col("x2") - (F.col("x1") + F.col("y1")) / 2) + F.abs(F.col("y1") - F.col("x2") * 0.4)) > 0.001).select("image", "id", G.face_vote(points, F.col("score") + 0.5).alias("v"))
    return v.where("v is not null").select("image", "id", "v.orientation", "v.confidence")


@query("z22_known_rotations", f"{_votes}, {_oriented('o', 'true')} select image, case orientation when 'upright' then 0 when 'rotated_90_cw' then 270 when 'rotated_180' then 180 else 90 end as angle, 'face-existing' as source from o where confidence >= 0.4 and unanimous", ("boxes",))
def z22(spark, d):
    return G.rotation_of_known_faces(G.orientation(_face_votes(spark, d)))


@query("z22_verified_rotations", f"{_votes}, {_oriented('r', 'id % 2 = 0')}, {_oriented('f', 'id % 2 = 1')}, s as (select distinct image, (image % 3 + 1) * 90 as turn from boxes) select s.image, case when r.orientation = 'rotated_180' then (turn + 180) % 360 when r.orientation is not null then turn when f.orientation = 'upright' and turn <> 180 then (turn + 180) % 360 end as angle, case when r.orientation = 'rotated_180' then 'face-flipped-check' when r.orientation is not null then 'face-rotated-check' when f.orientation = 'upright' and turn <> 180 then 'face-flipped-check' else 'vlm-fallback' end as source from s left join r on r.image = s.image left join f on f.image = s.image", ("boxes",))
def z22_verified(spark, d):
    votes, images = _face_votes(spark, d), view(spark, d, "boxes").select("image").distinct()
    suggested = images.select("image", ((F.col("image") % 3 + 1) * 90).alias("angle"))
    return G.verified_rotation(suggested, G.orientation(votes.where("id % 2 = 0")), G.orientation(votes.where("id % 2 = 1")))


@query("z39_turned_faces", "select image, id, case a when 90 then 80 - 1 - y2 when 180 then 100 - 1 - x2 else y1 end as x1, case a when 90 then x1 when 180 then 80 - 1 - y2 else 100 - 1 - x2 end as y1, case a when 90 then 80 - 1 - y1 when 180 then 100 - 1 - x1 else y2 end as x2, case a when 90 then x2 when 180 then 80 - 1 - y1 else 100 - 1 - x1 end as y2, case a when 90 then 80 - 1 - y1 when 180 then 100 - 1 - x2 else y1 end as px, case a when 90 then x2 when 180 then 80 - 1 - y1 else 100 - 1 - x2 end as py from (select *, (id % 3 + 1) * 90 as a from boxes)", ("boxes",))
def z39(spark, d):
    b = view(spark, d, "boxes")
    t = G.turned_face(G._box(), F.array(F.array("x2", "y1")), F.lit(100), F.lit(80), (F.col("id") % 3 + 1) * 90)
    return b.select("image", "id", t.alias("t")).select("image", "id", "t.box.*", F.col("t.points")[0][0].alias("px"), F.col("t.points")[0][1].alias("py"))


@query("k11_recomputed_centroids", "f as (select id, cluster_id % 2 = 0 as changed, case when cluster_id = 2 or (cluster_id % 2 = 0 and id % 7 = 0) then null else tag_id end as now, tag_id, embedding::double[] as v from faces where tag_id is not null), e as (select case when changed then now else tag_id end as tag_id, unnest(v) as x, unnest(range(len(v))) as pos from f), m as (select tag_id, pos, avg(x) as x, count(*) as n from e where tag_id is not null group by all), c as (select tag_id, max(n) as n, list(x order by pos) as v from m group by tag_id) select tag_id, n, round(v[1] / sqrt(list_inner_product(v, v)), 6) as first, round(v[64] / sqrt(list_inner_product(v, v)), 6) as last from c", ("faces",))
def k11(spark, d):
    """Centroids after the faces of one person lost their tag, and those of others a few: even tags are computed anew."""
    f = view(spark, d, "faces")
    now = f.withColumn("tag_id", F.when((F.col("cluster_id") != 2) & ~((F.col("cluster_id") % 2 == 0) & (F.col("id") % 7 == 0)), F.col("tag_id")))
    out = Q.recomputed_centroids(Q.centroids(f), now, f.where("tag_id % 2 = 0").select("tag_id"))
    return out.select("tag_id", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.col("centroid")[63], 6).alias("last"))


@query("g7_face_votes", "select image, id, case when greatest(abs(dx), abs(dy)) / greatest(least(abs(dx), abs(dy)), 1e-6) >= 1.3 then case when abs(dy) >= abs(dx) then case when dy > 0 then 'upright' else 'rotated_180' end when dx > 0 then 'rotated_270_cw' else 'rotated_90_cw' end end as orientation, case when greatest(abs(dx), abs(dy)) / greatest(least(abs(dx), abs(dy)), 1e-6) >= 1.3 then round(least(1.0, greatest(abs(dx), abs(dy)) / greatest(least(abs(dx), abs(dy)), 1e-6) / 5) * least(1.0, score), 9) end as confidence from (select image, id, score + 0.5 as score, x2 - (x1 + y1) / 2 as dx, y1 - x2 * 0.4 as dy from boxes) where abs(dx) + abs(dy) > 0.001", ("boxes",))
def g7(spark, d):
    b = view(spark, d, "boxes")
    points = F.array(F.array("x1", F.lit(0.0)), F.array("y1", F.col("x2") * 0.8), F.array("x2", "y1"), F.array("x1", "y1"), F.array("x1", "y1"))
    v = b.where((F.abs(F.col("x2") - (F.col("x1") + F.col("y1")) / 2) + F.abs(F.col("y1") - F.col("x2") * 0.4)) > 0.001).select("image", "id", G.face_vote(points, F.col("score") + 0.5).alias("v"))
    return v.select("image", "id", "v.orientation", F.round("v.confidence", 9).alias("confidence"))


@query("g2_rescaled_boxes", "select image, id, x1 * 2 as x1, y1 / 2 as y1, (x1 + 10) * 2 as x2, (y1 + 5) / 2 as y2 from boxes", ("boxes",))
def g2(spark, d):
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"))
    return view(spark, d, "boxes").select("image", "id", G.rescaled(box, F.lit(100.0), F.lit(80.0), F.lit(200.0), F.lit(40.0)).alias("b")).select("image", "id", "b.*")


@query("g6_turned_boxes", "select image, id, case id % 4 when 1 then 80 - y - h when 2 then 100 - x - w when 3 then y else x end as x, case id % 4 when 1 then x when 2 then 80 - y - h when 3 then 100 - x - w else y end as y, case when id % 2 = 1 then h else w end as width, case when id % 2 = 1 then w else h end as height, case when id % 2 = 1 then 80.0 else 100.0 end as image_width from (select image, id, least(x1, 100) as x, least(y1, 80) as y, least(x2, 100) - least(x1, 100) as w, least(y2, 80) - least(y1, 80) as h from boxes)", ("boxes",))
def g6(spark, d):
    b = view(spark, d, "boxes")
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    angle = ((F.col("id") % 4) * 90).cast("int")
    turned = F.when(angle == 0, box).otherwise(G.turned(box, F.lit(100.0), F.lit(80.0), angle))
    size = F.when(angle == 0, F.lit(100.0)).otherwise(G.turned_size(F.lit(100.0), F.lit(80.0), angle)["width"])
    return b.select("image", "id", turned.alias("t"), size.alias("image_width")).select("image", "id", "t.*", "image_width")


@query("g5_canonical_boxes", "select image, id, greatest(0.0, least(1000.0, floor(x1 / 50 * 1000 + 0.5))) as x_min, greatest(0.0, least(1000.0, floor(x2 / 50 * 1000 + 0.5))) as x_max, 'pixel' as format from boxes", ("boxes",))
def g5(spark, d):
    none = lambda c: F.lit(None).cast("double").alias(c)
    box = F.struct(
        *[none(c) for c in ("x_min", "y_min", "x_max", "y_max", "width", "height")], F.col("x1").alias("mp_x"), F.col("y1").alias("mp_y"), (F.col("x2") - F.col("x1")).alias("mp_width"), (F.col("y2") - F.col("y1")).alias("mp_height"), F.lit(50.0).alias("image_width"), F.lit(50.0).alias("image_height")
    )
    return view(spark, d, "boxes").withColumn("box", box).select("image", "id", G.canonical_box(F.col("box")).alias("c"), G.box_format(F.col("box")).alias("format")).select("image", "id", "c.x_min", "c.x_max", "format")


@query("g13_passing_faces", "select image, id from boxes where score >= 0.03 and least(x2 - x1, y2 - y1) / 80 >= 0.14", ("boxes",))
def g13(spark, d):
    return view(spark, d, "boxes").where(G.passing_face(G._box(), F.col("score"), F.lit(100.0), F.lit(80.0), 0.03, 0.14)).select("image", "id")


@query("g12_similarity_transforms", "s as (select image, avg(x1) as mx, avg(y1) as my, avg(x2) as mu, avg(y2) as mv, avg(x1 * x2) as xu, avg(y1 * y2) as yv, avg(x1 * y2) as xv, avg(y1 * x2) as yu, avg(x1 * x1) as xx, avg(y1 * y1) as yy from boxes group by image), t as (select image, mx, my, mu, mv, (xx - mx * mx) + (yy - my * my) as ss, (xu - mx * mu) + (yv - my * mv) as p, (xv - mx * mv) - (yu - my * mu) as q from s) select image, round(case when abs(ss) < 1e-12 then 1 else p / ss end, 6) + 0.0 as a, round(case when abs(ss) < 1e-12 then 0 else q / ss end, 6) + 0.0 as b from t where abs(ss) < 1e-13 or abs(ss) > 1e-6", ("boxes",))
def g12(spark, d):
    p = view(spark, d, "boxes").select("image", F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("u"), F.col("y2").alias("v"))
    return G.similarity_transform(p, "image").select("image", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("g10_priors", "g as (select s.*, i, j from (values (0, 8, 6, 8, [16.0, 32.0]), (1, 16, 3, 4, [64.0])) s(k, step, rows, cols, sizes), range(6) r(i), range(8) c(j) where i < rows and j < cols), e as (select *, unnest(sizes) as size, unnest(range(len(sizes))) as z from g) select case when k = 0 then (i * 8 + j) * 2 + z else 96 + i * 4 + j end as n, round((j + 0.5) * step / 64, 6) as cx, round((i + 0.5) * step / 48, 6) as cy, round(size / 64, 6) as w, round(size / 48, 6) as h from e")
def g10(spark, d):
    p = G.priors(spark, 64, 48, [[16, 32], [64]], [8, 16])
    return p.select(F.col("n").cast("long").alias("n"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("g15_points_of_boxes", "select image, id, round(x1 + 0.35 * (x2 - x1), 6) as left_eye_x, round(y1 + 0.72 * (y2 - y1), 6) as mouth_y, row_number() over (partition by image order by (x2 - x1) * (y2 - y1) desc, id) as place from boxes", ("boxes",))
def g15(spark, d):
    b = G.display_order(view(spark, d, "boxes"))
    points = G.points_of_box(G._box())
    return b.select("image", "id", F.round(points[0][0], 6).alias("left_eye_x"), F.round(points[4][1], 6).alias("mouth_y"), "place")


@query("g8_turns", "select image, id, case when y1 % 3 = 0 then (turn + 180) % 360 else turn end as valid, case when y1 % 3 = 0 then 'face-corrected' else 'vlm' end as source, cast((cast(x2 as int) % 4) * 90 + 270 as int) % 360 as composed, case when x1 % 2 = 1 and score >= 0.04 then 90 else 180 end as first, greatest(1, cast(floor(x2 * 20 * least(1.0, 512.0 / greatest(x2 * 20, y2 * 10)) + 0.5) as int)) as width, case when score * 10 >= 0.5 then 'female' else 'male' end as gender from (select *, (cast(x1 as int) % 3 + 1) * 90 as turn from boxes)", ("boxes",))
def g8(spark, d):
    """Turns, sizes and readings of models, from the places and scores of boxes."""
    x1, x2, y1, y2, score = (F.col(c) for c in ("x1", "x2", "y1", "y2", "score"))
    v = G.validated_turn((x1.cast("int") % 3 + 1) * 90, F.when(y1 % 3 == 0, "rotated_180").otherwise("upright"))
    s = lambda a, c: F.struct(F.lit(a).alias("angle"), c.cast("double").alias("confidence"))
    first = G.primary_turn(F.array(s(90, F.when(x1 % 2 == 1, score)), s(180, F.lit(0.04)), s(45, F.lit(0.9))))
    small = G.downscaled(x2 * 20, y2 * 10, 512)
    return view(spark, d, "boxes").select("image", "id", v["angle"].alias("valid"), v["source"].alias("source"), G.composed_turn((x2.cast("int") % 4) * 90, F.lit(270)).alias("composed"), first.alias("first"), small["width"].alias("width"), G.age_gender(y2, score * 10)["gender"].alias("gender"))


@query("k5_redetected_faces", "select image, count(*) filter (state = 'updated') as updated, count(*) filter (state = 'new') as \"new\", count(*) filter (state = 'kept') as kept, count(*) filter (state = 'deleted') as deleted from (select b.image, case when b.id % 2 = 0 then case when m.image is not null then 'updated' when b.id % 4 = 0 then 'kept' else 'deleted' end else 'new' end as state from boxes b left join (select image, old_id as id from g4m) m on m.image = b.image and m.id = b.id where b.id % 2 = 0 or not exists (select 1 from g4m g where g.image = b.image and g.new_id = b.id)) group by image".replace("select image, count", f"recursive p as (select a.image, a.id as old_id, b.id as new_id, {_inter} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_inter}) as iou from boxes a join boxes b on a.image = b.image and a.id % 2 = 0 and b.id % 2 = 1), o as (select *, row_number() over (partition by image order by iou desc, old_id, new_id) as k from p where iou >= 0.1), r(image, k, olds, news, took) as (select image, 0::bigint, []::bigint[], []::bigint[], false from o group by image union all select r.image, r.k + 1, case when list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id) then r.olds else list_append(r.olds, o.old_id) end, case when list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id) then r.news else list_append(r.news, o.new_id) end, not (list_contains(r.olds, o.old_id) or list_contains(r.news, o.new_id)) from r join o on o.image = r.image and o.k = r.k + 1), g4m as (select o.image, o.old_id, o.new_id from r join o on o.image = r.image and o.k = r.k where r.took) select image, count", 1), ("boxes",))
def k5(spark, d):
    b = view(spark, d, "boxes")
    old = b.where("id % 2 = 0").withColumn("tag_id", F.when(F.col("id") % 4 == 0, F.lit(1)))
    out = I.redetected_faces(old, b.where("id % 2 = 1"), 0.1)
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return out.groupBy("image").agg(count("updated"), count("new"), count("kept"), count("deleted"))


@query("z42_written_vectors", "select id, case when id % 3 = 0 then 'ready' when id % 3 = 1 then 'failed' else 'old' end as status, case when id % 3 = 0 then round(sqrt(list_inner_product(v, v)), 4) end as length from (select vec_id as id, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as v from embeddings)")
def z42(spark, d):
    e = _images(spark, d)
    faces = e.select("id", F.lit(None).cast("array<double>").alias("embedding"), F.lit("old").alias("embedding_status"))
    new = e.where("id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, F.transform("embedding", lambda x: x.cast("double") * 2)).alias("embedding"))
    out = I.written_vectors(faces, new)
    return out.select("id", F.col("embedding_status").alias("status"), F.round(V.norm(F.col("embedding")), 4).alias("length"))


@query("x10_distances", "select vec_id as id, greatest(-1.0, least(1.0, 1 - (1 - round(embedding[1]::double, 6)))) as similarity from embeddings")
def x10(spark, d):
    e = _images(spark, d)
    return e.select("id", S.similarity_of_distance(1 - F.round(F.col("embedding")[0].cast("double"), 6)).alias("similarity"))
