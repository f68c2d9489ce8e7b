"""Lookups, pages, reports and composed writes: registered queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import predicates as C
from ..operators import balls as B
from ..operators import coverage as COV
from ..operators import ingest as I
from ..operators import listings as L
from ..operators import people as PPL
from ..operators import search as Q
from .media import _cat, _raw_q, _title
from .queries import cells
from .registry import VIEWS, query, table, view

_excluded = f"(lower(coalesce({_cat}, '')) like 'document%' or lower(coalesce({_cat}, '')) like '%screenshot%' or lower(coalesce({_cat}, '')) in ('invoice_or_receipt', 'presentation_slide', 'diagram'))"


def _places_sql(gps: str, label: str, group: str, parent: str, ok: str) -> str:
    return f"select trim(country) as country, {label} as place, {group} as \"group\", {parent} as parent, count(*) as items from media where deleted_at is null and {gps} and trim(country) <> '' and {ok} and (nullif(trim(city), '') is null or trim(country) <> trim(city)) and not {_excluded} group by all"


_at = "coalesce(photo_taken_at, file_created_at)"
YEARLY = _places_sql("location_source = 'gps'", "trim(area)", f"substr({_at}, 1, 4)", "null::varchar", f"trim(area) <> '' and regexp_matches(substr({_at}, 1, 4), '^[0-9]{{4}}$')")


@query("a10_places_by_year", YEARLY, ("media",))
def a10(spark, d):
    return L.places(view(spark, d, "media"))


@query("a10_places_by_month", _places_sql("location_source is distinct from 'gps'", "trim(area)", f"substr({_at}, 1, 7)", "null::varchar", f"trim(area) <> '' and regexp_matches(substr({_at}, 1, 7), '^[0-9]{{4}}-[01][0-9]$')"), ("media",))
def a10_month(spark, d):
    return L.places(view(spark, d, "media"), "month-area", gps=False)


@query("a10_places_by_area", _places_sql("location_source = 'gps'", "trim(city)", "coalesce(nullif(trim(area2), ''), nullif(trim(area), ''), 'Unknown area')", "case when nullif(trim(area2), '') is not null then nullif(trim(area), '') end", "trim(city) <> ''"), ("media",))
def a10_area(spark, d):
    return L.places(view(spark, d, "media"), "area-city")


@query("r6_nested_places", f"p as ({YEARLY}), g as (select country, \"group\", sum(items) as items, string_agg('place:gps:year-city:' || country || ':' || \"group\" || '::' || place || '=' || items, ',' order by lower(place), place) as entries from p group by 1, 2) select country, sum(items)::bigint as items, string_agg(\"group\" || '(' || items || ')' || entries, ';' order by \"group\" desc) as groups from g group by country", ("media",))
def r6(spark, d):
    n = L.nested_places(L.places(view(spark, d, "media")), "year-city", "gps")
    entry = lambda e: F.concat(e["id"], F.lit("="), e["items"].cast("string"))
    group = lambda g: F.concat(g["group"], F.lit("("), g["items"].cast("string"), F.lit(")"), F.array_join(F.transform(g["entries"], entry), ","))
    return n.select("country", "items", F.array_join(F.transform("groups", group), ";").alias("groups"))


@query("a11_years", f"select substr({_at}, 1, 4) as year, count(*) as items, count(*) filter (star_rating > 0) as rated, count(*) filter ({_raw_q} > 0) as ai_rated from media where deleted_at is null group by 1", ("media",))
def a11(spark, d):
    return L.years(view(spark, d, "media"))


_quality = f"coalesce(star_rating, -1) desc, coalesce({_raw_q}, -1) desc, {_at} desc, lower(source_path), id"


@query("l3_best_of", f"select id from (select * from media order by {_quality} limit 100) order by {_quality} limit 20 offset 10", ("media",))
def l3(spark, d):
    return L.best_of(view(spark, d, "media"), 100, 20, 10).select("id")


@query("l4_best_shuffled", f"select id from (select * from media order by {_quality} limit 100) order by sha256('7' || chr(0) || cast(id as string)) limit 20", ("media",))
def l4(spark, d):
    return L.best_of(view(spark, d, "media"), 100, 20, seed=7).select("id")


@query("r8_shown_items", "select id, coalesce(nullif(trim(display_title), ''), filename) as title, case when mime_type ilike 'video/%' then 'video' else 'image' end as kind from media", ("media",))
def r8(spark, d):
    return L.shown(view(spark, d, "media"))


@query("p12_titled_albums", "select tag_id from persons where name ilike '%person_b%' or name ilike '%C%'", ("persons",))
def p12(spark, d):
    p = view(spark, d, "persons")
    return L.titled(p, "person_b").unionByName(L.titled(p, " c ")).select("tag_id").distinct()


@query("l11_failures", "select id, source_path, face_failed_at as failed_at from media where face_failed_at is not null and (face_done_at is null or face_failed_at >= face_done_at)", ("media",))
def l11(spark, d):
    return L.failures(view(spark, d, "media"), "face_done_at", "face_failed_at")


@query("s15_id_or_path", "select 'id' as found_by, id from media where deleted_at is null and library_id = 'L' and id = 14 union all select 'path', min(id) from media where library_id = 'L' and source_path = (select source_path from media where id = 16) union all select 'both', min(id) from media where deleted_at is null and library_id = 'L' and source_path = (select source_path from media where id = 18)", ("media",))
def s15(spark, d):
    m = view(spark, d, "media")
    path = {r["id"]: r["source_path"] for r in m.where("id in (16, 18)").select("id", "source_path").collect()}
    found = lambda df, by: df.select(F.lit(by).alias("found_by"), "id")
    return found(L.by_id_or_path(m, "L", " 14 "), "id").unionByName(found(L.by_path(m, "L", path[16]), "path")).unionByName(found(L.by_id_or_path(m, "L", path[18]), "both"))


@query("s18_metadata_of_paths", "select m.id, (select count(*) from sources s where s.item_id = m.id and s.status = 'active') as sources, (select string_agg(cast(cast(round(f.confidence * 100) as int) as string), ',' order by f.id) from faces f where f.item_id = m.id) as confidences from media m where m.deleted_at is null and m.id % 3 = 0", ("media", "sources", "faces"))
def s18(spark, d):
    m = view(spark, d, "media")
    out = L.metadata_of_paths(m, m.where("id % 3 = 0").select(F.col("source_path").alias("path")), view(spark, d, "sources"), view(spark, d, "faces"))
    return out.select("id", "sources", F.array_join(F.transform("confidences", lambda c: F.round(c.cast("double") * 100).cast("int").cast("string")), ",").alias("confidences"))


@query("s16_by_keys", "select id from media where id in (select item_id from faces where tag_id = 2) union all select -1 - id from media where id not in (select item_id from faces)", ("media", "faces"))
def s16(spark, d):
    m, f = view(spark, d, "media"), view(spark, d, "faces").select(F.col("item_id").alias("id"), "tag_id")
    return L.by_keys(m, f.where("tag_id = 2"), "id").select("id").unionByName(L.without_keys(m, f, "id").select((-1 - F.col("id")).alias("id")))


@query("u4_all_keys", "select item_id as id from faces union select item_id from hints union select id from media where id < 5", ("faces", "hints", "media"))
def u4(spark, d):
    as_id = lambda n: view(spark, d, n).select(F.col("item_id").alias("id"))
    return L.all_keys(L.all_keys(as_id("faces"), as_id("hints")), view(spark, d, "media").where("id < 5").select("id"))


@query("z7_face_scopes", "i as (select m.id, nullif(regexp_extract(substr(source_path, 6), '^([^/]+)/', 1), '') as sub, n, t from media m left join (select item_id, count(*) as n, count(tag_id) as t from faces group by 1) f on f.item_id = m.id), s as (select 'recursive' as scope, * from i union all select coalesce(sub, 'direct'), * from i) select scope, count(*) as images, count(n) as with_faces, coalesce(sum(n), 0)::bigint as faces, coalesce(sum(t), 0)::bigint as tagged from s group by 1", ("media", "faces"))
def z7(spark, d):
    return L.face_scopes(view(spark, d, "media"), view(spark, d, "faces"), "/lib")


VIEWS["jobs"] = "select event_id as seq, event_type, case event_type when 'view' then 'success' when 'click' then 'failed' when 'purchase' then 'cancelled' else 'running' end as status, case when event_id % 4 = 0 then null else 'x' end as result, case when event_id % 5 = 0 then 0.0 else cast(value as double) end as seconds from events"


@query("z31_job_counts", "e as (select * from jobs where status in ('success', 'failed', 'cancelled') and not (status = 'success' and result is null) and seconds > 0 order by seq desc limit 15) select count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'cancelled') as cancelled, count(*) filter (status = 'running') as running, count(*) filter (status = 'success' and result is null) as skipped, round((select avg(seconds) from e), 6) as mean_seconds from jobs", ("jobs",))
def z31(spark, d):
    out = L.job_counts(view(spark, d, "jobs"), skip_no_result=True)
    return out.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("z32_results", "select m.id, coalesce(nullif(trim(display_title), ''), filename) as title from media m join embeddings a on a.vec_id = m.id join embeddings b on b.vec_id = m.id where (a.embedding[1] >= 0.05 or b.embedding[2] >= 0.1) and star_rating between 2 and 5", ("media",))
def z32(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("image_similarity"), F.col("embedding")[1].cast("double").alias("text_similarity"))
    return L.results(e, view(spark, d, "media"), C.QuickFilter(stars="gte_2"), 0.05, 0.1).select("id", "title")


@query("x37_labels", "select event_id as id, case event_type when 'click' then 'White Balance Click' else 'White Balance ' || upper(substr(event_type, 1, 1)) || replace(substr(event_type, 2), '_', ' ') end as headline, case event_id % 3 when 0 then 'Adult' when 1 then 'teen' end as label from events where not contains(event_type, '_')")
def x37(spark, d):
    e = table(spark, d, "events").where(~F.col("event_type").contains("_"))
    word = F.when(F.col("event_id") % 3 == 0, "ADULT").when(F.col("event_id") % 3 == 1, "teen").otherwise("")
    return e.select(F.col("event_id").alias("id"), L.headline(F.concat(F.lit("white__balance_"), "event_type")).alias("headline"), L.label(word).alias("label"))


# ------------------------------------------------------------------ composed writes


@query("k18_reconciled", "i as (select * from media where regexp_extract(source_path, '^(.*)/[^/]*$', 1) = '/lib/src1/en') select id, source_path, case when id % 3 = 0 and deleted_at is null then 'deleted' when id % 3 <> 0 and deleted_at is not null then 'restored' else 'kept' end as action, id % 3 = 0 and deleted_at is null and not exists (select 1 from sources s where s.item_id = i.id and s.status = 'active' and s.source_path <> i.source_path) as logged from i", ("media", "sources"))
def k18(spark, d):
    m = view(spark, d, "media")
    disk = m.where("id % 3 <> 0").select(F.col("source_path").alias("path"))
    return L.reconciled(m, disk, view(spark, d, "sources"), "/lib/src1/en", "2026-03-01")


@query("k19_purged_counts", "g as (select id from media where deleted_at < '2026-02-01') select 'items' as \"table\", count(*) as rows from g union all select 'faces', count(*) from faces where item_id in (select id from g) union all select 'vectors', count(*) from vectors where item_id in (select id from g) union all select 'members', count(*) from members where item_id in (select id from g) union all select 'hints', count(*) from hints where item_id in (select id from g) union all select 'sources', count(*) from sources where item_id in (select id from g)", ("media", "faces", "vectors", "members", "hints", "sources"))
def k19(spark, d):
    return L.purged(view(spark, d, "media"), "2026-02-01", {n: (view(spark, d, n), "item_id") for n in ("faces", "vectors", "members", "hints", "sources")})


@query("k12_refreshed_suggestions", "select item_id, tag_id, face_id from hints where tag_id not in (1, 2) union all select item_id, tag_id, min(face_id) from (select item_id, label as tag_id, vec_id as face_id from (select vec_id, vec_id % 200 as item_id, label from embeddings) where label in (1, 2)) group by 1, 2", ("hints",))
def k12(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("item_id"), F.col("label").alias("tag_id"), F.col("vec_id").alias("face_id"))
    best = e.groupBy("item_id", "tag_id").agg(F.min("face_id").alias("face_id")).withColumn("similarity", F.lit(0.5))
    return L.refreshed_suggestions(view(spark, d, "hints"), best, [1, 2]).select("item_id", "tag_id", "face_id")


@query("k13_reclustered", "recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35), r(id, c) as (select distinct a, a from e union select e.b, r.c from r join e on e.a = r.id), k as (select id, min(c) as c from r group by id), big as (select c from k group by c having count(*) >= 4) select vec_id as id, k.c as cluster_id from embeddings left join (select * from k where c in (select c from big)) k on k.id = vec_id")
def k13(spark, d):
    members = Q.components(B.joined(cells(spark, d), cells(spark, d), 0.35, upper=True, linked=True)[0])
    faces = view(spark, d, "faces")
    return L.reclustered(faces, members, I.clusters_kept(members, faces)).select("id", "cluster_id")


@query("z12_extracted_paths", "select id, case when photo_taken_at is not null then photo_taken_at else file_created_at end as start, null::varchar as \"end\", case when photo_taken_at is null then 'file_mtime' when length(photo_taken_at) = 4 then 'xmp' else 'exif' end as source, null::varchar as title from media", ("media",))
def z12(spark, d):
    return L.extracted_paths(view(spark, d, "media"))


VIEWS["readings"] = "select id, '/lib/' || source || '/' || case when id % 4 = 0 then 'IMG_1.jpg' else cast(id as string) || ' trip.jpg' end as path, case when id % 3 = 0 then '2001' end as start, case when id % 5 = 0 then 'Italy' end as country, case when id % 2 = 0 then 'Rome' end as city from names"


@query("z14_folder_context", "select path, coalesce(start, '1999') as start, case when coalesce(country, city) is not null then country else 'Peru' end as country, case when coalesce(country, city) is not null then city end as city, id % 4 <> 0 as asked from readings", ("readings",))
def z14(spark, d):
    r = view(spark, d, "readings")
    folders = r.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct().select("folder", F.lit("1999").alias("start"), F.lit("Peru").alias("country"), F.lit(None).cast("string").alias("city"))
    return L.with_folder_context(r.drop("id"), folders)


@query("z13_path_results", "select id, case when id % 2 = 0 then '2001-05' else event_start end as event_start, case when id % 3 = 0 then 'Chile' else country end as country, case when id % 2 = 0 then case when id % 4 = 0 then 'A title' else display_title end else display_title end as display_title from media", ("media",))
def z13(spark, d):
    m = view(spark, d, "media")
    i = F.col("id")
    title = F.when(i % 4 == 0, " A title ").otherwise(F.concat(F.lit("IMG_"), i.cast("string")))
    r = m.where("id % 2 = 0 or id % 3 = 0").select("id", F.when(i % 2 == 0, "2001-05").alias("event_start"), F.lit(None).cast("string").alias("event_end"), F.when(i % 3 == 0, "Chile").alias("country"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("area"), F.when(i % 2 == 0, title).alias("display_title"))
    return I.path_results(m, r).select("id", "event_start", "country", "display_title")


@query("z43_open_vectors", "select id, case when id % 7 = 0 then 0.0 else round(confidence, 6) end::double as confidence from faces where tag_id is null and id % 3 = 1", ("faces",))
def z43(spark, d):
    i = F.col("id")
    f = view(spark, d, "faces").withColumn("embedding_status", F.when(i % 3 == 1, "ready").when(i % 3 == 2, "failed")).withColumn("confidence", F.when(i % 7 != 0, F.col("confidence").cast("double")))
    return L.open_vectors(f).select("id", F.round("confidence", 6).alias("confidence"))


@query("p28_faces_needing_vectors", "select id, id % 4 <> 0 and id % 5 <> 0 and id % 3 <> 0 as needs, id % 4 <> 0 and id % 5 <> 0 as refreshed from faces", ("faces",))
def p28(spark, d):
    i = F.col("id")
    f = view(spark, d, "faces").withColumn("bbox_x", F.when(i % 4 != 0, F.lit(1.0))).withColumn("landmarks", F.when(i % 5 != 0, "[]")).withColumn("embedding_status", F.when(i % 3 == 0, "ready").when(i % 3 == 1, "failed"))
    return f.select("id", C.needs_vector().alias("needs"), C.needs_vector(refresh=True).alias("refreshed"))


@query("z23_vector_targets", "select image, count(*) as faces from boxes where id % 2 = 0 and id % 3 <> 0 group by 1", ("boxes",))
def z23(spark, d):
    b = view(spark, d, "boxes").withColumn("embedding_status", F.when(F.col("id") % 3 == 0, "ready"))
    t = L.vector_targets(b.where("id % 2 = 0"), b.where("id % 2 = 1"))
    return t.groupBy("image").agg(F.count("*").alias("faces"))


@query("j17_added_sources", "select id as item_id, source_path from media where deleted_at is null and id % 2 = 0", ("media",))
def j17(spark, d):
    m = view(spark, d, "media")
    return L.added_sources(m, m.where("id % 2 = 1"), "local", "2026").select("item_id", "source_path")


@query("k24_without_results", "select id, case when id % 5 = 0 then null else photo_done_at end as photo_done_at, case when id % 5 = 0 then null else ai_metadata end as ai_metadata, star_rating from media", ("media",))
def k24(spark, d):
    m = view(spark, d, "media")
    return I.without_results(m, m.where("id % 5 = 0"), ("photo_done_at", "photo_failed_at", "ai_metadata")).select("id", "photo_done_at", "ai_metadata", "star_rating")


@query("k8_failures_written", "select id, case when id % 6 = 1 then '2026-03-01' else photo_failed_at end as photo_failed_at, case when id % 6 = 1 then left(repeat('x', 600), 500) end as error from media", ("media",))
def k8(spark, d):
    m = view(spark, d, "media").withColumn("error", F.lit(None).cast("string"))
    f = m.where("id % 6 = 1").select("library_id", "source_path", F.repeat(F.lit("x"), F.lit(600)).alias("error"))
    return I.failed(m, f, "photo_failed_at", "2026-03-01").select("id", "photo_failed_at", "error")


@query("k25_turned_items", "select image, id, case when image % 3 = 0 then 100.0 - least(y1, 100) - (least(y2, 100) - least(y1, 100)) else x1 end as x, case when image % 3 = 0 then 100.0 else 120.0 end as width from boxes", ("boxes",))
def k25(spark, d):
    b = view(spark, d, "boxes")
    box = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    items = b.select("image", "id", box.alias("box"), F.lit(120.0).alias("width"), F.lit(100.0).alias("height"))
    turns = b.where("image % 3 = 0").select("image", F.lit(90).alias("angle")).distinct()
    return I.turned_items(items, turns).select("image", "id", F.col("box.x").alias("x"), "width")


@query("k22_snapshot_times", "select folder, max(mtime) as mtime from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, mtime from files) where folder like '/lib/src1/%' group by 1", ("files",))
def k22(spark, d):
    f = view(spark, d, "files").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "mtime")
    snapshot = f.groupBy("folder").agg(F.max("mtime").alias("mtime"))
    return L.snapshot_times(snapshot, f.where(F.col("folder").startswith("/lib/src1/")))


@query("z3_faces_of_person", "select id, item_id from faces where tag_id = 2", ("faces",))
def z3(spark, d):
    return PPL.faces_of_person(view(spark, d, "faces"), 2).select("id", "item_id")


@query("z5_albums_of_item", "select distinct album_id, name from members join (select o_orderkey as k, 'Album ' || cast(o_orderkey % 7 as string) as name from orders) a on a.k = album_id where item_id = 7", ("members",))
def z5(spark, d):
    albums = table(spark, d, "orders").select(F.col("o_orderkey").alias("album_id"), F.concat(F.lit("Album "), (F.col("o_orderkey") % 7).cast("string")).alias("name"))
    return PPL.albums_of_item(view(spark, d, "members"), albums, 7)


@query("z40_face_similarities", "select id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)), 6) as similarity from faces where id in (1, 5, 9, 400)", ("faces",))
def z40(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return PPL.face_similarity(view(spark, d, "faces"), [1, 5, 9, 400], Q.vector_of(e, 3)).select("id", F.round("similarity", 6).alias("similarity"))


@query("z41_stored_centroids", "select tag_id, tag_id % 2 = 0 as is_stored from (select distinct label as tag_id from embeddings where vec_id % 2 = 0)")
def z41(spark, d):
    c = Q.centroids(view(spark, d, "faces")).select("tag_id", "centroid")
    return I.stored_or_computed(c.where("tag_id % 2 = 0"), c).select("tag_id", "is_stored")


@query("a36_representatives_by_tag", "c as (select cluster_id, arg_max(id, (confidence, -id)) as face_id from faces group by 1) select cluster_id % 3 as tag_id, string_agg(cluster_id || ':' || face_id, ',' order by cluster_id) as representatives from c group by 1", ("faces",))
def a36(spark, d):
    c = PPL.cluster_pages(view(spark, d, "faces"), 1000).withColumn("tag_id", F.col("cluster_id") % 3)
    r = PPL.representatives_by_tag(c)
    return r.select("tag_id", F.array_join(F.transform("representatives", lambda x: F.concat_ws(":", x["cluster_id"].cast("string"), x["face_id"].cast("string"))), ",").alias("representatives"))


@query("a19_items_in_scope", "select (select count(*) from media where starts_with(lower(source_path), '/lib/src1/')) as items, (select count(*) from media where starts_with(lower(source_path), '/lib/src1/en/') and instr(substr(source_path, 14), '/') = 0) as direct", ("media",))
def a19(spark, d):
    m = view(spark, d, "media")
    return COV.in_scope(m, "/lib/src1", True).join(COV.in_scope(m, "/lib/src1/en", False).withColumnRenamed("items", "direct"), F.lit(True))  # single rows


@query("a28_main_buckets", "t as (select item_id, count(*) as n, count(*) filter (id % 5 = 0) as m from faces join media on media.id = item_id group by 1) select count(*) filter (s = 1) as one, count(*) filter (s = 2) as two, count(*) filter (s = 3) as three, count(*) filter (s >= 4) as four_plus from (select case when m > 0 then m else n end as s from t)".replace("count(*) filter (id % 5 = 0)", "count(*) filter (faces.id % 5 = 0)"), ("faces", "media"))
def a28(spark, d):
    f = view(spark, d, "faces").withColumn("age", F.lit(None).cast("int")).withColumn("gender", F.lit(None).cast("string")).withColumn("role", F.when(F.col("id") % 5 == 0, "main"))
    hints = view(spark, d, "hints")
    return COV.main_buckets(COV.faces_summary(view(spark, d, "media"), f, hints, hints))


@query("k16_face_deleted", "select id, case when id % 2 = 0 then 'a,c' else 'a,b,c' end as boxes from names", ("names",))
def k16_deleted(spark, d):
    n = view(spark, d, "names")
    docs = n.select("id", F.array(*[F.lit(x) for x in "abc"]).alias("boxes"))
    return I.face_deleted(docs, n.where("id % 2 = 0").select("id", F.lit(1).alias("nth"))).select("id", F.array_join("boxes", ",").alias("boxes"))


# ------------------------------------------------------------------ patches


@query("z45_analysis_patches", "select a.id, case a.id % 6 when 0 then 'T' || cast(a.id % 9 as string) when 1 then 'U' when 5 then 'V' else t end as title, case a.id % 6 when 0 then 'mx' when 1 then 'mx' when 5 then 'mx' end as method, case when a.id % 6 = 0 then cast(a.id % 4 as string) when a.id % 6 in (1, 5) then null else n end as people, case when a.id % 3 > 0 then cast(a.id % 3 as string) end as faces from answers a join (select id, " + _title + " as t, case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.people.vlm_analysis.number_of_people') else json_extract_string(ai_metadata, '$.number_of_people') end as n from media) m on m.id = a.id", ("answers", "media"))
def z45(spark, d):
    a = view(spark, d, "answers").withColumn("a", M.photo_analysis(F.col("answer")))
    m = view(spark, d, "media").select("id", "ai_metadata").join(a.select("id", "a"), "id")
    once = m.select("id", M.merged("ai_metadata", M.analysis_patch(F.col("a"), "mx")).alias("n"))
    twice = once.select("id", M.merged("n", M.faces_patch(F.col("id") % 3, F.lit("r"), F.lit(4), F.lit(3))).alias("n"))
    at = lambda p: F.get_json_object("n", f"$.{p}")
    method = F.when(F.col("id") % 6 < 2, at("image_analysis.photo_analysis_method")).when(F.col("id") % 6 == 5, at("image_analysis.photo_analysis_method"))
    return twice.select("id", at("image_analysis.title").alias("title"), method.alias("method"), at("people.vlm_analysis.number_of_people").alias("people"), at("people.face_count").alias("faces"))


@query("z15_path_patches", "select id, start, case when start is not null then 'year' end as precision, case when coalesce(country, city) is not null then 'llm_path' end as place, case when id % 2 = 0 then 'Trip' end as title from readings", ("readings",))
def z15(spark, d):
    r = view(spark, d, "readings")
    title = F.when(F.col("id") % 2 == 0, " Trip ").otherwise("stem")
    p = r.select("id", M.path_patch(F.col("start"), F.lit(None).cast("string"), F.col("country"), F.col("city"), title, F.lit("stem"), "m", "2026").alias("p"))
    at = lambda x: F.get_json_object("p", f"$.path_extraction.{x}")
    return p.select("id", at("date.start").alias("start"), at("date.precision").alias("precision"), at("location.source").alias("place"), at("display_title").alias("title"))


@query("z47_geocoding_count", "select count(*) as items from media where latitude is not null and longitude is not null and (location_source is distinct from 'gps' or country is null or area is null or city is null)", ("media",))
def z47(spark, d):
    return view(spark, d, "media").where(C.needs_geocoding()).agg(F.count("*").alias("items"))
