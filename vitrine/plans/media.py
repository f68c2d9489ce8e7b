"""Items with metadata: filters, quick filters, dates, places, readings of models. Registered queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import metadata as M
from ..functions import paths as P
from ..functions import predicates as C
from ..functions import scalars as S
from ..functions import stems as ST
from ..operators import catalogue as CAT
from ..operators import coverage as COV
from ..operators import ingest as I
from ..operators import places as PLC
from ..operators.store import fresh_path, once
from ..sources import files as SRC
from .registry import VIEWS, query, table, view

#: Names with the shapes of dates that are told apart.
NAMES = (
    "2009-02-07 - 2009-03-01 trip", "2009-02-07 -- 2009-13-01", "2009-02-07 -- 03-14 coast", "1997-01-15 -- 18", "2009-02-07 -- 9", "2009-02-07-123", "1992-1998 school", "1998-1992",
    "1992 - 1998", "1982--91 class", "1998--03", "1999 -- 99", "2001-02-03_x", "2001-02-33", "IMG_20200306_185130", "x20200306", "20201341", "1994-09 lake", "1994-09-1", "summer 1999 best",
    "(1987)", "17990101", "no date", "3 cats", "garden 1", "scan 12", "scan0002", "IMG_1234", "P1020304 harbour", "image 5 of us", "DSCN0001-2", "sea_side", ". dots .", "12345", "the scan 7", "Photo DSC_001",
)

_doc = "cast(doc_id as string)"
_v2 = (
    "'{\"schema_version\":\"2.0\",\"metadata_version\":\"m' || cast(doc_id % 3 as string) || '\",\"image_analysis\":{\"title\":\"Title ' || cast(doc_id % 50 as string) || '\",\"description\":\"About ' || lang || '\",\"image_category\":\"' || "
    "case doc_id % 7 when 0 then 'nature' when 1 then 'food' when 2 then 'screenshot' when 3 then 'document_id_or_passport' when 4 then 'invoice_or_receipt' when 5 then 'Document_other' else 'pet' end || '\"' || "
    "case when doc_id % 5 = 0 then '' else ',\"photo_estetic_quality\":' || cast(doc_id % 13 as string) end || case when doc_id % 4 = 0 then '' else ',\"photo_analysis_method\":\"m\"' end || "
    "',\"quality_issues\":[\" blur \",\"None\",\"\",\"noise' || cast(doc_id % 3 as string) || '\"],\"location\":{\"country\":\" C' || cast(doc_id % 4 as string) || '\",\"city\":\"\",\"place_name\":\"P\"}},"
    "\"people\":{\"vlm_analysis\":{' || case when doc_id % 3 = 0 then '' else '\"number_of_people\":' || cast(doc_id % 6 as string) || ',' end || '\"has_children\":' || case when doc_id % 2 = 0 then 'true' else 'false' end || '},\"detections\":{\"face_detection_method\":\"x\",\"people_bounding_boxes\":[{\"x_min\":1},{\"x_min\":2}]}},"
    "\"locations_by_source\":[{\"source\":\"' || case when doc_id % 2 = 0 then 'path_llm' else 'gps' end || '\",\"country\":\"' || case when doc_id % 3 = 0 then ' ' else 'N' end || '\",\"area\":\"' || case when doc_id % 5 = 0 then 'A' else '' end || '\"},{\"source\":\"path_llm\",\"city\":\"' || case when doc_id % 4 = 0 then 'Oslo' else '' end || '\"}],"
    "' || case when doc_id % 3 = 0 then '' else '\"orientation_detection\":{\"source\":\"' || case when doc_id % 5 = 0 then 'other' else 'face_landmarks' end || '\",\"correction_angle_clockwise\":' || cast((doc_id % 5) * 90 as string) || ',\"confidence\":0.' || cast(doc_id % 10 as string) || ',\"processed_at\":\"2026-02-0' || cast(1 + doc_id % 9 as string) || '\"},' end || "
    "case when doc_id % 4 = 0 then '\"orientation_detection_error\":{\"failed_at\":\"2026-02-05\"},' else '' end || case when doc_id % 11 = 0 then '\"wrong_rotation_user_dismissed\":{\"dismissed_at\":\"2026\"},' else '' end || '\"extra\":\"e' || cast(doc_id % 2 as string) || '\"}'"
)
_v1 = (
    "'{\"title\":\"Old ' || cast(doc_id % 50 as string) || '\",\"description\":\"Was ' || lang || '\",\"image_category\":\"' || case doc_id % 3 when 0 then 'food' when 1 then 'diagram' else 'sports' end || '\",\"photo_estetic_quality\":' || cast(doc_id % 12 as string) || "
    "',\"number_of_people\":' || cast(doc_id % 5 as string) || ',\"location\":{\"city\":\"Old town\",\"country\":\"O\"},\"quality_issues\":{\"1\":\"dark\",\"0\":\" soft \",\"x\":\"no\"},\"camera\":\"c' || cast(doc_id % 4 as string) || '\"}'"
)
VIEWS["media"] = (
    "select doc_id as id, case when doc_id % 13 = 0 then 'M' else 'L' end as library_id, '/lib/' || source || '/' || lang || '/IMG_' || " + _doc + " || case when doc_id % 10 = 9 then '.mp4' when doc_id % 10 = 8 then '.txt' else '.JPG' end as source_path, "
    "'IMG_' || " + _doc + " || case when doc_id % 10 = 9 then '.mp4' when doc_id % 10 = 8 then '.txt' else '.JPG' end as filename, case when doc_id % 10 = 9 then 'video/mp4' when doc_id % 10 = 7 then null when doc_id % 10 = 8 then 'text/plain' else 'image/jpeg' end as mime_type, "
    "case when doc_id % 19 = 0 then null else 'Day at ' || source end as display_title, n_chars as byte_size, doc_id % 3 as mtime, 400 + doc_id % 5 as width, 300 + doc_id % 3 as height, doc_id % 8 as orientation, case when doc_id % 5 = 0 then null else md5(text) end as content_hash, 'v2' as metadata_version, "
    "case when doc_id % 23 = 0 then '2026-01-15' end as deleted_at, case when doc_id % 7 = 0 then null else doc_id % 7 - 1 end as star_rating, "
    "case when doc_id % 3 = 0 then null when doc_id % 6 = 1 then cast(2001 + doc_id % 20 as string) else cast(2001 + doc_id % 20 as string) || '-' || lpad(cast(1 + doc_id % 12 as string), 2, '0') end as photo_taken_at, cast(2015 + doc_id % 9 as string) || '-05-01' as file_created_at, "
    "case when doc_id % 4 = 0 then null else cast(1990 + doc_id % 30 as string) || '-06' end as event_start, case when doc_id % 4 = 1 then cast(1992 + doc_id % 30 as string) end as event_end, "
    "case when doc_id % 6 = 0 then null else cast(doc_id % 90 as double) end as age_min, case when doc_id % 6 = 0 then null else cast(doc_id % 90 + 5 as double) end as age_max, case when doc_id % 5 = 0 then null else doc_id % 4 end as people, case when doc_id % 7 = 0 then doc_id % 3 end as face_count, "
    "case when doc_id % 9 = 0 then null else 'Land ' || lang end as country, case when doc_id % 8 = 0 then ' ' else 'City ' || source end as city, case when doc_id % 5 = 0 then null else 'Area ' || cast(doc_id % 4 as string) end as area, case when doc_id % 7 = 0 then 'Sub_' || lang end as area2, case when doc_id % 6 = 0 then 'Old % pier' end as place, case when doc_id % 10 = 0 then 'Named' end as location_name, "
    "case doc_id % 4 when 0 then 'gps' when 1 then 'path_llm' when 2 then 'ai_vision' end as location_source, case when doc_id % 3 = 0 then null else 48.0 + doc_id % 7 end as latitude, case when doc_id % 5 = 0 then null else 10.0 + doc_id % 9 end as longitude, "
    "case when doc_id % 4 = 0 then null else '2026-02-0' || cast(1 + doc_id % 9 as string) end as photo_done_at, case when doc_id % 6 = 0 then '2026-02-05' end as photo_failed_at, case when doc_id % 3 = 0 then null else '2026-02-0' || cast(1 + doc_id % 8 as string) end as face_done_at, case when doc_id % 5 = 0 then '2026-02-04' end as face_failed_at, "
    f"case when doc_id % 17 = 0 then null when doc_id % 5 = 2 then {_v1} else {_v2} end as ai_metadata from documents"
)
_listed = "case doc_id % " + str(len(NAMES)) + " " + " ".join(f"when {k} then '{n}'" for k, n in enumerate(NAMES)) + " end"
#: File names: beginnings of texts, names with numbers and dates from the documents' columns, and the listed shapes.
VIEWS["names"] = (
    "select doc_id as id, case when doc_id % 4 = 1 and lang = 'en' then translate(substr(text, 1, 60), chr(9) || chr(10) || chr(13), '   ') || '.jpg' when doc_id % 4 = 2 then 'IMG_' || cast(20000101 + n_chars as string) || '_' || cast(doc_id as string) || '.JPG' "
    "when doc_id % 4 = 3 then cast(1900 + n_chars % 150 as string) || '-' || lpad(cast(1 + n_chars % 14 as string), 2, '0') || '-' || lpad(cast(1 + doc_id % 33 as string), 2, '0') || ' ' || source "
    f"else {_listed} end as name, source, lang, n_chars from documents"
)
VIEWS["tags"] = "select doc_id as id, case doc_id % 8 when 0 then '2009' when 1 then '1850-13' when 2 then ' 2011-04 ' when 3 then '2010-02-30' when 4 then '2010-02-28' when 5 then '2014:05:06 07:08:09' when 6 then 'soon' else '1999-12' end as raw, case when doc_id % 3 = 0 then -1 when doc_id % 3 = 1 then doc_id % 9 else null end as xmp, case when doc_id % 4 = 0 then doc_id % 120 end as exif, doc_id % 101 as percent from documents"

_title = "case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.image_analysis.title') else json_extract_string(ai_metadata, '$.title') end"
_cat = "case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.image_analysis.image_category') else json_extract_string(ai_metadata, '$.image_category') end"
_raw_q = "coalesce(try_cast(json_extract_string(ai_metadata, '$.image_analysis.photo_estetic_quality') as double), try_cast(json_extract_string(ai_metadata, '$.photo_estetic_quality') as double))"
_qual = f"case when {_raw_q} is not null then greatest(1.0, least(10.0, {_raw_q})) end"


# ------------------------------------------------------------------ filters


@query("p13_smart_album_text", "select id from media where display_title ilike '%day at src1%' or filename ilike '%day at src1%' or coalesce(json_extract_string(ai_metadata, '$.image_analysis.title'), '') ilike '%day at src1%' or coalesce(json_extract_string(ai_metadata, '$.image_analysis.description'), '') ilike '%day at src1%' or coalesce(json_extract_string(ai_metadata, '$.title'), '') ilike '%day at src1%' or coalesce(json_extract_string(ai_metadata, '$.description'), '') ilike '%day at src1%' union select id from media where coalesce(json_extract_string(ai_metadata, '$.image_analysis.title'), json_extract_string(ai_metadata, '$.title'), '') ilike '%le 4_%'", ("media",))
def p13(spark, d):
    m = view(spark, d, "media")
    return m.where(C.text_like("day at SRC1") | C.text_like("le 4_")).select("id")


@query("p8_place_contains", "select id from media where concat_ws(chr(1), country, city, area, area2, place, location_name) ilike '%b_de%' or coalesce(place, '') ilike '%d % p%'", ("media",))
def p8(spark, d):
    return view(spark, d, "media").where(C.place_like("b_de") | C.place_like("d % p")).select("id")


@query("p14_ratings", f"select id from media where coalesce(star_rating, 0) = 3 and coalesce({_raw_q}, 0) between 5 and 6 union all select -1 - id from media where coalesce(star_rating, 0) >= 4 or coalesce({_raw_q}, 0) >= 9", ("media",))
def p14(spark, d):
    m = view(spark, d, "media").withColumn("q", F.coalesce(F.get_json_object("ai_metadata", "$.image_analysis.photo_estetic_quality"), F.get_json_object("ai_metadata", "$.photo_estetic_quality")).try_cast("double"))
    exact = m.where(C.rated(F.col("star_rating"), F.col("q"), 3, True, 5, True, both=True)).select("id")
    return exact.unionByName(m.where(C.rated(F.col("star_rating"), F.col("q"), 4, False, 9)).select((-1 - F.col("id")).alias("id")))


@query("p15_excluded_categories", f"select id, {_cat} as category from media where not (lower(coalesce({_cat}, '')) like 'document%' or lower(coalesce({_cat}, '')) like '%screenshot%' or lower(coalesce({_cat}, '')) in ('invoice_or_receipt', 'presentation_slide', 'diagram'))", ("media",))
def p15(spark, d):
    m = view(spark, d, "media").withColumn("category", M.category(F.col("ai_metadata")))
    return m.where(~C.left_out(F.col("category"))).select("id", "category")


@query("p16_taken_between", "select id from media where coalesce(photo_taken_at, file_created_at) >= '2008' and coalesce(photo_taken_at, file_created_at) <= '2016-05-31T23:59:59.999Z'", ("media",))
def p16(spark, d):
    return view(spark, d, "media").where(C.taken_between(D.month_bound("2008", False)[:4], D.month_bound("2016-05", True))).select("id")


@query("p11_ages_meet", "select id from media where age_max >= 18 and age_min <= 30", ("media",))
def p11(spark, d):
    return view(spark, d, "media").where(C.ages_meet(18, 30)).select("id")


@query("p19_not_from_gps", "select id from media where location_source is distinct from 'gps'", ("media",))
def p19(spark, d):
    return view(spark, d, "media").where(C.from_gps(False)).select("id")


@query("p27_needs_geocoding", "select id from media where latitude is not null and longitude is not null and (location_source is null or location_source <> 'gps' or country is null or area is null or city is null)", ("media",))
def p27(spark, d):
    return view(spark, d, "media").where(C.needs_geocoding()).select("id")


@query("p29_photo_analysed", "select id from media where photo_done_at is not null and (photo_failed_at is null or photo_done_at > photo_failed_at) and coalesce(json_extract_string(ai_metadata, '$.image_analysis.photo_analysis_method'), json_extract_string(ai_metadata, '$.photo_analysis_method'), '') <> ''", ("media",))
def p29(spark, d):
    return view(spark, d, "media").where(C.photo_analysed()).select("id")


@query("p23_kinds", "select id, mime_type ilike 'image/%' or regexp_matches(lower(source_path), '[.](jpg|jpeg|png|webp|gif|heic|tif|tiff)$') as image, case when mime_type ilike 'video/%' then 'video' when mime_type ilike 'image/%' then 'image' when regexp_matches(lower(source_path), '[.](mp4|mov|mkv|avi|webm|m4v)$') then 'video' else 'image' end as kind, case regexp_extract(lower(source_path), '[.]([a-z0-9]+)$', 1) when 'jpg' then 'image/jpeg' when 'mp4' then 'video/mp4' end as mime from media", ("media",))
def p23(spark, d):
    path, mime = F.col("source_path"), F.col("mime_type")
    return view(spark, d, "media").select("id", SRC.is_image(path, mime).alias("image"), SRC.media_kind(path, mime).alias("kind"), SRC.mime(path).alias("mime"))


QUICK = C.QuickFilter(people="gte_2", stars="gte_3", years=(1995, 2012), location="land")
_people = "coalesce(case when try_cast(case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.people.vlm_analysis.number_of_people') else json_extract_string(ai_metadata, '$.number_of_people') end as double) >= 0 then try_cast(case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.people.vlm_analysis.number_of_people') else json_extract_string(ai_metadata, '$.number_of_people') end as double) end, face_count, people, case when json_extract_string(ai_metadata, '$.people.detections.face_detection_method') is not null then json_array_length(ai_metadata, '$.people.detections.people_bounding_boxes') end)"


@query("p31_quick_filter", f"select id from media where {_cat} is distinct from 'document_id_or_passport' and {_people} >= 2 and star_rating between 3 and 5 and event_start is not null and cast(substr(coalesce(event_end, event_start), 1, 4) as int) >= 1995 and cast(substr(event_start, 1, 4) as int) <= 2012 and lower(concat_ws(' ', country, city)) like '%land%'", ("media",))
def p31(spark, d):
    return QUICK.rows(view(spark, d, "media")).select("id")


@query("p31_quick_kinds", f"select id, coalesce({_cat} in ('invoice_or_receipt', 'document_id_or_passport', 'document_contract', 'document_other', 'presentation_slide', 'diagram', 'screenshot'), false) as document, coalesce({_cat} = 'nature', false) as nature, coalesce(ceil({_qual} / 2) >= 4, false) as ai, coalesce({_people} = 0, false) and {_cat} is distinct from 'document_id_or_passport' as nobody, star_rating is null or star_rating < 1 as unrated from media", ("media",))
def p31_kinds(spark, d):
    each = {"document": C.QuickFilter(documents="all"), "nature": C.QuickFilter(category="nature"), "ai": C.QuickFilter(ai_stars="gte_4"), "unrated": C.QuickFilter(stars="unrated")}
    m, read = M.read_once(view(spark, d, "media"), *M.READ), F.col("__read")
    nobody = F.coalesce(C.people_count(read=read) == 0, F.lit(False))
    return m.select("id", *[f.column(read=read).alias(n) for n, f in each.items()], (nobody & ~read["category"].eqNullSafe("document_id_or_passport")).alias("nobody"))


@query("p30_similarity_gate", "select a.vec_id as id, (a.embedding[1] >= 0.05 or b.embedding[2] >= 0.1) as hybrid, a.embedding[1] >= 0.05 as image_only from embeddings a join embeddings b on b.vec_id = a.vec_id")
def p30(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding")[0].alias("i"), F.col("embedding")[1].alias("t"))
    gate = lambda mode: C.passes_gate(F.col("i").cast("double"), F.col("t").cast("double"), 0.05, 0.1, mode)
    return e.select("id", gate("hybrid").alias("hybrid"), gate("vlm-only").alias("image_only"))


# ------------------------------------------------------------------ metadata


@query("x30_metadata_fields", f"select id, {_title} as title, {_cat} as category, {_qual} as quality, coalesce(json_extract_string(ai_metadata, '$.schema_version') = '2.0', false) as v2 from media", ("media",))
def x30(spark, d):
    doc = F.col("ai_metadata")
    return view(spark, d, "media").select("id", M.title(doc).alias("title"), M.category(doc).alias("category"), M.quality(doc).alias("quality"), M.is_v2(doc).alias("v2"))


@query("x28_normalised", f"select id, '2.0' as version, {_title} as title, {_raw_q} as quality, case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.people.vlm_analysis.number_of_people') else json_extract_string(ai_metadata, '$.number_of_people') end as people, json_extract_string(ai_metadata, '$.camera') as camera, json_extract_string(ai_metadata, '$.extra') as extra from media", ("media",))
def x28(spark, d):
    n = view(spark, d, "media").select("id", M.normalised("ai_metadata").alias("n"))
    at = lambda p: F.get_json_object("n", f"$.{p}")
    return n.select("id", at("schema_version").alias("version"), at("image_analysis.title").alias("title"), at("image_analysis.photo_estetic_quality").try_cast("double").alias("quality"), at("people.vlm_analysis.number_of_people").alias("people"), at("camera").alias("camera"), at("extra").alias("extra"))


@query("x29_merged", f"select id, 'new ' || cast(id % 5 as string) as title, {_cat} as category, 'true' as children, case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then json_extract_string(ai_metadata, '$.people.vlm_analysis.number_of_people') else json_extract_string(ai_metadata, '$.number_of_people') end as people, 'over' as extra from media", ("media",))
def x29(spark, d):
    patch = F.concat(F.lit('{"image_analysis":{"title":"new '), (F.col("id") % 5).cast("string"), F.lit('"},"people":{"vlm_analysis":{"has_children":true}},"extra":"over"}'))
    n = view(spark, d, "media").select("id", M.merged("ai_metadata", patch).alias("n"))
    at = lambda p: F.get_json_object("n", f"$.{p}")
    return n.select("id", at("image_analysis.title").alias("title"), at("image_analysis.image_category").alias("category"), at("people.vlm_analysis.has_children").alias("children"), at("people.vlm_analysis.number_of_people").alias("people"), at("extra").alias("extra"))


@query("x31_quality_issues", "select id, case when ai_metadata is null then null when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then 'blur,noise' || cast(id % 3 as string) else 'soft,dark' end as issues from media", ("media",))
def x31(spark, d):
    return view(spark, d, "media").select("id", F.array_join(M.quality_issues(F.col("ai_metadata")), ",").alias("issues"))


@query("r4_search_fields", f"select id, coalesce({_title}, '') as title, coalesce(location_name, case when json_extract_string(ai_metadata, '$.schema_version') = '2.0' then 'P, C' || cast(id % 4 as string) when ai_metadata is not null then 'Old town, O' end, '') as location, concat_ws(' | ', nullif({_title}, ''), nullif(display_title, '')) as one_title from media", ("media",))
def r4(spark, d):
    m = view(spark, d, "media").withColumn("s", M.search_fields(F.col("ai_metadata"), F.col("location_name")))
    titles = M.joined(" | ", F.col("s.title"), F.coalesce("display_title", F.lit("")))
    return m.select("id", F.col("s.title").alias("title"), F.col("s.location").alias("location"), titles.alias("one_title"))


@query("r12_star_ratings", "select id, coalesce(case when xmp = -1 then -1 when xmp between 0 and 5 then xmp when xmp > 5 then case when xmp <= 24 then 1 when xmp <= 49 then 2 when xmp <= 74 then 3 when xmp <= 98 then 4 else 5 end end, case when exif between 0 and 5 then exif when exif > 5 and exif <= 100 then case when exif <= 24 then 1 when exif <= 49 then 2 when exif <= 74 then 3 when exif <= 98 then 4 else 5 end end, case when percent <= 0 then 0 when percent <= 24 then 1 when percent <= 49 then 2 when percent <= 74 then 3 when percent <= 98 then 4 else 5 end)::int as stars, [0, 1, 25, 50, 75, 99, 99, 99, 99, 99][1 + percent % 10] as percent_of, case when id % 7 - 1 = -1 then 'file_rating_rejected' when id % 7 - 1 = 0 then 'file_rating_unrated' else 'file_rating_' || cast(id % 7 - 1 as string) end as tokens from tags", ("tags",))
def r12(spark, d):
    t = view(spark, d, "tags")
    return t.select("id", M.star_rating(F.col("xmp"), F.col("exif"), F.col("percent")).alias("stars"), M.percent_of_stars(F.col("percent") % 10).alias("percent_of"), M.rating_tokens(F.col("id") % 7 - 1).alias("tokens"))


ANSWER = "case id % 6 when 0 then '{\"image_category\":\" food \",\"title\":\"T' || cast(id % 9 as string) || '\",\"description\":\"D\",\"number_of_people\":' || cast(id % 4 as string) || ',\"people\":[{\"average_age\":' || cast(id % 70 as string) || '},{\"average_age\":\"x\"},{\"average_age\":30}],\"location\":\" Rome \"}' when 1 then 'Sure: ```json {\"image_category\":\"pet\",\"title\":\"U\",\"description\":\"E\",\"has_children\":true} ``` done' when 2 then 'text {\"image_category\":\"a\",\"title\":\"\",\"description\":\"F\"} more' when 3 then 'no json' when 4 then 'see {\"image_category\":\"sports\",\"title\":5,\"description\":\"G\"}' else 'so {\"image_category\":\"humor\",\"title\":\"V\",\"description\":\"H\",\"number_of_people\":\"3\"} end' end"
VIEWS["answers"] = f"select id, {ANSWER} as answer from names"


@query("x32_photo_analyses", "select id, case id % 6 when 0 then 'food' when 1 then 'pet' when 5 then 'humor' end as category, case id % 6 when 0 then 'T' || cast(id % 9 as string) when 1 then 'U' when 5 then 'V' end as title, case when id % 6 = 0 then cast(id % 4 as double) end as people, case when id % 6 = 1 then 1 end as children, case when id % 6 = 0 then least(30.0, cast(id % 70 as double)) end as age_min, case when id % 6 = 0 then greatest(30.0, cast(id % 70 as double)) end as age_max, case id % 6 when 0 then 'T' || cast(id % 9 as string) || '. D. Location: Rome. People detected: ' || cast(id % 4 as string) || '. Detected ages: ' || cast(id % 70 as string) || ', 30' when 1 then 'U. E' when 5 then 'V. H' end as caption from answers", ("answers",))
def x32(spark, d):
    a = view(spark, d, "answers").select("id", M.photo_analysis(F.col("answer")).alias("a"))
    ages = M.age_range(F.col("a.ages"))
    return a.select("id", F.col("a.image_category").alias("category"), F.col("a.title").alias("title"), F.col("a.number_of_people").alias("people"), F.col("a.has_children").cast("int").alias("children"), ages["age_min"].alias("age_min"), ages["age_max"].alias("age_max"), F.when(F.col("a").isNotNull(), M.caption(F.col("a"))).alias("caption"))


@query("x33_crops_and_angles", "select id, case when x between -0.02 and 1.02 and w between -0.02 and 1.02 and greatest(0, least(1, w)) > 0 and greatest(0, x) + least(1, w) <= 1.02 and least(least(1.0, w), 1 - greatest(0, x)) > 0 then round(least(least(1.0, w), 1 - greatest(0, x)), 6) end as width, case id % 5 when 0 then 90 when 1 then 270 when 2 then 270 when 3 then 180 end as angle from (select id, (id % 30) / 25.0 - 0.03 as x, (id % 11) / 10.0 as w from names)", ("names",))
def x33(spark, d):
    n = view(spark, d, "names")
    box = M.crop_box((F.col("id") % 30) / 25.0 - 0.03, F.lit(0.0), (F.col("id") % 11) / 10.0, F.lit(1.0))
    k = F.col("id") % 5
    explicit = F.when(k == 0, "90").when(k == 1, "-90").when(k == 4, "45")
    observed = F.when(k == 2, "rotated_90_cw").when(k == 3, "rotated_180").otherwise("uncertain")
    return n.select("id", F.round(box["width"], 6).alias("width"), M.rotation_angle(explicit, observed).alias("angle"))


PATH_ANSWER = "case id % 5 when 0 then '[{\"index\":1,\"date\":{\"start\":\"2001\"},\"location\":{\"country\":\"France\",\"city\":\"Paris\"}},{\"index\":2}]' when 1 then '{\"results\":[{\"index\":1},{\"index\":2,\"date\":{\"start\":\"2001-02\"}}]}' when 2 then '{\"index\":1,\"date\":null}' when 3 then '```json [{\"index\":7},{\"index\":8}] ```' else '[{\"index\":1}]' end"
VIEWS["path_answers"] = f"select id, {PATH_ANSWER} as answer from names"


@query("x34_path_answers", "select id, case id % 5 when 0 then 2 when 1 then 2 when 3 then 2 end as answers, case id % 5 when 0 then 1 when 1 then 1 when 3 then 7 end as first_index, case when id % 2 = 0 then 'year' else 'month' end as precision, case when id % 3 = 0 then 'Rome' end as one_place, case when id % 4 = 0 then null else 'Paris' end as city from path_answers", ("path_answers",))
def x34(spark, d):
    a = view(spark, d, "path_answers").withColumn("a", M.answers(F.col("answer"), F.lit(2)))
    i = F.col("id")
    start = F.when(i % 2 == 0, "2001").otherwise("2001-02")
    text = F.when(i % 3 == 0, " Rome ").when(i % 3 == 1, "Rome, Milan").otherwise("Rome and Milan")
    place = M.consistent_place(F.when(i % 4 == 0, "Italy").otherwise("france "), F.lit("Paris"))
    return a.select("id", F.size("a").alias("answers"), F.try_variant_get(F.try_element_at("a", F.lit(1)), "$.index", "int").alias("first_index"), M.date_precision(start, F.lit(None).cast("string")).alias("precision"), M.one_place(text).alias("one_place"), place["city"].alias("city"))


QUERY_ANSWER = "case id % 5 when 0 then '{\"original_language\":\"' || lang || '\",\"english_query\":\"red ' || source || '\",\"keywords\":[\" ' || source || ' \",\"car\",\"\",\"a\",\"b\",\"c\",\"d\"]}' when 1 then '{\"englishQuery\":\"dog ' || cast(n_chars as string) || '\",\"translated\":true,\"key_concepts\":[\"' || lang || '\"]}' when 2 then 'no' when 3 then '{\"english_query\":\"Same as input\"}' else '{\"keywords\":[1]}' end"
VIEWS["query_answers"] = f"select id, lang, source, n_chars, {QUERY_ANSWER} as answer from names"


@query("x36_query_analyses", "select id, case id % 5 when 0 then lang when 1 then 'en' when 4 then 'en' end as language, case id % 5 when 0 then case when lang = 'en' then 0 else 1 end when 1 then 1 when 4 then 0 end as translated, case id % 5 when 0 then 'red ' || source when 1 then 'dog ' || cast(n_chars as string) when 4 then 'raw' end as english, case id % 5 when 0 then source || ',car,a,b,c' when 1 then lang when 4 then '' end as keywords from query_answers", ("names", "query_answers"))
def x36(spark, d):
    a = view(spark, d, "query_answers").select("id", M.query_analysis(F.col("answer"), F.lit("raw")).alias("q"))
    return a.select("id", "q.language", F.col("q.translated").cast("int").alias("translated"), "q.english", F.array_join("q.keywords", ",").alias("keywords"))


@query("x23_spoken_places", "select id, case id % 5 when 0 then 'Italy' when 1 then 'France' when 2 then 'Lyon' when 3 then 'Peru' end as country, case id % 5 when 0 then 'Rome' when 1 then 'Lyon' when 2 then 'Nowhere' end as city, case when id % 5 = 0 then 'Colosseum, north' end as place from names", ("names",))
def x23(spark, d):
    i = F.col("id") % 5
    text = F.when(i == 0, "Rome, country: Italy, Colosseum, north").when(i == 1, "France, Lyon").when(i == 2, "Lyon, Nowhere, unknown").when(i == 3, "Peru").otherwise("n/a, somewhere")
    countries = F.array(*[F.lit(c) for c in ("italy", "france", "peru")])
    return view(spark, d, "names").select("id", M.spoken_place(text, countries).alias("p")).select("id", "p.country", "p.city", "p.place")


# ------------------------------------------------------------------ dates and titles

_ymd = r"(\d{4})-(\d{2})-(\d{2})"
_r1, _r2, _r3 = _ymd + r"\s*-{1,2}\s*" + _ymd, _ymd + r"\s*-{1,2}\s*(\d{2})-(\d{2})", _ymd + r"\s*-{1,2}\s*(\d{1,2})(?:\D|$)"
_r4, _r5 = r"\b(\d{4})\s*-{1,2}\s*(\d{4})\b", r"\b(\d{4})\s*--\s*(\d{2})\b"
_r6, _r7 = _ymd + r"(?:\D|$)", r"(?:^|[_\-\s])(\d{4})(\d{2})(\d{2})(?:\D|$)"
_r8, _r9 = r"\b(\d{4})-(\d{2})(?:[^-]|-\D|-$|$)", r"(?:^|\s|[_\-(])(\d{4})(?:\s|[_\-),.]|$)"


def _g(r: str, i: int) -> str:
    return f"regexp_extract(name, '{r}', {i})"


def _ok(r: str, y: int, m: int | None = None, day: int | None = None) -> str:
    out = f"try_cast({_g(r, y)} as int) between 1800 and 2100"
    out += f" and try_cast({_g(r, m)} as int) between 1 and 12" if m else ""
    return out + (f" and try_cast({_g(r, day)} as int) between 1 and 31" if day else "")


def _iso(r: str, *parts: int) -> str:
    return " || '-' || ".join(_g(r, p) for p in parts)


_short = f"case when cast(left({_g(_r5, 1)}, 2) || {_g(_r5, 2)} as int) < cast({_g(_r5, 1)} as int) then cast(left({_g(_r5, 1)}, 2) || {_g(_r5, 2)} as int) + 100 else cast(left({_g(_r5, 1)}, 2) || {_g(_r5, 2)} as int) end"
_RULES = (
    (f"{_ok(_r1, 1, 2, 3)} and {_ok(_r1, 4, 5, 6)}", _iso(_r1, 1, 2, 3), _iso(_r1, 4, 5, 6), "day"),
    (f"not regexp_matches(name, '{_r1}') and {_ok(_r2, 1, 2, 3)} and {_ok(_r2, 1, 4, 5)}", _iso(_r2, 1, 2, 3), _iso(_r2, 1, 4, 5), "day"),
    (f"not regexp_matches(name, '{_r1}') and not regexp_matches(name, '{_r2}') and {_ok(_r3, 1, 2, 3)} and {_ok(_r3, 1, 2, 4)}", _iso(_r3, 1, 2, 3), f"{_iso(_r3, 1, 2)} || '-' || lpad({_g(_r3, 4)}, 2, '0')", "day"),
    (f"{_ok(_r4, 1)} and {_ok(_r4, 2)} and {_g(_r4, 2)} > {_g(_r4, 1)}", _g(_r4, 1), _g(_r4, 2), "year"),
    (f"{_ok(_r5, 1)} and ({_short}) <= 2100 and ({_short}) > cast({_g(_r5, 1)} as int)", _g(_r5, 1), f"cast({_short} as string)", "year"),
    (_ok(_r6, 1, 2, 3), _iso(_r6, 1, 2, 3), "null", "day"),
    (_ok(_r7, 1, 2, 3), _iso(_r7, 1, 2, 3), "null", "day"),
    (_ok(_r8, 1, 2), _iso(_r8, 1, 2), "null", "month"),
    (_ok(_r9, 1), _g(_r9, 1), "null", "year"),
)
_case = lambda k, quote: "case " + " ".join(f"when {r[0]} then " + (f"'{r[k]}'" if quote else r[k]) for r in _RULES) + " end"


@query("x15_path_dates", f'select id, name, {_case(1, False)} as start, {_case(2, False)} as "end", {_case(3, True)} as precision from names', ("names",))
def x15(spark, d):
    return view(spark, d, "names").select("id", "name", D.date_in(F.col("name")).alias("p")).select("id", "name", "p.start", "p.end", "p.precision")


VIEWS["paths"] = "select id, 'C:' || chr(92) || 'albums' || chr(92) || case when id % 3 = 0 then '1994-09 lake' when id % 3 = 1 then 'misc' else 'misc (2002)' end || chr(92) || 'sub' || chr(92) || case id % 4 when 0 then '2001-02-03 a.b.jpg' when 1 then 'x.jpg' when 2 then 'IMG_20200306.JPG' else 'none' end as path from names"


@query("x16_dates_in_paths", "select id, case id % 4 when 0 then '2001-02-03' when 2 then '2020-03-06' else case id % 3 when 0 then '1994-09' when 2 then '2002' end end as start, case when id % 2 = 0 then 'script_filename' || case when id % 3 = 1 then '' else '+folder' end when id % 3 <> 1 then 'script_folder' end as source, case when id % 2 = 0 then 0 when id % 3 <> 1 then 2 end as depth from paths", ("paths",))
def x16(spark, d):
    return view(spark, d, "paths").select("id", D.date_in_path(F.col("path")).alias("p")).select("id", F.col("p.date.start").alias("start"), "p.source", "p.depth")


@query("x19_event_dates", "select id, case when p is not null and (t is null or cast(substr(p, 1, 4) as int) < cast(substr(t, 1, 4) as int)) then p when t is not null then t else c end as start, case when p is not null and (t is null or cast(substr(p, 1, 4) as int) < cast(substr(t, 1, 4) as int)) then case when id % 2 = 0 then 'path_llm' else 'path_script' end when t is not null then case when length(t) = 4 then 'xmp' else 'exif' end else 'file_mtime' end as source from (select id, photo_taken_at as t, event_start as p, file_created_at as c from media)", ("media",))
def x19(spark, d):
    m = view(spark, d, "media")
    path = F.when(F.col("event_start").isNotNull(), F.struct(F.col("event_start").alias("start"), F.lit(None).cast("string").alias("end"), F.lit("month").alias("precision")))
    precision = F.when(F.length("photo_taken_at") == 4, "year").otherwise("day")
    e = D.event_date(F.col("photo_taken_at"), precision, path, F.col("id") % 2 == 0, F.col("file_created_at"))
    return m.select("id", e.alias("e")).select("id", "e.start", "e.source")


_stem = r"regexp_replace(name, '(.)[.][^.]*$', '\1')"
_steps = (r"^(?:IMG|DSC[NF]?|DSCN|IMGP|SAM|MVI|MOV|VID|WP|PANO)[-_]?\d+(?:[-_]\d+)*", r"^scan\s*\d*", r"^(?:image|photo|pic|picture|img)\s*\d*", r"^P\d{4,}", r"\s+scan\s*\d+$", r"\s+(?:IMG|DSC[NF]?|DSCN)[-_]?\d+$", r"[\s_\-]+\d{1,4}$", r"^[\s,.\-_]+", r"[\s,.\-_]+$")
_cleaned = _stem
for _s in _steps:
    _cleaned = f"regexp_replace({_cleaned}, '{_s}', '', 'i')"


@query("x18_display_titles", f"select id, name, case when t <> '' and not regexp_matches(t, '^([0-9]+|scan)$', 'i') then t end as title from (select id, name, {_cleaned} as t from names)", ("names",))
def x18(spark, d):
    return view(spark, d, "names").select("id", "name", P.display_title(F.col("name")).alias("title"))


@query("x22_tag_dates", "select id, case id % 8 when 0 then '2009' when 2 then '2011-04' when 4 then '2010-02-28' when 5 then '2014-05-06T07:08:09.000Z' when 7 then '1999-12' end as value, case id % 8 when 0 then 'year' when 2 then 'month' when 4 then 'day' when 5 then 'instant' when 7 then 'month' end as precision, case id % 8 when 0 then '2009-01-01T00:00:00.000Z' when 2 then '2011-04-01T00:00:00.000Z' when 4 then '2010-02-28T00:00:00.000Z' when 5 then '2014-05-06T07:08:09.000Z' when 7 then '1999-12-01T00:00:00.000Z' end as sortable, case id % 8 when 0 then '2009' when 2 then 'Apr 2011' when 4 then '28 Feb 2010' when 5 then '6 May 2014' when 7 then 'Dec 1999' end as label, case when id % 8 = 4 then '2010-02-28' end as birth from tags", ("tags",))
def x22(spark, d):
    t = view(spark, d, "tags").select("id", "raw", D.tag_date(F.col("raw")).alias("t"))
    v, p = F.col("t.value"), F.col("t.precision")
    return t.select("id", v.alias("value"), p.alias("precision"), D.sortable(v, p).alias("sortable"), F.when(v.isNotNull(), D.date_label(v, p)).alias("label"), D.birth_date(F.col("raw")).alias("birth"))


@query("x21_leading_dates", "select id, case when n like '19__' or n like '20__' then n end as year, case id % 3 when 0 then '2001-02' when 1 then '2001-02' end as month from (select id, cast(1850 + id % 200 as string) as n from names)", ("names",))
def x21(spark, d):
    name = F.concat((F.col("id") % 200 + 1850).cast("string"), F.lit(" x.jpg"))
    other = F.when(F.col("id") % 3 == 0, "2001-02_a").when(F.col("id") % 3 == 1, "2001-02-03 b").otherwise("2001-02-31 c")
    return view(spark, d, "names").select("id", D.leading_date(name).alias("year"), D.leading_date(other).alias("month"))


@query("x25_person_ages", "select id, case when substr(day, 1, 10) <= '1996-06-15' then cast(1996 - cast(substr(day, 1, 4) as int) - case when '06-15' < substr(day, 6, 5) then 1 else 0 end as int) when id % 3 = 0 then cast(floor(vat + 0.5) as int) end as years, case when substr(day, 1, 10) <= '1996-06-15' then 'birth_date' when id % 3 = 0 then 'estimated_age_years' end as source from bills", ("bills",))
def x25p(spark, d):
    b = view(spark, d, "bills")
    return b.select("id", D.person_age(F.substring("day", 1, 10), F.lit("1996-06-15"), F.when(F.col("id") % 3 == 0, F.col("vat"))).alias("a")).select("id", "a.years", "a.source")


# ------------------------------------------------------------------ places, coverage


@query("p25_located_by_path", "select id, v and (id % 2 = 0 and (id % 3 <> 0 or id % 5 = 0) or id % 4 = 0) as located, v and id % 2 = 0 and id % 3 <> 0 as country from (select id, coalesce(json_extract_string(ai_metadata, '$.schema_version') = '2.0', false) as v from media)", ("media",))
def p25(spark, d):
    return view(spark, d, "media").select("id", C.located_by_path().alias("located"), C.located_by_path("country", "country_code").alias("country"))


_img, _vid = "(mime_type ilike 'image/%' or regexp_matches(lower(source_path), '[.](jpg|jpeg|png|webp|gif|heic|tif|tiff)$'))", "(mime_type ilike 'video/%' or regexp_matches(lower(source_path), '[.](mp4|mov|mkv|avi|webm|m4v)$'))"
_gps = "latitude is not null and longitude is not null"
_placed = f"{_gps} and location_source = 'gps' and (trim(coalesce(country, '')) <> '' or trim(coalesce(city, '')) <> '' or trim(coalesce(area, '')) <> '' or trim(coalesce(place, '')) <> '' or trim(coalesce(location_name, '')) <> '')"
_isv2 = "coalesce(json_extract_string(ai_metadata, '$.schema_version') = '2.0', false)"


@query("a4_geo_coverage", f"select count(*) filter ({_img}) as images, count(*) filter ({_img} and {_gps}) as images_gps, count(*) filter ({_img} and {_placed}) as images_placed, count(*) filter ({_img} and {_isv2} and (id % 2 = 0 and (id % 3 <> 0 or id % 5 = 0) or id % 4 = 0)) as path_placed, count(*) filter ({_img} and {_isv2} and id % 2 = 0 and id % 3 <> 0) as path_country, count(*) filter ({_img} and {_isv2} and id % 2 = 0 and id % 5 = 0) as path_area, count(*) filter ({_img} and {_isv2} and id % 4 = 0) as path_city, count(*) filter ({_vid}) as videos, count(*) filter ({_vid} and {_gps}) as videos_gps, count(*) filter ({_vid} and {_placed}) as videos_placed, count(*) filter (({_img} or {_vid}) and {_placed}) as placed from media where deleted_at is null", ("media",))
def a4(spark, d):
    return COV.places(view(spark, d, "media").where("deleted_at is null"))


_later = "(json_extract_string(ai_metadata, '$.orientation_detection_error') is null or json_extract_string(ai_metadata, '$.orientation_detection.processed_at') > json_extract_string(ai_metadata, '$.orientation_detection_error.failed_at'))"


@query("p22_rotations", f"select id, coalesce(json_extract_string(ai_metadata, '$.orientation_detection') is not null and {_later}, false) as done, coalesce(try_cast(json_extract_string(ai_metadata, '$.orientation_detection.correction_angle_clockwise') as int) in (90, 180, 270) and try_cast(json_extract_string(ai_metadata, '$.orientation_detection.confidence') as double) >= 0.4 and json_extract_string(ai_metadata, '$.wrong_rotation_user_dismissed.dismissed_at') is null and {_later}, false) as wrong, coalesce(json_extract_string(ai_metadata, '$.orientation_detection_error') is not null and (json_extract_string(ai_metadata, '$.orientation_detection') is null or json_extract_string(ai_metadata, '$.orientation_detection_error.failed_at') >= json_extract_string(ai_metadata, '$.orientation_detection.processed_at')), false) as failed, case when json_extract_string(ai_metadata, '$.orientation_detection.source') = 'face_landmarks' and try_cast(json_extract_string(ai_metadata, '$.orientation_detection.correction_angle_clockwise') as int) in (0, 90, 180, 270) then json_extract_string(ai_metadata, '$.orientation_detection.source') end as source from media", ("media",))
def p22(spark, d):
    r = C.Rotation()
    return view(spark, d, "media").select("id", r.done.alias("done"), r.wrong(0.4).alias("wrong"), r.failed.alias("failed"), I.orientation_state(F.col("ai_metadata"))["source"].alias("source"))


@query("l12_wrong_rotations", "select id, confidence from (select id, source_path, try_cast(json_extract_string(ai_metadata, '$.orientation_detection.confidence') as double) as confidence, try_cast(json_extract_string(ai_metadata, '$.orientation_detection.correction_angle_clockwise') as int) as a, " + _later + " as later, json_extract_string(ai_metadata, '$.wrong_rotation_user_dismissed.dismissed_at') as gone from media) where a in (90, 180, 270) and confidence >= 0.4 and later and gone is null order by confidence desc, source_path limit 24 offset 24", ("media",))
def l12(spark, d):
    m = view(spark, d, "media").where(C.Rotation().wrong(0.4)).withColumn("confidence", F.get_json_object("ai_metadata", "$.orientation_detection.confidence").try_cast("double"))
    return m.orderBy(F.desc("confidence"), "source_path").offset(24).limit(24).select("id", "confidence")


VIEWS["vectors"] = "select e.vec_id as item_id, 'image' as kind, 'm1' as model, e.embedding as embedding, case e.vec_id % 5 when 0 then 'failed' when 1 then 'indexing' else 'ready' end as status, case when e.vec_id % 5 = 0 then 'broken' end as error from embeddings e union all select f.vec_id as item_id, 'text' as kind, 'm1' as model, g.embedding as embedding, 'ready' as status, null as error from embeddings f join embeddings g on g.vec_id = (f.vec_id * 7 + 3) % 500"


@query("a2_analyses", f"select count(*) as total, count(*) filter (photo_done_at is not null and (photo_failed_at is null or photo_done_at > photo_failed_at)) as photo_done, count(*) filter (photo_failed_at is not null and (photo_done_at is null or photo_failed_at >= photo_done_at)) as photo_failed, count(*) filter (face_done_at is not null and (face_failed_at is null or face_done_at > face_failed_at)) as face_done, count(*) filter (face_failed_at is not null and (face_done_at is null or face_failed_at >= face_done_at)) as face_failed, count(*) filter (status = 'ready') as semantic_done, count(*) filter (status = 'failed') as semantic_failed, count(*) filter (json_extract_string(ai_metadata, '$.orientation_detection') is not null and {_later}) as rotation_done, count(*) filter (try_cast(json_extract_string(ai_metadata, '$.orientation_detection.correction_angle_clockwise') as int) in (90, 180, 270) and try_cast(json_extract_string(ai_metadata, '$.orientation_detection.confidence') as double) >= 0.4 and json_extract_string(ai_metadata, '$.wrong_rotation_user_dismissed.dismissed_at') is null and {_later}) as rotation_wrong, count(*) filter (json_extract_string(ai_metadata, '$.orientation_detection_error') is not null and (json_extract_string(ai_metadata, '$.orientation_detection') is null or json_extract_string(ai_metadata, '$.orientation_detection_error.failed_at') >= json_extract_string(ai_metadata, '$.orientation_detection.processed_at'))) as rotation_failed, count(n) as with_faces, count(*) filter (tagged > 0) as with_tagged from media left join (select * from vectors where kind = 'image' and model = 'm1') v on v.item_id = media.id left join (select item_id, count(*) as n, count(tag_id) as tagged from faces group by item_id) f on f.item_id = media.id where deleted_at is null and {_img}", ("media", "vectors", "faces"))
def a2_analyses(spark, d):
    return COV.analyses(view(spark, d, "media").where("deleted_at is null"), view(spark, d, "vectors"), view(spark, d, "faces"), "m1", 0.4)


#: What is done in each folder, by the day its files were made and their width.
VIEWS["done_in"] = (
    "select substr(source_path, 1, length(source_path) - length(filename)) || file_created_at || '/' || cast(width as string) as folder, count(*) as total, count(photo_done_at) as photo, count(face_done_at) as face, count(star_rating) as semantic, "
    "count(latitude) as located, max(case when width % 2 = 0 then photo_done_at end) as scanned, sum(case when mtime = 2 then 1 else 0 end) as fresh from media group by substr(source_path, 1, length(source_path) - length(filename)) || file_created_at || '/' || cast(width as string)"
)
_part = "case when {0} >= total then 'done' when {0} = 0 then 'not_done' else 'partial' end"


@query("r15_folder_labels", f"select folder, case when f = 'done' and s = 'done' and p <> 'done' then 'photo_analysis_waiting' when f = 'done' and s = 'done' then 'all_done' when 'partial' in (p, f, s) then 'partial' when 'not_done' in (p, f, s) then 'not_done' else 'all_done' end as label, case when fresh > 1 then 'in_progress' when scanned is not null then 'analyzed' else 'not_scanned' end as state, case when scanned is not null and fresh = 0 and located <> 0 then 'skip' when scanned is null then 'full' else 'incremental' end as plan from (select *, {_part.format('photo')} as p, {_part.format('face')} as f, {_part.format('semantic')} as s from done_in)", ("media", "done_in"))
def r15(spark, d):
    each = lambda c: S.coverage_label(F.col(c), F.lit(0), F.col("total"))
    label = COV.rollup_label(each("photo"), each("face"), each("semantic"), F.col("total"))
    plan = COV.geo_scan_plan(F.col("total"), F.col("located"), F.col("scanned"), F.col("fresh"))
    return view(spark, d, "done_in").select("folder", label.alias("label"), COV.folder_state(F.col("fresh") > 1, F.col("scanned")).alias("state"), plan.alias("plan"))


VIEWS["cities"] = (
    "select c_custkey as id, c_name as city, 'N' || cast(n_nationkey as string) as code, cast(n_regionkey as string) as admin, n_name as area, "
    "cast(cast(round(c_acctbal * 100) as bigint) % 9000 as double) / 100 as lat2, cast(c_custkey * 7919 % 36000 as double) / 100 - 180 as lon2 from customer join nation on n_nationkey = c_nationkey"
)
VIEWS["points"] = "select o_orderkey as id, cast(cast(round(o_totalprice * 100) as bigint) % 18000 as double) / 100 - 90 as latitude, cast((o_custkey * 104729 + o_orderkey) % 36000 as double) / 100 - 180 as longitude from orders"


@query("j22_nearest_city", "select points_id as id, arg_min(city, (km, city)) as city, arg_min(code, (km, city)) as country_code, arg_min(area, (km, city)) as area, min(km) as distance_km from (select points.id as points_id, city, code, area, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(lat2 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(lat2)) * power(sin(radians(lon2 - longitude) / 2), 2)))), 6) as km from points, cities) group by points_id", ("points", "cities"))
def j22(spark, d):
    """Orders' places and the nearest customers', which are written and read as GeoNames dumps are."""

    def dumped() -> list[str]:
        paths = [fresh_path(spark, n) for n in ("cities", "admin1", "admin2")]
        none = F.lit("")
        c = view(spark, d, "cities")
        columns = [F.col("city").alias("name"), none, none, F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), none, none, F.col("code"), none, F.col("admin"), none]
        c.select("id", *[x.alias(f"c{k}") for k, x in enumerate(columns)]).write.option("sep", "\t").csv(paths[0])
        table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey", F.lit("."), F.col("n_regionkey")), "n_name").write.option("sep", "\t").csv(paths[1])
        spark.createDataFrame([("none", "none")], "a string, b string").write.option("sep", "\t").csv(paths[2])
        return paths

    cities = SRC.geo_names(spark, *once(table(spark, d, "customer"), f"geo {d}", dumped))
    found = PLC.nearest_city(view(spark, d, "points"), cities, keep=("country_code", "area"))
    return found.select("id", "city", "country_code", "area", "distance_km")


@query("x6_clean_queries", "select id, trim(regexp_replace(regexp_replace('a:\"b\" (' || name || ')*  ^c', '[\":*^(){}\\[\\]\\\\]', ' ', 'g'), '\\s+', ' ', 'g')) as query from names", ("names",))
def x6(spark, d):
    return view(spark, d, "names").select("id", ST.clean_query(F.concat(F.lit('a:"b" ('), F.col("name"), F.lit(")*  ^c"))).alias("query"))


@query("x20_location_precedence", "select id, case when id % 4 = 0 then 'gps' when id % 2 = 1 then 'path_llm' when id % 3 = 0 then 'ai_vision' end as source from names", ("names",))
def x20(spark, d):
    i = F.col("id")
    candidate = lambda source, some: F.struct(F.lit(source).alias("source"), F.when(some, "x").otherwise(" ").alias("value"))
    found = S.first_by_rank(F.array(candidate("ai_vision", i % 3 == 0), candidate("path_llm", i % 2 == 1), candidate("gps", i % 4 == 0)), ("gps", "embedded_xmp", "path_llm", "path_script", "ai_vision"))
    return view(spark, d, "names").select("id", found["source"].alias("source"))


VIEWS["sites"] = "select page_id as id, url, regexp_replace(regexp_replace(url, '^[a-z]+:/', ''), '[?#].*$', '') as folder from pages"
VIEWS["scopes"] = "select distinct folder as scope, id % 2 = 0 as recursive from sites where id % 5 = 0 union select distinct regexp_replace(folder, '/[0-9]+[^/]*/?$', '') as scope, true as recursive from sites where id % 4 = 1"


@query("p37_covered_folders", "s as (select rtrim(scope, '/') as s, min(scope) as scope, bool_or(recursive) as recursive from scopes group by 1), m as (select sites.id, arg_max(s.scope, length(s.s)) as scope from sites join s on rtrim(folder, '/') = s.s or (recursive and starts_with(folder, s.s || '/')) group by sites.id) select sites.id, folder, m.scope from sites left join m on m.id = sites.id", ("sites", "scopes"))
def p37(spark, d):
    """Folders of pages and the innermost scope of a job that covers each; hosts and every fifth page's own folder are scopes."""
    return CAT.innermost_scope(view(spark, d, "sites").select("id", "folder"), view(spark, d, "scopes")).select("id", "folder", "scope")


@query("p36_amount_warnings", "select id, case when abs(total * 24 / 124 - vat) <= greatest(0.02, abs(total) * 1e-4) or abs(total * 24 / 100 - vat) <= greatest(0.02, abs(total) * 1e-4) or (total - vat > greatest(0.02, abs(total) * 1e-4) and abs(100 * vat / (total - vat) - 24) <= 0.35) or abs(total * 24 / 100 - vat) / greatest(abs(total * 24 / 100), abs(vat), 1e-9) <= 0.1 or abs(total * 24 / 124 - vat) / greatest(abs(total * 24 / 124), abs(vat), 1e-9) <= 0.1 then false else true end as mismatch from (select id, total, vat * (1 + (id % 4) / 10.0) as vat from bills)", ("bills",))
def p36w(spark, d):
    b = view(spark, d, "bills").withColumn("vat", F.col("vat") * (1 + (F.col("id") % 4) / 10.0))
    return b.select("id", S.vat_mismatch(F.col("total"), F.col("vat_percent"), F.col("vat")).alias("mismatch"))
