"""Search, people, albums, coverage, snapshots and bills: registered queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import balls as B
from ..operators import catalogue as C
from ..operators import digests as DIG
from ..operators import geometry as G
from ..operators import search as Q
from ..operators.store import fresh_path, once
from ..operators.textindex import TextIndex
from ..streaming import logs, timers
from .registry import LEAN, VIEWS, query, table, view

VIEWS |= {
    "items": ("select doc_id as id, 'L' as library_id, '/lib/' || source || '/' || lang || '/IMG_' || cast(doc_id as string) || '.jpg' as source_path, lang as country, source as city, "
        "case when doc_id % 3 = 0 then null else 'area' || cast(doc_id % 4 as string) end as area, n_chars as byte_size, "
        "case when doc_id % 7 = 0 then null else doc_id % 7 - 1 end as star_rating, case when doc_id % 5 = 0 then null else doc_id % 11 end as ai_quality, "
        "cast(2010 + doc_id % 15 as string) || '-' || lpad(cast(1 + doc_id % 12 as string), 2, '0') as taken, "
        "case when doc_id % 17 = 0 then '2026-01-' || lpad(cast(1 + doc_id % 28 as string), 2, '0') end as deleted_at, "
        "case when doc_id % 4 = 0 then null else '2026-02-0' || cast(1 + doc_id % 9 as string) end as processed_at, case when doc_id % 6 = 0 then '2026-02-05' end as failed_at, "
        "doc_id % 6 as people, case when doc_id % 8 = 0 then 'invoice_or_receipt' when doc_id % 8 = 1 then 'Screenshot phone' else 'nature' end as category, md5(text) as strong_hash, text from documents"
    ),
    "faces": ("select vec_id as id, vec_id % 200 as item_id, case when vec_id % 2 = 0 then label end as tag_id, label as cluster_id, 0.5 + (vec_id % 50) / 100.0 as confidence, embedding from embeddings"),
    "members": ("select l_orderkey as album_id, l_partkey as item_id, case when l_linenumber % 3 = 0 then null else l_linenumber end as position from lineitem"),
    "files": ("select doc_id as id, '/lib/' || source || '/' || lang || '/' || cast(doc_id % 50 as string) || '.JPG' as path, n_chars as size, doc_id % 3 as mtime, md5(text) as strong_hash from documents"),
    "disk": ("select '/lib/' || source || '/' || case when doc_id % 9 = 0 then 'new' else lang end || '/' || case when doc_id % 10 = 0 then 'fresh_' else '' end || cast(doc_id as string) || '.jpg' as path, n_chars + case when doc_id % 7 = 0 then 1 else 0 end as size, doc_id % 3 as mtime from documents"),
    "known": ("select '/lib/' || source || '/' || lang || '/' || case when doc_id % 10 = 1 then 'gone_' else '' end || cast(doc_id as string) || '.jpg' as path, n_chars as size, doc_id % 3 as mtime, case when doc_id % 11 = 0 then '2025-12-01' end as deleted_at from documents"),
    "boxes": ("select l_orderkey as image, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as id, cast(l_partkey % 40 as double) as x1, cast(l_suppkey % 40 as double) as y1, cast(l_partkey % 40 + 10 + l_linenumber as double) as x2, cast(l_suppkey % 40 + 20 as double) as y2, cast(l_discount as double) as score from lineitem"),
    "bills": ("select o_orderkey as id, c_name as issuer, cast(o_orderdate as string) as day, cast(o_totalprice as double) as total, case when o_orderkey % 4 = 0 then null when o_orderkey % 3 = 0 then 'CHF' else 'EUR' end as currency, 24.0 as vat_percent, round(cast(o_totalprice as double) * 24 / 124, 2) + (o_orderkey % 5) / 20.0 as vat from orders join customer on o_custkey = c_custkey"),
}

#: What is computed beside a window function is shuffled with it, so boxes are numbered first: one shuffle that all readers share.
LEAN["boxes"] = """select l_orderkey as image, id, cast(l_partkey % 40 as double) as x1, cast(l_suppkey % 40 as double) as y1, cast(l_partkey % 40 + 10 + l_linenumber as double) as x2, cast(l_suppkey % 40 + 20 as double) as y2, cast(l_discount as double) as score
from (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) as id from lineitem)"""


# ------------------------------------------------------------------ vectors, faces, people


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def cells(spark, d) -> B.Cells:
    """The vectors in cells, built once in an application."""
    return once(table(spark, d, "embeddings"), f"cells {d}", lambda: B.cells_of(_vectors(spark, d)))


@query("v4_nearest_vectors", "select vec_id as id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as similarity from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) desc, vec_id limit 25")
def v4(spark, d):
    return B.search(cells(spark, d), Q.vector_of(_vectors(spark, d), 0), 25)[0].select("id", F.round("similarity", 6).alias("similarity"))


@query("v1_search_by_vector", "select id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)), 6) as similarity from items join embeddings on vec_id = id where deleted_at is null and lower(country) = 'en' and people between 1 and 4 and taken >= '2012' order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 1)) desc, id limit 30", ("items",))
def v1(spark, d):
    items = C.active(view(spark, d, "items"), "L").where((F.lower("country") == "en") & F.col("people").between(1, 4) & (F.col("taken") >= "2012"))
    return B.search(cells(spark, d), Q.vector_of(_vectors(spark, d), 1), 30, allowed=items.select("id"))[0].select("id", F.round("similarity", 6).alias("similarity"))


@query("v5_similar_faces", "select id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 2)), 6) as similarity from faces where tag_id is null and list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 2)) >= 0.2", ("faces",))
def v5(spark, d):
    untagged = view(spark, d, "faces").where("tag_id is null").select("id")
    return B.search(cells(spark, d), Q.vector_of(_vectors(spark, d), 2), 0, 0.2, allowed=untagged)[0].select("id", F.round("similarity", 6).alias("similarity"))


CENTROIDS = """e as (select tag_id, unnest(embedding::double[]) as x, unnest(range(len(embedding))) as pos from faces where tag_id is not null),
m as (select tag_id, pos, avg(x) as x, count(*) as n from e group by all),
c as (select tag_id, max(n) as n, list(x order by pos) as v from m group by tag_id),
people as (select tag_id, n, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as centroid from c)"""


@query("a14_person_centroids", f"{CENTROIDS} select tag_id, n, pos, round(x, 6) as x from (select tag_id, n, unnest(range(len(centroid))) as pos, unnest(centroid) as x from people)", ("faces",))
def a14(spark, d):
    c = Q.centroids(view(spark, d, "faces"))
    return c.select("tag_id", "n", F.posexplode("centroid").alias("pos", "x")).select("tag_id", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


MATCH = f"{CENTROIDS}, p as (select id, item_id, people.tag_id, list_cosine_similarity(embedding::double[], centroid) as similarity from faces, people where faces.tag_id is null)"


@query("v6_matches_for_person", f"{MATCH} select id, tag_id, round(similarity, 6) as similarity from p where tag_id = 3 and similarity >= 0.1", ("faces",))
def v6(spark, d):
    f = view(spark, d, "faces")
    return Q.matches(f, Q.centroids(f.where("tag_id = 3")), 0.1).select("id", "tag_id", F.round("similarity", 6).alias("similarity"))


@query("v8_suggestions", f"{MATCH}, r as (select *, row_number() over (partition by item_id, tag_id order by round(similarity, 9) desc, id) as k from p where similarity >= 0.1) select item_id, tag_id, id as face_id, round(similarity, 6) as similarity from r where k = 1", ("faces",))
def v8(spark, d):
    f = view(spark, d, "faces")
    m = Q.matches(f, Q.centroids(f), 0.1).withColumn("similarity", F.round("similarity", 9)).join(f.select("id", "item_id"), "id")
    best = Q.best_per(m.withColumn("key", F.struct("item_id", "tag_id")).drop("item_id", "tag_id"), "key", "similarity", "id")
    return best.select("key.item_id", "key.tag_id", F.col("id").alias("face_id"), F.round("similarity", 6).alias("similarity"))


@query("a16_similarity_bands", f"{CENTROIDS}, s as (select cluster_id, list_cosine_similarity(embedding::double[], (select centroid from people where tag_id = 1)) as s from faces) select cluster_id, count(*) as members, count(*) filter (s >= 0.2) as matching, count(*) filter (s >= 0.1 and s < 0.2) as mid, count(*) filter (s < 0.1) as below from s group by cluster_id", ("faces",))
def a16(spark, d):
    f = view(spark, d, "faces")
    centroid = list(Q.centroids(f.where("tag_id = 1")).first()["centroid"])
    s = f.select("cluster_id", V.cosine(F.col("embedding"), V.literal(centroid)).alias("s"))
    return s.groupBy("cluster_id").agg(F.count("*").alias("members"), F.count_if(F.col("s") >= 0.2).alias("matching"), F.count_if((F.col("s") >= 0.1) & (F.col("s") < 0.2)).alias("mid"), F.count_if(F.col("s") < 0.1).alias("below"))


@query("j18_similar_pairs", "select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.35")
def j18(spark, d):
    return B.joined(cells(spark, d), cells(spark, d), 0.35, upper=True)[0].select("a", "b")


@query("w1_representatives", "select cluster_id, id, k from (select cluster_id, id, row_number() over (partition by cluster_id order by confidence desc nulls last, id) as k from faces) where k <= 64", ("faces",))
def w1(spark, d):
    k = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc_nulls_last("confidence"), "id"))
    return view(spark, d, "faces").select("cluster_id", "id", k.cast("long").alias("k")).where("k <= 64")


# ------------------------------------------------------------------ text search and fusion

#: DuckDB: the terms of a text, see ``stems.terms_of``.
_terms = lambda c: f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
TERMS = _terms("text")
BM25 = f"""d as (select doc_id as id, {TERMS} as t from documents),
st as (select count(*) as n, avg(len(t)) as al from d),
tf as (select id, len(t) as l, x as term, count(*) as f from (select id, t, unnest(t) as x from d) where x in ('the', 'license', 'version') group by all),
df as (select term, count(*) as df from tf group by term),
kw as (select id, count(*) as n_terms, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))) as score from tf join df using (term), st group by id)"""
WORDS = ["the", "license", "version"]


def _index(spark, d) -> TextIndex:
    """The text index of the documents, built once in an application."""

    def make() -> TextIndex:
        index = TextIndex(spark, fresh_path(spark, "text"), ("text",))
        index.upsert(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
        return index

    return once(table(spark, d, "documents"), f"text {d}", make)


@query("v9_keyword_search", f"{BM25} select id, round(score, 6) as score from kw")
def v9(spark, d):
    return _index(spark, d).search(WORDS, 0)[0].select("id", F.round("score", 6).alias("score"))


@query("v9_all_keywords", f"{BM25} select id, round(score, 6) as score from kw where n_terms = 3")
def v9_all(spark, d):
    return _index(spark, d).search(WORDS, 0, every=True)[0].select("id", F.round("score", 6).alias("score"))


#: The five fields of an item's caption, from its columns.
VIEWS["captions"] = (
    "select id, library_id, source_path, city, country, people, taken, deleted_at, substr(text, 1, 80) as title, text as description, city || ', ' || country as location, coalesce(category, '') as category, "
    "case when star_rating is null then '' when star_rating = -1 then 'file_rating_rejected' when star_rating = 0 then 'file_rating_unrated' else 'file_rating_' || cast(star_rating as string) end as rating from items"
)
FIELDS = ("title", "description", "location", "category", "rating")


def _bm25(source: str, words: list[str]) -> str:
    """DuckDB: ``kw(id, score, n_terms)``, BM25 over the five fields of a table of captions."""
    whole = "list_concat(" * 4 + _terms("title") + "".join(f", {_terms(c)})" for c in FIELDS[1:])
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""dt as (select id, {whole} as t from {source}), st as (select count(*) as n, avg(len(t)) as al from dt),
tf as (select id, len(t) as l, x as term, count(*) as f from (select id, t, unnest(t) as x from dt) where x in ({listed}) group by all),
df as (select term, count(*) as df from tf group by term),
kw as (select id, count(*) as n_terms, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / al))), 12) as score from tf join df using (term), st group by id)"""


def captions_index(spark, d) -> TextIndex:
    """The index of all captions, built once in an application."""

    def make() -> TextIndex:
        index = TextIndex(spark, fresh_path(spark, "captions"), FIELDS)
        index.upsert(view(spark, d, "captions"))
        return index

    return once(table(spark, d, "documents"), f"captions {d}", make)


@query("v9_keyword_page", f"{_bm25('captions', ['license', 'version', 'nature', '4', 'the'])}, ok as (select c.id, c.source_path, c.city, c.country, c.people from captions c where c.library_id = 'L' and c.deleted_at is null and starts_with(c.source_path, '/lib/src1/') and c.taken between '2012' and '2022-12' and c.country like '%e%' and (c.id in (select item_id from faces where tag_id = 2) or c.id in (select item_id from faces where tag_id is null and cluster_id = 3) or c.people >= 2)) select ok.id, source_path, city, country, people, round(score, 6) as score from ok join kw on kw.id = ok.id order by kw.score desc, ok.id limit 100", ("items", "captions", "faces"))
def v9_page(spark, d):
    """Keyword search as the catalogue asks it: five fields, filters for library, folder, dates, place and people, a limit."""
    c, f = view(spark, d, "captions"), view(spark, d, "faces")
    c = C.active(c, "L").where(P.in_folder(F.col("source_path"), "/lib/src1", True) & F.col("taken").between("2012", "2022-12") & F.col("country").contains("e"))
    with_person = f.where("tag_id = 2 or (tag_id is null and cluster_id = 3)").select(F.col("item_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
    c = c.join(with_person, "id", "left").where("tagged or people >= 2")
    found, _ = captions_index(spark, d).search(["license", "version", "nature", "4", "the"], 100, allowed=c.select("id"))
    return found.join(c.select("id", "source_path", "city", "country", "people"), "id").select("id", "source_path", "city", "country", "people", F.round("score", 6).alias("score"))


@query("k10_index_upkeep", f"now as (select id, case when id % 5 = 0 then 'renamed version ' || title else title end as title, description, location, category, rating from captions where id % 7 <> 0 or id % 5 = 0), {_bm25('now', ['license', 'version', 'renamed'])} select id, round(score, 6) as score from kw", ("items", "captions"))
def k10(spark, d):
    """An index after a first load, changed and new captions, deletions and a merge: what a rebuild of the last state gives."""

    def make() -> TextIndex:
        c = view(spark, d, "captions").select("id", *FIELDS)
        index = TextIndex(spark, fresh_path(spark, "upkeep"), FIELDS)
        index.upsert(c.where("id % 3 <> 0"))
        index.upsert(c.where("id % 3 = 0"))
        index.delete(c.where("id % 7 = 0").select("id"))
        index.upsert(c.where("id % 5 = 0").withColumn("title", F.concat(F.lit("renamed version "), "title")))
        index.merge()
        return index

    index = once(table(spark, d, "documents"), f"upkeep {d}", make)
    return index.search(["license", "version", "renamed"], 0)[0].select("id", F.round("score", 6).alias("score"))


HYBRID = f"""{BM25}, vs as (select vec_id as id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 5)) as s from embeddings),
a as (select id, row_number() over (order by round(score, 9) desc, id) as rank from kw), b as (select id, row_number() over (order by round(s, 9) desc, id) as rank from vs),
f as (select id, sum(1.0::double / (60 + rank)) as score from (select * from a where rank <= 100 union all select * from b where rank <= 100) group by id)"""


def _fused(spark, d) -> DataFrame:
    kw = _index(spark, d).search(WORDS, 150)[0].withColumn("score", F.round("score", 9))  # more than are ranked, as ranks go by rounded scores
    vs = B.search(cells(spark, d), Q.vector_of(_vectors(spark, d), 5), 150)[0].withColumn("score", F.round("similarity", 9))
    return Q.fuse([Q.ranked(kw, "score", 100), Q.ranked(vs, "score", 100)], limit=1_000_000)


@query("v10_rank_fusion", f"{HYBRID} select id, round(score, 9) as score from f")
def v10(spark, d):
    return _fused(spark, d).select("id", F.round("score", 9).alias("score"))


HITS = "(select f.id, count(*) filter (c is not null) as hits, sum(coalesce(c, 0)) / 3 as coverage from (select f.id, case when s >= 0.15 then s end as c from (select f.id, list_cosine_similarity(x.embedding::double[], k.embedding::double[]) as s from f join embeddings x on x.vec_id = f.id, (select embedding from embeddings where vec_id in (7, 8, 9)) k) f) f group by f.id)"


@query("v11_keyword_rerank", f"{HYBRID} select f.id, round(f.score, 9) as score, coalesce(hits, 0) as hits, round(coalesce(coverage, 0), 6) as coverage from f left join {HITS} h on h.id = f.id")
def v11(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    keywords = [list(r[0]) for r in e.where("id in (7, 8, 9)").select("embedding").collect()]
    return Q.keyword_rerank(_fused(spark, d), e, keywords, 0.15).select("id", F.round("score", 9).alias("score"), "hits", F.round("coverage", 6).alias("coverage"))


# ------------------------------------------------------------------ coverage, folders, places, albums

DONE = "processed_at is not null and not (failed_at is not null and failed_at > processed_at)"
FAILED = "failed_at is not null and (processed_at is null or failed_at > processed_at)"


@query("a2_folder_coverage", f"t as (select city as folder, count(*) as total, count(*) filter ({DONE}) as done, count(*) filter ({FAILED}) as failed from items where deleted_at is null group by city) select *, case when total = 0 then 'empty' when done + failed >= total then 'done' when done + failed = 0 then 'not_done' else 'partial' end as label from t", ("items",))
def a2(spark, d):
    return C.coverage(C.active(view(spark, d, "items"), "L"), ["city"]).withColumnRenamed("city", "folder")


@query("a3_folder_rollup", "p as (select unnest(['', '/lib', '/lib/' || city, '/lib/' || city || '/' || country]) as folder, byte_size from items) select folder, count(*) as items, cast(sum(byte_size) as bigint) as bytes from p group by folder", ("items",))
def a3(spark, d):
    return C.folder_rollup(view(spark, d, "items"))


@query("a18_direct_children", "select f.folder, count(i.id) as items from (select distinct '/LIB/' || city || '/en' as folder from items) f left join items i on lower('/lib/' || i.city || '/' || i.country) = lower(f.folder) group by f.folder", ("items",))
def a18(spark, d):
    items = view(spark, d, "items")
    return C.direct_children(items, items.select(F.concat(F.lit("/LIB/"), "city", F.lit("/en")).alias("folder")).distinct())


@query("p2_folder_scope", "select id, source_path from items where starts_with(lower(source_path), '/lib/src3/') and instr(substr(source_path, 11), '/') > 0", ("items",))
def p2(spark, d):
    i = view(spark, d, "items")
    return i.where(P.in_folder(F.col("source_path"), "/lib/SRC3", True) & ~P.in_folder(F.col("source_path"), "/lib/src3", False)).select("id", "source_path")


@query("a8_top_tags", "select tag_id, count(*) as faces from faces where tag_id is not null group by tag_id order by faces desc, tag_id limit 5", ("faces",))
def a8(spark, d):
    return view(spark, d, "faces").where("tag_id is not null").groupBy("tag_id").agg(F.count("*").alias("faces")).orderBy(F.desc("faces"), "tag_id").limit(5)


@query("a12_albums", "select album_id, count(distinct item_id) as items, max(case when id is not null and deleted_at is null then taken end) as newest, arg_min(id, (coalesce(position, 2147483647), id)) filter (id is not null and deleted_at is null) as cover from members left join items on id = item_id group by album_id", ("members", "items"))
def a12(spark, d):
    return C.albums(view(spark, d, "members"), view(spark, d, "items"))


@query("a17_place_tree", "select country, city, area, count(*) as items, cast(grouping(country, city, area) as bigint) as level from items group by rollup (country, city, area)", ("items",))
def a17(spark, d):
    return C.place_tree(view(spark, d, "items"), ["country", "city", "area"])


@query("l2_smart_album_page", "select id, star_rating, ai_quality, taken from items where deleted_at is null and (star_rating >= 3 or ai_quality >= 6) order by coalesce(star_rating, -1) desc, coalesce(ai_quality, -1) desc, taken desc nulls last, lower(source_path), id limit 48 offset 48", ("items",))
def l2(spark, d):
    i = C.active(view(spark, d, "items"), "L").where("star_rating >= 3 or ai_quality >= 6")
    return C.page(i, C.quality_order(), 48, 48).select("id", "star_rating", "ai_quality", "taken")


@query("l4_seeded_shuffle", "select id, sha256('4242' || chr(0) || cast(id as string)) as shuffle_key from items order by shuffle_key limit 48", ("items",))
def l4(spark, d):
    return C.shuffled(view(spark, d, "items"), 4242).select("id", "shuffle_key").orderBy("shuffle_key").limit(48)


@query("p7_date_overlap", "select id, taken from items where taken is not null and taken >= '2015' and taken <= '2018-06'", ("items",))
def p7(spark, d):
    return view(spark, d, "items").where(S.dates_overlap(F.col("taken"), F.lit(None).cast("string"), "2015", "2018-06")).select("id", "taken")


@query("j6_items_with_all_tags", "t as (select item_id, count(distinct tag_id) as n from faces where tag_id in (1, 2) group by item_id) select id from items where id in (select item_id from t where n = 2)", ("items", "faces"))
def j6(spark, d):
    return C.in_all(view(spark, d, "items"), view(spark, d, "faces"), [1, 2]).select("id")


@query("j10_without_embedding", "select id from items where id not in (select vec_id from embeddings)", ("items",))
def j10(spark, d):
    return view(spark, d, "items").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti").select("id")


# ------------------------------------------------------------------ duplicates, snapshots, writes


@query("a21_duplicate_groups", "select id, 'dup:' || strong_hash as \"group\", n as members from (select *, count(*) over (partition by strong_hash) as n from files where strong_hash is not null) where n > 1", ("files",))
def a21(spark, d):
    return C.duplicates(view(spark, d, "files")).select("id", "group", "members")


@query("a22_weak_duplicates", "select lower(regexp_extract(path, '([^/]*)$', 1)) as name, size, mtime, count(*) as files, min(id) as first_id from files group by 1, 2, 3 having count(*) > 1", ("files",))
def a22(spark, d):
    return C.weak_duplicates(view(spark, d, "files"))


@query("a24_duplicate_folders", "t as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder from files where strong_hash is not null), g as (select strong_hash, count(*) as n, count(distinct folder) as folders from t group by 1) select folder, count(*) as files, cast(sum(size) as bigint) as bytes, count(*) filter (folders > 1) as elsewhere from t join g using (strong_hash) where n > 1 group by folder", ("files",))
def a24(spark, d):
    return C.duplicate_folders(view(spark, d, "files"))


@query("c1_snapshot_diff", "select path, case when k.path is null then 'new' when a.path is null then 'deleted' when a.size <> k.size or a.mtime <> k.mtime then 'modified' else 'same' end as state, a.size as size_a, k.size as size_b from disk a full join known k using (path)", ("disk", "known"))
def c1(spark, d):
    return C.snapshot_diff(view(spark, d, "disk"), view(spark, d, "known"))


_up = "unnest(list_concat([''], list_transform(range(2, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[:n], '/')))) as folder"


@query("c1_changes", "select * from (select path, case when k.path is null then 'new' when a.path is null then 'deleted' when a.size <> k.size or a.mtime <> k.mtime then 'modified' else 'same' end as state, a.size as size_a, k.size as size_b from disk a full join known k using (path)) where state <> 'same'", ("disk", "known"))
def c1_changes(spark, d):
    disk, known = view(spark, d, "disk"), view(spark, d, "known")
    return DIG.changes(disk, known, DIG.folder_digests(disk), DIG.folder_digests(known))


@query("c1_folders_visited", f"a as (select folder, string_agg(path || ' ' || size || ' ' || mtime, ',' order by path) as g from (select *, {_up} from disk) group by 1), b as (select folder, string_agg(path || ' ' || size || ' ' || mtime, ',' order by path) as g from (select *, {_up} from known) group by 1), x as (select folder, a.g is distinct from b.g as differs from a full join b using (folder)) select folder from x where folder = '' or case when contains(folder, '/') then regexp_extract(folder, '^(.*)/[^/]*$', 1) else '' end in (select folder from x where differs)", ("disk", "known"))
def c1_visited(spark, d):
    return DIG.visited(DIG.folder_digests(view(spark, d, "disk")), DIG.folder_digests(view(spark, d, "known")))


@query("c2_moves", "o as (select path, size, lower(regexp_extract(path, '([^/]*)$', 1)) as name from known where path not in (select path from disk)), n as (select path, size, lower(regexp_extract(path, '([^/]*)$', 1)) as name from disk where path not in (select path from known)), o2 as (select *, row_number() over (partition by name, size order by path) as k from o), n2 as (select *, row_number() over (partition by name, size order by path) as k from n) select o2.path as old_path, n2.path as new_path, o2.size as size from o2 join n2 using (name, size, k)", ("disk", "known"))
def c2(spark, d):
    disk, known = view(spark, d, "disk"), view(spark, d, "known")
    return C.moves(known.join(disk, "path", "left_anti"), disk.join(known, "path", "left_anti"))


@query("c3_reconcile", "select path, case when path in (select path from disk) then null else coalesce(deleted_at, '2026-03-01') end as deleted_at, case when path in (select path from disk) and deleted_at is not null then 'restored' when path not in (select path from disk) and deleted_at is null then 'deleted' else 'kept' end as action from known", ("disk", "known"))
def c3(spark, d):
    return C.reconcile(view(spark, d, "known"), view(spark, d, "disk"), "2026-03-01")


@query("k1_upsert", "select doc_id, lang, n_chars + case when doc_id % 5 = 0 then 1000 else 0 end as n_chars from documents")
def k1(spark, d):
    base = table(spark, d, "documents").select("doc_id", "lang", "n_chars").withColumn("seq", F.lit(0))
    delta = base.where("doc_id % 5 = 0").select("doc_id", "lang", (F.col("n_chars") + 1000).alias("n_chars"), F.lit(1).alias("seq"))
    return C.upsert(base, delta, ["doc_id"], "seq").drop("seq")


@query("k19_purge", "select item_id, count(*) as faces from faces where item_id in (select id from items where deleted_at is null or deleted_at >= '2026-01-10') group by item_id", ("items", "faces"))
def k19(spark, d):
    stay = C.purge(view(spark, d, "items"), "2026-01-10")
    faces = view(spark, d, "faces")
    return faces.join(C.orphans(faces, stay, "item_id").select("id"), "id", "left_anti").groupBy("item_id").agg(F.count("*").alias("faces"))


# ------------------------------------------------------------------ bills, dates, boxes, events


@query("p26_bills_page", "select id, issuer, day, total, currency from bills where lower(issuer) like '%customer#00000%' and day >= '1995' and total between 1000 and 200000 and upper(trim(currency)) = 'EUR' order by case when day is null or day = '' then 1 else 0 end, day desc, id limit 100", ("bills",))
def p26(spark, d):
    b = view(spark, d, "bills").where(P.contains(F.col("issuer"), "customer#00000") & (F.col("day") >= "1995") & F.col("total").between(1000, 200000) & S.same_currency(F.col("currency"), "eur"))
    return C.page(b, [F.when(S.not_blank(F.col("day")).isNull(), 1).otherwise(0), F.desc("day"), F.col("id")], 100).select("id", "issuer", "day", "total", "currency")


@query("x25_ages", "select id, case when '2024-06-15' >= day then cast(2024 - cast(substr(day, 1, 4) as int) - case when '06-15' < substr(day, 6, 5) then 1 else 0 end as int) end as age from bills", ("bills",))
def x25(spark, d):
    return view(spark, d, "bills").select("id", S.age_at(F.col("day"), F.lit("2024-06-15")).alias("age"))


@query("x27_stars", "select id, cast(ceil(greatest(1.0, least(10.0, ai_quality)) / 2) as int) as stars from items where ai_quality is not null", ("items",))
def x27(spark, d):
    return view(spark, d, "items").where("ai_quality is not null").select("id", S.stars_of_quality(F.col("ai_quality")).alias("stars"))


@query("g1_box_overlap", "select a.image, a.id as a, b.id as b, round(w * h / (aa + ba - w * h), 6) as iou from (select a.image, a.id, b.id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) as w, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as h, (a.x2 - a.x1) * (a.y2 - a.y1) as aa, (b.x2 - b.x1) * (b.y2 - b.y1) as ba, a, b from boxes a join boxes b on a.image = b.image and a.id < b.id) where w * h > 0", ("boxes",))
def g1(spark, d):
    b = view(spark, d, "boxes").select("image", "id", G._box().alias("box"))
    two = b.select("image", F.col("id").alias("a"), F.col("box").alias("ba")).join(b.select("image", F.col("id").alias("b"), F.col("box").alias("bb")), "image").where("a < b")
    return two.select("image", "a", "b", F.round(S.iou(F.col("ba"), F.col("bb")), 6).alias("iou")).where("iou > 0")


@query("t7_sliding_mean", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 14 preceding and current row), 6) as mean from events")
def t7(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-14, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"))


@query("t4_hourly_events", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) as events, round(sum(value), 4) as value from events group by all")
def t4(spark, d):
    return logs.hourly(table(spark, d, "events")).select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


def _timed(spark, d, processor, what) -> DataFrame:
    """What the timers of a stream over the events give, from where the stream wrote it."""
    events = table(spark, d, "events")
    log = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")  # a file or a folder of files
    out = fresh_path(spark, "timed")
    timers.played(timers.timed(log, processor, what), out, f"{out}-state")
    return spark.read.schema("key long, what string, at timestamp").parquet(out).select(F.col("key").alias("user_id"), "what", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("at"))


@query("t3_appended_log", "select distinct event_id as operation_id, event_type, 'pending' as state from events")
def t3(spark, d):
    """The events, each twice in the stream, as an append-only log."""
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").select(F.col("event_id").alias("operation_id"), "ts", "event_type")
    out = fresh_path(spark, "log")
    logs.append_log(stream.unionByName(stream), out, f"{out}-state")
    return spark.read.schema("operation_id long, event_type string, state string").parquet(out)


#: Events below the last watermark, one hour behind the latest event, in whole milliseconds.
_passed = "e as (select user_id, event_id, event_type, epoch_us(ts) // 1000 as ms, max(epoch_us(ts) // 1000) over () - 3600000 as horizon from events), w as (select * from e where ms < horizon)"
_some = "from events where event_type in ('error', 'signup'))"  # a watermark follows the events that take part
_moment = "strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') as at"


@query("t6_deletion_windows", f"{_passed.replace('from events)', _some)}, d as (select *, case when event_type = 'error' then 'deleted' else 'seen' end as what from w where event_type in ('error', 'signup')), o as (select *, lag(what) over (partition by user_id order by ms, event_id) as before, min(case when what = 'seen' then ms end) over (partition by user_id order by ms, event_id rows between 1 following and unbounded following) as seen from d), x as (select * from o where what = 'deleted' and (before is null or before = 'seen')), a as (select user_id, 'forgotten' as what, ms + 86400000 as ms from x where (seen is null or seen > ms + 86400000) and ms + 86400000 < horizon union all select user_id, 'purged', ms + 432000000 from x where (seen is null or seen > ms + 432000000) and ms + 432000000 < horizon union all select user_id, 'restored', seen from x where seen <= ms + 432000000) select user_id, what, {_moment} from a")
def t6(spark, d):
    what = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "seen")
    return _timed(spark, d, timers.Tombstones(keep=timers.DAY, grace=5 * timers.DAY), what)


@query("t4_job_timeouts", f"{_passed}, n as (select *, lead(ms) over (partition by user_id order by ms, event_id) as next from w), a as (select user_id, event_type as what, ms from n where event_type in ('purchase', 'error') union all select user_id, 'timed out', ms + 43200000 from n where event_type not in ('purchase', 'error') and (next is null or next > ms + 43200000) and ms + 43200000 < horizon) select user_id, what, {_moment} from a")
def t4_jobs(spark, d):
    return _timed(spark, d, timers.Jobs(timeout=12 * timers.HOUR, ends=("purchase", "error")), F.col("event_type"))


@query("x2_json_values", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def x2(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("a1_distinct_usage", "select count(*) as items, count(distinct city) as cities, count(distinct strong_hash) as texts from items", ("items",))
def a1(spark, d):
    return view(spark, d, "items").agg(F.count("*").alias("items"), F.countDistinct("city").alias("cities"), F.countDistinct("strong_hash").alias("texts"))
