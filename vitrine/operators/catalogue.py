"""Operators over catalogue tables: scopes, upserts, albums, coverage, duplicates, snapshots. All lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S


def active(items: DataFrame, library: str) -> DataFrame:
    return items.where((F.col("library_id") == library) & F.col("deleted_at").isNull())


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``base`` with the rows of ``delta`` put in by key; of several the one of the largest ``order`` stays."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order)))
    both = base.withColumn("__new", F.lit(0)).unionByName(delta.withColumn("__new", F.lit(1)))
    return both.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__new")


def page(df: DataFrame, order: list[Column], limit: int = 48, offset: int = 0, most: int = 200) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def quality_order() -> list[Column]:
    return [F.coalesce("star_rating", F.lit(-1)).desc(), F.coalesce("ai_quality", F.lit(-1)).desc(), F.desc_nulls_last("taken"), F.lower("source_path").asc(), F.asc("id")]


def shuffled(df: DataFrame, seed: int, id_: str = "id") -> DataFrame:
    return df.withColumn("shuffle_key", F.sha2(F.concat(F.lit(str(seed)), F.lit("\0"), F.col(id_).cast("string")), 256))


def coverage(items: DataFrame, by: list[str]) -> DataFrame:
    """Counts of processed and failed items in one pass; a failure counts only if it is later than the success."""
    failed = F.col("failed_at").isNotNull() & (F.col("processed_at").isNull() | (F.col("failed_at") > F.col("processed_at")))
    done = F.col("processed_at").isNotNull() & ~failed
    g = items.groupBy(*by) if by else items.groupBy()
    out = g.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"))
    return out.withColumn("label", S.coverage_label(F.col("done"), F.col("failed"), F.col("total")))


def folder_rollup(items: DataFrame, path: str = "source_path") -> DataFrame:
    """Items and bytes below every folder: each path counts for all its ancestors (an equi-group, no prefix join)."""
    return items.select(F.explode(P.ancestors(F.col(path))).alias("folder"), "byte_size").groupBy("folder").agg(F.count("*").alias("items"), F.sum("byte_size").alias("bytes"))


def innermost_scope(folders: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows of ``folders(folder)`` with the innermost of the ``scopes(scope, recursive)`` that covers it, else null: the scope that is the
    folder itself, or the nearest recursive one above it (separators and, on Windows, letters' case don't matter; blank ones
    cover nothing). Each folder meets the scopes by its ancestors, an equi-join however many scopes there are."""
    s = scopes.select(P.match_form(F.col("scope")).alias("__at"), "recursive", "scope").where("__at <> ''")
    s = s.groupBy("__at").agg(F.min("scope").alias("scope"), F.max("recursive").alias("recursive"))
    f = folders.select("folder").distinct().withColumn("__own", P.match_form(F.col("folder"))).where("__own <> ''")
    up = f.select("folder", "__own", F.explode(P.ancestors(F.concat("__own", F.lit("/x")))).alias("__at")).where("__at <> ''")
    met = up.join(s, "__at").where("recursive or __at = __own").groupBy("folder").agg(F.max_by("scope", F.length("__at")).alias("scope"))
    return folders.join(met, "folder", "left")


def direct_children(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Number of items directly in each requested folder, zero where none; letters match in either case."""
    counts = items.groupBy(F.lower(P.parent(P.comparable(F.col("source_path")))).alias("key")).agg(F.count("*").alias("n"))
    return folders.join(counts, F.lower("folder") == F.col("key"), "left").select("folder", F.coalesce("n", F.lit(0)).alias("items"))


def place_tree(items: DataFrame, levels: list[str]) -> DataFrame:
    return items.rollup(*levels).agg(F.count("*").alias("items"), F.grouping_id().alias("level"))


def albums(members: DataFrame, items: DataFrame) -> DataFrame:
    """Albums with the number of members, the newest date and the cover: the best placed active member."""
    own = members.select("album_id", "item_id", F.coalesce("position", F.lit(2147483647)).alias("place"))
    before = F.lag("item_id").over(W.partitionBy("album_id").orderBy("item_id", "place"))  # the one sort: an item's rows of an album lie side by side
    own = own.withColumn("new", F.col("item_id").isNotNull() & ~F.col("item_id").eqNullSafe(before))
    active = items.where("deleted_at is null").groupBy("id").agg(F.max("taken").alias("taken"))
    live = own.join(active, F.col("item_id") == F.col("id"), "left")
    cover = F.min(F.when(F.col("id").isNotNull(), F.struct("place", "id")))["id"]
    return live.groupBy("album_id").agg(F.count_if("new").alias("items"), F.max("taken").alias("newest"), cover.alias("cover"))


def duplicates(files: DataFrame, key: str = "strong_hash") -> DataFrame:
    """Files whose hash is that of another: ``group`` and its size; null hashes are in no group."""
    sizes = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("members")).where("members > 1")
    return files.join(sizes, key).withColumn("group", F.concat(F.lit("dup:"), F.col(key)))


def weak_duplicates(files: DataFrame) -> DataFrame:
    """Buckets of lower-case file name, size and time with two files at least."""
    return files.groupBy(F.lower(P.file_name(F.col("path"))).alias("name"), "size", "mtime").agg(F.count("*").alias("files"), F.min("id").alias("first_id")).where("files > 1")


def duplicate_folders(files: DataFrame, key: str = "strong_hash") -> DataFrame:
    """Per folder: files that have a duplicate, their bytes, and how many have one in another folder."""
    d = duplicates(files, key).withColumn("folder", P.parent(F.col("path")))
    spread = d.groupBy(key).agg(F.countDistinct("folder").alias("folders"))
    return d.join(spread, key).groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("folders") > 1).alias("elsewhere"))


def snapshot_diff(disk: DataFrame, known: DataFrame) -> DataFrame:
    """``new``, ``modified`` (time or size), ``deleted`` or ``same`` for every path of two snapshots."""
    a = disk.select("path", F.col("size").alias("size_a"), F.col("mtime").alias("mtime_a"), F.lit(1).alias("in_a"))
    b = known.select("path", F.col("size").alias("size_b"), F.col("mtime").alias("mtime_b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "new").when(F.col("in_a").isNull(), "deleted").when(~F.col("size_a").eqNullSafe(F.col("size_b")) | ~F.col("mtime_a").eqNullSafe(F.col("mtime_b")), "modified").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"), "size_a", "size_b")


def moves(deleted: DataFrame, new: DataFrame, order: str = "path") -> DataFrame:
    """Pairs of a deleted and a new file of equal lower-case name and size, the first with the first and so on in the lists'
    ``order`` (a column of both). Files of unknown size pair with none."""
    key = lambda df: [F.lower(P.file_name(F.col("path"))).alias("name"), "size", F.col(order).alias("__at")]
    numbered = lambda df, as_: df.select(F.col("path").alias(as_), *key(df)).withColumn("nth", F.row_number().over(W.partitionBy("name", "size").orderBy("__at", as_))).drop("__at")
    return numbered(deleted, "old_path").join(numbered(new, "new_path"), ["name", "size", "nth"]).select("old_path", "new_path", "size")


def moves_by_hash(deleted: DataFrame, new: DataFrame, order: str = "path") -> DataFrame:
    """Pairs like those of ``moves``, of files whose content is equal as well (column ``strong_hash``, null over 128 MiB).

    Deleted files take their turns in order, and each looks only at the first new file of its name and size that is left: it
    takes it if the hashes are equal, else it pairs with none. A name and size with n deleted files is one array of n entries.
    """
    entry = lambda c: F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "path", "strong_hash"))).alias(c)
    named = lambda df: df.where("size is not null").withColumn("name", F.lower(P.file_name(F.col("path")))).groupBy("name", "size")
    both = named(deleted).agg(entry("old")).join(named(new).agg(entry("new")), ["name", "size"])
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<old_path:string,new_path:string>>").alias("pairs"))

    def turn(state, d):
        first = F.try_element_at("new", state["next"])
        same = F.coalesce(first["strong_hash"] == d["strong_hash"], F.lit(False))
        pair = F.struct(d["path"].alias("old_path"), first["path"].alias("new_path"))
        return F.when(same, F.struct((state["next"] + 1).alias("next"), F.array_append(state["pairs"], pair).alias("pairs"))).otherwise(state)

    found = both.select("size", F.explode(F.aggregate("old", start, turn)["pairs"]).alias("p"))
    return found.select("p.old_path", "p.new_path", "size")


def reconcile(known: DataFrame, disk: DataFrame, now: str) -> DataFrame:
    """``known`` with missing files soft-deleted at ``now`` and files that are there again restored."""
    present = disk.select("path", F.lit(True).alias("present")).distinct()
    return known.join(present, "path", "left").select("path", F.when(F.col("present"), F.lit(None)).otherwise(F.coalesce("deleted_at", F.lit(now))).alias("deleted_at"), F.when(F.col("present") & F.col("deleted_at").isNotNull(), "restored").when(F.col("present").isNull() & F.col("deleted_at").isNull(), "deleted").otherwise("kept").alias("action"))


def purge(items: DataFrame, before: str) -> DataFrame:
    """Items that stay when soft-deleted ones older than the grace day go."""
    return items.where(F.col("deleted_at").isNull() | (F.col("deleted_at") >= before))


def orphans(children: DataFrame, items: DataFrame, key: str) -> DataFrame:
    return children.join(items.select(F.col("id").alias(key)), key, "left_anti")


def in_all(items: DataFrame, tags: DataFrame, required: list) -> DataFrame:
    """Items that carry every required tag."""
    have = tags.where(F.col("tag_id").isin(required)).groupBy("item_id").agg(F.countDistinct("tag_id").alias("n")).where(F.col("n") == len(set(required)))
    return items.join(have.select(F.col("item_id").alias("id")), "id", "left_semi")
