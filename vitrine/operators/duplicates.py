"""Duplicate files: scans of a folder by hash and by weak signs, and what a report says of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

HASHED_BYTES = 128 << 20


def scope(path: Column, folder: str, recursive: bool) -> Column:
    """In the folder (at any depth, or directly), comparable forms compared as they are written."""
    root = folder.rstrip("/")
    inside = P.parent(P.comparable(path))
    return inside.startswith(root + "/") | (inside == root) if recursive else inside == root


def scanned(items: DataFrame, folder: str, recursive: bool) -> DataFrame:
    """The active items in the folder, each with its ``hash`` (null where there is none) and why it has none: ``skipped``
    is ``large`` (over 128 MiB), ``missing`` (not on disk) or ``unreadable``.

    ``items`` has content_hash, what hashing on the spot gives (found_hash) and whether the file is on disk.
    """
    own = F.nullif(F.trim("content_hash"), F.lit(""))
    large = F.coalesce("size", F.lit(0)) > HASHED_BYTES
    hashed = F.coalesce(own, F.when(~large & F.col("on_disk"), F.nullif("found_hash", F.lit(""))))
    why = F.when(hashed.isNotNull(), F.lit(None)).when(large, "large").when(~F.col("on_disk"), "missing").otherwise("unreadable")
    return items.where("deleted_at is null").where(scope(F.col("path"), folder, recursive)).select("*", hashed.alias("hash"), why.alias("skipped"))


def skips(scan: DataFrame) -> DataFrame:
    """How many files got no hash, how many of them for their size, and how many as they aren't on disk."""
    return scan.agg(F.count("skipped").alias("unresolved"), F.count_if(F.col("skipped") == "large").alias("large"), F.count_if(F.col("skipped") == "missing").alias("missing"))


def pairs(items: DataFrame, scan: DataFrame) -> DataFrame:
    """``id, path, other_id, other_path, other_size, basis`` for every scanned file and each of its duplicates.

    By ``hash``: all active items of the catalogue with the scanned file's hash. Scanned files without hash are matched among
    themselves by lower-case name, size and time (``weak``). This is the list that is shown for some files; a class of n files has n * n
    rows. Reports on all files go by ``members`` instead.
    """
    known = items.where("deleted_at is null").select("id", "path", "size", F.nullif(F.trim("content_hash"), F.lit("")).alias("hash")).where("hash is not null")
    fresh = scan.where("hash is not null").select("id", "path", "size", "hash").join(known.select("id"), "id", "left_anti")
    others = known.unionByName(fresh).select(F.col("id").alias("other_id"), F.col("path").alias("other_path"), F.col("size").alias("other_size"), "hash")
    repeated = others.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    strong = scan.where("hash is not null").select("id", "path", "hash").join(repeated, "hash", "left_semi").join(others, "hash").where("other_path <> path").withColumn("basis", F.lit("hash"))
    weak = scan.where("hash is null").select("id", "path", "size", F.lower(P.file_name(F.col("path"))).alias("name"), "mtime")
    again = weak.select(F.col("id").alias("other_id"), F.col("path").alias("other_path"), F.col("size").alias("other_size"), "name", "mtime", "size")
    alike = weak.join(again, ["name", "size", "mtime"]).where("other_path <> path").withColumn("basis", F.lit("weak"))
    columns = ["id", "path", "other_id", "other_path", "other_size", "basis"]
    return strong.select(*columns).unionByName(alike.select(*columns))


def listed(found: DataFrame) -> DataFrame:
    """One row per file with its duplicates as an array of (id, path, size) in the order of their paths."""
    entry = F.struct(F.col("other_path").alias("path"), F.col("other_id").alias("id"), F.col("other_size").alias("size"))
    return found.groupBy("id", "path", "basis").agg(F.array_sort(F.collect_list(entry)).alias("duplicates"))


# --------------------------------------------------------------------------- reports, without pairs


def members(items: DataFrame, scan: DataFrame) -> DataFrame:
    """``basis, key, id, path, size, scanned``: what ``pairs`` would pair, one row a file: all active items with a hash, and the scanned files without
    one by their weak signs. Files of one key are duplicates of each other where their paths differ; ``scanned`` ones are asked for."""
    known = items.where("deleted_at is null").select("id", "path", "size", F.nullif(F.trim("content_hash"), F.lit("")).alias("hash")).where("hash is not null")
    asked = scan.where("hash is not null").select("id", "path", "size", "hash")
    marked = known.join(asked.select("id", F.lit(True).alias("scanned")), "id", "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    strong = marked.unionByName(asked.join(known.select("id"), "id", "left_anti").withColumn("scanned", F.lit(True)))
    strong = strong.select(F.lit("hash").alias("basis"), F.col("hash").alias("key"), "id", "path", "size", "scanned")
    name = F.to_json(F.struct(F.lower(P.file_name(F.col("path"))).alias("n"), F.col("size").alias("s"), F.col("mtime").alias("m")))
    weak = scan.where("hash is null and path is not null and size is not null and mtime is not null")
    return strong.unionByName(weak.select(F.lit("weak").alias("basis"), name.alias("key"), "id", "path", "size", F.lit(True).alias("scanned")))


def class_paths(found: DataFrame) -> DataFrame:
    """One row for each class and path of ``members``: ``n`` and ``scans``, its members and scanned ones, their sizes and sums of ids, and the
    class's totals beside them (``all_...``). What a file or path has in the rest of its class follows by subtraction, so no file
    meets another. Rows of a class are summed up in the tasks first."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per = found.groupBy("basis", "key", "path").agg(F.count("*").alias("n"), F.count_if("scanned").alias("scans"), total("id").alias("ids"), F.max("size").alias("size"))
    whole = per.groupBy("basis", "key").agg(F.sum("n").alias("all_n"), F.sum("scans").alias("all_scans"), F.sum("ids").alias("all_ids")).where("all_n > 1")
    return per.join(whole, ["basis", "key"])


def duplicate_files(found: DataFrame) -> DataFrame:
    """``id, path, basis, key, duplicates``: scanned files that have duplicates, how many, and their class, whose members list them."""
    at = class_paths(found).where("all_n > n and scans > 0").select("basis", "key", "path", (F.col("all_n") - F.col("n")).alias("duplicates"))
    return found.where("scanned").select("basis", "key", "id", "path").join(at, ["basis", "key", "path"])


def _shown(found: DataFrame) -> DataFrame:
    """The paths that are duplicates of some scanned file."""
    return class_paths(found).where("all_scans > scans")


def folder_summaries(found: DataFrame, folder: str, recursive: bool) -> DataFrame:
    """Per folder of duplicates in ``members``: distinct paths, their bytes, and how many lie in the scanned scope or not."""
    each = _shown(found).groupBy(P.comparable(F.col("path")).alias("path")).agg(F.max("size").alias("size"))
    inside = scope(F.col("path"), folder, recursive)
    return each.groupBy(P.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("paths"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def inside_outside(found: DataFrame, folder: str) -> DataFrame:
    """One row: scanned files of ``members`` with a duplicate inside and outside the folder's tree, and the bytes of those duplicates, each
    path once."""
    tree = scope(F.col("path"), folder, True)
    at = class_paths(found).withColumn("tree", tree)
    inner = at.groupBy("basis", "key").agg(F.sum(F.when(F.col("tree"), F.col("n")).otherwise(0)).alias("all_inside"))
    at = at.join(inner, ["basis", "key"])
    others_in = F.col("all_inside") - F.when(F.col("tree"), F.col("n")).otherwise(0)
    others_out = F.col("all_n") - F.col("all_inside") - F.when(F.col("tree"), 0).otherwise(F.col("n"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0))
    files = at.agg(some(F.when(others_in > 0, F.col("scans"))).alias("files_inside"), some(F.when(others_out > 0, F.col("scans"))).alias("files_outside"))
    each = _shown(found).groupBy(F.lower(P.comparable(F.col("path"))).alias("low")).agg(F.max("size").alias("size"), F.max(tree).alias("i"))
    size = F.coalesce("size", F.lit(0))
    total = each.agg(some(F.when(F.col("i"), size)).alias("bytes_inside"), some(F.when(~F.col("i"), size)).alias("bytes_outside"))
    return files.join(F.broadcast(total), F.lit(True))  # two single rows


def collapsed(found: DataFrame, folder: str) -> DataFrame:
    """The ids that a list of the folder shows: of two scanned files of ``members`` that are each other's only duplicate, one: that in the
    folder, else the smaller id. The only duplicate of a file is the class's sum of ids less that of its own path."""
    at = class_paths(found).where("all_n > n and scans > 0")
    at = at.select("basis", "key", "path", (F.col("all_n") - F.col("n")).alias("others"), (F.col("all_ids") - F.col("ids")).cast("long").alias("partner"))
    a = found.where("scanned").select("basis", "key", "id", "path").join(at, ["basis", "key", "path"])
    a = a.withColumn("here", F.lower(P.parent(P.comparable(F.col("path")))) == folder.rstrip("/").lower())
    b = a.where("others = 1").select(F.col("id").alias("partner"), F.col("partner").alias("back"), F.col("here").alias("partner_here"))
    single = a.where("others = 1").join(b, "partner", "left")
    stays = F.when(F.col("here") != F.col("partner_here"), F.col("here")).otherwise(F.col("id") < F.col("partner"))
    return a.where("others > 1").select("id").unionByName(single.where(~F.col("back").eqNullSafe(F.col("id")) | stays).select("id"))


def marked_totals(found: DataFrame, marked: DataFrame) -> DataFrame:
    """One row for the duplicates in ``members`` marked for deletion (``id``): how many, in how many folders, and their bytes."""
    each = found.join(marked.select("id"), "id", "left_semi").join(_shown(found).select("basis", "key", "path"), ["basis", "key", "path"], "left_semi")
    each = each.groupBy("id").agg(F.min("path").alias("path"), F.max("size").alias("size"))
    return each.agg(F.count("*").alias("files"), F.countDistinct(P.parent(P.comparable(F.col("path")))).alias("folders"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def left_after_deletion(found: DataFrame, gone: DataFrame) -> DataFrame:
    """``duplicate_files`` of ``members`` once items (``id``) are deleted: neither they nor files without another duplicate."""
    return duplicate_files(found.join(gone.select("id"), "id", "left_anti"))


# --------------------------------------------------------------------------- lists


def after_deletion(found: DataFrame, gone: DataFrame) -> DataFrame:
    """What is left of ``pairs`` when items are deleted: neither they nor files that have no other duplicate."""
    g = gone.select("id")
    return found.join(g, "id", "left_anti").join(g.withColumnRenamed("id", "other_id"), "other_id", "left_anti").select(*found.columns)
