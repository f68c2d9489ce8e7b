"""Digests of folders: what lies below a folder as one value, and differences of snapshots that descend only where digests differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from . import catalogue as C

_WORDS = range(4)


def folder_digests(files: DataFrame) -> DataFrame:
    """``folder, files, digest`` of ``files(path, size, mtime)``: the digest of all files at any depth below the folder, the root ('') included.

    A file counts with the SHA-256 of its path, size and time, read as four 64-bit numbers; a folder's digest is that of their sums and
    of the number of files. Sums don't depend on order, so they are formed in the tasks first and no folder's files are ever listed in
    one place, and each file adds to all folders above it in one pass instead of one pass for each level.
    """
    sha = F.sha2(F.to_json(F.struct("path", "size", "mtime"), {"ignoreNullFields": "false"}), 256)
    words = [F.conv(F.substring(sha, 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)").alias(f"w{k}") for k in _WORDS]
    each = files.select(F.explode(F.array_union(F.array(F.lit("")), P.ancestors(F.col("path")))).alias("folder"), *words)
    g = each.groupBy("folder").agg(F.count("*").alias("files"), *[F.sum(F.col(f"w{k}").cast("decimal(38,0)")).alias(f"w{k}") for k in _WORDS])
    return g.select("folder", "files", F.sha2(F.concat_ws(",", "files", *[F.col(f"w{k}").cast("string") for k in _WORDS]), 256).alias("digest"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``folder`` of two tables of ``folder_digests`` where they differ or which only one has. If a folder is among them, so are all
    above it."""
    r = right.select("folder", F.col("digest").alias("other"))
    return left.select("folder", "digest").join(r, "folder", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("folder")


def visited(left: DataFrame, right: DataFrame) -> DataFrame:
    """``folder`` whose digests a descent from the root compares: the root, and the folders directly below one that differs."""
    odd = differing(left, right)
    every = left.select("folder").unionByName(right.select("folder")).distinct()
    below = every.where("folder <> ''").withColumn("up", F.when(F.col("folder").contains("/"), P.parent(F.col("folder"))).otherwise(""))
    return below.join(odd.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").unionByName(every.where("folder = ''"))


def changes(disk: DataFrame, known: DataFrame, disk_digests: DataFrame, known_digests: DataFrame) -> DataFrame:
    """The rows of ``catalogue.snapshot_diff`` that aren't ``same``. Only files directly in folders that differ are compared; those of all
    other folders are left out before the join."""
    odd = differing(disk_digests, known_digests).select(F.col("folder").alias("__in"))
    own = lambda df: df.withColumn("__in", P.parent(P.comparable(F.col("path")))).join(odd, "__in", "left_semi").drop("__in")
    return C.snapshot_diff(own(disk), own(known)).where("state <> 'same'")
