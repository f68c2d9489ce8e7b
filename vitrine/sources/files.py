"""Files as tables: listings, hashes and fingerprints through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

#: Extensions by kind, and the size from which a file gets no strong hash.
IMAGES = ("jpg", "jpeg", "png", "webp", "gif", "heic", "tif", "tiff")
VIDEOS = ("mp4", "mov", "mkv", "avi", "webm", "m4v")
HASHED_BYTES = 128 << 20


#: Media types by extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff",
    "mp4": "video/mp4", "mov": "video/quicktime", "m4v": "video/x-m4v", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo",
}


def mime(path):
    """The media type that a path's extension stands for, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair]), extension(path))


def media_kind(path, mime_type):
    """``video`` by media type, else by extension; all else is an image."""
    return F.when(F.coalesce(mime_type.ilike("video/%"), F.lit(False)), "video").when(F.coalesce(mime_type.ilike("image/%"), F.lit(False)), "image").otherwise(kind(path))


def is_image(path, mime_type):
    return F.coalesce(mime_type.ilike("image/%"), F.lit(False)) | extension(path).isin(*IMAGES)


def is_video(path, mime_type, media=None):
    named = F.coalesce(media == "video", F.lit(False)) if media is not None else F.lit(False)
    return named | F.coalesce(mime_type.ilike("video/%"), F.lit(False)) | extension(path).isin(*VIDEOS)


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path):
    return F.when(extension(path).isin(*VIDEOS), "video").otherwise("image")


def listing(spark: SparkSession, folder: str, recursive: bool = False, hashes: bool = False) -> DataFrame:
    """``path, size, mtime, kind`` of the media files in a folder; with ``hashes`` the contents are read and digested."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(extension(F.col("path")).isin(*IMAGES, *VIDEOS))
    columns = ["path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), kind(F.col("path")).alias("kind")]
    if hashes:
        columns.append(F.when(F.col("length") <= HASHED_BYTES, F.sha2("content", 256)).alias("strong_hash"))
    return files.select(*columns)


def signatures(files: DataFrame) -> DataFrame:
    """SHA-256 over the sorted ``name|mtime|size`` lines of each folder."""
    line = F.concat_ws("|", P.file_name(F.col("path")), F.col("mtime").cast("string"), F.col("size").cast("string"))
    return files.groupBy(P.parent(F.col("path")).alias("folder")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("signature"))


def fingerprint(size, mtime):
    return F.concat_ws(":", size.cast("string"), mtime.cast("string"))


def named(files: DataFrame) -> DataFrame:
    """A listing in the order of names, letters in either case, ties to the path."""
    return files.orderBy(F.lower(P.file_name(F.col("path"))), "path")


def batches(spark: SparkSession, folder: str, files: int = 80) -> DataFrame:
    """A stream of a folder's media files, at most so many a batch: ``path, size, mtime, kind``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files).load(folder)
    stream = stream.where(extension(F.col("path")).isin(*IMAGES, *VIDEOS))
    return stream.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), kind(F.col("path")).alias("kind"))


def folders(files: DataFrame, root: str) -> DataFrame:
    """``folder, has_subfolders`` of the folders directly in ``root`` that hold files at any depth, by their paths."""
    deep = files.select(F.explode(P.ancestors(F.col("path"))).alias("folder")).distinct()
    base = root.rstrip("/")
    own = deep.where(P.parent(F.col("folder")) == base)
    inner = deep.select(P.parent(F.col("folder")).alias("folder")).distinct().withColumn("__in", F.lit(True))
    return own.join(inner, "folder", "left").select("folder", F.coalesce("__in", F.lit(False)).alias("has_subfolders"))


def walk(files: DataFrame) -> DataFrame:
    """Per folder of a recursive listing: number of files, their bytes, latest time, and the names of its subfolders."""
    own = files.groupBy(P.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("latest"))
    every = files.select(F.explode(P.ancestors(F.col("path"))).alias("folder")).distinct()
    subs = every.where(P.parent(F.col("folder")) != "").groupBy(P.parent(F.col("folder")).alias("folder")).agg(F.array_sort(F.collect_set(P.file_name(F.col("folder")))).alias("subfolders"))
    out = every.join(own, "folder", "left").join(subs, "folder", "left")
    return out.select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "latest", F.coalesce("subfolders", F.array().cast("array<string>")).alias("subfolders"))


def geo_names(spark: SparkSession, cities: str, admin1: str, admin2: str) -> DataFrame:
    """Cities from GeoNames dumps (tab-separated, no header): ``city, country_code, area, area2, latitude, longitude``."""
    read = lambda path: spark.read.option("sep", "\t").option("quote", "").csv(path)
    names = lambda path, as_: read(path).select(F.col("_c0").alias(f"{as_}_code"), F.col("_c1").alias(as_))
    c = read(cities).select(F.col("_c1").alias("city"), F.col("_c8").alias("country_code"), F.concat_ws(".", "_c8", "_c10").alias("area_code"), F.concat_ws(".", "_c8", "_c10", "_c11").alias("area2_code"), F.col("_c4").cast("double").alias("latitude"), F.col("_c5").cast("double").alias("longitude"))
    return c.join(names(admin1, "area"), "area_code", "left").join(names(admin2, "area2"), "area2_code", "left").select("city", "country_code", "area", "area2", "latitude", "longitude")


def country_names(spark: SparkSession) -> DataFrame:
    """``country_code, country`` of all ISO countries in English, from the tables of the JVM."""
    locale = spark._jvm.java.util.Locale
    rows = [(c, locale("", c).getDisplayCountry(locale.ENGLISH)) for c in locale.getISOCountries()]
    return spark.createDataFrame(rows, "country_code string, country string")
