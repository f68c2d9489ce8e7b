"""Exact dedup with Structured Streaming: keyed state on disk, without expiry, and full bytes compared on hits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bits_for, materialise, maybe_in, scratch_path

#: State on disk, in RocksDB. Without preallocation, as each state partition would take several MB from its start; all stores of an
#: executor share one bounded cache, so their memory doesn't grow with the number of state partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}


def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def keep_state(spark: SparkSession, staged: str, schema, checkpoint: str, files_per_batch: int) -> DataFrame:
    """Run the stateful stream over the staged rows ``(digest, late, doc_id, locator)`` and return its state.

    State per digest: ``keep`` (the smallest identifier, none last, and where its content lies) and ``n``, in RocksDB on
    the executors' disks with change logs in ``checkpoint``; there is no watermark, so nothing expires. Spark combines the
    rows of a digest in each task before the shuffle, so a hot digest sends one row per task. Calling this again
    with the same checkpoint takes in only newly staged files.
    """
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(staged)
        state = stream.groupBy("digest").agg(F.min(F.struct("late", "doc_id", "locator")).alias("keep"), F.count("*").alias("n"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.format("statestore").load(checkpoint)
    names = [f.name for f in rows.schema["value"].dataType.fields]
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{names[0]}`").alias("keep"), F.col(f"value.`{names[1]}`").alias("n"))


def exact_duplicates(docs: DataFrame, digest: Column | None = None, checkpoint: str | None = None, files_per_batch: int = 10_000) -> DataFrame:
    """Groups of equal texts in ``docs(doc_id, text)``: ``doc_id, keep_id, group_size, kept, text_sha256, locator`` per row.

    Texts are equal when identical after each white space run becomes one space; null counts as the empty text. Of a
    group the row with the smallest doc_id stays; rows without doc_id come last, and of rows that share the doc_id one
    stays, so exactly one row of each group is ``kept``. Other columns are ignored; an empty table gives no rows.

    Rows get a content locator (the file that holds them, run and row) and are staged as digest, identifier and locator;
    a stream keeps the state described at ``keep_state``. With ``checkpoint``, a folder in a shared store, state and
    staged rows stay there, and a later call takes ``docs`` as further rows: they are told apart from those of all calls
    before, whose texts are read again through the locators of the kept rows that new rows hit: from their files, or, for rows that
    came from no file, from copies of their texts in the checkpoint folder. The files' names pass the driver, as those of any table
    that Spark reads; a file that is gone is an error.

    Every digest that was hit more than once is checked on full bytes: the texts behind it, found through a bitmap
    sized by the number of hits, are grouped by digest and whole text. If a digest turns out to hold different texts
    (``digest`` may be a weak one), its rows are regrouped by text.
    """
    spark = docs.sparkSession
    run = uuid.uuid4().hex
    staged, kept_in = (f"{checkpoint}/staged", f"{checkpoint}/state") if checkpoint else (scratch_path(spark, "exact-staged"), scratch_path(spark, "exact-state"))
    sha = F.sha2("text", 256)
    own = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"), F.input_file_name().alias("file"))
    with_digest = lambda df: df.withColumn("digest", F.unhex(sha) if digest is None else digest)
    d = with_digest(own(docs))
    locator = F.concat_ws("#", "file", F.lit(run), F.monotonically_increasing_id())
    name = sha if digest is not None else F.lit(None).cast("string")
    rows = d.select("digest", F.col("doc_id").isNull().alias("late"), "doc_id", locator.alias("locator"), name.alias("text_sha256"), F.lit(run).alias("run"))
    rows.write.mode("append").parquet(staged)
    every = spark.read.schema(rows.schema).parquet(staged)
    table = every.where(F.col("run") == run)
    state = materialise(keep_state(spark, staged, rows.schema, kept_in, files_per_batch), "exact-keys")

    hits = state.where("n > 1").select(F.xxhash64("digest").alias("h"))
    bits = bits_for(hits.count())
    texts = d
    if checkpoint:  # kept rows of earlier runs that rows of this run hit
        d.where("file = ''").select("doc_id", "text", F.lit(run).alias("run")).write.mode("append").parquet(f"{checkpoint}/texts")
        mark = F.concat(F.lit("#"), F.lit(run), F.lit("#"))
        elsewhere = state.where("n > 1").where(~F.col("keep.locator").contains(mark)).join(table.select("digest").distinct(), "digest", "left_semi")
        elsewhere = elsewhere.select("digest", F.col("keep.doc_id").alias("__id"), F.split("keep.locator", "#")[0].alias("__file"))
        files = [r[0] for r in elsewhere.where("__file <> ''").select("__file").distinct().collect()]
        loose = spark.read.schema("doc_id long, text string, run string").parquet(f"{checkpoint}/texts").where(F.col("run") != run)
        before = loose.select("doc_id", "text", F.lit("").alias("file"))
        if files:
            before = before.unionByName(own(spark.read.parquet(*files)))
        found = with_digest(before).join(elsewhere, "digest").where("doc_id <=> __id")
        texts = d.unionByName(found.select(*d.columns))
    hit_texts = maybe_in(texts.withColumn("h", F.xxhash64("digest")), "h", bitmap(hits, "h", bits), bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id"))
    checked = hit_texts.groupBy("digest", "text").agg(first.alias("first"), F.count("*").alias("group_size"))
    torn = materialise(checked.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "exact-torn")

    whole = table.join(state.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("keep.locator").alias("stays")), "digest")
    name = F.lower(F.hex("digest")) if digest is None else F.col("text_sha256")
    out = ["doc_id", "keep_id", "group_size", (F.col("locator") == F.col("stays")).alias("kept"), name.alias("text_sha256"), "locator"]
    if torn.isEmpty():
        return whole.select(*out)
    again = every.join(torn, "digest", "left_semi")
    groups = again.groupBy("digest", "text_sha256").agg(F.min(F.struct("late", "doc_id", "locator")).alias("keep"), F.count("*").alias("group_size"))
    groups = groups.select("digest", "text_sha256", F.col("keep.doc_id").alias("keep_id"), "group_size", F.col("keep.locator").alias("stays"))
    return whole.join(torn, "digest", "left_anti").select(*out).unionByName(again.where(F.col("run") == run).join(groups, ["digest", "text_sha256"]).select(*out))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the row with the smallest doc_id (null last), once."""
    stays = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    own = docs.withColumn("__own", F.sha2(normalised(F.col("text").cast("string")), 256))
    both = own.join(stays, (F.col("__own") == F.col("__sha")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return both.dropDuplicates(["__sha"]).select(*docs.columns)
