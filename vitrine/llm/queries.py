"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bilinear, bpe, centroids, exact_dedup, licenses, minhash, mixing, sharding, substring, toxicity, tries, twins, warc
from .common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).drop("locator")


def op4_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents") if docs is None else docs
    coded = bpe.round_trip(docs, tokenizer_path())
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return materialise(coded, "bpe", batch_rows=500)  # written here, as long texts, ids and decoded texts fill a task's Arrow batches


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learnt_from(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix_plan(_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {c: F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")}
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", *labels.values(), "score")


def op9_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))
    history = warc.archive(_table(spark, sf_dir, "pages"), captured)
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))[0].drop("compared")


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bilinear.score(_table(spark, sf_dir, "documents"), ~toxicity.in_fold(F.col("doc_id"), folds=10))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_additive_quantisation, op2_suffix_automata, op3_exact_dedup, op4_bpe, op5_toxicity, op6_minhash, op7_mixing, op8_licenses, op9_label_propagation, op10_warc, op11_annulus, op12_log_bilinear, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)""",
    "op2_suffix_automata": twins.REPEATS,
    "op6_minhash": twins.NEAR,
    "op8_licenses": licenses.oracle(),
    "op10_warc": twins.ARCHIVES,
    "op11_annulus": twins.CLUSTERS,
    "op13_prefix_trie": twins.TRIE,
}
