"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, tokens. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import exact_dedup, minhash, mixing, toxicity
from vitrine.llm.common import clear_scratch, materialise, scratch_mark
from vitrine.llm.queries import op4_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the classifier learns from the labelled ones among ``docs``."""
    model = toxicity.learnt_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = toxicity.score(docs, model, keep=tuple(docs.columns), name="__toxicity").where("__toxicity < 0.5").select(*docs.columns)
    return materialise(clean, "clean", batch_rows=500)  # written here, as whole documents fill a task's Arrow batches


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest doc_id."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id (see ``minhash.near_duplicates``)."""
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; documents may come whole, in part, or twice."""
    return mixing.mixed_documents(docs)


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the mix took, one row per row of it."""
    return op4_bpe(spark, sf_dir, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", count_tokens),
]

#: The classifier and the near-duplicate stage have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = scratch_mark()
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        clear_scratch(spark, mark, keep=(docs,))
    return docs
