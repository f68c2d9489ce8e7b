"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_SQL, materialise

#: Multipliers of the seeded block permutation; one that does not divide the number of blocks is coprime to it.
PRIMES = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081)


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: int = 150, epochs: int = 2) -> DataFrame:
    """Adds ``target`` to ``sources(source, source_size)``: shares by weight, capped at ``epochs`` times the size.

    Weights repeat over the sources in code point order, null last. What a cap leaves over is shared again by weight;
    in closed form: sources sorted by cap / weight, capped as long as the level of the rest covers them. The windows
    here run over one row per source.
    """
    n = F.lit(len(weights))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rising = W.orderBy("full_at", "nth")
    s = (
        sources.withColumn("nth", order)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % n + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * epochs)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * percent / 100)
        .withColumn("before", F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("before")) / F.col("open"))
        .withColumn("capped", F.col("full_at") <= F.col("level"))
        .withColumn("final", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("full_at"))).over(W.partitionBy()))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final"))).cast("double")
    return s.select("source", "source_size", "nth", target.alias("target"))


def sainte_lague(rows: DataFrame, group: list[str], key: str, seats: Column) -> DataFrame:
    """Adds ``won`` to ``rows(group, key, votes, cap)``: ``seats`` of each group by the highest quotients votes / (2k + 1).

    Rows whose votes reach their cap take it outright. For the rest only quotients near the common divisor are made:
    seats that every divisor in question gives are given at once, so a group of n rows makes O(n) quotients, however
    many seats there are. Ties go to the smaller key. No row gets more than its cap.
    """
    g = W.partitionBy(*group)
    free = F.col("votes") < F.col("cap")
    r = (
        rows.withColumn("__free", free)
        .withColumn("__v", F.sum(F.when(free, F.col("votes")).otherwise(0.0)).over(g))
        .withColumn("__n", F.sum(free.cast("long")).over(g))
        .withColumn("__s", F.greatest(F.lit(0), seats - F.sum(F.when(free, 0).otherwise(F.col("cap"))).over(g)))
        .withColumn("__lo", F.when(free & (F.col("__v") > 0), F.floor(F.col("votes") * F.greatest(F.lit(0.0), F.col("__s") - F.col("__n") / 2) / F.col("__v") + 0.5)).otherwise(0))
        .withColumn("__hi", F.when(free & (F.col("__v") > 0), F.floor(F.col("votes") * (F.col("__s") + F.col("__n") / 2) / F.col("__v") + 0.5) + 1).otherwise(0))
        .withColumn("__lo", F.least("__lo", "cap"))
        .withColumn("__hi", F.least("__hi", "cap"))
        .withColumn("__open", F.col("__s") - F.sum("__lo").over(g))
    )
    ranked = (
        r.where("__hi > __lo")
        .select(*group, key, "__open", F.explode(F.sequence("__lo", F.col("__hi") - 1)).alias("__k"), "votes")
        .withColumn("__rank", F.row_number().over(g.orderBy((F.col("votes") / (2 * F.col("__k") + 1)).desc(), F.col(key).asc(), F.col("__k").asc())))
        .where("__rank <= __open")
    )
    more = ranked.groupBy(*group, key).agg(F.count("*").alias("__more"))
    won = F.when(F.col("__free"), F.col("__lo") + F.coalesce("__more", F.lit(0))).otherwise(F.col("cap")).cast("long")
    return r.join(more, [*group, key], "left").select(*rows.columns, won.alias("won"))


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    percent: int = 150,
    epochs: int = 2,
    block_words: int = 128,
    rows_per_shard: int = 20_000,
    seed: int = 11,
) -> DataFrame:
    """What a mix takes of each row of ``docs(doc_id, text, source)``: ``doc_id, text_hash, size, source_size, target,
    whole, spans``.

    ``whole`` is how often the text is taken whole; ``spans`` (word from, word to) is what is taken once more.
    Size is the number of words, 0 for null and empty texts, which take part with nothing to take. A null source is a
    source of its own. Rows are dealt to shards by a hash of doc_id, about ``rows_per_shard`` to a shard, so a hot
    source lies in many shards. In a shard, the words of a source, in a seeded order of its rows, form near-equal
    blocks of about ``block_words``; Sainte-Laguë gives each source its number of blocks and then each of its shards
    an integer quota; a seeded permutation selects the blocks. Repeated rows count each. An empty table gives no rows.
    """
    d = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")),
        "mix-sizes",
    )
    shards = max(4, -(-d.count() // rows_per_shard))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
    cells = d.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("blocks", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(0).cast("long"))
    by_source = cells.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("blocks"))
    t = targets(by_source.select("source", "source_size"), weights, percent, epochs).join(by_source.select(F.col("source").alias("s2"), "blocks"), F.expr("source <=> s2")).drop("s2")
    t = t.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)).withColumn("cap", F.col("blocks") * epochs).withColumn("g", F.lit(0))
    quota = sainte_lague(t, ["g"], "nth", F.round(F.sum("votes").over(W.partitionBy("g"))).cast("long"))
    quota = materialise(quota.select("source", "source_size", "target", "nth", F.col("blocks").alias("source_blocks"), F.col("won").alias("quota")), "mix-quota")
    c = cells.join(quota.withColumnRenamed("source", "s2"), F.expr("source <=> s2")).drop("s2")
    c = c.withColumn("votes", F.when(F.col("source_blocks") > 0, F.col("quota") * F.col("blocks") / F.col("source_blocks")).otherwise(0.0)).withColumn("cap", F.col("blocks") * epochs)
    c = sainte_lague(c, ["nth"], "shard", F.col("quota"))
    prime = F.coalesce(*[F.when(F.col("blocks") % p != 0, F.lit(p)) for p in PRIMES], F.lit(1))
    c = c.select(F.col("source").alias("s2"), F.col("shard").alias("h2"), "source_size", "target", "words", "blocks", "won", prime.alias("prime"), F.xxhash64(F.lit(seed), "nth", "shard").alias("turn"))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    r = d.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0))).join(c, F.expr("source <=> s2 and shard = h2"))
    r = r.withColumn("whole", F.when(F.col("blocks") > 0, F.floor(F.col("won") / F.col("blocks"))).otherwise(0).cast("long")).withColumn("extra", F.col("won") - F.col("whole") * F.col("blocks"))
    first, last = F.expr("((at + 1) * blocks - 1) div words"), F.expr("((at + size) * blocks - 1) div words")
    chosen = F.filter(F.sequence(first, last), lambda j: F.pmod(j * F.col("prime") + F.pmod("turn", "blocks"), F.col("blocks")) < F.col("extra"))
    spans = F.transform(
        chosen,
        lambda j: F.struct(
            (F.greatest(F.floor(j * F.col("words") / F.col("blocks")), F.col("at")) - F.col("at")).alias("from"),
            (F.least(F.floor((j + 1) * F.col("words") / F.col("blocks")), F.col("at") + F.col("size")) - F.col("at")).alias("to"),
        ),
    )
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    return r.select("doc_id", "text_hash", "size", "source_size", "target", "whole", F.when((F.col("size") > 0) & (F.col("extra") > 0), spans).otherwise(none).alias("spans"))


def taken(plan: DataFrame) -> DataFrame:
    """``plan`` with the number of words taken of each row."""
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return plan.withColumn("taken", F.col("whole") * F.col("size") + words)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a text is taken whole, and one row with the
    words of the selected blocks, joined by one space, where only a part is taken once more (``n_chars``, if there,
    is set anew). Documents of which nothing is taken, null and empty texts among them, have no row. Rows that share doc_id and text share
    one of their plans.
    """
    plan = mix_plan(docs, **options).groupBy("doc_id", "text_hash").agg(F.min(F.struct("whole", "spans", "size")).alias("p"))
    plan = plan.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("p.size").alias("__size"), F.col("p.whole").alias("__whole"), F.col("p.spans").alias("__spans"))
    cols = docs.columns
    both = docs.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD_SQL})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("__words", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), " ")
    all_of_it = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"]) == F.col("__size")
    times = F.when(F.col("__size") > 0, F.col("__whole") + all_of_it.cast("long")).otherwise(0)
    wholes = F.array_repeat("text", times.cast("int"))
    pieces = F.when((F.size("__spans") > 0) & ~all_of_it, F.concat(wholes, F.array(part))).otherwise(wholes)
    out = both.withColumn("__words", F.when(F.size("__spans") > 0, words)).withColumn("__piece", F.explode(pieces))
    text = {"text": F.col("__piece")} | ({"n_chars": F.length("__piece").cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return out.select(*[text[c].alias(c) if c in text else F.col(c) for c in cols])
