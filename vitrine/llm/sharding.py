"""Sharding by balanced label propagation. DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_scratch, materialise

#: Rows in a cell that gets its own place in a shard's order, about; and members from which a group has cells of its own.
CELL, LARGE = 20_000, 20_000

#: Groups move in levels, the larger first: groups of one level are at most so many times as large as each other.
STEP = 8


def _pick(values: list[int], index: Column) -> Column:
    """The value at ``index`` (from 0) of a list as long as there are shards."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def _list(values: list, kind: str) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(str(v) for v in values)), ",").cast(f"array<{kind}>")


def admitted(wishes: dict[tuple[int, int], int], free: list[int]) -> list[float]:
    """The share of each move (from ``i`` to ``j`` at ``i * shards + j``) that is let in.

    A label takes in what it has room for and what leaves it in the same round, so full labels can swap rows. The
    wishes into a label with too many are scaled down until this holds for all of them.
    """
    n = len(free)
    asked = np.zeros((n, n))
    for (i, j), count in wishes.items():
        asked[i, j] = count
    flow = asked.copy()
    while True:
        comes, room = flow.sum(axis=0), np.maximum(0, np.array(free) + flow.sum(axis=1))
        if (comes <= room + 0.5).all():
            return np.divide(flow, asked, out=np.zeros((n, n)), where=asked > 0).ravel().tolist()
        flow *= np.where(comes > room, room / np.maximum(comes, 1e-9), 1.0)


def propagate(linked: DataFrame, most: list[int], share_of: int, shards: int, rounds: int | None, seed: int) -> DataFrame:
    """New labels of ``linked(g, u, label)`` (rows linked through their group ``g``): moves that cut fewer links.

    In each round a group's rows are counted by label (pre-aggregated). A label can hold what the group has there and
    what room there is: free places (``most`` less its rows) and rows whose group has its majority elsewhere; where
    ``most`` is exceeded, a hash tells the groups that can't stay. The group's aims are the fewest labels that can hold
    it, those first that can hold most of it, then those that do, ties by a hash. Its rows elsewhere wish for the aims
    in proportion to their room, by a hash, and are let in by a hash against the share that there is room for (see
    ``admitted``). Rounds end when no row wishes to move or the number of cut links, and of those that rows beyond
    ``most`` stand for, no longer falls (that round is taken back); ``rounds`` can end them earlier. A group has its
    majority in one label for each ``share_of`` members. Some numbers per pair of labels come to the driver.
    """
    spark = linked.sparkSession
    now, before, written, best, turn = linked, None, [], None, 0
    while rounds is None or turn <= rounds:
        held = F.struct((-F.col("n")).alias("less"), F.xxhash64("g", "label", F.lit(seed + turn)).alias("tie"), F.col("label"))
        ranks = now.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("m"), F.array_sort(F.collect_list(held)).alias("at"))
        ranks = materialise(ranks.withColumn("homes", F.ceil(F.col("m") / share_of).cast("int")), "shard-ranks")
        together = F.aggregate("at", F.lit(0).cast("long"), lambda x, s: x + s["less"] * (s["less"] + 1))
        sums = {r["label"]: r for r in ranks.select("homes", F.posexplode("at").alias("k", "s")).groupBy("s.label").agg(F.sum(-F.col("s.less")).alias("n"), F.sum(F.when(F.col("k") >= F.col("homes"), -F.col("s.less")).otherwise(0)).alias("leave")).collect()}
        n = [sums[j]["n"] if j in sums else 0 for j in range(shards)]
        free = [most[j] - n[j] for j in range(shards)]
        links, cut = ranks.agg(F.coalesce(F.sum(F.col("m") * (F.col("m") - 1)), F.lit(0)), F.coalesce(F.sum(F.col("m") * (F.col("m") - 1) - together), F.lit(0))).first()
        cut += sum(max(0, -x) for x in free) * links / max(1, sum(n))
        if best is not None and cut >= best:
            now = before
            drop_scratch(spark, ranks)
            break
        for old in written[:-1]:
            drop_scratch(spark, old)
        best, before, written = cut, now, written[-1:]
        if turn == rounds or not cut:
            drop_scratch(spark, ranks)
            break
        stay = _list([min(1.0, most[j] / n[j]) if n[j] else 1.0 for j in range(shards)], "double")
        room = _list([max(0, free[j] + (sums[j]["leave"] if j in sums else 0)) for j in range(shards)], "bigint")

        plan = ranks.where((F.size("at") > 1) | F.lit(min(free) < 0)).withColumn("own", F.map_from_entries(F.transform("at", lambda s: F.struct(s["label"], -s["less"])))).withColumn("home", F.transform(F.slice("at", F.lit(1), F.col("homes")), lambda s: s["label"]))
        have = lambda j: F.coalesce(F.try_element_at(F.col("own"), j), F.lit(0).cast("long"))
        hashed = lambda *by: F.pmod(F.xxhash64(*by, F.lit(seed + turn)), F.lit(1 << 30)) / float(1 << 30)
        own = lambda j: F.when(hashed("g", j, F.lit(1)) < F.element_at(stay, j + 1), have(j)).otherwise(0)
        can = lambda j: F.greatest(own(j), F.element_at(room, j + 1) + F.when(F.array_contains("home", j), own(j)).otherwise(0))
        every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(own(j).alias("n"), can(j).alias("can"), j.alias("label")))
        order = F.transform("every", lambda s: F.struct((-2 * F.least(s["can"], F.col("m")) - s["n"]).alias("less"), F.xxhash64("g", s["label"], F.lit(seed + turn)).alias("tie"), s["label"].alias("label"), s["can"].alias("can"), s["n"].alias("n")))
        none = F.struct(F.lit(0).cast("long").alias("can"), F.lit(0).cast("long").alias("room"), F.array().cast("array<int>").alias("labels"), F.array().cast("array<bigint>").alias("ends"))
        add = lambda x, s: F.when(x["can"] >= F.col("m"), x).otherwise(F.struct((x["can"] + s["can"]).alias("can"), (x["room"] + s["can"] - s["n"]).alias("room"), F.array_append(x["labels"], s["label"]).alias("labels"), F.array_append(x["ends"], x["room"] + s["can"] - s["n"]).alias("ends")))
        plan = plan.withColumn("every", every).withColumn("order", F.array_sort(order)).select("g", "m", F.aggregate("order", none, add).alias("aims"))
        aimed = F.element_at("aims.labels", F.size(F.filter("aims.ends", lambda e: e <= F.floor(hashed("u", F.lit(2)) * F.col("aims.room")))) + 1)
        wish = F.when(F.col("aims").isNull() | (F.col("aims.room") <= 0) | F.array_contains("aims.labels", F.col("label")), F.col("label")).otherwise(aimed)
        large = plan.where(F.col("m") >= LARGE)
        hot = [r["g"] for r in large.select("g").collect()]
        is_hot = F.col("g").isin(hot) if hot else F.lit(False)
        joined = now.where(~is_hot).join(plan.where(F.col("m") < LARGE), "g", "left")
        if hot:
            joined = joined.unionByName(now.where(is_hot).join(F.broadcast(large), "g"))
        wishes = materialise(joined.select("g", "u", "label", "m", wish.alias("wish")), "shard-wishes")
        asked = {(r["label"], r["wish"]): r["n"] for r in wishes.where("wish <> label").groupBy("label", "wish").agg(F.count("*").alias("n")).collect()}
        drop_scratch(spark, ranks)
        if not asked:
            drop_scratch(spark, wishes)
            break
        shares = _list(admitted(asked, free), "double")
        chance = F.when(F.col("m") * 100 <= share_of, hashed("g", "wish", F.lit(3))).otherwise(hashed("u", F.lit(3)))
        goes = (F.col("wish") != F.col("label")) & (chance < F.element_at(shares, F.col("label") * shards + F.col("wish") + 1))
        now = wishes.select("g", "u", F.when(goes, F.col("wish")).otherwise(F.col("label")).alias("label"))
        written, turn = [*written, wishes], turn + 1
    return now


def shard(docs: DataFrame, shards: int = 40, rounds: int | None = None, slack_percent: int = 0, seed: int = 17) -> DataFrame:
    """A shard for each row of ``docs(doc_id, text)``: ``doc_id, size, text_crc32, group, shard, slot``.

    Row counts of the shards differ by one at most. ``size`` is the UTF-8 bytes of the text plus 16, ``group`` a hash of
    the text; null counts as the empty text. Rows of one group are linked and should lie in one shard; a group
    larger than a shard fills several. ``slot`` numbers a shard's rows from 0 without gaps. Repeated rows count each,
    doc_id may be null, other columns are ignored, an empty table gives no rows.

    All rows start at a shard by a hash of their own. Rows of groups with several members then move by label
    propagation (see ``propagate``), the levels of larger groups first and each in the room that those left: a smaller
    group can still move as a whole. A label takes in ``slack_percent`` above its quota, and alone standing rows yield.
    At last each label keeps its exact quota, larger groups first, and the rows beyond it fill the gaps of the others.
    Places in a label come from counts of small cells, never from one task per label.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    table = materialise(rows.withColumn("u", F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed))), "shard-rows")
    several = table.groupBy("g").agg(F.count("*").alias("members")).where("members > 1")
    start = F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")
    t = materialise(table.join(several, "g", "left").withColumn("members", F.coalesce("members", F.lit(1))).withColumn("label", start), "shard-start")
    total = t.count()
    size = F.floor(F.log(F.lit(max(1, total // shards)) / F.col("members")) / math.log(STEP)) + 1
    t = t.withColumn("level", F.when(F.col("members") == 1, F.lit(1 << 30)).otherwise(F.greatest(F.lit(0), size)).cast("int"))
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    share_of = max(1, total // shards)
    most = [quota[j] * (100 + slack_percent) // 100 for j in range(shards)]
    parts = []
    for r in t.where("members > 1").select("level").distinct().orderBy("level").collect():
        linked = t.where((F.col("members") > 1) & (F.col("level") == r["level"])).select("g", "u", "label")
        parts.append(materialise(propagate(linked, most, share_of, shards, rounds, seed), "shard-moved"))
        have = {x["label"]: x["n"] for x in parts[-1].groupBy("label").agg(F.count("*").alias("n")).collect()}
        most = [max(0, most[j] - have.get(j, 0)) for j in range(shards)]
    moved = t.where("false").select("g", "u", "label")
    for part in parts:
        moved = moved.unionByName(part)
    moved = moved.withColumnRenamed("label", "new")
    t = t.join(moved, ["g", "u"], "left").withColumn("label", F.coalesce("new", "label")).drop("new")
    cells = max(1, total // (shards * CELL))
    alone, large = F.col("members") == 1, F.col("members") >= LARGE
    t = t.withColumn(
        "cell",
        F.struct(
            F.col("level").alias("late"),
            F.when(alone, F.pmod(F.xxhash64("u", F.lit(1)), F.lit(cells))).otherwise(F.pmod(F.xxhash64("g"), F.lit(cells))).alias("part"),
            F.when(large, F.col("g")).otherwise(0).alias("own"),
            F.when(large, F.pmod(F.xxhash64("u", F.lit(1)), F.floor(F.col("members") / LARGE) + 1)).otherwise(0).alias("sub"),
        ),
    )
    t = materialise(t.select("doc_id", "size", "text_crc32", "g", "u", "label", "cell"), "shard-cells")
    counts = t.groupBy("label", "cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("label", "cell", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("label", "cell").orderBy("g", "u", "doc_id")) - 1
    t = t.withColumn("inside", inside).join(offsets, ["label", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))
    held = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, held.get(j, 0) - quota[j]) for j in range(shards)]
    gaps = [max(0, quota[j] - held.get(j, 0)) for j in range(shards)]
    over_before, gap_before = [sum(over[:j]) for j in range(shards)], [sum(gaps[:j]) for j in range(shards)]
    stays = F.col("rank") < _pick(quota, F.col("label"))
    spare = _pick(over_before, F.col("label")) + F.col("rank") - _pick(quota, F.col("label"))
    t = t.withColumn("spare", F.when(~stays, spare))
    ends = F.array(*[F.lit(gap_before[j] + gaps[j]).cast("long") for j in range(shards)])
    to = F.size(F.filter(ends, lambda e: e <= F.col("spare"))).cast("int")
    t = t.withColumn("shard", F.when(F.col("spare").isNull(), F.col("label")).otherwise(to))
    slot = F.when(F.col("spare").isNull(), F.col("rank")).otherwise(_pick([held.get(j, 0) for j in range(shards)], F.col("shard")) + F.col("spare") - _pick(gap_before, F.col("shard")))
    return t.select("doc_id", "size", "text_crc32", F.col("g").alias("group"), "shard", slot.cast("long").alias("slot"))
