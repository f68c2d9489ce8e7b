"""Prefix tries of conversations: radix partitioning of dictionary-encoded turns, then multikey quicksort inside buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import clear_scratch, materialise, scratch_mark

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()

# --------------------------------------------------------------------------- rebuilt conversations


def placed(conversations: DataFrame) -> DataFrame:
    """``conv, pos, digest, size``: the turns with their places from 0, by turn (null first); null role or text is empty, rows without
    conv_id take no part. The digest is a SHA-256 of role and text and stands for both from here on, so no text is shuffled; turns
    of the same number go by it. ``size`` is the text's code points.

    Rows are dealt by ranges of all sort columns, so a conversation of any length spreads over tasks; a row's place is its number
    inside the range, less where the conversation began there, which takes one small row for each range and conversation in it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(named, 256)).alias("digest"), F.char_length(text).cast("long").alias("size")
    ).where("conv is not null")
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.select("conv", "digest", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    runs = dealt.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("conv", "part", "first", before.alias("before"))
    return dealt.join(starts, ["conv", "part"]).select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "digest", "size")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations with a shared head: the first h turns of conversation c - c % every, then the turns of c after its first h;
    h is the crc32 of c in decimal, modulo ``heads``. Returns turns in the columns of ``placed`` and all conversations ``conv``, also those
    that are left without turns. A head is copied to fewer than ``2 * every`` conversations."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = turns.select("conv").distinct()
    lead = turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads - 1)).select(F.col("conv").alias("lead"), "pos", "digest", "size")
    from_lead = convs.withColumn("h", h).withColumn("lead", F.col("conv") - F.col("conv") % every).join(lead, "lead").where("pos < h")
    had = from_lead.groupBy("conv").agg(F.count("*").alias("had"))
    own = turns.withColumn("h", h).where("pos >= h").join(had, "conv", "left")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.coalesce("had", F.lit(0))).alias("pos"), "digest", "size")
    return from_lead.select("conv", "pos", "digest", "size").unionByName(own), convs


def encoded(turns: DataFrame) -> DataFrame:
    """``conv, pos, tid, size``: each distinct turn gets a number; the numbers are settled by writing the dictionary."""
    words = materialise(turns.select("digest").distinct().withColumn("tid", F.monotonically_increasing_id()), "trie-dictionary")
    return turns.join(words, "digest").select("conv", "pos", "tid", "size")


# --------------------------------------------------------------------------- inside a bucket


def sorted_nodes(convs: list[int], turns: list[list[int]], sizes: list[list[int]], depth: int, size: int, parent: int | None) -> list[tuple]:
    """The nodes of a bucket, in the columns of ``NODES``, its first node first. ``turns`` and ``sizes`` are what the conversations have
    after the ``depth`` turns that they share; ``size`` is that of the last shared turn.

    Three-way radix (multikey) quicksort over the sequences of turn numbers: a range of sequences is split by one turn into
    smaller, equal and larger; the equal ones are a node one turn deeper. Ranges wait in a list, so depth isn't bound by Python's.
    """
    order = list(range(len(convs)))
    node = [(0, len(order), 0, -1)]  # range, depth and parent of each node; parents come before their children
    conv: list[int] = []
    n_children, ends = [], []
    while len(conv) < len(node):
        lo, hi, d, _ = node[len(conv)]
        members = order[lo:hi]
        conv.append(min(convs[i] for i in members))
        ended = [i for i in members if len(turns[i]) == d]
        ends.append(hashlib.sha256(",".join(map(str, sorted(convs[i] for i in ended))).encode()).hexdigest() if ended else NONE)
        order[lo:hi] = ended + [i for i in members if len(turns[i]) > d]
        count, ranges = 0, [(lo + len(ended), hi)]
        while ranges:
            a, b = ranges.pop()
            if a >= b:
                continue
            run = order[a:b]
            pivot = turns[run[len(run) // 2]][d]
            less, equal, more = [], [], []
            for i in run:
                t = turns[i][d]
                (less if t < pivot else more if t > pivot else equal).append(i)
            order[a:b] = less + equal + more
            x, y = a + len(less), b - len(more)
            node.append((x, y, d + 1, len(conv) - 1))
            count += 1
            ranges += [(a, x), (y, b)]
        n_children.append(count)
    leaves = [0 if c else 1 for c in n_children]
    saved = [(hi - lo - 1) * (sizes[order[lo]][d - 1] if d else size) for lo, hi, d, _ in node]
    for k in range(len(node) - 1, 0, -1):
        up = node[k][3]
        leaves[up] += leaves[k]
        saved[up] += saved[k]
    return [(conv[k], depth + d, parent if up < 0 else conv[up], hi - lo, n_children[k], leaves[k], saved[k], ends[k]) for k, (lo, hi, d, up) in enumerate(node)]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the buckets whose rows come one bucket after the other, by conversation and place. A bucket's first node also has the
    key of the bucket above it."""
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "up": pa.int64(), "up_depth": pa.int64()}
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(kinds)
        done = pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds.values())], [*kinds])
        out.clear()
        return done

    def close(held: list[list[np.ndarray]]) -> None:
        _, s, size, up, up_depth, conv, tid, sizes = (np.concatenate(c) for c in zip(*held))
        cut = np.flatnonzero(np.diff(conv)) + 1
        split = lambda x: [t.tolist() if t[0] >= 0 else [] for t in np.split(x, cut)]  # noqa: E731  without turns left: one row of -1
        top = up_depth[0] >= 0
        found = sorted_nodes(conv[np.concatenate([[0], cut])].tolist(), split(tid), split(sizes), int(s[0]), int(size[0]), int(up[0]) if top else None)
        out.extend((*n, int(up[0]), int(up_depth[0])) if k == 0 and top else (*n, None, None) for k, n in enumerate(found))

    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        borders = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        for lo, hi in zip([0, *borders], [*borders, batch.num_rows]):
            part = [c[lo:hi] for c in columns]
            if held and (held[0][0][0], held[0][1][0]) != (part[0][0], part[1][0]):
                close(held)
                held = []
            held.append(part)
            if len(out) >= 10_000:
                yield flush()
    if held:
        close(held)
    yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's list of conversations, which come sorted by node and number; a list is never held as a whole."""
    key, digest, out = None, None, []
    for batch in batches:
        for b, e, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (b, e) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (b, e), hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if len(out) > 10_000:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], ["b", "e", "sha"])
            out = []
    if key:
        out.append((*key, digest.hexdigest()))
        yield pa.record_batch([pa.array(c) for c in zip(*out)], ["b", "e", "sha"])


# --------------------------------------------------------------------------- the trie


def prefix_trie(conversations: DataFrame, local_rows: int = 50_000, every: int = 100, heads: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``), one row a node in the columns of ``NODES``.

    A node is a distinct sequence of first turns (role and text); ``conv_id``, the smallest conversation that starts with it, and ``depth``
    name it. ``saved_tokens`` sums, over the node's subtree, the members but one times the code points of the last text;
    ``ends_sha256`` digests the members that end there, as decimal numbers in ascending order, joined by commas. Null roles and texts are
    empty, rows without conv_id take no part, repeated rows are turns of their own, other columns are ignored; an empty table
    gives no rows, not even the root. A turn is told from another by the SHA-256 of both (``placed``).

    Most significant digit first: all conversations are one bucket at first. In each round, every bucket of over ``local_rows`` turns and
    conversations finds how far its conversations agree (counts, smallest and largest turn at each place, summed up in
    the tasks first), so a shared beginning of any length takes one round, and is dealt by the next turn into smaller
    buckets. The others go to one task each, at most ``local_rows`` rows, and are finished by ``sorted_nodes``. A bucket of equal
    conversations is done in one round, whatever its size; its list of conversations passes through one task as a stream,
    as the digest of a list needs it in order. Last, totals of subtrees go up, one small join a round.
    """
    spark = conversations.sparkSession
    mark = scratch_mark()
    turns, convs = rebuilt(materialise(placed(conversations), "trie-placed"), every, heads)
    seq = materialise(encoded(turns), "trie-sequences")
    length = seq.groupBy("conv").agg(F.count("*").alias("n"))
    live = materialise(convs.join(length, "conv", "left").select("conv", F.coalesce("n", F.lit(0)).alias("n")), "trie-conversations")
    first = live.agg(F.min("conv").alias("b"), F.count("*").alias("n_convs"), F.sum("n").alias("n_turns")).first()
    if not first["n_convs"]:
        return spark.createDataFrame([], NODES)
    root = (first["b"], 0, 0, None, -1, first["n_convs"], first["n_turns"])
    bucket = spark.createDataFrame([root], "b long, s long, size long, up long, up_depth long, n_convs long, n_turns long")
    live = live.withColumns({"b": F.lit(first["b"]), "s": F.lit(0).cast("long")})
    small, rounds = [], []
    while True:
        bucket = materialise(bucket, "trie-buckets")
        mine = bucket.where(F.col("n_turns") + F.col("n_convs") <= local_rows).select("b", "s", "size", "up", "up_depth")
        small.append(live.join(mine, ["b", "s"]))
        big = bucket.where(F.col("n_turns") + F.col("n_convs") > local_rows)
        if big.isEmpty():
            break
        live = live.join(big.select("b", "s"), ["b", "s"])
        ahead = materialise(seq.join(live, "conv").where("pos >= s"), "trie-ahead")
        at = ahead.groupBy("b", "s", "pos").agg(F.count("*").alias("k"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min("size").alias("at_size"))
        at = at.join(big.select("b", "s", "n_convs"), ["b", "s"])
        agree = (F.col("k") == F.col("n_convs")) & (F.col("lo") == F.col("hi"))
        found = at.groupBy("b", "s").agg(F.coalesce(F.min(F.when(~agree, F.col("pos"))), F.max("pos") + 1).alias("e"))
        upper = materialise(big.join(found, ["b", "s"], "left").withColumn("e", F.coalesce("e", "s")), "trie-upper")
        reach = upper.select("b", "s", "e")
        path = materialise(at.join(reach, ["b", "s"]).where("pos < e").select("b", "s", (F.col("pos") + 1).alias("depth"), "at_size"), "trie-paths")
        ends = live.join(reach, ["b", "s"]).where("n = e").select("b", "e", "conv")
        ends = ends.repartition("b", "e").sortWithinPartitions("b", "e", "conv").mapInArrow(_digests, "b long, e long, sha string")
        rounds.append((upper, path, materialise(ends, "trie-ends")))
        split = ahead.join(reach, ["b", "s"]).where("pos = e")
        kids = split.groupBy("b", "s", "e", "tid").agg(F.min("conv").alias("first"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("e") - 1).alias("n_turns"), F.min("size").alias("size"))
        kids = materialise(kids, "trie-kids")
        bucket = kids.select(F.col("first").alias("b"), (F.col("e") + 1).alias("s"), "size", F.col("b").alias("up"), F.col("s").alias("up_depth"), "n_convs", "n_turns")
        live = split.select("b", "s", "conv", "n", "tid").join(kids.select("b", "s", "tid", "first", "e"), ["b", "s", "tid"])
        live = materialise(live.select("conv", "n", F.col("first").alias("b"), (F.col("e") + 1).alias("s")), "trie-live")

    mine = small[0]
    for x in small[1:]:
        mine = mine.unionByName(x)
    rest = seq.select(F.col("conv").alias("c"), "pos", "tid", F.col("size").alias("turn_size"))
    rows = mine.join(rest, (F.col("conv") == F.col("c")) & (F.col("pos") >= F.col("s")), "left")
    none = F.lit(-1).cast("long")
    rows = rows.select("b", "s", "size", F.coalesce("up", none).alias("up"), "up_depth", "conv", F.coalesce("tid", none).alias("tid"), F.coalesce("turn_size", none).alias("turn_size"), "pos")
    rows = rows.repartition("b", "s").sortWithinPartitions("b", "s", "conv", "pos").drop("pos")
    nodes = materialise(rows.mapInArrow(_local, f"{NODES}, up long, up_depth long"), "trie-local")

    columns = [c.split()[0] for c in NODES.split(", ")]
    top = nodes.where("up is not null").select("up", "up_depth", "n_leaves", "saved_tokens")
    out = [nodes.select(*columns)]
    for upper, path, ends in reversed(rounds):
        below = top.groupBy("up", "up_depth").agg(F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved_below"), F.count("*").alias("n_kids"))
        u = upper.join(below.withColumnsRenamed({"up": "b", "up_depth": "s"}), ["b", "s"], "left")
        u = u.withColumns({"below": F.coalesce("below", F.lit(1)), "saved_below": F.coalesce("saved_below", F.lit(0)), "n_kids": F.coalesce("n_kids", F.lit(0))}).drop("up_depth", "n_turns")
        every_ = u.select("b", "s", F.col("s").alias("depth"), F.col("size").alias("at_size")).unionByName(path)
        every_ = every_.withColumn("chunk", F.expr("depth div 4096"))
        chunks = every_.groupBy("b", "s", "chunk").agg(F.sum("at_size").alias("whole"))
        later = F.coalesce(F.sum("whole").over(W.partitionBy("b", "s").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = every_.join(chunks.select("b", "s", "chunk", later.alias("later")), ["b", "s", "chunk"])
        own = F.sum("at_size").over(W.partitionBy("b", "s", "chunk").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0))
        sizes = sizes.select("b", "s", "depth", (own + F.col("later")).alias("from_here"))
        n = sizes.join(u, ["b", "s"]).join(ends, ["b", "e"], "left")
        last = F.col("depth") == F.col("e")
        n = n.select(
            F.col("b").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("s"), F.col("up")).otherwise(F.col("b")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("n_kids")).otherwise(1).alias("n_children"), F.col("below").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("from_here") + F.col("saved_below")).alias("saved_tokens"), F.when(last, F.coalesce("sha", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"), "s",
        )
        n = materialise(n, "trie-nodes")
        out.append(n.select(*columns))
        firsts = upper.where("up is not null").select("b", "s", "up", "up_depth")
        top = top.unionByName(n.where("depth = s").join(firsts.withColumnRenamed("b", "conv_id"), ["conv_id", "s"]).select("up", "up_depth", "n_leaves", "saved_tokens"))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    whole = materialise(whole, "trie")
    clear_scratch(spark, mark, keep=(whole,))
    return whole
