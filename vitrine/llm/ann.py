"""Nearest neighbours by inner product with additive quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def train_codebooks(sample: np.ndarray, books: int, words: int, steps: int = 6, seed: int = 5) -> np.ndarray:
    """Full-dimensional residual codebooks (books, words, dimensions): each is fitted by k-means to what the ones before
    leave of the unit directions in ``sample``.
    """
    rng = np.random.RandomState(seed)
    rest = sample.astype(np.float32)
    out = np.zeros((books, words, sample.shape[1]), np.float32)
    for m in range(books):
        own = min(words, len(rest))
        book = rest[rng.permutation(len(rest))[:own]].copy()
        for _ in range(steps):
            near = np.argmin((book * book).sum(1) - 2 * rest @ book.T, axis=1)
            size = np.bincount(near, minlength=own)
            order = np.argsort(near, kind="stable")
            sums = np.add.reduceat(rest[order], np.concatenate([[0], np.cumsum(size)[:-1]]).clip(0, len(rest) - 1), axis=0)
            book[size > 0] = sums[size > 0] / size[size > 0, None]
        out[m, :own] = book
        rest = rest - book[np.argmin((book * book).sum(1) - 2 * rest @ book.T, axis=1)]
    return out


def encode(vectors: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) by beam search, and the stored norms: what scales a code's sum to the vector's length.

    After each codebook the ``beam`` partial sums nearest to the direction go on, not only the nearest one.
    """
    length = np.linalg.norm(vectors.astype(np.float64), axis=1)
    unit = (vectors / length[:, None]).astype(np.float32)
    codes = np.zeros((len(unit), len(books)), np.uint8)
    scale = np.zeros(len(unit), np.float32)
    for a in range(0, len(unit), 512):
        rest = unit[a : a + 512, None, :]
        n, kept = len(rest), np.zeros((len(rest), 1, 0), np.uint8)
        for book in books:
            error = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1) - 2 * rest @ book.T
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
            old, word = np.divmod(best, book.shape[0])
            rest = np.take_along_axis(rest, old[:, :, None], 1) - book[word]
            kept = np.concatenate([np.take_along_axis(kept, old[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        win = np.argmin((rest * rest).sum(2), axis=1)
        codes[a : a + 512] = kept[np.arange(n), win]
        built = np.linalg.norm(unit[a : a + 512] - rest[np.arange(n), win], axis=1)
        scale[a : a + 512] = length[a : a + 512] / np.maximum(built, 1e-12)
    return codes, scale


def usable(column: Column) -> Column:
    """Whether a vector takes part: not null or zero, all components present and finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _scores(tables: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """What lookup tables (queries, books, words) give for every code (books, n): (queries, n), in single precision.

    The tables of all these queries lie side by side, so a code's words are looked up once for all of them.
    """
    beside = np.ascontiguousarray(tables.transpose(1, 2, 0))
    total, one = beside[0].take(codes[0], axis=0), np.empty((codes.shape[1], len(tables)), np.float32)
    for table, words in zip(beside[1:], codes[1:]):
        total += table.take(words, axis=0, out=one, mode="clip")
    total *= scale[:, None]
    return np.ascontiguousarray(total.T)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    books: int = 24,
    words: int = 256,
    beam: int = 4,
    rerank: int | None = None,
    sample: int = 4096,
    block: int = 8192,
    query_block: int = 512,
    group: int = 128,
    tile: tuple[int, int] = (4096, 32768),
) -> DataFrame:
    """The ``k`` nearest rows by inner product for each query row of ``vectors(vec_id, embedding)``.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller vec_id; ``score`` is the inner product
    of the original vectors in double precision. A row is no candidate for a query of its own vec_id. Rows without
    vec_id, vectors that are null, zero, hold null or non-finite components, or have another length than most, take no
    part. Repeated rows count once. Vectors are kept and scored in double precision. Other columns are ignored; an empty table gives no rows.

    Codebooks are fitted on at most ``sample`` vectors, those of the least hashes of their ids (the documented bound of
    what comes to the driver, and no task sorts more); every row is indexed. Equal vectors share one entry with their k + 1 smallest ids, which is all that
    any query can return of them. Codes, norms and entry numbers are packed into blocks; every block of queries meets every block
    of codes once, in tasks of one block of queries and at most about ``group`` blocks of codes, and scores it by lookup tables of inner products with all
    codewords; a task hands on the best of each query, not of each block. No side of that join is broadcast. Vectors don't take part in that: only the best
    entries of each query over all blocks, ``rerank`` (by default three times the root of their number) or a twentieth of all (but 100 at least) if that is less, are joined with
    their vectors and reranked exactly. For that, queries and entries are dealt to tiles of about ``tile``: an entry's vector travels
    once for each group of queries, not for each query that it is a candidate of.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("query"))
    v = v.where("vec_id is not null").where(usable(F.col("embedding")))
    usual = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], empty)
    dims = usual["d"]
    v = v.where(F.size("embedding") == dims)
    place = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = v.select("vec_id", "embedding").distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialise(entries.withColumn("entry", F.monotonically_increasing_id()), "ann-entries")  # numbers are settled once written
    count = entries.count()
    best = max(100, min(rerank or round(3 * count**0.5), count // 20))
    at = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(29)), F.lit(1 << 30))
    below = (1 << 30) if count <= sample else int((sample + 4 * sample**0.5) / count * (1 << 30)) + 1
    some = entries.where(at < below).select("embedding", F.col("ids")[0].alias("first"), at.alias("at")).orderBy("at", "first").limit(sample)
    fit = np.array([r[0] for r in some.collect()], np.float64)
    fit /= np.linalg.norm(fit, axis=1)[:, None]
    shared = spark.sparkContext.broadcast(train_codebooks(fit, books, words))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                codes, scale = encode(_matrix(part.column(0), dims), shared.value, beam)
                row = {"codes": np.ascontiguousarray(codes.T).tobytes(), "scales": scale.tobytes(), "entries": part.column(1).to_numpy().tobytes()}
                yield pa.RecordBatch.from_pylist([row])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = -(-batch.num_rows // max(1, -(-batch.num_rows // query_block)))  # blocks of like size
            for a in range(0, batch.num_rows, size or 1):
                part = batch.slice(a, size)
                yield pa.RecordBatch.from_pylist([{"q_ids": part.column(0).to_numpy().tobytes(), "q_vectors": _matrix(part.column(1), dims).tobytes()}])

    tasks = int(max(1, -(-count // block)))
    indexed = entries.select("embedding", "entry").repartition(tasks).mapInArrow(index, "codes binary, scales binary, entries binary")
    indexed = materialise(indexed, "ann-index")
    asked = v.where("query").select("vec_id", "embedding").distinct()
    queries = materialise(asked.repartition(max(1, tasks // 4)).mapInArrow(pack, "q_ids binary, q_vectors binary"), "ann-queries")

    def top(score: np.ndarray, n: int) -> np.ndarray:
        return np.argpartition(-score, n)[:n] if len(score) > n else np.arange(len(score))

    n_blocks, n_queries = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q_ids") / 8), F.lit(0)).cast("long")).first()
    query_tiles, entry_tiles = max(1, -(-n_queries // tile[0])), max(1, -(-count // tile[1]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query over the blocks of codes that follow one another for its block of queries."""
        books_, held = shared.value, None

        def lists() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(q), 64):
                rows = []
                for i in range(a, min(a + 64, len(q))):
                    keep = top(score[i], best)
                    rows.append((int(q_ids[i]), q[i].tobytes(), own[i][keep].tobytes(), score[i][keep].tobytes()))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["query_id", "asked", "entries", "approx"])

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: E731, B023
                now = [batch.column(c)[r].as_py() for c in ("q_ids", "q_vectors")]
                if now != held:
                    if held is not None:
                        yield from lists()
                    held, q_ids, q = now, np.frombuffer(now[0], np.int64), np.frombuffer(now[1], np.float64).reshape(-1, dims)
                    tables = np.einsum("qd,mwd->qmw", q.astype(np.float32), books_, optimize=True)
                    own, score, floor = [np.zeros(0, np.int64)] * len(q), [np.zeros(0, np.float32)] * len(q), np.full(len(q), np.nan, np.float32)
                codes, scale, entry = get("codes", np.uint8).reshape(len(books_), -1).astype(np.intp), get("scales", np.float32), get("entries", np.int64)
                for a in range(0, len(q), 32):
                    for i, s in enumerate(_scores(tables[a : a + 32], codes, scale), a):
                        near = np.flatnonzero(~(s <= floor[i]))  # what can't be among the best is not looked at again; no floor yet: all
                        own[i], score[i] = np.concatenate([own[i], entry[near]]), np.concatenate([score[i], s[near]])
                        if len(score[i]) > 2 * best:
                            keep = top(score[i], best)
                            own[i], score[i] = own[i][keep], score[i][keep]
                            floor[i] = score[i].min()
        if held is not None:
            yield from lists()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query, whose rows come one after the other, by tile; no more than two lists of it are held."""
        query, asked_, own, score = None, b"", np.zeros(0, np.int64), np.zeros(0, np.float32)

        def done() -> pa.RecordBatch:
            at = own % entry_tiles
            order = np.argsort(at, kind="stable")
            tiles, first = np.unique(at[order], return_index=True)
            parts = [x.tobytes() for x in np.split(own[order], first[1:])]
            return pa.record_batch([pa.array(np.full(len(tiles), query, np.int64)), pa.array([asked_] * len(tiles), pa.binary()), pa.array(tiles), pa.array(parts, pa.binary())], ["query_id", "asked", "entry_tile", "entries"])

        for batch in batches:
            for n, x, e, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (n, x) != (query, asked_):
                    if query is not None:
                        yield done()
                    query, asked_, own, score = n, x, own[:0], score[:0]
                own, score = np.concatenate([own, np.frombuffer(e, np.int64)]), np.concatenate([score, np.frombuffer(s, np.float32)])
                keep = top(score, best)
                own, score = own[keep], score[keep]
        if query is not None:
            yield done()

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query's candidates in a tile, but those that k + 1 others of the tile surpass: one of these may be the query itself."""
        entry = right["entry"].to_numpy()
        order = np.argsort(entry)
        entry, x = entry[order], _matrix(right["embedding"].combine_chunks(), dims)
        rows, score = [], []
        for q, e in zip(left["asked"].to_pylist(), left["entries"].to_pylist()):
            at = order[np.searchsorted(entry, np.frombuffer(e, np.int64))]
            s = np.einsum("nd,d->n", x[at], np.frombuffer(q, np.float64))
            if len(s) > k + 1:
                keep = ~(s < np.partition(s, len(s) - k - 1)[len(s) - k - 1])
                at, s = at[keep], s[keep]
            rows.append(at)
            score.append(s)
        ids = np.repeat(left["query_id"].to_numpy(), np.array([len(s) for s in score], np.int64))
        at = np.concatenate([np.zeros(0, np.int64), *rows])
        return pa.table({"query_id": pa.array(ids, pa.int64()), "ids": right["ids"].combine_chunks().take(pa.array(at)), "score": pa.array(np.concatenate([np.zeros(0), *score]))})

    dealt = queries.repartition(max(1, min(n_blocks, 1024)))
    pairs = dealt.hint("shuffle_replicate_nl").crossJoin(indexed.repartition(-(-tasks // group)))
    lists = pairs.select("q_ids", "q_vectors", "codes", "scales", "entries").mapInArrow(search, "query_id long, asked binary, entries binary, approx binary")
    chosen = lists.repartition("query_id").sortWithinPartitions("query_id", "asked").mapInArrow(merge, "query_id long, asked binary, entry_tile long, entries binary")
    chosen = materialise(chosen, "ann-candidates", batch_rows=16)  # a row of ``pairs`` holds two blocks
    chosen = chosen.withColumn("query_tile", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles)))
    placed = entries.withColumn("entry_tile", F.col("entry") % entry_tiles).withColumn("query_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_tiles - 1).cast("long"))))
    near = chosen.groupBy("query_tile", "entry_tile").cogroup(placed.groupBy("query_tile", "entry_tile"))
    found = near.applyInArrow(exact, "query_id long, ids array<long>, score double")
    found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
