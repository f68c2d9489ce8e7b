"""Exact vector search and similarity joins that skip what cannot match: vectors in cells around centres, with bounds from angles.

A cell keeps the range of its members' cosines to its centre. By the triangle inequality of angles, that bounds the similarity of
its members to a query, and of two cells' members to each other; what stays below the wanted similarity is not read or joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import fresh_path, written

#: Bounds are widened by this much, more than the rounding of products of unit vectors.
SLACK = 1e-9

#: Blocks on each side of a tile of pairs.
TILE = 8

#: The cell of zero vectors, whose similarity to anything is 0.
ZERO = -1


def usable(e: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return e.isNotNull() & ~F.coalesce(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1))
    return x / np.where(n == 0, 1.0, n)[:, None]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def centres_of(sample: np.ndarray, cells: int, steps: int = 3) -> np.ndarray:
    """Directions of so many centres (or fewer) for unit vectors: some of them, moved to the middle of those nearest."""
    c = sample[:cells].copy()
    for _ in range(steps):
        near = (sample @ c.T).argmax(axis=1)
        for k in range(len(c)):
            own = sample[near == k].sum(axis=0)
            if own @ own > 1e-12:
                c[k] = own / math.sqrt(own @ own)
    return c


@dataclass
class Cells:
    """Vectors dealt to cells: ``table(cell, cos, id, unit)`` is written by cell, sorted by cosine to the centre. Arrays hold each
    cell's number, size, range of cosines and centre: at most ``most_cells`` + 1 of them, whatever the number of vectors."""

    table: DataFrame
    dims: int
    cell: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centres: np.ndarray

    def centre(self) -> np.ndarray:
        return np.where((self.cell == ZERO)[:, None], 0.0, self.centres[np.maximum(self.cell, 0)])


def cells_of(vectors: DataFrame, rows: int = 4096, most_cells: int = 1024, sample: int = 8192) -> Cells:
    """Deal ``vectors(id, embedding)`` to cells of about ``rows`` vectors, at most ``most_cells`` cells. Vectors that are null or hold null or
    non-finite components take no part, nor do those of another length than most. Centres come from at most ``sample`` vectors
    (those of the least hashes of their ids); every vector is dealt. Cells of any size are split over tasks as they are written."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & (F.size("embedding") > 0))
    usual = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    path = fresh_path(spark, "cells")
    if usual is None:
        none = spark.createDataFrame([], "cos double, id long, unit binary, cell int")
        return Cells(none, 0, *(np.zeros(0, np.int64) for _ in range(2)), *(np.zeros(0) for _ in range(2)), np.zeros((0, 0)))
    dims = usual["d"]
    v = v.where(F.size("embedding") == dims)
    wanted = max(1, min(most_cells, -(-usual["n"] // rows)))
    fit = _units(np.array([r[0] for r in v.orderBy(F.xxhash64("id"), "id").limit(min(sample, 8 * wanted)).select("embedding").collect()]))
    fit = fit[(fit * fit).sum(axis=1) > 0.5]
    centres = centres_of(fit, wanted) if len(fit) else np.eye(1, dims)
    shared = spark.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _units(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            cos = u @ shared.value.T
            near = cos.argmax(axis=1)
            zero = ~u.any(axis=1)
            own = np.where(zero, 0.0, cos[np.arange(len(u)), near])
            yield pa.record_batch([pa.array(own), batch.column(0), pa.array([r.tobytes() for r in u], pa.binary()), pa.array(np.where(zero, ZERO, near).astype(np.int32))], ["cos", "id", "unit", "cell"])

    dealt = v.mapInArrow(deal, "cos double, id long, unit binary, cell int")
    dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "cos").write.partitionBy("cell").parquet(path)
    table = spark.read.schema("cos double, id long, unit binary, cell int").parquet(path)
    meta = sorted(map(tuple, table.groupBy("cell").agg(F.count("*"), F.min("cos"), F.max("cos")).collect()))
    cell, size, low, high = (np.array(c) for c in zip(*meta))
    return Cells(table, dims, cell, size, low, high, centres)


def as_arrays(dims: int):
    """``id, embedding`` of rows ``(id, unit)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _matrix(batch.column(1), dims)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * dims, pa.int32()), pa.array(u.ravel()))], ["id", "embedding"])

    return run


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


# --------------------------------------------------------------------------- search


def bounds(cells: Cells, unit: np.ndarray) -> np.ndarray:
    """For each cell, what no member's similarity to the query exceeds."""
    theta, near, far = _angle(cells.centre() @ unit), _angle(cells.high), _angle(cells.low)
    between = np.maximum(0.0, np.maximum(theta - far, near - theta))
    return np.where((cells.cell == ZERO) | (not unit.any()), 0.0, np.cos(between)) + SLACK  # zero vectors are 0 to all


def _scored(rows: DataFrame, unit: np.ndarray, dims: int, limit: int, least: float | None) -> DataFrame:
    """``id, similarity``: what of ``rows(id, unit)`` reaches ``least``; with a limit, the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = np.zeros(0, np.int64), np.zeros(0)
        emit = lambda: pa.record_batch([pa.array(ids), pa.array(values)], ["id", "similarity"])
        for batch in batches:
            s = np.einsum("nd,d->n", _matrix(batch.column(1), dims), unit)  # row by row: equal vectors have equal results
            ids, values = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([values, s])
            if least is not None:
                ids, values = ids[values >= least], values[values >= least]
            if limit > 0:
                best = np.lexsort((ids, -values))[:limit]
                ids, values = ids[best], values[best]
            else:
                yield emit()
                ids, values = ids[:0], values[:0]
        yield emit()

    return rows.select("id", "unit").mapInArrow(run, "id long, similarity double")


def search(cells: Cells, query: list[float], limit: int, least: float | None = None, allowed: DataFrame | None = None, first: int = 4) -> tuple[DataFrame, dict]:
    """The rows of ``search.nearest``, by cells: ``id, similarity``, best first, ties to the smaller id; and what was read.

    The cells of the best bounds are read first; the last of the ``limit`` best found there is a similarity that the others must be
    able to reach, and those that can't are never opened (cells are folders of the table). In a cell that is opened, the range of
    cosines to the centre that can still matter goes to the scan. ``allowed(id)`` restricts the candidates. A query of another length
    finds nothing.
    """
    spark, q = cells.table.sparkSession, np.array(query, float)
    report = {"cells": len(cells.cell), "cells_read": 0, "vectors": int(cells.size.sum()), "vectors_in_cells_read": 0}
    if len(q) != cells.dims or not len(cells.cell):
        return spark.createDataFrame([], "id long, similarity double"), report
    unit = _units(q[None])[0]
    bound = bounds(cells, unit)
    order = np.argsort(-bound, kind="stable")
    reach = -2.0 if least is None else least

    def read(some: np.ndarray, reach: float) -> DataFrame:
        report["cells_read"] += len(some)
        report["vectors_in_cells_read"] += int(cells.size[some].sum())
        rows = cells.table.where(F.col("cell").isin([int(c) for c in cells.cell[some]]))
        if unit.any() and -1.0 < reach <= 1.0 and 0 < len(some) <= 64:
            alpha, theta, ranges = math.acos(reach), _angle(cells.centre() @ unit), F.lit(False)
            for k in some:
                lo, hi = math.cos(min(math.pi, theta[k] + alpha)), math.cos(max(0.0, theta[k] - alpha))
                within = F.col("cos").between(lo - SLACK, hi + SLACK) if cells.cell[k] != ZERO else F.lit(reach <= SLACK)
                ranges = ranges | ((F.col("cell") == int(cells.cell[k])) & within)
            rows = rows.where(ranges)
        if allowed is not None:
            rows = rows.join(allowed.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
        return _scored(rows, unit, cells.dims, limit, least)

    order = order[bound[order] >= reach]
    best = [F.desc("similarity"), F.col("id")]
    if limit <= 0:
        return read(order, reach).orderBy(*best), report
    if limit > 10_000 or len(order) <= first:
        return read(order, reach).orderBy(*best).limit(limit), report
    head = max(first, int(np.searchsorted(np.cumsum(cells.size[order]), limit)) + 1)
    found = read(order[:head], reach).orderBy(*best).limit(limit).collect()
    if len(found) == limit:
        reach = max(reach, found[-1]["similarity"])
    rest = order[head:][bound[order[head:]] >= reach]
    out = spark.createDataFrame([tuple(r) for r in found], "id long, similarity double")  # at most the limit
    if len(rest):
        out = out.unionByName(read(rest, reach))
    return out.orderBy(*best).limit(limit), report


# --------------------------------------------------------------------------- joins


def _blocks(cells: Cells, rows: int) -> DataFrame:
    """``cell, block, piece, low, high, ids, units``: about ``rows`` vectors of a cell in a range of cosines. Ranges follow from a histogram of
    each cell (a bounded number of bins); what shares a bin beyond ``rows`` is split by a hash of the id."""
    spark, bins = cells.table.sparkSession, 128
    at = F.floor((1 - F.col("cos")) * bins / 2).cast("int")
    counted = sorted(map(tuple, cells.table.groupBy("cell", at.alias("bin")).agg(F.count("*").alias("n")).collect()))
    plan, block, held, last = [], 0, 0, None
    for cell, b, n in counted:
        if cell != last or held + n > rows:
            block, held = block + 1, 0
        plan.append((cell, b, block, max(1, -(-n // rows))))
        held, last = held + n, cell
    dealt = cells.table.withColumn("bin", at).join(F.broadcast(spark.createDataFrame(plan, "cell int, bin int, block int, pieces int")), ["cell", "bin"])
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    packed = dealt.groupBy("cell", "block", piece.alias("piece")).agg(F.min("cos").alias("low"), F.max("cos").alias("high"), F.collect_list(F.struct("id", "unit")).alias("r"))
    return packed.select("cell", "block", "piece", "low", "high", F.col("r.id").alias("ids"), F.col("r.unit").alias("units"))


def _met(batch: pa.RecordBatch, dims: int, upper: bool):
    """Matrices and ids of the pairs of blocks that a tile asks for, and whether both are one block."""
    for r in range(batch.num_rows):
        sides = []
        for name in ("blocks_a", "blocks_b"):
            blocks = batch.column(name)[r].values
            keys, ids, units = (blocks.field(k) for k in ("key", "ids", "units"))
            sides.append({tuple(k.values()): (ids[i].values.to_numpy(), units[i].values) for i, k in enumerate(keys.to_pylist())})
        by: dict = {}
        for p in batch.column("asked")[r].as_py():
            by.setdefault(tuple(p["a"].values()), []).append(tuple(p["b"].values()))
        for key, others in by.items():
            ids_a, x = sides[0][key][0], _matrix(sides[0][key][1], dims)
            for other in others:
                yield x, ids_a, _matrix(sides[1][other][1], dims), sides[1][other][0], upper and key == other


def _products(least: float, dims: int, upper: bool):
    """Pairs of two blocks' rows whose product reaches the bound, one matrix product for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, ids_a, y, ids_b, same in _met(batch, dims, upper):
                for i in range(0, len(ids_a), 512):
                    s = x[i : i + 512] @ y.T
                    p, q = np.nonzero(s >= least)
                    a, b, value = ids_a[i:][p], ids_b[q], s[p, q]
                    if upper:  # both sides are the same rows: each pair once, the smaller id first
                        keep = a < b if same else a != b
                        a, b, value = np.minimum(a, b)[keep], np.maximum(a, b)[keep], value[keep]
                    for k in range(0, len(a), 50_000):
                        yield pa.record_batch([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000]), pa.array(value[k : k + 50_000])], ["a", "b", "similarity"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges with the components of these: each node but a component's smallest is tied to that."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        u, v = u[open_], v[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[root[tied]], nodes[tied]


def _forests(products, most: int = 2_000_000):
    """The pairs of a task as a forest: what is gathered is reduced whenever it holds ``most`` pairs, and twice what a forest keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, kept = [], 0, 0
        merged = lambda: forest(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        for batch in products(batches):
            parts.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            held += batch.num_rows
            if held >= max(most, 2 * kept):
                parts = [merged()]
                held = kept = len(parts[0][0])
        if parts:
            a, b = merged()
            for k in range(0, len(a), 50_000):
                yield pa.record_batch([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], ["a", "b"])

    return run


def _apart(theta: Column, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """The least angle between members of two blocks whose centres are ``theta`` apart."""
    near_a, far_a, near_b, far_b = (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) for c in (high_a, low_a, high_b, low_b))
    return F.greatest(F.lit(0.0), theta - far_a - far_b, near_a - far_b - theta, near_b - far_a - theta)


def joined(left: Cells, right: Cells, least: float, rows: int | None = None, upper: bool = False, linked: bool = False) -> tuple[DataFrame, dict]:
    """``a, b, similarity`` of all members of two tables whose cosine is at least ``least``; ``upper``: both are the same table, a < b.
    ``linked``: for components of one table alone, ``a, b`` of a forest for each task, with the components of all pairs.

    Pairs of cells, at most ``most_cells`` squared, are bounded by their centres on the driver; pairs of blocks in those that remain are
    bounded by their ranges, on small columns alone. Only blocks of the pairs left over travel and meet, one matrix product
    each. The report counts pairs of blocks and those that met. A block holds about ``rows`` vectors; unless told, 4096 of many vectors, as
    blocks travel once for each pair.
    """
    rows = rows or (4096 if max(left.size.sum(), right.size.sum(), 0) >= 65_536 else 2048)
    spark = left.table.sparkSession
    if not len(left.cell) or not len(right.cell) or left.dims != right.dims:
        return spark.createDataFrame([], "a long, b long" if linked else "a long, b long, similarity double"), {"block_pairs": 0, "block_pairs_joined": 0}
    theta = _angle(left.centre() @ right.centre().T)
    near_a, far_a, near_b, far_b = _angle(left.high)[:, None], _angle(left.low)[:, None], _angle(right.high), _angle(right.low)
    apart = np.maximum.reduce([np.zeros_like(theta), theta - far_a - far_b, near_a - far_b - theta, near_b - far_a - theta])
    zero = (left.cell == ZERO)[:, None] | (right.cell == ZERO)
    keep = np.where(zero, least <= SLACK, np.cos(apart) + SLACK >= least)
    if upper:
        keep &= left.cell[:, None] <= right.cell
    i, j = np.nonzero(keep)
    pairs = spark.createDataFrame([(int(left.cell[a]), int(right.cell[b]), float(theta[a, b])) for a, b in zip(i, j)], "ca int, cb int, theta double")
    a = written(_blocks(left, rows), "blocks")
    b = a if upper else written(_blocks(right, rows), "blocks")
    key = lambda x: x.select("cell", F.struct("cell", "block", "piece").alias("key"), "low", "high")
    both = pairs.join(key(a).withColumnsRenamed({"cell": "ca", "key": "a", "low": "la", "high": "ha"}), "ca").join(key(b).withColumnsRenamed({"cell": "cb", "key": "b", "low": "lb", "high": "hb"}), "cb")
    meet = F.when((F.col("ca") == ZERO) | (F.col("cb") == ZERO), F.lit(True)).otherwise(F.cos(_apart(F.col("theta"), F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"))) + SLACK >= least)
    both = written(both.where(meet & (F.col("a") <= F.col("b")) if upper else meet).select("a", "b"), "block-pairs")
    m, k = a.count(), (a if upper else b).count()
    report = {"block_pairs": m * (m + 1) // 2 if upper else m * k, "block_pairs_joined": both.count()}
    # Pairs lie in tiles of TILE times TILE blocks, in the order of cells; a block travels once for each tile and not for each pair.
    number = lambda x: x.select(F.struct("cell", "block", "piece").alias("key")).select("key", F.floor((F.row_number().over(W.orderBy("key")) - 1) / TILE).cast("int").alias("tile"))
    na = written(number(a), "tiles")  # a small row for each block
    nb = na if upper else written(number(b), "tiles")
    tiled = written(both.join(na.withColumnsRenamed({"key": "a", "tile": "ta"}), "a").join(nb.withColumnsRenamed({"key": "b", "tile": "tb"}), "b"), "tile-pairs")
    asked = tiled.groupBy("ta", "tb").agg(F.collect_list(F.struct("a", "b")).alias("asked"))  # at most TILE squared
    side = lambda x, n: tiled.select("ta", "tb", n).distinct().join(x.select(F.struct("cell", "block", "piece").alias(n), "ids", "units"), n).groupBy("ta", "tb").agg(F.collect_list(F.struct(F.col(n).alias("key"), "ids", "units")).alias(f"blocks_{n}"))
    rows_ = asked.join(side(a, "a"), ["ta", "tb"]).join(side(b, "b"), ["ta", "tb"]).select("asked", "blocks_a", "blocks_b")
    if linked:
        return rows_.mapInArrow(_forests(_products(least, left.dims, upper)), "a long, b long"), report
    return rows_.mapInArrow(_products(least, left.dims, upper), "a long, b long, similarity double"), report
