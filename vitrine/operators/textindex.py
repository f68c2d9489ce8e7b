"""A stored text index of several fields: immutable segments, tombstones, running statistics, and BM25 search that reads only
the regions of documents that can still be among the best.

Folder layout, a number (``seg``) for each write: ``docs`` (the documents with their terms, as one string of them and the bytes of their
frequencies, so that a document travels as two values and not as nested ones), ``postings`` (a term's documents, by region),
``stats`` (what a write adds to document counts and lengths; deletions subtract), ``dead`` (documents of older segments that are gone),
and ``manifest``, whose last row says what counts. A write is visible once its manifest row is.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stems as ST

K1, B = 1.2, 0.75
DOCS = "id long, length long, n int, words string, f binary"  # n: distinct terms; words: these with spaces between; f: float64 each
#: Documents whose terms a task holds at once while it counts them; postings of a region, about.
ROWS, POSTINGS = 256, 1_000_000


POSTED = "term string, range int, piece int, most double, least long, n long, docs array<struct<id:long,f:double,length:long>>"


def _inverted(region: pa.Table) -> pa.Table:
    """The postings of one region from its documents ``range, piece, id, length, words, f``, each with a term at least."""
    region = region.combine_chunks()
    get = lambda name: region.column(name).combine_chunks()
    terms, f = pc.split_pattern(get("words"), " "), np.frombuffer(b"".join(get("f").to_pylist()), np.float64)
    doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    code = terms.flatten().dictionary_encode()
    order = np.argsort(code.indices.to_numpy(), kind="stable")
    doc, f = doc[order], f[order]
    ids, length = get("id").to_numpy()[doc], get("length").to_numpy()[doc]
    n = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
    ends = np.concatenate([[0], np.cumsum(n)])
    per = lambda ufunc, x: ufunc.reduceat(x, ends[:-1]) if len(n) else x
    docs = pa.StructArray.from_arrays([pa.array(ids), pa.array(f), pa.array(length)], ["id", "f", "length"])
    same = lambda name: pa.array(np.full(len(n), get(name)[0].as_py(), np.int32))
    columns = [code.dictionary, same("range"), same("piece"), pa.array(per(np.maximum, f)), pa.array(per(np.minimum, length)), pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), docs)]
    return pa.Table.from_arrays(columns, ["term", "range", "piece", "most", "least", "n", "docs"])


def _below(borders: list[int], length: Column) -> Column:
    """How many of the ascending borders are below the length, by halving: as many steps as the number of borders has bits."""
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    if not steps:
        return F.lit(0)
    at = F.lit([*borders, *[2**63 - 1] * (2 * steps[0] - len(borders))]).cast("array<long>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: n + F.when(F.element_at(at, n + step) < length, step).otherwise(0))


@dataclass(frozen=True)
class TextIndex:
    """An index at ``path`` over ``fields``; a term's frequency is the weighted sum of its numbers in the fields, a document's length the
    number of all its terms. ``stem``: terms are English stems. ``region``: documents in a region, about."""

    spark: SparkSession
    path: str
    fields: tuple[str, ...]
    weights: tuple[float, ...] = ()
    stem: bool = False
    region: int = 4096

    # ------------------------------------------------------------------ writing

    def upsert(self, docs: DataFrame) -> None:
        """Add ``docs(id, fields...)``; those whose id is there already replace what was there. Ids must be unique in ``docs``; a null id takes
        no part, null fields are empty. One write: a segment of the new documents, tombstones of the old ones."""
        state, seg = self._state(), self._next()
        self._docs_of(docs).write.parquet(f"{self.path}/docs/seg={seg}")
        new = self._docs([seg])
        self._post(new, seg)
        self._bury(state, seg, new.select("id"), new)
        self._commit(seg, [*state["live"], seg], [*state["log"], seg])

    def delete(self, ids: DataFrame) -> None:
        """Take the documents ``ids(id)`` out; unknown ids don't matter."""
        state, seg = self._state(), self._next()
        self._bury(state, seg, ids.select(F.col("id").cast("long").alias("id")).distinct(), None)
        self._commit(seg, state["live"], [*state["log"], seg])

    def merge(self, factor: int = 4) -> list[int]:
        """Merge small segments: from the smallest on, each that is at most ``factor`` times as large as those before it together. Tombstones in
        them and the pieces of statistics go as well. Returns the merged segments (none: there was nothing to do)."""
        state = self._state()
        sizes = sorted((r["n"], r["seg"]) for r in self._docs(state["live"]).groupBy("seg").agg(F.count("*").alias("n")).collect()) if state["live"] else []
        some, total = [], 0
        for n, s in sizes:
            if some and n > factor * total:
                break
            some, total = [*some, s], total + n
        if len(some) < 2 and not (len(some) == 1 and len(state["log"]) > 1):
            return []
        seg, dead = self._next(), self._dead(state)
        stay = self._docs(some).join(dead, ["id", "seg"], "left_anti").drop("seg")
        stay.write.parquet(f"{self.path}/docs/seg={seg}")
        self._post(self._docs([seg]), seg)
        self._stats(state).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where("df <> 0").write.parquet(f"{self.path}/stats/seg={seg}")
        dead.where(~F.col("seg").isin(some)).select("id", F.col("seg").alias("of")).write.parquet(f"{self.path}/dead/seg={seg}")
        self._commit(seg, [*(s for s in state["live"] if s not in some), seg], [seg])
        return some

    def _docs_of(self, docs: DataFrame) -> DataFrame:
        """Rows of ``DOCS``: each document's terms are counted where it is read."""
        weights, stem = self.weights or (1.0,) * len(self.fields), self.stem

        def counted(own: list[list[str]]) -> Counter:
            f: Counter = Counter()
            for some, w in zip(own, weights):
                if w == 1:
                    f.update(some)
                else:
                    for t, k in Counter(some).items():
                        f[t] += w * k
            return f

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                    sizes, n, words, fs = [], [], [], []
                    for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                        own = [ST.terms_of(text, stem) for text in row]
                        f = counted(own)
                        sizes.append(sum(map(len, own)))
                        n.append(len(f))
                        words.append(" ".join(f))
                        fs.append(np.fromiter(f.values(), np.float64, len(f)).tobytes())
                    yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int32()), pa.array(words, pa.string()), pa.array(fs, pa.binary())], ["id", "length", "n", "words", "f"])

        picked = docs.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in self.fields]).where("id is not null")
        cores = self.spark.sparkContext.defaultParallelism
        if picked.rdd.getNumPartitions() < cores:  # a table of few files is dealt to all tasks
            picked = picked.repartition(cores)
        return picked.mapInArrow(run, DOCS)

    def _post(self, docs: DataFrame, seg: int) -> None:
        """Postings of the segment. A region holds documents of like lengths, as these bound what a frequency is worth; regions of one
        length are split by a hash of the id, so no row or task holds more than a region of any term. Documents travel with their
        terms as they are, and a region is inverted in its task."""
        n = docs.count()
        regions = max(1, min(1024, n // self.region))
        borders = docs.agg(F.percentile_approx("length", [k / regions for k in range(1, regions)], 10_000)).first()[0] if regions > 1 else []
        d = docs.withColumn("range", _below(sorted(set(borders)), F.col("length")))
        parts = d.groupBy("range").agg(F.greatest(F.ceil(F.count("*") / (2 * self.region)), F.ceil(F.sum("n") / POSTINGS)).alias("pieces"))  # at most 1024 rows
        d = d.join(F.broadcast(parts), "range").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        p = d.where("n > 0").select("range", "piece", "id", "length", "words", "f").groupBy("range", "piece").applyInArrow(_inverted, POSTED)
        p.sortWithinPartitions("term", "range", "piece").write.parquet(f"{self.path}/postings/seg={seg}")

    def _bury(self, state: dict, seg: int, ids: DataFrame, new: DataFrame | None) -> None:
        """Tombstones and statistics of a write: what of ``ids`` was there goes, ``new`` comes. Which documents go is found by their ids; terms are
        read of those alone, and those of ``new`` are counted in its postings, which are written before."""
        parts = []

        def change(df: DataFrame, d: DataFrame, sign: int) -> None:
            total = d.agg((sign * F.count("*")).alias("df"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("length"))
            parts.append(df.groupBy("term").agg((sign * F.sum("n")).alias("df")).select("term", "df", F.lit(0).cast("long").alias("length")))
            parts.append(total.select(F.lit(None).cast("string").alias("term"), "df", "length"))

        if state["live"]:
            gone = self._docs(state["live"]).select("id", "seg").join(self._dead(state), ["id", "seg"], "left_anti").join(ids, "id", "left_semi")
            gone.select("id", F.col("seg").alias("of")).write.parquet(f"{self.path}/dead/seg={seg}")
            gone = self._dead({"log": [seg]})
            if not gone.isEmpty():
                d = self._docs(state["live"]).join(gone, ["id", "seg"], "left_semi")
                change(d.where("n > 0").select(F.explode(F.split("words", " ")).alias("term"), F.lit(1).cast("long").alias("n")), d, -1)
        if new is not None:
            change(self._part("postings", "term string, n long", [seg]), new, 1)
        if parts:
            reduce(DataFrame.unionByName, parts).write.parquet(f"{self.path}/stats/seg={seg}")

    # ------------------------------------------------------------------ what counts

    def _manifests(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema("seg int, live array<int>, log array<int>").parquet(f"{self.path}/manifest") if there else None

    def _state(self) -> dict:
        """The last manifest row: segments with live documents, and writes whose statistics and tombstones count."""
        rows = self._manifests()
        last = rows.orderBy(F.desc("seg")).first() if rows is not None else None
        return {"seg": last["seg"], "live": list(last["live"]), "log": list(last["log"])} if last else {"seg": 0, "live": [], "log": []}

    def _next(self) -> int:
        return self._state()["seg"] + 1

    def _commit(self, seg: int, live: list[int], log: list[int]) -> None:
        self.spark.createDataFrame([(seg, live, log)], "seg int, live array<int>, log array<int>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _part(self, name: str, schema: str, segs: list[int]) -> DataFrame:
        """Rows of some writes; folders that a write didn't need are not there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [f"{self.path}/{name}/seg={s}" for s in segs]
        at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        have = [p for p, a in zip(paths, at) if a.getFileSystem(conf).exists(a)]
        if not have:
            return self.spark.createDataFrame([], f"{schema}, seg int")
        return self.spark.read.schema(f"{schema}, seg int").option("basePath", f"{self.path}/{name}").parquet(*have)

    def _docs(self, segs: list[int]) -> DataFrame:
        return self._part("docs", DOCS, segs)

    def _stats(self, state: dict) -> DataFrame:
        return self._part("stats", "term string, df long, length long", state["log"])

    def _dead(self, state: dict) -> DataFrame:
        return self._part("dead", "id long, of int", state["log"]).select("id", F.col("of").alias("seg"))

    # ------------------------------------------------------------------ search

    def search(self, words: list[str], limit: int = 100, every: bool = False, allowed: DataFrame | None = None, first: int = 8) -> tuple[DataFrame, dict]:
        """``id, score``: the ``limit`` best documents (0: all) with any of the words (``every``: with all), best first, ties to the smaller
        id; and how many regions there were and were read. ``allowed(id)`` restricts the candidates; statistics stay those of the
        whole index. No words find nothing.

        BM25 with ``K1`` and ``B``, rounded to 12 digits, so that equal documents tie. Each region's postings of a word carry their largest frequency and smallest length, so the sum over words
        bounds the score of every document in it. The ``first`` regions of the largest bounds are scored; the last of the best found
        is a score that other regions must be able to reach, and the postings of those that can't are not read.
        """
        empty = self.spark.createDataFrame([], "id long, score double")
        state, wanted = self._state(), sorted({t for w in words for t in ST.terms_of(w, self.stem)})
        report = {"regions": 0, "regions_read": 0}
        if not wanted or not state["live"]:
            return empty, report
        known = self._stats(state).where(F.col("term").isin(wanted) | F.col("term").isNull()).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).collect()
        df = {r["term"]: r["df"] for r in known}
        n, total = df.pop(None, 0), sum(r["length"] for r in known)
        if not n or not total or (every and any(not df.get(w) for w in wanted)):
            return empty, report
        mean = total / n
        idf = {w: max(1e-6, math.log((n - k + 0.5) / (k + 0.5))) for w, k in df.items() if k > 0}
        if not idf:
            return empty, report
        weight = F.element_at(F.create_map(*[F.lit(x) for w, v in sorted(idf.items()) for x in (w, v)]), F.col("term"))
        worth = lambda f, length: weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
        hit = self._part("postings", POSTED, state["live"]).where(F.col("term").isin(sorted(idf)))
        region = hit.groupBy("seg", "range", "piece").agg(F.sum(worth(F.col("most"), F.col("least"))).alias("bound"), F.count("*").alias("words"))
        if every:
            region = region.where(F.col("words") == len(wanted))

        def scored(regions: DataFrame | None, at: Column | None) -> DataFrame:
            own = hit if at is None else hit.where(at)
            own = own if regions is None else own.join(regions.select("seg", "range", "piece"), ["seg", "range", "piece"], "left_semi")
            d = own.select("seg", "term", F.explode("docs").alias("d")).select("seg", "term", "d.id", "d.f", "d.length")
            if len(state["log"]) > 1 or state["live"] != state["log"]:
                d = d.join(self._dead(state), ["id", "seg"], "left_anti")
            if allowed is not None:
                d = d.join(allowed.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
            s = d.groupBy("id").agg(F.round(F.sum(worth(F.col("f"), F.col("length"))), 12).alias("score"), F.count("*").alias("words"))
            return (s.where(F.col("words") == len(wanted)) if every else s).select("id", "score")

        best = [F.desc("score"), F.col("id")]
        if limit <= 0 or limit > 10_000:
            out = scored(None, None).orderBy(*best)
            return (out if limit <= 0 else out.limit(limit)), report
        head = [(r["seg"], r["range"], r["piece"], r["bound"]) for r in region.orderBy(F.desc("bound"), "seg", "range", "piece").limit(first).collect()]
        report["regions"], report["regions_read"] = region.count() if len(head) == first else len(head), len(head)
        top = self.spark.createDataFrame(head, "seg int, range int, piece int, bound double")
        within = lambda some: F.col("range").isin(sorted({r for _, r in some})) & F.col("seg").isin(sorted({s for s, _ in some}))
        found = scored(F.broadcast(top), within([h[:2] for h in head])).orderBy(*best).limit(limit).collect() if head else []
        out = self.spark.createDataFrame([tuple(r) for r in found], "id long, score double")  # at most the limit
        if report["regions"] > len(head):
            least = found[-1]["score"] if len(found) == limit else 0.0
            rest = region.where(F.col("bound") >= least - 1e-9).join(F.broadcast(top), ["seg", "range", "piece"], "left_anti")
            ranges = rest.groupBy("seg", "range").agg(F.count("*").alias("n")).collect()  # at most 1024 for each segment
            report["regions_read"] += sum(r["n"] for r in ranges)
            if ranges:
                out = out.unionByName(scored(rest, within([(r["seg"], r["range"]) for r in ranges])))
        return out.orderBy(*best).limit(limit), report
