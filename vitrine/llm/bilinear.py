"""A log-bilinear language model over word units, fitted by noise-contrastive estimation, and corpus counts beneath it."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_scratch, frugal, materialise, scratch_mark, slices, text_buffers

#: The token after each text's last word; no word is empty.
END = b""

#: Words that tasks know by heart: at most so many, of at most so many bytes (a broadcast of a few MB, whatever the corpus).
KNOWN, LONGEST = 1 << 18, 64


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (``bytes.lower`` and ``bytes.split`` know ASCII only)."""
    return text.encode().lower().split() if text else []


# --------------------------------------------------------------------------- the model


@dataclass
class LogBilinear:
    """log P(unit | context) = log softmax(q[unit] . r + b[unit]), where r = sum over the last words of c[i] * e[word i], component by component."""

    units: int
    size: int = 16
    context: int = 3
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, counts: np.ndarray, size: int = 16, context: int = 3, seed: int = 12) -> LogBilinear:
        """A model that gives the units' own frequencies whatever the context. The last row of ``e`` stands for the place before a text."""
        rng, n = np.random.RandomState(seed), len(counts)
        bias = np.log((counts + 1.0) / (counts + 1.0).sum())
        w = {"e": rng.normal(0, 0.5, (n + 1, size)), "q": np.zeros((n, size)), "b": bias, "c": np.full((context, size), 1.0 / context)}
        return cls(n, size, context, {k: v.astype(np.float32) for k, v in w.items()})

    def packed(self) -> np.ndarray:
        return np.concatenate([self.weights[k].ravel() for k in ("e", "q", "b", "c")])

    def with_weights(self, flat: np.ndarray) -> LogBilinear:
        out, at = {}, 0
        for k in ("e", "q", "b", "c"):
            shape = self.weights[k].shape
            out[k] = flat[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32)
            at += int(np.prod(shape))
        return LogBilinear(self.units, self.size, self.context, out)

    def contexts(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The units before each token (tokens x context), nearest first. ``first`` marks each text's first token; what lies before
        it is the last row of ``e``."""
        n = len(units)
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        back = np.arange(n)[:, None] - np.arange(1, self.context + 1)
        return np.where(back >= begin[:, None], units[np.maximum(back, 0)], self.units)

    def predicted(self, ctx: np.ndarray) -> np.ndarray:
        return np.einsum("nkd,kd->nd", self.weights["e"][ctx], self.weights["c"])

    def log_probabilities(self, units: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the units, a matrix product with all units for each batch."""
        out = np.empty(len(units))
        for a in range(0, len(units), 2048):
            s = self.predicted(ctx[a : a + 2048]) @ self.weights["q"].T
            s += self.weights["b"]
            own = s[np.arange(len(s)), units[a : a + 2048]].astype(np.float64)
            with np.errstate(over="ignore"):
                total = np.exp(s).sum(axis=1)
            top = np.zeros(len(s))
            if not (np.isfinite(total).all() and (total > 1e-30).all()):  # beyond single precision: relative to the largest
                top = s.max(axis=1).astype(np.float64)
                total = np.exp(s - top[:, None]).sum(axis=1)
            out[a : a + 2048] = own - top - np.log(total.astype(np.float64))
        return out

    def step(self, units: np.ndarray, ctx: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, sums: dict[str, np.ndarray], rate: float) -> None:
        """One step of noise-contrastive estimation: tell each token from ``noise``, units drawn from the distribution whose logarithm
        is ``log_noise``; ``sums`` holds the squared gradients so far (adaptive step sizes)."""
        e, q, b, c = (self.weights[k] for k in ("e", "q", "b", "c"))
        near = e[ctx]
        r = np.einsum("nkd,kd->nd", near, c)
        many = np.log(len(noise))
        told = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
        g = 1.0 - told(np.einsum("nd,nd->n", r, q[units]) + b[units] - log_noise[units] - many)
        f = told(r @ q[noise].T + (b - log_noise)[noise] - many)
        g_r = g[:, None] * q[units] - f @ q[noise]

        def onto(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
            cell = (at[:, None] * self.size + np.arange(self.size)).ravel()
            return np.bincount(cell, weights=rows.ravel(), minlength=n * self.size).reshape(n, self.size)

        grads = {
            "q": onto(units, g[:, None] * r, self.units) - onto(noise, f.T @ r, self.units),
            "b": np.bincount(units, weights=g, minlength=self.units) - np.bincount(noise, weights=f.sum(axis=0), minlength=self.units),
            "e": sum(onto(ctx[:, k], g_r * c[k], self.units + 1) for k in range(self.context)),
            "c": np.einsum("nkd,nd->kd", near, g_r),
        }
        for k, grad in grads.items():
            grad = grad / len(units)
            sums[k] += grad * grad
            self.weights[k] += (rate * grad / np.sqrt(sums[k])).astype(np.float32)

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, seed: int, batch: int = 1024, noise: int = 16, rate: float = 0.05) -> int:
        """Fit to runs of (units, first) in shuffled batches; returns the number of tokens."""
        rng, share = np.random.RandomState(seed), (counts + 1.0) / (counts + 1.0).sum()
        log_noise, cumulated = np.log(share).astype(np.float32), np.cumsum(share)
        sums, tokens = {k: np.full(v.shape, 1e-6) for k, v in self.weights.items()}, 0
        for units, first in batches:
            ctx, order = self.contexts(units, first), rng.permutation(len(units))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                drawn = np.searchsorted(cumulated, rng.random_sample(noise)).clip(0, self.units - 1)
                self.step(units[at], ctx[at], drawn, log_noise, sums, rate)
            tokens += len(units)
        return tokens


# --------------------------------------------------------------------------- units and counts


@dataclass
class Units:
    """Units of words: the end, the ``singles`` (a unit each), and groups by a word's first two bytes. ``counts``: tokens of each unit,
    ``types``: its different words. ``known`` words with their counts are the frequent ones that tasks have at hand."""

    singles: list[bytes]
    groups: int
    discount: float
    counts: np.ndarray
    types: np.ndarray
    known: list[bytes]
    known_counts: np.ndarray
    total: int
    distinct: int

    def table(self) -> _Table:
        return _Table(self.singles, self.groups)

    def within(self, unit: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its unit: 1 for singles; in a group, its count less the discount over the group's tokens, and what
        the discounts leave for words that the group has not met (all of them are one)."""
        n, kinds = self.counts[unit].astype(float), self.types[unit]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.log10(np.where(c > 0, c - self.discount, self.discount * kinds) / n)
        return np.where((unit <= len(self.singles)) | (n == 0), 0.0, share)


class _Table(dict):
    """Word -> unit; groups are found at a word's first sight and forgotten when there are many."""

    def __init__(self, singles: list[bytes], groups: int):
        self.first = [END, *singles]
        self.groups = groups
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(zip(self.first, range(len(self.first))))

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.restart()
        unit = self[word] = len(self.first) + zlib.crc32(word[:2]) % self.groups
        return unit


def _runs(batches: Iterator[pa.RecordBatch], table: _Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of texts end to end, and each text's first token, in runs of bounded size."""
    for batch in batches:
        texts = batch.column(0)
        for i, j in slices(text_buffers(texts)[1]):
            cut = [[*words_of(t), END] for t in texts.slice(i, j - i).to_pylist()]
            units = np.fromiter(map(table.__getitem__, chain.from_iterable(cut)), np.int64)
            first = np.zeros(len(units), bool)
            first[np.cumsum([0, *map(len, cut[:-1])])] = True
            yield units, first


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c``: how often each word stands in ``texts(text)``, the end of each text as the empty word. Tasks add up what they read
    before anything is shuffled, in tables of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.record_batch([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], ["word", "c"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(words_of(t))
                held[END] += 1
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        yield out()

    part = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "word binary, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


def group_of(word: Column, singles: int, groups: int) -> Column:
    """The unit of a word that is no single: ``_Table`` in SQL."""
    return (F.crc32(F.substring(word, 1, 2)) % groups + 1 + singles).cast("int")


def units_of(counts: DataFrame, singles: int = 127, groups: int = 32, discount: float = 0.6) -> Units:
    """Units from ``word_counts``. Singles are the most frequent words (of at most ``LONGEST`` bytes); the words at hand are all that
    occur as often as some bound, chosen from a histogram of counts so that there are at most ``KNOWN``. No more than these and
    the units' totals comes to the driver."""
    short = counts.where((F.col("word") != F.lit(b"")) & (F.octet_length("word") <= LONGEST))
    top = [(bytes(r["word"]), r["c"]) for r in short.orderBy(F.desc("c"), "word").limit(singles).collect()]
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    band = F.floor(F.log2("c") * 4).cast("int")
    bands, kept, least = sorted(((r["band"], r["n"]) for r in short.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()), reverse=True), 0, None
    for b, n in bands:
        if (kept := kept + n) > KNOWN:
            break
        least = b
    mine = {w: n for w, n in top}
    if least is not None:
        found = short.where(band >= least).select("word", "c").toArrow()
        mine |= dict(zip(found.column("word").to_pylist(), found.column("c").to_pylist()))
    ends = counts.where(F.col("word") == F.lit(b"")).select("c").first()
    n, kinds = np.zeros(1 + len(top) + groups, np.int64), np.zeros(1 + len(top) + groups, np.int64)
    n[0] = ends["c"] if ends else 0
    n[1 : 1 + len(top)] = [c for _, c in top]
    for r in counts.where(F.col("word") != F.lit(b"")).groupBy(group_of(F.col("word"), len(top), groups).alias("unit")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        n[r["unit"]], kinds[r["unit"]] = r["c"], r["n"]
    for w, c in top:  # a single is no member of its group
        g = 1 + len(top) + zlib.crc32(w[:2]) % groups
        n[g], kinds[g] = n[g] - c, kinds[g] - 1
    words = [END, *mine]
    return Units([w for w, _ in top], groups, discount, n, kinds, words, np.array([n[0], *mine.values()], np.int64), int(total), int(distinct))


def fit(texts: DataFrame, units: Units, part: Column | None = None, rounds: int = 4, size: int = 12, context: int = 3, rate: float = 0.05) -> LogBilinear:
    """The model of ``texts(text)``. Each round every task goes on from the shared weights over its own texts of that round, and the
    results are averaged by tokens; steps shrink by half from round to round. The rounds together read every text once (``part``, a whole number, deals them out). Weights are a
    few thousand numbers; averages are formed in at most 64 tasks before they come to the driver."""
    model = LogBilinear.fresh(units.counts, size, context)
    if not units.total:
        return model
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast(units)
    part = F.xxhash64("text") if part is None else part
    for r in range(rounds):
        now = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now, r=r) -> Iterator[pa.RecordBatch]:
            own = now.value.with_weights(now.value.packed())
            n = own.learn(_runs(batches, shared.value.table()), shared.value.counts, seed=r, rate=rate * 0.5**r)
            if n:
                yield pa.record_batch([pa.array([n]), pa.array([own.packed().tobytes()], pa.binary())], ["n", "w"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for batch in batches:
                for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.frombuffer(w, np.float32).astype(np.float64) * k
                    n, total = n + k, own if total is None else total + own
            if n:
                yield pa.record_batch([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

        mine = texts.where(F.pmod(part, F.lit(rounds)) == r).select(F.col("text").cast("string").alias("text"))
        sums = mine.mapInArrow(frugal(run), "n long, w binary").repartition(64).mapInArrow(add, "n long, w binary").collect()
        if sums:
            model = model.with_weights(sum(np.frombuffer(x["w"], np.float64) for x in sums) / sum(x["n"] for x in sums))
    return model


# --------------------------------------------------------------------------- scores


def score(docs: DataFrame, training: Column, **options) -> DataFrame:
    """Log-probabilities of whole ``docs(doc_id, text)``: ``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Rows where ``training`` (over the columns of ``docs``; null is false) holds are learnt from. Tokens are the words of ``words_of`` and one end;
    a null text is empty. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) with the counts c, N, V of the training tokens, all words
    the training texts don't hold being one. ``score`` sums log10 of P(unit | the last words) by the log-bilinear model, normalised
    over all units, times the word's share of its unit (``Units.within``), so the probabilities of all words, with one unmet word a group, add
    up to 1. Without training rows the base score is 0 a token, and all units are equally likely. Repeated rows count as often as they occur,
    other columns are ignored, an empty table gives no rows.

    Counts cover every training text and grow with the corpus. Tasks know the frequent words by heart, so hot words never meet in
    a shuffle; the other words of a text, once each, are joined with the counts.
    """
    spark = docs.sparkSession
    mark = scratch_mark()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("trained"))
    learnt = rows.where("trained")
    counts = materialise(word_counts(learnt), "lm-counts")
    units = units_of(counts)
    model = fit(learnt, units, F.xxhash64("doc_id"), **options)
    sc = spark.sparkContext
    shared = sc.broadcast((units, model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, m = shared.value
        table = u.table()
        number = dict(zip(u.known, range(len(u.known))))
        unit = np.fromiter(map(table.__getitem__, u.known), np.int64, len(u.known))
        base = np.log10(u.known_counts + 0.1)
        within = u.within(unit, u.known_counts)
        known = u.known_counts > 0
        for batch in batches:
            texts = batch.column(0)
            for i, j in slices(text_buffers(texts)[1]):
                cut = [[*words_of(t), END] for t in texts.slice(i, j - i).to_pylist()]
                at = np.fromiter(map(number.get, chain.from_iterable(cut), repeat(-1)), np.int64)
                size = np.fromiter(map(len, cut), np.int64, len(cut))
                begin = np.concatenate([[0], np.cumsum(size)])
                own_units, missed = unit[at], np.flatnonzero(at < 0)
                doc = np.searchsorted(begin, missed, side="right") - 1
                lost: list[Counter] = [Counter() for _ in cut]
                for p, k in zip(missed.tolist(), doc.tolist()):
                    w = cut[k][p - begin[k]]
                    own_units[p] = table[w]
                    lost[k][w] += 1
                first = np.zeros(len(at), bool)
                first[begin[:-1]] = True
                log_p = m.log_probabilities(own_units, m.contexts(own_units, first)) / np.log(10)
                met = at >= 0
                add = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: E731, B023
                words = pa.StructArray.from_arrays([pa.array([w for c in lost for w in c], pa.binary()), pa.array([n for c in lost for n in c.values()], pa.int32())], ["word", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lost)]), pa.int32()), words)
                sums = [size, add((met & known[at]).astype(np.int64)), add(np.where(met, base[at], 0.0)), add(log_p + np.where(met, within[at], 0.0))]
                yield pa.record_batch([batch.column(1).slice(i, j - i), batch.column(2).slice(i, j - i), *map(pa.array, sums), lists], ["doc_id", "trained", "n_tokens", "n_known", "base", "model", "rest"])

    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, base double, model double, rest array<struct<word:binary,n:int>>"
    found = rows.select("text", "doc_id", "trained").mapInArrow(frugal(run), schema)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "lm-texts")  # rows are told apart by this number, once written
    lost = found.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.n")
    lost = lost.join(counts, "word", "left").withColumn("unit", group_of(F.col("word"), len(units.singles), units.groups))
    stats = spark.createDataFrame([(k, int(c), int(t)) for k, (c, t) in enumerate(zip(units.counts, units.types))], "unit int, unit_n long, unit_types long")  # a row for each unit
    c = F.coalesce("c", F.lit(0))
    share = F.when(F.col("unit_n") == 0, 0.0).otherwise(F.log10(F.when(c > 0, c - units.discount).otherwise(units.discount * F.col("unit_types")) / F.col("unit_n")))
    lost = lost.join(F.broadcast(stats), "unit").groupBy("row")
    lost = lost.agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("more_base"), F.sum(F.col("n") * share).alias("more_model"))
    out = found.drop("rest").join(lost, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    norm = float(np.log10(units.total + 0.1 * (units.distinct + 1)))
    out = out.select("doc_id", "trained", "n_tokens", plus("n_known", "more").alias("n_known"), F.lit(units.total).cast("long").alias("train_tokens"), (plus("base", "more_base") - F.col("n_tokens") * norm).alias("base_score"), plus("model", "more_model").alias("score"))
    out = materialise(out, "lm-scores")
    clear_scratch(spark, mark, keep=(out,))
    return out
