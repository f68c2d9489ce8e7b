"""Toxicity: a counterfactual-regularised logistic classifier over hashed words and word beginnings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, frugal, materialise, slices, text_buffers, word_hashes

#: Identity terms by kind; a counterfactual puts the next term of the kind in a term's place.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("africans", "europeans", "americans", "mexicans", "chinese", "indians"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "citoyens"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "ciudadanos"),
)
_NEXT = {kind[i]: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i in range(len(kind))}
_IDENTITY = re.compile(r"(?<!\w)(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)
#: Signs that IGNORECASE takes for i and s, and that ``lower`` leaves: dotless i, the dot of a capital dotted i, long s.
_FOLD = str.maketrans({"\u0131": "i", "\u0307": None, "\u017f": "s"})

DIMENSIONS = 1 << 20
#: Lengths in bytes of the word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7)


def counterfactual(text: str) -> str:
    """The text with every identity term replaced by the next one of its kind; the same text if it has none."""

    def swap(m: re.Match) -> str:
        new = _NEXT[m[0].lower().translate(_FOLD)]
        return new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

    return _IDENTITY.sub(swap, text)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, end to end, and where each text's begin.

    A feature is a lower-cased (A-Z) run of ASCII letters, apostrophes and non-ASCII bytes, or a beginning of one, hashed to
    ``DIMENSIONS`` numbers.
    """
    n = len(offsets) - 1
    letters = np.where(_WORD[data], data, np.uint8(32))
    found, owner = [], []
    for length in (0, *BEGINNINGS):
        h, first = word_hashes(letters, offsets, lower=True, beginning=length)
        found.append((h + np.uint64(length)) & np.uint64(DIMENSIONS - 1))
        owner.append(np.repeat(np.arange(n), np.diff(first)))
    both = np.unique(np.concatenate(owner).astype(np.uint64) << np.uint64(20) | np.concatenate(found))
    own = (both >> np.uint64(20)).astype(np.int64)
    return (both & np.uint64(DIMENSIONS - 1)).astype(np.int64), np.searchsorted(own, np.arange(n + 1))


_WORD = np.zeros(256, bool)
_WORD[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


@dataclass(frozen=True)
class Classifier:
    """Weights of the selected features (sorted by number), and the bias."""

    selected: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found, begin = features(data, offsets)
        dense = np.zeros(DIMENSIONS)
        dense[self.selected] = self.weights
        total = np.concatenate([[0.0], np.cumsum(dense[found])])
        return 1 / (1 + np.exp(-np.clip(total[begin[1:]] - total[begin[:-1]] + self.bias, -30, 30)))


def in_fold(doc_id: Column, fold: int = 0, folds: int = 5) -> Column:
    """Whether the row belongs to the fold: crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def train(labelled: DataFrame, most_features: int = 4096, least_documents: int = 4, counterfactual_weight: float = 1.0, decay: float = 3e-3, steps: int = 120) -> Classifier:
    """A classifier from ``labelled(text, label)``; rows with a null label take no part, a null text is empty.

    Documents are counted by feature and label, per task and then summed, and the ``most_features`` features of the
    largest chi-square are selected. Only lists of selected features come to the driver, one for each row, so callers bound
    the rows (see ``learnt_from``). The loss is the logistic loss, ``decay`` times the squared weights, and
    ``counterfactual_weight`` times the squared change of the score (as log odds) between a text and its counterfactual,
    so that identity terms by themselves move no score. Without labelled rows, all scores are 0.5.
    """
    spark = labelled.sparkSession
    rows = materialise(labelled.where("label is not null").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int").alias("label")), "tox-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, DIMENSIONS), np.int64)
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            label = batch.column(1).to_numpy()
            for i, j in slices(off):
                found, begin = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                toxic = np.repeat(label[i:j] > 0, np.diff(begin))
                counts[0] += np.bincount(found[~toxic], minlength=DIMENSIONS)
                counts[1] += np.bincount(found[toxic], minlength=DIMENSIONS)
        at = np.flatnonzero(counts.any(axis=0))
        for i in range(0, len(at), 50_000):
            own = at[i : i + 50_000]
            yield pa.record_batch([pa.array(own), pa.array(counts[0, own]), pa.array(counts[1, own])], ["feature", "clean", "toxic"])

    sizes = {r["y"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(False, 0), sizes.get(True, 0)
    if not n0 or not n1:
        drop_scratch(spark, rows)
        return Classifier(np.zeros(0, np.int64), np.zeros(0), 0.0 if n0 == n1 else 5.0 if n1 else -5.0)
    counted = rows.mapInArrow(frugal(count), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic"), F.col("clean")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    chi = (a * d - b * c).cast("double") ** 2 / ((a + b).cast("double") * (c + d + 1))
    best = counted.where(a + b >= least_documents).orderBy(chi.desc(), "feature").limit(most_features)
    selected = np.array(sorted(r[0] for r in best.select("feature").collect()), np.int64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DIMENSIONS, -1, np.int32)
        place[selected] = np.arange(len(selected))
        for batch in batches:
            _, borders = text_buffers(batch.column(0))
            for i, j in slices(borders):
                texts = batch.column(0).slice(i, j - i).to_pylist()
                swapped = [counterfactual(t) for t in texts]
                lists = []
                for own in (texts, swapped):
                    data, off = text_buffers(pa.array(own, pa.large_string()))
                    found, begin = features(data[off[0] : off[-1]], off - off[0])
                    lists.append([p[p >= 0] for p in (place[found[x:y]] for x, y in zip(begin[:-1], begin[1:]))])
                other = [None if t == u else v for t, u, v in zip(texts, swapped, lists[1])]
                yield pa.record_batch([batch.column(1).slice(i, j - i), pa.array(lists[0], pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["label", "own", "other"])

    fit = rows.mapInArrow(frugal(pick), "label int, own array<int>, other array<int>").collect()
    drop_scratch(spark, rows)
    weights, bias = _fit(fit, len(selected), counterfactual_weight, decay, steps)
    return Classifier(selected, weights, bias)


def _fit(rows, n: int, pull: float, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Adam over all rows at once."""
    flat = lambda lists: (np.array([f for x in lists for f in x], np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
    y = np.array([r["label"] > 0 for r in rows], float)
    at, row = flat([[n, *r["own"]] for r in rows])  # n: the bias, so that no row is empty
    begin = np.searchsorted(row, np.arange(len(y)))
    swapped = [r for r in rows if r["other"] is not None]
    at1, row1 = flat([r["own"] for r in swapped])
    at2, row2 = flat([r["other"] for r in swapped])
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for t in range(1, steps + 1):
        z = np.add.reduceat(w[at], begin)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.bincount(at, e[row], n + 1)
        g[:n] += 2 * decay / n**0.5 * w[:n]
        if len(swapped):
            d = np.bincount(row1, w[at1], len(swapped)) - np.bincount(row2, w[at2], len(swapped))
            d *= 2 * pull / len(swapped)
            g[:n] += np.bincount(at1, d[row1], n) - np.bincount(at2, d[row2], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the score ``name`` (0 to 1, higher: more toxic) from the whole ``text`` alone.

    Null and empty texts get the score of a text without features. Rows are independent; an empty table gives no rows.
    """
    own = text in keep and docs.schema[text].dataType.typeName() == "string"  # a text that is kept travels once
    picked = docs.select(*keep) if own else docs.select(F.col(text).cast("string").alias("__text"), *keep)
    at, first = (keep.index(text), 0) if own else (0, 1)
    schema = ", ".join([*(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(at))
            for i, j in slices(off):
                s = model.scores(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.record_batch([*(batch.column(first + k).slice(i, j - i) for k in range(len(keep))), pa.array(s)], [*keep, name])

    return picked.mapInArrow(frugal(run), schema)


def fitting_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, label`` of at most ``sample`` labelled documents outside fold 0.

    They are chosen from ``labels(doc_id, toxic)`` alone: labels whose hash of doc_id is below what leaves about ``sample`` of
    them, the least hashes first. A doc_id that is labelled several times is toxic if one label says so. The chosen ids,
    at most ``sample`` of 16 bytes, are broadcast, so no text is shuffled but those chosen; of rows that share a doc_id the
    smallest text is taken. Documents without label, and labels without document, take no part.
    """
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(~in_fold(F.col("doc_id")))
    n = known.count()
    at = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    below = (1 << 30) if n <= sample else int((sample + 4 * sample**0.5) / n * (1 << 30)) + 1
    chosen = known.where(at < below).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(at, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def learnt_from(docs: DataFrame, labels: DataFrame, sample: int = 12_000, **options) -> Classifier:
    """A classifier from at most ``sample`` (a documented bound) labelled documents outside fold 0, see ``fitting_rows``
    and ``train``."""
    return train(fitting_rows(docs, labels, sample), **options)
