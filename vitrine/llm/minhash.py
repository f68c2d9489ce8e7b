"""MinHash near-dedup with circulant MinHash (Li and Li 2021), banding, and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap, bits_for, components, drop_scratch, frugal, materialise, maybe_in, mix, ngram_hashes, slices, text_buffers, word_hashes

UNIVERSE = 1 << 20
#: Rows of an Arrow batch of texts, and of pairs of texts.
TEXTS, PAIRS = 2_000, 1_000


def permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of the universe; the beginning of the second is repeated at its end, so that every shift is
    a slice."""
    random = np.random.RandomState(seed)
    sigma, pi = (random.permutation(UNIVERSE).astype(np.int32) for _ in range(2))
    return sigma, np.concatenate([pi, pi[:coordinates]])


def signatures(shingles: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per text; texts are runs of ``shingles`` beginning at ``starts`` (none empty).

    A shingle's hash gives its element x of the universe. Coordinate k of a set is the least pi(sigma(x) + k), so all
    coordinates of one shingle are a contiguous slice of the second table.
    """
    sigma, pi = tables
    at = sigma[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    rows = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    out = np.full((len(starts), coordinates), np.iinfo(np.int32).max, np.int32)
    for i in range(0, len(at), 4096):
        j = min(i + 4096, len(at))
        first = np.searchsorted(starts, i, side="right") - 1
        last = np.searchsorted(starts, j, side="left")
        cuts = np.maximum(starts[first:last], i) - i
        part = np.minimum.reduceat(rows[at[i:j]], cuts, axis=0)
        np.minimum(out[first:last], part, out=out[first:last])
    return out


def shingles_of(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles end to end and each text's number of them; a shorter text is one shingle."""
    grams = ngram_hashes(words, n)
    lengths = np.diff(first)
    full = lengths >= n
    counts = np.where(full, lengths - n + 1, (lengths > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(begin[-1], np.uint64)
    where = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    long = np.repeat(full, counts)
    out[long] = grams[where[long]]
    for d in np.flatnonzero(~full & (lengths > 0)):
        h = np.uint64(lengths[d])
        for w in words[first[d] : first[d + 1]]:
            h = mix(np.array([h ^ w]))[0]
        out[begin[d]] = h
    return out, begin


def _sketches(shingle: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        k = bands * rows
        tables = permutations(k, seed)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for i, j in slices(off):
                part = data[off[i] : off[j]]
                words, first = word_hashes(part, off[i : j + 1], lower=True)
                grams, begin = shingles_of(words, first, shingle)
                texts = np.flatnonzero(np.diff(begin))
                keys: list = [[]] * (j - i)
                if len(texts):
                    sig = signatures(grams, begin[:-1][texts], tables, k).astype(np.uint64).reshape(len(texts), bands, rows)
                    key = np.broadcast_to(salt, sig.shape[:2])
                    with np.errstate(over="ignore"):
                        for r in range(rows):
                            key = mix(key + sig[:, :, r])
                    for t, own in zip(texts, key.view(np.int64)):
                        keys[t] = own
                raw = part.tobytes()
                b = off[i : j + 1] - off[i]
                norm = [hashlib.blake2b(b" ".join(raw[x:y].lower().split()), digest_size=16).digest() for x, y in zip(b[:-1], b[1:])]
                sizes = [len(np.unique(grams[x:y])) for x, y in zip(begin[:-1], begin[1:])]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(norm, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "same", "n_shingles", "bands"],
                )

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with both texts; a bitmap of bounded size prunes ``texts`` before the two joins."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "near-asked")
    bits = bits_for(ids.count())
    t = materialise(maybe_in(texts, "cid", bitmap(ids, "cid", bits), bits), "near-texts")
    return (
        pairs.join(t.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        .join(t.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )


def jaccard_pairs(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Adds ``inter`` and ``total`` (sizes of intersection and union of the full shingle sets) to ``pairs(a, b)``.

    ``texts(cid, text)`` may hold more rows than the pairs name.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(text) -> set:
            w = (text or "").encode().lower().split()
            return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)}

        at, mine = None, set()
        for batch in batches:
            a = batch.column(0).to_pylist()
            inter, total = [], []
            for i in range(batch.num_rows):
                if at is None or a[i] != at:
                    at, mine = a[i], full(batch.column(2)[i].as_py())
                other = full(batch.column(3)[i].as_py())
                inter.append(n := len(mine & other))
                total.append(len(mine) + len(other) - n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "inter", "total"])

    return _with_texts(pairs, texts).mapInArrow(frugal(measure), "a long, b long, inter long, total long")


def differences(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """What parts the shingles of b from those of a: ``a, b, n_a, n_b, missing`` (how many of a's are not in b) and
    ``differ`` (hashes of the shingles that only one of the two has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(text) -> np.ndarray:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, first = word_hashes(raw, np.array([0, len(raw)]), lower=True)
            return np.unique(shingles_of(words, first, shingle)[0])

        at, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for a, b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != at:
                    at, centre = a, full(text_a)
                own = full(text_b)
                differ = np.setxor1d(centre, own, assume_unique=True)
                rows.append((a, b, len(centre), len(own), (len(differ) + len(centre) - len(own)) // 2, differ.view(np.int64)))
            yield pa.record_batch([pa.array(x, pa.list_(pa.int64()) if i == 5 else pa.int64()) for i, x in enumerate(list(zip(*rows)) or [()] * 6)], ["a", "b", "n_a", "n_b", "missing", "differ"])

    return _with_texts(pairs, texts).mapInArrow(frugal(run), "a long, b long, n_a long, n_b long, missing long, differ array<long>")


def cross_pairs(mixed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Every pair ``a, b`` across components that can be linked among ``mixed(bucket, cid, component)``, by an exact
    join on differences to a common centre c.

    Let D(x) be the shingles that only one of c and x has, and t = percent / (100 + percent). x and y are linked if
    |x & y| >= t (|x| + |y|); as |x & y| = |c| - |c - x| - |c - y| + |D(x) & D(y)|, they must share at least
    need(x) + (1 - t) |c - y| + t |y - c| differences, with need(x) = t (|x| + |c|) - |c & x|, which is above 0 just if
    x is not linked to c. Of two documents in different components one at least is not linked to c (a link to c is
    returned itself), so it is enough to join those with all others on a prefix of the differences, rarest first, where enough
    differences are left from the shared one on. Copies of one
    text differ from it in a few places of their own, so a large group makes few candidates.
    """
    low = mixed.join(mixed.groupBy("bucket").agg(F.min("cid").alias("low")), "bucket").groupBy("cid").agg(F.min("low").alias("low"))
    centre = mixed.join(low, "cid").groupBy("bucket").agg(F.min("low").alias("c"))  # two steps towards one centre for all
    groups = mixed.join(centre, "bucket").select("c", "cid", "component").distinct()
    t = percent / (100 + percent)
    diff = materialise(differences(groups.where("c <> cid").select(F.col("c").alias("a"), F.col("cid").alias("b")), texts, shingle), "near-differences", PAIRS)
    size, missing = F.size("differ"), F.col("missing")
    need = t * (F.col("n_a") + F.col("n_b")) + missing - F.col("n_a")
    outside = (F.col("n_a") - missing) * 100 < (F.col("n_b") + missing) * percent
    shared = F.when(outside, F.ceil(need / (1 - t) - 1e-6)).otherwise(F.floor((1 - t) * missing + t * (size - missing) - 1e-6) + 1)
    each = diff.select("a", "b", F.col("n_a").alias("n_c"), F.col("n_b").alias("n"), "missing", size.alias("size"), outside.alias("outside"), (size - F.greatest(shared, F.lit(1)) + 1).alias("prefix"), "differ")
    each = each.join(groups.select(F.col("c").alias("a"), F.col("cid").alias("b"), "component"), ["a", "b"]).where("prefix > 0")
    each = each.withColumn("e", F.explode("differ")).drop("differ")
    often = each.groupBy("a", "e").agg(F.count("*").alias("often"), F.max("outside").alias("any_outside"))
    ranked = each.join(often, ["a", "e"]).withColumn("at", F.row_number().over(W.partitionBy("a", "b").orderBy("often", "e")))
    keys = materialise(ranked.where("at <= prefix and often > 1 and any_outside").select("a", "e", "b", "n_c", "n", "missing", (F.col("size") - F.col("at") + 1).alias("left"), "component", "outside"), "near-keys")
    x = keys.where("outside").select("a", "e", F.col("b").alias("x"), "n_c", F.col("n").alias("n_x"), F.col("missing").alias("m_x"), F.col("left").alias("left_x"), F.col("component").alias("c_x"))
    y = keys.select("a", "e", F.col("b").alias("y"), F.col("n").alias("n_y"), F.col("missing").alias("m_y"), F.col("left").alias("left_y"), F.col("component").alias("c_y"), "outside")
    close = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    enough = F.least("left_x", "left_y") >= t * (F.col("n_x") + F.col("n_y")) + F.col("m_x") + F.col("m_y") - F.col("n_c") - 1e-6
    across = x.join(y, ["a", "e"]).where("c_x <> c_y and (x < y or not outside)").where(close & enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    own = diff.where(~outside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return across.unionByName(own).distinct()


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 75,
    bands: int = 48,
    rows: int = 5,
    seed: int = 7,
    star_rounds: int = 2,
) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``: one row per document with ``doc_id, n_shingles,
    component_id, kept, text_hash`` (xxhash64 of the text).

    Texts are lower-cased (A-Z) and cut into words; the set of a document is its distinct ``shingle``-word shingles
    (fewer words: the whole sequence is one). Two documents are linked if 100 * |A & B| >= percent * |A | B|. A
    document with no word, an empty or a null text has an empty set and is linked with nothing. Repeated rows give
    repeated result rows. Rows that share a doc_id and differ in text are documents of their own: each has the smallest
    doc_id that its own text reaches. Rows without doc_id take part too; where only such rows are linked, component_id is
    null and one of them is kept. Other columns are ignored.

    1. Equal word sequences form classes (a pre-aggregated ``min``); the smallest id stands for its class from here on.
    2. Circulant MinHash: two permutations give all bands * rows coordinates. With 48 bands of 5 rows a pair at 0.75
       shares no band with a probability of 3e-6, and one at 0.8 of 1e-8.
    3. In every band bucket all members are compared with the bucket's smallest id (a star, linear in the bucket), on
       the full sets. Linked documents form components; buckets within one component are done. Members of the mixed
       buckets that are outside a bucket's largest component are compared with further centres of that component
       (until few pairs across components are left, or ``star_rounds`` are over). ``cross_pairs`` then finds all pairs
       across components that can be linked at all, and they are compared. So no link within a bucket is lost, while a
       large group of copies costs about as many comparisons as it has members.
    """
    options = {"shingle": shingle, "percent": percent, "star_rounds": star_rounds}
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = "doc_id long, text_hash long, same binary, n_shingles long, bands array<long>"
    sketch = lambda df: materialise(df.mapInArrow(frugal(_sketches(shingle, bands, rows, seed)), schema), "near-sketches", TEXTS)
    sk = sketch(docs)
    several = sk.groupBy("doc_id").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.max("n_shingles").alias("words")).where("if(doc_id is null, words > 0, lo <> hi)")
    if several.isEmpty():
        return _by_identifier(sk, docs.select("doc_id", "text"), **options)
    drop_scratch(docs.sparkSession, sk)
    numbered = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    own = numbered.select(F.col("row").alias("doc_id"), "text_hash", "text")
    found = _by_identifier(sketch(own), own.select("doc_id", "text"), **options).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("c"))
    found = materialise(numbered.drop("text").join(found, "row"), "near-found")
    least = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("c")))
    return found.join(least, "c").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def _by_identifier(sk: DataFrame, docs: DataFrame, shingle: int, percent: int, star_rounds: int) -> DataFrame:
    """``near_duplicates`` of rows whose doc_id tells their texts apart, from their sketches."""
    spark = docs.sparkSession
    classes = sk.where("n_shingles > 0").groupBy("same").agg(F.min("doc_id").alias("cid"))
    reps = sk.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").where("n_shingles > 0").dropDuplicates(["doc_id"])
    members = reps.select(F.col("doc_id").alias("cid"), "n_shingles", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cid").alias("centre")).where("n > 1")
    shared = materialise(members.join(buckets.select("bucket"), "bucket"), "near-members")
    texts = docs.where("text is not null").select(F.col("doc_id").alias("cid"), "text")
    same_size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    linked = F.col("inter") * 100 >= F.col("total") * percent

    measured = spark.createDataFrame([], "a long, b long, inter long, total long")
    labels = spark.createDataFrame([], "id long, component long")
    centres_of = (1, 2, 4, 8)
    for turn in range(star_rounds):
        if turn == 0:
            mine = shared.withColumn("component", F.col("cid"))
        else:
            mine = materialise(_mixed(shared, labels), "near-mixed")
            own = mine.groupBy("bucket", "component").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("squares"))
            left, members = own.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2), F.sum("n")).first()
            if (left or 0) <= 2 * (members or 0):
                break
        picks = [F.min_by(F.struct("cid", "n_shingles"), F.col("cid") if turn == 0 else F.xxhash64("cid", "bucket", F.lit(turn), F.lit(k))) for k in range(centres_of[min(turn, 3)])]
        if turn == 0:  # nothing is linked yet: one centre for all
            centres = mine.groupBy("bucket").agg(F.array(*picks).alias("c"), F.lit(None).cast("long").alias("main"))
        else:  # centres from the largest component, for the members that are outside it
            each = mine.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.array_distinct(F.array(*picks)).alias("c"))
            centres = each.groupBy("bucket").agg(F.max_by(F.struct("c", "component"), F.struct("n", "component")).alias("m")).select("bucket", "m.c", F.col("m.component").alias("main"))
        star = (
            mine.join(centres, "bucket")
            .where(~F.col("main").eqNullSafe(F.col("component")))
            .withColumn("c", F.explode("c"))
            .where(F.col("c.cid") != F.col("cid"))
            .select(F.col("c.cid").alias("x"), "cid", F.col("c.n_shingles").alias("n_a"), F.col("n_shingles").alias("n_b"))
            .where(same_size)
            .select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b"))
            .distinct()
        )
        new = materialise(jaccard_pairs(star.join(measured, ["a", "b"], "left_anti"), texts, shingle), "near-stars", PAIRS)
        measured = measured.unionByName(new)
        links = measured.where(linked)
        labels = materialise(components(links.select("a", "b"), "near-cc"), "near-labels")

    rest = _mixed(shared, labels)
    if not rest.isEmpty():
        pairs = cross_pairs(materialise(rest, "near-rest"), texts, shingle, percent).join(measured, ["a", "b"], "left_anti")
        new = materialise(jaccard_pairs(pairs, texts, shingle), "near-pairs", PAIRS)
        links = measured.unionByName(new).where(linked)
        labels = materialise(components(links.select("a", "b"), "near-cc"), "near-labels")

    cid = classes.join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").select("same", F.coalesce("component", "cid").alias("cid"))
    return (
        sk.select("doc_id", "text_hash", "same", "n_shingles")
        .join(cid, "same", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
    )


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component."""
    own = shared.join(labels.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    several = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return own.join(several.select("bucket"), "bucket")
