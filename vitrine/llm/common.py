"""Shared helpers: scratch tables, bounded bitmaps, connected components, and vectorised word hashing.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SQL = r"[^\x20\x09-\x0D]+"

# --------------------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a
    temporary folder; on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='vitrine-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


#: Scratch folders that this process made and has not deleted, in order.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/vitrine-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def scratch_mark() -> int:
    """How many scratch folders there are now, for ``clear_scratch``."""
    return len(_made)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch folders made after the mark, but those that the DataFrames ``keep`` read. Results that are not
    written yet must be among these."""
    held = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    for path in _made[since:]:
        if path.rsplit("/", 1)[-1] not in held:
            _delete(spark, path)
            _made.remove(path)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors.

    ``batch_rows`` bounds the rows of an Arrow batch meanwhile: batches of long texts, or of pairs of them, take memory in
    the JVM and in the Python workers.
    """
    spark = df.sparkSession
    path, schema, old = scratch_path(spark, name), df.schema, spark.conf.get(BATCH, None)
    if batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.unset(BATCH) if old is None else spark.conf.set(BATCH, old)
    return spark.read.schema(schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialised table once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}:
        for path in [p for p in _made if p.endswith("/" + name)]:
            _delete(spark, path)
            _made.remove(path)


# --------------------------------------------------------------------------- memory of Python workers


#: How to forget what an operator keeps in a Python worker between its tasks, by the operator's name.
kept: dict[str, Callable[[], None]] = {}


def frugal(run, owner: str = ""):
    """``run`` (a function of Arrow batches), before which the worker forgets what operators other than ``owner`` keep, and after
    which it gives its free memory back: workers stay for later tasks, and what the allocators keep would add up beside the JVM's."""

    def trim():
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such function in this C library
            pass

    def done(batches):
        for forget in [f for name, f in kept.items() if name != owner]:
            forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return done


# --------------------------------------------------------------------------- bounded bitmaps


def bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """A bitmap of ``bits`` bits over a long column, as at most ``bits / 32768`` rows of 4 KB: its size has a fixed bound.

    It only ever prunes: a set bit may be a false positive, a clear bit is certain. A full bitmap prunes nothing and
    results stay right.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bm_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bm_bits"))
    )


def bits_for(keys: int) -> int:
    """Bits of a bitmap over so many keys: 16 for each, 2**20 to 2**27 in all (16 MB); beyond, it prunes less."""
    return 1 << min(27, max(20, (16 * keys).bit_length()))


def maybe_in(df: DataFrame, column: str, bm: DataFrame, bits: int, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose key may be in the bitmap (``keep=False``: those whose key is certainly not in it)."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits))
    at = F.bitmap_bit_position("__slot").cast("int")
    byte = F.conv(F.hex(F.substring("bm_bits", F.expr("cast(bitmap_bit_position(__slot) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, __bit) & 1") == 1, F.lit(False))
    cols = df.columns
    return (
        df.withColumn("__slot", slot)
        .withColumn("bm_bucket", F.bitmap_bucket_number("__slot"))
        .join(F.broadcast(bm), "bm_bucket", "left")
        .withColumn("__byte", byte)
        .withColumn("__bit", at % 8)
        .where(hit if keep else ~hit)
        .select(*cols)
    )


# --------------------------------------------------------------------------- connected components


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: every u has one edge, and no v is a u."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("centre")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("centre")))).alias("p"))
    n = ends.select("p.*").groupBy("id").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return n.where("out > 1 or (out = 1 and centre = 1)").isEmpty()


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs) as ``(id, component)`` with the smallest reachable id.

    Alternating large-star and small-star rounds until only stars are left: every round is two shuffles of at most as
    many rows as there are edges; the rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder, and no row comes to the driver. A hub's edges are pre-aggregated (``min``) before the shuffle.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialise(e, name)
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))).alias("p"))
            .select(F.col("p.x").alias("u"), F.col("p.y").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = materialise(small, name)
        drop_scratch(e.sparkSession, e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# --------------------------------------------------------------------------- words of whole texts, hashed in numpy

_R = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = (np.arange(256) + 1).astype(np.uint64)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, for positions 0 to n - 1 at least."""
    key = int(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.cumprod(p, dtype=np.uint64))
        _powers[key] = (out[0], out[1])
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (Steele, Lea and Flood 2014)."""
    h = h.copy()
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, beginning: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end, and where each text's words begin (len(offsets) entries).

    ``data`` holds UTF-8 bytes, ``offsets`` the texts' borders in it. A word never crosses a border. With ``beginning``,
    the first so many bytes of the words that are longer are hashed, and the others are left out.
    """
    n = len(data)
    borders = offsets - offsets[0]
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[borders] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    if beginning:
        starts = starts[ends - starts > beginning]
        ends = starts + beginning
    power, inverse = _tables(_R, n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _SAME)[data] * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    return mix(h), np.searchsorted(starts, borders)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (also across texts: callers leave those out); len(words) - n + 1 entries."""
    m = len(words)
    if m < n:
        return np.zeros(0, np.uint64)
    power, inverse = _tables(_Q, m + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(words * power[:m], out=total[1:])
        return mix((total[n:] - total[: m - n + 1]) * inverse[: m - n + 1])


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of an Arrow string column; null texts have no bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, most: int = 1 << 19):
    """Runs (i, j) of texts of about ``most`` bytes together, so that work arrays stay small whatever a batch holds."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
