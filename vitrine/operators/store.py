"""Tables kept for later use in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application and key: the state of the source files, and what was built from them.
_kept: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode, an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='vitrine-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path inside the shared folder."""
    return f"{shared_dir(spark)}/catalogue-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/catalogue-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def state_of(df: DataFrame) -> str:
    """What changes when the files behind a table change: a digest of their names, sizes and times."""
    sc = df.sparkSession.sparkContext
    out = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path)
        out.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return out.hexdigest()


def once(source: DataFrame, key: str, make):
    """What ``make()`` builds from the files of ``source`` (an index in the shared folder), built at the first call of this application and
    again when the files have changed."""
    at, state = (source.sparkSession.sparkContext.applicationId, key), state_of(source)
    if at not in _kept or _kept[at][0] != state:
        _kept[at] = (state, make())
    return _kept[at][1]
