"""Listings through Spark's readers, and logs as streams against the same on tables."""

import datetime
import hashlib
import os
import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from vitrine.sources import files as SRC
from vitrine.streaming import logs
from vitrine.streaming import timers as T

EVENTS = "/root/testdata/sf0.001/events.parquet"


def media(tmp_path):
    for name, data in {"b.JPG": b"b", "A.mp4": b"aa", "c.txt": b"c", "sub/d.png": b"d", "sub/deep/e.gif": b"eee", "none/f.md": b"f"}.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}"


def test_listing(spark, tmp_path):
    root = media(tmp_path)
    one = SRC.listing(spark, root, hashes=True)
    assert [(r["path"].rsplit("/", 1)[1], r["kind"], r["size"]) for r in SRC.named(one).collect()] == [("A.mp4", "video", 2), ("b.JPG", "image", 1)]
    assert {r["strong_hash"] for r in one.collect()} == {hashlib.sha256(b"b").hexdigest(), hashlib.sha256(b"aa").hexdigest()}
    every = SRC.listing(spark, root, recursive=True)
    base = every.first()["path"].rsplit("/" + os.path.basename(tmp_path) + "/", 1)[0] + "/" + os.path.basename(tmp_path)
    assert {(r["folder"].rsplit("/", 1)[1], r["has_subfolders"]) for r in SRC.folders(every, base).collect()} == {("sub", True)}
    walked = {r["folder"].removeprefix(base): (r["files"], r["bytes"], list(r["subfolders"])) for r in SRC.walk(every).collect() if r["folder"].startswith(base)}
    assert walked == {"": (2, 3, ["sub"]), "/sub": (1, 1, ["deep"]), "/sub/deep": (1, 3, [])}
    lines = sorted(f"{r['path'].rsplit('/', 1)[1]}|{r['mtime']}|{r['size']}" for r in one.collect())
    assert SRC.signatures(one).first()["signature"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_listing_as_a_stream(spark, tmp_path):
    root = media(tmp_path / "in")
    seen = []
    n = logs.pushed(SRC.batches(spark, root, 1), lambda df: seen.extend(r["kind"] for r in df.collect()), lambda: False, f"file://{tmp_path}/c1")
    assert sorted(seen) == ["image", "video"] and n >= 2
    assert logs.pushed(SRC.batches(spark, root, 1), seen.append, lambda: True, f"file://{tmp_path}/c2") == 0


def test_geo_names_and_countries(spark, tmp_path):
    (tmp_path / "cities").write_text("\t".join(["1", "Oslo", "Oslo", "", "59.9", "10.7", "P", "PPLC", "NO", "", "12", "0301"]) + "\n")
    (tmp_path / "a1").write_text("NO.12\tOslo County\tx\t1\n")
    (tmp_path / "a2").write_text("NO.12.0301\tOslo kommune\tx\t1\n")
    r = SRC.geo_names(spark, *[f"file://{tmp_path}/{n}" for n in ("cities", "a1", "a2")]).first()
    assert tuple(r) == ("Oslo", "NO", "Oslo County", "Oslo kommune", 59.9, 10.7)
    names = {r["country_code"]: r["country"] for r in SRC.country_names(spark).collect()}
    assert names["NO"] == "Norway" and names["FR"] == "France" and len(names) > 200


def split(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    e = spark.read.parquet(EVENTS)
    e.where("event_id % 2 = 0").unionByName(e.where("event_id % 10 = 0")).repartition(3).write.parquet(path)
    return path


def test_streams_equal_tables(spark, tmp_path):
    path = split(spark, tmp_path)
    table = spark.read.parquet(path)
    hourly = logs.drained(logs.hourly(logs.read_log(spark, path, 1)), "t_hourly", f"file://{tmp_path}/h")
    shape = lambda df: {(r["hour"], r["event_type"], r["events"], round(r["value"], 6)) for r in df.collect()}
    assert shape(hourly) == shape(logs.hourly(table))
    single = logs.drained(logs.once(logs.read_log(spark, path)), "t_once", f"file://{tmp_path}/o", "append")
    assert sorted(r["event_id"] for r in single.collect()) == sorted(r["event_id"] for r in logs.once(table).collect())
    sessions = logs.drained(logs.sessions(logs.read_log(spark, path)), "t_sessions", f"file://{tmp_path}/s")
    assert {tuple(r) for r in sessions.collect()} == {tuple(r) for r in logs.sessions(table).collect()}


def test_job_states(spark, tmp_path):
    rows = [(1, 1, "queued", None, None, "a"), (1, 2, "running", 0, 9, None), (1, 3, None, 5, None, None), (2, 1, "queued", None, None, "b"), (2, 2, "failed", None, None, None)]
    d = spark.createDataFrame(rows, "job_id int, seq int, state string, done int, total int, at string")
    want = {1: ("running", 5, 9, "a"), 2: ("failed", None, None, "b")}
    assert {r["job_id"]: tuple(r)[1:] for r in logs.job_states(d).collect()} == want
    d.repartition(5, F.col("seq")).write.parquet(f"file://{tmp_path}/jobs")
    stream = logs.read_log(spark, f"file://{tmp_path}/jobs", 1)
    assert {r["job_id"]: tuple(r)[1:] for r in logs.drained(logs.job_states(stream), "t_jobs", f"file://{tmp_path}/j").collect()} == want


def test_a_cancelled_push_goes_on_where_it_stopped(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    for i in range(4):
        spark.range(i * 5, i * 5 + 5).coalesce(1).write.mode("append").parquet(path)
    seen, stream = [], lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path)
    push = lambda df: seen.extend(r["id"] for r in df.collect())
    assert logs.pushed(stream(), push, lambda: len(seen) >= 5, f"file://{tmp_path}/c") == 1 and len(seen) == 5
    assert logs.pushed(stream(), push, lambda: False, f"file://{tmp_path}/c") == 3 and sorted(seen) == list(range(20))


def test_timers_equal_their_tables_also_after_a_restart(spark, tmp_path):
    rnd = random.Random(2)
    rows = sorted((datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rnd.randint(0, 60 * 24 * 60)), u) for u in range(12) for _ in range(rnd.randint(1, 14)))
    rows += [(rows[0][0], 0), (rows[3][0], 1), (rows[-1][0] + datetime.timedelta(hours=2), 99), (rows[5][0], None)]
    table = spark.createDataFrame([(i, t, u, rnd.choice(["deleted", "seen", "other"])) for i, (t, u) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string")
    path = f"file://{tmp_path}/log"
    table.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(path)
    files = sorted(f for f in os.listdir(tmp_path / "log") if f.endswith(".parquet"))
    for k, f in enumerate(files):  # read in the order of their times
        os.utime(tmp_path / "log" / f, (1_700_000_000 + k, 1_700_000_000 + k))
    shape = lambda df: Counter((r["key"], r["what"], r["at"]) for r in df.collect())
    what = F.col("event_type")
    day = T.DAY
    cases = {
        "stones": (lambda: T.Tombstones(keep=day, grace=10 * day), lambda: T.tombstones_on_table(table, what, keep=day, grace=10 * day)),
        "jobs": (lambda: T.Jobs(timeout=2 * day, ends=("seen",)), lambda: T.jobs_on_table(table, what, timeout=2 * day, ends=("seen",))),
    }
    for name, (processor, twin) in cases.items():
        stream = lambda: T.timed(logs.read_log(spark, path, 1), processor(), what)  # noqa: E731, B023
        out, again = (f"file://{tmp_path}/{name}{k}" for k in (1, 2))
        T.played(stream(), out, f"{out}-c")
        want = shape(twin())
        assert shape(spark.read.parquet(out)) == want and len({k[1] for k in want}) >= 2
        assert T.played(stream(), again, f"{again}-c", batches=2) >= 2
        T.played(stream(), again, f"{again}-c")
        assert shape(spark.read.parquet(again)) == want


def test_timers_of_many_keys_share_a_state(spark, tmp_path):
    """A call to the store for each key and a row in it for each event took most of the time (F20)."""

    class Stored:  # a state store in memory that counts rows
        def __init__(self):
            self.rows, self.timers = {}, []

        def getListState(self, name, schema):
            return self.state(name)

        def getValueState(self, name, schema):
            return self.state(name, one=True)

        def registerTimer(self, at):
            self.timers.append(at)

        def state(self, name, one=False):
            kept = self.rows.setdefault(name, [])
            put = lambda rows: kept.__setitem__(slice(None), rows)
            return SimpleNamespace(exists=lambda: bool(kept), get=lambda: (kept[0] if kept else None) if one else iter(list(kept)), appendValue=kept.append, appendList=kept.extend, put=put, clear=kept.clear, update=lambda row: put([row]))

    n = 3000
    frame = pd.DataFrame({"key": [i % 50 for i in range(n)], "ms": [1000 + i for i in range(n)], "number": range(n), "what": ["seen" if i % 7 == 0 else "other" for i in range(n)]})
    handle, jobs = Stored(), T.Jobs(timeout=60, ends=("seen",))
    jobs.init(handle)
    assert list(jobs.handleInputRows((1,), iter([frame]), None)) == [] and handle.timers == [1000]
    assert len(handle.rows["waiting"]) == 1  # of 3000 events
    (said,) = jobs.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2000), None)
    assert {w: k for w, k in Counter(said["what"]).items() if w == "seen"} == {"seen": sum(i % 7 == 0 for i in range(1000))} and set(said["key"]) == set(range(50))
    assert len(handle.rows["waiting"]) == 1 and len(handle.rows["kept"]) == 1 and handle.timers[-1] == 2000

    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=37 * i), i * i % 23, ("deleted", "seen", "other")[i % 5 % 3]) for i in range(600)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    path = f"file://{tmp_path}/log"
    table.repartitionByRange(3, "ts").write.parquet(path)
    files = sorted(f for f in os.listdir(tmp_path / "log") if f.endswith(".parquet"))
    for k, f in enumerate(files):
        os.utime(tmp_path / "log" / f, (1_700_000_000 + k, 1_700_000_000 + k))
    shape = lambda df: Counter((r["key"], r["what"], r["at"]) for r in df.collect())
    for name, processor, twin in (("stones", T.Tombstones(T.DAY, 3 * T.DAY), T.tombstones_on_table(table, F.col("event_type"), keep=T.DAY, grace=3 * T.DAY)), ("jobs", T.Jobs(10 * T.HOUR, ("seen",)), T.jobs_on_table(table, F.col("event_type"), timeout=10 * T.HOUR, ends=("seen",)))):
        out, want = f"file://{tmp_path}/{name}", shape(twin)
        stream = T.timed(logs.read_log(spark, path, 1), processor, F.col("event_type"), groups=2)
        assert T.played(stream, out, f"{out}-c", batches=1) >= 1
        T.played(stream, out, f"{out}-c")
        assert shape(spark.read.parquet(out)) == want and len({k[1] for k in want}) >= 2
