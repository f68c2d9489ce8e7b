"""Event-time timers: tombstones that expire, purges after a grace period, and jobs that time out, as stateful streams.

Events of a key wait in state until the watermark has passed them and are then taken in the order of their times, so results
don't depend on how input is cut into batches or on a restart. Keys share states in groups, as a state of their own for each key costs
more than its events. Each processor has a twin on a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

HOUR, DAY = 3_600_000, 86_400_000

#: The state store that timers need.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}


class _InOrder(StatefulProcessor):
    """Takes the events ``(key, at, number, what)`` of a group of keys in order once the watermark is past them. Subclasses say what an
    event and the passing of time do to a key's state ``(since, stage)``. Both what waits and the states are JSON: a row for each frame of
    new events (10,000 at most, by Arrow's setting), and one for the states."""

    PART = 10_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events string")
        self.kept = handle.getValueState("kept", "states string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["ms"].astype("int64").tolist()
            new = zip(frame["key"].astype("int64").tolist(), at, frame["number"].astype("int64").tolist(), frame["what"].tolist())
            self.waiting.appendValue((json.dumps(list(new)),))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first)  # the first of them; the next is set when it is due
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() - 1  # all that is due is taken at the first timer, also what it leads to
        events = [e for (part,) in self.waiting.get() for e in json.loads(part)] if self.waiting.exists() else []
        before = self.kept.get() if self.kept.exists() else None
        states = {k: (since, stage) for k, since, stage in json.loads(before[0])} if before else {}
        due, rest, said = sorted(e for e in events if e[1] <= now), [e for e in events if e[1] > now], []
        for k, at, _, what in due:
            out: list[tuple] = []
            state = self.passed(states.get(k), at - 1, out)
            states[k] = self.met(state, at, what, out)
            said += [(k, *o) for o in out]
        for k, state in states.items():
            out = []
            states[k] = self.passed(state, now, out)
            said += [(k, *o) for o in out]
        states = {k: s for k, s in states.items() if s is not None}
        if due:
            parts = [(json.dumps(rest[i : i + self.PART]),) for i in range(0, len(rest), self.PART)]
            self.waiting.put(parts) if parts else self.waiting.clear()
        if states:
            self.kept.update((json.dumps([(k, *s) for k, s in states.items()]),))
        elif before:
            self.kept.clear()
        after = [at for at in map(self.next_due, states.values()) if at is not None and at > now] + [e[1] for e in rest]
        if after:
            self.handle.registerTimer(min(after))
        if said:
            yield pd.DataFrame(said, columns=["key", "what", "ms"])

    def close(self) -> None:
        pass


class Tombstones(_InOrder):
    """``deleted`` and ``seen`` events of an item. A deleted item is ``forgotten`` after ``keep`` ms (its tombstone can't explain a move any
    more) and ``purged`` after ``grace`` ms, unless it is seen before: then it is ``restored``. Later deletions of a deleted item don't count."""

    def __init__(self, keep: int = 24 * HOUR, grace: int = 30 * DAY):
        self.keep, self.grace = keep, grace

    def passed(self, state, now, out):
        for stage, (what, wait) in enumerate((("forgotten", self.keep), ("purged", self.grace))):
            if state is not None and state[1] == stage and state[0] + wait <= now:
                out.append((what, state[0] + wait))
                state = (state[0], stage + 1)
        return state

    def met(self, state, at, what, out):
        if what == "deleted":
            return state or (at, 0)
        if what == "seen" and state is not None and state[1] < 2:
            out.append(("restored", at))
        return None if what == "seen" else state

    def next_due(self, state):
        return state[0] + (self.keep, self.grace)[state[1]] if state[1] < 2 else None


class Jobs(_InOrder):
    """A job's events; one that is not an end (``ends``) must be followed by another within ``timeout`` ms, else the job has ``timed out``."""

    def __init__(self, timeout: int = 30 * 60_000, ends: tuple[str, ...] = ("done", "failed")):
        self.timeout, self.ends = timeout, ends

    def passed(self, state, now, out):
        if state is not None and state[0] + self.timeout <= now:
            out.append(("timed out", state[0] + self.timeout))
            return None
        return state

    def met(self, state, at, what, out):
        if what in self.ends:
            out.append((what, at))
            return None
        return (at, 0)

    def next_due(self, state):
        return state[0] + self.timeout


def _events(events: DataFrame, what: Column, key: str, late: str) -> DataFrame:
    e = events.select(F.col(key).cast("long").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").cast("long").alias("number"), what.alias("what"))
    e = e.where("key is not null and ms is not null and what is not null")
    return e.withWatermark("at", late) if events.isStreaming else e


def timed(events: DataFrame, processor: _InOrder, what: Column, key: str = "user_id", late: str = "1 hour", groups: int = 4096) -> DataFrame:
    """``key, what, at``: what the timers of a stream of ``(key, ts, event_id)`` say, for all times that the watermark (``late`` behind the
    latest event that takes part) has passed. Events without key, time or ``what`` take no part. Keys are dealt to ``groups``, which share a
    state; a checkpoint keeps its number, and a task holds one group's open keys and waiting events. Needs the settings ``STORE``."""
    e = _events(events, what, key, late).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)))
    out = e.groupBy("part").transformWithStateInPandas(processor, "key long, what string, ms long", "Append", "EventTime")
    return out.select("key", "what", F.timestamp_millis("ms").alias("at"))


def _horizon(e: DataFrame, late_ms: int) -> DataFrame:
    """The events below the last watermark of a stream over all of them, with that watermark beside them."""
    last = e.agg((F.max("ms") - late_ms).alias("horizon"))  # one row
    return e.join(F.broadcast(last), F.col("ms") < F.col("horizon"))


def tombstones_on_table(events: DataFrame, what: Column, key: str = "user_id", keep: int = 24 * HOUR, grace: int = 30 * DAY, late_ms: int = HOUR) -> DataFrame:
    """What ``timed`` with ``Tombstones`` gives once all of a table has streamed by."""
    order = W.partitionBy("key").orderBy("ms", "number")
    e = _horizon(_events(events, what, key, ""), late_ms).where("what in ('deleted', 'seen')")
    e = e.withColumn("before", F.lag("what").over(order)).withColumn("next_seen", F.min(F.when(F.col("what") == "seen", F.col("ms"))).over(order.rowsBetween(1, W.unboundedFollowing)))
    d = e.where("what = 'deleted' and (before is null or before = 'seen')")
    none = F.col("next_seen").isNull()
    at = lambda wait: F.col("ms") + F.lit(wait)
    lapsed = lambda wait: (none | (F.col("next_seen") > at(wait))) & (at(wait) < F.col("horizon"))
    said = lambda name, cond, ms: F.when(cond, F.struct(F.lit(name).alias("what"), ms.alias("ms")))
    each = F.array_compact(F.array(said("forgotten", lapsed(keep), at(keep)), said("purged", lapsed(grace), at(grace)), said("restored", ~none & (F.col("next_seen") <= at(grace)), F.col("next_seen"))))
    return d.select("key", F.explode(each).alias("o")).select("key", "o.what", F.timestamp_millis("o.ms").alias("at"))


def jobs_on_table(events: DataFrame, what: Column, key: str = "user_id", timeout: int = 30 * 60_000, ends: tuple[str, ...] = ("done", "failed"), late_ms: int = HOUR) -> DataFrame:
    """What ``timed`` with ``Jobs`` gives once all of a table has streamed by."""
    e = _horizon(_events(events, what, key, ""), late_ms).withColumn("next", F.lead("ms").over(W.partitionBy("key").orderBy("ms", "number")))
    end, due = F.col("what").isin(*ends), F.col("ms") + F.lit(timeout)
    late = ~end & (F.col("next").isNull() | (F.col("next") > due)) & (due < F.col("horizon"))
    e = e.select("key", F.when(end, F.struct("what", "ms")).when(late, F.struct(F.lit("timed out").alias("what"), due.alias("ms"))).alias("o")).where("o is not null")
    return e.select("key", "o.what", F.timestamp_millis("o.ms").alias("at"))


def played(stream: DataFrame, path: str, checkpoint: str, batches: int | None = None) -> int:
    """Run an append stream over all present input into Parquet at ``path`` (``batches``: stop after so many, to go on later with the same
    checkpoint) and return the number of batches. State lives on the executors' disks, its changes in ``checkpoint``."""
    spark, old = stream.sparkSession, {}
    for k, v in STORE.items():
        old[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        w = stream.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint)
        q = w.trigger(availableNow=True).start() if batches is None else w.trigger(processingTime="0 seconds").start()
        if batches is None:
            q.awaitTermination()
        else:
            while (q.lastProgress is None or q.lastProgress["batchId"] < batches - 1) and q.isActive:
                q.awaitTermination(1)
            q.stop()
        return (q.lastProgress or {"batchId": -1})["batchId"] + 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
