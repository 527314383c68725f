"""Streams that keep state per key: latest durations, steps of jobs, silence.

The state of a key lives in Spark's state store (RocksDB, which ``keyed_state`` selects)
and is changed in place, so a batch touches only the keys it has events of.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from reelgrid.operators.jobs import cascade_failed, parent_status

LATE = "10 minutes"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEP_STATES = ("done", "skipped", "running", "queued", "failed", "partial")


def keyed_state(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, as those here need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _LastDurations(StatefulProcessor):
    """The last ``n`` (ts, duration) of a kind."""

    def __init__(self, n: int, probs: dict[str, float]):
        self.n, self.probs = n, probs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "us bigint, duration_ms double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        for part in rows:
            held += zip(part["us"].astype("int64").tolist(), part["duration_ms"].astype(float).tolist())
            held = heapq.nlargest(self.n, held)
        self.last.put(held)
        values = sorted(d for _, d in held)
        found = {name: values[round((len(values) - 1) * p)] for name, p in self.probs.items()}
        yield pd.DataFrame([{"kind": key[0], **found, "n": len(values), "ms_max": values[-1]}])

    def close(self) -> None:
        pass


def recent_latency(events: DataFrame, n: int = 300) -> DataFrame:
    """Percentiles over the last ``n`` durations of each kind, in update mode: a batch
    gives a row for each kind it has events of.  State: ``n`` pairs of numbers per kind."""
    probs = {"ms_p50": 0.5, "ms_p95": 0.95}
    x = events.where("duration_ms is not null").select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.unix_micros("ts").alias("us"), "duration_ms")
    schema = "kind string, ms_p50 double, ms_p95 double, n bigint, ms_max double"
    return x.groupBy("kind").transformWithStateInPandas(_LastDurations(n, probs), schema, "Update", "none")


class _JobSteps(StatefulProcessor):
    """The latest event of each step of a job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "step_key bigint", "us bigint, event_id bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            newest = part.sort_values(["us", "event_id"]).groupby("step_key").tail(1)
            for step, us, event, status in zip(newest["step_key"], newest["us"], newest["event_id"], newest["status"]):
                step, new = (int(step),), (int(us), int(event), status)
                if not self.steps.containsKey(step) or tuple(self.steps.getValue(step))[:2] < new[:2]:
                    self.steps.updateValue(step, new)
        n = Counter(value[2] for _, value in self.steps.iterator())
        yield pd.DataFrame([{"job_id": key[0], "total": n.total(), **{s: n[s] for s in STEP_STATES}}])

    def close(self) -> None:
        pass


def job_status(steps: DataFrame) -> DataFrame:
    """Parent status of every job touched by a batch of step events, in update mode.

    An event without status leaves its step as it is; an event older than the one
    known changes nothing.  State: one row per step of a job.
    """
    schema = "job_id bigint, total bigint, " + ", ".join(f"{s} bigint" for s in STEP_STATES)
    x = steps.where("status is not null").select("job_id", "step_key", "event_id", F.unix_micros("ts").alias("us"), "status")
    n = x.groupBy("job_id").transformWithStateInPandas(_JobSteps(), schema, "Update", "none")
    done = F.col("done") + F.col("skipped")
    return n.select("job_id", "total", done.alias("done"), F.concat_ws("/", done, "total").alias("label"), parent_status({s: F.col(s) for s in STEP_STATES}, done).alias("status"))


class _Silence(StatefulProcessor):
    """The last event of a job, with a timer ``silent_ms`` behind it."""

    def __init__(self, silent_ms: int, open_states: Sequence[str]):
        self.silent_ms, self.open_states = silent_ms, set(open_states)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, event_id bigint, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = tuple(self.last.get()) if self.last.exists() else None
        for part in rows:
            top = part.sort_values(["ms", "event_id"]).iloc[-1]
            new = (int(top["ms"]), int(top["event_id"]), top["status"])
            last = new if last is None or last[:2] < new[:2] else last
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.last.update(last)
        if last[2] in self.open_states:
            self.handle.registerTimer(last[0] + self.silent_ms)
        yield pd.DataFrame({"job_id": pd.Series([], dtype="int64"), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame([{"job_id": key[0], "last_ms": ms}])

    def close(self) -> None:
        pass


def silent_jobs(progress: DataFrame, silent_s: int = 900, late: str = LATE, open_states: Sequence[str] = ("queued", "running")) -> DataFrame:
    """Jobs whose last event left them open and that then kept silent for ``silent_s``
    seconds of event time: job_id, last_ts, status ``failed``; once per silence."""
    x = progress.withWatermark("ts", late).select("job_id", "ts", F.unix_millis("ts").alias("ms"), "event_id", F.coalesce("status", F.lit("")).alias("status"))
    found = x.groupBy("job_id").transformWithStateInPandas(_Silence(silent_s * 1000, open_states), "job_id bigint, last_ms bigint", "Append", "EventTime")
    return found.select("job_id", F.timestamp_millis("last_ms").alias("last_ts"), F.lit("failed").alias("status"))


def fail_silent_jobs(silent: DataFrame, jobs: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand on each batch of ``silent_jobs`` with the pending jobs of their packs that
    depend on them, directly or not (pack_id, workflow, cause): changes to the job table.

    ``jobs()``: pack_id, workflow, status, depends_on, read anew for each batch.
    Only what these failures bring down is told, not what earlier ones did.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        gone, now = df.select(F.col("job_id").alias("workflow")).distinct(), jobs()
        hit = now.join(gone, "workflow", "left_semi").where(~F.col("status").isin("done", "published", "failed"))
        waiting = now.where("status = 'pending'").join(gone, "workflow", "left_anti")
        fallen = cascade_failed(hit.withColumn("status", F.lit("failed")).unionByName(waiting))
        told = hit.select("pack_id", "workflow", F.lit("silent").alias("cause"))
        sink(told.unionByName(fallen.select("pack_id", "workflow", F.lit("dependency").alias("cause"))), epoch)

    return silent.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
