"""Structured Streaming jobs over event logs, step events, cues and files.

Event time is ``ts``; rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgrid import schemas
from reelgrid.functions.similarity import alike
from reelgrid.operators import catalog as cat
from reelgrid.operators import dedup, retrieval
from reelgrid.operators.cues import _norm_py
from reelgrid.operators.evaluation import fingerprint
from reelgrid.sources.catalog_io import inventory, upsert_materials

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT_LOG).option("mode", "DROPMALFORMED").json(path)


def windowed_metrics(events: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Request metrics per tumbling (or sliding) window and kind."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    n = F.count(F.lit(1))
    x = events.withWatermark("ts", late).groupBy(w.alias("w"), F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(
        n.alias("count"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"), F.count_if(F.coalesce("zero_hit", F.lit(False))).alias("zero_hits"),
        F.percentile_approx("duration_ms", [0.5, 0.95], 10_000).alias("p"), F.max("duration_ms").alias("ms_max"),
    )
    return x.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kind", "count", "errors", "zero_hits",
        F.get("p", F.lit(0)).alias("ms_p50"), F.get("p", F.lit(1)).alias("ms_p95"), "ms_max",
    )


Sink = Callable[[DataFrame, int], None]


def _generation(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    """The table a finished earlier batch left under ``path`` (empty at first)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    for e in range(epoch - 1, -1, -1):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/gen={e}/_SUCCESS")):
            return spark.read.schema(schema).parquet(f"{path}/gen={e}")
    return spark.createDataFrame([], schema)


def alerts(metrics: DataFrame, max_error_rate: float, max_p95: float) -> DataFrame:
    """Windows over a threshold, one row per window, kind and rule."""
    rate = F.col("errors") / F.col("count")
    rules = F.array(F.when(rate > max_error_rate, F.lit("error_rate")), F.when(F.col("ms_p95") > max_p95, F.lit("slow")))
    return metrics.select("window_start", "kind", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def alert_stream(events: DataFrame, max_error_rate: float, max_p95: float, width: str = "1 minute", late: str = LATE) -> DataFrame:
    """``alerts`` of a request stream, in append mode: a window is judged when the
    watermark has passed it, and each window, kind and rule is told once."""
    w = F.window("ts", width)
    x = events.withWatermark("ts", late).groupBy(w.alias("w"), F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"), F.percentile_approx("duration_ms", 0.95, 10_000).alias("ms_p95"),
    )
    told = alerts(x.withColumnRenamed("w", "window_start"), max_error_rate, max_p95).withColumnRenamed("window_start", "w")
    return told.dropDuplicatesWithinWatermark(["w", "kind", "rule"]).select(F.col("w.start").alias("window_start"), "kind", "rule")


def append_once(df: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to a table, a folder per batch: a batch that is run
    again after a failure replaces its own rows."""
    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return df.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CATALOG = (
    "id string, kind string, name string, ext string, size bigint, sha256 string, tags array<string>, description string, "
    "source string, external_path string, location string, created_at timestamp"
)


def catalog_sync(files: DataFrame, catalog_path: str, prepare: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Keep a catalog in step with a stream of binary files.

    Files are hashed and deduplicated; each batch is merged into the current
    catalog and written as a new generation next to a pointer file, so a batch
    that is run again after a failure gives the same generation.
    """
    def batch(df: DataFrame, epoch: int) -> None:
        current = _generation(df.sparkSession, catalog_path, epoch, CATALOG)
        merged = upsert_materials(current, prepare(inventory(df)))
        linked = cat.link_clip_parents(merged).select("id", F.col("tags").alias("__t"))
        out = merged.join(linked, "id", "left").withColumn("tags", F.coalesce("__t", "tags")).drop("__t", "op")
        out.write.mode("overwrite").parquet(f"{catalog_path}/gen={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint_watch(changes: DataFrame, read_catalog: Callable[[], DataFrame], cols: Sequence[str], log_path: str, checkpoint: str):
    """After each batch compare the catalog fingerprint with the last one logged; a
    change is one more folder of the log, which is never rewritten."""
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        schema = "fingerprint string, rows bigint, epoch bigint"
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{log_path}/batch=-1")
        log = spark.read.schema(schema).parquet(log_path).where(F.col("epoch") < epoch)
        now = fingerprint(read_catalog(), cols).withColumn("epoch", F.lit(epoch).cast("long")).select("fingerprint", "rows", "epoch")
        fresh = now.join(log.groupBy().agg(F.max_by("fingerprint", "epoch").alias("fingerprint")), "fingerprint", "left_anti")
        if not fresh.isEmpty():
            fresh.write.mode("overwrite").parquet(f"{log_path}/batch={epoch}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_intervals(lines: DataFrame, gap_ms: int = 400, late: str = LATE) -> DataFrame:
    """Frames to text intervals as they arrive (video_id, track, ts, text).

    An interval closes when the text changes, frames stop for ``gap_ms``, or
    the watermark passes its end.
    """
    schema = "video_id long, track long, start_ms long, end_ms long, text string"
    state_schema = "start_ms long, end_ms long, text string"
    cols = ["video_id", "track", "start_ms", "end_ms", "text"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            yield pd.DataFrame([(*key, *run)], columns=cols)
            state.remove()
            return
        rows = sorted((int(t), x) for b in batches for t, x in zip(b["ms"], b["text"]))
        for ms, text in rows:
            if run is not None and ms - run[1] <= gap_ms and alike(_norm_py(text), _norm_py(run[2]), 0.8):
                run[1] = max(run[1], ms)
                continue
            if run is not None:
                out.append((*key, *run))
            run = [ms, ms, text]
        state.update(tuple(run))
        state.setTimeoutTimestamp(max(run[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=cols)

    x = lines.withWatermark("ts", late).select("video_id", "track", "ts", F.unix_millis("ts").alias("ms"), "text")
    return x.groupBy("video_id", "track").applyInPandasWithState(update, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def stale_jobs(progress: DataFrame, silent: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Jobs without a progress event for ``silent``: one row per closed session
    whose last status was still open."""
    s = F.session_window("ts", silent)
    x = progress.withWatermark("ts", late).groupBy(s.alias("w"), "job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("last_status"), F.max("ts").alias("last_ts")
    )
    return x.where(F.col("last_status").isin("queued", "running")).select("job_id", "last_ts", F.lit("failed").alias("status"))


def vetoed_queries(queries: DataFrame, feedback: Callable[[], DataFrame], sink: Sink, checkpoint: str):
    """Queries without the vetoed ones, per batch; feedback is read anew each time."""
    def batch(df: DataFrame, epoch: int) -> None:
        sink(retrieval.drop_vetoed(df, retrieval.vetoes(feedback())), epoch)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_dup_check(incoming: DataFrame, stored: Callable[[], DataFrame], sink: Sink, checkpoint: str, d: int = 10, k: int = 5):
    """Advisory: the nearest stored hashes of every incoming hash (qid, qh), per batch."""
    def batch(df: DataFrame, epoch: int) -> None:
        ph = stored()
        sink(dedup.similar_to(ph, df, d, k).select("qid", "id", "dist", "rank"), epoch)

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined_passes(a: DataFrame, b: DataFrame, late: str = LATE, reach: str = "1 minute") -> DataFrame:
    """Cues of two passes of one video that overlap in time (ts = start, end_ts)."""
    x = a.withWatermark("ts", late).select("video_id", F.col("idx").alias("a_idx"), F.col("ts").alias("a_ts"), F.col("end_ts").alias("a_end"), F.col("text").alias("a_text"))
    y = b.withWatermark("ts", late).select(F.col("video_id").alias("b_video"), F.col("idx").alias("b_idx"), F.col("ts").alias("b_ts"), F.col("end_ts").alias("b_end"), F.col("text").alias("b_text"))
    near = F.expr(f"b_ts >= a_ts - interval {reach} AND b_ts <= a_ts + interval {reach}")
    cond = (F.col("video_id") == F.col("b_video")) & near & (F.col("a_ts") < F.col("b_end")) & (F.col("b_ts") < F.col("a_end"))
    return x.join(y, cond).drop("b_video")
