"""Streams over the event log, run until they have read it, with batch SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.operators.scale import shared_folder
from reelgrid.plans import standins as si
from reelgrid.plans.jobs import STEPS, pack
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql
from reelgrid.streaming import jobs as sj
from reelgrid.streaming import keyed as kd

#: What has the watermark passed when the log ends?
PAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, as the table may be a file or a folder of files.
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")


def _latest(df: DataFrame, key: str) -> DataFrame:
    """The last row of each key of a stream in update mode."""
    spark = df.sparkSession
    out = _folder(spark)

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("__batch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/batch={epoch}")

    spark.createDataFrame([], df.schema).withColumn("__batch", F.lit(-1)).write.parquet(f"{out}/rows/batch=-1")
    df.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/*")
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__batch"))))
    return last.where("__n = 1").select(*df.columns)


@query("st2_recent_latency", with_sql("rq", body=""", l AS (SELECT kind, duration_ms AS d, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, duration_ms DESC) AS r FROM rq),
 s AS (SELECT kind, list_sort(list(d)) AS x FROM l WHERE r <= 300 GROUP BY 1)
 SELECT kind, x[cast(round_even((len(x) - 1) * 0.5, 0) AS int) + 1] AS ms_p50, x[cast(round_even((len(x) - 1) * 0.95, 0) AS int) + 1] AS ms_p95, cast(len(x) AS bigint) AS n, x[-1] AS ms_max FROM s"""))
def _(spark, sf):
    kd.keyed_state(spark)
    return _latest(kd.recent_latency(si.requests(spark, sf, _log(spark, sf))), "kind")


@query("st6_job_status", with_sql("st", body=", " + STEPS + """ SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('done','skipped')) AS done,
  count(*) FILTER (status IN ('done','skipped')) || '/' || count(*) AS label, CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'processing' WHEN count(*) FILTER (status = 'queued') > 0 THEN NULL
   WHEN count(*) FILTER (status = 'failed') = 0 THEN 'done' WHEN count(*) FILTER (status IN ('done','skipped')) = 0 THEN 'failed' ELSE 'partial' END AS status FROM ls GROUP BY 1"""))
def _(spark, sf):
    kd.keyed_state(spark)
    return _latest(kd.job_status(si.step_events(spark, sf, _log(spark, sf))), "job_id")


@query("st7_silent_jobs", with_sql("st", "pj", recursive=True, body=", " + STEPS.replace("ls AS", "l0 AS") + f""", la AS (SELECT job_id, max(ts) AS ts, arg_max(status, struct_pack(t := ts, e := event_id)) AS status FROM st GROUP BY 1),
 gone AS (SELECT job_id FROM la WHERE status IN ('queued', 'running') AND ts + INTERVAL 12 HOUR <= {PAST}),
 hit AS (SELECT pj.job_id FROM pj JOIN gone USING (job_id) WHERE status NOT IN ('done', 'published', 'failed')),
 w AS (SELECT job_id FROM hit UNION SELECT pj.job_id FROM w JOIN pj ON pj.dep = w.job_id WHERE pj.status = 'pending' AND pj.job_id NOT IN (SELECT job_id FROM gone))
 SELECT job_id AS workflow, CASE WHEN job_id IN (SELECT job_id FROM hit) THEN 'silent' ELSE 'dependency' END AS cause FROM w"""))
def _(spark, sf):
    kd.keyed_state(spark)
    out, jobs = _folder(spark), pack(spark, sf)
    rows = "pack_id bigint, workflow bigint, cause string"
    spark.createDataFrame([], rows).write.parquet(f"{out}/rows/batch=-1")
    silent = kd.silent_jobs(si.step_events(spark, sf, _log(spark, sf)), 12 * 3600)
    kd.fail_silent_jobs(silent, lambda: jobs, lambda x, e: x.write.mode("overwrite").parquet(f"{out}/rows/batch={e}"), f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows).parquet(f"{out}/rows/*").select("workflow", "cause")


@query("st9_alerts", with_sql("rq", body=f""", w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, kind, count(*) AS n, count(*) FILTER (NOT ok) AS bad, list_sort(list(duration_ms)) AS d FROM rq GROUP BY 1, 2),
 a AS (SELECT s, kind, unnest(list_filter([CASE WHEN bad / n > 0.2 THEN 'error_rate' END, CASE WHEN d[cast(ceil(0.95 * n) AS int)] > 40 THEN 'slow' END], lambda r: r IS NOT NULL)) AS rule FROM w WHERE s + INTERVAL 6 HOUR <= {PAST})
 SELECT cast(epoch(s) AS bigint) AS window_s, kind, rule FROM a"""))
def _(spark, sf):
    out = _folder(spark)
    told = sj.alert_stream(si.requests(spark, sf, _log(spark, sf)), 0.2, 40.0, "6 hours")
    sj.append_once(told, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{out}/rows/*").select(F.unix_timestamp("window_start").alias("window_s"), "kind", "rule")
