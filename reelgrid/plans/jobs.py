"""Job-state queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import jobs as jb
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql


def pack(spark: SparkSession, sf: str) -> DataFrame:
    return si.pack_jobs(spark, sf).select(
        "pack_id", F.col("job_id").alias("workflow"), "status", "depends_on",
        # Every fifth job needs what the job five before it puts out when it is done.
        F.expr("case when job_id % 5 = 0 then array(concat('out:', job_id - 5)) else cast(array() as array<string>) end").alias("depends_on_artifacts"),
    )


@query("wn6_queue_order", with_sql("pj", body="""SELECT job_id, row_number() OVER (ORDER BY CASE WHEN priority > 40 THEN 0 ELSE 1 END, score DESC, job_id % 100, job_id) AS queue_pos,
  row_number() OVER (ORDER BY CASE WHEN priority > 40 THEN 0 ELSE 1 END, score DESC, job_id % 100, job_id) - 1 AS ahead FROM pj WHERE status = 'pending'"""))
def _(spark, sf):
    j = si.pack_jobs(spark, sf).select(F.col("job_id").alias("id"), "status", F.expr("case when priority > 40 then 'high' else 'normal' end").alias("priority"), "score", F.expr("job_id % 100").alias("created_at"))
    return jb.queue_order(j).select(F.col("id").alias("job_id"), "queue_pos", "ahead")


@query("jn25_ready_jobs", with_sql("pj", body="""SELECT p.job_id AS workflow, (p.dep IS NULL OR d.status = 'done') AND (p.job_id % 5 <> 0 OR coalesce(o.status = 'done', false)) AS ready
  FROM pj p LEFT JOIN pj d ON d.job_id = p.dep LEFT JOIN pj o ON o.job_id = p.job_id - 5 WHERE p.status = 'pending'"""))
def _(spark, sf):
    arts = si.pack_jobs(spark, sf).where("status = 'done'").select("pack_id", F.expr("concat('out:', job_id)").alias("artifact"))
    p = pack(spark, sf).withColumn("workflow", F.col("workflow").cast("string")).withColumn("depends_on", F.col("depends_on").cast("array<string>"))
    return jb.ready_jobs(p, arts).select(F.col("workflow").cast("bigint").alias("workflow"), "ready")


@query("jn26_cascade_failed", with_sql("pj", recursive=True, body=""", w AS (SELECT job_id FROM pj WHERE status = 'failed' UNION ALL SELECT pj.job_id FROM w JOIN pj ON pj.dep = w.job_id WHERE pj.status = 'pending')
 SELECT DISTINCT w.job_id AS workflow FROM w JOIN pj USING (job_id) WHERE status = 'pending'"""))
def _(spark, sf):
    return jb.cascade_failed(pack(spark, sf)).select("workflow")


CHAIN = ["view", "click", "signup", "purchase"]


@query("jn28_upstream_of", """WITH t AS (SELECT DISTINCT user_id AS job_id, event_type AS step, list_position(['view','click','signup','purchase'], event_type) AS o FROM events WHERE event_type <> 'error')
 SELECT job_id, step, coalesce(lag(step) OVER (PARTITION BY job_id ORDER BY o), 'source') AS upstream FROM t""")
def _(spark, sf):
    t = si.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step"))
    return jb.upstream_of(t, CHAIN)


STEPS = "ls AS (SELECT job_id, step_key, arg_max(status, event_id) AS status FROM (SELECT *, row_number() OVER (PARTITION BY job_id, step_key ORDER BY ts DESC, event_id DESC) AS r FROM st) WHERE r = 1 GROUP BY 1, 2)"


@query("ag33_rollup_jobs", with_sql("st", body=", " + STEPS + """ SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('done','skipped')) AS done,
  count(*) FILTER (status IN ('done','skipped')) || '/' || count(*) AS label, CASE WHEN count(*) FILTER (status = 'running') > 0 THEN 'processing' WHEN count(*) FILTER (status = 'queued') > 0 THEN NULL
   WHEN count(*) FILTER (status = 'failed') = 0 THEN 'done' WHEN count(*) FILTER (status IN ('done','skipped')) = 0 THEN 'failed' ELSE 'partial' END AS status FROM ls GROUP BY 1"""))
def _(spark, sf):
    return jb.rollup_jobs(jb.latest_steps(si.step_events(spark, sf)))


@query("ag34_status_counts", with_sql("pj", body="SELECT status, count(*) AS n FROM pj GROUP BY 1"))
def _(spark, sf):
    return jb.status_counts(si.pack_jobs(spark, sf))


@query("ag34_video_status", with_sql("pj", body="""SELECT 'p' AS platform, job_id // 4 AS video_id, arg_min(status, CASE status WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 4 END) AS status FROM pj GROUP BY 2"""))
def _(spark, sf):
    j = si.pack_jobs(spark, sf).select(F.lit("p").alias("platform"), F.floor(F.col("job_id") / 4).alias("video_id"), "status")
    return jb.video_status(j)


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return si.table(spark, sf, "events").select(
        F.col("event_id").alias("task_id"), F.expr("element_at(array('done','failed','running','cancelled'), cast(event_id % 4 as int) + 1)").alias("status"),
        F.expr("event_id % 9").alias("steps"), F.expr("user_id * 10").alias("tokens"))


TASKS = "t AS (SELECT event_id AS task_id, ['done','failed','running','cancelled'][event_id % 4 + 1] AS status, event_id % 9 AS steps, user_id * 10 AS tokens FROM events)"


@query("ag17_task_stats", "WITH " + TASKS + """ SELECT count(*) AS total, count(*) FILTER (status <> 'running') AS terminal, round_even(count(*) FILTER (status = 'done') / count(*) FILTER (status <> 'running'), 3) AS success_rate,
  round_even(avg(steps) FILTER (status <> 'running'), 1) AS avg_steps, cast(sum(tokens) AS bigint) AS tokens FROM t""")
def _(spark, sf):
    return jb.task_stats(tasks(spark, sf))


@query("ag17_recent_failures", "WITH " + TASKS + " SELECT task_id, status FROM t WHERE status IN ('failed','cancelled') ORDER BY task_id DESC LIMIT 5")
def _(spark, sf):
    return jb.recent_failures(tasks(spark, sf)).select("task_id", "status")


@query("wn23_unique_slugs", """SELECT doc_id AS id, source || CASE WHEN r > 1 THEN '-' || r ELSE '' END AS final FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)""")
def _(spark, sf):
    a = si.table(spark, sf, "documents").select(F.col("lang").alias("topic_id"), F.col("doc_id").alias("id"), F.col("source").alias("slug"))
    return jb.unique_slugs(a).select("id", "final")


@query("io17_upsert_links", """SELECT 'p' AS platform, d.doc_id AS video_id, CASE WHEN quality IS NULL THEN source WHEN quality = 1 THEN source ELSE 'new' END AS title,
  CASE WHEN quality IS NULL OR quality = 1 THEN 'none' ELSE 'update' END AS op FROM documents d LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT 'p', 1000000000 + item_id, 'new', 'insert' FROM benchmark""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    links = d.select(F.lit("p").alias("platform"), F.col("doc_id").alias("video_id"), F.col("source").alias("title"), F.lit(1.0).alias("created_at"))
    upd = si.table(spark, sf, "labels").join(d.select("doc_id", "source"), "doc_id").select(
        F.lit("p").alias("platform"), F.col("doc_id").alias("video_id"), F.expr("case when quality = 1 then source else 'new' end").alias("title"), F.lit(2.0).alias("updated_at"))
    new = si.table(spark, sf, "benchmark").select(F.lit("p").alias("platform"), (F.col("item_id") + 1000000000).alias("video_id"), F.lit("new").alias("title"), F.lit(2.0).alias("updated_at"))
    return jb.upsert_links(links, upd.unionByName(new), ["title"]).select("platform", "video_id", "title", "op")


@query("pf21_feed_rows", """SELECT doc_id AS id, md5(lower(source || ' ' || text || ' ' || lang || ' ' || source || ' ' || lang)) AS haystack FROM documents WHERE contains(lower(source || ' ' || text || ' ' || lang || ' ' || source || ' ' || lang), 'tion')""")
def _(spark, sf):
    a = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("summary"), F.col("lang").alias("author"), F.array("source", "lang").alias("points"))
    return jb.feed_rows(a, "Tion").select("id", F.md5("haystack").alias("haystack"))


@query("pf20_decide_frames", """WITH x AS (SELECT doc_id, lang, lower(text) AS t, doc_id % 4 <> 3 AS v FROM documents), h AS (SELECT *, cast(contains(t, 'ing') AS int) + cast(contains(t, 'ment') AS int) AS a, cast(contains(t, 'tion') AS int) + cast(contains(t, 'the') AS int) AS k FROM x)
 SELECT doc_id AS id, CASE WHEN NOT v OR lang NOT IN ('en','fr') THEN 'none' WHEN a >= 1 AND a >= k THEN 'gif' WHEN k > a THEN 'none' WHEN a = 0 AND k = 0 THEN 'jpg' ELSE 'gif' END AS media FROM h""")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic_id"), "text", F.expr("doc_id % 4 <> 3").alias("has_video"))
    return jb.decide_frames(d, ["en", "fr"], ["ing", "ment"], ["tion", "the"]).select("id", "media")


@query("ag42_audit_articles", with_sql("cues", body="""SELECT track_id AS id, count(DISTINCT idx % 3) AS langs, count(*) AS cues, CASE WHEN count(DISTINCT idx % 3) < 3 OR track_id % 5 = 0 THEN 'warn' ELSE 'ok' END AS severity FROM cues GROUP BY track_id"""))
def _(spark, sf):
    a = si.cues(spark, sf).groupBy(F.col("track_id").alias("id")).agg(F.countDistinct(F.expr("idx % 3")).alias("langs"), F.count(F.lit(1)).alias("cues"))
    a = a.withColumn("clock", F.expr("case when id % 5 = 0 then 'remix' else 'source' end"))
    return jb.audit_articles(a, 3).drop("clock")
