"""Discovery queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import discovery as dc
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

NOW = 915148800.0  # 1999-01-01, after the last order
FLOOR = "CASE platform WHEN '1-URGENT' THEN 150000 WHEN '5-LOW' THEN 50000 ELSE 150000 END"


def topics(spark: SparkSession) -> DataFrame:
    rows = [
        ("alpha", 24.0 * 900, 3, "platform", 60, "default", [("1-URGENT", 150000), ("5-LOW", 50000)]),
        ("beta", 0.0, 10, "total", 0, "velocity_first", [("1-URGENT", 150000), ("5-LOW", 50000)]),
    ]
    return spark.createDataFrame(
        rows, "id string, fresh_hours double, daily_quota_per_platform int, quota_scope string, min_duration_sec int, score_mode string, "
        "floors array<struct<platform:string,views:bigint>>")


FRESH = f"(topic_id = 'beta' OR ({NOW} - published_at) / 3600.0 <= 21600)"
SCORE = f"""ln(1 + views) + CASE WHEN topic_id = 'beta' THEN 3.5 ELSE 2.5 END * ln(1 + views / greatest(({NOW} - published_at) / 3600.0, 1.0)) + 0.5 * ln(1 + likes + 2 * comments)"""


@query("pf9_filter_fresh", with_sql("cand", body=f"SELECT video_id, topic_id FROM cand WHERE {FRESH}"))
def _(spark, sf):
    return dc.filter_fresh(si.candidates(spark, sf), topics(spark), NOW).select("video_id", "topic_id")


@query("pf10_filter_min_duration", with_sql("cand", body="SELECT video_id FROM cand WHERE topic_id = 'beta' OR duration_sec >= 60"))
def _(spark, sf):
    return dc.filter_min_duration(si.candidates(spark, sf), topics(spark)).select("video_id")


@query("pf11_filter_min_views", with_sql("cand", body=f"SELECT video_id FROM cand WHERE views >= {FLOOR}"))
def _(spark, sf):
    return dc.filter_min_views(si.candidates(spark, sf), topics(spark)).select("video_id")


@query("pf12_exclude_authors", with_sql("cand", body="SELECT video_id FROM cand WHERE lower(author) NOT IN ('customer#7', 'customer#000000007') OR author IS NULL"))
def _(spark, sf):
    return dc.exclude_authors(si.candidates(spark, sf), ["CUSTOMER#7", "Customer#000000007"]).select("video_id")


@query("pf13_needs_enrich", with_sql("cand", body="SELECT video_id, duration_sec % 7 = 0 AS need FROM cand"))
def _(spark, sf):
    c = si.candidates(spark, sf).withColumn("author", F.expr("case when duration_sec % 7 = 0 then '' else author end"))
    return c.select("video_id", dc.needs_enrich().alias("need"))


@query("pf14_title_hits", with_sql("cand", body="SELECT video_id, contains(lower(title), 'build') OR contains(lower(title), 'urgent') AS hit FROM cand"))
def _(spark, sf):
    c = si.candidates(spark, sf).withColumn("title", F.concat(F.lit("<em>"), "title", F.lit("</em>")))
    return c.select("video_id", dc.title_hits("title", ["BUILD", "Urgent", "em>"]).alias("hit"))


@query("rt17_relevance", with_sql("cand", body="""SELECT video_id, round(CASE WHEN contains(lower(title), 'building 1') THEN 100.0 WHEN contains(lower(title), 'building') AND contains(lower(title), '1') THEN 70.0
  ELSE 12.0 * (cast(contains(lower(title), 'building') AS int) + cast(contains(lower(title), '1') AS int)) END + 2.0 * ln(1 + greatest(0, views)), 6) AS score FROM cand"""))
def _(spark, sf):
    return dc.relevance(si.candidates(spark, sf), "Building 1").select("video_id", F.round("relevance", 6).alias("score"))


@query("rt18_score_candidates", with_sql("cand", body=f"SELECT video_id, round({SCORE}, 6) AS score FROM cand"))
def _(spark, sf):
    return dc.score_candidates(si.candidates(spark, sf), topics(spark), NOW).select("video_id", F.round("score", 6).alias("score"))


RANKED = f"""s AS (SELECT *, {SCORE} AS score FROM cand WHERE {FRESH} AND (topic_id = 'beta' OR duration_sec >= 60) AND views >= {FLOOR}),
 r AS (SELECT *, row_number() OVER (PARTITION BY topic_id, CASE WHEN topic_id = 'alpha' THEN platform ELSE '' END ORDER BY round(score, 9) DESC, video_id) AS rank FROM s),
 k AS (SELECT * FROM r WHERE rank <= CASE WHEN topic_id = 'alpha' THEN 3 ELSE 10 END)"""


@query("wn3_take_quota", with_sql("cand", body=", " + RANKED + " SELECT topic_id, platform, video_id, round(score, 6) AS score, rank FROM k"))
def _(spark, sf):
    x = dc.rank_candidates(si.candidates(spark, sf), topics(spark), NOW)
    return x.select("topic_id", "platform", "video_id", F.round("score", 6).alias("score"), "rank")


@query("wn4_shortlist", with_sql("cand", body=""", n AS (SELECT *, row_number() OVER (PARTITION BY topic_id, platform ORDER BY views DESC, video_id) AS r FROM cand WHERE duration_sec % 7 = 0),
 g AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY CASE platform WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, platform, r) AS rank FROM n WHERE r <= 9)
 SELECT topic_id, platform, video_id, rank FROM g WHERE rank <= 30"""))
def _(spark, sf):
    c = si.candidates(spark, sf).withColumn("author", F.expr("case when duration_sec % 7 = 0 then null else author end"))
    return dc.shortlist(c, ["5-LOW", "1-URGENT"], 3, 30).select("topic_id", "platform", "video_id", "rank")


@query("wn5_dedup_candidates", with_sql("cand", body=""", x AS (SELECT platform, video_id // 3 AS vid, video_id, views, 'u' || (video_id // 4) AS url FROM cand),
 a AS (SELECT *, row_number() OVER (PARTITION BY platform, vid ORDER BY views DESC, video_id) AS r FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY platform, url ORDER BY views DESC, video_id) AS q FROM a WHERE r = 1)
 SELECT platform, video_id AS src FROM b WHERE q = 1"""))
def _(spark, sf):
    c = si.candidates(spark, sf).select("platform", F.col("video_id").alias("src"), F.floor(F.col("video_id") / 3).alias("video_id"), "views",
                                        F.concat(F.lit("U"), F.floor(F.col("video_id") / 4).cast("string")).alias("url"))
    return dc.dedup_candidates(c, [F.desc("views"), F.col("src")]).select("platform", "src")


@query("ag35_crawl_report", with_sql("cand", body=", " + RANKED + """, a AS (SELECT topic_id, platform, grouping(topic_id, platform) AS level, count(*) AS raw FROM cand GROUP BY ROLLUP (topic_id, platform)),
 b AS (SELECT topic_id, platform, grouping(topic_id, platform) AS level, count(*) AS ranked FROM k GROUP BY ROLLUP (topic_id, platform))
 SELECT a.topic_id, a.platform, raw, coalesce(ranked, 0) AS ranked FROM a LEFT JOIN b ON a.topic_id IS NOT DISTINCT FROM b.topic_id AND a.platform IS NOT DISTINCT FROM b.platform AND a.level = b.level"""))
def _(spark, sf):
    c = si.candidates(spark, sf)
    return dc.crawl_report(c, dc.rank_candidates(c, topics(spark), NOW)).select("topic_id", "platform", "raw", "ranked")


@query("sl3_top_rows", with_sql("cand", body=", " + RANKED + " SELECT platform, video_id, round_even(score, 3) AS score, views, substring(title, 1, 80) AS title FROM k ORDER BY round(k.score, 9) DESC, video_id LIMIT 12"))
def _(spark, sf):
    return dc.top_rows(dc.rank_candidates(si.candidates(spark, sf), topics(spark), NOW))


@query("std_enqueue", with_sql("cand", body=""", j AS (SELECT platform, video_id // 2 AS vid, min(CASE WHEN video_id % 3 = 0 THEN 'done' ELSE 'pending' END) AS st FROM cand WHERE topic_id = 'alpha' GROUP BY 1, 2),
 c AS (SELECT platform, video_id // 2 AS vid, video_id AS ord, min(video_id) OVER (PARTITION BY platform, video_id // 2) AS f FROM cand)
 SELECT platform, ord, CASE WHEN st = 'done' THEN 'skipped_done' WHEN st IS NOT NULL OR ord > f THEN 'ignored' ELSE 'inserted' END AS outcome FROM c LEFT JOIN j USING (platform, vid)"""))
def _(spark, sf):
    c = si.candidates(spark, sf)
    half = F.floor(F.col("video_id") / 2)
    jobs = c.where("topic_id = 'alpha'").groupBy("platform", half.alias("video_id")).agg(F.min(F.expr("case when video_id % 3 = 0 then 'done' else 'pending' end")).alias("status"))
    batch = c.select("platform", half.alias("video_id"), F.col("video_id").alias("ord"))
    return dc.enqueue(jobs.withColumn("workflow", F.lit("all")), batch).select("platform", "ord", "outcome")
