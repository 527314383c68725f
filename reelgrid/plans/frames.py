"""Frame-box queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators import frames as fr
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return si.frame_boxes(spark, sf).withColumnRenamed("event_id", "box")


@query("pf22_target_boxes", with_sql("fb", body="SELECT event_id AS box FROM fb WHERE contains(text, 'view') OR contains(text, 'error 3') OR NOT (x1 < 100 OR x0 > 200 OR y1 < 0 OR y0 > 10)"))
def _(spark, sf):
    return fr.target_boxes(boxes(spark, sf), [(100, 0, 200, 10)], ["view", "error 3"]).select("box")


@query("ag37_drop_resident", with_sql("fb", body=""", k AS (SELECT *, cast(floor((y0 + y1) / 2 / 20) AS int) AS pos, substring(replace(text, ' ', ''), 1, 6) || ':' || cast(floor((y0 + y1) / 2 / 24) + floor((y1 - y0) / 24) AS int) AS tx FROM fb),
 n AS (SELECT video_id, count(DISTINCT frame) AS n FROM fb GROUP BY 1), p AS (SELECT video_id, pos FROM k JOIN n USING (video_id) GROUP BY 1, 2, n HAVING count(*) > 0.5 * n), t AS (SELECT video_id, tx FROM k JOIN n USING (video_id) GROUP BY 1, 2, n HAVING count(*) > 0.5 * n)
 SELECT event_id AS box FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video_id = k.video_id AND p.pos = k.pos) AND NOT EXISTS (SELECT 1 FROM t WHERE t.video_id = k.video_id AND t.tx = k.tx)"""))
def _(spark, sf):
    return fr.drop_resident(boxes(spark, sf)).select("box")


@query("wn15_cluster_lines", with_sql("fb", body=""", l AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM fb WINDOW w AS (PARTITION BY video_id, frame ORDER BY y0, x0, y1, x1, text)),
 b AS (SELECT *, cast(sum(CASE WHEN y0 - py1 > greatest(py1 - py0, 1) * 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame ORDER BY y0, x0, y1, x1, text) AS bigint) AS block FROM l)
 SELECT video_id, frame, block, string_agg(text, ' ' ORDER BY y0, x0, y1, x1, text) AS text, min(y0) AS y0, max(y1) AS y1 FROM b GROUP BY 1, 2, 3"""))
def _(spark, sf):
    return fr.cluster_lines(boxes(spark, sf)).select("video_id", "frame", "block", "text", "y0", "y1")


WN16_SQL = """, l AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM fb WINDOW w AS (PARTITION BY video_id, frame ORDER BY y0, x0, y1, x1, text)),
 b AS (SELECT *, cast(sum(CASE WHEN y0 - py1 > greatest(py1 - py0, 1) * 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, frame ORDER BY y0, x0, y1, x1, text) AS bigint) AS block FROM l),
 k AS (SELECT video_id, frame, block, (min(y0) + max(y1)) / 2 AS cy, greatest(1.0, max(y1) - min(y0)) AS h FROM b GROUP BY 1, 2, 3),
 o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, block) AS p FROM k),
 r AS (SELECT video_id, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS track, []::DOUBLE[] AS c, []::DOUBLE[] AS t FROM (SELECT DISTINCT video_id FROM o) UNION ALL
  SELECT video_id, p, frame, block, coalesce(nr, len(c) + 1) - 1, CASE WHEN nr IS NULL THEN list_append(c, cy) ELSE list_transform(c, lambda x, i: CASE WHEN i = nr THEN x + 0.1::DOUBLE * (cy - x) ELSE x END) END,
   CASE WHEN nr IS NULL THEN list_append(t, h) ELSE list_transform(t, lambda x, i: CASE WHEN i = nr THEN greatest(x, h) ELSE x END) END FROM
  (SELECT *, CASE WHEN list_min(d) IS NOT NULL THEN list_position(d, list_min(d)) END AS nr FROM (SELECT r.video_id, o.p, o.frame, o.block, o.cy, o.h, c, t,
    list_transform(c, lambda x, i: CASE WHEN abs(x - o.cy) <= 0.35::DOUBLE * greatest(1.0, least(o.h, t[i])) THEN abs(x - o.cy) END) AS d FROM r JOIN o ON o.video_id = r.video_id AND o.p = r.p + 1)))"""


@query("wn16_assign_tracks", with_sql("fb", recursive=True, body=WN16_SQL + " SELECT video_id, frame, block, track FROM r WHERE p > 0"))
def _(spark, sf):
    return fr.assign_tracks(fr.cluster_lines(boxes(spark, sf))).select("video_id", "frame", "block", "track")


@query("wn14_frames_to_intervals")
def _(spark, sf):
    tracked = fr.assign_tracks(fr.cluster_lines(boxes(spark, sf)))
    return fr.frames_to_intervals(tracked, 1000)


IOU = """greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas"""


@query("wn17_smooth_boxes", with_sql("fb", body=", p AS (SELECT a.event_id AS box, " + IOU + " FROM fb a JOIN fb b ON a.video_id = b.video_id AND abs(a.frame - b.frame) = 1) SELECT DISTINCT box FROM p WHERE inter / (areas - inter) >= 0.3"))
def _(spark, sf):
    return fr.smooth_boxes(boxes(spark, sf)).select("box")


@query("ag39_stable_boxes")
def _(spark, sf):
    return fr.stable_boxes(boxes(spark, sf)).select("video_id", "box", "rank")


@query("dd5_nms")
def _(spark, sf):
    return fr.nms(boxes(spark, sf)).select("video_id", "box")


@query("ag40_removal_qc", "SELECT user_id AS video_id, count(*) FILTER (event_type = 'view' AND value < 12) AS missed, count(*) FILTER (event_type <> 'view' AND value > 12) AS damaged FROM events GROUP BY 1")
def _(spark, sf):
    d = si.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), (F.col("event_type") == "view").alias("is_target"), F.col("value").alias("diff"))
    return fr.removal_qc(d)


PX = "px AS (SELECT vec_id, label, list_transform(embedding, lambda e: cast(cast(floor((e + 1) * 160) AS int) % 256 AS double)) AS p FROM embeddings)"


@query("ag38_band_scores", "WITH " + PX + """, s AS (SELECT vec_id, list_avg(p) AS mean, sqrt(list_sum(list_transform(p, lambda v: (v - list_avg(p)) * (v - list_avg(p)))) / len(p)) AS std, len(list_filter(p, lambda v: v >= 200)) / len(p) AS bright FROM px)
 SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, round(bright, 6) AS bright FROM s""")
def _(spark, sf):
    e = si.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor((x + F.lit(1).cast("float")) * F.lit(160).cast("float")).cast("int"), F.lit(256)).cast("double")).alias("pixels"))
    x = fr.band_scores(e)
    return x.select("vec_id", *[F.round(c, 6).alias(c) for c in ["mean", "std", "bright"]])


@query("ag38_band_verdict", """WITH s AS (SELECT user_id, value / 100 AS s FROM events) SELECT user_id AS video_id, round(avg(s), 4) AS score, count(*) FILTER (s >= 0.28) AS hits, avg(s) >= 0.24 AND count(*) FILTER (s >= 0.28) >= greatest(2, count(*) // 2) AS detected FROM s GROUP BY 1""")
def _(spark, sf):
    return fr.band_verdict(si.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), (F.col("value") / 100).alias("score")))


@query("jn18_interpolate_boxes", """WITH s AS (SELECT user_id AS video_id, event_id AS frame, value AS cx FROM events WHERE event_type IN ('view', 'click')), f AS (SELECT user_id AS video_id, event_id AS frame FROM events),
 b AS (SELECT f.video_id, f.frame, (SELECT max(frame) FROM s WHERE s.video_id = f.video_id AND s.frame <= f.frame) AS p, (SELECT min(frame) FROM s WHERE s.video_id = f.video_id AND s.frame >= f.frame) AS n FROM f)
 SELECT b.video_id, b.frame, round(1e-8 + CASE WHEN p IS NULL THEN sn.cx WHEN n IS NULL OR n = p THEN sp.cx ELSE sp.cx + (sn.cx - sp.cx) * (b.frame - p) / (n - p) END, 6) AS cx
 FROM b LEFT JOIN s sp ON sp.video_id = b.video_id AND sp.frame = p LEFT JOIN s sn ON sn.video_id = b.video_id AND sn.frame = n""")
def _(spark, sf):
    e = si.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.col("value").alias("cx"), "event_type")
    s = e.where("event_type in ('view', 'click')").select("video_id", "frame", "cx", F.lit(1.0).alias("cy"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h"))
    return fr.interpolate_boxes(e, s).select("video_id", "frame", F.round(F.col("cx") + 1e-8, 6).alias("cx"))


CUTS = """cu AS (SELECT DISTINCT user_id AS id, event_id * 977 % 600000 AS t FROM events WHERE event_type = 'view'), du AS (SELECT user_id AS id, 650000 AS d FROM events GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t) AS pos, count(*) OVER (PARTITION BY id) AS n FROM cu),
 th AS (SELECT id, t FROM r WHERE n <= 10 OR list_contains(list_transform(range(0, 10), lambda i: cast(round_even(i * (n - 1) / 9, 0) AS bigint) + 1), pos)),
 bo AS (SELECT id, t FROM th WHERE t > 0 UNION SELECT id, 0 FROM du UNION SELECT id, d FROM du), sc AS (SELECT id, t AS start_ms, lead(t) OVER (PARTITION BY id ORDER BY t) AS end_ms FROM bo)"""


def _scenes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = si.table(spark, sf, "events")
    cuts = e.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.expr("event_id * 977 % 600000").alias("t_ms"))
    dur = e.select(F.col("user_id").alias("id"), F.lit(650000).cast("long").alias("duration_ms")).distinct()
    return fr.scenes(cuts, dur, 10), dur


@query("wn18_scenes", "WITH " + CUTS + " SELECT * FROM sc WHERE end_ms IS NOT NULL")
def _(spark, sf):
    return _scenes(spark, sf)[0]


@query("wn19_crop_windows", "WITH " + CUTS + """, s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_ms) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, first_value(start_ms) OVER (PARTITION BY id ORDER BY end_ms - start_ms DESC, start_ms) AS lg FROM sc WHERE end_ms IS NOT NULL)
 SELECT id, CASE WHEN i = 0 THEN 'opening' WHEN n > 2 AND i = 2 THEN 'third' WHEN start_ms = lg THEN 'longest' WHEN i = n // 2 THEN 'middle' ELSE 'last' END AS label, start_ms, end_ms, i AS scene_index FROM s
 WHERE i = 0 OR (n > 2 AND i = 2) OR start_ms = lg OR i = n // 2 OR i = n - 1 UNION ALL SELECT id, 'whole', 0, d, -1 FROM du""")
def _(spark, sf):
    sc, dur = _scenes(spark, sf)
    return fr.crop_windows(sc, dur)
