"""Near-duplicate queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import dedup as dd
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

PAIRS = "pr AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h)) AS dist FROM ph a JOIN ph b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= {d})"


@query("dd1_dhash", """WITH p AS (SELECT vec_id, list_transform(range(0, 72), lambda i: (cast(floor((embedding[i % 64 + 1] + 1) * 100) AS int) + i * 7) % 256) AS px FROM embeddings)
 SELECT vec_id, cast(list_sum(list_transform(range(0, 62), lambda k: CASE WHEN px[(k // 8) * 9 + k % 8 + 1] > px[(k // 8) * 9 + k % 8 + 2] THEN cast(1 AS bigint) << cast(k AS bigint) ELSE 0 END)) AS bigint) AS low_bits FROM p""")
def _(spark, sf):
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.lpad(F.hex(F.pmod(
        F.floor((F.get("embedding", i % 64) + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("int") + i * 7, F.lit(256))), 2, "0"))
    e = si.table(spark, sf, "embeddings").withColumn("thumb", F.unhex(F.array_join(px, "")))
    return e.select("vec_id", dd.dhash("thumb").bitwiseAND(F.lit((1 << 62) - 1)).alias("low_bits"))


@query("dd2_hamming", with_sql("ph", body="SELECT a.id, cast(bit_count(xor(a.h, b.h)) AS int) AS dist FROM ph a JOIN ph b ON b.id = a.id - a.id % 4"))
def _(spark, sf):
    p = si.phashes(spark, sf)
    b = p.select(F.col("id").alias("bid"), F.col("h").alias("bh"))
    return p.join(b, F.col("bid") == F.col("id") - F.col("id") % 4).select("id", dd.hamming("h", "bh").alias("dist"))


@query("jn19_near_dup_pairs", with_sql("ph", body=", " + PAIRS.format(d=10) + " SELECT a, b, cast(dist AS int) AS dist FROM pr"))
def _(spark, sf):
    return dd.near_dup_pairs(si.phashes(spark, sf), 10)


@query("jn19_near_dup_pairs_d3", with_sql("ph", body=", " + PAIRS.format(d=3) + " SELECT a, b, cast(dist AS int) AS dist FROM pr"))
def _(spark, sf):
    return dd.near_dup_pairs(si.phashes(spark, sf), 3)


@query("jn19_pair_report", with_sql("ph", body=", " + PAIRS.format(d=10) + " SELECT a, b, cast(dist AS int) AS dist FROM pr ORDER BY dist, a, b LIMIT 50"))
def _(spark, sf):
    return dd.near_dup_pairs(si.phashes(spark, sf), 10, 50)


@query("jn19_pair_count", with_sql("ph", body=", " + PAIRS.format(d=10) + " SELECT count(*) AS pairs FROM pr"))
def _(spark, sf):
    return dd.pair_count(si.phashes(spark, sf), 10)


@query("jn20_similar_to", with_sql("ph", body=""", q AS (SELECT label AS qid, min(vec_id) AS v FROM embeddings GROUP BY 1)
 SELECT qid, p.id, cast(bit_count(xor(p.h, b.h)) AS int) AS dist FROM q JOIN ph b ON b.id = v JOIN ph p ON p.id <> qid AND bit_count(xor(p.h, b.h)) <= 22"""))
def _(spark, sf):
    p = si.phashes(spark, sf)
    q = si.vectors(spark, sf).groupBy(F.col("label").cast("bigint").alias("qid")).agg(F.min("mid").alias("id")).join(p, "id").select("qid", F.col("h").alias("qh"))
    return dd.similar_to(p, q, 22).withColumn("qid", F.col("qid").cast("int"))


@query("dd3_clusters", with_sql("ph", recursive=True, body=", " + PAIRS.format(d=10) + """, e AS (SELECT a AS x, b AS y FROM pr UNION ALL SELECT b, a FROM pr),
 w AS (SELECT DISTINCT x AS id, x AS r FROM e UNION SELECT e.y, w.r FROM w JOIN e ON e.x = w.id), c AS (SELECT id, min(r) AS cluster FROM w GROUP BY 1)
 SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c"""))
def _(spark, sf):
    return dd.clusters(si.phashes(spark, sf), 10)
