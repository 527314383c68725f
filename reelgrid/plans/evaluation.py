"""Evaluation queries over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators import evaluation as ev
from reelgrid.operators import retrieval as rt
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.retrieval import TOP_SQL
from reelgrid.plans.standins import with_sql


def relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Good documents that contain the first word of a query."""
    q = si.queries(spark, sf).select(F.col("qid").alias("query"), F.substring_index("query", " ", 1).alias("w"))
    good = si.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    d = si.table(spark, sf, "documents").join(good, "doc_id", "left_semi").select(tx.padded_id("doc_id").alias("id"), F.explode(F.array_distinct(tx.words("text"))).alias("w"))
    return q.join(d, "w").select("query", "id")


GT = """gt AS (SELECT DISTINCT qid AS query, id FROM (SELECT qid, split_part(query, ' ', 1) AS w FROM q) JOIN
  (SELECT lpad(cast(doc_id AS varchar), 9, '0') AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents JOIN labels USING (doc_id) WHERE quality = 1) USING (w))"""
EVAL = ", " + GT + """, n AS (SELECT query, count(*) AS n FROM gt GROUP BY 1), h AS (SELECT gt.query, rank FROM gt JOIN rk ON rk.qid = gt.query AND rk.id = gt.id AND rank <= 20),
 e AS (SELECT n.query, coalesce(count(*) FILTER (rank <= 5) / least(n, 5), 0) AS p_at_min5, count(rank) / n AS r20, coalesce(1.0 / min(rank), 0) AS mrr,
   coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10 FROM n LEFT JOIN h USING (query) GROUP BY n.query, n)"""


def _run(spark: SparkSession, sf: str) -> DataFrame:
    m = si.materials(spark, sf)
    return rt.lexical_top(si.queries(spark, sf), m, 20).select(F.col("qid").alias("query"), "id", "rank")


def _rounded(df: DataFrame) -> DataFrame:
    for c in ev.METRICS:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("ag18_eval_retrieval", TOP_SQL + EVAL + " SELECT query, round(p_at_min5, 6) AS p_at_min5, round(r20, 6) AS r20, cast(round(mrr, 6) AS double) AS mrr, round(ndcg10, 6) AS ndcg10 FROM e")
def _(spark, sf):
    return _rounded(ev.eval_retrieval(_run(spark, sf), relevance(spark, sf)))


BASE = {"p_at_min5": 0.5, "r20": 0.05, "mrr": 0.99, "ndcg10": 0.2}


@query("ag19_check_gate", TOP_SQL + EVAL + """, g AS (SELECT unnest(['p_at_min5','r20','mrr','ndcg10']) AS metric, unnest([0.5, 0.05, 0.99, 0.2]::DOUBLE[]) AS baseline, unnest([avg(p_at_min5), avg(r20), avg(mrr), avg(ndcg10)]) AS actual FROM e)
 SELECT metric, baseline, round(actual, 6) AS actual, actual >= baseline - 0.02 AS pass, (SELECT bool_and(actual >= baseline - 0.02) FROM g) AS ok FROM g""")
def _(spark, sf):
    mean = ev.eval_mean(ev.eval_retrieval(_run(spark, sf), relevance(spark, sf)))
    return ev.check_gate(mean, BASE).drop("delta").withColumn("actual", F.round("actual", 6))


@query("ag20_gt_staleness", with_sql("q", body=", " + GT + """, a AS (SELECT query, count(*) AS n, count(*) FILTER (id IN (SELECT lpad(cast(vec_id AS varchar), 9, '0') FROM embeddings)) AS h FROM gt GROUP BY 1)
 SELECT count(*) AS queries, cast(sum(n) AS bigint) AS total, cast(sum(h) AS bigint) AS existing, cast(sum(n) - sum(h) AS bigint) AS missing, round_even(sum(h) / sum(n), 3) AS coverage, count(*) FILTER (h = 0) AS empty_queries,
  sum(h) / sum(n) < 0.5 OR count(*) FILTER (h = 0) >= greatest(1, count(*) // 2) AS stale FROM a"""))
def _(spark, sf):
    m = si.table(spark, sf, "embeddings").select(tx.padded_id("vec_id").alias("id"))
    return ev.gt_staleness(relevance(spark, sf), m)


@query("ag21_fingerprint", with_sql("m", body=""", h AS (SELECT sha256(concat_ws('|', coalesce(id, ''), coalesce(name, ''), coalesce(CAST(size AS VARCHAR), ''), coalesce(sha256, ''))) AS h FROM m),
 s AS (SELECT CAST('0x' || h[1:3] AS INT) AS bucket, sum(CAST('0x' || h[4:15] AS BIGINT)) AS a, sum(CAST('0x' || h[16:27] AS BIGINT)) AS b, count(*) AS n FROM h GROUP BY 1)
 SELECT sha256(string_agg(bucket || ':' || a || ':' || b || ':' || n, '|' ORDER BY bucket)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM s"""))
def _(spark, sf):
    return ev.fingerprint(si.materials(spark, sf), ["id", "name", "size", "sha256"])


@query("ag21_guard_state", "SELECT * FROM (VALUES ('same', 'fresh', false), ('text', 'warn', false), ('corpus', 'stale', true), ('count', 'stale', true), ('gt', 'stale', true), ('unsaved', 'legacy', true), ('no gt', 'missing', true)) t(saved, state, blocking)")
def _(spark, sf):
    m = si.materials(spark, sf)
    c = ev.fingerprint(m, ["id", "name", "size", "sha256"]).select(F.col("fingerprint").alias("corpus_hash"), F.col("rows").alias("materials"))
    t = ev.fingerprint(m, ["id", "description"]).select(F.col("fingerprint").alias("text_hash"))
    now = c.withColumn("k", F.lit(0)).join(t.withColumn("k", F.lit(0)), "k").drop("k")
    other = ev.fingerprint(m.where("doc_id > 0"), ["id", "name", "size", "sha256"]).select(F.col("fingerprint").alias("corpus_hash"), F.lit(0).alias("k"))
    cases = {
        "same": (now, True, False), "text": (now.withColumn("text_hash", F.lit("old")), True, False), "count": (now.withColumn("materials", F.col("materials") + 1), True, False),
        "corpus": (now.drop("corpus_hash").withColumn("k", F.lit(0)).join(other, "k").drop("k"), True, False),
        "gt": (now, True, True), "unsaved": (now.where("materials < 0"), True, False), "no gt": (now, False, False),
    }
    parts = [ev.guard_state(now, saved, has, old).select(F.lit(name).alias("saved"), "state", "blocking") for name, (saved, has, old) in cases.items()]
    return reduce(DataFrame.unionByName, parts)


def named(spark: SparkSession, sf: str) -> DataFrame:
    return si.materials(spark, sf).withColumn("blob", F.lower(F.concat_ws(" ", "name", "description")))


@query("ag22_derive_queries", with_sql("m", body=""", b AS (SELECT id, lower(name || ' ' || description) AS blob, list_distinct(regexp_extract_all(lower(regexp_replace(name, '\\.[^.]*$', '')), '[a-z][a-z0-9]+')) AS w FROM m),
 t AS (SELECT w AS query, min(id) AS f FROM (SELECT id, unnest(w) AS w FROM b) WHERE length(w) >= 2 AND NOT regexp_full_match(w, '[0-9a-f]{8,}') GROUP BY 1),
 h AS (SELECT query, f, list_sort(list(id)) AS ids FROM t JOIN b ON contains(blob, query) GROUP BY 1, 2 HAVING count(*) <= 8),
 o AS (SELECT ids, arg_min(query, f || query) AS query FROM h GROUP BY 1) SELECT query, unnest(ids) AS id FROM o"""))
def _(spark, sf):
    return ev.derive_queries(named(spark, sf))


@query("ag23_mine_labels", with_sql("q", "m", body=", " + GT + """, tg AS (SELECT id, unnest(tags) AS t FROM m), nm AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]{2,}'))) AS t FROM m),
 n AS (SELECT query, count(*) AS n FROM gt GROUP BY 1), co AS (SELECT t, count(*) AS corpus FROM tg GROUP BY 1),
 s AS (SELECT query, t, n, corpus FROM (SELECT query, t, count(*) AS c FROM gt JOIN tg USING (id) GROUP BY 1, 2) JOIN n USING (query) JOIN co USING (t) WHERE c / n >= 0.6 AND corpus <= greatest(n * 4.0, n + 5)),
 k AS (SELECT query, t FROM (SELECT query, t, count(*) AS c FROM gt JOIN nm USING (id) GROUP BY 1, 2) JOIN n USING (query) WHERE c / n >= 0.6),
 h AS (SELECT query, id, CASE WHEN corpus <= greatest(n * 1.5, n + 2) THEN 0 ELSE 1 END AS cls, t FROM s JOIN tg USING (t) UNION ALL SELECT query, id, 2, t FROM k JOIN nm USING (t))
 SELECT query, id, ['high','review','low'][min(cls) + 1] AS confidence, array_to_string(list_sort(list_distinct(list(t))), ',') AS evidence FROM h WHERE NOT EXISTS (SELECT 1 FROM gt WHERE gt.query = h.query AND gt.id = h.id) GROUP BY 1, 2"""))
def _(spark, sf):
    x = ev.mine_labels(relevance(spark, sf), si.materials(spark, sf), [])
    return x.withColumn("evidence", F.array_join("evidence", ","))


@query("stx_prune_gt", with_sql("q", body=", " + GT + " SELECT query, id FROM gt WHERE id IN (SELECT lpad(cast(vec_id AS varchar), 9, '0') FROM embeddings)"))
def _(spark, sf):
    return ev.prune_gt(relevance(spark, sf), si.table(spark, sf, "embeddings").select(tx.padded_id("vec_id").alias("id"))).select("query", "id")


@query("stm_merge_gt", with_sql("q", body=", " + GT + """, k AS (SELECT query, id FROM gt WHERE id IN (SELECT lpad(cast(vec_id AS varchar), 9, '0') FROM embeddings)), fr AS (SELECT item_id % 60 AS query, lpad(cast(item_id AS varchar), 9, '0') AS id FROM benchmark)
 SELECT * FROM k UNION ALL SELECT * FROM fr WHERE query NOT IN (SELECT query FROM k)"""))
def _(spark, sf):
    fresh = si.table(spark, sf, "benchmark").select((F.col("item_id") % 60).alias("query"), tx.padded_id("item_id").alias("id"))
    return ev.merge_gt(relevance(spark, sf), fresh, si.table(spark, sf, "embeddings").select(tx.padded_id("vec_id").alias("id")))


@query("stp_apply_candidates", with_sql("q", body=", " + GT + " SELECT query, id FROM gt UNION SELECT label, lpad(cast(vec_id AS varchar), 9, '0') FROM embeddings WHERE label % 3 = 0"))
def _(spark, sf):
    c = si.vectors(spark, sf).select(F.col("label").cast("bigint").alias("query"), tx.padded_id("mid").alias("id"), F.expr("element_at(array('high','review','low'), cast(label % 3 as int) + 1)").alias("confidence"))
    return ev.apply_candidates(relevance(spark, sf), c)


G6 = "list_transform(range(1, greatest(length({c}) - 5, 0) + 1), lambda i: substring({c}, i, 6))"


@query("ag24_chr_f", with_sql("cues", "pass2", body=", x AS (SELECT c.track_id * 1000 + c.idx AS id, lower(p.text) AS h, lower(c.text) AS r FROM cues c JOIN pass2 p ON p.track_id = c.track_id AND p.idx = c.idx), "
   "hg AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(CASE WHEN length(h) >= 6 THEN " + G6.format(c="h") + " ELSE [h] END) AS g FROM x) GROUP BY 1, 2), rg AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(CASE WHEN length(r) >= 6 THEN " + G6.format(c="r") + """ ELSE [r] END) AS g FROM x) GROUP BY 1, 2),
 s AS (SELECT coalesce(hg.id, rg.id) AS id, sum(hg.c) AS nh, sum(rg.c) AS nr, sum(least(coalesce(hg.c, 0), coalesce(rg.c, 0))) AS tp FROM hg FULL JOIN rg ON hg.id = rg.id AND hg.g = rg.g GROUP BY 1)
 SELECT id, round_even(CASE WHEN tp > 0 THEN 5.0 * (tp / nh) * (tp / nr) / (4.0 * (tp / nh) + tp / nr) ELSE 0 END, 4) AS chrf FROM s"""))
def _(spark, sf):
    c, p = si.cues(spark, sf), si.second_pass(spark, sf).select("track_id", "idx", F.col("text").alias("hyp"))
    x = c.join(p, ["track_id", "idx"]).select(F.expr("track_id * 1000 + idx").alias("id"), F.lit(0).alias("ref_no"), "hyp", F.col("text").alias("ref"))
    return ev.chr_f(x)


@query("ag25_eval_report", """SELECT lang, count(*) AS samples, count(*) FILTER (doc_id % 10 = 0) AS fails, round_even(avg(CASE WHEN doc_id % 10 <> 0 THEN doc_id % 7 / 8.0 END), 4)::DOUBLE AS chrf, round_even(avg(doc_id % 5), 3)::DOUBLE AS judge_avg,
  round_even(round_even(avg(CASE WHEN doc_id % 10 <> 0 THEN doc_id % 7 / 8.0 END), 4) - 0.25, 4)::DOUBLE AS chrf_delta FROM documents GROUP BY 1""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    s = d.select("lang", F.expr("case when doc_id % 10 <> 0 then cast((doc_id % 7) / 8.0D as double) end").alias("chrf"), F.expr("cast(doc_id % 5 as double)").alias("judge"))
    base = d.select("lang").distinct().select("lang", F.lit(0.25).alias("chrf"), F.lit(2.0).alias("judge_avg"))
    return ev.eval_report(s, base).drop("judge_delta")


@query("ag26_judge_decision", """SELECT event_id, CASE WHEN event_type = 'error' OR m < 3 THEN 'reject' WHEN event_type = 'view' OR m < 4 THEN 'human_review' ELSE 'accept' END AS decision FROM (SELECT event_id, event_type, (event_id % 6 + user_id % 6) / 2.0 AS m FROM events)""")
def _(spark, sf):
    e = si.table(spark, sf, "events")
    mean = ev.judge_mean(F.array(F.expr("cast(event_id % 6 as double)"), F.expr("cast(user_id % 6 as double)"), F.lit(None).cast("double")))
    sev = F.expr("case event_type when 'error' then 'MAJOR' when 'view' then 'minor' else 'none' end")
    return e.select("event_id", ev.judge_decision(sev, mean).alias("decision"))


def _proof(spark: SparkSession, sf: str) -> DataFrame:
    c = si.cues(spark, sf)
    p = si.second_pass(spark, sf).select("track_id", "idx", F.expr("concat(text, case when idx % 2 = 0 then ' x' else '' end)").alias("alt"))
    x = c.join(p, ["track_id", "idx"], "left").select(
        "track_id", "idx", F.lit("源").alias("src"), F.col("text").alias("prim"), "alt",
        F.expr("case when idx % 3 = 0 then 'reject' else 'accept' end").alias("decision"), F.lit(2.0).alias("score"), F.expr("2.0D + idx / 10.0D").alias("alt_score"))
    return ev.proofread(x, "en", 2)


PROOF = """, x AS (SELECT c.track_id, c.idx, p.text IS NOT NULL AND p.text <> '' AND c.idx % 2 = 0 AS sp FROM cues c LEFT JOIN pass2 p ON p.track_id = c.track_id AND p.idx = c.idx),
 y AS (SELECT *, sum(CASE WHEN sp THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY idx) AS used FROM x),
 z AS (SELECT track_id, idx, CASE WHEN NOT sp THEN 'consensus' WHEN used > 2 THEN 'judge_budget_exceeded' WHEN idx % 3 <> 0 THEN 'accept' WHEN idx / 10.0 > 0.25 THEN 'judge_preferred_alt' ELSE 'reject' END AS reason FROM y)"""


@query("ag27_proofread", with_sql("cues", "pass2", body=PROOF + " SELECT track_id, idx, reason FROM z"))
def _(spark, sf):
    return _proof(spark, sf).select("track_id", "idx", "reason")


@query("ag27_proofread_report", with_sql("cues", "pass2", body=PROOF + """ SELECT track_id, count(*) FILTER (reason = 'consensus') AS consensus, count(*) FILTER (reason = 'judge_preferred_alt') AS repaired,
  count(*) FILTER (reason IN ('judge_budget_exceeded', 'reject')) AS human_review, count(*) FILTER (reason <> 'consensus') AS divergent FROM z GROUP BY 1"""))
def _(spark, sf):
    return ev.proofread_report(_proof(spark, sf))
