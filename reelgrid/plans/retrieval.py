"""Search queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators import retrieval as rt
from reelgrid.plans import standins as si
from reelgrid.plans.catalog import SYN, VOCAB, _created
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

CJK = "translate(lower(text), 'aeiou', '的一是不了')"
CH = "regexp_extract_all({t}, '[\\x{{4e00}}-\\x{{9fff}}]')"
TOK = ("list_distinct(list_concat(regexp_extract_all({t}, '[a-z0-9]+'), list_transform(" + CH + ", lambda x: 'c:' || x), "
       "list_transform(list_zip(list_slice(" + CH + ", 1, -2), list_slice(" + CH + ", 2, -1)), lambda z: 'b:' || z[1] || z[2])))")


def tok(t: str) -> str:
    return TOK.format(t=t)


@query("rt1_tokens", f"""SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {tok('l')} AS t FROM
  (SELECT doc_id, lower(text) || ' ' || {CJK} AS l FROM documents))""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    t = tx.tokens(F.concat("text", F.lit(" "), F.translate(F.lower("text"), "aeiou", "的一是不了")))
    return d.select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(F.sort_array(t), " ")).alias("digest"))


FIELDS_SQL = """f AS (SELECT id, 'name' AS field, 3.0 AS w, lower(name) AS t FROM m UNION ALL SELECT id, 'tags', 2.5, lower(array_to_string(tags, ',')) FROM m
  UNION ALL SELECT id, 'description', 1.5, lower(description) FROM m UNION ALL SELECT id, 'rel_path', 1.0, lower(replace(rel_path, '/', ' ')) FROM m),
 p AS (SELECT id, field, w, unnest(list_distinct(regexp_extract_all(t, '[a-z0-9]+'))) AS token FROM f),
 qt AS (SELECT qid, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS token FROM q),
 strict AS (SELECT qid, id, field, w * count(*) AS s FROM p JOIN qt USING (token) GROUP BY qid, id, field, w),
 lm AS (SELECT qid, qt.token AS qtok, v.token FROM qt, (SELECT DISTINCT token FROM p) v WHERE length(qt.token) >= 5 AND contains(v.token, qt.token)),
 loose AS (SELECT qid, id, field, w * 0.6 * count(DISTINCT qtok) AS s FROM p JOIN lm USING (token) GROUP BY qid, id, field, w),
 lexf AS (SELECT * FROM strict UNION ALL SELECT * FROM loose l WHERE NOT EXISTS (SELECT 1 FROM strict s WHERE s.qid = l.qid AND s.id = l.id AND s.field = l.field)),
 lex AS (SELECT qid, id, sum(s) AS score FROM lexf GROUP BY qid, id)"""


@query("rt2_lexical_scores", with_sql("m", "q", body=", " + FIELDS_SQL + " SELECT qid, id, cast(round(score, 6) AS double) AS score FROM lex"))
def _(spark, sf):
    s = rt.lexical_scores(si.queries(spark, sf), si.materials(spark, sf))
    return s.select("qid", "id", F.round("score", 6).alias("score"))


def cjk_queries(spark: SparkSession, sf: str) -> DataFrame:
    return si.queries(spark, sf).select("qid", F.translate("query", "aeiou", "的一是不了").alias("query"))


SIDE_SQL = f"""qc AS (SELECT qid, translate(query, 'aeiou', '的一是不了') AS query FROM q),
 qk AS (SELECT qid, {tok('query')} AS t FROM qc),
 qt2 AS (SELECT qid, unnest(t) AS token, len(list_filter(t, lambda x: starts_with(x, 'b:'))) AS nb FROM qk),
 cp AS (SELECT id, channel, unnest({tok('l')}) AS token FROM (SELECT id, channel, lower(text) AS l FROM sc)),
 ch AS (SELECT qid, id, channel, count(*) AS n, count(*) FILTER (starts_with(token, 'b:')) AS b, max(nb) AS nb FROM cp JOIN qt2 USING (token)
   WHERE NOT starts_with(token, 'c:') GROUP BY ALL)"""


@query("rt3_sidecar_channels", with_sql("sc", "q", body=", " + SIDE_SQL + """
 SELECT qid, id, cast(round(sum(0.35 * n), 6) AS double) AS score FROM ch WHERE NOT (nb >= 2 AND b < 2) GROUP BY qid, id"""))
def _(spark, sf):
    docs = si.sidecars(spark, sf).select("id").distinct()
    s = rt.lexical_scores(cjk_queries(spark, sf), docs, {"none": F.lit("")}, si.sidecars(spark, sf))
    return s.select("qid", "id", F.round("score", 6).alias("score"))


DENSE_SQL = """mean AS (SELECT list(x ORDER BY pos) AS mu FROM (SELECT pos, avg(x) AS x FROM
   (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec) GROUP BY pos)),
 cv AS (SELECT mid, label, list_transform(list_zip(v, mu), lambda z: z[1] - z[2]) AS c FROM vec, mean),
 cq AS (SELECT qid, list_transform(list_zip(qv, mu), lambda z: z[1] - z[2]) AS c FROM lv, mean),
 dn AS (SELECT qid, mid, list_dot_product(cv.c, cq.c) / sqrt(list_dot_product(cv.c, cv.c)) / sqrt(list_dot_product(cq.c, cq.c)) AS cos FROM cv, cq)"""


@query("rt4_dense_scores", with_sql("vec", "lv", body=", " + DENSE_SQL + " SELECT qid, mid AS id, round(cos, 6) AS cos FROM dn"))
def _(spark, sf):
    return rt.dense_scores(si.label_vectors(spark, sf), si.vectors(spark, sf)).select("qid", "id", F.round("cos", 6).alias("cos"))


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One text query per label vector: the frequent word of the label's first document."""
    v = si.vectors(spark, sf)
    d = si.table(spark, sf, "documents").select(F.col("doc_id").alias("mid"), "text")
    first = d.join(v, "mid").groupBy(F.col("label").alias("qid")).agg(F.min_by("text", "mid").alias("t"))
    return first.select("qid", F.array_join(tx.words("t"), " ").alias("query"))


LQ = """q AS (SELECT label AS qid, array_to_string(regexp_extract_all(lower(arg_min(text, doc_id)), '[a-z0-9]+'), ' ') AS query
  FROM documents JOIN vec ON mid = doc_id GROUP BY label)"""
RRF_SQL = "WITH " + si.SQL["m"] + ", " + si.SQL["vec"] + ", " + si.SQL["lv"] + ", " + LQ + ", " + FIELDS_SQL + ", " + DENSE_SQL + """,
 base AS (SELECT id, doc_id, row_number() OVER (ORDER BY created_s DESC, id) AS bp FROM m),
 allq AS (SELECT q.qid, b.id, b.doc_id, bp, coalesce(round(score, 9), 0) AS sc, lex.id IS NOT NULL AS hit FROM q CROSS JOIN base b LEFT JOIN lex ON lex.qid = q.qid AND lex.id = b.id),
 lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sc DESC, bp) - 1 AS lr FROM allq),
 dr AS (SELECT dn.qid, base.id, cos, row_number() OVER (PARTITION BY dn.qid ORDER BY cos DESC, bp) - 1 AS dr FROM dn JOIN base ON base.doc_id = dn.mid),
 fu AS (SELECT lr.qid, lr.id, bp, lr, dr, 20.0 / (60 + lr) + 1.0 / (60 + coalesce(dr, 1000000)) AS fused FROM lr LEFT JOIN dr USING (qid, id) WHERE hit OR coalesce(cos, -1) >= 0.25)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    m = si.materials(spark, sf)
    lex = rt.lexical_scores(label_queries(spark, sf), m)
    dense = rt.dense_scores(si.label_vectors(spark, sf), si.vectors(spark, sf))
    dense = dense.withColumn("id", tx.padded_id("id")).join(m.select("id"), "id", "left_semi")
    return rt.rrf(lex, dense, rt.base_positions(m))


@query("rt5_rank_fusion", RRF_SQL + " SELECT qid, id, bp AS base_pos, lr AS lex_rank, dr AS dense_rank, cast(round(fused, 6) AS double) AS fused FROM fu")
def _(spark, sf):
    return _fused(spark, sf).select("qid", "id", "base_pos", "lex_rank", "dense_rank", F.round("fused", 6).alias("fused"))


@query("rt6_rerank", RRF_SQL + """, kp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bp) AS kp FROM fu),
 dt AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(name || ' ' || description || ' ' || array_to_string(tags, ',')), '[a-z0-9]+'))) AS token FROM m),
 rs AS (SELECT qid, id, count(*) AS rs FROM kp JOIN dt USING (id) JOIN qt USING (qid, token) WHERE kp <= 60 GROUP BY qid, id)
 SELECT qid, id, CASE WHEN kp > 60 THEN kp ELSE row_number() OVER (PARTITION BY qid, kp > 60 ORDER BY coalesce(rs, 0) DESC, kp) END AS pos FROM kp LEFT JOIN rs USING (qid, id)""")
def _(spark, sf):
    m = si.materials(spark, sf)
    docs = m.select("id", F.concat_ws(" ", "name", "description", F.array_join("tags", ",")).alias("text"))
    return rt.rerank(_fused(spark, sf), label_queries(spark, sf), docs).select("qid", "id", "pos")


@query("rt7_chunk_paragraphs")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.chunk_rows(d, rt.chunk_paragraphs("text")).select("id", "chunk", F.md5("text").alias("digest"))


@query("rt8_chunk_fixed", """SELECT doc_id AS id, i AS chunk, md5(substring(t, cast(i * 680 + 1 AS bigint), 800)) AS digest FROM (SELECT doc_id, trim(text, ' ') AS t,
  unnest(range(0, 1 + greatest(cast(ceil((length(trim(text, ' ')) - 800) / 680.0) AS bigint), 0))) AS i FROM documents) WHERE t <> ''""")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.chunk_rows(d, rt.chunk_fixed("text")).select("id", F.col("chunk").cast("long").alias("chunk"), F.md5("text").alias("digest"))


@query("rt9_chunk_lines")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return rt.chunk_rows(d, rt.chunk_lines("text")).select("id", "chunk", F.md5("text").alias("digest"))


@query("rt10_chunk_search")
def _(spark, sf):
    return rt.chunk_search(si.queries(spark, sf), si.materials(spark, sf)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


TOP_SQL = "WITH " + si.SQL["m"] + ", " + si.SQL["q"] + ", " + FIELDS_SQL + """,
 rk AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, created_s DESC, id) AS rank FROM lex JOIN m USING (id))"""


@query("rt2_lexical_topk", TOP_SQL + " SELECT qid, id, cast(round(score, 6) AS double) AS score, rank FROM rk WHERE rank <= 10")
def _(spark, sf):
    m = si.materials(spark, sf)
    top = rt.lexical_top(si.queries(spark, sf), m, 10)
    return top.select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("rt11_append_body_hits", TOP_SQL + """, r AS (SELECT qid, id, rank FROM rk WHERE rank <= 10),
 e AS (SELECT rk.qid, rk.id, rk.rank FROM rk JOIN m USING (id) WHERE rk.rank <= 40 AND kind = 'docs' AND rk.rank > 10)
 SELECT qid, id, rank, 'rank' AS via FROM r UNION ALL SELECT e.qid, e.id, e.rank + n, 'body' FROM e JOIN (SELECT qid, max(rank) AS n FROM r GROUP BY qid) USING (qid)""")
def _(spark, sf):
    m = si.materials(spark, sf)
    top = rt.lexical_top(si.queries(spark, sf), m, 40)
    extra = top.join(m.select("id", "kind", "name"), "id").select("qid", "id", "kind", "name", "rank")
    return rt.append_hits(top.where("rank <= 10"), extra)


@query("rt12_append_image_hits", "WITH " + si.SQL["m"] + ", " + si.SQL["vec"] + ", " + si.SQL["lv"] + ", " + LQ + ", " + FIELDS_SQL + """,
 c AS (SELECT qid, lpad(cast(mid AS varchar), 9, '0') AS id, list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)) AS s FROM vec, lv),
 few AS (SELECT * FROM lex WHERE qid % 3 <> 0),
 n AS (SELECT qid, count(*) AS n FROM few GROUP BY qid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rn FROM c),
 h AS (SELECT qid, max(s) AS top, min(s) AS sec FROM r WHERE rn <= 2 GROUP BY qid HAVING max(s) >= 0.11 AND max(s) - min(s) >= 0.001)
 SELECT qid, id, round(s, 6) AS score FROM c JOIN h USING (qid) WHERE s >= top - 0.001 AND coalesce((SELECT n FROM n WHERE n.qid = c.qid), 0) < 3
  AND NOT EXISTS (SELECT 1 FROM few WHERE few.qid = c.qid AND few.id = c.id)""")
def _(spark, sf):
    q = label_queries(spark, sf)
    lex = rt.lexical_scores(q, si.materials(spark, sf))
    # A third of the queries have no lexical hits.
    lex = lex.where("qid % 3 <> 0")
    hits = rt.score_vectors(si.label_vectors(spark, sf), si.vectors(spark, sf)).select("qid", tx.padded_id("mid").alias("id"), F.col("cos").alias("score"))
    x = rt.append_image_hits(q.withColumn("intent", F.lit("text")), lex, hits, gap=0.001)
    return x.withColumn("score", F.round("score", 6))


VTOP = """ SELECT qid, mid, score, rank FROM (SELECT qid, mid, round_even(cos, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round_even(cos, 4) DESC, mid) AS rank
  FROM (SELECT qid, mid, list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)) AS cos FROM vec, lv) WHERE cos >= 0.15) WHERE rank <= 20"""


@query("rt13_vector_topk", with_sql("vec", "lv", body=VTOP))
def _(spark, sf):
    v = si.vectors(spark, sf)
    return rt.vector_topk(si.label_vectors(spark, sf), v, 20).select("qid", "mid", "score", "rank")


@query("rt13_frame_channel", with_sql("vec", "lv", body=""" SELECT qid, mid, score, rank FROM (SELECT qid, mid, round_even(cos, 4) AS score,
  row_number() OVER (PARTITION BY qid ORDER BY round_even(cos, 4) DESC, mid) AS rank FROM (SELECT qid, mid // 4 AS mid, max(list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv))) AS cos
  FROM vec, lv GROUP BY 1, 2) WHERE cos >= 0.15) WHERE rank <= 20"""))
def _(spark, sf):
    v = si.vectors(spark, sf).withColumn("mid", F.floor(F.col("mid") / 4))
    return rt.vector_topk(si.label_vectors(spark, sf), v, 20, frames=v).select("qid", "mid", "score", "rank")


@query("rt14_kb_search", with_sql("vec", "lv", body=VTOP.replace("WHERE cos >= 0.15", "WHERE true").replace("rank <= 20", "rank <= 5")))
def _(spark, sf):
    return rt.vector_topk(si.label_vectors(spark, sf), si.vectors(spark, sf), 5, min_score=-1.0).select("qid", "mid", "score", "rank")


@query("rt15_search", "WITH " + si.SQL["m"] + """, q0 AS (SELECT item_id AS qid, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS query FROM benchmark),
 q1 AS (SELECT qid, query, CASE WHEN regexp_matches(query, '(^|[^a-z0-9])the([^a-z0-9]|$)') THEN ['article'] ELSE [] END AS ab,
  list_concat(CASE WHEN contains(query, 'tion') THEN ['action','motion'] ELSE [] END, CASE WHEN contains(query, 'ing') THEN ['gerund','action'] ELSE [] END) AS strong,
  CASE WHEN contains(query, 'with') THEN ['using','and'] ELSE [] END AS weak FROM q0),
 q AS (SELECT qid, query || ' ' || array_to_string(list_concat(ab, CASE WHEN len(strong) > 0 THEN strong ELSE weak END), ' ') AS query FROM q1), """ + FIELDS_SQL.replace("FROM m", "FROM m WHERE list_contains(usage, '短视频')") + """
 SELECT qid, id, favorite, cast(round(score, 6) AS double) AS score, rank FROM (SELECT qid, id, l.doc_id IS NOT NULL AS favorite, score,
   row_number() OVER (PARTITION BY qid ORDER BY l.doc_id IS NOT NULL DESC, round(score, 9) DESC, created_s DESC, id) AS rank
   FROM lex JOIN m USING (id) LEFT JOIN labels l USING (doc_id)) WHERE rank > 5 AND rank <= 25""")
def _(spark, sf):
    syn = spark.createDataFrame(SYN, "ord int, key string, words array<string>, cls string")
    fav = si.table(spark, sf, "labels").select(tx.padded_id("doc_id").alias("mid"))
    x = rt.search(si.queries(spark, sf), si.materials(spark, sf), syn, fav, usage="短视频", offset=5, limit=20)
    return x.select("qid", "id", "favorite", F.round("score", 6).alias("score"), "rank")


@query("rt16_entity_search", with_sql("m", body=", e AS (SELECT DISTINCT id, unnest(list_concat(tags, ai_tags)) AS e FROM m) SELECT id, count(*) AS n FROM e WHERE e IN ('the', 'lang:en') GROUP BY id HAVING count(*) = 2"))
def _(spark, sf):
    from reelgrid.operators import catalog as cat

    m = si.materials(spark, sf)
    idx = cat.entity_index(m, m.select("id", F.explode("ai_tags").alias("entity")), [*VOCAB, "lang:en"])
    names = spark.createDataFrame([("english", "lang:en"), ("the", "lang:de")], "alias string, entity string")
    return rt.entity_search(idx, ["The/English", "no-such-thing"], "and", names)


@query("rt19_stale_vectors", with_sql("m", body=r""", t AS (SELECT id, doc_id, concat_ws(' | ', regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '[_\-.]+', ' ', 'g') || ' ' || ext[2:],
   array_to_string(tags, ' '), nullif(description, ''), kind, CASE WHEN external_path <> '' THEN 'ext' ELSE 'media ' || regexp_replace(source, '[_\-.]+', ' ', 'g') END) AS t FROM m)
 SELECT id, sha1(t)[:16] AS sig FROM t WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def _(spark, sf):
    texts = rt.doc_text(si.materials(spark, sf))
    good = si.table(spark, sf, "labels").where("quality = 1").select(tx.padded_id("doc_id").alias("id"))
    emb = texts.join(good, "id", "left_semi").select(F.col("id").alias("mid"), "sig", F.lit("m1").alias("model"))
    old = si.table(spark, sf, "labels").where("quality = 0").select(tx.padded_id("doc_id").alias("mid"), F.lit("old").alias("sig"), F.lit("m1").alias("model"))
    return rt.stale_vectors(texts, emb.unionByName(old), "m1").select("id", "sig")


@query("rt19_embed")
def _(spark, sf):
    v = rt.embed(rt.doc_text(si.materials(spark, sf)), rt.hashed_vectors, "hash64")
    return v.select("mid", "dim", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("words"))


@query("rt20_support_tier", "SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'strong' WHEN value / 100 >= 0.6 THEN 'partial' ELSE 'unsupported' END AS tier FROM events")
def _(spark, sf):
    return si.table(spark, sf, "events").select("event_id", rt.support_tier(F.col("value") / 100).alias("tier"))


@query("jn10_scene_of", "WITH " + si.SQL["cues"] + ", " + si.SQL["spans"] + """ SELECT track_id AS id, idx, t_ms, min(s.start_ms) AS scene_start_ms, arg_min(s.end_ms, s.start_ms) AS scene_end_ms
  FROM (SELECT track_id, idx, start_ms + 10 AS t_ms FROM cues) c LEFT JOIN (SELECT track_id AS tid, start_ms, end_ms FROM spans) s ON s.tid = track_id AND t_ms >= s.start_ms AND t_ms <= s.end_ms + 50 GROUP BY 1, 2, 3""")
def _(spark, sf):
    h = si.cues(spark, sf).select(F.col("track_id").alias("id"), "idx", (F.col("start_ms") + 10).alias("t_ms"))
    return rt.scene_of(h, si.spans(spark, sf).withColumnRenamed("track_id", "id"))


@query("wn22_locate_hits", "WITH " + si.SQL["cues"] + ", " + si.SQL["spans"] + ", " + si.SQL["q"] + """,
 qt AS (SELECT qid, unnest(list_distinct(regexp_extract_all(query, '[a-z0-9]+'))) AS token FROM q),
 l AS (SELECT track_id AS id, idx, start_ms, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM cues),
 b AS (SELECT qid, id, min(idx) AS line_no, arg_min(start_ms, idx) AS t_ms FROM l JOIN qt USING (token) GROUP BY 1, 2)
 SELECT qid, id, line_no, t_ms, min(s.start_ms) AS scene_start_ms FROM b LEFT JOIN (SELECT track_id AS tid, start_ms, end_ms FROM spans) s
  ON s.tid = id AND t_ms >= s.start_ms AND t_ms <= s.end_ms + 50 GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    lines = si.cues(spark, sf).select(F.col("track_id").alias("id"), F.lit("asr").alias("channel"), F.col("idx").alias("line_no"), F.col("start_ms").alias("t_ms"), "text")
    x = rt.locate_hits(si.queries(spark, sf), lines, si.spans(spark, sf).withColumnRenamed("track_id", "id"))
    return x.select("qid", "id", "line_no", "t_ms", "scene_start_ms")


@query("jn23_drop_vetoed", """WITH v AS (SELECT DISTINCT trim(p, ' ') AS p FROM (SELECT unnest([left(text, 14), CASE WHEN doc_id % 5 = 0 THEN right(text, 9) END]) AS p FROM documents JOIN labels USING (doc_id) WHERE quality = 0) WHERE trim(p, ' ') <> '')
 SELECT doc_id, md5(text) AS digest FROM documents WHERE trim(text, ' ') = '' OR NOT EXISTS (SELECT 1 FROM v WHERE contains(trim(text, ' '), p) OR contains(p, trim(text, ' ')))""")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    rows = si.table(spark, sf, "labels").join(si.table(spark, sf, "documents"), "doc_id").select(
        (F.col("quality") == 1).alias("accepted"), F.substring("text", 1, 14).alias("query"), F.when(F.col("doc_id") % 5 == 0, F.expr("right(text, 9)")).alias("proposed_query"))
    return rt.drop_vetoed(d, rt.vetoes(rows)).select("doc_id", F.md5("query").alias("digest"))


@query("jn27_assemble", TOP_SQL + """, u AS (SELECT qid % 4 AS goal, id, min(struct_pack(a := qid, b := rank)) AS o FROM rk WHERE rank <= 8 GROUP BY 1, 2)
 SELECT goal, id, pos FROM (SELECT goal, id, row_number() OVER (PARTITION BY goal ORDER BY o, id) AS pos FROM u JOIN m USING (id) WHERE list_contains(tags, 'role:master')) WHERE pos <= 12""")
def _(spark, sf):
    m = si.materials(spark, sf)
    q = si.queries(spark, sf)
    top = rt.lexical_top(q, m, 8)
    goals = q.select((F.col("qid") % 4).alias("goal"), "qid", F.col("qid").alias("ord"))
    return rt.assemble(goals, top, m, 12, "master").select("goal", "id", "pos")
