"""Reader and writer transformations applied to whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import tags as tg
from reelgrid.sources import catalog_io as ci
from reelgrid.sources import cues_io as qi
from reelgrid.sources import documents as dm
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"


@query("io2_channel_text", with_sql("sc", body="SELECT channel, count(*) AS n, cast(sum(length(text)) AS bigint) AS chars FROM sc GROUP BY 1"))
def _(spark, sf):
    return si.sidecars(spark, sf).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("io3_inventory", "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, sha256(text)[:12] AS id FROM documents")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"), F.octet_length("text").cast("long").alias("length"))
    return ci.inventory(files).select(F.col("path").cast("long").alias("doc_id"), "size", "sha256", "id")


@query("io4_upsert_materials", with_sql("m", body=""", i AS (SELECT m.*, quality FROM m JOIN labels USING (doc_id)),
 o AS (SELECT sha256, min(id) AS owner FROM m GROUP BY 1)
 SELECT m.id, CASE WHEN quality IS NULL THEN 'none' ELSE 'updated' END AS op, m.location, m.created_s, m.form,
  CASE WHEN quality IS NULL THEN m.rel_path ELSE m.external_path END AS rel_path, array_to_string(m.topics, ',') AS topics
 FROM m LEFT JOIN labels l ON l.doc_id = m.doc_id AND m.location = 'external'
 UNION ALL SELECT sha256('b' || item_id)[:12], 'added', 'external', NULL, NULL, '/new/' || item_id, NULL FROM benchmark"""))
def _(spark, sf):
    m = si.materials(spark, sf)
    have = m.where("location = 'external'").join(si.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    cols = ["id", "kind", "name", "ext", "size", "sha256", "tags", "description", "source", "external_path"]
    again = have.withColumn("sha256", F.concat("id", F.lit("-v2"))).select(*cols)
    new = si.table(spark, sf, "benchmark").select(
        F.concat(F.lit("new"), F.col("item_id").cast("string")).alias("id"), F.lit("docs").alias("kind"), F.lit("n.txt").alias("name"), F.lit(".txt").alias("ext"), F.lit(1).cast("long").alias("size"),
        F.sha2(F.concat(F.lit("b"), F.col("item_id").cast("string")), 256).alias("sha256"), tg.no_tags().alias("tags"), F.col("text").alias("description"), F.lit("").alias("source"),
        F.concat(F.lit("/new/"), F.col("item_id").cast("string")).alias("external_path"))
    # An older version of each path comes along and must not win.
    older = again.withColumn("sha256", F.concat("sha256", F.lit("-old"))).withColumn("at", F.lit(1))
    both = again.withColumn("at", F.lit(2)).unionByName(older).unionByName(new.withColumn("at", F.lit(1)))
    made = F.when(F.col("op") != "added", F.unix_timestamp("created_at"))
    return ci.upsert_materials(m, both, "at").select("id", "op", "location", made.alias("created_s"), "form", "rel_path", F.array_join("topics", ",").alias("topics"))


SRT = "concat_ws('\\n', cast(idx + 1 as string), concat(clock, ' --> ', clock2, ' X1:10 Y1:20'), line)"


@query("io5_parse_cues", with_sql("cues", body=f"SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY idx) - 1 AS idx, start_ms, end_ms, md5({FLAT}) AS text FROM cues WHERE {FLAT} <> ''"))
def _(spark, sf):
    from reelgrid.functions.parse import to_clock

    c = si.cues(spark, sf).withColumn("line", F.trim(F.regexp_replace("text", r"\s+", " "))).where("line <> ''")
    c = c.withColumn("clock", to_clock("start_ms")).withColumn("clock2", to_clock("end_ms", "."))
    # One caption file per track, blocks divided by blank lines.
    blocks = c.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.expr(SRT).alias("b")))).alias("b"))
    files = blocks.select("track_id", F.array_join(F.transform("b", lambda r: r["b"]), "\r\n \n").alias("text"))
    return qi.parse_cues(files).select("track_id", F.col("idx").cast("long").alias("idx"), "start_ms", "end_ms", F.md5("text").alias("text"))


CK = "printf('%02d:%02d:%02d{s}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@query("io6_cue_blocks", with_sql("cues", body="SELECT track_id, no, md5(no || chr(10) || " + CK.format(s=",", c="start_ms") + " || ' --> ' || " + CK.format(s=",", c="end_ms") + " || chr(10) || trim(text, ' ') || chr(10)) AS srt FROM (SELECT *, idx + 1 AS no FROM cues)"))
def _(spark, sf):
    c = si.cues(spark, sf).withColumn("no", F.col("idx") + 1)
    return qi.cue_blocks(c).select("track_id", "no", F.md5("block").alias("srt"))


@query("io8_export_rows", with_sql("m", body="SELECT id, array_to_string(tags, ',') AS tags, array_to_string(ai_tags, ',') AS ai_tags, size FROM m"))
def _(spark, sf):
    return ci.export_frame(si.materials(spark, sf), ["id", "tags", "ai_tags", "size"])


@query("io10_watch_meta", r"""SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]+)"', 1) AS lang, views FROM (SELECT *, cast(NULL AS bigint) AS views FROM pages)""")
def _(spark, sf):
    return dm.watch_meta(si.table(spark, sf, "pages")).select("page_id", "title", "lang", "views")


@query("io11_channel_posts", """SELECT doc_id, 'src' || doc_id % 7 AS channel, cast(doc_id AS varchar) AS post_id, md5(trim(translate(text, '<>&', '   '), ' ')) AS text, n_chars * 1000 AS views, 1704067200.0::DOUBLE AS ts, 'ok' AS page FROM documents""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    html = F.concat(
        F.lit('<title>x</title><a class="tgme_widget_message_date" href="https://t.me/src'), F.col("doc_id") % 7, F.lit("/"), "doc_id",
        F.lit('"><time datetime="2024-01-01T00:00:00+00:00"></time></a><div class="tgme_widget_message_text js" dir="auto">'), F.translate("text", "<>&", "   "),
        F.lit('</div><span class="tgme_widget_message_views">'), F.col("n_chars"), F.lit("K</span>"))
    p = d.select(F.col("doc_id").alias("page_id"), html.alias("html"))
    x = dm.channel_posts(p).join(p.select("page_id", dm.page_class("html", F.lit("src")).alias("page")), "page_id")
    return x.select(F.col("page_id").alias("doc_id"), "channel", "post_id", F.md5("text").alias("text"), "views", "ts", "page")


@query("io12_to_candidates", with_sql("cand", body="""SELECT 'V' || video_id AS video_id, views, likes, comments, duration_sec, published_at, author FROM cand WHERE published_at >= 1e9 OR published_at < 1e9""").replace("published_at, author", "cast(NULL AS double) AS published_at, author"))
def _(spark, sf):
    c = si.candidates(spark, sf)
    item = F.to_json(F.struct(F.concat(F.lit("V"), F.col("video_id").cast("string")).alias("id"), "title", F.col("author").alias("channel"), F.col("views").alias("view_count"), F.col("likes").alias("like_count"),
                              F.col("comments").alias("comment_count"), F.col("duration_sec").alias("duration"), F.col("published_at").alias("timestamp")))
    x = dm.to_candidates(c.select(item.alias("item")), "youtube")
    return x.select("video_id", "views", "likes", "comments", "duration_sec", "published_at", "author")


@query("io13_export_articles", """SELECT d.doc_id AS video_id, d.source AS slug, count(l.doc_id) AS locales FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.lang <> 'de' GROUP BY 1, 2""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.lit("p").alias("platform"), F.col("doc_id").alias("video_id"), F.col("source").alias("slug"), F.col("lang").alias("source_lang"),
                 F.expr("case when lang = 'de' then 'draft' else 'ready' end").alias("status"), F.col("n_chars").alias("updated_at"))
    l = si.table(spark, sf, "labels").join(d, "doc_id").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("locale"), F.col("source").alias("title"), F.col("text").alias("summary"), F.array("lang").alias("points"))
    x = dm.export_articles(a, l)
    return x.select("video_id", "slug", F.coalesce(F.size("locales"), F.lit(0)).cast("long").alias("locales")).withColumn("locales", F.greatest("locales", F.lit(0)))


@query("io16_vector_blobs", "SELECT vec_id, cast(len(embedding) * 4 AS int) AS bytes, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 6) AS total FROM embeddings")
def _(spark, sf):
    e = si.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    x = ci.decode_vectors(ci.encode_vectors(e).drop("vec"))
    return x.select("vec_id", F.octet_length("blob").alias("bytes"), F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("io18_history_rows", "SELECT doc_id, substring(text, 1, 300) AS detail FROM documents WHERE lang <> 'es'")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select("doc_id", F.expr("case when lang = 'es' then ' ' else lang end").alias("action"), F.col("text").alias("detail"))
    return ci.history_rows(d).select("doc_id", "detail")
