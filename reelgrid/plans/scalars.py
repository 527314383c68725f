"""Scalar functions applied to whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import language as lg
from reelgrid.functions import parse as ps
from reelgrid.functions import similarity as sm
from reelgrid.functions import text as tx
from reelgrid.operators.cues import fix_text
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql


@query("sc1_parse_count", "SELECT event_id, [event_id * 1000, cast(floor(value * 10) AS bigint) * 1000, event_id * 10000, event_id][event_id % 4 + 1] AS n FROM events")
def _(spark, sf):
    raw = F.expr("element_at(array(format_number(event_id * 1000, 0), concat(cast(floor(value * 10) as string), 'K'), concat(cast(event_id as string), '万'), concat(' ', cast(event_id as string), ' ')), cast(event_id % 4 as int) + 1)")
    return si.table(spark, sf, "events").select("event_id", ps.parse_count(raw).alias("n"))


@query("sc2_parse_duration", "SELECT event_id, cast(event_id AS int) AS sec FROM events")
def _(spark, sf):
    raw = F.expr("element_at(array(cast(event_id as string), concat('PT', floor(event_id / 3600), 'H', floor(event_id / 60) % 60, 'M', event_id % 60, 'S'), "
                 "concat(floor(event_id / 60), ':', lpad(cast(event_id % 60 as string), 2, '0')), concat_ws(':', floor(event_id / 3600), floor(event_id / 60) % 60, event_id % 60)), cast(event_id % 4 as int) + 1)")
    return si.table(spark, sf, "events").select("event_id", ps.parse_duration(raw).alias("sec"))


@query("sc3_parse_time", "SELECT o_orderkey, cast(CASE o_orderkey % 3 WHEN 1 THEN epoch(o_orderdate) ELSE epoch(date_trunc('day', o_orderdate)) END AS double) + CASE WHEN o_orderkey % 3 = 1 THEN 1e9 ELSE 0 END AS ts FROM orders")
def _(spark, sf):
    t = F.col("o_orderdate").cast("timestamp")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, ((F.unix_timestamp(t) + 1000000000) * 1000).cast("string")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    # Compact dates are read by the ISO parser, epoch values by the unix parser.
    out = F.when(F.col("o_orderkey") % 3 == 0, ps.parse_iso(raw)).otherwise(ps.first_time([raw]))
    return si.table(spark, sf, "orders").select("o_orderkey", out.alias("ts"))


@query("sc4_strip_markup", r"SELECT page_id, md5(substring(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' '), 1, 500)) AS digest FROM pages")
def _(spark, sf):
    return si.table(spark, sf, "pages").select("page_id", F.md5(ps.strip_markup("html")).alias("digest"))


@query("sc5_urls", """WITH u AS (SELECT doc_id, doc_id % 5 AS k, 1000000 + doc_id AS n, substring('abcdefghijk' || doc_id, length(cast(doc_id AS varchar)) + 1, 11) AS y FROM documents)
 SELECT doc_id, ['youtube','bilibili','douyin','hls','generic'][k + 1] AS platform,
  CASE k WHEN 0 THEN y WHEN 1 THEN 'BV1' || n WHEN 2 THEN cast(n AS varchar) WHEN 3 THEN sha256('https://cdn.example/' || doc_id || '/a.m3u8')[:16] END AS video_id,
  CASE k WHEN 0 THEN 'https://www.youtube.com/watch?v=' || y WHEN 1 THEN 'https://www.bilibili.com/video/BV1' || n WHEN 2 THEN 'https://www.douyin.com/video/' || n
   WHEN 3 THEN 'https://cdn.example/' || doc_id || '/a.m3u8?t=1' END AS canonical FROM u""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    y = F.expr("substring(concat('abcdefghijk', doc_id), length(cast(doc_id as string)) + 1, 11)")
    n = (F.col("doc_id") + 1000000).cast("string")
    k = F.col("doc_id") % 5
    url = (F.when(k == 0, F.concat(F.lit("https://youtu.be/"), y)).when(k == 1, F.concat(F.lit("https://m.bilibili.com/video/BV1"), n, F.lit("?p=1")))
           .when(k == 2, F.concat(F.lit("https://www.douyin.com/share/video/"), n)).when(k == 3, F.concat(F.lit("https://cdn.example/"), F.col("doc_id").cast("string"), F.lit("/a.m3u8?t=1")))
           .otherwise(F.concat(F.lit("https://other.example/"), n)))
    x = d.select("doc_id", url.alias("url")).select("doc_id", ps.platform_of("url").alias("platform"), ps.video_id_of("url").alias("video_id"), "url")
    return x.select("doc_id", "platform", "video_id", ps.canonical_url(F.col("platform"), F.col("video_id"), F.col("url")).alias("canonical"))


@query("sc6_slugs", r"""WITH s AS (SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(text, ' ')), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-'), '-{2,}', '-', 'g') AS s FROM documents)
 SELECT doc_id, CASE WHEN length(regexp_replace(s, '[^a-z0-9-]', '', 'g')) < 2 THEN 'd' || doc_id ELSE substring(s, 1, 80) END AS slug FROM s""")
def _(spark, sf):
    return si.table(spark, sf, "documents").select("doc_id", ps.slugify("text", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("slug"))


@query("sc7_normalize_keyword", r"SELECT doc_id, md5(substring(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'), ' '), 1, 80)) AS digest FROM documents")
def _(spark, sf):
    return si.table(spark, sf, "documents").select("doc_id", F.md5(ps.normalize_keyword("text")).alias("digest"))


@query("sc8_language_codes", "SELECT doc_id, lang AS code, CASE WHEN lang = 'de' THEN 'en,fr' ELSE array_to_string(list_filter(['de','en','fr'], lambda x: x <> lang), ',') END AS targets FROM documents")
def _(spark, sf):
    raw = F.expr("case when lang = 'de' then ' German ' when lang = 'fr' then 'FR_fr' else upper(lang) end")
    code = lg.language_code(raw, {"german": "de", "fr-fr": "fr"}, ["en", "fr", "de", "es"])
    pack = F.array(*[F.lit(c) for c in ["de", "en", "fr"]])
    return si.table(spark, sf, "documents").select("doc_id", code.alias("code"), F.array_join(lg.target_languages(pack, code), ",").alias("targets"))


@query("sc9_to_traditional", "SELECT doc_id, md5(translate(text, 'aei', '的一是')) AS digest FROM documents")
def _(spark, sf):
    return si.table(spark, sf, "documents").select("doc_id", F.md5(lg.to_traditional(F.col("text"), ("aei", "的一是"))).alias("digest"))


@query("sc10_clock_text", with_sql("cues", body="SELECT track_id, idx, printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS clock, end_ms AS back FROM cues"))
def _(spark, sf):
    c = si.cues(spark, sf).select("track_id", "idx", ps.to_clock("end_ms").alias("clock"))
    return c.withColumn("back", ps.from_clock("clock"))


@query("sc11_text_similarity")
def _(spark, sf):
    a = si.captions(spark, sf).select("track_id", "idx", sm.caption_key("text").alias("a"))
    b = si.shown_lines(spark, sf).select("track_id", "idx", sm.caption_key("text").alias("b"))
    return a.join(b, ["track_id", "idx"]).select("track_id", "idx", F.round(sm.caption_sim("a", "b"), 6).alias("sim"))


W = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


@query("sc12_token_overlap", with_sql("cues", "pass2", body=", x AS (SELECT c.track_id, c.idx, " + W.format(c="c.text") + " AS a, " + W.format(c="p.text") + """ AS b FROM cues c JOIN pass2 p ON p.track_id = c.track_id AND p.idx = c.idx + 1)
 SELECT track_id, idx, round(CASE WHEN len(a) * len(b) > 0 THEN len(list_intersect(a, b)) / (sqrt(len(a)) * sqrt(len(b))) ELSE 0 END, 6) AS cos FROM x"""))
def _(spark, sf):
    c = si.cues(spark, sf).withColumn("k", F.col("idx") + 1)
    p = si.second_pass(spark, sf).select("track_id", F.col("idx").alias("k"), F.col("text").alias("t2"))
    a, b = F.array_distinct(tx.words("text")), F.array_distinct(tx.words("t2"))
    return c.join(p, ["track_id", "k"]).select("track_id", "idx", F.round(sm.token_cosine(a, b), 6).alias("cos"))


@query("sc13_vector_math", "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)), 6) AS cos FROM (SELECT vec_id, cast(embedding AS double[]) AS v, list_reverse(cast(embedding AS double[])) AS w FROM embeddings)")
def _(spark, sf):
    e = si.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.reverse("embedding").alias("w"))
    return e.select("vec_id", F.round(sm.norm("v"), 6).alias("norm"), F.round(sm.cosine("v", "w"), 6).alias("cos"))


@query("sc14_ordered_replace", r"SELECT doc_id, md5(trim(regexp_replace(replace(replace(text, 'tion', 'ement'), 'ement', 'X'), '\s+', ' ', 'g'), ' ')) AS digest FROM documents")
def _(spark, sf):
    return si.table(spark, sf, "documents").select("doc_id", F.md5(fix_text("text", [("tion", "ement"), ("ement", "X")])).alias("digest"))


@query("sc15_word_bounds", with_sql("cues", body="""SELECT track_id, idx, CASE WHEN idx % 4 = 3 THEN start_ms ELSE greatest(start_ms - 50, least(start_ms - 100 + idx * 40, end_ms)) END AS start_ms,
  CASE WHEN idx % 4 = 3 THEN end_ms ELSE least(end_ms + 50, greatest(end_ms + 200 - idx * 60, start_ms)) END AS end_ms FROM cues"""))
def _(spark, sf):
    w = F.expr("case when idx % 4 = 3 then cast(array() as array<struct<start_ms:bigint,end_ms:bigint>>) else array("
               "struct(start_ms - 100 + idx * 40 as start_ms, start_ms + 50 as end_ms), struct(start_ms + 200 + idx * 40 as start_ms, end_ms + 200 - idx * 60 as end_ms)) end")
    return si.cues(spark, sf).select("track_id", "idx", ps.word_bounds(F.col("start_ms"), F.col("end_ms"), w).alias("b")).select("track_id", "idx", "b.*")


@query("sc16_key_points", """SELECT doc_id, source || '|' || lang AS titles, cast(n_chars AS double) AS start_sec FROM documents""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    raw = F.expr("to_json(array(to_json(named_struct('title', source, 'start_sec', cast(n_chars as double))), lang, ' ', to_json(named_struct('detail', 'x'))))")
    kp = ps.key_points(raw)
    return d.select("doc_id", F.array_join(F.transform(kp, lambda p: p["title"]), "|").alias("titles"), F.get(kp, F.lit(0))["start_sec"].alias("start_sec"))


@query("sc17_merge_meta", """SELECT event_id, '{"k":"' || (CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END) || '"' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',"z":"1"' END || '}' AS meta FROM events""")
def _(spark, sf):
    new = F.expr("""case when event_id % 2 = 0 then '{"k":"new"}' else '{"z":"1"}' end""")
    return si.table(spark, sf, "events").select("event_id", ps.merge_meta("props", new).alias("meta"))


@query("sc18_visual_fields", "SELECT doc_id, source AS zh_desc, lang AS zh_tags, CASE WHEN doc_id % 2 = 0 THEN 'e' || source ELSE '' END AS en_desc FROM documents")
def _(spark, sf):
    t = F.expr("concat('描述: 未提供\\n描述：', source, '\\n标签: ', lang, case when doc_id % 2 = 0 then concat('\\nEN描述: e', source) else '' end)")
    return si.table(spark, sf, "documents").select("doc_id", ps.visual_fields(t).alias("v")).select("doc_id", "v.zh_desc", "v.zh_tags", "v.en_desc")


@query("sc19_script_flags", "SELECT doc_id, regexp_matches(translate(text, 'xyz', '的一是'), '[\\x{3400}-\\x{9fff}]') AS cjk, regexp_matches(translate(text, 'k', 'か'), '[\\x{3040}-\\x{30ff}]') AS kana, contains(text, 'q') AS hangul FROM documents")
def _(spark, sf):
    return si.table(spark, sf, "documents").select(
        "doc_id", tx.has_cjk(F.translate("text", "xyz", "的一是")).alias("cjk"), tx.has_kana(F.translate("text", "k", "か")).alias("kana"), tx.has_hangul(F.translate("text", "q", "한")).alias("hangul"))


@query("sc20_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' ELSE lang END AS label FROM documents")
def _(spark, sf):
    dim = spark.createDataFrame([("en", "English"), ("fr", "Français")], "lang string, label string")
    return si.table(spark, sf, "documents").join(F.broadcast(dim), "lang", "left").select("doc_id", F.coalesce("label", "lang").alias("label"))


@query("sc21_note_leaves", """SELECT doc_id, unnest(['/points/0/title', '/points/1/title', '/title']) AS path, unnest([source, 'p', lang]) AS value FROM documents""")
def _(spark, sf):
    doc = F.expr("to_json(named_struct('title', lang, 'id', 'x', 'points', array(named_struct('title', source, 'ts', '1'), named_struct('title', 'p', 'ts', '2'))))")
    return si.table(spark, sf, "documents").select("doc_id", F.inline(ps.note_leaves(doc, ["title", "summary"])))


def _axis(lo: str, size: str, total: int, p: str, q: str) -> str:
    at = f"greatest(1, least({total} - 3, CAST(round_even({lo} * {total}, 0) AS INT)))"
    n = f"greatest(2, CAST(round_even({size} * {total}, 0) AS INT))"
    return f"{at} AS {p}, greatest(2, CASE WHEN {at} + {n} >= {total} THEN {total} - {at} - 1 ELSE {n} END) AS {q}"


@query("sc22_pixel_box", f"""WITH e AS (SELECT event_id, value / 500 AS v FROM events),
 b AS (SELECT event_id, greatest(0.0::DOUBLE, least(0.98::DOUBLE, v - 0.01::DOUBLE)) AS nx, greatest(0.0::DOUBLE, least(0.98::DOUBLE, v / 2 - 0.01::DOUBLE * 0.5::DOUBLE)) AS ny FROM e),
 s AS (SELECT *, greatest(0.02::DOUBLE, least(1.0::DOUBLE - nx, 0.2::DOUBLE + 2 * 0.01::DOUBLE)) AS nw, greatest(0.02::DOUBLE, least(1.0::DOUBLE - ny, 0.1::DOUBLE + 0.01::DOUBLE)) AS nh FROM b)
 SELECT event_id, {_axis("nx", "nw", 1920, "x", "w")}, {_axis("ny", "nh", 1080, "y", "h")} FROM s""")
def _(spark, sf):
    e = si.table(spark, sf, "events").select("event_id", (F.col("value") / 500).alias("v"))
    return e.select("event_id", ps.pixel_box(F.lit(1920), F.lit(1080), F.col("v"), F.col("v") / 2, F.lit(0.2), F.lit(0.1)).alias("b")).select("event_id", "b.*")


@query("sc23_snap_to_frames", "SELECT event_id, round(greatest(round_even(value * 30, 0), 1) / 30.0, 6) AS sec FROM events")
def _(spark, sf):
    return si.table(spark, sf, "events").select("event_id", F.round(ps.snap_to_frames(F.col("value"), 30.0, empty=1), 6).alias("sec"))
