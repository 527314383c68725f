"""Catalog queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import tags as tg
from reelgrid.operators import catalog as cat
from reelgrid.operators import tagging
from reelgrid.plans import standins as si
from reelgrid.plans.registry import query
from reelgrid.plans.standins import with_sql

CSV = "array_to_string(tags, ',')"
LANGS = ["en", "fr", "de", "es", "ja"]


def _created(df: DataFrame) -> DataFrame:
    return df.withColumn("created_s", F.unix_timestamp("created_at"))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Files known to exist: the external paths of labelled documents."""
    return si.table(spark, sf, "labels").select(F.expr("concat('/ext/', cast(doc_id as string))").alias("path"))


INV = "inv AS (SELECT DISTINCT '/ext/' || cast(doc_id AS varchar) AS path FROM labels)"


def derived(spark: SparkSession, sf: str) -> DataFrame:
    """Derived rows per asset: text channels from labels, picture channels from vectors."""
    lab = si.table(spark, sf, "labels")
    vec = si.table(spark, sf, "embeddings")
    rows = lab.select(
        si.tx.padded_id("doc_id").alias("id"),
        F.explode(F.expr("case when quality = 1 then array('ocr','visual') else array('thumb','ocr') end")).alias("channel"),
    )
    more = vec.select(
        si.tx.padded_id("vec_id").alias("id"),
        F.explode(F.expr("case when label % 2 = 0 then array('shots','phash') else array('thumb','phash') end")).alias("channel"),
    )
    return rows.unionByName(more)


DER = """der AS (SELECT lpad(cast(doc_id AS varchar), 9, '0') AS id,
  unnest(CASE WHEN quality = 1 THEN ['ocr','visual'] ELSE ['thumb','ocr'] END) AS channel FROM labels
  UNION ALL SELECT lpad(cast(vec_id AS varchar), 9, '0'),
  unnest(CASE WHEN label % 2 = 0 THEN ['shots','phash'] ELSE ['thumb','phash'] END) FROM embeddings)"""


def tech(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return d.select(
        si.tx.padded_id("doc_id").alias("id"),
        F.expr("n_chars / 8.0D").alias("duration"),
        F.expr("element_at(array(1920, 1280, 640), cast(doc_id % 3 as int) + 1)").alias("width"),
        F.expr("element_at(array(1080, 720, 480), cast(doc_id % 3 as int) + 1)").alias("height"),
        F.expr("element_at(array('h264', 'hevc', 'vp9', ''), cast(doc_id % 4 as int) + 1)").alias("codec"),
        F.expr("case when doc_id % 3 <> 0 then 16000 end").alias("sample_rate"),
    )


TECH = """tech AS (SELECT lpad(cast(doc_id AS varchar), 9, '0') AS id, cast(n_chars / 8.0 AS double) AS duration,
  [1920, 1280, 640][doc_id % 3 + 1] AS width, [1080, 720, 480][doc_id % 3 + 1] AS height,
  ['h264', 'hevc', 'vp9', ''][doc_id % 4 + 1] AS codec, CASE WHEN doc_id % 3 <> 0 THEN 16000 END AS sample_rate FROM documents)"""


def job_cues(spark: SparkSession, sf: str) -> DataFrame:
    return si.cues(spark, sf).withColumn("track_id", si.tx.padded_id("track_id"))


@query("io1_catalog_scan", with_sql("m", body="SELECT id, kind, created_s, size FROM m"))
def _(spark, sf):
    return _created(si.materials(spark, sf)).select("id", "kind", "created_s", "size")


PF1_SQL = with_sql("m", body="""SELECT id, CASE ext WHEN '.mp4' THEN 'videos' WHEN '.wav' THEN 'audio' WHEN '.srt' THEN 'docs' ELSE 'images' END AS class_kind,
  CASE WHEN ext = '.srt' THEN 'type:subs' END AS doc_type FROM m""")


@query("pf1_classify", PF1_SQL)
def _(spark, sf):
    return cat.classify(si.materials(spark, sf).drop("kind")).select("id", "class_kind", "doc_type")


@query("pf2_path_facets", """WITH p AS (SELECT doc_id, 'downloads/batch/' || CASE WHEN doc_id % 5 = 0 THEN 'yt' ELSE 'bili_' || source END
   || ['/media/clips/','/media/','/subs/','/notes/','/media/segments/'][doc_id % 5 + 1]
   || CASE WHEN doc_id % 3 = 0 THEN 'x_' || lang || '.srt' ELSE 'translate_qa_' || lang || '.json' END AS rel_path, source, lang FROM documents)
 SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'clip' WHEN 2 THEN 'subs' WHEN 3 THEN 'notes' ELSE CASE WHEN doc_id % 3 = 0 THEN 'media' ELSE '' END END AS asset_type,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'bili' END AS platform, CASE WHEN doc_id % 5 = 0 THEN 'yt' ELSE source END AS video_id,
  lang AS path_lang, doc_id % 5 IN (0, 1, 4) AND doc_id % 3 <> 0 AS is_sidecar, doc_id % 5 = 4 AS is_intermediate FROM p""")
def _(spark, sf):
    d = si.table(spark, sf, "documents").select(
        "doc_id",
        F.expr("concat('downloads/batch/', case when doc_id % 5 = 0 then 'yt' else concat('bili_', source) end, "
               "element_at(array('/media/clips/','/media/','/subs/','/notes/','/media/segments/'), cast(doc_id % 5 as int) + 1), "
               "case when doc_id % 3 = 0 then concat('x_', lang, '.srt') else concat('translate_qa_', lang, '.json') end)").alias("rel_path"),
    )
    return cat.path_facets(d, LANGS).drop("rel_path")


@query("pf3_kind_and_tag", with_sql("m", body=f"SELECT id, size FROM m WHERE kind = 'docs' AND contains({CSV}, 'type:')"))
def _(spark, sf):
    return cat.filter_catalog(si.materials(spark, sf), "docs", "type:").select("id", "size")


@query("pf4_with_tag", with_sql("m", body="SELECT id FROM m WHERE list_contains(tags, 'job:1')"))
def _(spark, sf):
    return cat.with_tag(si.materials(spark, sf), "job:1").select("id")


@query("pf5_facet_filter", with_sql("m", body="""SELECT id FROM m WHERE form IN ('live_vo')
  AND (list_has_any(topics, ['影视','搞笑','音乐','舞蹈']) OR list_has_any(usage, ['影视']))"""))
def _(spark, sf):
    return cat.facet_filter(si.materials(spark, sf), form="live", topic="影视娱乐").select("id")


@query("pf6_taxonomy_closure", with_sql("m", recursive=True, body="""SELECT CASE form WHEN 'live_vo' THEN 'live' WHEN 'flat2d' THEN 'anim2d'
   WHEN 'hand2d' THEN 'anim2d' WHEN 'cgi3d' THEN 'anim3d' WHEN 'anime_jp' THEN 'anime' WHEN 'ai_img' THEN 'ai' END AS ancestor, count(*) AS n
  FROM m WHERE form NOT IN ('', 'unlisted') GROUP BY 1
  UNION ALL SELECT form, count(*) FROM m WHERE form NOT IN ('', 'unlisted') GROUP BY 1
  UNION ALL SELECT 'live_talk', count(*) FROM m WHERE form = 'live_vo'"""))
def _(spark, sf):
    closure = cat.taxonomy_closure(cat.form_edges(spark))
    m = si.materials(spark, sf)
    return m.join(F.broadcast(closure), m.form == closure.node).groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query("pf7_query_intent", """SELECT page_id, 'id' AS intent FROM pages UNION ALL
 SELECT 1000000000 + doc_id, CASE WHEN starts_with(t, 'type:') OR starts_with(t, 'job:') OR starts_with(t, 'tag:') OR starts_with(t, 'id:')
   OR contains(t, '/') OR contains(t, '\\') OR regexp_full_match(t, '[0-9a-f]{8,}') THEN 'id' ELSE 'text' END
 FROM (SELECT doc_id, lower(trim(text)) AS t FROM documents)""")
def _(spark, sf):
    p = si.table(spark, sf, "pages").select("page_id", F.col("url").alias("q"))
    d = si.table(spark, sf, "documents").select((F.col("doc_id") + 1000000000).alias("page_id"), F.col("text").alias("q"))
    return p.unionByName(d).select("page_id", cat.query_intent("q").alias("intent"))


SYN = [
    (0, "with", ["using", "and"], "weak"), (1, "tion", ["action", "motion"], "strong"),
    (2, "the", ["article"], "abbrev"), (3, "ing", ["gerund", "action"], "strong"),
]


@query("pf8_expand_query", """WITH d AS (SELECT doc_id, text, lower(text) AS l FROM documents), e AS (SELECT doc_id, text,
  CASE WHEN regexp_matches(l, '(^|[^a-z0-9])the([^a-z0-9]|$)') THEN ['article'] ELSE [] END AS ab,
  list_concat(CASE WHEN contains(text, 'tion') THEN ['action','motion'] ELSE [] END, CASE WHEN contains(text, 'ing') THEN ['gerund','action'] ELSE [] END) AS strong,
  CASE WHEN contains(text, 'with') THEN ['using','and'] ELSE [] END AS weak FROM d),
 x AS (SELECT doc_id, text, list_concat(ab, CASE WHEN len(strong) > 0 THEN strong ELSE weak END) AS w FROM e)
 SELECT doc_id, md5(CASE WHEN len(w) > 0 THEN text || ' ' || array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i), ' ') ELSE text END) AS expanded FROM x""")
def _(spark, sf):
    syn = spark.createDataFrame(SYN, "ord int, key string, words array<string>, cls string")
    d = si.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    return cat.expand_query(d, syn).select("doc_id", F.md5("expanded").alias("expanded"))


@query("tg1_tag_union", with_sql("m", body="""SELECT id, array_to_string(list_concat(tags, list_filter(ai_tags, lambda x: NOT list_contains(tags, x))), ',') AS tags FROM m"""))
def _(spark, sf):
    return si.materials(spark, sf).select("id", tg.tags_to_csv(tg.tag_union("tags", "ai_tags")).alias("tags"))


_CLIP = "list_filter(tags, lambda x: x NOT IN ('role:master','role:picture'))"
_MAST = "CASE WHEN list_contains(tags,'has_audio:0') THEN [] ELSE ['role:picture'] END"


@query("tg2_coerce_roles", with_sql("m", body=f"""SELECT id, array_to_string(CASE WHEN list_contains(tags,'role:clip') OR list_contains(tags,'type:clip')
   THEN list_concat({_CLIP}, ['type:clip'])
   WHEN kind = 'videos' THEN list_concat(tags, {_MAST}) ELSE tags END, ',') AS tags FROM m"""))
def _(spark, sf):
    return si.materials(spark, sf).select("id", tg.tags_to_csv(tg.coerce_roles("tags", "kind")).alias("tags"))


@query("tg3_reconcile_audio", with_sql("m", body="""SELECT id, array_to_string(CASE WHEN size % 2 = 0
   THEN list_concat(list_filter(tags, lambda x: x NOT IN ('has_audio:0','role:silent-picture')), CASE WHEN list_contains(tags,'has_audio:1') THEN [] ELSE ['has_audio:1'] END)
   ELSE list_concat(list_filter(tags, lambda x: x <> 'has_audio:1'), CASE WHEN list_contains(tags,'has_audio:0') THEN [] ELSE ['has_audio:0'] END) END, ',') AS tags FROM m"""))
def _(spark, sf):
    return si.materials(spark, sf).select("id", tg.tags_to_csv(tg.reconcile_audio("tags", F.col("size") % 2 == 0)).alias("tags"))


TG4_SQL = """f AS (SELECT m.*, sample_rate IS NOT NULL AS loud,
  CASE kind WHEN 'videos' THEN list_concat(CASE WHEN list_contains(tags,'role:clip') THEN ['role:clip','type:clip'] ELSE ['role:master','role:picture'] END,
      [CASE WHEN sample_rate IS NOT NULL THEN 'has_audio:1' ELSE 'has_audio:0' END])
    WHEN 'images' THEN CASE WHEN ext = '.gif' THEN ['type:gif'] ELSE [] END
    WHEN 'docs' THEN ['type:subs'] ELSE ['role:audio-stem','has_audio:1'] END AS facets FROM m JOIN tech USING (id))"""


@query("tg4_media_facets", "WITH " + si.SQL["m"] + ", " + TECH + ", " + TG4_SQL + " SELECT id, array_to_string(facets, ',') AS facets FROM f")
def _(spark, sf):
    return tagging.media_facets(si.materials(spark, sf), tech(spark, sf)).select("id", tg.tags_to_csv("facets").alias("facets"))


@query("tg5_merge_tags", with_sql("m", body="""SELECT id, array_to_string(list_concat(list_filter(tags, lambda x: x NOT IN ('the','de')),
    list_filter(['new','type:text'], lambda x: NOT list_contains(tags, x))), ',') AS new_tags,
   'job:1' AS protected_skipped, array_to_string(list_sort(list_filter(['the','de'], lambda x: list_contains(tags, x))), ',') AS removed_applied FROM m"""))
def _(spark, sf):
    x = tagging.merge_tags(si.materials(spark, sf), ["new", "type:text"], ["the", "job:1", "de"])
    return x.select("id", *[tg.tags_to_csv(c).alias(c) for c in ["new_tags", "protected_skipped", "removed_applied"]])


@query("tg6_replace_tags", with_sql("m", body="""SELECT id, array_to_string(list_filter(ai_tags, lambda x: list_contains(tags, x)), ',') AS ai_tags,
   array_to_string(list_filter(ai_tags, lambda x: NOT list_contains(tags, x)), ',') AS ai_tags_removed FROM m"""))
def _(spark, sf):
    x = tagging.replace_tags(si.materials(spark, sf), F.col("tags"))
    return x.select("id", *[tg.tags_to_csv(c).alias(c) for c in ["ai_tags", "ai_tags_removed"]])


@query("tg7_drop_from_aliases", with_sql("m", body="""SELECT id, array_to_string(list_concat(tags, ['parent:' || id], CASE WHEN size % 2 = 0 THEN [] ELSE ['from:x'] END), ',') AS tags FROM m"""))
def _(spark, sf):
    m = si.materials(spark, sf)
    alias = F.when(F.col("size") % 2 == 0, F.concat(F.lit("from:"), "id")).otherwise("from:x")
    t = F.concat("tags", F.array(F.concat(F.lit("parent:"), "id"), alias))
    return m.select("id", tg.tags_to_csv(tg.drop_from_aliases(t)).alias("tags"))


_STOP_SQL = "(" + ",".join(repr(x) for x in __import__("reelgrid.functions.fixed_values", fromlist=["x"]).MODEL_TAG_STOP) + ")"


@query("tg8_normalize_model_tags", f"""WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '),
   lambda x: regexp_replace(translate(lower(trim(x)), '_ ', '--'), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}-]', '', 'g')) AS a FROM documents),
 d AS (SELECT doc_id, list_filter(a, lambda v, i: list_position(a, v) = i AND v <> '' AND v NOT IN {_STOP_SQL} AND v <> 'sp'
   AND NOT starts_with(v, 'type') AND NOT starts_with(v, 'job') AND length(v) <= 20) AS a FROM w)
 SELECT doc_id, array_to_string(list_slice(a, 1, 6), ',') AS tags FROM d""")
def _(spark, sf):
    d = si.table(spark, sf, "documents")
    return d.select("doc_id", tg.tags_to_csv(tg.normalize_model_tags(F.split("text", " "))).alias("tags"))


RULES = [(("tion", "ment"), "abstract"), (("ing",), "gerund"), (("job:1",), "first"), (("videos",), "moving")]


@query("tg9_rule_tag", with_sql("m", body=f"""SELECT id, array_to_string(list_concat(tags, list_filter([
   CASE WHEN contains(t,'tion') OR contains(t,'ment') THEN 'abstract' END, CASE WHEN contains(t,'ing') THEN 'gerund' END,
   CASE WHEN contains(t,'job:1') THEN 'first' END, CASE WHEN contains(t,'videos') THEN 'moving' END], lambda x: x IS NOT NULL AND NOT list_contains(tags, x))), ',') AS tags,
   md5(description) AS description FROM (SELECT *, lower(name || ' ' || {CSV} || ' ' || description || ' ' || kind) AS t FROM m)"""))
def _(spark, sf):
    x = tagging.rule_tag(si.materials(spark, sf), RULES, {"abstract": "a"}, "none")
    return x.select("id", tg.tags_to_csv("tags").alias("tags"), F.md5("description").alias("description"))


@query("tg10_tag_labels", with_sql("m", body="""SELECT tag, n, CASE WHEN tag LIKE 'job:%' THEN '任务·' || tag[5:] WHEN tag LIKE 'lang:%' THEN '语言·' || tag[6:]
   WHEN tag LIKE 'album:%' THEN '合集·' || tag[7:] WHEN tag = 'role:master' THEN '角色·母版' WHEN tag = 'role:clip' THEN '角色·物理切片'
   WHEN tag = 'role:audio-stem' THEN '角色·音轨组件' WHEN tag = 'type:subs' THEN '类型·字幕' WHEN tag LIKE 'type:%' THEN '类型·' || tag[6:]
   WHEN tag = 'has_audio:1' THEN '有声' WHEN tag = 'has_audio:0' THEN '无声' ELSE tag END AS label, tag LIKE 'has_audio:_' AS hide
  FROM (SELECT unnest(tags) AS tag, count(*) AS n FROM m GROUP BY 1)"""))
def _(spark, sf):
    return cat.tag_counts(si.materials(spark, sf)).select("tag", "n", tg.tag_label("tag").alias("u")).select("tag", "n", "u.label", "u.hide")


@query("tg11_retag_album", with_sql("m", body="""SELECT id, array_to_string(list_transform(tags, lambda x: CASE WHEN x = 'album:src1' THEN 'album:kept' ELSE x END), ',') AS renamed,
   array_to_string(list_filter(tags, lambda x: x <> 'album:src2'), ',') AS dissolved FROM m"""))
def _(spark, sf):
    return si.materials(spark, sf).select(
        "id", tg.tags_to_csv(tg.rename_tag("tags", "album:src1", "album:kept")).alias("renamed"),
        tg.tags_to_csv(tg.drop_tag("tags", "album:src2")).alias("dissolved"),
    )


@query("tg12_zero_shot_tags", with_sql("vec", "lv", body=""", s AS (SELECT mid, 'l' || cast(qid AS varchar) AS term,
   list_dot_product(v, qv) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(qv, qv)) AS c FROM vec, lv),
 p AS (SELECT mid, term, c, exp(100 * (c - max(c) OVER w)) AS e FROM s WINDOW w AS (PARTITION BY mid)),
 r AS (SELECT mid, term, e / sum(e) OVER (PARTITION BY mid) AS p, row_number() OVER (PARTITION BY mid ORDER BY c DESC, term) AS rn FROM p)
 SELECT mid, term, round(p, 6) AS score, coalesce(contains(lower(d.text), term), false) AS verified
 FROM r LEFT JOIN documents d ON d.doc_id = r.mid WHERE rn <= 12 AND p >= 0.02"""))
def _(spark, sf):
    vocab = si.label_vectors(spark, sf).select(F.concat(F.lit("l"), F.col("qid").cast("string")).alias("term"), F.col("qvec").alias("vec"))
    desc = si.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    x = tagging.zero_shot_tags(si.vectors(spark, sf), vocab, desc)
    return x.withColumn("score", F.round("score", 6))


@query("tg13_open_entities", """WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 3 AND x NOT IN STOPS) AS w FROM documents),
 p AS (SELECT doc_id, 0 AS is_word, i AS pos, w[i] || ' ' || w[i + 1] AS entity, [w[i], w[i + 1]] AS ws FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
   UNION ALL SELECT doc_id, 1, i, w[i], [w[i]] FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 c AS (SELECT doc_id, is_word, entity, count(*) AS n, min(pos) AS f FROM p WHERE NOT list_has_any(ws, ['tion','ment']) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY is_word, n DESC, f) AS rank FROM c)
 SELECT doc_id, entity, n, rank FROM r WHERE rank <= 8""".replace("STOPS", "(" + ",".join(repr(x) for x in __import__("reelgrid.functions.fixed_values", fromlist=["x"]).ENTITY_STOP) + ")"))
def _(spark, sf):
    d = si.table(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    return tagging.open_entities(d, ["tion", "ment"]).select(F.col("id").alias("doc_id"), "entity", "n", "rank")


STAGES = [("tion", "动"), ("ment", "物"), ("en", "恩")]
STAGE_SQL = "CASE WHEN contains(st,'tion') THEN '动' WHEN contains(st,'ment') THEN '物' WHEN contains(st,'en') THEN '恩' WHEN list_contains(tags,'type:subs') THEN '字幕' ELSE '' END"


@query("tg14_describe", "WITH " + si.SQL["m"] + ", " + TECH + f""", x AS (SELECT *, {STAGE_SQL} AS label FROM
   (SELECT m.*, tech.*, lower(regexp_replace(name, '\\.[^.]*$', '')) AS st FROM m JOIN tech USING (id)))
 SELECT id, concat_ws(' · ', nullif(label, ''), CASE WHEN kind <> 'docs' THEN concat_ws(' ', width || 'x' || height, nullif(codec, ''),
   CASE WHEN duration > 0 THEN cast(duration AS varchar) || 's' END, sample_rate || 'Hz') END, 'job:' || (doc_id % 50)) AS description FROM x""")
def _(spark, sf):
    m = si.materials(spark, sf).withColumn("description", F.lit(""))
    return tagging.describe(m, tech(spark, sf), STAGES).select("id", "description")


@query("tg15_canonical_names", with_sql("m", body=f""", x AS (SELECT *, {STAGE_SQL} AS label FROM (SELECT *, lower(regexp_replace(name, '\\.[^.]*$', '')) AS st FROM m)),
 y AS (SELECT *, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^_+|_+$', '', 'g') AS s0 FROM x),
 z AS (SELECT *, CASE WHEN s0 = '' THEN 'asset' ELSE s0 END AS safe FROM y),
 n AS (SELECT *, concat_ws('_', nullif(label, ''), CASE lang WHEN 'en' THEN '英文' WHEN 'fr' THEN '法文' WHEN 'de' THEN '德文' WHEN 'es' THEN '西班牙文' ELSE lang END,
   cast(doc_id % 50 AS varchar)) || '_' || safe || ext AS nm FROM z),
 f AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY created_s DESC, id) AS rn FROM n)
 SELECT id, CASE WHEN rn = 1 THEN nm ELSE regexp_replace(nm, '\\.[^.]*$', '') || '_' || substring(id, 1, 4) || ext END AS new_name FROM f"""))
def _(spark, sf):
    return tagging.canonical_names(si.materials(spark, sf), STAGES).select("id", "new_name")


@query("tg16_set_classify", with_sql("m", body="""SELECT m.id, CASE WHEN kind NOT IN ('videos','images') THEN '' WHEN l.quality = 1 THEN 'cgi3d' WHEN l.quality = 0 THEN '' ELSE form END AS form,
   CASE WHEN kind NOT IN ('videos','images') THEN '' ELSE array_to_string(topics, ',') END AS topics FROM m LEFT JOIN labels l USING (doc_id)"""))
def _(spark, sf):
    ch = si.table(spark, sf, "labels").select(
        si.tx.padded_id("doc_id").alias("id"), F.expr("case when quality = 1 then 'cgi3d' else '' end").alias("form"),
        F.lit(None).cast("array<string>").alias("topics"), F.lit(None).cast("array<string>").alias("usage"),
    )
    x = tagging.clear_nonvisual(tagging.set_classify(si.materials(spark, sf), ch))
    return x.select("id", "form", tg.tags_to_csv("topics").alias("topics"))


@query("tg17_migrations", with_sql("m", body="""SELECT id, CASE kind WHEN 'audio' THEN 'sound' WHEN 'images' THEN 'pictures' ELSE kind END AS kind,
   array_to_string(list_filter(list_concat(tags, CASE kind WHEN 'audio' THEN ['was:audio'] WHEN 'images' THEN ['was:images','type:raw'] ELSE [] END),
     lambda x, i: NOT (x IN ('the','de')) AND (i <= len(tags) OR NOT list_contains(tags, x))), ',') AS tags FROM m"""))
def _(spark, sf):
    dim = spark.createDataFrame(
        [("audio", "sound", ["was:audio"]), ("images", "pictures", ["was:images", "type:raw"])],
        "old_kind string, new_kind string, extra array<string>",
    )
    x = tagging.strip_tags(tagging.migrate_kinds(si.materials(spark, sf), dim), ["the", "de"])
    return x.select("id", "kind", tg.tags_to_csv("tags").alias("tags"))


@query("tg17_restore_tags", with_sql("m", body="""SELECT m.id, l.doc_id IS NOT NULL AS changed, CASE WHEN l.doc_id IS NULL THEN array_to_string(tags, ',') ELSE 'saved' END AS tags
  FROM m LEFT JOIN labels l USING (doc_id)"""))
def _(spark, sf):
    snap = si.table(spark, sf, "labels").select(
        si.tx.padded_id("doc_id").alias("id"), F.expr("array('saved')").alias("tags"), F.expr("cast(array() as array<string>)").alias("ai_tags")
    )
    return tagging.restore_tags(si.materials(spark, sf), snap).select("id", "changed", tg.tags_to_csv("tags").alias("tags"))


@query("tg17_refresh_facets", "WITH " + si.SQL["m"] + ", " + TECH + ", " + TG4_SQL + """,
 a AS (SELECT *, list_concat(tags, list_filter(facets, lambda x: NOT list_contains(tags, x))) AS t FROM f),
 b AS (SELECT *, CASE WHEN list_contains(facets, 'has_audio:1') THEN list_filter(t, lambda x: x <> 'has_audio:0')
   WHEN list_contains(facets, 'has_audio:0') THEN list_filter(t, lambda x: x <> 'has_audio:1') ELSE t END AS u FROM a)
 SELECT id, array_to_string(CASE WHEN list_contains(u, 'role:clip') THEN list_concat(list_filter(u, lambda x: x NOT IN ('role:master','role:picture')),
   CASE WHEN list_contains(u, 'type:clip') THEN [] ELSE ['type:clip'] END) ELSE u END, ',') AS tags FROM b""")
def _(spark, sf):
    return tagging.refresh_facets(si.materials(spark, sf), tech(spark, sf)).select("id", tg.tags_to_csv("tags").alias("tags"))


MASTERS = """v AS (SELECT *, 'job:' || (doc_id % 50) AS job, list_contains(tags,'role:master') AS mas FROM m WHERE kind = 'videos' AND NOT list_contains(tags,'role:clip')),
 masters AS (SELECT job, arg_max(id, cast(-created_s AS varchar) || id) AS x,
   (SELECT id FROM v v2 WHERE v2.job = v.job AND mas ORDER BY created_s, id DESC LIMIT 1) AS a,
   (SELECT id FROM v v2 WHERE v2.job = v.job ORDER BY created_s DESC, id LIMIT 1) AS b FROM v GROUP BY job),
 jm AS (SELECT job, coalesce(a, b) AS master_id FROM masters)"""


@query("jn1_link_clip_parents", with_sql("m", body=", " + MASTERS + """
 SELECT m.id, jm.master_id AS parent_id, jm.master_id IS NOT NULL AS linked,
   array_to_string(CASE WHEN jm.master_id IS NULL THEN tags ELSE list_append(tags, 'parent:' || jm.master_id) END, ',') AS tags
 FROM m LEFT JOIN jm ON jm.job = 'job:' || (doc_id % 50) WHERE list_contains(tags, 'role:clip')""").replace("JOIN jm ON jm.job", "JOIN jm ON jm.job"))
def _(spark, sf):
    x = cat.link_clip_parents(si.materials(spark, sf))
    return x.select("id", "parent_id", "linked", tg.tags_to_csv("tags").alias("tags"))


@query("jn2_link_component_parents", with_sql("m", body=", " + MASTERS + """,
 s AS (SELECT lower(regexp_replace(name, '\\.[^.]*$', '')) AS stem, arg_min(id, struct_pack(a := created_s, b := -doc_id)) AS by_stem FROM v GROUP BY 1),
 c AS (SELECT *, regexp_replace(lower(regexp_replace(name, '\\.[^.]*$', '')), '(_silent|_track|_audio|_stem)$', '') AS stem FROM m WHERE kind = 'audio'),
 p AS (SELECT c.*, coalesce(s.by_stem, jm.master_id) AS parent_id FROM c LEFT JOIN s USING (stem) LEFT JOIN jm ON jm.job = 'job:' || (doc_id % 50))
 SELECT p.id, parent_id, array_to_string(CASE WHEN parent_id IS NULL THEN p.tags ELSE list_concat(p.tags, ['parent:' || parent_id],
    list_filter(q.tags, lambda x: starts_with(x, 'job:') AND NOT list_contains(p.tags, x))) END, ',') AS tags, parent_id IS NOT NULL AS linked
 FROM p LEFT JOIN m q ON q.id = p.parent_id"""))
def _(spark, sf):
    x = cat.link_component_parents(si.materials(spark, sf))
    return x.select("id", "parent_id", tg.tags_to_csv("tags").alias("tags"), "linked")


JN3_SQL = """subs AS (SELECT id, doc_id, doc_id % 50 AS job, lang, created_s FROM m WHERE kind = 'docs' AND list_contains(tags,'type:subs')),
 best AS (SELECT job, arg_min(struct_pack(id := id, lang := lang), struct_pack(a := -created_s, b := id)) AS b, list_sort(list_distinct(list(lang))) AS langs FROM subs GROUP BY job),
 bounds AS (SELECT lpad(cast(track_id AS varchar), 9, '0') AS sub_id, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM cues GROUP BY 1),
 tr AS (SELECT m.id, best.b.id AS sub_id, best.b.lang AS attached_lang, list_filter(langs, lambda x: x <> best.b.lang) AS other_langs, first_ms, last_ms
   FROM m LEFT JOIN best ON best.job = m.doc_id % 50 LEFT JOIN bounds ON bounds.sub_id = best.b.id WHERE kind IN ('videos','audio'))"""


@query("jn3_attach_transcripts", with_sql("m", "cues", body=", " + JN3_SQL + """
 SELECT id, sub_id, attached_lang, array_to_string(other_langs, ',') AS other_langs, first_ms, last_ms FROM tr"""))
def _(spark, sf):
    x = cat.attach_transcripts(si.materials(spark, sf), job_cues(spark, sf))
    return x.withColumn("other_langs", F.array_join("other_langs", ","))


@query("jn4_related", with_sql("m", body=f""", me AS (SELECT * FROM m WHERE id = '000000000')
 SELECT m.id, CASE WHEN contains({CSV.replace('tags', 'm.tags')}, 'parent:000000000') THEN 'children' WHEN contains({CSV.replace('tags', 'm.tags')}, 'job:0') THEN 'job'
   WHEN contains({CSV.replace('tags', 'm.tags')}, 'role:master') THEN 'role' ELSE 'kind' END AS relation FROM m, me
 WHERE m.id <> me.id AND (contains({CSV.replace('tags', 'm.tags')}, 'job:0') OR contains({CSV.replace('tags', 'm.tags')}, 'role:master') OR m.kind = me.kind)"""))
def _(spark, sf):
    return cat.related(si.materials(spark, sf), "000000000").select("id", "relation")


@query("jn21_orphans", "WITH " + DER + " SELECT id, channel FROM der WHERE id NOT IN (SELECT lpad(cast(item_id AS varchar), 9, '0') FROM benchmark)")
def _(spark, sf):
    m = si.table(spark, sf, "benchmark").select(si.tx.padded_id("item_id").alias("id"))
    return cat.orphans(derived(spark, sf), m).select("id", "channel")


@query("jn22_broken_refs", "WITH " + si.SQL["m"] + ", " + INV + " SELECT id, external_path FROM m WHERE location = 'external' AND external_path NOT IN (SELECT path FROM inv)")
def _(spark, sf):
    return cat.broken_refs(si.materials(spark, sf), inventory(spark, sf)).select("id", "external_path")


@query("jn22_reference_stats", "WITH " + si.SQL["m"] + ", " + INV + """ SELECT count(*) FILTER (location <> 'external') AS internal, count(*) FILTER (location = 'external') AS external,
  count(*) FILTER (location = 'external' AND external_path NOT IN (SELECT path FROM inv)) AS broken FROM m""")
def _(spark, sf):
    return cat.reference_stats(si.materials(spark, sf), inventory(spark, sf))


@query("jn24_flag_favorites", with_sql("m", body="SELECT m.id, l.doc_id IS NOT NULL AS favorite FROM m LEFT JOIN labels l USING (doc_id)"))
def _(spark, sf):
    fav = si.table(spark, sf, "labels").select(si.tx.padded_id("doc_id").alias("mid"))
    return cat.flag_favorites(si.materials(spark, sf), fav).select("id", "favorite")


def visual_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = si.table(spark, sf, "documents")
    return d.select(
        si.tx.padded_id("doc_id").alias("id"), F.lit("描述").alias("zh_desc"), F.lit("标签").alias("zh_tags"),
        F.expr("case when lang = 'en' then source else '' end").alias("en_desc"), F.lit("t").alias("en_tags"),
    )


STEP_SQL = """have AS (SELECT id, list(DISTINCT channel) AS h FROM der GROUP BY id),
 pend AS (SELECT m.id, m.kind, kind IN ('videos','images') AS vis, kind = 'videos' AND NOT list_contains(tags,'role:clip') AS sh, coalesce(h, []) AS h FROM m LEFT JOIN have USING (id)),
 steps AS (SELECT id, kind, vis AND NOT list_contains(h,'thumb') AS thumb, vis AND NOT list_contains(h,'ocr') AS ocr, vis AND NOT list_contains(h,'visual') AS visual,
   sh AND NOT list_contains(h,'shots') AS shots, vis AND NOT list_contains(h,'phash') AS phash FROM pend)"""


@query("jn29_asset_records", "WITH " + si.SQL["m"] + ", " + si.SQL["cues"] + ", " + DER + ", " + INV + ", " + STEP_SQL + ", " + JN3_SQL + """
 SELECT m.id, CASE WHEN m.kind IN ('videos','images') THEN CASE WHEN thumb THEN 'missing' ELSE 'ok' END END AS thumb,
  CASE WHEN m.kind IN ('videos','images') THEN CASE WHEN shots THEN 'missing' ELSE 'ok' END END AS shots, attached_lang AS speech, lang = 'en' AS visual_bilingual,
  CASE WHEN location = 'external' AND external_path NOT IN (SELECT path FROM inv) THEN 'unusable' ELSE 'ok' END AS quality
 FROM m JOIN steps USING (id) LEFT JOIN tr USING (id)""")
def _(spark, sf):
    m = si.materials(spark, sf)
    tr = cat.attach_transcripts(m, job_cues(spark, sf))
    x = cat.asset_records(m, derived(spark, sf), tr, inventory(spark, sf), visual_rows(spark, sf))
    return x.select("id", F.col("steps")["thumb"].alias("thumb"), F.col("steps")["shots"].alias("shots"),
                    F.col("speech.lang").alias("speech"), "visual_bilingual", "quality")


@query("ag1_tag_counts", with_sql("m", body="SELECT unnest(tags) AS tag, count(*) AS n FROM m GROUP BY 1"))
def _(spark, sf):
    return cat.tag_counts(si.materials(spark, sf))


@query("ag2_tag_cloud", with_sql("m", body=""", c AS (SELECT unnest(tags) AS tag, count(*) AS n FROM m GROUP BY 1),
  t AS (SELECT * FROM c WHERE NOT (tag IN ('has_audio:0','has_audio:1','role:picture')) ORDER BY n DESC, tag LIMIT 48)
 SELECT tag, max(n) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM c WHERE tag LIKE 'album:%' UNION ALL SELECT 'album:empty', 0) GROUP BY tag"""))
def _(spark, sf):
    return cat.tag_cloud(si.materials(spark, sf), ["album:empty"]).select("tag", "n")


@query("ag3_facet_counts", with_sql("m", body="""SELECT facet, value, count(*) AS n, cast(sum(b) AS bigint) AS bytes FROM (
  SELECT 'kind' AS facet, kind AS value, size AS b FROM m UNION ALL SELECT 'form', CASE WHEN form IN ('','unlisted') THEN 'other' ELSE form END, NULL FROM m
  UNION ALL SELECT 'topic', unnest(topics), NULL FROM m UNION ALL SELECT 'usage', unnest(usage), NULL FROM m) GROUP BY 1, 2"""))
def _(spark, sf):
    return cat.facet_counts(si.materials(spark, sf))


@query("ag4_subfacets", with_sql("m", body=""", d(kind, tag) AS (VALUES ('videos','has_audio:0'),('images','type:gif'),('images','type:raw'),
  ('docs','type:subs'),('docs','type:pdf'),('docs','type:doc'),('docs','type:text'),('docs','type:sheet'),('docs','type:slide'),('docs','type:data'),('docs','type:translate'))
 SELECT d.kind, d.tag, count(m.id) AS n FROM d LEFT JOIN m ON m.kind = d.kind AND list_contains(m.tags, d.tag) GROUP BY ALL"""))
def _(spark, sf):
    return cat.subfacets(si.materials(spark, sf))


@query("ag5_exact_duplicates", with_sql("m", body="SELECT sha256, count(*) AS copies, min(id) AS first_id FROM m GROUP BY 1 HAVING count(*) > 1"))
def _(spark, sf):
    return cat.exact_duplicates(si.materials(spark, sf))


@query("ag5_duplicate_members", with_sql("m", body="""SELECT id, sha256, copies, first_id FROM (SELECT id, sha256, count(*) OVER w AS copies, min(id) OVER w AS first_id
  FROM m WINDOW w AS (PARTITION BY sha256)) WHERE copies > 1"""))
def _(spark, sf):
    return cat.duplicate_members(si.materials(spark, sf))


@query("ag6_tech_stats", "WITH " + si.SQL["m"] + ", " + TECH + """, x AS (SELECT tech.* FROM tech JOIN m USING (id) WHERE kind <> 'docs'),
 c AS (SELECT 'resolution' AS what, width || 'x' || height AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'codec', codec, count(*) FROM x WHERE codec <> '' GROUP BY 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, value) AS rn FROM c)
 SELECT what, value, cast(n AS double) AS n FROM r WHERE rn <= 10 UNION ALL SELECT 'total', 'with_tech', count(*) FROM x
 UNION ALL SELECT 'total', 'duration', round_even(sum(duration), 1) FROM x""")
def _(spark, sf):
    return cat.tech_stats(si.materials(spark, sf), tech(spark, sf))


@query("ag7_count_hits", with_sql("m", body=f"SELECT count(*) AS n FROM m WHERE kind = 'videos' AND contains({CSV}, 'job:') AND list_contains(usage, '短视频')"))
def _(spark, sf):
    return cat.count_hits(si.materials(spark, sf), kind="videos", tag="job:", usage="短视频")


@query("ag8_vector_coverage", with_sql("m", body="""SELECT count(vec_id) AS embedded, count(*) AS total, round_even(count(vec_id) / count(*), 3) AS coverage
  FROM m LEFT JOIN embeddings ON vec_id = doc_id"""))
def _(spark, sf):
    v = si.vectors(spark, sf).withColumn("mid", si.tx.padded_id("mid"))
    return cat.vector_coverage(si.materials(spark, sf), v)


@query("ag8_missing_vectors", with_sql("m", body="SELECT id FROM m WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"))
def _(spark, sf):
    v = si.vectors(spark, sf).withColumn("mid", si.tx.padded_id("mid"))
    return cat.missing_vectors(si.materials(spark, sf), v).select("id")


@query("ag9_pending_steps", "WITH " + si.SQL["m"] + ", " + DER + ", " + STEP_SQL + " SELECT * FROM steps WHERE thumb OR ocr OR visual OR shots OR phash")
def _(spark, sf):
    return cat.pending_steps(si.materials(spark, sf), derived(spark, sf))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    e = si.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("action"), (F.col("value") > 20).alias("accepted"), "event_id", "user_id")


@query("ag10_ops_summary", "WITH " + si.SQL["m"] + ", " + si.SQL["cues"] + ", " + INV + ", " + JN3_SQL + """
 SELECT 'total' AS metric, cast(count(*) AS double) AS value FROM m
 UNION ALL SELECT 'visual_bilingual', count(*) FROM m WHERE kind IN ('videos','images') AND lang = 'en'
 UNION ALL SELECT 'source_attached', count(sub_id) FROM tr
 UNION ALL SELECT 'bad_files', count(*) FROM m WHERE location = 'external' AND external_path NOT IN (SELECT path FROM inv)
 UNION ALL SELECT 'feedback_total', count(*) FROM events UNION ALL SELECT 'feedback_accepted', count(*) FROM events WHERE value > 20
 UNION ALL SELECT 'feedback_rate', round_even(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 3) FROM events
 UNION ALL SELECT 'subs:' || l, (SELECT count(*) FROM m WHERE lang = l AND list_contains(tags,'type:subs')) FROM (VALUES ('en'),('fr'),('de'),('es'),('ja')) v(l)""")
def _(spark, sf):
    m = si.materials(spark, sf)
    tr = cat.attach_transcripts(m, job_cues(spark, sf))
    return cat.ops_summary(m, tr, visual_rows(spark, sf), cat.broken_refs(m, inventory(spark, sf)), feedback(spark, sf), LANGS)


@query("ag11_governance", with_sql("m", body=r""", f AS (SELECT id, created_s, unnest(list_filter([
   CASE WHEN regexp_matches(name, '(?i)(temp|tmp|draft|untitled|copy|\.bak|test_|_test)') THEN 'placeholder' END,
   CASE WHEN trim(description) = '' THEN 'missing_desc' END], lambda x: x IS NOT NULL)) AS issue FROM m),
 r AS (SELECT *, count(*) OVER (PARTITION BY issue) AS total, row_number() OVER (PARTITION BY issue ORDER BY created_s DESC, id) AS rank FROM f)
 SELECT issue, total, rank, id, total > 50 AS truncated FROM r WHERE rank <= 50"""))
def _(spark, sf):
    return cat.governance(si.materials(spark, sf))


AG12_SQL = STEP_SQL + """, x AS (SELECT m.*, 'clip', thumb, shots, list_contains(tags,'role:clip') AS is_clip,
   location = 'external' AND external_path NOT IN (SELECT path FROM inv) AS broken FROM m JOIN steps USING (id)),
 jc AS (SELECT cast(doc_id % 50 AS varchar) AS job, count(*) AS assets, count(*) FILTER (kind = 'videos') AS videos, count(*) FILTER (kind = 'docs') AS docs,
   count(*) FILTER ((list_contains(tags,'role:master') OR kind = 'videos') AND NOT is_clip) AS n_is_master, count(*) FILTER (is_clip) AS n_is_clip,
   count(*) FILTER (kind = 'audio') AS n_is_component, count(*) FILTER (is_clip) AS n_clip_without_parent,
   count(*) FILTER (kind = 'videos' AND thumb) AS n_missing_thumb, count(*) FILTER (kind = 'videos' AND NOT is_clip AND shots) AS n_missing_shots,
   count(*) FILTER (broken) AS n_broken, list_sort(list_distinct(list(CASE WHEN list_contains(tags,'type:subs') THEN lang END))) AS langs FROM x GROUP BY 1)"""
AG12_HEAD = "WITH " + si.SQL["m"] + ", " + DER + ", " + INV + ", " + AG12_SQL


@query("ag12_job_checkup", AG12_HEAD + """ SELECT job, assets, videos, docs, n_is_master, n_is_clip, n_is_component, n_clip_without_parent, n_missing_thumb, n_missing_shots, n_broken,
  array_to_string(list_filter(langs, lambda x: x IS NOT NULL), ',') AS sub_langs, n_broken = 0 AND videos > 0 AS ok FROM jc""")
def _(spark, sf):
    x = cat.job_checkup(si.materials(spark, sf), derived(spark, sf), inventory(spark, sf))
    return x.select("job", "assets", "videos", "docs", "n_is_master", "n_is_clip", "n_is_component", "n_clip_without_parent", "n_missing_thumb",
                    "n_missing_shots", "n_broken", F.array_join("sub_langs", ",").alias("sub_langs"), "ok")


@query("ag13_readiness", AG12_HEAD + """ SELECT job, CASE WHEN n_broken > 0 OR videos = 0 THEN 'job_checkup_failed' ELSE array_to_string(list_filter([
  CASE WHEN n_missing_thumb > 0 THEN 'missing_thumbs' END, CASE WHEN n_missing_shots > 0 THEN 'missing_shots' END,
  CASE WHEN n_clip_without_parent > 0 THEN 'clips_missing_parent' END, CASE WHEN n_is_master = 0 THEN 'no_master' END], lambda x: x IS NOT NULL), ',') END AS blocking,
  coalesce(list_contains(langs, 'fr'), false) AS lang_present FROM jc""")
def _(spark, sf):
    x = cat.readiness(cat.job_checkup(si.materials(spark, sf), derived(spark, sf), inventory(spark, sf)), "fr")
    return x.select("job", F.array_join("blocking", ",").alias("blocking"), "lang_present")


VOCAB = ["the", "de", "la", "el", "der", "und", "and", "le", "un", "en"]


@query("ag36_entity_index", with_sql("m", body=f"SELECT DISTINCT id, e AS entity FROM (SELECT id, unnest(list_concat(tags, ai_tags)) AS e FROM m) WHERE e IN {tuple(VOCAB)}"))
def _(spark, sf):
    m = si.materials(spark, sf)
    auto = m.select("id", F.explode("ai_tags").alias("entity"))
    return cat.entity_index(m, auto, VOCAB)


@query("ag43_package_manifest", "WITH " + si.SQL["m"] + ", " + si.SQL["cues"] + ", " + JN3_SQL + """ SELECT source AS package, count(*) AS asset_count, cast(sum(size) AS bigint) AS bytes,
  arg_min(CASE WHEN attached_lang IS NOT NULL THEN attached_lang END, CASE WHEN attached_lang IS NOT NULL THEN doc_id END) AS speech_lang FROM m LEFT JOIN tr USING (id) GROUP BY source""")
def _(spark, sf):
    m = si.materials(spark, sf)
    a = m.select(F.col("source").alias("package"), F.col("doc_id").alias("rank"), "id", "kind", "size")
    return cat.package_manifest(a, cat.attach_transcripts(m, job_cues(spark, sf)))


@query("ag45_collections", with_sql("m", body=""", p AS (SELECT *, CASE WHEN doc_id = 0 THEN 'job0' WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 5 THEN 'parent:gone' ELSE doc_id // 2 || '' END AS up FROM m)
 , w AS (SELECT doc_id, doc_id AS at, up FROM p UNION ALL SELECT w.doc_id, p.doc_id, p.up FROM w JOIN p ON w.up NOT IN ('job0','parent:gone') AND p.doc_id = try_cast(w.up AS bigint)),
 k AS (SELECT doc_id, CASE WHEN up = 'job0' THEN 'root' ELSE up END AS key FROM w WHERE up IN ('job0','parent:gone')),
 g AS (SELECT key, count(*) AS members, count(*) FILTER (kind = 'videos') AS videos, count(*) FILTER (kind = 'docs') AS docs,
   arg_min(m.id, struct_pack(a := CASE WHEN kind = 'videos' THEN 0 ELSE 1 END, b := -created_s, c := m.id)) AS cover_id FROM k JOIN m USING (doc_id) GROUP BY key)
 SELECT * FROM g WHERE members >= 2
 UNION ALL SELECT NULL, 1, CASE WHEN kind = 'videos' THEN 1 ELSE 0 END, CASE WHEN kind = 'docs' THEN 1 ELSE 0 END, m.id FROM m LEFT JOIN k USING (doc_id) WHERE key IS NULL OR key NOT IN (SELECT key FROM g WHERE members >= 2)""", recursive=True))
def _(spark, sf):
    m = si.materials(spark, sf)
    up = F.expr("case when doc_id = 0 then array('job:root') when doc_id % 11 = 0 then cast(array() as array<string>) "
                "when doc_id % 13 = 5 then array('parent:gone') else array(concat('parent:', lpad(cast(floor(doc_id / 2) as string), 9, '0'))) end")
    return cat.collections(m.withColumn("tags", up)).select("key", "members", "videos", "docs", "cover_id")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    e = si.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("mid"), F.col("event_type").alias("action"))


@query("wn1_prune_versions", """SELECT event_id AS id, user_id AS mid, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 50""")
def _(spark, sf):
    return cat.prune_versions(versions(spark, sf)).select("id", "mid", "rank")


@query("ag41_version_stats", "SELECT count(*) AS versions, count(DISTINCT user_id) AS materials_with_versions FROM events")
def _(spark, sf):
    return cat.version_stats(versions(spark, sf))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return si.table(spark, sf, "labels").select(
        si.tx.padded_id("doc_id").alias("id"), F.lit(0).cast("timestamp").alias("ts"), F.lit("app").alias("actor"), F.lit("update").alias("action"),
        F.lit("n").alias("note"), F.expr("case when quality = 1 then 'good.mp4' end").alias("name"), F.expr("case when toxic = 1 then 'flat2d' end").alias("form"),
    )


WN2 = "ch AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good.mp4' END AS nn, CASE WHEN toxic = 1 THEN 'flat2d' END AS nf FROM labels)"


@query("wn2_apply_updates", "WITH " + si.SQL["m"] + ", " + WN2 + """ SELECT id AS mid, name, form FROM m JOIN ch USING (doc_id)
  WHERE coalesce(nn, name) <> name OR coalesce(nf, form) <> form""")
def _(spark, sf):
    _, before = cat.apply_updates(si.materials(spark, sf), _changes(spark, sf), ["name", "form"])
    return before.select("mid", F.col("payload")["name"].alias("name"), F.col("payload")["form"].alias("form"))


@query("wn2_diff_version", "WITH " + si.SQL["m"] + ", " + WN2 + """ SELECT id AS mid, 'name' AS field, name AS version, nn AS current FROM m JOIN ch USING (doc_id) WHERE nn <> name
  UNION ALL SELECT id, 'form', form, nf FROM m JOIN ch USING (doc_id) WHERE nf <> form""")
def _(spark, sf):
    new, before = cat.apply_updates(si.materials(spark, sf), _changes(spark, sf), ["name", "form"])
    return cat.diff_version(before, new)


@query("wn2_restore", with_sql("m", body="SELECT id, name, form FROM m"))
def _(spark, sf):
    new, before = cat.apply_updates(si.materials(spark, sf), _changes(spark, sf), ["name", "form"])
    return cat.restore(new, before, ["name", "form"]).select("id", "name", "form")


@query("sl1_sort_page", with_sql("m", body=", f AS (SELECT m.*, l.doc_id IS NOT NULL AS fav FROM m LEFT JOIN labels l USING (doc_id)) SELECT id, size FROM f ORDER BY fav DESC, size DESC, id LIMIT 25 OFFSET 50"))
def _(spark, sf):
    fav = si.table(spark, sf, "labels").select(si.tx.padded_id("doc_id").alias("mid"))
    return cat.sort_page(cat.flag_favorites(si.materials(spark, sf), fav), "size", 50, 25).select("id", "size")


@query("sl2_latest", "SELECT event_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(spark, sf):
    e = si.table(spark, sf, "events")
    return cat.latest(e, 100, [F.desc("ts"), F.desc("event_id")], F.col("event_type") != "view").select("event_id", "event_type")
