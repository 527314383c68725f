"""Catalog and cue entities derived from the driver tables.

Every builder is lazy and uses integer or text expressions that Spark and the
SQL twin in ``SQL`` evaluate identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions import text as tx


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(col: str, mod: int, values: list[str]) -> F.Column:
    expr = f"element_at(array({','.join(repr(v) for v in values)}), cast({col} % {mod} as int) + 1)"
    return F.expr(expr)


def materials(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    words = F.regexp_extract(F.lower("text"), "[a-z0-9]+", 0)
    stem = F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z0-9]+", "_")
    kind = _pick("doc_id", 4, ["videos", "docs", "audio", "images"])
    ext = F.expr(
        "case doc_id % 4 when 0 then '.mp4' when 1 then '.srt' when 2 then '.wav' "
        "else (case when doc_id % 8 = 3 then '.gif' else '.jpg' end) end"
    )
    extra = F.expr(
        "case doc_id % 4 when 0 then (case when doc_id % 3 = 0 then 'has_audio:0' else 'has_audio:1' end) "
        "when 1 then (case when doc_id % 8 = 1 then 'type:subs' else 'type:text' end) "
        "when 2 then 'role:audio-stem' else (case when doc_id % 8 = 3 then 'type:gif' else 'type:raw' end) end"
    )
    role = F.expr("case when doc_id % 5 = 0 then 'role:master' else 'role:clip' end")
    album = F.expr("case when doc_id % 7 = 0 then concat('album:', source) end")
    tags = F.array(
        F.expr("concat('job:', cast(doc_id % 50 as string))"), role, F.expr("concat('lang:', lang)"), extra, album, words
    )
    return d.select(
        tx.padded_id("doc_id").alias("id"),
        "doc_id",
        kind.alias("kind"),
        ext.alias("ext"),
        F.concat(stem, ext).alias("name"),
        F.concat(F.lit("media/"), "source", F.lit("/"), stem, ext).alias("rel_path"),
        F.col("n_chars").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.array_distinct(F.filter(tags, lambda x: x.isNotNull() & (x != ""))).alias("tags"),
        F.expr("case when doc_id % 2 = 0 then array(regexp_extract(lower(text), '[a-z0-9]+', 0), 'video') "
               "else cast(array() as array<string>) end").alias("ai_tags"),
        F.col("text").alias("description"),
        F.col("source"),
        F.concat(stem, ext).alias("orig_name"),
        F.timestamp_seconds(F.expr("1704067200 + ((doc_id * 37) % 1000) * 60")).alias("created_at"),
        F.expr("case when doc_id % 3 = 0 then 'external' else 'internal' end").alias("location"),
        F.expr("case when doc_id % 3 = 0 then concat('/ext/', cast(doc_id as string)) else '' end").alias("external_path"),
        _pick("doc_id", 8, ["live_vo", "flat2d", "hand2d", "cgi3d", "anime_jp", "ai_img", "", "unlisted"]).alias("form"),
        F.expr("case doc_id % 3 when 0 then array('美食') when 1 then array('影视','音乐') "
               "else cast(array() as array<string>) end").alias("topics"),
        F.expr("case when doc_id % 5 = 0 then array('影视') else array('短视频') end").alias("usage"),
        "lang",
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(
        F.col("item_id").alias("qid"),
        F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), " ").alias("query"),
    )


def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Two channels per asset: the text itself and a version with CJK letters."""
    d = table(spark, sf, "documents").select(tx.padded_id("doc_id").alias("id"), "text")
    return d.select(
        "id",
        F.inline(
            F.array(
                F.struct(F.lit("ocr").alias("channel"), F.col("text").alias("text")),
                F.struct(F.lit("visual").alias("channel"), F.translate(F.lower("text"), "aeiou", "的一是不了").alias("text")),
            )
        ),
    )


def cues(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").alias("idx"),
        (F.col("turn") * 2000).alias("start_ms"),
        F.expr("turn * 2000 + 500 + ((length(text) * 40) % 4000)").cast("long").alias("end_ms"),
        "text",
    )


def second_pass(spark: SparkSession, sf: str) -> DataFrame:
    return (
        cues(spark, sf)
        .where("idx % 7 <> 3")
        .withColumn("shift", F.expr("(idx * 37) % 900 - 450"))
        .select(
            "track_id",
            "idx",
            F.expr("start_ms + shift").alias("start_ms"),
            F.expr("end_ms + shift").alias("end_ms"),
            F.expr("case when idx % 5 = 0 then translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') else text end").alias("text"),
        )
    )


def third_pass(spark: SparkSession, sf: str) -> DataFrame:
    """A pass with other gaps, later by 0.3 s and spelled otherwise here and there."""
    text = F.expr("case when idx % 3 = 0 then replace(text, 'tion', 'TION') else text end")
    return cues(spark, sf).where("idx % 4 <> 1").select("track_id", "idx", (F.col("start_ms") + 300).alias("start_ms"), (F.col("end_ms") + 300).alias("end_ms"), text.alias("text"))


def ideographs(words: F.Column) -> F.Column:
    """A caption in which every word is one CJK character (same word, same character)."""
    code = lambda w: F.lpad(F.hex(F.lit(0x4E00) + F.pmod(F.crc32(w), F.lit(20000))), 4, "0")
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(code(w)), "UTF-16BE")), "")


def captions(spark: SparkSession, sf: str) -> DataFrame:
    """Cues whose whole text is written in ideographs, as captions are compared."""
    return cues(spark, sf).withColumn("text", ideographs(tx.words("text")))


def shown_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The second pass in ideographs; every fifth line lacks its short words."""
    w = tx.words("text")
    kept = F.when(F.col("idx") % 5 == 0, F.filter(w, lambda x: F.length(x) > 3)).otherwise(w)
    return second_pass(spark, sf).withColumn("text", ideographs(kept))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Six of every eight seconds of a track, from its start to its last cue."""
    ends = cues(spark, sf).groupBy("track_id").agg(F.max("end_ms").alias("last"))
    seg = ends.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 8000))).alias("seg"))
    return seg.select("track_id", "seg", (F.col("seg") * 8000 + 1000).alias("start_ms"), (F.col("seg") * 8000 + 7000).alias("end_ms"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("mid"), F.col("embedding").alias("vec"), "label")


def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label, the mean of the label's vectors."""
    e = vectors(spark, sf).select("label", F.posexplode("vec").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(F.col("label").alias("qid")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("qvec")
    )


def phashes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    base = e.select(
        F.col("vec_id").alias("b"),
        F.expr("aggregate(sequence(0, 59), 0L, (h, i) -> h + "
               "case when embedding[i] > 0 then shiftleft(1L, i) else 0L end)").alias("bits"),
    )
    v = e.select("vec_id", F.expr("vec_id - vec_id % 4").alias("b"))
    return v.join(base, "b").select(
        F.col("vec_id").alias("id"), F.expr("bits ^ ((vec_id % 4) * 5)").alias("h")
    )


def requests(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return (table(spark, sf, "events") if events is None else events).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("ok"),
        (F.get_json_object("props", "$.k").cast("int") == 0).alias("zero_hit"),
        "user_id",
    )


def step_events(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    return (table(spark, sf, "events") if events is None else events).select(
        F.col("user_id").alias("job_id"),
        F.expr("event_id % 6").alias("step_key"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        _pick("event_id", 5, ["queued", "running", "done", "failed", "skipped"]).alias("status"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .select(
            F.col("o_orderpriority").alias("platform"),
            F.col("o_orderkey").alias("video_id"),
            F.expr("concat('https://video.example/', cast(o_orderkey as string))").alias("url"),
            F.expr("concat(c_mktsegment, ' ', o_orderpriority, ' ', c_name)").alias("title"),
            F.expr("case when o_custkey % 2 = 0 then 'alpha' else 'beta' end").alias("topic_id"),
            F.col("c_name").alias("author"),
            F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("published_at"),
            F.floor("o_totalprice").alias("views"),
            F.expr("o_orderkey % 1000").alias("likes"),
            F.expr("o_orderkey % 100").alias("comments"),
            F.expr("cast(o_custkey % 600 as int)").alias("duration_sec"),
            F.lower("o_orderstatus").alias("description"),
        )
    )


def frame_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """One box per event; a frame is one day of a user."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("video_id"),
        F.expr("cast(floor((unix_seconds(cast(ts as timestamp)) - 1704067200) / 86400) as int)").alias("frame"),
        F.expr("cast((event_id * 13) % 600 as double)").alias("x0"),
        F.expr("cast(floor(value) % 400 as double)").alias("y0"),
        F.expr("cast((event_id * 13) % 600 + 40 + event_id % 50 as double)").alias("x1"),
        F.expr("cast(floor(value) % 400 + 20 as double)").alias("y1"),
        F.expr("concat(event_type, ' ', cast(event_id % 9 as string))").alias("text"),
        "event_id",
    )


def pack_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """A binary dependency tree of jobs; job 0 is the root."""
    return table(spark, sf, "part").select(
        F.expr("1L").alias("pack_id"),
        F.col("p_partkey").alias("job_id"),
        F.expr("case when p_partkey > 0 then array(cast(floor(p_partkey / 2) as bigint)) "
               "else cast(array() as array<bigint>) end").alias("depends_on"),
        F.expr("case when p_partkey % 97 = 13 then 'failed' when p_partkey % 3 = 0 then 'done' else 'pending' end").alias("status"),
        F.expr("p_size").alias("priority"),
        F.col("p_retailprice").alias("score"),
    )


# The same entities as SQL.  Each value is one common table expression.
SQL = {
    "m": """m AS (SELECT lpad(cast(doc_id AS varchar), 9, '0') AS id, doc_id,
  ['videos','docs','audio','images'][doc_id % 4 + 1] AS kind,
  CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.srt' WHEN 2 THEN '.wav'
    ELSE (CASE WHEN doc_id % 8 = 3 THEN '.gif' ELSE '.jpg' END) END AS ext,
  regexp_replace(substring(text, 1, 40), '[^A-Za-z0-9]+', '_', 'g') || ext AS name,
  'media/' || source || '/' || name AS rel_path,
  n_chars AS size, sha256(text) AS sha256,
  list_filter([ 'job:' || cast(doc_id % 50 AS varchar),
    CASE WHEN doc_id % 5 = 0 THEN 'role:master' ELSE 'role:clip' END,
    'lang:' || lang,
    CASE doc_id % 4 WHEN 0 THEN (CASE WHEN doc_id % 3 = 0 THEN 'has_audio:0' ELSE 'has_audio:1' END)
      WHEN 1 THEN (CASE WHEN doc_id % 8 = 1 THEN 'type:subs' ELSE 'type:text' END)
      WHEN 2 THEN 'role:audio-stem' ELSE (CASE WHEN doc_id % 8 = 3 THEN 'type:gif' ELSE 'type:raw' END) END,
    CASE WHEN doc_id % 7 = 0 THEN 'album:' || source END,
    regexp_extract(lower(text), '[a-z0-9]+') ], lambda x: x IS NOT NULL AND x <> '') AS tags,
  CASE WHEN doc_id % 2 = 0 THEN [regexp_extract(lower(text), '[a-z0-9]+'), 'video'] ELSE [] END AS ai_tags,
  text AS description, source, name AS orig_name,
  1704067200 + ((doc_id * 37) % 1000) * 60 AS created_s,
  CASE WHEN doc_id % 3 = 0 THEN 'external' ELSE 'internal' END AS location,
  CASE WHEN doc_id % 3 = 0 THEN '/ext/' || cast(doc_id AS varchar) ELSE '' END AS external_path,
  ['live_vo','flat2d','hand2d','cgi3d','anime_jp','ai_img','','unlisted'][doc_id % 8 + 1] AS form,
  CASE doc_id % 3 WHEN 0 THEN ['美食'] WHEN 1 THEN ['影视','音乐'] ELSE [] END AS topics,
  CASE WHEN doc_id % 5 = 0 THEN ['影视'] ELSE ['短视频'] END AS usage, lang
  FROM documents)""",
    "q": """q AS (SELECT item_id AS qid,
  array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS query FROM benchmark)""",
    "sc": """sc AS (SELECT lpad(cast(doc_id AS varchar), 9, '0') AS id, 'ocr' AS channel, text FROM documents
  UNION ALL SELECT lpad(cast(doc_id AS varchar), 9, '0'), 'visual', translate(lower(text), 'aeiou', '的一是不了') FROM documents)""",
    "cues": """cues AS (SELECT conv_id AS track_id, turn AS idx, turn * 2000 AS start_ms,
  turn * 2000 + 500 + ((length(text) * 40) % 4000) AS end_ms, text FROM conversations)""",
    "pass2": """pass2 AS (SELECT track_id, idx, start_ms + (idx * 37) % 900 - 450 AS start_ms,
  end_ms + (idx * 37) % 900 - 450 AS end_ms,
  CASE WHEN idx % 5 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS text FROM cues WHERE idx % 7 <> 3)""",
    "pass3": """pass3 AS (SELECT track_id, idx, start_ms + 300 AS start_ms, end_ms + 300 AS end_ms,
   CASE WHEN idx % 3 = 0 THEN replace(text, 'tion', 'TION') ELSE text END AS text FROM cues WHERE idx % 4 <> 1)""",
    "spans": """spans AS (SELECT track_id, CAST(seg AS INT) AS seg, seg * 8000 + 1000 AS start_ms, seg * 8000 + 7000 AS end_ms
  FROM (SELECT track_id, unnest(range(0, max(end_ms) // 8000 + 1)) AS seg FROM cues GROUP BY track_id))""",
    "vec": "vec AS (SELECT vec_id AS mid, cast(embedding AS double[]) AS v, label FROM embeddings)",
    "lv": """lv AS (SELECT label AS qid, list(x ORDER BY pos) AS qv FROM (
  SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec)
  GROUP BY label, pos) GROUP BY label)""",
    "ph": """ph AS (SELECT e.vec_id AS id, xor(b.bits, (e.vec_id % 4) * 5) AS h FROM embeddings e
  JOIN (SELECT vec_id, cast(list_sum(list_transform(range(0, 60),
    lambda i: CASE WHEN embedding[i + 1] > 0 THEN cast(1 AS bigint) << cast(i AS bigint) ELSE 0 END)) AS bigint) AS bits
    FROM embeddings) b ON b.vec_id = e.vec_id - e.vec_id % 4)""",
    "rq": """rq AS (SELECT event_id, ts, event_type AS kind, value AS duration_ms, event_type <> 'error' AS ok,
  cast(json_extract_string(props, '$.k') AS int) = 0 AS zero_hit, user_id FROM events)""",
    "st": """st AS (SELECT user_id AS job_id, event_id % 6 AS step_key, event_id, ts,
  ['queued','running','done','failed','skipped'][event_id % 5 + 1] AS status FROM events)""",
    "cand": """cand AS (SELECT o_orderpriority AS platform, o_orderkey AS video_id,
  'https://video.example/' || cast(o_orderkey AS varchar) AS url,
  c_mktsegment || ' ' || o_orderpriority || ' ' || c_name AS title,
  CASE WHEN o_custkey % 2 = 0 THEN 'alpha' ELSE 'beta' END AS topic_id, c_name AS author,
  cast(epoch(o_orderdate) AS double) AS published_at, cast(floor(o_totalprice) AS bigint) AS views,
  o_orderkey % 1000 AS likes, o_orderkey % 100 AS comments, cast(o_custkey % 600 AS int) AS duration_sec,
  lower(o_orderstatus) AS description
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "fb": """fb AS (SELECT user_id AS video_id,
  cast(floor((epoch(ts) - 1704067200) / 86400) AS int) AS frame,
  cast((event_id * 13) % 600 AS double) AS x0, cast(cast(floor(value) AS bigint) % 400 AS double) AS y0,
  cast((event_id * 13) % 600 + 40 + event_id % 50 AS double) AS x1, cast(cast(floor(value) AS bigint) % 400 + 20 AS double) AS y1,
  event_type || ' ' || cast(event_id % 9 AS varchar) AS text, event_id FROM events)""",
    "pj": """pj AS (SELECT 1 AS pack_id, p_partkey AS job_id,
  CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS dep,
  CASE WHEN p_partkey % 97 = 13 THEN 'failed' WHEN p_partkey % 3 = 0 THEN 'done' ELSE 'pending' END AS status,
  p_size AS priority, p_retailprice AS score FROM part)""",
}


def with_sql(*names: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(SQL[n] for n in names) + "\n" + body
