"""Documents, saved pages, API items and configuration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import parse as ps
from reelgrid.functions.text import text_or_empty


def read_documents(spark: SparkSession, sources: Sequence[tuple[str, str]]) -> DataFrame:
    """Text corpus from (path or glob, label) sources; missing paths give no rows."""
    out = spark.createDataFrame([], "source string, text string, label string")
    for path, label in sources:
        try:
            df = spark.read.option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
            df = df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"), F.lit(label).alias("label"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(df)
    return out


def read_event_log(spark: SparkSession, path: str, days: int | None = None) -> DataFrame:
    """Event rows from JSON lines; malformed lines are skipped, ``days`` keeps the last days."""
    df = spark.read.schema(schemas.EVENT_LOG).option("mode", "DROPMALFORMED").json(path)
    return df if days is None else df.where(F.col("ts") >= F.date_sub(F.current_date(), days - 1))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold translations, one row per sample, language and reference."""
    g = spark.read.schema(schemas.GOLD).json(path)
    x = g.select("id", "source_lang", "source_text", "type", F.explode("references").alias("lang", "refs"))
    return x.select("id", "source_lang", "source_text", "type", "lang", F.posexplode("refs").alias("ref_no", "reference"))


def topics_dim(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Topic configuration as a dimension table."""
    schema = (
        "id string, fresh_hours double, daily_quota_per_platform int, min_duration_sec int, score_mode string, quota_scope string, "
        "floors array<struct<platform:string,views:bigint>>, platforms array<string>, exclude_authors array<string>, keywords map<string,array<string>>"
    )
    data = [
        (
            r["id"], float(r.get("fresh_hours", 0)), int(r.get("daily_quota_per_platform", 10)), int(r.get("min_duration_sec", 0)),
            r.get("score_mode", "views"), r.get("quota_scope", "total"), list((r.get("min_views") or {}).items()),
            list(r.get("platforms") or []), list(r.get("exclude_authors") or []), r.get("keywords") or {},
        )
        for r in rows
    ]
    return spark.createDataFrame(data, schema)


def _key(html: Column, key: str, value: str = r'"?(\d+)"?') -> Column:
    v = F.regexp_extract(html, rf'"{key}"\s*:\s*{value}', 1)
    return F.when(v != "", v)


def watch_meta(pages: DataFrame) -> DataFrame:
    """Publish time, views, length and author of saved watch pages (page_id, html).

    JSON-LD comes first, page JSON keys fill what it lacks; the page title and
    language are read as well.
    """
    html = text_or_empty("html")
    ld = F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    stat = "array<struct<interactionType:string,userInteractionCount:string>>"
    schema = f"uploadDate string, datePublished string, duration string, interactionStatistic {stat}, author string"
    doc = F.from_json(F.regexp_replace(F.trim(ld), r"^\[|\]$", ""), schema)
    watch = F.filter(doc["interactionStatistic"], lambda s: s["interactionType"].contains("Watch") | F.lower(s["interactionType"]).contains("view"))
    name = F.coalesce(F.get_json_object(doc["author"], "$.name"), F.when(~doc["author"].startswith("{"), doc["author"]))
    quoted = r'"([^"]+)"'
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    return pages.select(
        "page_id",
        F.coalesce(ps.parse_iso(F.coalesce(doc["uploadDate"], doc["datePublished"])), ps.parse_iso(_key(html, "publishDate", quoted)), ps.parse_iso(_key(html, "uploadDate", quoted))).alias("published_at"),
        F.coalesce(ps.parse_count(F.get(watch, F.lit(0))["userInteractionCount"]), ps.parse_count(_key(html, "viewCount"))).alias("views"),
        F.coalesce(ps.parse_duration(doc["duration"]), ps.parse_count(_key(html, "lengthSeconds")).cast("int")).alias("duration_sec"),
        F.coalesce(name, _key(html, "ownerChannelName", quoted)).alias("author"),
        _key(html, "channelId", '"(UC[^"]+)"').alias("author_id"),
        F.when(title != "", title).alias("title"),
        F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]+)"', 1).alias("lang"),
    )


def fill_meta(c: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Fill only null columns of candidates from page metadata."""
    fields = ["published_at", "views", "duration_sec", "author", "author_id"]
    m = meta.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    x = c.join(m, key, "left")
    return x.select(*[F.coalesce(F.col(f), F.col(f"__{f}")).alias(f) if f in fields else F.col(f) for f in c.columns])


def channel_posts(pages: DataFrame) -> DataFrame:
    """Posts of saved channel pages: channel, post_id, text, views, ts."""
    anchor = r'(?=<a\s[^>]*class="tgme_widget_message_date")'
    parts = pages.select("page_id", F.posexplode(F.split(text_or_empty("html"), anchor)).alias("ord", "p")).where("ord > 0")
    href = F.regexp_extract("p", r'^<a\s[^>]*href="([^"]+)"', 1)
    raw = F.regexp_extract("p", r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', 1)
    text = F.regexp_replace(F.regexp_replace(raw, r"<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        text = F.replace(text, F.lit(entity), F.lit(char))
    shown = F.regexp_extract("p", r'(?s)class="tgme_widget_message_views"[^>]*>(.*?)</span>', 1)
    counted = F.regexp_extract("p", r'data-view="(\d+)"', 1)
    when = F.regexp_extract("p", r'<time[^>]*datetime="([^"]+)"', 1)
    return parts.select(
        "page_id", F.regexp_extract(href, r"t\.me/([^/]+)/(\d+)", 1).alias("channel"), F.regexp_extract(href, r"t\.me/([^/]+)/(\d+)", 2).alias("post_id"),
        F.trim(text).alias("text"), F.coalesce(ps.parse_count(F.when(shown != "", shown)), F.when(counted != "", counted.cast("bigint"))).alias("views"),
        F.unix_timestamp(F.try_to_timestamp(F.when(when != "", when))).cast("double").alias("ts"),
    ).where("channel <> ''")


def page_class(html: str | Column, channel: Column) -> Column:
    """ok, no_match or no_preview for a saved channel page."""
    h = text_or_empty(html)
    low = F.lower(h)
    title = F.lower(F.concat(F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1), F.lit(" "), F.regexp_extract(h, r'(?i)<meta\s+property="og:title"\s+content="([^"]*)"', 1)))
    launch = title.contains("launch @") | title.contains("telegram: launch") | (title.contains("telegram:") & F.contains(title, F.concat(F.lit("@"), F.lower(channel))))
    empty = F.lit(False)
    for k in ["no posts", "nothing found", "tgme_channel_info", "tgme_page_title", "subscribers"]:
        empty = empty | low.contains(k)
    return F.when(h.contains("tgme_widget_message_date") | h.contains("data-post="), "ok").when(launch, "no_preview").when(empty, "no_match").otherwise("no_preview")


def to_candidates(items: DataFrame, platform: str) -> DataFrame:
    """Candidate rows from API item JSON (``item``); unusable items drop."""
    def g(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object("item", f"$.{p}") for p in paths])

    title = F.trim(F.regexp_replace(text_or_empty(g("title")), r"<[^>]+>", ""))
    unix = [g(k) for k in ["timestamp", "release_timestamp", "pubdate", "created", "ctime", "senddate", "pubtime"]]
    iso = [g(k) for k in ["upload_date", "release_date", "uploadDate", "datePublished", "publishDate"]]
    if platform == "bilibili":
        vid = g("bvid")
        cols = {
            "author": g("owner.name", "author"), "author_id": g("owner.mid", "mid"), "views": g("stat.view", "play", "view"), "likes": g("stat.like", "like"),
            "comments": g("stat.reply", "review", "video_review"), "coins": g("stat.coin", "coins", "coin"), "favorites": g("stat.favorite", "favorites", "favorite"),
            "shares": g("stat.share", "share"), "duration": g("duration", "length"), "thumb": g("pic", "cover"), "desc": g("description", "desc"),
        }
        base = "https://www.bilibili.com/video/"
        good = F.lit(True)
    else:
        vid = g("id")
        none = F.lit(None).cast("string")
        cols = {
            "author": g("uploader", "channel"), "author_id": g("channel_id", "uploader_id"), "views": g("view_count", "views"), "likes": g("like_count"),
            "comments": g("comment_count"), "coins": none, "favorites": none, "shares": none, "duration": g("duration"), "thumb": g("thumbnail"), "desc": g("description"),
        }
        base = "https://www.youtube.com/watch?v="
        good = (F.coalesce(g("_type"), F.lit("")) != "playlist") & ~title.isin("[Deleted video]", "[Private video]")
    x = items.where(good & (F.coalesce(vid, F.lit("")) != ""))
    return x.select(
        F.lit(platform).alias("platform"), vid.alias("video_id"), F.concat(F.lit(base), vid).alias("url"), F.when(title != "", title).otherwise(vid).alias("title"),
        cols["author"].alias("author"), cols["author_id"].alias("author_id"), ps.first_time(unix, iso).alias("published_at"),
        *[ps.parse_count(cols[c]).alias(c) for c in ["views", "likes", "comments", "coins", "favorites", "shares"]],
        ps.parse_duration(cols["duration"]).alias("duration_sec"), cols["thumb"].alias("thumb_url"), ps.strip_markup(cols["desc"]).alias("description"),
    )


def export_articles(articles: DataFrame, locales: DataFrame) -> DataFrame:
    """Nested export of ready articles with a language map; cues stay a table of their own.

    articles: id, platform, video_id, slug, source_lang, status, updated_at;
    locales: article_id, locale, title, summary, points array<string>.
    """
    ready = articles.where(F.col("status").isin("ready", "published"))
    by = locales.groupBy(F.col("article_id").alias("id")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("locale", F.struct("title", "summary", "points"))))).alias("locales")
    )
    return ready.join(by, "id", "left").select("platform", "video_id", "slug", F.coalesce("source_lang", F.lit("en")).alias("source_lang"), "locales", "updated_at")


def write_articles(df: DataFrame, path: str) -> None:
    df.orderBy(F.desc("updated_at"), "slug").write.mode("overwrite").json(path)
