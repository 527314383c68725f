"""Parsers for crawled values: counts, durations, times, URLs, names, clocks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.text import as_col, text_or_empty

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_count(c: str | Column) -> Column:
    """``12,345``, ``1.2万``, ``3亿``, ``5.87M`` as a whole number; null if unreadable."""
    s = F.regexp_replace(F.regexp_replace(F.trim(as_col(c).cast("string")), ",", ""), " ", "")
    unit = F.lower(F.substring(s, -1, 1))
    mult = (
        F.when(unit == "亿", 1e8).when(unit == "万", 1e4).when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9)
    )
    body = F.when(mult.isNotNull(), F.regexp_replace(s, ".$", "")).otherwise(s)
    value = F.when(body.rlike(NUMBER), body.cast("double"))
    return (value * F.coalesce(mult, F.lit(1.0))).cast("bigint")


def parse_duration(c: str | Column) -> Column:
    """Seconds from ``90``, ``PT1M30S``, ``1:30`` or ``01:02:03``."""
    s = F.trim(as_col(c).cast("string"))
    iso = r"(?i)^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"

    def part(i: int) -> Column:
        v = F.regexp_extract(s, iso, i)
        return F.when(v == "", 0).otherwise(v.cast("int"))

    nums = F.transform(F.split(s, ":"), lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).cast("int")))
    whole = ~F.exists(nums, lambda x: x.isNull())
    clock = F.when(whole & (F.size(nums) == 2), F.get(nums, F.lit(0)) * 60 + F.get(nums, F.lit(1))).when(
        whole & (F.size(nums) == 3), F.get(nums, F.lit(0)) * 3600 + F.get(nums, F.lit(1)) * 60 + F.get(nums, F.lit(2))
    )
    return F.when(s.rlike(r"^\d+$"), s.cast("int")).when(s.rlike(iso), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(clock)


def parse_iso(c: str | Column) -> Column:
    """Unix seconds (UTC) from ``yyyymmdd`` or an ISO date with optional time."""
    s = F.trim(as_col(c).cast("string"))
    compact = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(s, r"^(\d{8})", 1), F.lit("yyyyMMdd")))
    iso = r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}:\d{2}))?"
    day, time = F.regexp_extract(s, iso, 1), F.regexp_extract(s, iso, 2)
    text = F.concat_ws(" ", day, F.when(time == "", "00:00:00").otherwise(time))
    long = F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(F.when(s.rlike(r"^\d{8}"), compact), F.when(day != "", long)).cast("double")


def parse_unix(c: str | Column) -> Column:
    """Unix seconds; milliseconds are recognised, values before 2001 rejected."""
    s = F.trim(as_col(c).cast("string"))
    n = F.when(s.rlike(NUMBER), s.cast("double"))
    scaled = F.when(n > 1e12, n / 1000.0).otherwise(n)
    return F.when(n.isNotNull(), F.when(scaled >= 1e9, scaled)).otherwise(parse_iso(s))


def first_time(unix_cols: Sequence[Column], iso_cols: Sequence[Column] = ()) -> Column:
    return F.coalesce(*[parse_unix(c) for c in unix_cols], *[parse_iso(c) for c in iso_cols])


def strip_markup(c: str | Column, n: int = 500) -> Column:
    t = F.trim(F.regexp_replace(text_or_empty(c), r"<[^>]+>", ""))
    return F.when(t != "", F.substring(t, 1, n))


def platform_of(url: str | Column) -> Column:
    u = F.lower(text_or_empty(url))
    path = F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1)
    hls = F.trim(u).rlike(r"^https?://") & (path.endswith(".m3u8"))
    return (
        F.when(hls, "hls")
        .when(u.contains("bilibili.com") | u.contains("b23.tv"), "bilibili")
        .when(u.contains("douyin.com"), "douyin")
        .when(u.contains("kuaishou.com") | u.contains("gifshow.com"), "kuaishou")
        .when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube")
        .otherwise("generic")
    )


def video_id_of(url: str | Column) -> Column:
    u = F.trim(text_or_empty(url))

    def found(pattern: str) -> Column:
        v = F.regexp_extract(u, pattern, 1)
        return F.when(v != "", v)

    short = found(r"(?i)(?:v\.douyin\.com|iesdouyin\.com)/([A-Za-z0-9_-]+)")
    short = F.when(~F.lower(short).isin("share", "video", "user", "note"), short)
    douyin = F.coalesce(found(r"(?:/video/|/share/video/)(\d{6,})"), found(r"(?i)[?&](?:modal_id|aweme_id)=(\d{6,})"), short)
    youtube = found(r"(?:youtu\.be/|[?&]v=|/embed/|/shorts/|/live/)([\w-]{11})")
    hls = F.coalesce(
        F.substring(found(r"(?i)/(?:hls_mps|hls)/([a-f0-9]{20,64})/"), 1, 40),
        F.substring(F.sha2(F.regexp_extract(u, r"^([^?#]*)", 1), 256), 1, 16),
    )
    p = platform_of(u)
    return F.when(p == "bilibili", found(r"(?i)(BV\w+)")).when(p == "douyin", douyin).when(p == "youtube", youtube).when(p == "hls", hls)


def canonical_url(platform: Column, video_id: Column, original: Column) -> Column:
    return (
        F.when(platform == "hls", F.trim(original))
        .when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), video_id))
        .when((platform == "douyin") & video_id.rlike(r"^\d+$"), F.concat(F.lit("https://www.douyin.com/video/"), video_id))
        .when(platform == "douyin", F.concat(F.lit("https://v.douyin.com/"), video_id))
        .when(platform == "bilibili", F.concat(F.lit("https://www.bilibili.com/video/"), video_id))
    )


def embed_url(platform: Column, video_id: Column) -> Column:
    return (
        F.when(platform == "youtube", F.concat(F.lit("https://www.youtube.com/embed/"), video_id))
        .when(platform == "bilibili", F.concat(F.lit("https://player.bilibili.com/player.html?bvid="), video_id, F.lit("&high_quality=1&danmaku=0")))
        .otherwise("")
    )


def sanitize_name(c: str | Column) -> Column:
    """File name with only word characters, dots and hyphens."""
    s = F.regexp_replace(text_or_empty(c), r"(?U)[^\w.\-]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "file").otherwise(s)


def slugify(c: str | Column, fallback: Column) -> Column:
    s = F.lower(F.trim(text_or_empty(c)))
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(s, "-{2,}", "-")
    plain = F.regexp_replace(F.lower(fallback), "[^a-z0-9-]", "")
    other = F.when(plain == "", "clip").otherwise(plain)
    short = (s == "") | (F.length(F.regexp_replace(s, "[^a-z0-9-]", "")) < 2)
    return F.substring(F.when(short, other).otherwise(s), 1, 80)


def public_slug(video_id: Column, title: Column) -> Column:
    t, v = F.trim(text_or_empty(title)), F.trim(text_or_empty(video_id))
    v = F.when(v == "", "clip").otherwise(v)
    synthetic = (t == "") | t.startswith("try:") | t.startswith("upload:")
    return F.when(synthetic, slugify(v, F.substring(v, 1, 12))).otherwise(slugify(t, v))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_keyword(c: str | Column, cap: int = 80) -> Column:
    """NFKC, single spaces, capped length."""
    return F.substring(F.trim(F.regexp_replace(nfkc(text_or_empty(c)), r"(?U)\s+", " ")), 1, cap)


def to_clock(ms: str | Column, sep: str = ",") -> Column:
    """``hh:mm:ss,mmm`` from milliseconds; negative counts as zero."""
    t = F.greatest(as_col(ms).cast("bigint"), F.lit(0))
    return F.format_string(
        f"%02d:%02d:%02d{sep}%03d", F.floor(t / 3600000), F.floor(t / 60000) % 60, F.floor(t / 1000) % 60, t % 1000
    )


def from_clock(c: str | Column) -> Column:
    """Milliseconds from ``[hh:]mm:ss,mmm``, ``12.5s`` or ``12.5``; null if unreadable."""
    s = F.regexp_replace(F.trim(text_or_empty(c)), "s+$", "")
    p = r"^(?:(\d+):)?(\d+):(\d+)[,.](\d+)"

    def part(i: int) -> Column:
        v = F.regexp_extract(s, p, i)
        return F.when(v == "", 0).otherwise(v.cast("bigint"))

    plain = F.bround(s.cast("double") * 1000).cast("bigint")
    clock = part(1) * 3600000 + part(2) * 60000 + part(3) * 1000 + part(4)
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), plain).when(s.rlike(p), clock)


def snap_to_frames(sec: Column, fps: float = 30.0, empty: int = 0) -> Column:
    """Seconds moved to a whole number of frames, at least one; ``empty`` frames
    where there is no length (null, zero or less)."""
    rate = fps if fps > 0 else 30.0
    return F.when(sec > 0, F.greatest(F.bround(sec * rate), F.lit(1.0)) / rate).otherwise(empty / rate)


def pixel_box(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column, pad: float = 0.01) -> Column:
    """Normalised box to a padded pixel box that stays one pixel off the edges."""
    nx = F.greatest(F.lit(0.0), F.least(F.lit(0.98), x - pad))
    ny = F.greatest(F.lit(0.0), F.least(F.lit(0.98), y - pad * 0.5))
    nw = F.greatest(F.lit(0.02), F.least(1.0 - nx, w + 2 * pad))
    nh = F.greatest(F.lit(0.02), F.least(1.0 - ny, h + pad))

    def axis(lo: Column, size: Column, total: Column) -> tuple[Column, Column]:
        t = F.greatest(F.lit(2), total.cast("int"))
        p = F.greatest(F.lit(1), F.least(t - 3, F.bround(lo * total).cast("int")))
        q = F.greatest(F.lit(2), F.bround(size * total).cast("int"))
        return p, F.greatest(F.lit(2), F.when(p + q >= t, t - p - 1).otherwise(q))

    px, pw = axis(nx, nw, width)
    py, ph = axis(ny, nh, height)
    return F.struct(px.alias("x"), py.alias("y"), pw.alias("w"), ph.alias("h"))


def visual_fields(c: str | Column) -> Column:
    """Struct of zh/en description and tags from labelled lines; the last good line wins."""
    refusal = "没有提供|未提供|无法观察|无法进行描述|请上传|请提供"
    lines = F.transform(F.split(text_or_empty(c), r"\r?\n"), lambda s: F.trim(s))
    pairs = F.transform(
        lines, lambda s: F.struct(F.lower(s).alias("low"), F.trim(F.regexp_replace(F.regexp_replace(s, "^[^:]*:", ""), "^[^：]*：", "")).alias("val"))
    )
    good = F.filter(pairs, lambda p: (p["val"] != "") & ~p["val"].rlike(refusal))
    zh_d = r"^描述|^description(?!.*en)"
    en_d = r"^en ?描述|^en-description|^description\(en\)|^en description"
    zh_t = "^标签|^tags|^关键字|^关键词"
    en_t = r"^en ?标签|^en-tags|^en tags"

    def pick(pattern: str) -> Column:
        hits = F.filter(good, lambda p: p["low"].rlike(pattern))
        return F.coalesce(F.get(F.reverse(hits), F.lit(0))["val"], F.lit(""))

    return F.struct(pick(zh_d).alias("zh_desc"), pick(zh_t).alias("zh_tags"), pick(en_d).alias("en_desc"), pick(en_t).alias("en_tags"))


def json_list(c: str | Column) -> Column:
    return F.coalesce(F.from_json(as_col(c), "array<string>"), F.array().cast("array<string>"))


def merge_meta(old: str | Column, new: str | Column) -> Column:
    """JSON metadata maps merged, later keys win."""
    kind = "map<string,string>"
    empty = F.create_map().cast(kind)
    a, b = F.coalesce(F.from_json(as_col(old), kind), empty), F.coalesce(F.from_json(as_col(new), kind), empty)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))


def key_points(c: str | Column) -> Column:
    """Key points from a JSON list of objects or plain strings; untitled rows drop."""
    kind = "array<struct<title:string,detail:string,image:string,clip:string,start_sec:double,end_sec:double>>"
    raw = F.from_json(as_col(c), "array<string>")
    one = F.transform(raw, lambda s: F.when(F.trim(s).startswith("{"), F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), kind), F.lit(0))).otherwise(
        F.from_json(F.to_json(F.struct(F.trim(s).alias("title"))), kind[6:-1])))
    return F.coalesce(F.filter(one, lambda p: F.coalesce(F.trim(p["title"]), F.lit("")) != ""), F.array().cast(kind))


def word_bounds(seg_start: Column, seg_end: Column, words: Column) -> Column:
    """Segment bounds from word times (``start_ms``, ``end_ms``), kept within 50 ms of the segment."""
    s, e = F.array_min(F.transform(words, lambda w: w["start_ms"])), F.array_max(F.transform(words, lambda w: w["end_ms"]))
    s2 = F.greatest(seg_start - 50, F.least(s, seg_end))
    e2 = F.least(seg_end + 50, F.greatest(e, seg_start))
    ok = s.isNotNull() & e.isNotNull() & (e2 > s2)
    return F.struct(F.when(ok, s2).otherwise(seg_start).alias("start_ms"), F.when(ok, e2).otherwise(seg_end).alias("end_ms"))


def note_leaves(c: str | Column, keys: Sequence[str]) -> Column:
    """Text leaves of a notes document: (path, value) for whitelisted keys at the
    top level and inside lists of objects."""
    doc = F.from_json(as_col(c), "map<string,string>")
    wanted = F.filter(F.map_entries(doc), lambda e: e["key"].isin(list(keys)) & ~e["value"].rlike(r"^\s*[\[{]"))
    flat = F.transform(wanted, lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("path"), e["value"].alias("value")))
    lists = F.filter(F.map_entries(doc), lambda e: e["value"].rlike(r"^\s*\["))

    def rows(e: Column) -> Column:
        items = F.from_json(e["value"], "array<map<string,string>>")
        return F.flatten(F.transform(items, lambda m, i: F.transform(
            F.filter(F.map_entries(m), lambda x: x["key"].isin(list(keys))),
            lambda x: F.struct(F.concat(F.lit("/"), e["key"], F.lit("/"), i.cast("string"), F.lit("/"), x["key"]).alias("path"), x["value"].alias("value")),
        )))

    return F.array_sort(F.concat(F.coalesce(flat, F.array().cast("array<struct<path:string,value:string>>")), F.coalesce(F.flatten(F.transform(lists, rows)), F.array().cast("array<struct<path:string,value:string>>"))))
