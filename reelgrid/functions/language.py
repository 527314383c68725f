"""Language codes and translation predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions.text import as_col, text_or_empty

# What can never be a line of a translation.
VIDEO_ID = r"(?i)\bBV[0-9A-Za-z]{8,}\b"
PLACEHOLDER = r"(?i)^(?:try|job|pack)\s*[:：]\s*[\w.\-]+$"
URL = r"(?i)https?://\S+|www\.\S+"
DICT_LITERAL = r"(?s)^\s*\{['\"]?[\w\x{4e00}-\x{9fff}]+['\"]?\s*:.+?\}\s*$"
DICT_KEY = r"\{['\"][A-Za-z\x{4e00}-\x{9fff}]+['\"]\s*:"
CJK = r"[\x{3400}-\x{9fff}]"
KANA = r"[\x{3040}-\x{30ff}]"
HANGUL = r"[\x{ac00}-\x{d7af}]"
LINE_PUNCT = r"[\s\x{3000}，。！？、,.!?;；:：\"'“”‘’()（）\-]"
CJK_LANGS = ["zh", "zh-Hant", "ja", "ko"]
# Fixed value: variant forms that count as the same character.
VARIANTS = {"絶": "絕", "裡": "裏", "峯": "峰", "羣": "群", "䌽": "彩", "甦": "蘇", "堃": "坤", "喆": "哲"}


def is_polluted(c: str | Column, video_id: str = VIDEO_ID) -> Column:
    """Ids, placeholders, dict literals and bare URLs."""
    t = F.trim(text_or_empty(c))
    bad = t.rlike(video_id) | t.rlike(PLACEHOLDER) | t.rlike(DICT_LITERAL) | t.rlike(DICT_KEY)
    return (t != "") & (bad | t.rlike(f"^(?:{URL})$"))


def to_traditional(c: Column, pairs: tuple[str, str]) -> Column:
    """Character-wise simplified to traditional; ``pairs`` is the mapping as two strings."""
    return F.translate(c, pairs[0], pairs[1]) if pairs[0] else c


def shared_idiom(c: str | Column, src: str | Column, pairs: tuple[str, str] = ("", "")) -> Column:
    """Up to four Han characters that are written differently from the source."""
    t = F.trim(text_or_empty(c))
    a = F.translate(to_traditional(t, pairs), "".join(VARIANTS), "".join(VARIANTS.values()))
    b = F.translate(to_traditional(text_or_empty(src), pairs), "".join(VARIANTS), "".join(VARIANTS.values()))
    return t.rlike("^" + CJK + "{1,4}$") & (a != b)


def wrong_language(c: str | Column, lang: str, src: str | Column, pairs: tuple[str, str] = ("", "")) -> Column:
    t = F.trim(text_or_empty(c))
    live = (t != "") & ~is_polluted(t)
    if lang not in CJK_LANGS:
        return live & t.rlike(CJK)
    if lang == "ko":
        return live & t.rlike(CJK) & ~t.rlike(HANGUL)
    if lang == "ja":
        return live & t.rlike(CJK) & ~t.rlike(KANA) & ~shared_idiom(t, src, pairs)
    return F.lit(False)


def overlong(c: str | Column, src: str | Column, lang: str) -> Column:
    if lang not in ("ja", "ko"):
        return F.lit(False)
    t, s = F.length(F.trim(text_or_empty(c))), F.length(F.trim(text_or_empty(src)))
    return (t > 0) & (s > 0) & (t > F.greatest(s * 2.2, s + 6))


def strip_ads(c: str | Column, markers: list[str]) -> Column:
    """Drop sentences with an ad marker; if nothing is left the text stays."""
    t = text_or_empty(c)
    parts = F.filter(F.transform(F.split(F.regexp_replace(t, "\n", ""), "。"), lambda s: F.trim(s)), lambda x: x != "")

    def ad(x: Column) -> Column:
        cond = x.contains("AI") & (x.contains("图") | x.contains("减肥"))
        for m in markers:
            cond = cond | x.contains(m)
        return cond

    kept = F.filter(parts, lambda x: ~ad(x))
    body = F.trim(F.array_join(kept, "。"))
    closed = F.when(body.rlike("[。！？.!?]$"), body).otherwise(F.concat(body, F.lit("。")))
    return F.when(F.size(kept) == 0, F.trim(t)).otherwise(closed)


def clean_hotwords(c: str | Column) -> Column:
    """Line-wise removal of ids, placeholders and URLs; null when nothing is left."""
    lines = F.transform(F.split(text_or_empty(c), r"\r?\n"), lambda s: F.trim(s))

    def clean(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, VIDEO_ID, ""), PLACEHOLDER, ""), URL, "")
        return F.regexp_replace(y, r"^[ ,;:：\-]+|[ ,;:：\-]+$", "")

    kept = F.filter(F.transform(lines, clean), lambda x: (x != "") & ~is_polluted(x))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def language_code(c: str | Column, aliases: dict[str, str], known: list[str]) -> Column:
    """Known code for an alias or any spelling of it; null when unknown."""
    raw = F.translate(F.lower(F.trim(text_or_empty(c))), "_", "-")
    table = {**{k.lower(): k for k in known}, **aliases}
    pairs = [v for kv in table.items() for v in (F.lit(kv[0]), F.lit(kv[1]))]
    return F.element_at(F.create_map(*pairs), raw)


def target_languages(pack: Column, source: str | Column) -> Column:
    """A language pack without the source language."""
    return F.array_except(pack, F.array(as_col(source)))
