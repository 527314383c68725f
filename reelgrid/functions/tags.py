"""Column functions over ``array<string>`` tag sets (order is kept)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid.functions import fixed_values as fv
from reelgrid.functions.text import as_col, text_or_empty


def no_tags() -> Column:
    return F.array().cast("array<string>")


def tags_of(c: str | Column) -> Column:
    return F.coalesce(as_col(c), no_tags())


def csv_to_tags(c: str | Column) -> Column:
    """Split a comma-separated column, trim the parts and drop empty ones."""
    return F.filter(F.transform(F.split(text_or_empty(c), ","), lambda s: F.trim(s)), lambda x: x != "")


def tags_to_csv(c: str | Column) -> Column:
    return F.array_join(tags_of(c), ",")


def tag_union(a: str | Column, b: str | Column) -> Column:
    return F.array_distinct(F.concat(tags_of(a), tags_of(b)))


def has_tag(c: str | Column, tag: str) -> Column:
    return F.array_contains(tags_of(c), tag)


def tag_values(c: str | Column, ns: str) -> Column:
    """Values of a namespace such as ``job:`` in tag order."""
    hits = F.filter(tags_of(c), lambda x: x.startswith(ns))
    return F.transform(hits, lambda x: F.substring(x, len(ns) + 1, 1_000_000))


def tag_value(c: str | Column, ns: str) -> Column:
    return F.get(tag_values(c, ns), F.lit(0))


def starts_with_any(x: Column, prefixes: Sequence[str]) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | x.startswith(p)
    return cond


def is_protected(x: Column) -> Column:
    return x.isin(fv.PROTECTED_TAGS) | starts_with_any(x, fv.PROTECTED_PREFIXES)


def is_hidden(x: Column) -> Column:
    return x.isin(fv.HIDDEN_TAGS) | starts_with_any(x, fv.HIDDEN_PREFIXES)


def without(c: str | Column, drop: Sequence[str]) -> Column:
    return F.filter(tags_of(c), lambda x: ~x.isin(list(drop)))


def is_clip(c: str | Column) -> Column:
    return has_tag(c, "role:clip")


def coerce_roles(tags: str | Column, kind: str | Column, path_is_clip: Column | None = None) -> Column:
    """Make ``role:clip`` and ``role:master`` exclusive; complete the roles of videos."""
    t = F.array_distinct(tags_of(tags))
    clip = has_tag(t, "role:clip") | has_tag(t, "type:clip")
    if path_is_clip is not None:
        clip = clip | path_is_clip
    picture = F.when(has_tag(t, "has_audio:0"), no_tags()).otherwise(F.array(F.lit("role:picture")))
    as_clip = tag_union(without(t, ["role:master", "role:picture"]), F.array(F.lit("role:clip"), F.lit("type:clip")))
    as_master = tag_union(t, F.concat(F.array(F.lit("role:master")), picture))
    video = (text_or_empty(kind) == "videos") | has_tag(t, "role:picture")
    return F.when(clip, as_clip).when(video, as_master).otherwise(t)


def reconcile_audio(tags: str | Column, has_audio: Column) -> Column:
    """Keep only the audio facet that was measured."""
    loud = tag_union(without(tags, ["has_audio:0", "role:silent-picture"]), F.array(F.lit("has_audio:1")))
    mute = tag_union(without(tags, ["has_audio:1"]), F.array(F.lit("has_audio:0")))
    return F.when(has_audio, loud).otherwise(mute)


def drop_from_aliases(tags: str | Column) -> Column:
    """Drop ``from:x`` where ``parent:x`` says the same."""
    t = tags_of(tags)
    parents = tag_values(t, "parent:")
    return F.filter(
        t, lambda x: ~(x.startswith("from:") & F.array_contains(parents, F.substring(x, 6, 1_000_000)))
    )


def normalize_model_tags(raw: str | Column) -> Column:
    """Clean tags proposed by a model: charset, stop words, length, first six."""
    low = F.transform(tags_of(raw), lambda x: F.translate(F.lower(F.trim(F.coalesce(x, F.lit("")))), "_ ", "--"))
    kept = F.transform(low, lambda x: F.regexp_replace(x, r"[^a-z0-9\x{4e00}-\x{9fff}-]", ""))
    good = F.filter(
        F.array_distinct(kept),
        lambda x: (x != "")
        & ~x.isin(fv.MODEL_TAG_STOP)
        & (x != "sp")
        & ~x.startswith("type")
        & ~x.startswith("job")
        & (F.length(x) <= fv.MODEL_TAG_MAX_LEN),
    )
    return F.slice(good, 1, fv.MODEL_TAG_MAX)


def rename_tag(tags: str | Column, old: str, new: str) -> Column:
    return F.array_distinct(F.transform(tags_of(tags), lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def drop_tag(tags: str | Column, tag: str) -> Column:
    return F.array_remove(tags_of(tags), tag)


def _short(v: Column, over: int, keep: int) -> Column:
    return F.when(F.length(v) <= over, v).otherwise(F.concat(F.substring(v, 1, keep), F.lit("…")))


def _lookup(v: Column, table: dict[str, tuple[str, str]], which: int) -> Column:
    pairs = [x for k, names in table.items() for x in (F.lit(k), F.lit(names[which]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), v), v)


def tag_label(tag: str | Column, lang: str = "zh") -> Column:
    """Struct of label, group and hidden flag for display."""
    t = as_col(tag)
    zh = lang.lower().startswith("zh")
    which = 0 if zh else 1

    def rest(n: int) -> Column:
        return F.substring(t, n + 1, 1_000_000)

    def named(a: str, b: str, value: Column) -> Column:
        return F.concat(F.lit(a if zh else b), value)

    album = F.when(rest(6) == "", F.lit("未命名" if zh else "untitled")).otherwise(rest(6))
    audio = F.when(t.endswith(":1"), "有声").otherwise("无声") if zh else t
    exact = t.isin(list(fv.EXACT_TAG_LABELS))
    cases = [
        (exact, "source", _lookup(t, fv.EXACT_TAG_LABELS, which)),
        (t.startswith("type:"), "type", named("类型·", "type·", _lookup(rest(5), fv.TYPE_TAG_LABELS, which))),
        (t.startswith("role:"), "role", named("角色·", "role·", _lookup(rest(5), fv.ROLE_TAG_LABELS, which))),
        (t.startswith("job:"), "job", named("任务·", "job·", _short(rest(4), 10, 8))),
        (t.startswith("album:"), "album", named("合集·", "album·", _short(album, 16, 14))),
        (t.startswith("parent:"), "rel", named("父素材·", "parent·", _short(rest(7), 10, 8))),
        (t.startswith("lang:"), "lang", named("语言·", "lang·", rest(5))),
        (t.startswith("has_audio:"), "tech", audio),
    ]
    label, group = t, F.lit("content")
    for cond, name, text in reversed(cases):
        label = F.when(cond, text).otherwise(label)
        group = F.when(cond, F.lit(name)).otherwise(group)
    return F.struct(label.alias("label"), group.alias("group"), is_hidden(t).alias("hide"))
