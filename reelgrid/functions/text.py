"""Tokens, script classes and other text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK_CHAR = r"[\x{4e00}-\x{9fff}]"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def padded_id(c: str | Column, width: int = 9) -> Column:
    return F.lpad(as_col(c).cast("string"), width, "0")


def words(c: str | Column) -> Column:
    """Latin words and numbers, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0))


def cjk_chars(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(CJK_CHAR), F.lit(0))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Bind a costly value once and use it several times in ``fn``."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def _cjk_tokens(chars: Column) -> Column:
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(F.lit("b:"), a, b))
    return F.concat(F.transform(chars, lambda x: F.concat(F.lit("c:"), x)), pairs)


def tokens(c: str | Column) -> Column:
    """Distinct search tokens: words, ``c:`` characters and ``b:`` bigrams.

    Bigrams run over the CJK characters of the text put side by side.
    """
    def split(s: Column) -> Column:
        latin = F.regexp_extract_all(s, F.lit("[a-z0-9]+"), F.lit(0))
        chars = F.regexp_extract_all(s, F.lit(CJK_CHAR), F.lit(0))
        cjk = F.when(s.rlike(CJK_CHAR), let(chars, _cjk_tokens)).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(latin, cjk))

    return let(F.lower(text_or_empty(c)), split)


def path_tail(c: str | Column, parts: int = 3) -> Column:
    """The last path segments as text, for token matching."""
    split = F.filter(F.split(text_or_empty(c), r"[\\/]+"), lambda x: (x != "") & (x != ":"))
    return F.array_join(F.slice(split, F.greatest(F.size(split) - (parts - 1), F.lit(1)), parts), " ")


def field_token_weight(t: Column) -> Column:
    """Weight of a token in the name, tag, description and path fields."""
    return F.when(t.startswith("b:"), 0.5).when(t.startswith("c:"), 0.1).otherwise(1.0)


def channel_token_weight(t: Column) -> Column:
    """Weight of a token in a sidecar channel; single characters do not count."""
    return F.when(t.startswith("c:"), 0.0).otherwise(1.0)


def has_cjk(c: str | Column) -> Column:
    return text_or_empty(c).rlike(r"[\x{3400}-\x{9fff}]")


def has_kana(c: str | Column) -> Column:
    return text_or_empty(c).rlike(r"[\x{3040}-\x{30ff}]")


def has_hangul(c: str | Column) -> Column:
    return text_or_empty(c).rlike(r"[\x{ac00}-\x{d7af}]")
