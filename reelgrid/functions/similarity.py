"""Text and geometry similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.text import as_col, text_or_empty

# Fixed value: characters that do not count when two captions are compared.
CAPTION_PUNCT = r"[\s\x{3000}\x{a0}，。！？、,.!?;；:：\"'“”‘’()（）\-—_/\\|｜]+"
PY_PUNCT = r"[\s，。！？、,.!?;；:：\"'“”‘’()（）\-—_/\\|｜]+"


def caption_key(c: str | Column) -> Column:
    """Caption text without spaces and punctuation."""
    return F.regexp_replace(text_or_empty(c), CAPTION_PUNCT, "")


def char_set(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(as_col(c), ""), lambda x: x != ""))


def char_jaccard(a: str | Column, b: str | Column) -> Column:
    sa, sb = char_set(a), char_set(b)
    return F.size(F.array_intersect(sa, sb)) / F.greatest(F.size(F.array_union(sa, sb)), F.lit(1))


def alike(a: str, b: str, least: float) -> bool:
    """Do two caption keys reach similarity ``least``, by the share of their characters
    or by 0.9 times that of their longest matching blocks?  Cheap bounds come first."""
    if not (a and b):
        return least <= 0
    if a == b or len({*a} & {*b}) / len({*a, *b}) >= least:
        return True
    blocks = SequenceMatcher(None, a, b)
    return all(0.9 * share() >= least for share in (blocks.real_quick_ratio, blocks.quick_ratio, blocks.ratio))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    out = []
    for x, y, f in zip(a, b, floor):
        if x is None or y is None:
            out.append(None)
            continue
        m = SequenceMatcher(None, x, y)
        # The quick ratio bounds the ratio from above.
        out.append(m.ratio() if 0.9 * m.quick_ratio() > f else 0.0)
    return pd.Series(out, dtype="float64")


# Keeps the optimizer from moving the costly comparison below a distinct or a
# join, where it would see every candidate instead of every pair.
_ratio = _ratio.asNondeterministic()


def caption_sim(a: str | Column, b: str | Column, at_least: float = 0.0) -> Column:
    """Similarity of two caption keys: the larger of the Jaccard share of their characters
    and 0.9 x the sequence ratio, which is worked out only where it can matter.

    Values below ``at_least`` may be reported too low.
    """
    ka, kb = as_col(a), as_col(b)
    jac = char_jaccard(ka, kb)
    need = (ka != kb) & (ka != "") & (kb != "") & (jac < 0.9)
    none = F.lit(None).cast("string")
    floor = F.greatest(jac, F.lit(at_least - 1e-9))
    seq = _ratio(F.when(need, ka).otherwise(none), F.when(need, kb).otherwise(none), floor)
    full = F.greatest(jac, 0.9 * F.coalesce(seq, F.lit(0.0)))
    return F.when((ka == "") | (kb == ""), 0.0).when(ka == kb, 1.0).otherwise(full)


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def iou(a: str, b: str) -> Column:
    """IoU of two boxes given as x0,y0,x1,y1 columns with a prefix."""
    def c(p: str, n: str) -> Column:
        return F.col(f"{p}{n}")

    ix = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    iy = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    inter = F.when((ix > 0) & (iy > 0), ix * iy).otherwise(F.lit(0.0))
    area = (c(a, "x1") - c(a, "x0")) * (c(a, "y1") - c(a, "y0")) + (c(b, "x1") - c(b, "x0")) * (c(b, "y1") - c(b, "y0"))
    return F.when(area - inter > 0, inter / (area - inter)).otherwise(0.0)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def token_cosine(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of the set sizes."""
    n = F.sqrt(F.size(a).cast("double")) * F.sqrt(F.size(b).cast("double"))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)
