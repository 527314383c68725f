"""Products of two vector tables in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEFT_ROWS = 8_192
RIGHT_ROWS = 1_024
#: Bytes of texts that a task takes from a batch at once.
TEXT_BYTES = 1 << 22


def by_bytes(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (most or TEXT_BYTES), "right")))
        yield at, to
        at = to


def unit_rows(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return a / n


def block_products(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: T.StructType, left_rows: int = LEFT_ROWS, right_rows: int = RIGHT_ROWS,
) -> DataFrame:
    """``run`` on every pair of a piece of ``left`` and a piece of ``right``.

    Both sides are cut by a hash of their key into pieces of about the given
    sizes; a piece is sent once to each piece of the other side, so no task and
    no broadcast grows with either table.
    """
    n_left, n_right = max(1, -(-left.count() // left_rows)), max(1, -(-right.count() // right_rows))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("__a", own(left_key, n_left)).withColumn("__b", each(n_right))
    b = right.withColumn("__b", own(right_key, n_right)).withColumn("__a", each(n_left))
    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInPandas(lambda x, y: run(x, y), schema)
