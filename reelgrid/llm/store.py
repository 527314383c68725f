"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.scale import shared_folder


class Workspace:
    """Tables of one run under one folder of ``spark.checkpoint.dir``.

    ``keep`` cuts the lineage at a written table, so a lost executor costs one
    step at most; ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path(uuid.uuid4().hex)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        sc = self.spark.sparkContext
        for table in tables:
            path = sc._jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table)))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def top_threshold(df: DataFrame, key: str, n: int) -> int | None:
    """The largest value v of a 64-bit integer column such that at least ``n``
    rows have ``key >= v``; None when there are fewer rows.

    Found 16 bits at a time: each pass counts rows by the next 16 bits among
    those that share the bits found so far, so at most 65,536 counts reach the
    driver and no rows are sorted.
    """
    if n <= 0:
        return None
    low, rest = -(1 << 63), n
    for shift in (48, 32, 16, 0):
        part = F.shiftright(F.col(key) - F.lit(low) if shift < 48 else F.col(key), shift)
        seen = df.where(F.col(key).isNotNull())
        if shift < 48:
            seen = seen.where((F.col(key) >= low) & (F.col(key) <= low + (1 << (shift + 16)) - 1))
        counts = seen.groupBy(part.cast("long").alias("p")).agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values("p", ascending=False)
        total = np.cumsum(counts["c"].to_numpy())
        at = int(np.searchsorted(total, rest))
        if at >= len(total):
            return None
        p = int(counts["p"].iloc[at])
        rest -= int(total[at - 1]) if at else 0
        low = (p << 48) if shift == 48 else low + (p << shift)
    return low
