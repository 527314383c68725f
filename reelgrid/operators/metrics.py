"""Request metrics, feedback and nearest-rank percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.scale import join_keys, running, stable, top_k


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (index rounds half to even) from value counts.

    Only the distinct values of a key are ordered, with their multiplicity as a
    running sum; the values of a key are spread over range partitions.
    """
    x = df.where(F.col(value).isNotNull())
    counts = x.groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    counts = join_keys(counts, total, keys).repartitionByRange(*keys, "__v")
    counts = stable(counts.withColumn("__chunk", F.spark_partition_id()))
    cum = running(counts, keys, "__chunk", [F.col("__v")], {"__cum": ("sum", F.col("__n"))})
    aggs = []
    for name, p in probs.items():
        index = F.bround((F.col("__total") - 1) * F.lit(p)).cast("bigint")
        aggs.append(F.min(F.when(F.col("__cum") > index, F.col("__v"))).alias(name))
    return cum.groupBy(*keys).agg(*aggs)


def request_metrics(events: DataFrame, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """Counts, errors, zero hits, rates and p50/p95/max of durations per kind."""
    keys = list(keys)
    n = F.count(F.lit(1))
    base = events.withColumn("kind", F.coalesce("kind", F.lit("unknown"))).groupBy(*keys).agg(
        n.alias("count"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("errors"), F.count_if(F.coalesce("zero_hit", F.lit(False))).alias("zero_hits"),
        F.bround(F.coalesce(F.max("duration_ms"), F.lit(0.0)), 2).alias("ms_max"),
    )
    pct = nearest_rank(events.withColumn("kind", F.coalesce("kind", F.lit("unknown"))), keys, "duration_ms", {"ms_p50": 0.5, "ms_p95": 0.95})
    x = join_keys(base, pct, keys)
    rate = lambda c: F.bround(F.col(c) / F.col("count"), 4)
    return x.select(
        *keys, "count", "errors", rate("errors").alias("error_rate"), "zero_hits", rate("zero_hits").alias("zero_hit_rate"),
        F.bround(F.coalesce("ms_p50", F.lit(0.0)), 2).alias("ms_p50"), F.bround(F.coalesce("ms_p95", F.lit(0.0)), 2).alias("ms_p95"), "ms_max",
    )


def recent_metrics(events: DataFrame, n: int = 300, order: Sequence[Column] | None = None) -> DataFrame:
    """Metrics over the last ``n`` durations of each kind."""
    order = order or [F.desc("ts"), F.desc("event_id")]
    return request_metrics(top_k(events, ["kind"], order, n).drop("rank"))


def call_stats(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("calls"), F.bround(F.avg(F.col("ok").cast("double")), 4).alias("ok_rate"),
        F.bround(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    )


def acceptance(feedback: DataFrame) -> DataFrame:
    x = feedback.groupBy("action").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("overrides"), F.count(F.lit(1)).alias("total"))
    return x.withColumn("rate", F.bround(F.col("accepted") / F.col("total"), 3))
