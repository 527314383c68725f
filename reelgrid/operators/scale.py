"""Building blocks that keep one hot key from landing in one task.

Everything ordered within a track, job or query is built on these four ideas:

* a *chunk* column splits a key into pieces that are shuffled separately;
* running aggregates are computed per chunk and corrected by the carry of the
  chunks before it (a two-level prefix scan);
* row positions come from a range partitioning plus per-partition offsets;
* sequential rules run chunk by chunk and are repeated only where the state
  that enters a chunk was not the one assumed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rows of one key per chunk.  Large enough to amortise the second level of a
# scan, small enough that a chunk always fits a task.
CHUNK_ROWS = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names, else (local
    mode only) a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, runs the plan once, and gives
    the planner the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/reelgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cols(names: Iterable[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _on(left: str, right: str, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on ``keys`` that keeps the left key columns only."""
    joined = left.alias("l").join(right.alias("r"), _on("l", "r", keys), how)
    extra = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return joined.select("l.*", *extra)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (map-side reduced)."""
    return top_k(df, keys, order, 1, "__rn").drop("__rn")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based row position per key without gathering a key in one task.

    ``order`` must be total within a key.  The rows are range-partitioned by
    (keys, order) and materialised, so the offsets and the local numbering see
    the same partitions even if a task is recomputed.
    """
    bounds = [*_cols(keys), *order]
    chunked = stable(df.repartitionByRange(*bounds).withColumn("__chunk", F.spark_partition_id()))
    group = [*keys, "__chunk"]
    local = Window.partitionBy(*group).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    numbered = chunked.withColumn("__local", F.row_number().over(local))
    return (
        join_keys(numbered, offsets, group)
        .withColumn(name, (F.col("__local") + F.col("__before")).cast("long"))
        .drop("__chunk", "__local", "__before")
    )


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    specs: dict[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Add running ``sum``/``max``/``min``/``count`` columns per key.

    ``chunk`` must be non-decreasing in ``order`` within a key.  The input is
    written once and only the per-chunk totals of a key meet in one task.
    ``exclusive`` leaves the current row out of its own value.
    """
    group = [*keys, chunk]
    upto = -1 if exclusive else 0
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    df = stable(df)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    named = df
    for name, (_, expr) in specs.items():
        named = named.withColumn(f"__v_{name}", expr)
    totals = named.groupBy(*group).agg(
        *[_FOLD[kind](F.col(f"__v_{name}")).alias(f"__t_{name}") for name, (kind, _) in specs.items()]
    )
    again = {"count": F.sum}
    for name, (kind, _) in specs.items():
        fold = again.get(kind, _FOLD[kind])
        totals = totals.withColumn(f"__c_{name}", fold(F.col(f"__t_{name}")).over(before)).drop(f"__t_{name}")
    out = named
    for name, (kind, _) in specs.items():
        out = out.withColumn(f"__l_{name}", _FOLD[kind](F.col(f"__v_{name}")).over(local))
    out = join_keys(out, totals, group)
    for name, (kind, _) in specs.items():
        out = out.withColumn(name, _merge(kind, F.col(f"__l_{name}"), F.col(f"__c_{name}")))
        out = out.drop(f"__l_{name}", f"__c_{name}", f"__v_{name}")
    return out


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[Column],
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
) -> DataFrame:
    """Previous/next row values per key, across chunk borders.

    ``lag`` and ``lead`` map a new column name to an existing column.
    """
    group = [*keys, chunk]
    local = Window.partitionBy(*group).orderBy(*order)
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    lag, lead = lag or {}, lead or {}
    df = stable(df)
    edges, out = [], df
    rank = F.row_number().over(local)
    rank_back = F.count(F.lit(1)).over(Window.partitionBy(*group))
    for name, col in lag.items():
        out = out.withColumn(f"__p_{name}", F.lag(F.struct(col)).over(local))
    for name, col in lead.items():
        out = out.withColumn(f"__n_{name}", F.lead(F.struct(col)).over(local))
    marked = df.withColumn("__rn", rank).withColumn("__size", rank_back)
    for name, col in lag.items():
        last = F.max(F.when(F.col("__rn") == F.col("__size"), F.struct(col)))
        edges.append(last.alias(f"__e_{name}"))
    for name, col in lead.items():
        first = F.max(F.when(F.col("__rn") == 1, F.struct(col)))
        edges.append(first.alias(f"__e_{name}"))
    ends = marked.groupBy(*group).agg(*edges)
    for name in lag:
        ends = ends.withColumn(f"__x_{name}", F.lag(f"__e_{name}").over(chunks)).drop(f"__e_{name}")
    for name in lead:
        ends = ends.withColumn(f"__x_{name}", F.lead(f"__e_{name}").over(chunks)).drop(f"__e_{name}")
    out = join_keys(out, ends, group)
    for name, col in lag.items():
        out = out.withColumn(name, F.coalesce(F.col(f"__p_{name}"), F.col(f"__x_{name}"))[col])
        out = out.drop(f"__p_{name}", f"__x_{name}")
    for name, col in lead.items():
        out = out.withColumn(name, F.coalesce(F.col(f"__n_{name}"), F.col(f"__x_{name}"))[col])
        out = out.drop(f"__n_{name}", f"__x_{name}")
    return out


Rows = list[dict]


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    step: Callable[[Rows, str | None, bool], tuple[Rows, str | None]],
    schema: T.StructType,
) -> DataFrame:
    """Run a sequential rule over each key, one chunk at a time.

    ``step(rows, state, last)`` receives a chunk's rows in ``order``, the JSON
    state left by the chunk before (None for the first) and whether it is the
    key's last chunk; it returns output rows in ``schema`` and the state it
    leaves.  Chunks are hash-partitioned, sorted, and streamed through the rule
    in Arrow batches.

    Every chunk is first run with no incoming state; a chunk is rerun while the
    state left by its predecessor differs from the one it was run with.  The
    loop ends at the fixed point, which is the sequential result; keys of one
    chunk take a single pass.
    """
    group = [*keys, chunk]
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    df = stable(df)
    spans = (
        df.select(*group)
        .distinct()
        .withColumn("__last", F.lead(chunk).over(chunks).isNull())
        .withColumn("__seq", F.row_number().over(chunks))
    )
    rows = join_keys(df, spans, group, "inner")
    # One output row is either a result or, marked, the state a chunk leaves.
    out_schema = T.StructType(
        [*[df.schema[k] for k in group]]
        + [
            T.StructField("__seq", T.IntegerType()),
            T.StructField("__in", T.StringType()),
            T.StructField("__left", T.StringType()),
            T.StructField("__mark", T.BooleanType()),
            *schema.fields,
        ]
    )
    names = schema.fieldNames()
    columns = out_schema.fieldNames()

    def settle(held: Rows) -> list[tuple]:
        head = held[0]
        state = head["__in"] if isinstance(head["__in"], str) else None
        result, left = step(held, state, bool(head["__last"]))
        key = tuple(head[k] for k in group)
        tail = (int(head["__seq"]), state, left)
        out = [(*key, *tail, True, *[None] * len(names))]
        out += [(*key, *tail, False, *[r[n] for n in names]) for r in result]
        return out

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        held: Rows = []
        current = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                key = tuple(row[k] for k in group)
                if held and key != current:
                    out += settle(held)
                    held = []
                current = key
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(settle(held), columns=columns)

    def apply(part: DataFrame) -> DataFrame:
        ordered = part.repartition(*group).sortWithinPartitions(*group, *order)
        return ordered.mapInPandas(run, out_schema)

    def results(part: DataFrame) -> DataFrame:
        return part.where(~F.col("__mark")).select(*keys, *names)

    done = stable(apply(rows.withColumn("__in", F.lit(None).cast("string"))))
    while True:
        marks = done.where("__mark").select(*group, "__seq", "__in", "__left")
        wanted = marks.withColumn("__want", F.lag("__left").over(chunks))
        stale = wanted.where(~F.col("__in").eqNullSafe(F.col("__want"))).select(*group, "__want")
        stale = stable(stale)
        if not stale.limit(1).count():
            return results(done)
        redo = join_keys(rows, stale.withColumnRenamed("__want", "__in"), group, "inner")
        kept = done.alias("l").join(stale.alias("r"), _on("l", "r", group), "left_anti")
        done = stable(kept.unionByName(apply(redo)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as (node, root).

    Alternating large-star and small-star rounds: a logarithmic number of
    joins, no neighbour list is ever collected, one written table per round.
    """
    e = (
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = stable(e)
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        pairs = big.join(low, "u")
        small = pairs.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = stable(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
