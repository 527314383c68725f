"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents fall into blocks by a hash.  A source whose target is r
times its size takes all blocks floor(r) times and, for the rest, blocks in a
permuted order as long as they fit; the smallest block that does not fit is
opened and its smaller blocks, then its documents, are taken as long as they fit.

The blocks drawn from all sources are dealt to ``2 ** levels`` output shards by a
splitting tree: at every node the left half gets its share of the node's blocks
and the number from each source follows the multivariate hypergeometric
distribution, source by source.  Quotas add up exactly at every node.  A source's
quotas then cut its permuted sequence of draws into disjoint runs, one per
shard, and rows are shuffled inside their shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Workspace

BLOCKS = 1024
LEVELS = 4
MOST = 3.0


def word_count(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table of sources with their sizes.

    Sources by code point (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the
    whole size; a target stops at ``most`` times its source's size and the excess
    is shared by weight among the others until none is above.

    A source is capped when ``share * weight > most * size``, so sources are capped in
    the order of size per weight; with the first k capped, the share of a unit of
    weight is what is left over the weights left.  The table has a row per source.
    """
    s = sizes.select("source", F.col("source_size").cast("double").alias("size"))
    listed = s.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "size"))).alias("all"))
    weighed = listed.select(F.transform("all", lambda x, i: F.struct((x["size"] / (i % 3 + 1)).alias("per"), x["source"].alias("source"), x["size"].alias("size"), (i % 3 + 1).cast("double").alias("w"))).alias("all"))
    total, weights = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["size"]), F.aggregate("all", F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(total.alias("left"), weights.alias("w"), F.lit(False).alias("done"))

    def cap(a: Column, x: Column) -> Column:
        over = ~a["done"] & (a["left"] * x["w"] > most * x["size"] * a["w"])
        return F.struct(
            F.when(over, a["left"] - most * x["size"]).otherwise(a["left"]).alias("left"), F.when(over, a["w"] - x["w"]).otherwise(a["w"]).alias("w"), (a["done"] | ~over).alias("done")
        )

    unit = weighed.withColumn("end", F.aggregate(F.array_sort("all"), start, cap)).withColumn("unit", F.when(F.col("end.w") > 0, F.col("end.left") / F.col("end.w")).otherwise(F.lit(0.0)))
    return unit.select("unit", F.inline("all")).select("source", F.col("size").cast("long").alias("source_size"), F.least(F.col("unit") * F.col("w"), most * F.col("size")).alias("target"))


def _let(name: str, value: str, use: str) -> str:
    """SQL for ``use``, in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _log_factorial(n: str) -> str:
    """SQL for ln n! less a constant: Stirling's series at n + 8, less the factors between."""
    return _let("v", n, f"(v + 7.5D) * ln(v + 8) - v + 1 / (12 * (v + 8)) - 1 / (360 * pow(v + 8, 3)) - ln({' * '.join(f'(v + {i})' for i in range(1, 8))})")


def hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL for the quantile ``u`` of the number of good ones among ``draws`` without
    replacement from ``total``: exact weights over all values within eight
    standard deviations (and one more on each side), always inside the support."""
    log_weight = lambda x: "-(" + " + ".join(map(_log_factorial, (x, f"p.k - {x}", f"p.d - {x}", f"p.n - p.k - p.d + {x}"))) + ")"
    count = "aggregate(w, named_struct('s', 0D, 'at', 0L), (a, x) -> named_struct('s', a.s + x, 'at', a.at + if(a.s + x < goal, 1L, 0L)), a -> a.at)"
    pick = _let("goal", "p.u * aggregate(w, 0D, (a, x) -> a + x)", f"least(bigint(e.first) + {count}, bigint(e.last))")
    weights = _let("w", f"transform(sequence(bigint(e.first), bigint(e.last)), x -> exp({_let('y', 'double(x)', log_weight('y'))} - top))", pick)
    top = _let("top", _let("y", "greatest(e.first, least(e.last, e.mid))", log_weight("y")), weights)
    ends = "named_struct('first', greatest(p.d - (p.n - p.k), 0D, floor(m.mean - 8 * m.spread) - 1D), 'last', least(p.d, p.k, ceil(m.mean + 8 * m.spread) + 1D), 'mid', round(m.mean))"
    moments = "named_struct('mean', if(p.n > 0, p.d * p.k / p.n, 0D), 'spread', if(p.n > 1, sqrt(greatest(p.d * p.k / p.n * (1 - p.k / p.n) * (p.n - p.d) / (p.n - 1), 0D)), 0D))"
    return _let("p", f"named_struct('n', double({total}), 'k', double({good}), 'd', double({draws}), 'u', double({u}))", _let("m", moments, _let("e", ends, top)))


def split_quotas(ws: Workspace, quotas: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """source, shard, quota, begin: the splitting tree over ``quotas`` (source, n).

    A row is one node with the quotas of all its sources; each level halves the
    nodes.  ``begin`` counts the source's blocks in the shards before."""
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("n").cast("long").alias("n")))).alias("q")).select(F.lit(0).alias("shard"), "q")
    for level in range(levels):
        u = f"(pmod(xxhash64({seed}, {level}, shard, s.source, size(b.out)), 4503599627370496L) + 0.5D) / 4503599627370496D"
        deal = _let("got", hypergeometric("b.total", "s.n", "b.draws", u), "named_struct('total', b.total - s.n, 'draws', b.draws - got, 'out', concat(b.out, array(got)))")
        start = "named_struct('total', total, 'draws', bigint(floor((total + shard % 2) / 2)), 'out', cast(array() as array<bigint>))"
        node = node.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x.n)")).withColumn("left", F.expr(f"aggregate(q, {start}, (b, s) -> {deal}, b -> b.out)"))
        half = lambda side, n: f"named_struct('shard', shard * 2 + {side}, 'q', transform(q, (x, i) -> named_struct('last', x.last, 'source', x.source, 'n', {n})))"
        node = ws.keep(node.select(F.expr(f"inline(array({half(0, 'left[i]')}, {half(1, 'x.n - left[i]')}))")))
    flat = node.select("shard", F.inline("q"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.select("source", "shard", F.col("n").alias("quota"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))


def _fits(items: DataFrame, key: list[str], name: str, room: str) -> DataFrame:
    """Per ``key``: the ``name``s taken, in permuted order as long as they fit into
    ``room``, the room left, and the smallest that did not fit (or null)."""
    listed = items.groupBy(*key, room).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("x"), "words"))).alias("all"))
    start = F.struct(F.col(room).alias("room"), F.array().cast("array<bigint>").alias("took"), F.lit(None).cast("struct<words:bigint,x:bigint>").alias("open"))

    def take(a: Column, x: Column) -> Column:
        fit = x["words"] <= a["room"]
        return F.struct(
            F.when(fit, a["room"] - x["words"]).otherwise(a["room"]).alias("room"),
            F.when(fit, F.concat(a["took"], F.array(x["x"].cast("bigint")))).otherwise(a["took"]).alias("took"),
            F.when(fit, a["open"]).otherwise(F.least(a["open"], F.struct(x["words"].cast("bigint").alias("words"), x["x"].cast("bigint").alias("x")))).alias("open"),
        )

    return listed.select(*key, F.aggregate("all", start, take).alias("r")).select(*key, F.col("r.room").alias("left"), "r.took", F.col("r.open.x").alias("open"), F.col("r.open.words").alias("open_words"))


def mix_plan(docs: DataFrame, seed: int = 0, levels: int = LEVELS, blocks: int = BLOCKS, most: float = MOST, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but its text (doc_id, source), with size, source_size,
    target, copies, taken = copies * size, and shards: the output shard of each copy.

    Sizes are words ``[^\\x20\\x09-\\x0D]+``; a null or empty text has size 0 and takes
    nothing of a target.  A null source is one source, the last.  No document
    exceeds ``most`` copies.  Rows that repeat a doc_id are taken together; a null
    doc_id is one like any other.  No rows in give no rows out.
    """
    ws = Workspace(docs.sparkSession)
    own = {"size", "source_size", "target", "copies", "taken", "shards"}
    kept = [c for c in docs.columns if c != text and c not in own]
    # Other columns travel as one, so that their names can't meet those used below.
    rest = [c for c in kept if c not in ("doc_id", "source")]
    carried = F.struct(*[F.col(c) for c in rest]) if rest else F.lit(None).cast("int")
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "doc_id"), F.lit(blocks)).cast("int")
    inner = F.pmod(F.xxhash64(F.lit(seed), F.lit("inner"), "doc_id"), F.lit(blocks)).cast("int")
    sized = ws.keep(docs.select("doc_id", "source", carried.alias("__rest"), word_count(text).alias("size"), block.alias("block"), inner.alias("inner")))
    by_block = ws.keep(sized.groupBy("source", "block").agg(F.sum("size").alias("words")))
    goal = ws.keep(targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = ws.keep(goal.withColumn("epochs", whole).withColumn("room", (F.col("target") - F.col("epochs") * F.col("source_size"))))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    rank = lambda what: F.xxhash64(F.lit(seed), F.lit("rank"), F.col(what), F.col("source"))

    # The last, partial epoch: blocks, then inner blocks and documents of one block.
    g = goal.select(F.col("source").alias("s"), "room", "epochs")
    roomy = by_block.join(g, by_block["source"].eqNullSafe(g["s"]) & (F.col("room") > 0)).select("source", "room", "block", "words", rank("block").alias("rank"))
    first = ws.keep(_fits(roomy, ["source"], "block", "room"))
    f = first.where("open is not null").select(F.col("source").alias("s"), "left", "open")
    opened = ws.keep(sized.select("source", "doc_id", "size", "block", "inner").join(f, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("open"))).select("source", "doc_id", "size", "inner", "left", "block"))
    inner_sizes = opened.groupBy("source", "left", "inner").agg(F.sum("size").alias("words")).withColumn("rank", -F.col("words"))
    second = ws.keep(_fits(inner_sizes, ["source"], "inner", "left"))
    f = second.where("open is not null").select(F.col("source").alias("s"), F.col("left").alias("room"), "open")
    last = opened.join(f, F.col("source").eqNullSafe(F.col("s")) & (F.col("inner") == F.col("open"))).groupBy("source", "room", "doc_id").agg(F.sum("size").alias("words")).withColumn("rank", -F.col("words"))
    nearer = F.col("open").isNotNull() & (F.col("open_words") - F.col("left") < F.col("left"))  # one more is nearer to the target than none
    third = ws.keep(_fits(last, ["source"], "doc_id", "room").withColumn("took", F.when(nearer, F.concat("took", F.array("open"))).otherwise(F.col("took"))))

    # Draws of each source: its blocks once per epoch, then those of the partial one.
    order = lambda epoch: F.xxhash64(F.lit(seed), F.lit("draw"), epoch, F.col("block"), F.col("source"))
    present = by_block.join(g, by_block["source"].eqNullSafe(g["s"])).select("source", "block", "epochs")
    taken = first.select("source", F.explode(F.concat("took", F.when(F.col("open").isNotNull(), F.array("open")).otherwise(F.array().cast("array<bigint>")))).alias("block"))
    full = present.where("epochs > 0").select("source", "block", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("epoch"))
    part = taken.select("source", F.col("block").cast("int").alias("block"), F.lit(1 << 20).alias("epoch"))
    drawn = full.unionByName(part)
    w = Window.partitionBy("source").orderBy("epoch", order(F.col("epoch")), "block")
    drawn = ws.keep(drawn.withColumn("at", F.row_number().over(w) - 1))  # at most ``most * blocks`` draws of a source
    quota = split_quotas(ws, drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")), levels, seed).where("quota > 0")
    q = quota.select(F.col("source").alias("s"), "shard", "begin", (F.col("begin") + F.col("quota")).alias("end"))
    dealt = drawn.join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")))
    shards = dealt.groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("epoch") < (1 << 20), F.struct("epoch", "shard")))).alias("full"), F.max(F.when(F.col("epoch") == (1 << 20), F.col("shard"))).alias("part")
    )  # at most ``most`` draws of a block

    # Which documents of a partly taken block go along.
    s2 = second.select(F.col("source").alias("s"), F.explode(F.col("took").cast("array<int>")).alias("inner"))
    whole_inner = opened.select("source", "doc_id", "inner").join(s2, F.col("source").eqNullSafe(F.col("s")) & (opened["inner"] == s2["inner"])).select("source", "doc_id")
    some = ws.keep(whole_inner.unionByName(third.select("source", F.explode("took").alias("doc_id"))).distinct().withColumn("chosen", F.lit(True)))
    first_block = first.select(F.col("source").alias("s"), F.col("open").cast("int").alias("open_block"))
    goal_side = goal.select(F.col("source").alias("s0"), "source_size", "target")
    per_block = ws.keep(
        by_block.select("source", "block")
        .join(shards.withColumnsRenamed({"source": "s1", "block": "b1"}), F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1")), "left")
        .join(first_block, F.col("source").eqNullSafe(F.col("s")), "left").join(goal_side, F.col("source").eqNullSafe(F.col("s0")))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", F.coalesce(F.col("full.shard"), F.array().cast("array<int>")).alias("full"), "part", (F.col("block") == F.col("open_block")).alias("opened"))
    )
    chosen = some.select(F.col("source").alias("s2"), F.col("doc_id").alias("d2"), "chosen")
    out = sized.join(per_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).join(chosen, F.col("source").eqNullSafe(F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left")
    goes = F.col("part").isNotNull() & (~F.coalesce("opened", F.lit(False)) | F.coalesce("chosen", F.lit(False)))
    out = out.withColumn("shards", F.concat("full", F.when(goes, F.array("part")).otherwise(F.array().cast("array<int>")))).withColumn("copies", F.size("shards"))
    columns = [F.col(f"__rest.`{c}`").alias(c) if c in rest else F.col(c) for c in kept]
    return out.select(*columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "shards")


def shards_table(docs: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: the columns of ``docs``, shard, copy, order; a row per copy
    drawn.  Write it with ``partitionBy('shard')``: a shard's files hold its rows by a
    hash of source and doc_id, each in random order.  The join with the plan is the only
    exchange of the texts, so as many tasks write as Spark gives the join.

    All rows of one source and doc_id (each may be null) have the same shards."""
    shards = plan.select(F.col("source").alias("__source"), F.col("doc_id").alias("__doc_id"), "shards").distinct()
    found = docs.drop("copy", "shard", "order", "shards").join(shards, F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    copies = found.select("*", F.posexplode("shards").alias("copy", "shard")).drop("__source", "__doc_id", "shards")
    shuffle = F.xxhash64(F.lit(seed), F.lit("order"), "doc_id", "source", "copy", "text")
    return copies.withColumn("order", shuffle).sortWithinPartitions("shard", "order")


def draw(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mix_plan`` and the mix (``shards_table``), written by shard to the
    shared folder; copies, taken and shards of the plan are those of the drawn rows."""
    ws = Workspace(docs.sparkSession)
    plan = ws.keep(mix_plan(docs, seed))
    mix = shards_table(docs, plan, seed)
    mix.write.partitionBy("shard").parquet(ws.path("mix"))
    mix = docs.sparkSession.read.schema(mix.schema).parquet(ws.path("mix")).select(*mix.columns)
    drawn = mix.select("source", "doc_id", "copy", "shard").distinct().groupBy("source", "doc_id").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("drawn"))  # at most ``most`` copies
    drawn = drawn.withColumnsRenamed({"source": "__source", "doc_id": "__doc_id", "drawn": "__drawn"})
    found = plan.drop("shards").join(drawn, F.col("source").eqNullSafe(F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left")
    found = found.withColumn("shards", F.coalesce(F.col("__drawn.shard"), F.array().cast("array<int>"))).withColumn("copies", F.size("shards"))
    return found.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).select(*plan.columns), mix
