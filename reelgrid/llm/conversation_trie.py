"""Prefix trie of conversations, measured along its Euler tour.

Nodes are the distinct sequences of first turns.  A node is named by sums of
hashes of (position, turn), so the names of all prefixes of a conversation are
running sums, and no conversation has to be held in one task.

The tour enters and leaves every node once.  Its arcs form a linked list that is
ranked by distributed pointer jumping between random splitters: an arc jumps until
it meets a splitter, then the splitters' own, far shorter list is ranked the same
way.  With the positions of the arcs known, sums over a subtree are differences of
two prefix sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.scale import positions, running

from .store import Workspace

#: One arc in so many is a splitter.
SPLIT = 64
CHUNK = 65_536
#: 32-bit pieces of a turn's SHA-256 that are summed for a prefix's name.
_LIMBS = 4


def shared_prefixes(turns: DataFrame, family: int = 100, share: int = 6) -> DataFrame:
    """Conversations that share beginnings: conversation c takes the first
    h = crc32(c as text) % ``share`` turns of conversation c - c % ``family``, then its
    own turns after its first h.  Same columns as ``ordered_turns``, which see, and
    a conversation may be left without turns; returned as (conversations, turns)."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    convs = convs.select("conv", F.coalesce("own", F.lit(0)).alias("own"), (F.crc32(F.col("conv").cast("string").cast("binary")) % share).alias("h"), (F.col("conv") - F.col("conv") % family).alias("base"))
    had = convs.join(convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own")), "base", "left")
    plan = had.select("conv", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"))
    first = turns.where((F.col("pos") > 0) & (F.col("pos") < share))
    head = plan.join(first.withColumnRenamed("conv", "base"), "base").where("pos <= taken").select("conv", "pos", "turn_key", "chars")
    tail = turns.where("pos > 0").join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "chars")
    return plan.select("conv"), head.unionByName(tail)


def ordered_turns(table: DataFrame) -> DataFrame:
    """conv, pos (from 1), turn_key (SHA-256 of role and text) and chars (code points of
    the text) of each row of a table conv_id, turn, role, text; rows without conv_id
    belong to no conversation and are left out."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = table.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), key.alias("turn_key"), F.length(text).cast("long").alias("chars"),
    )
    return positions(rows, ["conv"], [F.col("turn"), F.col("role"), F.sha2("turn_key", 256), F.col("chars")], "pos").drop("turn", "role")


def _limbs(pos: Column) -> list[Column]:
    """Numbers below 2**32 that depend on a turn and its position."""
    mixed = F.sha2(F.concat(F.col("turn_key"), pos.cast("string").cast("binary")), 256)
    return [F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(_LIMBS)]


def _name(sums: list[Column], depth: Column) -> Column:
    """A node's name: 128 bits of its depth and sums."""
    return F.struct(*[F.xxhash64(F.lit(seed), depth, *sums).alias(c) for seed, c in ((11, "a"), (23, "b"))])


def list_ranks(ws: Workspace, links: DataFrame, split: int = SPLIT) -> DataFrame:
    """(id, rank): the number of steps from each element of linked lists (id, next) to
    the end of its list (next is null); ids are 64-bit and unique."""
    levels, now = [], links.select("id", F.col("next").alias("at"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    while True:
        chosen = lambda c, k=len(levels): F.pmod(F.xxhash64(F.lit(k), F.col(c)), F.lit(split)) == 0  # noqa: E731, B023
        ended = F.col("at").isNull() | chosen("at")
        going, stopped = now.where(~ended), now.where(ended)
        while not going.isEmpty():
            far = going.unionByName(stopped).select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
            jumped = ws.keep(going.join(far, "at").select("id", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps")))
            going, stopped = jumped.where(~ended), stopped.unionByName(jumped.where(ended))
        level = ws.keep(stopped)
        levels.append(level)
        now = level.where(chosen("id"))
        if now.where("at is not null").isEmpty():
            break
    # At the shortest list every element stands before one that ends it.
    known = now.select("id", F.col("steps").alias("rank"))
    for level in reversed(levels):
        further = known.select(F.col("id").alias("at"), F.col("rank").alias("more"))
        summed = level.where("at is not null").join(further, "at").select("id", (F.col("steps") + F.col("more")).alias("rank"))
        known = ws.keep(level.where("at is null").select("id", F.col("steps").alias("rank")).unionByName(summed))
    return known


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, ordered by node and piece, in; a SHA-256 per node out.  One
    piece is held at a time."""
    now, sha = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids")):
            if (a, b) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        if out:
            yield _digests(out)
    if now is not None:
        yield _digests([(*now, sha.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, sha = zip(*rows)
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "ends_sha256": pa.array(sha)})


def prefix_trie(table: DataFrame, rebuild=shared_prefixes, split: int = SPLIT) -> DataFrame:
    """The trie of the conversations of a table conv_id, turn, role, text.

    Turns are ordered by turn, null first; ties by role, then by a hash of role and
    text.  A null role or text is empty, rows without conv_id are left out.
    ``rebuild`` maps the ordered turns to (conversations, turns) before the trie is
    built; None takes them as they are.  Repeated rows are repeated turns.  Other
    columns are ignored, whatever their names.  An empty table gives no node.

    One row per node: conv_id (smallest member), depth, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens (over the subtree: members
    less one times the code points of the node's last text) and ends_sha256 (of the
    ids of the members that end there).  Nodes are told apart by 128 bits.
    """
    ws = Workspace(table.sparkSession)
    turns = ordered_turns(table)
    convs, turns = rebuild(turns) if rebuild is not None else (turns.select("conv").distinct(), turns)
    convs = ws.keep(convs)
    numbered = turns.select("conv", "pos", "chars", F.floor(F.col("pos") / CHUNK).alias("chunk"), *[c.alias(f"v{i}") for i, c in enumerate(_limbs(F.col("pos")))])
    sums = running(numbered, ["conv"], "chunk", [F.col("pos")], {f"s{i}": ("sum", F.col(f"v{i}")) for i in range(_LIMBS)})
    s = [F.col(f"s{i}") for i in range(_LIMBS)]
    steps = ws.keep(sums.select("conv", "pos", "chars", _name(s, F.col("pos")).alias("node"), _name([F.col(f"s{i}") - F.col(f"v{i}") for i in range(_LIMBS)], F.col("pos") - 1).alias("parent")))
    zero = F.lit(0).cast("long")
    root = _name([zero] * _LIMBS, zero)
    at_root = convs.select("conv", zero.alias("pos"), zero.alias("chars"), root.alias("node"), F.lit(None).cast(steps.schema["parent"].dataType).alias("parent"))
    grouped = steps.unionByName(at_root).groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.min("pos").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
    )
    # A node's number is even and names the arc that enters it; one more, the arc that leaves it.
    numbered = ws.keep(grouped.withColumn("id", F.monotonically_increasing_id() * 2))
    above = numbered.select(F.col("node").alias("parent"), F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    nodes = ws.keep(numbered.join(above, "parent", "left"))
    siblings = ws.keep(positions(nodes.where("above is not null").select("above", "id"), ["above"], [F.col("id")], "nth"))
    leave = lambda c: F.col(c) + 1
    first = siblings.where("nth = 1").select(F.col("above").alias("id"), F.col("id").alias("child"))
    enter = nodes.select("id").join(first, "id", "left").select("id", F.coalesce("child", leave("id")).alias("next"))
    after = siblings.select("above", (F.col("nth") - 1).alias("nth"), F.col("id").alias("sibling"))
    out = siblings.select("id", "above", "nth").join(after, ["above", "nth"], "left").select(leave("id").alias("id"), F.coalesce("sibling", leave("above")).alias("next"))
    end = nodes.where("above is null").select(leave("id").alias("id"), F.lit(None).cast("long").alias("next"))
    ranks = list_ranks(ws, ws.keep(enter.unionByName(out).unionByName(end)), split)

    children = siblings.groupBy(F.col("above").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = ws.keep(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    weights = nodes.select("id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    # The last arc has rank 0: positions count from the end, sums run towards the start.
    arcs = ranks.join(weights, "id", "left").select("id", "rank", F.floor(F.col("rank") / CHUNK).alias("chunk"), F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved"))
    tour = ws.keep(running(arcs, [], "chunk", [F.col("rank")], {"leaves": ("sum", F.col("leaf")), "savings": ("sum", F.col("saved"))}).select("id", "leaves", "savings"))
    inside = tour.where("id % 2 = 0").join(tour.where("id % 2 <> 0").select((F.col("id") - 1).alias("id"), F.col("leaves").alias("l0"), F.col("savings").alias("s0")), "id")
    inside = inside.select("id", (F.col("leaves") - F.col("l0")).alias("n_leaves"), (F.col("savings") - F.col("s0")).alias("saved_tokens"))

    lengths = steps.groupBy("conv").agg(F.max(F.struct("pos", "node")).alias("last"))
    ends = convs.join(lengths, "conv", "left").select("conv", F.coalesce(F.col("last.node"), root).alias("node")).select("conv", "node.a", "node.b")
    dealt = ws.keep(ends.repartitionByRange("a", "b", "conv").withColumn("piece", F.spark_partition_id()))
    pieces = dealt.groupBy("a", "b", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    digests = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "piece").select("a", "b", "ids").mapInArrow(_digest, "a long, b long, ends_sha256 string")

    full = nodes.join(inside, "id").select("*", "node.a", "node.b").join(digests, ["a", "b"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
