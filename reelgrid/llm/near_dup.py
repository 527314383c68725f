"""Near-duplicate documents by a join on MinHash signature coordinates.

1. Every distinct shingle set gets a signature of ``coordinates`` minima.
2. A set is posted under its coordinate-value pairs.  A pair of sets that agrees
   in ``matches`` of ``coordinates`` coordinates shares at least one of the first
   ``coordinates - matches + 1`` entries of both signatures in any common order
   (the prefix), so only those are posted, rarest first: long posting lists are
   skipped, their coordinates are counted when two sets meet in a short one.
3. In a posting list, sets that agree in ``matches`` coordinates are joined by a
   spanning forest.  Its components hold every agreeing pair.
4. In each component the full shingle sets are intersected.  A large one is cut
   into pieces that share some landmark sets, which joins the copies of all
   pieces; then what is outside the largest confirmed group is intersected with
   all sets of the component, piece by piece.  So no link is lost, no pairs are
   written out, and no task holds more than a piece or two.

Copies of one set are one node throughout, so a group of copies costs one row.
At 64 coordinates and 36 matches a pair at similarity 0.8 fails to agree with
probability below 2e-5, and less above it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .graph import components, smallest_reached
from .store import Workspace

COORDINATES = 64
MATCHES = 36
SKETCH_BITS = 18
BLOCK = 512
PIECE = 128

_rng = np.random.default_rng(4099)
_MULT = (_rng.integers(0, 1 << 31, 1024, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, 1024, dtype=np.uint32)


def _shingle_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> Iterator[np.ndarray]:
    found = W.Words(batch.column(column), W.blank_separated())
    hashes = found.hashes()
    for a, b in zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist()):
        yield np.unique(W.shingle_hashes(hashes[a:b], k))


def _node(shingles: np.ndarray) -> int:
    return int(W.mix(shingles).sum(dtype=np.uint64).astype(np.int64))


def _minima(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 8192):
        v = x[None, i : i + 8192] * _MULT[:coordinates, None]
        v += _PLUS[:coordinates, None]
        np.minimum(low, v.min(axis=1), out=low)
    return low


def signatures(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, node (a hash of the shingle set, null without
    shingles), sig (the minima as little-endian 32-bit numbers)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            n, node, sig = [], [], []
            for s in _shingle_sets(batch, k):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                sig.append(_minima(s, coordinates).tobytes() if len(s) else None)
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "node", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, sig binary")


def _tokens(batch: pa.RecordBatch, coordinates: int) -> np.ndarray:
    raw = batch.column("sig")
    sig = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(len(raw), coordinates)
    return (np.arange(coordinates, dtype=np.uint64)[None, :] << np.uint64(32)) | sig


def _sketch(spark: SparkSession, sets: DataFrame, coordinates: int, bits: int):
    """Counts of coordinate-value pairs in ``2 ** bits`` hashed cells, broadcast:
    a fixed size, whatever the input.  It only orders pairs by how common they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((W.mix(_tokens(batch, coordinates)) >> np.uint64(64 - bits)).astype(np.int64).ravel(), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "c"])

    counts = sets.select("sig").mapInArrow(run, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros(1 << bits, np.float64)
    table[counts["cell"].to_numpy()] = counts["c"].to_numpy()
    return spark.sparkContext.broadcast(table)


def _postings(sets: DataFrame, sketch, coordinates: int, matches: int, bits: int) -> DataFrame:
    """token, node for the rarest ``coordinates - matches + 1`` tokens of each set."""
    prefix = coordinates - matches + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _tokens(batch, coordinates)
            h = W.mix(tokens)
            order = sketch.value[(h >> np.uint64(64 - bits)).astype(np.int64)] + (h & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**33
            first = np.argsort(order, axis=1, kind="stable")[:, :prefix]
            yield pa.record_batch(
                [pa.array(np.take_along_axis(tokens, first, 1).ravel().astype(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), prefix))],
                names=["token", "node"],
            )

    return sets.select("node", "sig").mapInArrow(run, "token long, node long")


def _blocks(lists: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Give every posting list's members to tasks of at most about ``2 * block``
    members: long lists are cut by a hash and each pair of pieces is one group."""
    wide = lists.join(sets, "node")
    pieces = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(11)), pieces).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.struct(F.least(p, own).alias("lo"), F.greatest(p, own).alias("hi")))
    return wide.select("token", "node", "n", "bits", F.inline(pairs)).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "node")


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(cols[:, a].tolist())
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _forest(blocks: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """Edges a, b of a spanning forest of the agreeing sets in each group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["token", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
            sig = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint8).reshape(len(node), coordinates)
            open_ = np.arange(len(node))
            a, b = [], []
            while len(open_) > 1:
                front, open_ = [int(open_[0])], open_[1:]
                while front and len(open_):
                    at = front.pop()
                    near = ((sig[open_] == sig[at]).sum(axis=1) >= matches) & (100 * np.minimum(n[open_], n[at]) >= percent * np.maximum(n[open_], n[at]))
                    hit = open_[near]
                    open_ = open_[~near]
                    front.extend(hit.tolist())
                    a.extend([int(node[at])] * len(hit))
                    b.extend(node[hit].tolist())
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = blocks.mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, from an incidence matrix made a
    few thousand shared shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    found, times = np.unique(np.concatenate([*left, *right]), return_counts=True)
    common = found[times > 1]
    places = []
    for side in (left, right):
        every = np.concatenate(side)
        at = np.searchsorted(common, every)
        at[at == len(common)] = 0
        own = common[at] == every if len(common) else np.zeros(len(every), bool)
        who = np.repeat(np.arange(len(side)), [len(x) for x in side])[own]
        order = np.argsort(at[own], kind="stable")
        places.append((at[own][order], who[order], len(side)))
    for low in range(0, len(common), 4096):
        part = []
        for at, who, n in places:
            i, j = np.searchsorted(at, [low, low + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[who[i:j], at[i:j] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _linked(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges a, b that join the sets of each group (group, side, node, text) that
    are connected by links between its sides 0 and 1 (or within it, if all are 0)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["group"]):
            side = group.column("side").to_numpy()
            node = group.column("node").to_numpy()
            if len(np.unique(node)) < 2:
                continue
            sets = [s for part in W.chunks([group]) for s in _shingle_sets(part, k)]
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
            if not len(one):
                continue
            x, y = [sets[i] for i in one], [sets[i] for i in two]
            both = _intersections(x, y).astype(np.int64)
            size = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :]
            i, j = np.nonzero((100 * both >= percent * (size - both)) & (node[one][:, None] != node[two][None, :]))
            if len(i):
                low_a, low_b = smallest_reached(i, j, len(one), len(two))
                i, j = np.unique(i), np.unique(j)
                yield pa.record_batch(
                    [pa.array(np.concatenate([node[one[i]], node[two[j]]])), pa.array(np.concatenate([node[one[low_a[i]]], node[one[low_b[j]]]]))], names=["a", "b"]
                )

    return groups.repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    block: int = BLOCK,
    piece: int = PIECE,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Two documents are linked when ``100 * intersection >= percent * union`` of
    their distinct ``shingle_words``-word shingles (blank-separated words, A-Z in
    lower case; a shorter text is one shingle).  component_id is the smallest
    doc_id reachable over links; kept marks the document that carries it.

    A null or empty text has no shingles and links with nothing; so does a row
    without doc_id when its text is nobody else's, and its component_id is null
    then and it is kept.  Rows that repeat an id and its text share one result.
    Other columns are ignored; no rows in give no rows out.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    sigs = ws.keep(signatures(docs, shingle_words, coordinates))
    copies = ws.keep(sigs.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n")))
    # One row of each set: of the rows with its smallest id, any.
    sets = ws.keep(
        sigs.where("n_shingles > 0").join(copies.select("node", "first_id"), "node").where("doc_id = first_id")
        .select("node", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["node"])
    )
    sketch = _sketch(spark, sets, coordinates, SKETCH_BITS)
    posted = ws.keep(_postings(sets, sketch, coordinates, matches, SKETCH_BITS))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = ws.keep(posted.join(shared, "token"))
    ws.drop(posted)
    low_bytes = lambda batches: (  # noqa: E731  the low byte of each coordinate: agreeing sets agree in it too
        pa.record_batch(
            [b.column("node"), b.column("n"), pa.array([s[0::4] for s in b.column("sig").to_pylist()], pa.binary())], names=["node", "n", "bits"]
        )
        for b in batches
    )
    small = ws.keep(sets.mapInArrow(low_bytes, "node long, n long, bits binary"))
    ws.drop(sets)
    likely = ws.keep(_forest(_blocks(lists, small, block), coordinates, matches, percent))

    ws.drop(lists, small)
    maybe = components(ws, likely)
    ws.drop(likely)

    # Texts of the documents that may have a partner, fetched once.
    wanted = copies.join(maybe, "node", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            node = [_node(s) if len(s) else None for s in _shingle_sets(batch, shingle_words)]
            yield pa.record_batch([pa.array(node, pa.int64()), batch.column("text")], names=["node", "text"])

    found = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(named, "node long, text string")
    sizes = maybe.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    homes = maybe.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node", F.lit(21)), F.col("pieces")).cast("int"))
    texts = ws.keep(found.where("node is not null").dropDuplicates(["node"]).join(homes, "node"))

    # Every component in pieces; about a quarter of a piece is landmarks, in all of them.
    everywhere = (F.col("pieces") > 1) & (F.pmod(F.xxhash64("node", F.lit(22)), F.col("pieces") * 4) == 0)
    all_pieces = F.sequence(F.lit(0), F.col("pieces") - 1)
    at = texts.select("root", "node", "text", F.explode(F.when(everywhere, all_pieces).otherwise(F.array("own"))).alias("p"))
    sure = ws.keep(_linked(at.select(F.xxhash64("root", "p").alias("group"), F.lit(0).alias("side"), "node", "text"), shingle_words, percent))

    # What is outside the largest confirmed group of a cut component, against all of it.
    held = texts.where("pieces > 1").join(components(ws, sure).withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    held = ws.keep(held)
    largest = held.groupBy("root", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("group", F.struct("n", "group")).alias("largest"))
    held = held.join(largest, "root").withColumn("outside", F.col("group") != F.col("largest"))
    rest = held.where("outside").groupBy("root").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("rest"))
    held = held.join(rest, "root")
    q = F.pmod(F.xxhash64("node", F.lit(23)), F.col("rest")).cast("int")
    one = held.where("outside").select("root", "node", "text", F.lit(0).alias("side"), q.alias("q"), F.explode(all_pieces).alias("p"))
    two = held.select("root", "node", "text", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("q"), F.col("own").alias("p"))
    crossed = one.unionByName(two).select(F.xxhash64("root", "p", "q").alias("group"), "side", "node", "text")
    more_sure = ws.keep(_linked(crossed, shingle_words, percent))
    ws.drop(texts)
    root = components(ws, sure.unionByName(more_sure))
    grouped = copies.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = ws.keep(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")).join(grouped, "root").select("node", "component_id"))
    out = sigs.select("doc_id", "n_shingles", "node").join(smallest, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"))
