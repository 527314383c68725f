"""Near-duplicate pictures: difference hashes, Hamming pairs, clusters."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import as_col
from reelgrid.operators.scale import components, stable, top_k

#: Probes per hash: always worth wider bands, and never more than.
FEW_PROBES = 256
MOST_PROBES = 8_192
#: Hashes of a side that a task compares at once, pairs looked at in one step, and
#: partitions of the comparisons at most.
TILE_ROWS = 8_192
STEP_PAIRS = 1 << 17
TILE_PARTITIONS = 4_096


def dhash(data: str | Column) -> Column:
    """64-bit difference hash of a 72-byte 9x8 gray thumbnail; short input is null.

    Bit row*8+col is set where a pixel is brighter than its right neighbour.
    """
    d = as_col(data)
    px = F.transform(F.sequence(F.lit(1), F.lit(72)), lambda i: F.conv(F.hex(F.substr(d, i, F.lit(1))), 16, 10).cast("int"))
    bits = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(
            F.sequence(F.lit(0), F.lit(7)), lambda c: F.struct((r * 8 + c).alias("bit"), (r * 9 + c).alias("at"))))
    )
    p = F.transform(bits, lambda b: F.when(F.get(px, b["at"]) > F.get(px, b["at"] + 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), b["bit"])).otherwise(F.lit(0).cast("bigint")))
    h = F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return F.when(F.length(d) >= 72, h)


def hash_from_hex(c: str | Column) -> Column:
    """16 hex digits as a signed 64-bit number."""
    return F.conv(as_col(c), 16, -10).cast("bigint")


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(as_col(a).bitwiseXOR(as_col(b)))


def _bands(bands: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``bands`` runs of a 64-bit hash."""
    cuts = [64 * j // bands for j in range(bands + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _band(h: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(h, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _radii(d: int, bands: int) -> list[int]:
    """Per band the distance that must be probed so that no pair within ``d`` is
    lost: were all larger, they would add up to more than ``d``."""
    base, extra = divmod(d + 1, bands)
    return [base - (j >= extra) for j in range(bands)]


def _masks(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def _probes(d: int, bands: int) -> int:
    return sum(comb(w, k) for (_, w), r in zip(_bands(bands), _radii(d, bands)) for k in range(r + 1))


def _scheme(d: int, hashes: int) -> int:
    """Number of bands: band values should be about as many as the hashes, so that
    few meet by chance, while the probes per hash stay below ``MOST_PROBES``."""
    for bands in (2, 3):
        probes = _probes(d, bands)
        if probes <= MOST_PROBES and (probes <= FEW_PROBES or hashes >> (64 // (bands + 1))):
            return bands
    return 4


def hash_pairs(hashes: DataFrame, d: int, bands: int | None = None) -> DataFrame:
    """Pairs of distinct hashes (h_a < h_b) at Hamming distance at most ``d``.

    Small distances, by bands of bits: two hashes within ``d`` agree on one band up to
    a small radius.  One side lists the band values within that radius (masks
    written out as constants), the other its own bands, and an equi-join brings
    them together.  A pair is kept only at its first agreeing band, so nothing is
    deduplicated.  ``bands`` follows the number of hashes; any gives the same pairs.
    Larger distances, for which bands are too many or too coarse, by tiles.
    """
    h = stable(hashes.select("h").where("h is not null").distinct())
    if bands is None and _wide(d):
        x = _tiles(h, h, d, same=True)
        return x.select(F.least("h_a", "h_b").alias("h_a"), F.greatest("h_a", "h_b").alias("h_b"), "dist").where("h_a < h_b")
    return _meet(h, h, d, bands or _scheme(d, h.count())).where("h_a < h_b")


def _wide(d: int) -> bool:
    return min(_probes(d, bands) for bands in (2, 3, 4)) > FEW_PROBES


def _tiles(left: DataFrame, right: DataFrame, d: int, same: bool = False) -> DataFrame:
    """h_a of ``left`` and h_b of ``right`` (columns h, distinct) within ``d``, by comparing pieces.

    Hashes of unlike frequency share bands so often that a join of them costs far more
    than a count of bits.  Both sides are cut into pieces of ``TILE_ROWS``; a task
    counts the differing bits of two pieces, so its time and memory do not grow with the
    tables.  Of one table (``same``) two pieces meet once.
    """
    n, m = (max(1, -(-x.count() // TILE_ROWS)) for x in (left, right))
    piece = lambda k: F.pmod(F.xxhash64("h"), F.lit(k)).cast("int")
    each = lambda low, high: F.explode(F.sequence(low, high))
    a = left.withColumn("__a", piece(n)).withColumn("__b", each(F.col("__a") if same else F.lit(0), F.lit(m - 1)))
    b = right.withColumn("__b", piece(m)).withColumn("__a", each(F.lit(0), F.col("__b") if same else F.lit(n - 1)))
    parts = min(n * (n + 1) // 2 if same else n * m, TILE_PARTITIONS)
    both = a.withColumn("__left", F.lit(True)).unionByName(b.withColumn("__left", F.lit(False))).repartition(parts, "__a", "__b")

    def once(rows: pa.Table) -> bool:
        return same and rows.column("__a")[0] == rows.column("__b")[0]

    def run(rows: pa.Table) -> pa.Table:
        h, is_left = rows.column("h").to_numpy().view("uint64"), rows.column("__left").to_numpy()
        p, q = h[is_left], h[~is_left]
        step = max(1, STEP_PAIRS // max(1, len(q)))
        found = [[np.empty(0, "int64")] * 2 + [np.empty(0, "int32")]]
        for low in range(0, len(p) if len(q) else 0, step):
            dist = np.bitwise_count(p[low : low + step, None] ^ q)
            i, j = np.divmod(np.flatnonzero(dist <= d), len(q))
            if once(rows):
                i, j = (k[p[low + i] < q[j]] for k in (i, j))
            found.append([p[low + i].view("int64"), q[j].view("int64"), dist[i, j].astype("int32")])
        return pa.table([np.concatenate(c) for c in zip(*found)], names=["h_a", "h_b", "dist"])

    return both.groupBy("__a", "__b").applyInArrow(run, "h_a long, h_b long, dist int")


def _meet(left: DataFrame, right: DataFrame, d: int, bands: int) -> DataFrame:
    """h_a of ``left`` and h_b of ``right`` (columns h, distinct) within ``d``, by bands."""
    used = [(j, *cut, r) for j, (cut, r) in enumerate(zip(_bands(bands), _radii(d, bands))) if r >= 0]
    own = F.array(*[F.struct(F.lit(j).alias("band"), _band(F.col("h"), at, width).alias("v")) for j, at, width, _ in used])

    def probe(j: int, at: int, width: int, r: int) -> Column:
        masks = F.lit(_masks(width, r)).cast("array<bigint>")
        return F.transform(masks, lambda m: F.struct(F.lit(j).alias("band"), _band(F.col("h"), at, width).bitwiseXOR(m).alias("v")))

    probes = F.flatten(F.array(*[probe(*b) for b in used]))
    a = left.select(F.col("h").alias("h_a"), F.inline(probes))
    b = right.select(F.col("h").alias("h_b"), F.inline(own))
    x = a.join(b, ["band", "v"]).where(hamming("h_a", "h_b") <= d)
    xor = F.col("h_a").bitwiseXOR(F.col("h_b"))
    first = F.lit(None).cast("int")
    for j, at, width, r in reversed(used):
        first = F.when(F.bit_count(_band(xor, at, width)) <= r, j).otherwise(first)
    return x.where(F.col("band") == first).select("h_a", "h_b", hamming("h_a", "h_b").alias("dist"))


def near_dup_pairs(ph: DataFrame, d: int, limit: int | None = None) -> DataFrame:
    """Id pairs (a < b) within distance ``d``, equal hashes included.

    Without ``limit`` the result is as large as the pairs are many; reports
    should pass a limit, which keeps the closest pairs in (dist, a, b) order
    without forming the pairs of large groups of copies.
    """
    x = ph.where("h is not null")
    pairs = hash_pairs(x, d)
    if limit is not None:
        # The pairs of a report use at most the first ids of each hash.
        x = top_k(x, ["h"], [F.col("id")], limit + 1, "__r").drop("__r")
    ia, ib = x.select(F.col("id").alias("i"), F.col("h").alias("h_a")), x.select(F.col("id").alias("j"), F.col("h").alias("h_b"))
    far = pairs.join(ia, "h_a").join(ib, "h_b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "dist")
    same = ia.join(ib.withColumnRenamed("h_b", "h_a"), "h_a").where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).alias("dist"))
    out = far.unionByName(same)
    return out if limit is None else out.orderBy("dist", "a", "b").limit(limit)


def pair_count(ph: DataFrame, d: int) -> DataFrame:
    """Number of id pairs within ``d``, from group sizes only."""
    sizes = ph.where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    inner = sizes.select((F.col("n") * (F.col("n") - 1) / 2).alias("p"))
    cross = hash_pairs(sizes, d).join(sizes.withColumnsRenamed({"h": "h_a", "n": "na"}), "h_a").join(
        sizes.withColumnsRenamed({"h": "h_b", "n": "nb"}), "h_b").select((F.col("na") * F.col("nb")).cast("double").alias("p"))
    return inner.unionByName(cross).agg(F.coalesce(F.sum("p"), F.lit(0.0)).cast("bigint").alias("pairs"))


def clusters(ph: DataFrame, d: int) -> DataFrame:
    """Near-duplicate clusters of two or more assets: id, cluster (its smallest id), size.

    Components are found between distinct hashes; copies follow their hash.
    """
    x = ph.where("h is not null")
    pairs = hash_pairs(x, d)
    comp = components(pairs.select(F.col("h_a").alias("a"), F.col("h_b").alias("b")))
    rooted = x.join(comp.withColumnRenamed("node", "h"), "h", "left").select("id", F.coalesce("root", "h").alias("root"))
    rooted = stable(rooted)
    size = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("cluster")).where("size > 1")
    return rooted.join(size, "root").select("id", "cluster", "size")


def similar_to(ph: DataFrame, queries: DataFrame, d: int, k: int | None = None) -> DataFrame:
    """Stored assets within ``d`` of each query hash (qid, qh), nearest first, from
    the distinct query hashes and the distinct stored ones."""
    q = queries.select("qid", "qh").where("qh is not null")
    x = ph.where("h is not null")
    stored = stable(x.select("h").distinct())
    asked = q.select(F.col("qh").alias("h")).distinct()
    near = _tiles(asked, stored, d) if _wide(d) else _meet(asked, stored, d, _scheme(d, stored.count()))
    out = q.join(near, F.col("qh") == F.col("h_a")).join(x.select("id", "h"), F.col("h_b") == F.col("h")).select("id", "qid", "dist").where(F.col("id") != F.col("qid"))
    return out if k is None else top_k(out, ["qid"], [F.col("dist"), F.col("id")], k)
