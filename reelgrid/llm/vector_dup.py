"""Near-duplicate vectors by product quantisation.

Distinct vectors are put into coarse inverted lists with the codes of their
residuals in subspaces and the error of that coding.  A vector probes every list
that can hold one at the wanted cosine: with unit vectors, ``d`` the distance of
that cosine, ``c`` its own and ``c'`` another centroid, a neighbour in ``c'`` needs
``|q - c'|^2 - |q - c|^2 <= 2 d |c - c'|``.  In a probed list, table lookups give
the distance to each coded vector up to its coding error; what may be near
enough is compared by exact cosine in double precision.  Both tests only use
bounds, so no link is lost.

Copies of one vector are one node with a count.  Lists are cut into pieces, and
pairs of pieces are separate groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, smallest_reached
from .near_dup import _groups
from .samples import thin
from .store import Workspace

SAMPLE = 20_000
LISTS = 64
SUBSPACES = 8
CODES = 256
PIECE = 1024
_SLACK = 1e-4  # float32 distances


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` centroids of the rows of ``x``."""
    rng = np.random.default_rng(3)
    center = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, center)
        n = np.bincount(near, minlength=len(center))
        total = np.stack([np.bincount(near, x[:, j], len(center)) for j in range(x.shape[1])], 1)
        center[n > 0] = (total[n > 0] / n[n > 0, None]).astype(x.dtype)
    return center


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 4096], y).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantiser:
    center: np.ndarray
    parts: list[np.ndarray]  # the components of each subspace
    book: list[np.ndarray]

    @staticmethod
    def train(x: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        center = k_means(x, max(1, min(lists, len(x) // 8)))
        rest = x - center[_nearest(x, center)]
        parts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        return Quantiser(center, parts, [k_means(rest[:, p], min(codes, len(x))) for p in parts])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of unit vectors."""
        at = _nearest(x, self.center)
        rest = x - self.center[at]
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.book)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.book)], 1)
        return at, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
        """Which lists may hold a unit vector within ``reach``."""
        far = _distances(x, self.center)
        gap = np.sqrt(_distances(self.center, self.center))[at]
        return far - far[np.arange(len(x)), at][:, None] <= 2 * reach * gap + _SLACK

    def table_distances(self, q: np.ndarray, list_no: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to the coded vectors of one list, by lookup."""
        rest = q - self.center[list_no]
        total = np.zeros((len(q), len(codes)), np.float32)
        for i, (p, b) in enumerate(zip(self.parts, self.book)):
            total += _distances(rest[:, p], b)[:, codes[:, i]]
        return np.sqrt(total)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, sample: int = SAMPLE, lists: int = LISTS, piece: int = PIECE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept.

    Rows with equal labels and cosine >= ``cosine`` are linked.  Vectors that are
    null, empty, zero or hold a null or non-finite component, and rows without
    label, link with nothing; so do vectors of different lengths.  component_id is
    the smallest vec_id reachable; a row without vec_id that links with nothing has
    none and is kept.  Repeated rows are rows of their own that link with each
    other.  Other columns are ignored; no rows in give no rows out.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark)
    good = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", "label", "embedding", F.when(good, F.xxhash64("label", "embedding")).alias("node"))
    named = rows.select("vec_id", "node")
    nodes = ws.keep(
        rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("v"))
        .withColumn("dim", F.size("v"))
    )
    taught: dict[int, Quantiser] = {}
    learn = thin(nodes, "node", sample, seed=6).select("dim", "v", "node").toPandas().sort_values("node")
    for dim, part in learn.groupby("dim"):
        taught[int(dim)] = Quantiser.train(_unit(np.stack(part["v"].to_numpy()).astype(np.float64)), lists)
    held = spark.sparkContext.broadcast(taught)
    reach = float(np.sqrt(max(2 - 2 * cosine, 0))) + _SLACK

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in whole.column("dim").unique().to_pylist():
                batch = whole.filter(pa.array(whole.column("dim").to_numpy() == dim))
                x = _unit(_matrix(batch.column("v"), dim))
                q = held.value.get(dim)
                if q is None:  # a length the sample missed: one list, everything is compared
                    at, codes, err, probe = np.zeros(len(x), int), np.zeros((len(x), 1), np.uint8), np.full(len(x), np.inf), np.ones((len(x), 1), bool)
                else:
                    at, codes, err = q.code(x)
                    probe = q.probes(x, at, reach)
                which = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(probe.sum(1))]).astype(np.int32)), pa.array(np.nonzero(probe)[1].astype(np.int32)))
                yield pa.record_batch(
                    [*(batch.column(c) for c in ("node", "label", "dim", "copies", "v")), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err.astype(float)), which],
                    names=["node", "label", "dim", "copies", "v", "list", "codes", "err", "probes"],
                )

    kinds = dict(nodes.dtypes)
    placed = ws.keep(nodes.select("node", "label", "dim", "copies", "v").mapInArrow(place, f"node long, label {kinds['label']}, dim int, copies long, v {kinds['v']}, list int, codes binary, err double, probes array<int>"))
    key = ["label", "dim", "list"]
    base = placed.drop("probes")
    ask = placed.select("node", "label", "dim", "copies", "v", F.explode("probes").alias("list"))
    size = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(name))
    pieces = ws.keep(size(base, "n_base").join(size(ask, "n_ask"), key))
    turn = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = base.join(pieces, key).withColumn("b", turn("n_base", 1)).withColumn("a", upto("n_ask")).withColumn("kind", F.lit(0))
    ask = ask.join(pieces, key).withColumn("a", turn("n_ask", 2)).withColumn("b", upto("n_base")).withColumn("kind", F.lit(1)).withColumn("codes", F.lit(None).cast("binary")).withColumn("err", F.lit(None).cast("double"))
    columns = ["group", "kind", "dim", "list", "node", "copies", "v", "codes", "err"]
    groups = (
        base.withColumn("group", F.xxhash64(*key, "a", "b")).select(*columns).unionByName(ask.withColumn("group", F.xxhash64(*key, "a", "b")).select(*columns))
        .repartition("group").sortWithinPartitions("group", "kind", "node")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["group"]):
            is_ask = group.column("kind").to_numpy() == 1
            if is_ask.all() or not is_ask.any():
                continue
            b, a = group.filter(pa.array(~is_ask)), group.filter(pa.array(is_ask))
            dim, list_no = a.column("dim")[0].as_py(), a.column("list")[0].as_py()
            x, y = _matrix(a.column("v"), dim), _matrix(b.column("v"), dim)
            node_a, node_b = a.column("node").to_numpy(), b.column("node").to_numpy()
            q = held.value.get(dim)
            if q is None:
                maybe = np.ones((len(x), len(y)), bool)
            else:
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
                maybe = q.table_distances(_unit(x), list_no, codes) <= reach + b.column("err").to_numpy() + _SLACK
            i, j = np.nonzero(maybe & (node_a[:, None] != node_b[None, :]))
            nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[i[s : s + 8192]], y[j[s : s + 8192]]) / (nx[i[s : s + 8192]] * ny[j[s : s + 8192]]) >= cosine for s in range(0, len(i), 8192))])
            i, j = i[near], j[near]
            if not len(i):
                continue
            links = np.bincount(i, b.column("copies").to_numpy()[j], len(x)).astype(np.int64)
            first = smallest_reached(i, j, len(x), len(y))
            who, what = np.unique(i), np.unique(j)
            head = node_a[first[0][who]], node_a[first[1][what]]
            yield pa.record_batch(
                [pa.array(np.concatenate([node_a[who], node_b[what]])), pa.array(np.concatenate([head[0], head[1]])), pa.array(np.concatenate([links[who], np.zeros(len(what), np.int64)]))],
                names=["a", "b", "links"],
            )

    found = ws.keep(groups.mapInArrow(compare, "a long, b long, links long"))
    root = components(ws, found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    each = nodes.select("node", "first_id", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = each.groupBy("root").agg(F.min("first_id").alias("component_id"))
    each = ws.keep(each.join(smallest, "root").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = named.join(each, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("vec_id").isNull() & F.col("component_id").isNull()).alias("kept"))
