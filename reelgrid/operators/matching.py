"""Similar-text pairs and greedy one-to-one matching, inside keys of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from reelgrid.operators.blocks import by_bytes
from reelgrid.operators.scale import stable

#: Rows of a key that a task compares with as many of the other side; lines of a key whose runs it forms.
PIECE_ROWS = 2_048
RUN_ROWS = 512
#: Bytes of text whose characters are listed at once, cells and shared characters counted at once, rows sent on at once.
LIST_BYTES = 1 << 20
CELLS = 1 << 20
OUT_ROWS = 10_000


def _characters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct characters of each text: number of the text, character, how often."""
    own = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    both, n = np.unique(own << 21 | np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64), return_counts=True)
    return both >> 21, both & (1 << 21) - 1, n


class _Listed:
    """Texts listed by their characters, to count what another text shares with each of them."""

    def __init__(self, texts: Sequence[str]) -> None:
        rows, chars, n = _characters(texts)
        order = np.argsort(chars, kind="stable")
        self.texts, self.rows, self.n = texts, rows[order], n[order]
        self.chars, self.starts = np.unique(chars[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.length = np.array([len(t) for t in texts])
        self.distinct = np.bincount(rows, minlength=len(texts))

    def similar(self, texts: Sequence[str], thr: float, first: bool = False) -> Iterator[tuple[int, int, float]]:
        """(number in ``texts``, number among the listed, sim) with sim >= thr in this order, as ``caption_sim`` has it;
        ``first``: only the first listed of each text."""
        rows, chars, n = _characters(texts)
        distinct, size = np.bincount(rows, minlength=len(texts)), len(self.texts)
        at = np.minimum(np.searchsorted(self.chars, chars), len(self.chars) - 1)
        known = self.chars[at] == chars
        rows, n, start, more = rows[known], n[known], self.starts[at[known]], (self.ends - self.starts)[at[known]]
        shared = np.cumsum(np.bincount(rows, more, minlength=len(texts)) + size)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(shared, (shared[a - 1] if a else 0) + CELLS, "right")))
            p, q = np.searchsorted(rows, (a, b))
            k = more[p:q]
            hit = np.repeat(start[p:q] - np.cumsum(k) + k, k) + np.arange(k.sum())
            cell = np.repeat((rows[p:q] - a) * size, k) + self.rows[hit]
            both = np.bincount(cell, minlength=(b - a) * size).reshape(b - a, size)
            most = np.bincount(cell, np.minimum(self.n[hit], np.repeat(n[p:q], k)), (b - a) * size).reshape(b - a, size)
            jac = both / (self.distinct + distinct[a:b, None] - both).clip(1)
            bound = 0.9 * (2.0 * most / (self.length + np.array([len(t) for t in texts[a:b]])[:, None]).clip(1))
            reach = (jac < 0.9) & (bound > np.maximum(jac, thr - 1e-9))
            for i in np.flatnonzero((reach | (jac >= thr)).any(axis=1)):
                match = SequenceMatcher(None, "", texts[a + i])
                for j in np.flatnonzero(reach[i] | (jac[i] >= thr)):
                    sim = float(jac[i, j])
                    if reach[i, j]:
                        match.set_seq1(self.texts[j])
                        sim = max(sim, 0.9 * match.ratio())
                    if sim >= thr:
                        yield a + int(i), int(j), sim
                        if first:
                            break
            a = b


def _seek(texts: Sequence[str], thr: float, first: bool = False) -> Callable[[Sequence[str]], Iterator[tuple[int, int, float]]]:
    """``_Listed.similar`` over any number of texts, of which a bounded part is listed at a time."""
    spans = list(by_bytes(pa.array(texts, pa.string()), LIST_BYTES))
    listed = lru_cache(1)(lambda k: _Listed(texts[slice(*spans[k])]))

    def run(others: Sequence[str]) -> Iterator[tuple[int, int, float]]:
        left = list(range(len(others)))
        for k, (a, _) in enumerate(spans):
            done = set()
            for i, j, sim in listed(k).similar([others[i] for i in left], thr, first):
                done.add(i)
                yield left[i], a + j, sim
            if first:
                left = [x for i, x in enumerate(left) if i not in done]
            if not left:
                break

    return run


def _compared(
    a: DataFrame, b: DataFrame, group: Sequence[str], order: Sequence[str], fields: Sequence[T.StructField],
    hold: Callable[[list[dict]], Callable[[list[dict]], Iterator[tuple]]],
) -> DataFrame:
    """The rows that ``hold(rows of a)(some rows of b)`` gives after the values of ``group``, for
    each group.  Streamed in sorted tasks: of a group, only the rows of ``a`` are held."""
    both = a.withColumn("__right", F.lit(False)).unionByName(b.withColumn("__right", F.lit(True)), True)
    schema = T.StructType([*(both.schema[k] for k in group), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, seek, out = None, [], None, []
        for batch in batches:
            rows = batch.to_pylist()
            for (own, right), some in groupby(rows, lambda r: (tuple(r[k] for k in group), r["__right"])):
                if own != current:
                    current, held, seek = own, [], None
                if not right:
                    held += some
                elif held:
                    seek = seek or hold(held)
                    for found in seek(list(some)):
                        out.append((*own, *found))
                        if len(out) == OUT_ROWS:
                            yield _batch(out, schema)
                            out = []
        yield _batch(out, schema)

    return both.repartition(*group).sortWithinPartitions(*group, "__right", *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def _piece(columns: Sequence[str], n: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), n).cast("int")


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def similar_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], thr: float, text_a: str = "text_a", text_b: str = "text_b", texts: bool = False) -> DataFrame:
    """Pairs of a row of ``a`` and one of ``b`` with equal keys and texts of sim >= thr:
    keys, the other columns of both (with the texts only if asked), sim.

    The texts of a key meet in one task, where their shared characters are counted;
    those of a key of many rows in pieces, each piece of one side with each of the
    other.  So only the texts are shuffled.  Empty texts and null keys have no pairs.
    """
    a, b = _known(a, keys), _known(b, keys)
    count = lambda x, n: x.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias(n))
    sizes = stable(count(a, "__na").join(count(b, "__nb").hint("merge"), [*keys]).where("__na > 1 or __nb > 1"))
    part = lambda x, own, other: (
        x.join(sizes.hint("merge"), [*keys], "left").withColumn(own, _piece(x.columns, F.coalesce(own, F.lit(1)))).withColumn(other, _each(F.coalesce(other, F.lit(1))))
    )
    ca, cb = [[c for c in x.columns if c not in keys and (texts or c != t)] for x, t in ((a, text_a), (b, text_b))]
    fields = [*(a.schema[c] for c in ca), *(b.schema[c] for c in cb), T.StructField("sim", T.DoubleType())]

    def hold(held: list[dict]) -> Callable[[list[dict]], Iterator[tuple]]:
        seek = _seek([r[text_a] for r in held], thr)

        def pairs(rows: list[dict]) -> Iterator[tuple]:
            for i, j, sim in seek([r[text_b] for r in rows]):
                yield (*(held[j][c] for c in ca), *(rows[i][c] for c in cb), sim)

        return pairs

    left, right = part(a.where(F.col(text_a) != ""), "__na", "__nb"), part(b.where(F.col(text_b) != ""), "__nb", "__na")
    return _compared(left, right, [*keys, "__na", "__nb"], [], fields, hold).drop("__na", "__nb")


def similar_texts(a: DataFrame, b: DataFrame, keys: Sequence[str], thr: float) -> DataFrame:
    """Pairs (keys, text_a, text_b, sim) of distinct caption keys with sim >= thr."""
    da, db = [x.select(*keys, F.col("text").alias(name)).where("text <> ''").distinct() for x, name in ((a, "text_a"), (b, "text_b"))]
    return similar_rows(da, db, keys, thr, texts=True)


def similar_runs(lines: DataFrame, texts: DataFrame, keys: Sequence[str], thr: float, most: int = 6) -> DataFrame:
    """For each row of ``texts`` (keys, id, text), the first run of at most ``most`` lines (keys,
    pos, idx, text; pos counts the lines of a key from 0) whose joined texts have sim >= thr:
    keys, id, idx of its first line, more (lines after it), covers (idx of all).

    Runs are formed where they are compared; lines and texts of long keys meet in pieces,
    and the lines at the border of a piece are also in the one before.
    """
    lines, texts = _known(lines, keys), _known(texts, keys).where("text <> ''")
    size = texts.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("__texts"))
    size = stable(size.join(lines.groupBy(*keys).agg((F.floor(F.max("pos") / RUN_ROWS) + 1).alias("__lines")), [*keys]))
    piece, early = F.floor(F.col("pos") / RUN_ROWS).cast("int"), F.col("pos") % RUN_ROWS < most - 1
    a = lines.join(size.drop("__lines"), [*keys]).withColumn("__own", piece).withColumn("__texts", _each(F.col("__texts")))
    a = a.withColumn("__lines", F.explode(F.when(early & (piece > 0), F.array(piece - 1, piece)).otherwise(F.array(piece))))
    b = texts.join(size, [*keys]).withColumn("__texts", _piece(texts.columns, F.col("__texts"))).withColumn("__lines", _each(F.col("__lines")))
    kind = lines.schema["idx"].dataType
    fields = [texts.schema["id"], T.StructField("idx", kind), T.StructField("more", T.IntegerType()), T.StructField("covers", T.ArrayType(kind))]

    def hold(held: list[dict]) -> Callable[[list[dict]], Iterator[tuple]]:
        line = [r["text"] for r in held]
        runs = [(i, n) for i, r in enumerate(held) if r["__own"] == r["__lines"] for n in range(1, min(most, len(held) - i) + 1) if any(line[i : i + n])]
        seek = _seek(["".join(line[i : i + n]) for i, n in runs], thr, True)

        def firsts(rows: list[dict]) -> Iterator[tuple]:
            for k, j, _ in seek([r["text"] for r in rows]):
                i, n = runs[j]
                covers = [r["idx"] for r in held[i : i + n]]
                yield rows[k]["id"], covers[0], n - 1, covers

        return firsts

    found = _compared(a, b, [*keys, "__lines", "__texts"], ["pos"], fields, hold)
    return found.groupBy(*keys, "id").agg(F.min(F.struct("idx", "more", "covers")).alias("f")).select(*keys, "id", "f.*")


def greedy_matching(edges: DataFrame, group: Sequence[str], left: str, right: str, order: Sequence[str]) -> DataFrame:
    """Take edges in ``order`` (total per group), each end at most once.

    Settled in streams sorted by group and order, in one job: a task holds only the
    ends taken so far in the group it reads.
    """

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lefts, rights = None, set(), set()
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()
            keep = []
            for own, a, b in zip(zip(*map(column, group)), column(left), column(right)):
                if own != current:
                    current, lefts, rights = own, set(), set()
                keep.append(a not in lefts and b not in rights)
                if keep[-1]:
                    lefts.add(a)
                    rights.add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(take, edges.schema)
