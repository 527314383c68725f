"""Lexical scores in one pass over the documents.

A block of queries (bounded by its number of tokens) is sent to the tasks, which
cut the tokens of the documents they read and score them; only scores leave a task, so no token
is ever shuffled.  More queries make more blocks, and each block one more pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions import fixed_values as fv
from reelgrid.functions.text import text_or_empty, tokens

#: (query, token) entries of a block, cells of a document by query table, tokens of
#: the documents taken at once, and (document, query) entries added at once.
BLOCK_ENTRIES = 1 << 20
CELLS = 1 << 19
TOKENS = 1 << 20
ADDED = 1 << 19
NINTH = Decimal("1e-9")


@dataclass
class QueryBlock:
    """Queries by token: those of token ``i`` are ``of[ptr[i]:ptr[i + 1]]``."""

    qids: pa.Array
    tokens: pa.Array
    ptr: np.ndarray
    of: np.ndarray
    bigrams: np.ndarray
    long_words: dict[str, list[tuple[int, str]]]


def _block(rows: pa.Table) -> QueryBlock:
    ids = rows.column("qid").combine_chunks().dictionary_encode()
    words = rows.column("token").combine_chunks().dictionary_encode()
    q, t = ids.indices.to_numpy(zero_copy_only=False), words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(t, kind="stable")
    names = words.dictionary.to_pylist()
    is_bigram = np.array([n.startswith("b:") for n in names], bool)
    long_words: dict[str, list[tuple[int, str]]] = {}
    for i, n in enumerate(names):
        if len(n) >= fv.LOOSE_MIN_LEN and not n.startswith(("b:", "c:")):
            long_words.setdefault(n[: fv.LOOSE_MIN_LEN], []).append((i, n))
    return QueryBlock(
        ids.dictionary, words.dictionary, np.searchsorted(t[order], np.arange(len(names) + 1)), q[order],
        np.bincount(q[is_bigram[t]], minlength=len(ids.dictionary)), long_words,
    )


def query_blocks(queries: DataFrame, entries: int = BLOCK_ENTRIES) -> Iterator[QueryBlock]:
    """The queries (qid, query) in blocks of about ``entries`` tokens."""
    rows = queries.where("qid is not null").select("qid", F.explode(tokens("query")).alias("token")).distinct()
    n = -(-rows.count() // entries)
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).toArrow()
        if part.num_rows:
            yield _block(part)


def _spread(ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list ``which`` of a pointer table: positions of all its entries, and
    the place in ``which`` each belongs to."""
    size = ptr[which + 1] - ptr[which]
    owner = np.repeat(np.arange(len(which)), size)
    first = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(first - ptr[which], size), owner


def _pieces(sizes: np.ndarray, first: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions, counted from ``first``, of at most ``most`` in size or one position."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield first + at, first + to
        at = to


#: Which bytes of UTF-8 are letters or digits of a word.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = True


def _ascii(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat.tobytes()))


def _found(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The tokens of lower-cased texts, with repeats, and the row of each, in no order: see ``functions.text.tokens``."""
    texts = column.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    off = off - off[0]
    word = _WORD[data]
    begin, last = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges], last[edges - 1] = word[edges], word[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    rows, parts = [np.searchsorted(off, start, "right") - 1], [_ascii(data[word], np.cumsum(end - start))]
    lead = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    lead = lead[(data[lead] > 0xE4) | (data[lead + 1] >= 0xB8)]  # U+4E00 to U+9FFF
    if len(lead):
        row = np.searchsorted(off, lead, "right") - 1
        chars = np.stack([np.full(len(lead), 0x63), np.full(len(lead), 0x3A), data[lead], data[lead + 1], data[lead + 2]], 1).astype(np.uint8)
        pair = np.flatnonzero(row[1:] == row[:-1])
        pairs = np.hstack([chars[pair], chars[pair + 1, 2:]])
        pairs[:, 0] = 0x62
        for own, cells in ((row, chars), (row[pair], pairs)):
            rows.append(own)
            parts.append(_ascii(cells, np.arange(1, len(cells) + 1) * cells.shape[1]))
    return np.concatenate(rows), pa.concat_arrays(parts).cast(pa.string())


class _Cells:
    """The tokens of one column of a batch (lower-cased texts, or lists of their tokens):
    (row, query token) pairs of equal words and, once per row and query word, of words that
    hold a long query word."""

    def __init__(self, column: pa.Array, block: QueryBlock, loose: bool):
        if pa.types.is_list(column.type):
            parent, words = pc.list_parent_indices(column).to_numpy(zero_copy_only=False), pc.list_flatten(column)
        else:
            parent, words = _found(column)
        words = words.dictionary_encode()
        code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        same = pc.index_in(names, value_set=block.tokens).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = same[code] >= 0
        pair = np.unique(parent[hit].astype(np.int64) * len(block.tokens) + same[code[hit]])
        self.row, self.token = pair // len(block.tokens), pair % len(block.tokens)
        self.loose_row = self.loose_token = np.empty(0, np.int64)
        if loose and block.long_words:
            sizes, held = np.zeros(len(names) + 1, np.int64), []
            least = fv.LOOSE_MIN_LEN
            for i, n in enumerate(names.to_pylist()):
                if len(n) > least and not n.startswith(("b:", "c:")):
                    found = {t for at in range(len(n) - least + 1) for t, q in block.long_words.get(n[at : at + least], ()) if n.startswith(q, at) and n != q}
                    sizes[i + 1] = len(found)
                    held += found
            at, owner = _spread(np.cumsum(sizes), code)
            pair = np.unique(parent[owner] * len(block.tokens) + np.array(held, np.int64)[at])
            self.loose_row, self.loose_token = pair // len(block.tokens), pair % len(block.tokens)

    def sums(self, block: QueryBlock, low: int, high: int, weight: np.ndarray | None, loose: bool = False) -> np.ndarray:
        """Rows ``low`` to ``high`` by queries: the added weights (or counts) of their pairs."""
        row, token = (self.loose_row, self.loose_token) if loose else (self.row, self.token)
        a, b = np.searchsorted(row, (low, high))
        n = len(block.qids)
        if a == b:
            return np.zeros((high - low) * n)
        total = np.zeros((high - low) * n)
        for a, b in _pieces(np.diff(block.ptr)[token[a:b]], a, ADDED):
            at, owner = _spread(block.ptr, token[a:b])
            # Added one by one, in the order of the tokens: the sum does not depend on the pieces.
            np.add.at(total, (row[a:b][owner] - low) * n + block.of[at], 1.0 if weight is None else weight[token[a:b]][owner])
        return total


def _by_tokens(batch: pa.RecordBatch, first: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``TOKENS`` tokens; a long text is a part of its own."""
    # A token of a text takes two bytes or more.
    size = lambda c: pc.list_value_length(c) if pa.types.is_list(c.type) else pc.divide(pc.binary_length(c), 2)
    sizes = sum(size(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[first:])
    for a, b in _pieces(sizes, 0, TOKENS):
        yield batch.slice(a, b - a)


def _totals(block: QueryBlock, batch: pa.RecordBatch, first: int, columns: list[float], channel: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of rows of a batch with their scores (rows by queries, flat); token lists start at column ``first``."""
    names = block.tokens.to_pylist()
    bigram = np.array([n.startswith("b:") for n in names], float)
    single = np.array([n.startswith("c:") for n in names], bool)
    weight = np.where(single, 0.0, 1.0) if channel else np.where(bigram > 0, 0.5, np.where(single, 0.1, 1.0))
    step = max(1, CELLS // max(1, len(block.qids)))
    cells = [_Cells(c, block, not channel) for c in batch.columns[first:]]
    for low in range(0, batch.num_rows, step):
        high = min(batch.num_rows, low + step)
        total = np.zeros((high - low) * len(block.qids))
        for c, factor in zip(cells, columns):
            own = c.sums(block, low, high, weight)
            if channel:
                gated = np.tile(block.bigrams >= 2, high - low) & (c.sums(block, low, high, bigram) < 2)
                own[gated] = 0.0
            else:
                own = np.where(own > 0, own, fv.LOOSE_FACTOR * c.sums(block, low, high, None, loose=True))
            total += factor * own
        yield low, high, total


def _scores(send, columns: list[float], channel: bool):
    """Rows (id, token lists) in; (qid, id, score) of all positive scores out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = send.value
        for batch in (part for whole in batches for part in _by_tokens(whole, 1)):
            for low, _, total in _totals(block, batch, 1, columns, channel):
                at = np.flatnonzero(total > 0)
                if len(at):
                    yield pa.record_batch({
                        "qid": block.qids.take(pa.array(at % len(block.qids))), "id": batch.column(0).take(pa.array(low + at // len(block.qids))), "score": pa.array(total[at]),
                    })

    return run


def _added(send, columns: list[float], factor: float):
    """Rows (id, texts of the fields, text of a channel) sorted by id in; (qid, id, score) of all
    positive scores out, those of an id's rows added.  Only the id read last is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = send.value
        n = len(block.qids)

        def positive(ids: pa.Array, total: np.ndarray) -> Iterator[pa.RecordBatch]:
            row, q = np.nonzero(total > 0)
            if len(row):
                yield pa.record_batch({"qid": block.qids.take(pa.array(q)), "id": ids.take(pa.array(row)), "score": pa.array(total[row, q])})

        held, sums = None, np.zeros((1, n))
        for batch in (part for whole in batches for part in _by_tokens(whole, 1)):
            last = batch.num_columns - 1
            own, other = _totals(block, batch.select(range(last)), 1, columns, False), _totals(block, batch.select([0, last]), 1, [factor], True)
            for (low, high, total), (_, _, more) in zip(own, other):
                ids = batch.column(0).slice(low, high - low)
                code = ids.dictionary_encode().indices.fill_null(-1).to_numpy()
                first = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
                total = np.add.reduceat((total + more).reshape(-1, n), first)
                ids = ids.take(pa.array(first))
                if held is not None and held[0].as_py() == ids[0].as_py():
                    total[0] += sums[0]
                elif held is not None:
                    yield from positive(held, sums)
                yield from positive(ids.slice(0, len(ids) - 1), total[:-1])
                held, sums = ids.slice(len(ids) - 1), total[-1:].copy()
        if held is not None:
            yield from positive(held, sums)

    return run


#: Candidates (a row and a query) that a task gathers before it drops all but the best.
HELD = 1 << 19


def _best(send, columns: list[float], k: int, first: int):
    """Rows (id, boost, ties, token lists) in; out, per task, every row that is among the first
    ``k`` ids of a query by boost, score rounded to 9 digits (all descending), ties (descending)
    and id.  An id counts with its best row."""

    def keep(held: pa.Table, least: np.ndarray) -> pa.Table:
        exact, back = np.unique(held.column("score").to_numpy(), return_inverse=True)
        # Spark rounds decimal digits half up.
        rounded = np.array([float(Decimal(repr(x)).quantize(NINTH, ROUND_HALF_UP)) for x in exact.tolist()])[back]
        held = held.append_column("__r", pa.array(rounded))
        down = [(c, "descending") for c in ("boost", "__r", *[c for c in held.column_names if c.startswith("tie")])]
        held = held.sort_by([("q", "ascending"), *down, ("id", "ascending")])
        q, ids = held.column("q").to_numpy(), held.column("id").combine_chunks().dictionary_encode()
        pair = q * len(ids.dictionary) + ids.indices.to_numpy(zero_copy_only=False)
        once = np.sort(np.unique(pair, return_index=True)[1])
        held, q = held.take(pa.array(once)), q[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == k - 1
        least[:, q[last]] = [held.column(c).to_numpy()[last] for c in ("boost", "__r")]
        return held.filter(pa.array(place < k)).drop_columns(["__r"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: QueryBlock = send.value
        n = len(block.qids)
        # Boost and rounded score that the k-th id of a query has so far.
        least = np.array([np.full(n, -np.inf), np.zeros(n)])
        held, new = None, []
        for batch in (part for whole in batches for part in _by_tokens(whole, first)):
            boost = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, total in _totals(block, batch, first, columns, False):
                score, own = total.reshape(-1, n), boost[low:high, None]
                row, q = np.nonzero((score > 0) & ((own > least[0]) | ((own == least[0]) & (score >= least[1] - 1e-8))))
                if len(row):
                    rows = pa.Table.from_batches([batch.select(range(first)).take(pa.array(low + row))])
                    new.append(rows.append_column("q", pa.array(q)).append_column("score", pa.array(score[row, q])))
                if sum(t.num_rows for t in new) > HELD:
                    held, new = keep(pa.concat_tables([*([held] if held else []), *new]).combine_chunks(), least), []
        if new:
            held = keep(pa.concat_tables([*([held] if held else []), *new]).combine_chunks(), least)
        if held:
            at = held.column("q").combine_chunks()
            names = ["id", "boost", *[c for c in held.column_names if c.startswith("tie")], "score"]
            yield from pa.table({"qid": block.qids.take(at)} | {c: held.column(c) for c in names}).combine_chunks().to_batches()

    return run


def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes from fewer files than there are cores; tables of
    many files are read where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def _lowered(c: str | Column) -> Column:
    """The text as its tokens are cut from it, inside the tasks."""
    return F.lower(text_or_empty(c))


def _together(docs: DataFrame, scans: list[DataFrame], schema: T.StructType) -> DataFrame:
    # An empty table is only made if there is no scan: it is read by Python workers of its own.
    return reduce(DataFrame.unionByName, scans) if scans else docs.sparkSession.createDataFrame([], schema)


def scan_scores(queries: DataFrame, docs: DataFrame, fields: dict[str, Column], weights: dict[str, float], default: float, sidecars: DataFrame | None, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(qid, id, score) with score > 0; ids are unique in ``docs``, (id, channel) in ``sidecars``."""
    spark = docs.sparkSession
    schema = T.StructType([queries.schema["qid"], docs.schema["id"], T.StructField("score", T.DoubleType())])
    cells = [f"f{i}" for i in range(len(fields))]
    docs = docs.select("id", *[_lowered(c).alias(name) for name, c in zip(cells, fields.values())])
    factors = [weights.get(f, default) for f in fields]
    if sidecars is None:
        rows = spread_out(docs)
    else:
        # The rows of an id meet in one stream as texts, which are fewer than their scores.
        side = sidecars.select("id", _lowered("text").alias("side"))
        parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = docs.unionByName(side, allowMissingColumns=True).select("id", *cells, "side").repartition(parts, "id").sortWithinPartitions("id")
    sent = (spark.sparkContext.broadcast(block) for block in query_blocks(queries, entries))
    return _together(docs, [rows.mapInArrow(_scores(send, factors, False) if sidecars is None else _added(send, factors, default), schema) for send in sent], schema)


def scan_best(queries: DataFrame, docs: DataFrame, fields: dict[str, Column], weights: dict[str, float], default: float, k: int, ties: list[Column] = [], boost: Column | None = None, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(qid, id, boost, tie0 .., score), among them the first ``k`` ids of every query with a score > 0.

    Ids are ordered by boost, score rounded to 9 digits and ties (whole numbers without
    nulls; all descending), then by id; an id counts with its best row.  A task passes on
    no more than ``k`` ids of a query, so what follows grows with the tasks, not with the
    scores.  The caller ranks them.
    """
    spark = docs.sparkSession
    head = [F.col("id"), (F.lit(0) if boost is None else boost).cast("double").alias("boost"), *[c.cast("long").alias(f"tie{i}") for i, c in enumerate(ties)]]
    docs = spread_out(docs.where("id is not null").select(*head, *[c.alias(f"f{i}") for i, c in enumerate(fields.values())]))
    names = docs.columns[: len(head)]
    rows = docs.select(*names, *[_lowered(f"f{i}").alias(f"t{i}") for i in range(len(fields))])
    schema = T.StructType([queries.schema["qid"], *[docs.schema[c] for c in names], T.StructField("score", T.DoubleType())])
    sent = (spark.sparkContext.broadcast(block) for block in query_blocks(queries, entries))
    return _together(docs, [rows.mapInArrow(_best(send, [weights.get(f, default) for f in fields], k, len(head)), schema) for send in sent], schema)
