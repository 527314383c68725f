"""Benchmark decontamination with a positional inverted index of the training text.

The index is built in blocks, each a run of whole documents: one row per term
of a block with the ascending positions of its occurrences (delta coded), and
one directory row with the documents of the block.  A test window is looked up
in the blocks that hold its rarest term: that term's positions, less its offset
in the window, are the candidates, and the offset-adjusted lists of the other
terms are intersected with them from rare to frequent until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .near_dup import _groups
from .store import Workspace

BLOCK_BYTES = 1 << 23
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("at", pa.binary()), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def encode(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (7 bits each, the high bit says that more follow) of
    the steps between ascending positions; ``first`` marks where lists begin.
    Returns the bytes and the end of each value in them."""
    step = values.astype(np.int64)
    step[1:] -= np.where(first[1:], 0, values[:-1])
    size = np.ones(len(step), np.int64)
    bits = 7
    while len(step) and int(step.max()) >> bits:
        size += step >= (1 << bits)
        bits += 7
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    begin = end - size
    for i in range(int(size.max()) if len(size) else 0):
        own = size > i
        out[begin[own] + i] = ((step[own] >> (7 * i)) & 0x7F) | np.where(size[own] > i + 1, 0x80, 0)
    return out, end


def decode(raw: bytes) -> np.ndarray:
    """The positions of one encoded list."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = np.flatnonzero(x < 0x80)
    begin = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(x)) - np.repeat(begin, last - begin + 1)
    return np.cumsum(np.add.reduceat((x & 0x7F) << (7 * place), begin)) if len(x) else x


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, term, n, at for every term of a block; ids, starts (and a null
    term) for its documents, all of them, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in W.chunks(batches, most=block_bytes):
            found = W.Words(batch.column("text"), W.letters_and_digits())
            yield _rows(block, None, None, None, [batch.column("doc_id").cast(pa.int64()).to_pylist()], [found.ptr.tolist()])
            if len(found.start):
                coded = found.packed().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                at = np.argsort(code, kind="stable")
                sorted_code = code[at]
                first = np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])
                raw, end = encode(at, first)
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(at)))
                offsets = np.concatenate([[0], end[begin + size - 1]]).astype(np.int32)
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                terms = coded.dictionary.cast(pa.large_string()).cast(pa.string())
                for i in range(0, len(begin), 20_000):
                    yield _rows(block, terms.slice(i, 20_000), pa.array(size[i : i + 20_000]), lists.slice(i, 20_000), None, None)
            block += 1

    return docs.select("doc_id", "text").mapInArrow(run, "block long, term string, n long, at binary, ids array<long>, starts array<long>")


def _rows(block, terms, n, at, ids, starts) -> pa.RecordBatch:
    size = len(terms) if terms is not None else 1
    column = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind) if isinstance(x, list) else x
    return pa.record_batch([pa.array(np.full(size, block)), *(column(x, f.type) for x, f in zip((terms, n, at, ids, starts), list(_INDEX)[1:]))], schema=_INDEX)


def windows(items: DataFrame, length: int) -> DataFrame:
    """item_id, win, terms: all runs of ``length`` words of each item; an item of
    fewer words is one window, one without words none."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = items.select("item_id", F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1)).alias("w")).where(F.size("w") > 0)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1))), lambda i: F.slice("w", i, length))
    return w.select("item_id", F.posexplode(spans).alias("win", "terms"))


def _within(cand: np.ndarray, at: np.ndarray, slop: int) -> np.ndarray:
    """Which candidates have a position at most ``slop`` away."""
    i = np.searchsorted(at, cand - slop)
    return (i < len(at)) & (at[np.minimum(i, len(at) - 1)] <= cand + slop)


def contamination(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256,
    contaminated, n_near.

    A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z in lower case.  A document
    word is hit when it lies in an occurrence of a window of ``length`` consecutive
    words of an item (``items``: item_id, text); n_items counts the items that occur.
    n_near counts the documents' words inside proximity matches: every term of a
    window at most ``slop`` words off its place.

    A null or empty text has no words and no hits; items without words are ignored;
    an item without item_id hits, but is not counted or listed; repeated rows and
    repeated item ids are allowed.  Without items every document is clean; without
    documents the result is empty.  Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    index = ws.keep(build_index(docs, block_bytes))
    wins = ws.keep(windows(items, length))
    vocabulary = ws.keep(wins.select(F.explode("terms").alias("term")).distinct())
    used = index.where("term is not null").join(vocabulary, "term", "left_semi")
    common = used.groupBy("term").agg(F.sum("n").alias("df"))
    ranked = (
        wins.select("item_id", F.xxhash64("item_id", "win", "terms").alias("w"), F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
        .join(common, "term")
        .groupBy("item_id", "w", "size")
        .agg(F.array_sort(F.collect_set(F.struct("df", "off", "term"))).alias("terms"))
        .where(F.size("terms") == F.col("size"))  # a window with a term that no document has occurs nowhere
    )
    places = index.where("term is not null").select("block", "term")
    sought = ranked.withColumn("term", F.col("terms")[0]["term"]).join(places, "term").select("block", "item_id", "size", F.col("terms.off").alias("offs"), F.col("terms.term").alias("words"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    every = (
        index.where("term is null").select("block", F.lit(0).alias("kind"), none("term", "string"), none("at", "binary"), "ids", "starts", none("item_id", "long"), none("offs", "array<int>"), none("words", "array<string>"))
        .unionByName(used.select("block", F.lit(1).alias("kind"), "term", "at", none("ids", "array<long>"), none("starts", "array<long>"), none("item_id", "long"), none("offs", "array<int>"), none("words", "array<string>")))
        .unionByName(sought.select("block", F.lit(2).alias("kind"), none("term", "string"), none("at", "binary"), none("ids", "array<long>"), none("starts", "array<long>"), F.col("item_id").cast("long").alias("item_id"), "offs", "words"))
        .repartition("block").sortWithinPartitions("block", "kind")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["block"]):
            kind = group.column("kind").to_numpy()
            ids, starts = group.column("ids")[0].as_py(), np.array(group.column("starts")[0].as_py())
            raw = dict(zip(group.column("term").filter(pa.array(kind == 1)).to_pylist(), group.column("at").filter(pa.array(kind == 1)).to_pylist()))
            lists: dict[str, np.ndarray] = {}

            def positions(term: str) -> np.ndarray:
                if term not in lists:
                    lists[term] = decode(raw[term])
                return lists[term]

            # Differences: +1 where a match begins, -1 behind its end.
            exact, near = np.zeros(starts[-1] + 1, np.int64), np.zeros(starts[-1] + 1, np.int64)
            items_of: dict[int, set] = {}
            win = group.filter(pa.array(kind == 2))
            for item, offs, terms in zip(win.column("item_id").to_pylist(), win.column("offs").to_pylist(), win.column("words").to_pylist()):
                if any(t not in raw for t in terms):
                    continue
                size = len(terms)
                begin = positions(terms[0]) - offs[0]
                begin = begin[(begin >= 0) & (begin + size <= starts[-1])]
                row = np.searchsorted(starts, begin, "right") - 1
                begin = begin[begin + size <= starts[row + 1]]
                hit = begin
                for off, term in zip(offs[1:], terms[1:]):
                    begin = begin[_within(begin + off, positions(term), slop)] if slop else begin
                    hit = hit[_within(hit + off, positions(term), 0)]
                    if not len(begin) or not slop and not len(hit):
                        break
                for diff, at in ((exact, hit), (near, begin if slop else hit)):
                    if len(at):
                        np.add.at(diff, at, 1)
                        np.add.at(diff, at + size, -1)
                if item is not None:
                    for r in np.unique(np.searchsorted(starts, hit, "right") - 1).tolist():
                        items_of.setdefault(r, set()).add(item)
            covered = [np.concatenate([[0], np.cumsum(np.cumsum(d)[:-1] > 0)]) for d in (exact, near)]
            n_hit, n_near = (np.diff(c[starts]) for c in covered)
            found = [sorted(map(str, items_of.get(r, ()))) for r in range(len(ids))]
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]), pa.array(n_hit > 0), pa.array(n_near, pa.int64()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"],
            )

    return every.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long")
