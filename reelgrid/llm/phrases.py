"""Collocations: frequent phrases, mined with Rabin-Karp fingerprints.

1. The texts of a language are packed in blocks of about a megabyte: words
   separated by a blank, pieces by a line feed.
2. Prefix polynomials over a block's bytes give the fingerprint of each n-gram
   as a difference of two of them.  A block passes on its distinct fingerprints
   in ascending order with their counts, cut into buckets by their first bits; an
   entry's occurrence pointer is its block and its place in that order.
3. A bucket adds the counts of equal fingerprints and answers each block with one
   bit per entry: frequent or not.
4. Blocks look only these n-grams up in their text and count them by their bytes,
   so n-grams that share a fingerprint part again; the sum over all blocks gives
   exact counts, and only frequent phrases become strings.

A fingerprint's count is never below that of an n-gram that has it, so no frequent
n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.scale import positions

from .store import Workspace
from .words import hash_slices, mix

#: Bytes of packed text after which a block is closed, and of all open blocks of a task.
BLOCK_BYTES = 1 << 20
OPEN_BYTES = 8 << 20
#: N-gram occurrences per bucket of fingerprints.
BUCKET_NGRAMS = 1 << 19
LEAST_BUCKET_BITS = 8

_BLANK, _END = 0x20, 0x0A


def _separators() -> np.ndarray:
    """A-Z to lower case, tabs to blanks, what ends a piece to line feeds."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    table[0x09] = _BLANK
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = _END
    return table


_TABLE = _separators()


def pack(raw: bytes) -> bytes:
    """Words of ``raw`` in lower case, each followed by a blank, or by a line feed
    where its piece ends."""
    data = _TABLE[np.frombuffer(raw + b"\n", np.uint8)]
    inside = (data != _BLANK) & (data != _END)
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        start = np.concatenate([[0], start])
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    breaks = np.cumsum(data == _END)
    same = np.zeros(len(end), bool)
    if len(start) > 1:
        same[:-1] = breaks[start[1:]] == breaks[end[:-1] - 1]
    data[end] = np.where(same, _BLANK, _END)
    inside[end] = True
    return data[inside].tobytes()


def _pack_blocks(block_bytes: int, open_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal n
            body = b"".join(held.pop(lang))
            size.pop(lang)
            n += 1
            words = int(np.isin(np.frombuffer(body, np.uint8), (_BLANK, _END)).sum())
            return pa.record_batch({
                "block": pa.array([(part << 32) + n], pa.int64()), "lang": pa.array([lang]), "words": pa.array([words], pa.int64()), "body": pa.array([body], pa.binary()),
            })

        for batch in batches:
            texts = batch.column(0).cast(pa.large_binary())
            codes, mine = batch.column(1).dictionary_encode(), None
            which = codes.indices.to_numpy(zero_copy_only=False)
            for code, lang in enumerate(codes.dictionary.to_pylist()):
                mine, raw, many = texts.filter(pa.array(which == code)), [], 0
                for text in mine:
                    x = text.as_py() or b""
                    raw.append(x)
                    many += len(x) + 1
                    if many >= block_bytes:
                        held.setdefault(lang, []).append(pack(b"\n".join(raw)))
                        size[lang] = size.get(lang, 0) + len(held[lang][-1])
                        raw, many = [], 0
                        if size[lang] >= block_bytes:
                            yield close(lang)
                if raw:
                    held.setdefault(lang, []).append(pack(b"\n".join(raw)))
                    size[lang] = size.get(lang, 0) + len(held[lang][-1])
                    if size[lang] >= block_bytes:
                        yield close(lang)
            while sum(size.values()) > open_bytes:
                yield close(max(size, key=size.get))
            del texts, codes, mine
            pa.default_memory_pool().release_unused()
        for lang in list(held):
            yield close(lang)

    return run


class Grams:
    """The n-grams of a block: their slices and fingerprints."""

    def __init__(self, body: bytes, lang: str, most: int):
        self.data = np.frombuffer(body, np.uint8)
        self.end = np.flatnonzero((self.data == _BLANK) | (self.data == _END))
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        stops = np.cumsum(self.data[self.end] == _END)
        salt = np.frombuffer(lang.encode().ljust(8, b"\0"), np.uint8)
        self.salt = mix(np.array([len(salt)], np.uint64) + hash_slices(salt, np.array([0]), np.array([len(salt)])))[0]
        self.first = []
        for k in range(1, most + 1):
            n = len(self.end) - k + 1
            if k == 1:
                self.first.append(np.arange(n))
            elif n > 0:
                before = np.concatenate([[0], stops[: n - 1]])
                self.first.append(np.flatnonzero(stops[k - 2 : k - 2 + n] == before))
            else:
                self.first.append(np.arange(0))

    def slices(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the n-grams of ``k`` words."""
        i = self.first[k - 1]
        return self.start[i], self.end[i + k - 1]

    def fingerprints(self, k: int, bits: int) -> np.ndarray:
        """The first ``bits`` bits of the fingerprints of the n-grams of ``k`` words."""
        return mix(hash_slices(self.data, *self.slices(k)) ^ self.salt) >> np.uint64(64 - bits)

    def texts(self, k: int, which: np.ndarray) -> pa.StringArray:
        """The chosen n-grams of ``k`` words as strings."""
        start, end = self.slices(k)
        start, end = start[which], end[which]
        size = np.concatenate([[0], np.cumsum(end - start)])
        kind = np.int32 if max(size[-1], len(self.data)) < 1 << 31 else np.int64
        at = np.repeat((start - size[:-1]).astype(kind), end - start)
        at += np.arange(size[-1], dtype=kind)
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(self.data[at].tobytes()))


def _entries(prints: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in ascending order and their counts."""
    every = np.concatenate(prints)
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.diff(first, append=len(every))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their first, second, ... bytes together."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _send(most: int, bucket_bits: int, least: int):
    """Blocks in; per bucket the ascending low 32 bits of the block's fingerprints
    as differences, and their counts (as far as ``least``) out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, body in zip(*(batch.column(i) for i in range(3))):
                grams = Grams(body.as_py(), lang.as_py(), most)
                found, count = _entries([grams.fingerprints(k, bucket_bits + 32) for k in range(1, most + 1)])
                bucket = (found >> np.uint64(32)).astype(np.int64)
                low = (found & np.uint64(0xFFFFFFFF)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                gap = np.diff(low, prepend=0)
                gap[cut] = low[cut]
                count = np.minimum(count, least).astype("<u4")
                ends = [*cut[1:], len(found)]
                yield pa.record_batch({
                    "bucket": pa.array(bucket[cut], pa.int32()), "block": pa.array([block.as_py()] * len(cut), pa.int64()),
                    "gaps": pa.array([_planes(gap[a:b]) for a, b in zip(cut, ends)], pa.binary()), "counts": pa.array([_planes(count[a:b]) for a, b in zip(cut, ends)], pa.binary()),
                })

    return run


def _answer(least: int):
    """All entries of a bucket in; which of each block's entries are frequent, as bits, out."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts, sizes = [], [], []
        for gaps, n in zip(table.column("gaps"), table.column("counts")):
            keys.append(np.cumsum(_unplanes(gaps.as_py()), dtype=np.uint32))
            counts.append(_unplanes(n.as_py()))
            sizes.append(len(keys[-1]))
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(counts))
        good = np.split(total[which] >= least, np.cumsum(sizes)[:-1])
        return pa.table({
            "block": table.column("block").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int32()), "n": pa.array(sizes, pa.int32()),
            "bits": pa.array([np.packbits(g).tobytes() for g in good], pa.binary()),
        })

    return run


def _look_up(most: int, bucket_bits: int):
    """Blocks with their answers in; the frequent n-grams' texts and counts out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, body, answers in zip(*(batch.column(i) for i in range(3))):
                grams = Grams(body.as_py(), lang.as_py(), most)
                prints = [grams.fingerprints(k, bucket_bits + 32) for k in range(1, most + 1)]
                told = sorted(answers.as_py(), key=lambda a: a["bucket"])
                good = _entries(prints)[0][np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in told]).astype(bool)]
                if not len(good):
                    continue
                for k, x in enumerate(prints, 1):
                    at = np.minimum(np.searchsorted(good, x), len(good) - 1)
                    found = pc.value_counts(grams.texts(k, good[at] == x))
                    if len(found):
                        phrase, n = found.flatten()
                        yield pa.record_batch({"lang": pa.array([lang.as_py()] * len(n)), "size": pa.array(np.full(len(n), k, np.int32)), "phrase": phrase.cast(pa.string()), "f": n})

    return run


def frequent_phrases(docs: DataFrame, most: int = 3, least: int = 10, text_column: str = "text", lang_column: str = "lang", block_bytes: int = BLOCK_BYTES, bucket_ngrams: int = BUCKET_NGRAMS, bucket_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all word sequences of 1 to ``most`` words inside a
    piece that occur at least ``least`` times in their language, and (lang, n) of
    all word occurrences.  Exact.  ``bucket_bits`` sets the number of fingerprint
    buckets, which otherwise follows the number of words."""
    ws = Workspace(docs.sparkSession)
    read = docs.select(F.col(text_column).cast("string").alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    blocks = ws.keep(read.mapInArrow(_pack_blocks(block_bytes, OPEN_BYTES), "block long, lang string, words long, body binary"))
    words = blocks.groupBy("lang").agg(F.sum("words").alias("n")).where("n > 0")
    full = blocks.where("words > 0")
    if bucket_bits is None:
        total = most * (blocks.agg(F.sum("words")).first()[0] or 0)
        bucket_bits = min(max(LEAST_BUCKET_BITS, (total // bucket_ngrams).bit_length()), 31)
    sent = full.select("block", "lang", "body").mapInArrow(_send(most, bucket_bits, least), "bucket int, block long, gaps binary, counts binary")
    answers = ws.keep(sent.groupBy("bucket").applyInArrow(_answer(least), "block long, bucket int, n int, bits binary"))
    told = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))
    found = full.join(told, "block").select("lang", "body", "answers").mapInArrow(_look_up(most, bucket_bits), "lang string, size int, phrase string, f long")
    kept = ws.keep(found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least))
    ws.drop(answers)
    return kept, words


def _parts(phrase: Column, size: Column, shortest: int) -> Column:
    """All proper contiguous parts of at least ``shortest`` words."""
    words = F.split(phrase, " ")
    lengths = F.sequence(F.lit(shortest), size - 1)
    return F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(
    docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, cover_percent: int = 50, top: int | None = 2000, text_column: str = "text", lang_column: str = "lang", **sizes,
) -> DataFrame:
    """The most cohesive phrases of each language.

    Candidates are the phrases of ``shortest`` to ``longest`` words with at least
    ``least`` occurrences inside pieces of text.  Cutting one in two gives
    floor(1000000 * a * a / (l * r)) with the counts of the phrase and its parts; the
    lowest cut counts (of equal ones the shortest first part).  A candidate inside
    a longer one that has ``cover_percent`` of its occurrences or more is dropped.

    Columns lang, rank, phrase, a, l, r, n, score: the first ``top`` per language (all
    for None) by score, then count, then phrase in byte order.  ``n`` counts all
    words of the language.

    A null lang is ``und``; null and empty texts have no words, so a language of
    such texts, or an empty table, gives no rows.  Repeated rows count each time.
    Other columns are ignored, whatever their names.  Counts and scores are exact.
    """
    ws = Workspace(docs.sparkSession)
    counts, words = frequent_phrases(docs, longest, least, text_column, lang_column, **sizes)
    known = counts.select("lang", "phrase", "f")
    many = counts.where(F.col("size") >= shortest)
    split = F.split("phrase", " ")
    cut = many.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", F.col("f").alias("a"), "cut", F.array_join(F.slice(split, 1, F.col("cut")), " ").alias("head"),
        F.array_join(F.slice(split, F.col("cut") + 1, F.col("size")), " ").alias("tail"),
    )
    both = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = both.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(({exact('a')} * {exact('a')} * 1000000) div ({exact('l')} * {exact('r')}) as bigint)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    scored = both.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")
    inner = many.where(F.col("size") > shortest).select("lang", F.explode(F.array_distinct(_parts(F.col("phrase"), F.col("size"), shortest))).alias("phrase"), "f")
    cover = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(cover, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as bigint) * longer < cast({cover_percent} as bigint) * a")
    ranked = positions(ws.keep(left.drop("longer", "size")), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], "rank")
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
