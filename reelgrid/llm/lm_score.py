"""Document scores by cross-entropy difference of two matched language models.

Target and background model share the vocabulary, the order and the smoothing;
only their counts differ: all word bigrams of all target texts, and of all texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Workspace

SMOOTH = 10.0

#: An entry of a word: 48 bits of the word before (in one column), the text in its chunk, or 32,768 more
#: for a target text, and how often (one column each).
BEFORE = np.dtype([("low", "<u4"), ("high", "<u2")])
#: A text of a chunk.
TEXT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n_tokens", "<u4")])
#: A part of the sums of a text of a chunk.
SUM = np.dtype([("row", "<u2"), ("own", "<f8"), ("raw", "<f8")])
OWN = 1 << 15
LOW_48 = np.uint64((1 << 48) - 1)
BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
HOT_SHARE = 2048
FLUSH = 1 << 21
#: Words go to their task in buckets: so many at least, more when a bucket would get over so many steps on average.
BUCKETS, BUCKET_STEPS = 4096, 1 << 17
#: Entries that are weighed at once (whole buckets, one at least).
AT_ONCE = 1 << 18


def _pairs(batch: pa.RecordBatch) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk; word, word before and text of every step, each text's end among them."""
    found = W.Words(batch.column("text"), W.letters_and_digits())
    full = np.flatnonzero(found.counts)
    last = found.ptr[1:][full]
    word = np.insert(found.hashes(), last, END)
    before = np.concatenate([[BEGIN], word[:-1]])[: len(word)].astype(np.uint64)
    before[1:][word[:-1] == END] = BEGIN
    return found, word, before, np.insert(found.rows(), last, full)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches, most=4 << 20):
        for a in range(0, batch.num_rows, OWN):
            yield batch.slice(a, OWN)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in sorted_keys], axis=0)
    return np.flatnonzero(new)


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` from each of ``cuts`` to the next."""
    offsets = np.append(cuts, len(values)).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _flat(table: pa.Table, name: str, dtype: type | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a binary column, and where each row's begin."""
    data = table.column(name).combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    values = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
    return values.view(dtype), (off - off[0]) // np.dtype(dtype).itemsize


def _add_up(rows: pa.Table) -> pa.Table:
    """The texts of one chunk and all parts of their sums in, a row per text out."""
    texts = np.frombuffer(b"".join(x.as_py() for x in rows.column("texts").drop_null()), TEXT)
    parts = np.frombuffer(b"".join(x.as_py() for x in rows.column("sums").drop_null()), SUM)
    add = lambda c: pa.array(np.bincount(parts["row"], parts[c], len(texts)).astype(float))
    return pa.table({
        "doc_id": pa.array(texts["doc_id"], mask=texts["known"] == 0), "n_tokens": pa.array(texts["n_tokens"].astype(np.int64)), "own": add("own"), "raw": add("raw"),
    })


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, target_loss, background_loss
    (nats per word, the end of the text counting as one) and score, their difference;
    the higher, the closer to the documents named by ``target`` (doc_id).

    Both models are word bigrams over the vocabulary of all documents, counted over
    all texts (background) and all texts named by ``target``:
    p(w | v) = (c(v w) + SMOOTH p(w)) / (c(v) + SMOOTH), p(w) = (c(w) + 0.1) / (N + 0.1 V).

    The bigrams of a chunk of texts travel once, a row per bucket of second words
    (of a word with more than a 2048th of all steps, to the bucket of the pair, with the
    word's counts broadcast); there they are counted, and go back to their chunk as parts of its texts' sums.

    A null or empty text has no tokens and 0 for all losses; repeated rows score
    alike; without target texts the target model is flat; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = target.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct().toPandas()["doc_id"].to_numpy(np.int64)
    named = docs.sparkSession.sparkContext.broadcast(np.sort(ids))  # eight bytes per target document

    def is_target(batch: pa.RecordBatch) -> np.ndarray:
        ids, own = named.value, batch.column("doc_id").fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
        return (ids[at] == own) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(own), bool)

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            _, h, _, row = _pairs(batch)
            word, at = np.unique(h, return_inverse=True)
            own = is_target(batch)[row]
            yield pa.record_batch(
                [pa.array(word.view(np.int64)), pa.array(np.bincount(at, minlength=len(word))), pa.array(np.bincount(at, own, len(word)).astype(np.int64))],
                names=["word", "raw", "own"],
            )

    counts = ws.keep(texts.mapInArrow(count_words, "word long, raw long, own long").groupBy("word").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")))
    all_own, all_raw, size = counts.agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(END.view(np.int64))
    many = counts.where(F.col("word") == end).select("own", "raw").first() or (0, 0)
    often = counts.where(F.col("raw") * HOT_SHARE > all_raw).toPandas()  # fewer than HOT_SHARE words
    hot = often["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    held = docs.sparkSession.sparkContext.broadcast((hot[order], often[["own", "raw"]].to_numpy(float)[order].T))
    total, begin = np.array([all_own, all_raw], float), np.log(np.array(many, float) + SMOOTH)

    def is_hot(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hot = held.value[0]
        at = np.minimum(np.searchsorted(hot, word), max(len(hot) - 1, 0))
        return at, hot[at] == word if len(hot) else np.zeros(len(word), bool)

    buckets = np.uint64(max(BUCKETS, -(-int(all_raw) // BUCKET_STEPS)))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(_pieces(batches)):
            found, word, before, row = _pairs(batch)
            row, hot = row.astype(np.uint16), is_hot(word)[1]
            before = before & LOW_48
            bucket = (W.mix(np.where(hot, word + W.mix(before), word)) % buckets).astype(np.uint32)
            order = np.lexsort((row, before, word, bucket))
            bucket, word, before, row = bucket[order], word[order], before[order], row[order]
            at = _starts(bucket, word, before, row)
            n = np.diff(np.append(at, len(word)))
            times = (n + 254) // 255
            at, n = np.repeat(at, times), np.repeat(n, times)
            first = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            bucket, word, before, row = bucket[at], word[at], before[at], row[at]
            entry = np.empty(len(at), BEFORE)
            entry["low"], entry["high"] = before, before >> np.uint64(32)
            row = row | np.where(is_target(batch), OWN, 0).astype(np.uint16)[row]
            # A word stands once for 255 of its entries in a bucket.
            own = _starts(bucket, word)
            size = np.diff(np.append(own, len(word)))
            times = (size + 254) // 255
            own, size = np.repeat(own, times), np.repeat(size, times)
            past = 255 * (np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times))
            cut = _starts(bucket)
            at_word = np.searchsorted(own, cut)
            text = np.empty(batch.num_rows, TEXT)
            text["doc_id"], text["known"], text["n_tokens"] = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False), found.counts
            none = pa.array([b""], pa.binary())
            column = lambda x, cuts, last=none: pa.concat_arrays([_binary(x, cuts), last])
            # A row for every bucket of the chunk, and one for its texts, with a negative number.
            yield pa.record_batch([
                pa.array(np.append(bucket[cut].astype(np.int64), int(W.mix(np.array([part + k], np.uint64))[0] % buckets))),
                pa.array(np.append(np.full(len(cut), part + k), -1 - part - k)),
                column(word[own], at_word, pa.array([text.tobytes()], pa.binary())), column(np.minimum(size - past, 255).astype(np.uint8), at_word),
                column(entry, cut), column(row, cut), column(np.minimum(n - 255 * first, 255).astype(np.uint8), cut),
            ], names=["key", "chunk", "words", "sizes", "before", "row", "n"])

    def weigh(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, text and both sums of every entry of whole buckets."""
        per_row = np.diff(_flat(batch, "n", np.uint8)[1])
        chunk = np.repeat(batch.column("chunk").to_numpy(), per_row)
        word = np.repeat(_flat(batch, "words", np.uint64)[0], _flat(batch, "sizes", np.uint8)[0])
        entry, row, n = _flat(batch, "before", BEFORE)[0], _flat(batch, "row", np.uint16)[0], _flat(batch, "n", np.uint8)[0].astype(float)
        before = entry["low"] | entry["high"].astype(np.uint64) << np.uint64(32)
        own = n * (row >= OWN)
        order = np.lexsort((before, word))
        at = _starts(word[order], before[order])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        _, same = np.unique(word, return_inverse=True)
        # Only some of the pairs of a hot word are here.
        spot, often = is_hot(word)
        ends = word == END
        out = []
        for i, x in enumerate((own, n)):
            c_word = np.bincount(same, x)[same]
            if often.any():
                c_word = np.where(often, held.value[1][i][spot], c_word)
            prior = (c_word + 0.1) / (total[i] + 0.1 * size)
            # The word after its word before, and the word as the one before the next.
            out.append(n * (np.where(ends, 0.0, np.log(c_word + SMOOTH)) - np.log(np.bincount(pair, x)[pair] + SMOOTH * prior)))
        return chunk, (row & (OWN - 1)).astype(np.int64), out[0], out[1]

    names = ["chunk", "sums", "texts"]

    def sums(parts: list[tuple]) -> pa.RecordBatch:
        """A row per chunk with the sums of its texts so far."""
        chunk, row, own, raw = (np.concatenate(x) for x in zip(*parts))
        which, at = np.unique(chunk, return_inverse=True)
        key, at = np.unique((at << 15) | row, return_inverse=True)
        found = np.empty(len(key), SUM)
        found["row"], found["own"], found["raw"] = key & (OWN - 1), np.bincount(at, own), np.bincount(at, raw)
        cut = np.searchsorted(key >> 15, np.arange(len(which) + 1))
        data = [found[a:b].tobytes() for a, b in zip(cut, cut[1:])]
        return pa.record_batch([pa.array(which, pa.int64()), pa.array(data, pa.binary()), pa.nulls(len(which), pa.binary())], names=names)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rest, waiting = [], [], 0
        for batch in batches:
            is_text = pc.less(batch.column("chunk"), 0)
            told = batch.filter(is_text)
            if told.num_rows:
                chunk = -1 - told.column("chunk").to_numpy()
                yield pa.record_batch([pa.array(chunk), pa.nulls(len(chunk), pa.binary()), told.column("words").cast(pa.binary())], names=names)
            batch = batch.filter(pc.invert(is_text))
            if not batch.num_rows:
                continue
            key, entries = batch.column("key").to_numpy(), pc.binary_length(batch.column("n")).to_numpy()
            cuts, ends = _starts(key), np.cumsum(entries, dtype=np.int64)
            if rest and rest[-1].column("key")[0].as_py() != key[0]:
                cuts = np.append(0, cuts)  # the bucket held back is whole
            at = 0
            for cut in cuts[1:]:
                # Whole buckets up to here; the last bucket may go on in the next batch.
                if cut == cuts[-1] or ends[cut - 1] - (ends[at - 1] if at else 0) >= AT_ONCE or not cut:
                    part = [*rest, *([batch.slice(at, cut - at)] if cut > at else [])]
                    kept.append(weigh(pa.Table.from_batches(part)))
                    waiting += len(kept[-1][0])
                    rest, at = [], int(cut)
                    if waiting >= FLUSH:
                        yield sums(kept)
                        kept, waiting = [], 0
            rest.append(batch.slice(at))
        if rest:
            kept.append(weigh(pa.Table.from_batches(rest)))
        if kept:
            yield sums(kept)

    dealt = texts.mapInArrow(deal, "key long, chunk long, words binary, sizes binary, before binary, row binary, n binary").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(gather, "chunk long, sums binary, texts binary")
    added = found.groupBy("chunk").applyInArrow(_add_up, "doc_id long, n_tokens long, own double, raw double")
    loss = lambda c, i: F.when(F.col("n_tokens") > 0, (F.col(c) + float(begin[i])) / (F.col("n_tokens") + 1)).otherwise(F.lit(0.0))
    return added.select("doc_id", "n_tokens", loss("own", 0).alias("target_loss"), loss("raw", 1).alias("background_loss")).withColumn("score", F.col("background_loss") - F.col("target_loss"))
