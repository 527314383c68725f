"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the distinct
hashed terms of a text (words and their beginnings): a term counts by its own
weight and by its interaction with every other term present.  The model has a fixed size and is fitted on a
bounded sample of labelled rows; scoring is one pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .samples import fold, thin

BITS = 18
FACTORS = 8
TRAINING_ROWS = 15_000


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # per cell
    factor: np.ndarray  # per cell and factor

    def raw(self, cells: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Log odds of texts; text r has the distinct cells ``ptr[r]:ptr[r + 1]``."""
        row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        add = lambda x: np.bincount(row, x, len(ptr) - 1)
        out = self.bias + add(self.weight[cells])
        for f in range(self.factor.shape[1]):
            v = self.factor[cells, f]
            out += 0.5 * (add(v) ** 2 - add(v * v))
        return out


def cells(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct term cells of each text, and where each text's begin.  Terms are
    words and, for word forms never seen, beginnings of four and five bytes."""
    found = W.Words(texts, W.letters_and_digits())
    row, length = found.rows().astype(np.int64), found.end - found.start
    terms = [(row, found.hashes())]
    for n in (4, 5):
        long = length > n
        start = found.start[long]
        terms.append((row[long], W.mix(W.hash_slices(found.data, start, start + n) + np.uint64(n))))
    key = np.unique(np.concatenate([(r << bits) | (h >> np.uint64(64 - bits)).astype(np.int64) for r, h in terms]))
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(texts) + 1))


def telling(seen: np.ndarray, seen_toxic: np.ndarray, rows: int, toxic: int, least: float = 3.5) -> np.ndarray:
    """Cells whose presence differs between the classes by ``least`` standard errors."""
    share = toxic / max(rows, 1)
    spread = np.sqrt(np.maximum(seen * (1 - seen / max(rows, 1)) * share * (1 - share), 1e-9))
    return (seen >= 3) & (np.abs(seen_toxic - seen * share) >= least * spread)


def train(rows: list[np.ndarray], label: np.ndarray, bits: int, factors: int, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4) -> Machine:
    """Adaptive gradient steps on the logistic loss.  Cells that don't tell the
    classes apart stay at zero, like cells never seen: the many chance words of a
    long text must not add up."""
    rng = np.random.default_rng(7)
    size = 1 << bits
    share = min(max(float(label.mean()) if len(label) else 0.0, 1e-3), 1 - 1e-3)
    count = lambda part: np.bincount(np.concatenate(part), minlength=size).astype(float) if part else np.zeros(size)
    seen, seen_toxic = count(rows), count([r for r, y in zip(rows, label) if y])
    live = telling(seen, seen_toxic, len(rows), int(label.sum()))
    weight, factor = np.zeros(size), np.where(live[:, None], rng.normal(0, 0.05, (size, factors)), 0.0)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(label)) < 2:
        return Machine(bias, weight, np.zeros((size, factors)))
    g_bias, g_weight, g_factor = 1e-8, np.full(size, 1e-8), np.full((size, factors), 1e-8)
    rows = [r[live[r]] for r in rows]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 128):
            part = [rows[j] for j in order[i : i + 128]]
            ptr = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            at = np.concatenate(part)
            row = np.repeat(np.arange(len(part)), np.diff(ptr))
            v = factor[at]
            sums = np.stack([np.bincount(row, v[:, f], len(part)) for f in range(factors)], 1)
            out = bias + np.bincount(row, weight[at], len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(row, (v * v).sum(1), len(part)))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label[order[i : i + 128]]) / len(part)
            own, back = np.unique(at, return_inverse=True)
            d_w = np.bincount(back, err[row]) + decay * weight[own]
            d_v = err[row][:, None] * (sums[row] - v)
            d_v = np.stack([np.bincount(back, d_v[:, f]) for f in range(factors)], 1) + decay * factor[own]
            g_weight[own] += d_w**2
            g_factor[own] += d_v**2
            weight[own] -= rate * d_w / np.sqrt(g_weight[own])
            factor[own] -= rate * d_v / np.sqrt(g_factor[own])
            d_b = float(err.sum())
            g_bias += d_b**2
            bias -= rate * d_b / g_bias**0.5
    return Machine(bias, weight, factor)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, bits: int = BITS, factors: int = FACTORS) -> Machine:
    """Fit on about ``rows`` labelled documents outside the held-out third.

    The bound is a parameter; labels that are null or belong to no document are
    ignored, and with fewer than two classes the machine scores the base rate.
    Two passes: presence counts of all cells (a table of fixed size), then the
    telling cells of each document, which are few.
    """
    usable = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1)).select("doc_id", "toxic")
    sample = F.broadcast(thin(usable, "doc_id", rows, seed=9))  # at most about ``rows`` pairs of numbers

    chosen = docs.select("doc_id", "text").join(sample, "doc_id")
    every = 1 << bits  # the row after the last cell counts documents

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(every + 1, np.int64), np.zeros(every + 1, np.int64)
        for batch in W.chunks(batches):
            cell, ptr = cells(batch.column("text"), bits)
            label = batch.column("toxic").to_numpy() > 0
            seen += np.append(np.bincount(cell, minlength=every), len(label))
            toxic += np.append(np.bincount(cell[np.repeat(label, np.diff(ptr))], minlength=every), label.sum())
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at]), pa.array(toxic[at])], names=["cell", "seen", "toxic"])

    counts = chosen.mapInArrow(count, "cell long, seen long, toxic long").groupBy("cell").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toPandas()
    total = np.zeros((2, every + 1))
    total[:, counts["cell"].to_numpy()] = counts[["seen", "toxic"]].to_numpy().T
    live = docs.sparkSession.sparkContext.broadcast(telling(total[0, :every], total[1, :every], int(total[0, every]), int(total[1, every])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            cell, ptr = cells(batch.column("text"), bits)
            keep = live.value[cell]
            cell, ptr = cell[keep], np.concatenate([[0], np.cumsum(keep)])[ptr]
            lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(cell.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), lists], names=["doc_id", "toxic", "cells"])

    found = chosen.mapInArrow(run, "doc_id long, toxic int, cells array<int>").toPandas()
    found = found.assign(size=found["cells"].map(len)).sort_values(["doc_id", "toxic", "size"])
    return train([np.asarray(c, np.int64) for c in found["cells"]], (found["toxic"] > 0).to_numpy(float), bits, factors)


def score_texts(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` and score, predicted (1 from ``threshold`` on)."""
    held = docs.sparkSession.sparkContext.broadcast(Machine(machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32)))
    bits = int(machine.weight.size).bit_length() - 1
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            score = 1 / (1 + np.exp(-np.clip(held.value.raw(*cells(batch.column("text"), bits)), -30, 30)))
            yield pa.record_batch([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = TRAINING_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, score, predicted.

    ``labels`` (doc_id, toxic 0/1) are learned outside the third of documents with
    crc32(doc_id as text) mod 3 = 1, which is held_out.  Only the text is an input
    of a score: a null or empty text gets the score of no words.  A null doc_id is
    scored and not held out; repeated rows are scored alike; other columns are
    ignored; without documents the result is empty.
    """
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels, rows), threshold)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
