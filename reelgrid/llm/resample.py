"""Quality selection by importance resampling over hashed n-grams.

Two generative models of hashed words and word pairs, one of target documents
and one of all raw documents, weigh each document by the ratio of its
likelihoods; Gumbel noise on the log weight and the top k draw a sample without
replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .samples import thin
from .store import Workspace, top_threshold

BUCKETS = 10_000
TARGET_ROWS = 20_000


def _cells(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word and pair of neighbouring words, and its text."""
    found = W.Words(texts, W.letters_and_digits())
    h, row = found.hashes(), found.rows()
    pair = row[1:] == row[:-1]
    two = W.mix(h[:-1][pair] * np.uint64(3) + h[1:][pair])
    return (np.concatenate([h, two]) % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def log_ratios(docs: DataFrame, target: DataFrame, rows: int = TARGET_ROWS, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target over raw frequency per bucket.  Raw counts cover all
    documents; the target model is fitted on about ``rows`` of the target ids."""
    ids = F.broadcast(thin(target.select("doc_id").where("doc_id is not null").distinct(), "doc_id", rows, seed=2).withColumn("wanted", F.lit(1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, own = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in W.chunks(batches):
            cell, row = _cells(batch.column("text"), buckets)
            wanted = batch.column("wanted").fill_null(0).to_numpy() == 1
            raw += np.bincount(cell, minlength=buckets)
            own += np.bincount(cell[wanted[row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(own[at])], names=["cell", "raw", "own"])

    counts = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("text", "wanted").mapInArrow(run, "cell int, raw long, own long")
    counts = counts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("own").alias("own")).toPandas()
    raw, own = np.ones(buckets), np.ones(buckets)
    raw[counts["cell"]] += counts["raw"]
    own[counts["cell"]] += counts["own"]
    if own.sum() == buckets:  # no target text: nothing to prefer
        return np.zeros(buckets)
    return np.log(own / own.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_features, log_weight per row."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            cell, row = _cells(batch.column("text"), len(held.value))
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(np.bincount(row, held.value[cell], batch.num_rows).astype(float))],
                names=["doc_id", "n_features", "log_weight"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, log_weight double")


def importance_sample(docs: DataFrame, target: DataFrame, fraction: float = 0.8, seed: int = 0, rows: int = TARGET_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_features, log_weight, kept; ``target``
    (doc_id) names target documents.

    kept marks the ``ceil(fraction * rows)`` largest log weights with Gumbel noise
    from a hash of doc_id, so reruns agree.  A null or empty text has weight 0;
    rows that repeat an id and a text share their key and, at the border, are kept
    together; without target texts all weights are 0 and the sample is uniform.
    """
    ws = Workspace(docs.sparkSession)
    scored = weigh(docs, log_ratios(docs, target, rows, buckets))
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))
    noisy = ws.keep(scored.withColumn("key", F.round((F.col("log_weight") - F.log(-F.log(u))) * F.lit(float(1 << 20))).cast("long")))
    n = noisy.count()
    least = top_threshold(noisy, "key", int(np.ceil(fraction * n)))
    return noisy.select("doc_id", "n_features", "log_weight", (F.col("key") >= (least if least is not None else 0) if n else F.lit(True)).alias("kept"))
