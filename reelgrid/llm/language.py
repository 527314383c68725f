"""Language identification by word frequencies with backing off to character n-grams.

A known word adds its log frequency in each language.  An unseen word is cut
into character n-grams of four, then three, two and one characters; the first
length that has known n-grams decides, with their mean.  The model is fitted on
a bounded sample per language and keeps a bounded number of entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .samples import fold
from .store import Workspace

PER_LANGUAGE = 6_000
WORDS = 200_000
GRAMS = 200_000
LONGEST = 4


def grams(word: str, n: int) -> list[str]:
    """The character n-grams of a word between boundary marks."""
    marked = f"\x02{word}\x03"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    languages: list[str]  # commonest first
    word: dict[str, int]
    word_log: np.ndarray  # entry and language
    gram: dict[str, int]
    gram_log: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        """Log weight of one word per language."""
        i = self.word.get(word)
        if i is not None:
            return self.word_log[i]
        for n in range(LONGEST, 0, -1):
            known = [k for k in map(self.gram.get, grams(word, n)) if k is not None]
            if known:
                return self.gram_log[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def _log_table(counts, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequencies of entries (columns lang, item, n) by language."""
    items = sorted(set(counts["item"]))
    at = {w: i for i, w in enumerate(items)}
    of = {x: j for j, x in enumerate(languages)}
    n = np.zeros((len(items), len(languages)))
    np.add.at(n, ([at[w] for w in counts["item"]], [of[x] for x in counts["lang"]]), counts["n"].to_numpy(float))
    total = n.sum(axis=0)
    return at, np.log((n + 0.1) / (total + 0.1 * max(len(items), 1))).astype(np.float32)


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """Entries with at least the count that leaves no more than ``most`` of them."""
    whole = counts.groupBy("item").agg(F.sum("n").alias("all"))
    by_count = whole.groupBy("all").count().orderBy(F.desc("all")).toPandas()
    fits = by_count["all"][by_count["count"].cumsum() <= most]
    least = int(fits.min()) if len(fits) else int(by_count["all"].max()) + 1 if len(by_count) else 1
    return counts.join(whole.where(F.col("all") >= max(least, 2)), "item", "left_semi")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, words: int = WORDS, n_grams: int = GRAMS) -> Model:
    """Fit on about ``per_language`` documents of every language (lang not null,
    crc32(doc_id as text) mod 5 not 0), chosen by a hash of doc_id."""
    usable = docs.where(F.col("lang").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    sizes = F.broadcast(sizes)  # one row per language
    languages = [r["lang"] for r in sizes.orderBy(F.desc("c"), "lang").collect()]
    sample = usable.join(sizes, "lang").where(F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)) * F.col("c") < F.lit(per_language << 30).cast("double"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            lang = batch.column("lang")
            for name in lang.unique().to_pylist():
                part = batch.filter(pa.array([x == name for x in lang.to_pylist()]))
                found = pc.value_counts(_words(part.column("text")).packed())
                yield pa.record_batch([pa.array([name] * len(found)), found.field(0).cast(pa.large_string()).cast(pa.string()), found.field(1)], names=["lang", "item", "n"])

    counts = sample.select("text", "lang").mapInArrow(run, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "item", "n"))):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        total[lang, g] += n
            yield pa.record_batch(
                [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["lang", "item", "n"],
            )

    ws = Workspace(docs.sparkSession)
    counts = ws.keep(counts)
    cuts = ws.keep(counts.mapInArrow(cut, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    word, word_log = _log_table(_commonest(counts, words).toPandas(), languages)
    gram, gram_log = _log_table(_commonest(cuts, n_grams).toPandas(), languages)
    ws.drop(counts, cuts)
    return Model(languages, word, word_log, gram, gram_log)


def _words(texts: pa.Array) -> W.Words:
    return W.Words(pc.utf8_lower(texts), W.letters())


def language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of ``docs`` (doc_id, text).

    The score is the share of the best language among the products of word
    weights.  A null or empty text, one without a letter, and every text when
    nothing was learned are ``und`` with score 0; ties go to the language with
    more training documents.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = held.value, {}
        names = np.array([*model.languages, "und"], object)
        for batch in W.chunks(batches, most=8 << 20):
            text = batch.column("text")
            found = _words(text)
            code, distinct = found.codes()
            table = np.zeros((len(distinct), max(len(model.languages), 1)), np.float32)
            if model.languages:
                for i, raw in enumerate(distinct):
                    v = memo.get(raw)
                    if v is None:
                        if len(memo) > 200_000:
                            memo.clear()
                        v = memo[raw] = model.vector(raw.decode())
                    table[i] = v
            sums = np.stack([np.bincount(found.rows(), table[code, j], batch.num_rows) for j in range(table.shape[1])], 1)
            sums -= sums.max(axis=1, keepdims=True)
            share = np.exp(sums) / np.exp(sums).sum(axis=1, keepdims=True)
            lettered = np.array([t is not None and next(filter(str.isalpha, t), None) is not None for t in text.to_pylist()], bool) & bool(model.languages)
            best = np.where(lettered, share.argmax(axis=1), len(model.languages))
            score = np.where(lettered, share.max(axis=1), 0.0)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): held_out, lang_pred, score.

    Learned outside the held-out fifth (crc32(doc_id as text) mod 5 = 0); lang is
    read for training only.  A null doc_id is predicted and neither learned from
    nor held out; repeated rows are alike; other columns are ignored.
    """
    out = language(docs, fit(docs, per_language))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
