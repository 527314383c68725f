"""Small tables with the odd cases that every operator must stand."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, n int, size string, score string, kind int, term string, block string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empties, blanks, one word, ties, repeated rows, a very long text."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "Éa ñ öß 漢字 \U0001F600 tail"), (8, "x" * 70_000), (9, LONG), (10, LONG + " end"),
        (11, "\x00\x01 odd \x7f bytes"), (4, "one"), (None, "no id here at all"), (None, None), (12, "a b c d"),
    ]


def table(spark: SparkSession, rows: list[tuple], lang: str | None = "en", source: str | None = "s") -> DataFrame:
    """A documents table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", 1, "y", "z", 0, "t", "b") for i, t in rows], DOCS)


def near_copies(n: int, words: int, change: float, seed: int, start: int = 100) -> list[tuple[int, str]]:
    """One text and ``n - 1`` copies with a share of the words replaced."""
    r = random.Random(seed)
    first = [f"t{seed}w{i}" for i in range(words)]
    return [(start + k, " ".join(w if k == 0 or r.random() > change else f"c{k}n{i}" for i, w in enumerate(first))) for k in range(n)]


def lower(text: str | None) -> str:
    """A-Z in lower case, nothing else."""
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def groups_of(n: int, links: list[tuple[int, int]]) -> list[int]:
    """The root of each of ``n`` things under ``links``."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]
