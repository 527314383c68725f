"""Personal data spans by weak supervision.

Fixed patterns give the base spans, which always stay.  A wider net of candidate
spans is voted on by labelers (patterns, gazetteers, words nearby), each for,
against or silent.  Expectation-maximisation over the counts of vote patterns
estimates how reliable every labeler is, per kind; the resulting probabilities
of a bounded sample of candidates train the final span classifier (logistic
regression over shape, context and votes).  Candidates it is sure of are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import thin
from .store import Workspace

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
CELLS = 1 << 12
SURE = 0.95

# Common domain endings, issuer prefixes and calling codes.
ENDINGS = frozenset("com org net edu gov mil int info io co uk de fr es it nl eu ch at be pl se us ca au jp cn in br ru".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38")
CALLING = re.compile(r"1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
NEAR = {
    "email": frozenset("email mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip server host address adresse dirección login from".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono".split()),
}
AGAINST = frozenset("version isbn issn doi order invoice page pages chapter section figure table".split())

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,3}[0-9])+(?![0-9A-Za-z])")
_AT = re.compile(r"(?<![\w.])[\w.+-]{1,64} ?(?:\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,4}")
_GROUPED = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}|[0-9]{1,2}[-. ][0-9]{1,2}[-. ](?:19|20)[0-9]{2}")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found
    from each @ outwards, so that a long run without one costs nothing."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        at += 1
        if m:
            yield start, m.end()
            done = at = m.end()


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, in order."""
    if not _SOME.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[Span]) -> list[Span]:
    """The base spans and whatever else might be one: numbers of 9 to 19 digits and
    spelled-out addresses that touch no base span."""
    if not _SOME.search(text) and "(at)" not in text and "[at]" not in text:
        return []
    out = list(base)
    taken = sorted((a, b) for a, _, b in base)
    free = lambda a, b: all(b <= x or y <= a for x, y in taken)
    for m in _AT.finditer(text):
        if free(*m.span()):
            out.append((m.start(), 0, m.end()))
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        if 9 <= n <= 19 and free(*m.span()):
            out += [(m.start(), 3, m.end())] * (n <= 15) + [(m.start(), 2, m.end())] * (n >= 12)
    return sorted(out)


def _nearby(text: str, start: int) -> list[str]:
    return re.findall(r"[^\W\d_]+", text[max(0, start - 60) : start].lower())[-4:]


# Labelers: (text, span text, kind, words before) -> 1 for, -1 against, 0 silent.
LABELERS: dict[str, Callable[[str, int, list[str]], int]] = {
    "pattern": lambda s, kind, near: 1 if any(k == kind and (a, b) == (0, len(s)) for a, k, b in base_spans(s)) else 0,
    "checksum": lambda s, kind, near: 0 if kind != 2 else 1 if luhn(_digits(s)) else -1,
    "issuer": lambda s, kind, near: 0 if kind != 2 else 1 if ISSUERS.match(_digits(s)) else -1,
    "ending": lambda s, kind, near: 0 if kind != 0 else 1 if re.split(r"[.\s)\]]", s.lower())[-1] in ENDINGS else -1,
    "calling code": lambda s, kind, near: 0 if kind != 3 or s[0] != "+" else 1 if CALLING.match(_digits(s)) else -1,
    "grouping": lambda s, kind, near: 0 if kind != 3 else 1 if _GROUPED.search(s) else -1 if s.isdigit() else 0,
    "octets": lambda s, kind, near: 0 if kind != 1 else -1 if s.startswith("0.") else 1,
    "words for": lambda s, kind, near: 1 if NEAR[KINDS[kind]].intersection(near) else 0,
    "words against": lambda s, kind, near: -1 if AGAINST.intersection(near) else 0,
    "date": lambda s, kind, near: -1 if kind in (2, 3) and _DATE.search(s) else 0,
}


def votes(text: str, span: Span) -> list[int]:
    start, kind, end = span
    near = _nearby(text, start)
    return [f(text[start:end], kind, near) for f in LABELERS.values()]


def features(text: str, span: Span, cast: list[int]) -> list[int]:
    """Hashed features of a candidate: shape, digits, context, votes, all by kind."""
    start, kind, end = span
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", text[start:end]))
    named = [f"shape {shape}", f"digits {shape.count('9')}", f"before {text[start - 1 : start]}", f"after {text[end : end + 1]}", *(f"word {w}" for w in _nearby(text, start)[-2:])]
    named += [f"vote {i} {v}" for i, v in enumerate(cast) if v] + ["kind"]
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % CELLS for n in named})


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (kind, votes, count): accuracy per
    kind and labeler, and the probability that a pattern's candidates are real."""
    accuracy = np.full((len(KINDS), vote.shape[1]), 0.8)
    p = np.zeros(len(n))
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        v, c, prior = vote[own], n[own].astype(float), 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + v @ np.log(accuracy[k] / (1 - accuracy[k]))
            q = 1 / (1 + np.exp(-odds))
            right = ((v == 1) * (c * q)[:, None] + (v == -1) * (c * (1 - q))[:, None]).sum(0)
            accuracy[k] = np.clip((right + 8) / ((np.abs(v) * c[:, None]).sum(0) + 10), 0.55, 0.99)
            prior = float(np.clip((c * q).sum() / c.sum(), 0.05, 0.95))
        p[own] = q
    return accuracy, p


def train(rows: list[list[int]], p: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic regression on soft labels by gradient steps."""
    weight = np.zeros(CELLS + 1)
    if not rows:
        return weight
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64)
    total, squares = n.sum(), np.full(CELLS + 1, 1e-8)
    for _ in range(rounds):
        out = weight[CELLS] + np.bincount(row, weight[at], len(rows))
        err = n * (1 / (1 + np.exp(-out)) - p) / total
        step = np.bincount(at, err[row], CELLS + 1)
        step[CELLS] = err.sum()
        step += 1e-4 * weight
        squares += step**2
        weight -= 0.3 * step / np.sqrt(squares)
    return weight


@dataclass
class Detector:
    accuracy: np.ndarray  # per kind and labeler
    weight: np.ndarray

    def spans(self, text: str, base: list[Span], sure: float = SURE) -> list[Span]:
        """The base spans and the candidates added."""
        found = candidates(text, base)
        out = set(base)
        for span in found:
            if span not in out:
                score = self.weight[CELLS] + self.weight[features(text, span, votes(text, span))].sum()
                if score >= np.log(sure / (1 - sure)) and all(span[2] <= a or b <= span[0] for a, _, b in out):
                    out.add(span)
        return sorted(out)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Detector:
    """Votes of the candidates of all texts are counted; the classifier is trained on
    about ``sample`` distinct sets of features."""
    ws = Workspace(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                for span in candidates(text, base_spans(text)) if text else ():
                    cast = votes(text, span)
                    rows.append((span[1], ",".join(map(str, cast)), features(text, span, cast)))
            if rows:
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.list_(pa.int32())))], names=["kind", "votes", "cells"])

    found = docs.select("text").mapInArrow(run, "kind int, votes string, cells array<int>").groupBy("kind", "votes", "cells").agg(F.count(F.lit(1)).alias("n"))
    found = ws.keep(found.withColumn("id", F.xxhash64("kind", "votes", "cells")))
    patterns = found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).toPandas().sort_values(["kind", "votes"])  # at most 3 ** labelers per kind
    taught = thin(found, "id", sample, seed=7).toPandas().sort_values("id")
    ws.drop(found)
    if not len(patterns):
        return Detector(np.full((len(KINDS), len(LABELERS)), 0.8), np.zeros(CELLS + 1))
    cast = np.array([list(map(int, v.split(","))) for v in patterns["votes"]])
    accuracy, p = reliabilities(patterns["kind"].to_numpy(), cast, patterns["n"].to_numpy())
    soft = dict(zip(zip(patterns["kind"], patterns["votes"]), p))
    rows = [list(c) for c in taught["cells"]]
    return Detector(accuracy, train(rows, np.array([soft[k] for k in zip(taught["kind"], taught["votes"])]), np.sqrt(taught["n"].to_numpy(float))))


def _line(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans per row."""
    held = docs.sparkSession.sparkContext.broadcast(detector)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, lines = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))])
                hashes.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(held.value.spans(text, base) if text else base))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(lines, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; of
    overlapping spans the first, then the longest, counts and covers the others."""
    held = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                spans = held.value.spans(text, base_spans(text)) if text else []
                if spans:
                    parts, end = [], 0
                    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
                        if a >= end:
                            parts += [text[end:a], f"[{KINDS[k].upper()}]"]
                        end = max(end, b)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base spans by kind, the SHA-256
    of ``kind:start:end`` of the base spans, and all spans in the same form, by start,
    then kind; offsets are code points, ends exclusive.

    A null or empty text has no spans.  A null doc_id is reported as null; repeated
    rows are alike; other columns are ignored; no rows in give no rows out.
    """
    return detect(docs, fit(docs, sample))
