"""Scores, containment, Hamming pairs and notes against brute force, in many small blocks."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import cues as cu
from reelgrid.operators import dedup, lexical, retrieval
from reelgrid.functions.similarity import caption_sim
from reelgrid.operators.containment import containments
from reelgrid.operators.frames import frames_to_intervals


def _tokens(text):
    low = (text or "").lower()
    cjk = re.findall("[一-鿿]", low)
    return {*re.findall("[a-z0-9]+", low), *("c:" + c for c in cjk), *("b:" + a + b for a, b in zip(cjk, cjk[1:]))}


def _score(query, fields, channels):
    asked = _tokens(query)
    grams = {t for t in asked if t.startswith("b:")}
    weight = lambda t: 0.5 if t.startswith("b:") else 0.1 if t.startswith("c:") else 1.0
    total = 0.0
    for factor, text in fields:
        own = _tokens(text)
        strict = sum(map(weight, asked & own))
        loose = sum(any(len(t) > 5 and q in t and q != t and t[:2] not in ("b:", "c:") for t in own) for q in asked if len(q) >= 5 and q[:2] not in ("b:", "c:"))
        total += factor * (strict or 0.6 * loose)
    for text in channels:
        both = asked & _tokens(text)
        if not (len(grams) >= 2 and len(both & grams) < 2):
            total += 0.35 * sum(not t.startswith("c:") for t in both)
    return round(total, 6)


@pytest.mark.parametrize("entries", [1 << 20, 3])
def test_lexical_scores(spark, entries, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 8)
    r = random.Random(4)
    words = ["chicken", "chickens", "backchicken", "wing", "wings", "烧鸡", "烧鸡翅", "鸡翅", "a1", "salad", "saladbowl", ""]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 5)))
    docs = [(f"d{i}", text(), text() if i % 4 else None) for i in range(60)]
    side = [(f"d{i}", c, text()) for i in range(0, 60, 3) for c in ("ocr", "asr")]
    queries = [(i, text()) for i in range(12)] + [(99, None), (100, "")]
    d, q = spark.createDataFrame(docs, "id string, name string, tail string"), spark.createDataFrame(queries, "qid long, query string")
    s = spark.createDataFrame(side, "id string, channel string, text string")
    got = lexical.scan_scores(q, d, {"name": F.col("name"), "tail": F.col("tail")}, {"name": 3.0}, 0.35, s, entries)
    want = {}
    for qid, query in queries:
        for i, name, tail in docs:
            value = _score(query, [(3.0, name), (0.35, tail)], [t for j, _, t in side if j == i])
            if value > 0:
                want[qid, i] = value
    assert {(x.qid, x.id): round(x.score, 6) for x in got.collect()} == want
    assert retrieval.lexical_scores(q.limit(0), d, {"name": F.col("name")}).count() == 0


@pytest.mark.parametrize("chars", [1 << 21, 5])
def test_containments(spark, chars):
    r = random.Random(1)
    phrases = ["a", "ab", "ba", "aab", "漢字", "", None, "bbbb"]
    texts = [(i, "".join(r.choice("ab漢字") for _ in range(r.randint(0, 9)))) for i in range(50)] + [(77, None)]
    got = containments(spark.createDataFrame(texts, "i long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), chars=chars)
    assert sorted((x.i, x.phrase) for x in got.collect()) == sorted((i, p) for i, t in texts for p in phrases if p and t and p in t)


@pytest.mark.parametrize(("d", "bands"), [(3, 2), (3, 3), (3, 4), (1, 4), (8, 3), (10, 4), (0, 2)])
def test_hamming_pairs_by_any_bands(spark, d, bands):
    r = random.Random(d)
    base = [r.getrandbits(64) for _ in range(12)]
    hashes = {h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, d + 2))) for h in base for _ in range(6)}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    got = dedup.hash_pairs(spark.createDataFrame([(h,) for h in signed], "h long"), d, bands)
    far = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    assert sorted((x.h_a, x.h_b, x.dist) for x in got.collect()) == sorted((a, b, far(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if far(a, b) <= d)


def _place(notes, cues, anchors):
    """Notes one after the other, as the definition says."""
    spans, used, out = {}, set(), []
    low = [t.lower() for _, _, t in cues]
    words = [set(re.findall("[a-z0-9]{2,}", t)) for t in low]
    for i, title in enumerate(notes):
        mine = sorted((a for a in anchors if a in title.lower()), key=lambda a: (-len(a), a not in title, anchors.index(a)))
        for j in (j for a in mine for j in range(len(cues)) if a in low[j] and j not in used):
            used.add(j)
            spans[i] = cues[j][:2]
            break
    for i, title in enumerate(notes):
        w = set(re.findall("[a-z0-9]{2,}", title.lower()))
        best = [(-round(len(w & k) / (len(w) * len(k)) ** 0.5, 12), j) for j, k in enumerate(words) if j not in used and w & k]
        if i not in spans and best and min(best)[0] <= -0.05:
            used.add(min(best)[1])
            spans[i] = cues[min(best)[1]][:2]
    middles, seen = {i: sum(s) / 2 for i, s in spans.items()}, []
    for i in range(len(notes)):
        if i not in spans:
            before, after = [middles[k] for k in sorted(middles) if k < i][-1:], [middles[k] for k in sorted(middles) if k > i][:1]
            first, last = cues[0][0], cues[-1][1]
            at = (before[0] + after[0]) / 2 if before and after else min(last, before[0] + 8000) if before else max(0, after[0] - 8000) if after else first + (i + 1) / (len(notes) + 1) * (last - first)
            spans[i] = (max(0, at - 1500), at + 1500)
        start, end = spans[i]
        middle = now = (start + end) / 2
        for p in seen:
            now = p + 1500 if abs(now - p) < 1200 else now
        seen.append(now)
        out.append((i, round(max(0, start + now - middle)), round(max(500, end + now - middle))))
    return out


@pytest.mark.parametrize("anchors", [[], ["coat", "big coat", "hat"]])
def test_notes_meet_their_cues(spark, anchors):
    r = random.Random(6)
    words = ["coat", "big", "hat", "Big coat", "sock", "shoe", "red", "blue", "zz"]
    tracks = defaultdict(lambda: ([], []))
    for t in range(6):
        at = 0
        for _ in range(r.randint(1, 40)):
            at += r.randint(0, 1500)
            tracks[t][1].append((at, at + r.randint(500, 2500), " ".join(r.choice(words) for _ in range(r.randint(0, 3)))))
        tracks[t][0].extend(" ".join(r.choice(words) for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 30)))
    notes = spark.createDataFrame([(t, i, n, "") for t, (ns, _) in tracks.items() for i, n in enumerate(ns)] + [(50, 0, "no cues here", "")], "track_id long, note long, title string, detail string")
    cues = spark.createDataFrame([(t, i, *c) for t, (_, cs) in tracks.items() for i, c in enumerate(cs)], "track_id long, idx long, start_ms long, end_ms long, text string")
    got = defaultdict(list)
    for x in cu.align_notes(notes, cues, anchors).collect():
        got[x.track_id].append((x.note, x.start_ms, x.end_ms))
    assert {t: sorted(v) for t, v in got.items()} == {t: _place(ns, cs, anchors) for t, (ns, cs) in tracks.items()}


def test_runs_of_similar_text(spark):
    lines = [(1, 0, f, 0, "甲乙丙丁戊") for f in range(5)] + [(1, 0, 5, 0, "甲乙丙丁")] + [(1, 0, 6, 0, "壬癸")] + [(1, 0, 9, 0, "壬癸"), (1, 0, 10, 0, "壬癸")] + [(2, 1, 3, 0, "子")]
    got = frames_to_intervals(spark.createDataFrame(lines, "video_id long, track long, frame long, block long, text string"), 1000)
    assert sorted(map(tuple, got.select("video_id", "track", "start_ms", "end_ms", "text").collect())) == [(1, 0, 0, 5000, "甲乙丙丁戊"), (1, 0, 9000, 10000, "壬癸")]


def test_similarity_of_captions(spark):
    r = random.Random(8)
    pairs = [("".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(0, 8))), "".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(0, 8)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", caption_sim("a", "b").alias("s")).collect()
    for a, b, s in got:
        want = 0.0 if not a or not b else float(a == b) or max(len({*a} & {*b}) / len({*a} | {*b}), 0.9 * SequenceMatcher(None, a, b).ratio())
        assert abs(s - want) < 1e-9


def test_lines_of_the_band_leak(spark):
    """Of four lines outside the band one is a watermark, one Latin, one known in the band
    at that time."""
    kind = "track_id long, idx long, start_ms long, end_ms long, text string"
    full = [(1, i, i * 1000, i * 1000 + 900, "水印") for i in range(4)] + [(1, 10, 9_000, 9_900, "新的一行"), (1, 11, 12_000, 12_900, "latin"), (1, 12, 15_000, 15_900, "大家好"), (1, 13, 18_000, 18_900, "看水印吧")]
    band = [(1, 0, 15_000, 15_900, "大家好")]
    got = cu.leak_suspects(spark.createDataFrame(full, kind), spark.createDataFrame(band, kind)).collect()
    assert [x.idx for x in got] == [10]


def test_best_chunk_counts(spark):
    docs = spark.createDataFrame([("a", "red coat\n" + "filler words here " * 20 + "\nblue coat red coat"), ("b", "coat"), ("c", None)], "id string, description string")
    queries = spark.createDataFrame([(1, "red blue coat")], "qid long, query string")
    assert [(x.id, x.rank) for x in retrieval.chunk_search(queries, docs, 5).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_vectors_come_from_the_function(spark):
    texts = spark.createDataFrame([("a", "one two two", "s1"), ("b", None, "s2")], "id string, text string, sig string")
    got = {x.mid: x for x in retrieval.embed(texts, retrieval.hashed_vectors, "m").collect()}
    assert [sum(got[k].vec) for k in "ab"] == [3.0, 0.0] and {(x.model, x.sig, x.dim) for x in got.values()} == {("m", "s1", 64), ("m", "s2", 64)}
