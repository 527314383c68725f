"""The split paths must give what one ordered pass over a key gives."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.operators import matching, scale
from reelgrid.operators.cues import align_cues, check_monotonic, merge_flicker, merge_simultaneous, merge_slices, nearest_middle, normalize_timing


def _cues(spark, n=60, tracks=3, seed=42):
    rnd = random.Random(seed)
    rows = []
    for t in range(tracks):
        at = 0
        for i in range(n):
            at += rnd.randint(0, 1500)
            rows.append((t, i, at, at + rnd.randint(-50, 2500), rnd.choice(["甲乙丙丁", "甲乙丙丁", "戊己庚辛", "壬癸"])))
    return rows, spark.createDataFrame(rows, "track_id long, idx long, start_ms long, end_ms long, text string")


def test_positions_match_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(500)).alias("v"), "id").repartition(7)
    got = {(r["k"], r["id"]): r["pos"] for r in scale.positions(df, ["k"], [F.desc("v"), F.col("id")]).collect()}
    for k in range(3):
        rows = sorted((r for r in df.collect() if r["k"] == k), key=lambda r: (-r["v"], r["id"]))
        assert [got[(k, r["id"])] for r in rows] == list(range(1, len(rows) + 1))


def test_running_and_neighbours_across_chunks(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), "id", F.floor(F.col("id") / 16).alias("c"), ((F.col("id") * 7) % 11).alias("v"))
    specs = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))}
    order = [F.col("id")]
    for exclusive in (False, True):
        split = scale.running(df, ["k"], "c", order, specs, exclusive)
        plain = scale.running(df.withColumn("c", F.lit(0)), ["k"], "c", order, specs, exclusive)
        cols = ["k", "id", "s", "m", "n"]
        assert sorted(split.select(*cols).collect()) == sorted(plain.select(*cols).collect(), key=lambda r: tuple(r)) or (
            sorted(map(str, split.select(*cols).collect())) == sorted(map(str, plain.select(*cols).collect()))
        )
    a = scale.neighbours(df, ["k"], "c", order, lag={"p": "v"}, lead={"x": "v"}).select("k", "id", "p", "x")
    b = scale.neighbours(df.withColumn("c", F.lit(0)), ["k"], "c", order, lag={"p": "v"}, lead={"x": "v"}).select("k", "id", "p", "x")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_chunked_fold_reaches_the_sequential_result(spark):
    def step(rows, state, last):
        total = json.loads(state) if state else 0
        out = []
        for r in rows:
            total = (total * 3 + r["v"]) % 1009
            out.append({"pos": int(r["id"]), "h": int(total)})
        return out, json.dumps(total)

    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("h", T.LongType())])
    df = spark.range(60).select(F.lit(1).alias("k"), "id", F.floor(F.col("id") / 10).alias("c"), ((F.col("id") * 5) % 17).alias("v"))
    got = {r["pos"]: r["h"] for r in scale.chunked_fold(df, ["k"], "c", ["id"], step, schema).collect()}
    total = 0
    for r in df.orderBy("id").collect():
        total = (total * 3 + r["v"]) % 1009
        assert got[r["id"]] == total


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 100 <> 99")
    roots = {r["node"]: r["root"] for r in scale.components(edges).collect()}
    assert all(roots[i] == i // 100 * 100 for i in range(300) if i in roots)
    assert len(set(roots.values())) == 3


def _normalized(rows):
    """Plain loop: push overlaps, then bound durations."""
    out = {}
    for t in sorted({r[0] for r in rows}):
        cs = sorted(([s, e if e > s else s + 100, i] for k, i, s, e, _ in rows if k == t), key=lambda c: (c[0], c[1], c[2]))
        for p, c in zip(cs, cs[1:]):
            move = max(0, p[1] + 40 - c[0])
            c[0] += move
            c[1] += move
        for j, c in enumerate(cs):
            nxt = cs[j + 1][0] if j + 1 < len(cs) else None
            if c[1] - c[0] < 800:
                target = c[0] + 800 if nxt is None else min(c[0] + 800, nxt - 40)
                c[1] = target if target > c[0] else c[1]
            c[1] = min(c[1], c[0] + 7000)
            c[1] = c[0] + 100 if c[1] <= c[0] else c[1]
            out[(t, c[2])] = (c[0], c[1])
    return out


def test_normalize_timing_split_and_plain(spark):
    rows, df = _cues(spark)
    want = _normalized(rows)
    for chunk_ms in (5_000, 3_600_000):
        got = {(r["track_id"], r["idx"]): (r["start_ms"], r["end_ms"]) for r in normalize_timing(df, chunk_ms=chunk_ms).collect()}
        assert got == want


def test_normalize_twice_is_once(spark):
    _, df = _cues(spark, 20, 1)
    once = normalize_timing(df)
    assert sorted(once.collect()) == sorted(normalize_timing(once).collect())


def test_sequential_rules_do_not_depend_on_chunks(spark):
    _, df = _cues(spark, 80, 2)
    for rule in (merge_flicker, merge_simultaneous):
        assert sorted(rule(df, chunk_ms=4_000).collect()) == sorted(rule(df, chunk_ms=10**9).collect())
    parts = df.withColumn("slice", F.col("idx") % 2)
    off = parts.select("track_id", "slice").distinct().withColumn("offset_ms", F.col("slice") * 900)
    assert sorted(merge_slices(parts, off, 4_000).collect()) == sorted(merge_slices(parts, off, 10**9).collect())


def test_monotonic_across_chunks(spark):
    _, df = _cues(spark, 50, 2)
    assert sorted(check_monotonic(df, chunk=7).collect()) == sorted(check_monotonic(df).collect())


def test_nearest_middle_brute_force(spark):
    rows, df = _cues(spark, 40, 2)
    other = df.where("idx % 3 = 0").withColumn("text", F.col("idx").cast("string"))
    got = {(r["track_id"], r["idx"]): r["near_text"] for r in nearest_middle(df, other, chunk_ms=3_000).collect()}
    refs = [r for r in rows if r[1] % 3 == 0]
    for t, i, s, e, _ in rows:
        best = min((r for r in refs if r[0] == t), key=lambda r: (abs(r[2] + r[3] - s - e), r[1]))
        assert got[(t, i)] == str(best[1])


def test_greedy_matching_rounds_equal_one_pass(spark):
    rnd = random.Random(1)
    rows = [(1, rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 5)) for _ in range(300)]
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "g long, l long, r long, w long")
    many = sorted(map(tuple, matching.greedy_matching(df, ["g"], "l", "r", ["w", "l", "r"]).collect()))
    used_l, used_r, one = set(), set(), []
    for g, l, r, w in sorted(rows, key=lambda x: (x[3], x[1], x[2])):
        if l not in used_l and r not in used_r:
            used_l.add(l)
            used_r.add(r)
            one.append((g, l, r, w))
    assert sorted(one) == many


def test_percentiles_of_small_values_spread_over_tasks(spark):
    from reelgrid.operators.metrics import nearest_rank

    rnd = random.Random(2)
    rows = [(k, rnd.random()) for k in ("a", "b") for _ in range(3_001)]
    got = {r["k"]: (r["p50"], r["p95"]) for r in nearest_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in ("a", "b"):
        own = sorted(v for x, v in rows if x == k)
        assert got[k] == (own[1500], own[2850])


def test_similar_texts_loses_no_pair(spark):
    from difflib import SequenceMatcher

    from reelgrid.functions.similarity import alike

    def sim(a, b):
        return float(a == b) or max(len(set(a) & set(b)) / len(set(a) | set(b)), 0.9 * SequenceMatcher(None, a, b).ratio())

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(1, t) for t in texts], "k long, text string")
    for thr in (0.5, 0.8):
        got = {(r["text_a"], r["text_b"]) for r in matching.similar_texts(df, df, ["k"], thr).collect()}
        want = {(a, b) for a in texts for b in texts if sim(a, b) >= thr}
        assert got == want == {(a, b) for a in texts for b in texts if alike(a, b, thr)}


def test_align_repeats_take_the_nearest_interval(spark):
    cues = spark.createDataFrame([(1, 0, 1000, 2000, "打死他"), (1, 1, 21000, 22000, "打死他")], "track_id long, idx long, start_ms long, end_ms long, text string")
    iv = spark.createDataFrame([(1, 0, 20900, 22000, "打死他"), (1, 1, 900, 2000, "打死他")], "track_id long, idx long, start_ms long, end_ms long, text string")
    assert {r["idx"]: r["iv_idx"] for r in align_cues(cues, iv).collect()} == {0: 1, 1: 0}
