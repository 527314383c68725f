"""Inputs on which queries once left their SQL twins or grew too fast."""

from __future__ import annotations

import random
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from oracle_check import check
from reelgrid.functions import text as tx
from reelgrid.operators import blocks, catalog, containment, cues as cu, dedup, evaluation, lexical, matching, retrieval, tagging
from reelgrid.operators.containment import containments
from reelgrid.operators.cues import coverage_rows
from reelgrid.operators.matching import similar_texts
from reelgrid.operators.scale import shared_folder, top_k
from reelgrid.plans import load_all
from reelgrid.plans.registry import QUERIES

load_all()


def against_twin(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return check(spark, con, str(folder), name)[0]


def vectors(*values):
    """One vector of 64 equal components per value."""
    return pa.table({
        "vec_id": pa.array(range(len(values)), pa.int64()), "embedding": pa.array([[v] * 64 for v in values], pa.list_(pa.float32())),
        "label": pa.array([0] * len(values), pa.int32()),
    })


def test_pixels_of_single_floats(spark, tmp_path):
    # (e + 1) * 160 rounds up to a whole number in single precision only.
    assert against_twin(spark, tmp_path, "ag38_band_scores", embeddings=vectors(-0.768750011920929, -0.737500011920929, 0.25)) == ""


def test_thumbnails_of_single_floats(spark, tmp_path):
    # The same for (e + 1) * 100; a pixel one too low turns a bit where it meets its neighbour.
    values = [-0.8700000047683716, -0.8100000023841858, -0.7400000095367432, -0.6800000071525574]
    rows = [[v if i % 2 == k else v + d / 100 for i in range(64)] for v in values for k in (0, 1) for d in range(-8, 9)]
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    assert against_twin(spark, tmp_path, "dd1_dhash", embeddings=table) == ""


def test_split_that_starts_where_its_cue_did(spark, tmp_path):
    # Cue 3 has no interval; its part of that of cue 2, from 3624 on, starts at its own 6000.
    size = {2: 77, 3: 39}
    rows = [(1, turn, ("abcd" * 100)[: size.get(turn, 8)]) for turn in range(5)]
    table = pa.table({"conv_id": [r[0] for r in rows], "turn": [r[1] for r in rows], "text": [r[2] for r in rows]})
    assert against_twin(spark, tmp_path, "jn14_retime", conversations=table) == ""


def test_values_without_length_take_a_frame(spark, tmp_path):
    table = pa.table({"event_id": [1, 2, 3, 4, 5], "value": [0.0, -2.0, None, 0.01, 1.25]})
    assert against_twin(spark, tmp_path, "sc23_snap_to_frames", events=table) == ""


def test_exploded_texts_are_not_broadcast(spark):
    # A file of texts is small, its characters are not: they took the driver's memory.
    texts = spark.range(200).selectExpr("id % 5 as k", "repeat(sha2(cast(id as string), 256), 4) as text")
    plan = similar_texts(texts, texts, ["k"], 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def sought(monkeypatch, module):
    """The phrases that ``module`` looks for in texts, filled in as it runs."""

    def spy(texts, phrases, text="text", phrase="phrase"):
        seen.extend(r[0] for r in phrases.select(phrase).collect())
        return containments(texts, phrases, text, phrase)

    monkeypatch.setattr(module, "containments", spy)
    return seen


def test_long_queries_are_not_sought_in_short_vetoes(spark, monkeypatch):
    seen = sought(monkeypatch, retrieval)
    queries = spark.createDataFrame([(1, "long text with a bad word"), (2, "  bad "), (3, "good " * 50), (4, ""), (5, None), (6, "ad wo")], "i long, query string")
    left = retrieval.drop_vetoed(queries, spark.createDataFrame([("bad word",), ("",)], "phrase string"))
    assert sorted(r["i"] for r in left.collect()) == [3, 4, 5]
    assert sorted(seen) == ["ad wo", "bad"]


def test_words_of_many_assets_are_not_sought(spark, monkeypatch):
    seen = sought(monkeypatch, evaluation)
    rows = [(f"{i:03}", f"common_{chr(97 + i)}name.mp4", f"common_{chr(97 + i)}name.mp4 commonest text in{i}") for i in range(12)]
    rows += [("900", "mon_in.mp4", "mon_in.mp4"), ("901", "rarest.mp4", "rarest.mp4 xrarestx")]
    got = evaluation.derive_queries(spark.createDataFrame(rows, "id string, name string, blob string").withColumn("orig_name", F.col("name")), most=8)
    assert sorted(map(tuple, got.collect())) == sorted([(f"{chr(97 + i)}name", f"{i:03}") for i in range(12)] + [("rarest", "901")])
    assert "common" not in seen


def test_scores_do_not_depend_on_pieces(monkeypatch):
    # 40 queries share every word: each token of a text stands for 40 entries.
    words = [f"word{i}" for i in range(30)]
    block = lexical._block(pa.table({"qid": [q for q in range(40) for _ in words], "token": words * 40}))
    rows = pa.record_batch({"id": list("abcdef"), "t": pa.array([words, None, [], words[:7] * 3, ["c:x", "word1", "longword12"], words[::-1]], pa.list_(pa.string()))})
    send = type("Sent", (), {"value": block})

    def run():
        return [tuple(r.values()) for part in lexical._scores(send, [1.7], False)([rows]) for r in part.to_pylist()]

    spread, most = lexical._spread, []

    def spy(ptr, which):
        out = spread(ptr, which)
        most.append(len(out[0]))
        return out

    monkeypatch.setattr(lexical, "_spread", spy)
    whole = run()
    most.clear()
    monkeypatch.setattr(lexical, "TOKENS", 8, raising=False)
    monkeypatch.setattr(lexical, "ADDED", 100, raising=False)
    assert run() == whole and len(whole) == 160
    assert max(most) <= 100


def test_tokens_are_sorted_without_a_comparator(spark, tmp_path):
    # array_sort compares by an interpreted function, which took 77 of 188 task seconds.
    table = pa.table({"doc_id": pa.array([1, 2, 3], pa.int64()), "text": ["The same AND the other", "", None]})
    pq.write_table(table, f"{tmp_path}/documents.parquet")
    plan = QUERIES["rt1_tokens"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_wide_hamming_pairs_by_tiles(spark, monkeypatch):
    # Many pieces, some empty; half of the hashes lie close together, as those of like pictures do.
    monkeypatch.setattr(dedup, "TILE_ROWS", 40)
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 60) ^ np.bitwise_xor.reduce(np.int64(1) << rng.integers(0, 63, (150, 6)), axis=1)
    h = np.unique(np.concatenate([near, rng.integers(-(1 << 63), (1 << 63) - 1, 150)]))
    df = spark.createDataFrame([(int(x),) for x in h] + [(None,)] + [(int(h[0]),)], "h long")
    found = dedup.hash_pairs(df, 10)
    dist = np.bitwise_count(h[:, None] ^ h)
    want = {(int(h[i]), int(h[j]), int(dist[i, j])) for i, j in zip(*np.nonzero(dist <= 10)) if i < j}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 500
    assert found.count() == len(want)
    ids = df.select(F.col("h").alias("id"), "h").distinct()
    asked = ids.where("h is not null").limit(7).select(F.col("id").alias("qid"), F.col("h").alias("qh"))
    got = {(r.qid, r.id, r.dist) for r in dedup.similar_to(ids, asked, 10).collect()}
    q = {r.qid for r in asked.collect()}
    assert got == {(x, y, d) for a, b, d in want for x, y in ((a, b), (b, a)) if x in q}


def test_best_rows_kept_inside_the_tasks(spark, monkeypatch):
    # Many equal scores and dates, rows without a date, several blocks of queries, held rows dropped often.
    monkeypatch.setattr(lexical, "HELD", 50)
    q = spark.createDataFrame([(i, f"w{i} common word{i % 3}") for i in range(12)], "qid int, query string")
    m = spark.range(400).select(
        F.format_string("%03d", "id").alias("id"), F.expr("concat('w', id % 12, ' common')").alias("name"), F.expr("array(concat('word', id % 4))").alias("tags"),
        F.expr("repeat('common words ', cast(id % 2 as int))").alias("description"), F.lit("a/b").alias("rel_path"), F.expr("timestamp_seconds(nullif(id % 7, 3))").alias("created_at"),
    ).repartition(3)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    every = retrieval.lexical_scores(q, m)
    names = ["qid", "id", "rank", F.round("score", 9)]
    for k in (1, 7, 500):
        assert rows(retrieval.lexical_top(q, m, k), *names) == rows(retrieval.search_rank(every, m, k), *names)
    fav = m.where("id % 50 = 1").select(F.col("id").alias("mid"))
    marked = every.join(m.select("id", "created_at"), "id").join(fav.select(F.col("mid").alias("id"), F.lit(True).alias("favorite")), "id", "left").fillna({"favorite": False})
    want = top_k(marked, ["qid"], [F.desc("favorite"), F.desc(F.round("score", 9)), F.desc("created_at"), F.col("id")], 9)
    assert rows(retrieval.lexical_top(q, m, 9, fav), "favorite", *names) == rows(want, "favorite", *names)
    blocks = lexical.scan_best(q, m, {"name": F.col("name")}, {}, 1.0, 4, entries=9)
    one = lexical.scan_best(q, m, {"name": F.col("name")}, {}, 1.0, 4)
    assert rows(blocks, "qid", "id", "score") == rows(one, "qid", "id", "score") and one.count() <= 12 * 4 * 16


def test_chunk_search_passes_on_few_rows(spark):
    q = spark.createDataFrame([(1, "common")], "qid int, query string")
    docs = spark.range(300).select(F.format_string("%03d", "id").alias("id"), F.expr("repeat('common words. ', 40)").alias("description"))
    top = retrieval.chunk_search(q, docs, 3)
    assert [r.id for r in top.orderBy("rank").collect()] == ["000", "001", "002"]
    held = lexical.scan_best(q, docs.repartition(4), {"description": F.col("description")}, {}, 1.0, 3)
    assert held.count() <= 3 * held.rdd.getNumPartitions()


def test_entities_are_counted_without_a_shuffle(spark):
    d = spark.createDataFrame([(1, "beta alpha beta alpha gamma"), (2, ""), (3, None), (4, "delta"), (5, "beta stop beta stop epsilon beta stop")], "id long, text string")
    top = tagging.open_entities(d, ["stop"], 3)
    assert "Exchange" not in top._jdf.queryExecution().toString()
    assert [tuple(r) for r in top.select("id", "entity", "n", "rank").orderBy("id", "rank").collect()] == [
        (1, "beta alpha", 2, 1), (1, "alpha beta", 1, 2), (1, "alpha gamma", 1, 3), (4, "delta", 1, 1), (5, "epsilon beta", 1, 1), (5, "beta", 3, 2), (5, "epsilon", 1, 3)]


def test_grams_are_not_shuffled(spark):
    rows = [(1, 0, "ABCDEFGH", "abcdefgh"), (1, 1, "abcdefgh", "xyz"), (2, 0, "abc", "abd"), (3, 0, None, None), (4, 0, "abcdefg", "bcdefgh"), (4, 0, "bcdefgh", "abcdefg")]
    x = evaluation.chr_f(spark.createDataFrame(rows, "id long, ref_no int, hyp string, ref string"))
    assert {r.id: r.chrf for r in x.collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0}
    assert "generate" not in x._jdf.queryExecution().toString().lower()


def test_scores_of_channels_are_not_shuffled(spark, monkeypatch):
    # Texts go to the tasks, which cut their tokens; rows of one id come from several batches and pieces.
    monkeypatch.setattr(lexical, "TOKENS", 4)
    q = spark.createDataFrame([(1, "alpha 的一是"), (2, "beta x9")], "qid long, query string")
    texts = ["Alpha beta", "的x一是 ALPHA", None, "", "É9beta的", "x9的 一是不了", "龿一丐鿿乀"]
    docs = spark.createDataFrame([(f"d{i % 9}", texts[i]) for i in range(7)] + [(None, "alpha")], "id string, name string")
    side = spark.createDataFrame([(f"d{i % 5}", f"c{i}", texts[i % 7]) for i in range(35)] + [(None, "c", "beta")], "id string, channel string, text string")
    fields = {"name": F.col("name")}
    both = lexical.scan_scores(q, docs, fields, {"name": 3.0}, 0.35, side)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "regexp_extract_all" not in plan
    tokens = lambda c: F.array_distinct(tx.tokens(c))
    asked = q.select("qid", F.explode(tokens("query")).alias("t"))
    weight = F.when(F.col("t").startswith("b:"), 0.5).when(F.col("t").startswith("c:"), 0.1).otherwise(1.0)
    own = docs.select("id", F.explode(tokens("name")).alias("t")).join(asked, "t").select("qid", "id", (3 * weight).alias("s"))
    grams = lambda: F.count_if(F.col("t").startswith("b:"))
    other = side.select("id", "channel", F.explode(tokens("text")).alias("t")).join(asked, "t").groupBy("qid", "id", "channel").agg(grams().alias("b"), F.count_if(~F.col("t").startswith("c:")).alias("n"))
    other = other.join(asked.groupBy("qid").agg(grams().alias("nb")), "qid").where("not (nb >= 2 and b < 2) and n > 0").select("qid", "id", (0.35 * F.col("n")).alias("s"))
    want = own.unionByName(other).groupBy("qid", "id").agg(F.round(F.sum("s"), 6).alias("s"))
    key = lambda r: (r[0], r[1] or "")
    got = sorted((tuple(r) for r in both.select("qid", "id", F.round("score", 6)).collect()), key=key)
    assert got == sorted(map(tuple, want.collect()), key=key) and len(got) > 10


def test_synonyms_are_found_where_the_queries_are(spark):
    # Long texts went out once per key they held, and were shuffled as join keys.
    syn = spark.createDataFrame([(0, "The", ["article"], "abbrev"), (1, "tion", ["motion", "act"], "strong"), (1, "TION", ["upper"], "strong"), (2, "with", ["and"], "weak"), (3, "", ["none"], "weak")], "ord int, key string, words array<string>, cls string")
    texts = ["the motion with", "other with", "", None, "TION the", "other with", "plain"]
    x = catalog.expand_query(spark.createDataFrame(list(enumerate(texts)), "i long, query string"), syn)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert [r.expanded for r in x.orderBy("i").collect()] == ["the motion with article motion act", "other with and", "", None, "TION the article upper", "other with and", "plain"]


def test_texts_go_out_in_bounded_batches(spark, monkeypatch):
    batch = pa.record_batch({"text": [f"{i:04} alpha beta gamma" for i in range(50)] + [None, ""]})
    phrases = type("Sent", (), {"value": ["alpha", "beta", "gamma", "0007"]})
    monkeypatch.setattr(containment, "TEXT_BYTES", 100, raising=False)
    monkeypatch.setattr(blocks, "TEXT_BYTES", 100, raising=False)
    out = list(containment._finder(phrases, 0, "phrase")([batch]))
    assert sum(b.num_rows for b in out) == 151 and max(b.num_rows for b in out) <= 5
    texts = spark.createDataFrame([(f"{i}", "word " * 10 if i % 9 else None, "s") for i in range(40)], "id string, text string, sig string").coalesce(1)
    size = spark.sparkContext.accumulator(0)
    monkeypatch.undo()

    def lengths(part):
        size.add(max(sum(len(t or "") for t in part) > blocks.TEXT_BYTES, 0))
        return retrieval.hashed_vectors(part)

    v = retrieval.embed(texts.withColumn("text", F.expr("repeat(text, 8000)")), lengths, "m").collect()
    assert size.value == 0 and sorted(sum(r.vec) for r in v) == [0.0] * 5 + [80000.0] * 35 and {r.dim for r in v} == {64}


def test_phrases_meet_the_texts_of_their_track_only(spark):
    # 60 tracks with the same texts: pairs of different tracks grew with their square.
    rows = [(k, t) for k in range(60) for t in (f"甲乙丙{chr(0x5000 + k)}", "乙", "甲乙丙", "丁", "")] + [(None, "甲"), (1, None)]
    texts = spark.createDataFrame(rows, "k long, text string")
    got = containment.containments_within(texts, texts.withColumnRenamed("text", "phrase"), ["k"])
    want = {(k, t, p) for k, t in rows for j, p in rows if k is not None and j == k and t and p and p in t}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 60 * 7
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Cartesian" not in plan


def test_matching_takes_one_job(spark):
    # A chain in which every edge waits for the one before took a round of joins per edge.
    edges = spark.createDataFrame([(g, i, j, 2 * i + j - i) for g in (1, 2, None) for i in range(40) for j in (i, i + 1)], "g long, l long, r long, w long").repartition(5)
    plan = matching.greedy_matching(edges, ["g"], "l", "r", ["w", "l", "r"])
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 0 and "Join" not in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert sorted((r.g or 0, r.l, r.r) for r in got) == [(g, i, i) for g in (0, 1, 2) for i in range(40)]


def test_image_hits_score_the_texts_once(spark):
    # The lexical scan ran twice, and an empty table beside each scan was read by Python workers of its own.
    q = spark.createDataFrame([(1, "text"), (1, "text"), (2, "text"), (3, "text"), (4, "id"), (5, "text"), (6, None), (None, "text"), (7, "text")], "qid long, intent string")
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "many"), (3, "alpha"), (4, "alpha"), (5, "none"), (7, "alpha")], "qid long, query string")
    docs = spark.createDataFrame([("a", "alpha"), ("b", "beta"), (None, "alpha many"), ("d", "many"), ("e", "many"), ("f", "")], "id string, name string")
    lex = retrieval.scan_scores(asked, docs, {"name": F.col("name")}, {"name": 3.0}, 0.35, None)
    assert "LogicalRDD" not in lex._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    found = [("a", 0.875), ("b", 0.85), ("f", 0.875), (None, 0.875), ("d", 0.5), ("x", 0.9375)]
    rows = [(k, i, s) for k in (1, 2, 3, 4, 5, 6, None) for i, s in found] + [(7, "a", 0.5), (7, "b", 0.5)]
    hits = spark.createDataFrame(rows, "qid long, id string, score double")
    x = retrieval.append_image_hits(q, lex, hits, gap=0.0625)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.qid: r["count"] for r in lex.groupBy("qid").count().collect()} == {1: 3, 2: 3, 3: 2, 4: 2, 7: 2}
    want = [(3, None, 0.875), (3, "f", 0.875), (3, "x", 0.9375), (5, None, 0.875), (5, "a", 0.875), (5, "f", 0.875), (5, "x", 0.9375)]
    assert sorted(map(tuple, x.collect()), key=lambda r: (r[0], r[1] or "")) == want


def test_vectors_and_many_queries_meet_in_small_pieces(spark, monkeypatch):
    # A piece of 8,192 vectors met 1,024 queries at once, and every pair became a row of one table.
    whole = retrieval.block_products
    counted = lambda left, right, a, b, run, schema, **rows: whole(left, right, a, b, lambda s, q: run(s, q).assign(cos=float(len(s) * len(q))), schema, **rows)
    vec = lambda n, key, name: spark.range(n).select(F.col("id").alias(key), F.expr("array(cos(id), sin(id), 0.5D)").alias(name))
    store, asked = vec(50, "mid", "vec"), vec(600, "qid", "qvec")
    got = {(r.qid, r.mid): r.cos for r in retrieval.score_vectors(asked, store).collect()}
    assert len(got) == 30_000 and all(abs(v - (np.cos(q - m) + 0.25) / 1.25) < 1e-9 for (q, m), v in got.items())
    monkeypatch.setattr(retrieval, "block_products", counted)
    assert retrieval.score_vectors(asked, store).agg(F.max("cos")).first()[0] <= 50 * 128


def coverage_by_loops(cues, shown, thr=0.5):
    """Findings of one track as loops give them; rows are (idx, start_ms, key)."""

    def sim(a, b):
        return 0.0 if not (a and b) else float(a == b) or max(len({*a} & {*b}) / len({*a, *b}), 0.9 * SequenceMatcher(None, a, b).ratio())

    pairs = [(sim(a, b), abs(s - t), i, k, s - t) for i, s, a in cues for k, t, b in shown if sim(a, b) >= thr]
    seen, met = {p[2] for p in pairs}, {p[3] for p in pairs}
    for k, _, b in shown:
        runs = [cues[i : i + n] for i in range(len(cues)) for n in range(1, 7) if i + n <= len(cues)]
        run = None if k in met else next((r for r in runs if sim("".join(x[2] for x in r), b) >= thr), None)
        if run:
            met.add(k)
            seen |= {x[0] for x in run}
    out = {("missing" if len(b) > 1 else "minor", k, None) for k, _, b in shown if k not in met} | {("extra", i, None) for i, *_ in cues if i not in seen}
    left, right = set(), set()
    for s, _, i, k, d in sorted((p for p in pairs if p[0] >= 0.8), key=lambda p: (-round(p[0], 9), *p[1:4])):
        if i not in left and k not in right:
            left.add(i)
            right.add(k)
            out |= {("drift", i, d)} if abs(d) > 600 else set()
    return out


def test_coverage_of_short_and_long_tracks_equals_loops(spark, monkeypatch):
    # Pieces of 3 rows and 8 lines: a track of 60 lines is compared in many of them, runs cross their borders.
    monkeypatch.setattr(matching, "PIECE_ROWS", 3, raising=False)
    monkeypatch.setattr(matching, "RUN_ROWS", 8, raising=False)
    rnd = random.Random(7)
    line = lambda: "".join(rnd.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未") for _ in range(rnd.randint(0, 5)))
    cues, shown = [], []
    for track in range(12):
        own = [(2 * i + (i > 4), 1000 * i, line()) for i in range(60 if track == 5 else rnd.randint(0, 9))]
        cues += [(track, i, s, s + 500, t[:2] + "，" + t[2:] if t else None) for i, s, t in own]
        for k in range(len(own)):
            some = "".join(x[2] for x in own[k : k + rnd.randint(1, 7)]) if k % 2 else line()
            shown.append((track, k, 1000 * k + rnd.randint(-900, 900), 1000 * k + 1500, some))
    shown.append((77, 0, 0, 500, "甲"))
    kind = "track_id long, idx long, start_ms long, end_ms long, text string"
    got = [tuple(r) for r in coverage_rows(*(spark.createDataFrame(x + [(None, 0, 0, 9, "甲乙")], kind) for x in (cues, shown)), chunk=16).collect()]
    want = {(None, "missing", 0, None), (None, "extra", 0, None)}
    for track in {*range(12), 77}:
        own, lines = [[(i, s, (t or "").replace("，", "")) for j, i, s, _, t in x if j == track] for x in (cues, shown)]
        want |= {(track, *x) for x in coverage_by_loops(own, lines)}
    assert len(got) == len({*got}) and {*got} == want and {x[1] for x in want} == {"missing", "minor", "extra", "drift"}


def test_similar_texts_are_not_exploded(spark, monkeypatch):
    # Each text was shuffled several times as one row per character: 80 times its size.
    texts = spark.range(60).selectExpr("id % 5 as k", "substr(sha2(cast(id as string), 256), 1, 4) as text")
    x = similar_texts(texts, texts, ["k"], 0.3)
    assert "split(" not in x._jdf.queryExecution().optimizedPlan().toString()
    pairs = sorted((r.k, r.text_a, r.text_b, round(r.sim, 12)) for r in x.collect())
    monkeypatch.setattr(matching, "CELLS", 7, raising=False)
    monkeypatch.setattr(matching, "LIST_BYTES", 9, raising=False)
    rows = [tuple(r) for r in texts.distinct().collect()]
    small = []
    for k in range(5):
        own = [t for g, t in rows if g == k]
        small += [(k, own[j], own[i], round(s, 12)) for i, j, s in matching._seek(own, 0.3)(own)]
        firsts = {i: min(j for a, j, _ in matching._seek(own, 0.3)(own) if a == i) for i in range(len(own))}
        assert {i: j for i, j, _ in matching._seek(own, 0.3, True)(own)} == firsts
    assert pairs == sorted(small) and len(pairs) > 100


def test_runs_are_formed_in_tracks_with_open_intervals_only(spark, monkeypatch):
    # Every track's cues were joined to runs, six times as long as the texts, though all its intervals had been found.
    def spy(lines, texts, *more):
        tracks.append(sorted(r.track_id for r in lines.select("track_id").distinct().collect()))
        return whole(lines, texts, *more)

    whole, tracks = matching.similar_runs, []
    monkeypatch.setattr(cu, "similar_runs", spy)
    rows = [(k, i, 1000 * i, 1000 * i + 500, f"{chr(0x5000 + 9 * i)}{chr(0x5001 + 9 * i)}") for k in range(4) for i in range(5)]
    both = [(k, 0, 0, 900, "".join(r[4] for r in rows[k * 5 : k * 5 + 3]) if k == 2 else rows[k * 5][4]) for k in range(4)]
    kind = "track_id long, idx long, start_ms long, end_ms long, text string"
    got = coverage_rows(spark.createDataFrame(rows, kind), spark.createDataFrame(both, kind), thr=0.9).collect()
    assert tracks == [[2]] and sorted((r.track_id, r.kind, r.idx) for r in got) == [(k, "extra", i) for k in range(4) for i in range(5) if i >= (3 if k == 2 else 1)]


def test_coverage_report_writes_less_than_the_texts(spark):
    # Texts, then their runs of two to six cues, were written again and again: many times the input.
    rnd = random.Random(5)
    rows = [(k, i, 1000 * i, 1000 * i + 500, "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(400))) for k in range(40) for i in range(6)]
    shown = [r for r in rows if r[1] != 3] + [(k, 9, 9000, 9500, "啊" if k % 2 else "龥啊") for k in range(2)]
    a, b = (spark.createDataFrame(x, "track_id long, idx long, start_ms long, end_ms long, text string") for x in (rows, shown))
    files = lambda: {f: f.stat().st_size for f in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")}
    old = files()
    got = {r.track_id: (r.cues, r.intervals, r.missing, r.minor, r.extra, r.drift, r.matched, r.coverage, r.ok) for r in cu.coverage_report(a, b, coverage_rows(a, b)).collect()}
    assert sum(n for f, n in files().items() if f not in old) < sum(len(r[4].encode()) for r in rows)
    assert got == {k: (6, 5, 0, 0, 1, 0, 5, 1.0, True) for k in range(2, 40)} | {0: (6, 6, 1, 0, 1, 0, 5, 0.8333, False), 1: (6, 6, 0, 1, 1, 0, 5, 1.0, True)}
