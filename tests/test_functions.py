"""Literal fixtures of the scalar functions and small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import language as lg
from reelgrid.functions import parse as ps
from reelgrid.functions import tags as tg
from reelgrid.operators import cues as cu
from reelgrid.operators import dedup as dd
from reelgrid.operators import retrieval as rt
from reelgrid.sources import cues_io as qi
from reelgrid.sources import documents as dm


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_counts(spark):
    raw = ["1.2万", "3万", "1亿", "12,345", "5.87M", "938.5K", "", "abc"]
    assert one(spark, raw, ps.parse_count) == [12000, 30000, 100000000, 12345, 5870000, 938500, None, None]


def test_durations(spark):
    assert one(spark, ["PT1H2M3S", "PT1M30S", "1:30", "01:02:03", "90", "x:y", ""], ps.parse_duration) == [3723, 90, 90, 3723, 90, None, None]


def test_times(spark):
    got = one(spark, ["1700000000", "1700000000000", "12", "2024-01-01T00:00:10Z", "20240101"], ps.parse_unix)
    assert got == [1700000000.0, 1700000000.0, None, 1704067210.0, None]
    assert one(spark, ["20240101", "2024-01-01"], ps.parse_iso) == [1704067200.0, 1704067200.0]


def test_csv_tags_are_trimmed(spark):
    assert one(spark, [" a, b ,,c "], tg.csv_to_tags) == [["a", "b", "c"]]


def test_role_exclusion(spark):
    df = spark.createDataFrame([(["role:master", "x", "role:clip"], "videos"), (["x"], "videos"), (["x", "has_audio:0"], "videos")], "t array<string>, k string")
    got = [r[0] for r in df.select(tg.coerce_roles("t", "k")).collect()]
    assert got == [["x", "role:clip", "type:clip"], ["x", "role:master", "role:picture"], ["x", "has_audio:0", "role:master"]]


def test_srt_suffix_and_empty_body(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000 X1:1 X2:2\nHello\nworld\n\n2\n00:00:03,000 --> 00:00:04,000\n\n"
    df = spark.createDataFrame([("t", text)], "track_id string, text string")
    assert [(r["start_ms"], r["end_ms"], r["text"]) for r in qi.parse_cues(df).collect()] == [(1000, 2000, "Hello world")]


def test_timing_overlap_fixture(spark):
    rows = [(1, 0, 0, 2000, "a"), (1, 1, 1000, 3000, "b"), (1, 2, 3000, 3200, "c"), (1, 3, 5000, 20000, "d")]
    df = spark.createDataFrame(rows, "track_id long, idx long, start_ms long, end_ms long, text string")
    got = cu.normalize_timing(df).orderBy("start_ms").collect()
    assert len(got) == 4 and all(a["end_ms"] <= b["start_ms"] for a, b in zip(got, got[1:]))
    assert got[2]["end_ms"] - got[2]["start_ms"] >= 790
    assert got[3]["start_ms"] == 5000 and got[3]["end_ms"] - got[3]["start_ms"] <= 7010


def test_flicker_fixture(spark):
    rows = [(1, 0, 35000, 36000, "打死他打死他"), (1, 1, 36100, 37200, "打死他打死他"), (1, 2, 37300, 38000, "打死他")]
    df = spark.createDataFrame(rows, "track_id long, idx long, start_ms long, end_ms long, text string")
    assert [(r["start_ms"], r["end_ms"]) for r in cu.merge_flicker(df).orderBy("start_ms").collect()] == [(35000, 37200), (37300, 38000)]


def test_shared_idiom(spark):
    pairs = ("义风绝无", "義風絕無")
    df = spark.createDataFrame([("忠孝節義", "威风八面"), ("威風八面", "威风八面"), ("絶無二心", "绝无二心")], "t string, s string")
    assert [r[0] for r in df.select(lg.shared_idiom("t", "s", pairs)).collect()] == [True, False, False]


def test_pollution(spark):
    got = one(spark, ["BV14hAEzRENh 你好", "try:abc", "{'zh': '好'}", "https://a.b/c", "see https://a.b now", "台词"], lg.is_polluted)
    assert got == [True, True, True, True, False, False]


def test_phash_fixture(spark):
    rows = [("me", "ffffffffffffffff"), ("a1", "0000000000000000"), ("b1", "ffffffffffffff00"), ("c1", "fffffffffffffe00"), ("b2", "ffffffffffffff00")]
    df = spark.createDataFrame(rows, "id string, hex string").select("id", dd.hash_from_hex("hex").alias("h"))
    assert {(r["a"], r["b"], r["dist"]) for r in dd.near_dup_pairs(df, 10).collect()} == {
        ("b1", "me", 8), ("b2", "me", 8), ("c1", "me", 9), ("b1", "c1", 1), ("b2", "c1", 1), ("b1", "b2", 0)}
    assert dd.pair_count(df, 10).first()["pairs"] == 6
    assert {r["id"] for r in dd.clusters(df, 10).collect()} == {"me", "b1", "b2", "c1"}
    assert [tuple(r) for r in dd.near_dup_pairs(df, 10, 2).collect()] == [("b1", "b2", 0), ("b1", "c1", 1)]


def test_hash_pairs_brute_force(spark):
    import random

    rnd = random.Random(9)
    base = [rnd.getrandbits(63) for _ in range(20)]
    hs = base + [b ^ sum(1 << rnd.randrange(63) for _ in range(rnd.randint(1, 9))) for b in base for _ in range(3)]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "id long, h long")
    for d in (0, 3, 6, 10, 13):
        want = {(min(a, b), max(a, b)) for a in set(hs) for b in set(hs) if a != b and bin(a ^ b).count("1") <= d}
        rows = dd.hash_pairs(df, d).collect()
        assert {(r["h_a"], r["h_b"]) for r in rows} == want and len(rows) == len(want)


def test_dhash_pixels(spark):
    df = spark.createDataFrame([(bytes(range(72)),), (bytes(range(72, 0, -1)),), (b"short",)], "b binary")
    assert [r[0] for r in df.select(dd.dhash("b")).collect()] == [0, -1, None]


def test_chunk_paragraphs_against_a_loop(spark):
    def loop(text, size=140, overlap=30):
        import re

        chunks, buf = [], ""
        for p in [p.strip() for p in re.split(r"\n+", text) if p.strip()]:
            if len(buf) + len(p) <= size:
                buf = (buf + "\n" + p).strip()
                continue
            if buf:
                chunks.append(buf)
                buf = ""
            if len(p) <= size:
                chunks.append(p)
                continue
            for s in (s.strip() for s in re.split(r"(?<=[。！？!?；;])", p)):
                if s:
                    chunks += [s] if len(s) <= size else [s[i : i + size] for i in range(0, len(s), size - overlap)]
        return chunks + ([buf] if buf else [])

    texts = ["", "a\n\nb", "x" * 400, ("句子。" * 60) + "\n" + "y" * 100 + "\n" + "z" * 100, "k" * 139 + "\nq"]
    assert one(spark, texts, rt.chunk_paragraphs) == [loop(t) for t in texts]


def test_chunk_lines(spark):
    assert one(spark, ["aaaa\nbbbb\ncc", "x" * 20], lambda c: rt.chunk_lines(c, 9)) == [["aaaa\nbbbb"[:9], "cc"], ["x" * 20]]


def test_watch_page(spark):
    ld = '<script type="application/ld+json">{"uploadDate":"2024-01-01","duration":"PT1M30S","author":{"name":"HackChannel"},"interactionStatistic":[{"interactionType":"WatchAction","userInteractionCount":12345}]}</script>'
    page = '{"viewCount":"99901","lengthSeconds":"75","ownerChannelName":"Own"}'
    df = spark.createDataFrame([(1, ld), (2, page)], "page_id long, html string")
    got = {r["page_id"]: r for r in dm.watch_meta(df).collect()}
    assert (got[1]["views"], got[1]["duration_sec"], got[1]["author"]) == (12345, 90, "HackChannel")
    assert (got[2]["views"], got[2]["duration_sec"], got[2]["author"]) == (99901, 75, "Own")


def test_loose_match_only_without_exact_hit(spark):
    q = spark.createDataFrame([(1, "mosaic")], "qid long, query string")
    d = spark.createDataFrame([("a", "demosaic tool"), ("b", "mosaic demosaic"), ("c", "none")], "id string, description string")
    got = {r["id"]: round(r["score"], 6) for r in rt.lexical_scores(q, d, {"description": F.col("description")}).collect()}
    assert got == {"a": 0.9, "b": 1.5}


def test_coverage_reports_missing_and_drift(spark):
    kind = "track_id long, idx long, start_ms long, end_ms long, text string"
    cues = spark.createDataFrame([(1, 0, 0, 900, "甲乙丙"), (1, 1, 1000, 1900, "丁戊"), (1, 2, 9000, 9900, "天地玄黄")], kind)
    iv = spark.createDataFrame([(1, 0, 0, 1900, "甲乙丙丁戊"), (1, 1, 5000, 6000, "宇宙洪荒"), (1, 2, 5300, 6300, "天地玄黄"), (1, 3, 7000, 7100, "啊")], kind)
    rows = {(r["kind"], r["idx"], r["delta_ms"]) for r in cu.coverage_rows(cues, iv).collect()}
    assert rows == {("missing", 1, None), ("minor", 3, None), ("drift", 2, 3700)}
