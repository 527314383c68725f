"""Cases in which earlier versions were wrong or lost rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from reelgrid.operators import catalog, discovery, frames, jobs
from reelgrid.operators.cues import coverage_rows
from reelgrid.sources.catalog_io import upsert_materials

CUES = "track_id long, idx long, start_ms long, end_ms long, text string"


def slugs(spark, rows):
    df = spark.createDataFrame([("t", i, s) for i, s in enumerate(rows, 1)], "topic_id string, id long, slug string")
    return [r["final"] for r in jobs.unique_slugs(df).orderBy("id").collect()]


def test_slugs_take_the_free_numbers(spark):
    assert slugs(spark, ["a", "a-2", "a", "a", "a"]) == ["a", "a-2", "a-3", "a-4", "a-5"]
    assert slugs(spark, ["a", "a", "a-3", "a", "a-2x", "a-02", "a"]) == ["a", "a-2", "a-3", "a-4", "a-2x", "a-02", "a-5"]
    assert slugs(spark, ["a", "a-2", "a-2", "a"]) == ["a", "a-2", "a-2-2", "a-3"]
    assert slugs(spark, []) == []


def test_a_run_over_a_gap_covers_its_cues(spark):
    """Cues 0, 1, 3, 4; the interval holds the first three lines."""
    rows = [(1, 0, 0, 900, "甲乙丙丁"), (1, 1, 1000, 1900, "戊己庚辛"), (1, 3, 3000, 3900, "壬癸子丑"), (1, 4, 4000, 4900, "寅卯辰巳")]
    iv = spark.createDataFrame([(1, 0, 60_000, 64_000, "甲乙丙丁戊己庚辛壬癸子丑")], CUES)
    got = {(r["kind"], r["idx"]) for r in coverage_rows(spark.createDataFrame(rows, CUES), iv, thr=0.9).collect()}
    assert got == {("extra", 4)}


def test_full_width_text_is_found(spark):
    df = spark.createDataFrame([("ＡＢＣ　ｄｅｆ", "", 0)], "title string, description string, views long")
    assert discovery.relevance(df, "abc").first()["relevance"] >= 100
    art = spark.createDataFrame([(1, "ＡＢＣ", "", "", None)], "id long, title string, summary string, author string, points array<string>")
    assert jobs.feed_rows(art, "ａｂc").count() == 1


def test_upsert_keeps_what_only_the_catalog_has(spark):
    cat = spark.createDataFrame(
        [("m1", "videos", "a.mp4", ".mp4", 1, "h1", ["x"], "", "", "/p/a", "external", "rel/a", "flat2d", "2020-01-01"), ("m2", "docs", "b", "", 2, "h2", ["y"], "d", "s", "", "internal", "rel/b", "f", "2020-01-02")],
        "id string, kind string, name string, ext string, size long, sha256 string, tags array<string>, description string, source string, external_path string, location string, rel_path string, form string, day string",
    ).withColumn("created_at", F.to_timestamp("day"))
    inc = spark.createDataFrame(
        [("i1", "videos", "new.mp4", ".mp4", 9, "h9", ["n"], "text", "", "/p/a", 2), ("i0", "videos", "old.mp4", ".mp4", 8, "h8", ["o"], "", "", "/p/a", 1), ("i2", "docs", "c", "", 2, "h2", ["z"], "other", "", "/p/c", 1), ("i3", "docs", "e", "", 3, "0123456789abcdef", None, None, None, "/p/e", 1)],
        "id string, kind string, name string, ext string, size long, sha256 string, tags array<string>, description string, source string, external_path string, at int",
    )
    out = upsert_materials(cat, inc, "at")
    assert out.columns == [*cat.columns, "op"]
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {"m1", "m2", "0123456789ab"}
    a, b, new = got["m1"], got["m2"], got["0123456789ab"]
    assert (a["op"], a["name"], a["sha256"], a["rel_path"], a["form"], a["day"], sorted(a["tags"])) == ("updated", "new.mp4", "h9", "/p/a", "flat2d", "2020-01-01", ["n", "x"])
    assert (b["op"], b["description"], b["rel_path"], b["form"]) == ("duplicate", "d", "rel/b", "f") and "z" in b["tags"]
    assert (new["op"], new["form"]) == ("added", None) and new["created_at"] is not None


def test_a_parent_cycle_ends(spark):
    m = spark.createDataFrame([("a", ["parent:b"]), ("b", ["parent:a"]), ("c", ["parent:d"]), ("d", ["job:j"])], "id string, tags array<string>")
    assert {r["id"]: r["key"] for r in catalog.ancestors(m).collect()} == {"a": None, "b": None, "c": "j", "d": "j"}


def test_topics_are_no_fixed_number(spark):
    topics = spark.range(20_000).select(F.col("id"), F.lit(0).alias("fresh_hours"))
    c = spark.createDataFrame([(19_999, 1.0), (7, 2.0)], "topic_id long, published_at double")
    assert discovery.filter_fresh(c, topics, 10.0).count() == 2


BOXES = "video_id long, frame long, box long, x0 double, y0 double, x1 double, y1 double"


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    both = max(w, 0) * max(h, 0)
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    return both / (area(a) + area(b) - both) if area(a) + area(b) - both > 0 else 0


def brute_nms(rows, thr):
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[5] - r[3]) * (r[6] - r[4]), r[2])):
        if all(k[0] != r[0] or iou(k, r) < thr for k in kept):
            kept.append(r)
    return kept


def test_boxes_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for v in (1, 2):
        for _ in range(80):
            x, y = rnd.randrange(0, 200, 20), rnd.randrange(0, 100, 20)
            rows.append((v, rnd.randrange(4), len(rows), float(x), float(y), float(x + rnd.choice([0, 30, 60])), float(y + rnd.choice([20, 40]))))
    df = spark.createDataFrame(rows, BOXES)
    assert {r["box"] for r in frames.nms(df, 0.5).collect()} == {r[2] for r in brute_nms(rows, 0.5)}
    again = [r for r in rows if any(q[0] == r[0] and q[1] != r[1] and iou(q, r) >= 0.35 for q in rows)]
    want = set()
    for v in (1, 2):
        own = sorted((r for r in brute_nms(again, 0.5) if r[0] == v), key=lambda r: (-(r[5] - r[3]) * (r[6] - r[4]), r[2]))
        want |= {r[2] for r in own[:4]}
    assert {r["box"] for r in frames.stable_boxes(df, 0.35, 0.5, 4).collect()} == want


def test_a_box_in_many_frames_is_one_rectangle(spark):
    df = spark.range(10_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame"), F.col("id").alias("box"), *[F.lit(float(x)).alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), (10, 10, 90, 40))])
    assert frames._rectangles(df).count() == 1
    assert frames.rect_overlaps(frames._rectangles(df), 0.35).count() == 0
    assert [r["box"] for r in frames.stable_boxes(df).collect()] == [0]
