"""Readers and writers on real files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from reelgrid.sources import catalog_io as ci
from reelgrid.sources import cues_io as qi
from reelgrid.sources import documents as dm
from reelgrid.sources.candidates_source import SavedCandidates


def test_captions_round_trip(spark, tmp_path):
    rows = [("t", i, i * 1000, i * 1000 + 900, f"line {i}") for i in range(5)]
    cues = spark.createDataFrame(rows, "track_id string, idx long, start_ms long, end_ms long, text string").withColumn("no", F.col("idx") + 1)
    qi.write_cues(cues, str(tmp_path / "out"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "out" / "track_id=t").glob("part-*")))
    (tmp_path / "t.srt").write_text(text)
    got = qi.read_cues(spark, str(tmp_path / "t.srt")).orderBy("start_ms").collect()
    assert [(r["track_id"], r["start_ms"], r["end_ms"], r["text"]) for r in got] == [(t, s, e, x) for t, _, s, e, x in rows]


def test_files_sidecars_documents_and_logs(spark, tmp_path):
    for folder, name, body in [("ocr", "a1.txt", "hello"), ("autotags", "a1.json", json.dumps({"verified": [{"zh": "猫", "en": "cat"}], "auto": []}))]:
        (tmp_path / "side" / folder).mkdir(parents=True)
        (tmp_path / "side" / folder / name).write_text(body)
    got = {(r["id"], r["channel"], r["text"]) for r in ci.read_sidecars(spark, str(tmp_path / "side")).collect()}
    assert got == {("a1", "ocr", "hello"), ("a1", "autotags", "猫 cat")}
    assert ci.scan_files(spark, str(tmp_path / "side")).where("length(id) = 12").count() == 2
    docs = dm.read_documents(spark, [(str(tmp_path / "side" / "ocr"), "x"), (str(tmp_path / "nowhere"), "y")])
    assert [(r["text"], r["label"]) for r in docs.collect()] == [("hello", "x")]
    (tmp_path / "log.jsonl").write_text('{"ts":"2024-01-01T00:00:00","kind":"a","duration_ms":1.5,"ok":true}\nnot json\n')
    assert dm.read_event_log(spark, str(tmp_path / "log.jsonl")).count() == 1


def test_saved_candidates_source(spark, tmp_path):
    (tmp_path / "c" / "youtube").mkdir(parents=True)
    (tmp_path / "c" / "youtube" / "a.jsonl").write_text('{"id":"v1","title":"T","view_count":"1.2万","duration":"1:30"}\nbad\n{"id":"v2","title":"[Deleted video]"}\n')
    spark.dataSource.register(SavedCandidates)
    items = spark.read.format("saved_candidates").load(str(tmp_path / "c"))
    got = dm.to_candidates(items.where("platform = 'youtube'"), "youtube").collect()
    assert [(r["video_id"], r["views"], r["duration_sec"]) for r in got] == [("v1", 12000, 90)]
