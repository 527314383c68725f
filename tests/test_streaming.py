"""Streams over files end with the result of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.operators import jobs as jb
from reelgrid.operators import metrics as mt
from reelgrid.streaming import jobs as sj
from reelgrid.streaming import keyed as kd


def _log(spark, tmp_path):
    rows = spark.range(400).select(
        F.timestamp_seconds(1704067200 + F.col("id") * 7).alias("ts"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("kind"),
        (F.col("id") % 37).cast("double").alias("duration_ms"), (F.col("id") % 5 != 0).alias("ok"), (F.col("id") % 3 == 0).alias("zero_hit"))
    path = str(tmp_path / "log")
    rows.repartition(4).write.json(path)
    return rows, path


def _memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_metrics(spark, tmp_path):
    rows, path = _log(spark, tmp_path)
    got = _memory(sj.windowed_metrics(sj.read_events(spark, path), "1 minute"), "w1", "complete").agg(F.sum("count"), F.sum("errors"), F.sum("zero_hits")).first()
    assert tuple(got) == (400, 80, 134)


def _updates(df, path, key):
    """The last row of each key that a stream in update mode gives, and its batches."""
    rows, batches = {}, []

    def batch(part, epoch):
        found = part.collect()
        batches.append(len(found))
        rows.update({r[key]: r.asDict() for r in found})

    df.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination()
    return rows, batches


def test_recent_latency(spark, tmp_path):
    kd.keyed_state(spark)
    rows, path = _log(spark, tmp_path)
    stream = spark.readStream.schema(schemas.EVENT_LOG).option("maxFilesPerTrigger", 1).json(path)
    got, batches = _updates(kd.recent_latency(stream, 50), tmp_path / "cp", "kind")
    want = mt.recent_metrics(rows.withColumn("event_id", F.lit(0)), 50, [F.desc("ts"), F.desc("duration_ms")])
    assert {(r["kind"], r["ms_p50"], r["ms_p95"], r["n"]) for r in got.values()} == {(r["kind"], r["ms_p50"], r["ms_p95"], 50) for r in want.collect()}
    assert len(batches) > 1
    # Started again, the stream has nothing to tell and its state is still there.
    assert _updates(kd.recent_latency(stream, 50), tmp_path / "cp", "kind")[0] == {}


def test_job_status(spark, tmp_path):
    kd.keyed_state(spark)
    ev = spark.range(300).select((F.col("id") % 7).alias("job_id"), (F.col("id") % 3).alias("step_key"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
                                 F.element_at(F.array(*[F.lit(s) for s in ["done", "failed", "skipped", "running", None]]), (F.col("id") % 5 + 1).cast("int")).alias("status"))
    ev.repartition(3).write.json(str(tmp_path / "steps"))
    stream = spark.readStream.schema(schemas.STEP_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "steps"))
    got, batches = _updates(kd.job_status(stream), tmp_path / "cp", "job_id")
    want = {r["job_id"]: r.asDict() for r in jb.rollup_jobs(jb.latest_steps(ev.where("status is not null"))).collect()}
    assert got == want and len(batches) > 1


def test_silent_jobs_and_what_falls_with_them(spark, tmp_path):
    kd.keyed_state(spark)
    rows = [(1, 0, 1, 0, "running"), (1, 0, 2, 60, "running"), (2, 0, 3, 0, "running"), (2, 0, 4, 30, "done"), (5, 0, 6, 10, "queued"), (3, 0, 5, 90_000, "running")]
    df = spark.createDataFrame(rows, "job_id long, step_key long, event_id long, s long, status string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.json(str(tmp_path / "p"))
    jobs = spark.createDataFrame([(9, 1, "processing", []), (9, 10, "pending", [1]), (9, 11, "pending", [10]), (9, 12, "pending", [2]), (9, 2, "done", []), (9, 5, "done", []), (9, 13, "pending", [5]), (9, 20, "failed", []), (9, 21, "pending", [20])],
                                 "pack_id long, workflow long, status string, depends_on array<long>")
    out = []
    stream = spark.readStream.schema(schemas.STEP_EVENT).json(str(tmp_path / "p"))
    kd.fail_silent_jobs(kd.silent_jobs(stream, 900), lambda: jobs, lambda x, e: out.extend(x.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["workflow"], r["cause"]) for r in out) == [(1, "silent"), (10, "dependency"), (11, "dependency")]


def test_alerts_are_told_once(spark, tmp_path):
    rows = [(0, "a", 10.0, False), (5, "a", 10.0, True), (10, "b", 900.0, True), (70, "b", 1.0, True), (100_000, "z", 1.0, True)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "s long, kind string, duration_ms double, ok boolean").select(F.timestamp_seconds("s").alias("ts"), "kind", "duration_ms", "ok").coalesce(1).write.json(str(tmp_path / "log" / f"{n}"))
    stream = spark.readStream.schema(schemas.EVENT_LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "log"))
    for _ in range(2):  # run again, the table stays as it is
        sj.append_once(sj.alert_stream(stream, 0.2, 500.0), str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
        got = [(r["kind"], r["rule"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()]
        assert sorted(got) == [("a", "error_rate"), ("b", "slow")]


def test_stale_jobs(spark, tmp_path):
    rows = [(1, 0, 1, 0, "running"), (1, 0, 2, 60, "running"), (2, 0, 3, 0, "running"), (2, 0, 4, 30, "done"), (3, 0, 5, 90_000, "running")]
    df = spark.createDataFrame(rows, "job_id long, step_key long, event_id long, s long, status string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.json(str(tmp_path / "p"))
    stream = spark.readStream.schema(schemas.STEP_EVENT).json(str(tmp_path / "p"))
    got = _memory(sj.stale_jobs(stream), "stale")
    assert [r["job_id"] for r in got.collect()] == [1]


def test_online_intervals(spark, tmp_path):
    rows = [(1, 0, i * 200, "甲乙丙") for i in range(5)] + [(1, 0, 1000 + i * 200, "丁戊己") for i in range(3)] + [(9, 0, 90_000_000, "末")]
    df = spark.createDataFrame(rows, "video_id long, track long, ms long, text string").select("video_id", "track", F.timestamp_millis(F.col("ms") + 10_000).alias("ts"), "text")
    df.write.json(str(tmp_path / "l"))
    stream = spark.readStream.schema(schemas.LINE_EVENT).json(str(tmp_path / "l"))
    got = {tuple(r) for r in _memory(sj.online_intervals(stream), "iv").collect() if r["video_id"] == 1}
    assert got == {(1, 0, 10000, 10800, "甲乙丙"), (1, 0, 11000, 11400, "丁戊己")}


def test_alerts_and_vetoes(spark, tmp_path):
    m = spark.createDataFrame([("w", "a", 10, 5, 100.0), ("w", "b", 10, 0, 1.0)], "window_start string, kind string, count long, errors long, ms_p95 double")
    assert [(r["kind"], r["rule"]) for r in sj.alerts(m, 0.2, 50.0).collect()] == [("a", "error_rate"), ("a", "slow")]
    spark.createDataFrame([("chicken wings",), ("beef",), ("win",), (" ",)], "query string").write.json(str(tmp_path / "q"))
    feedback = spark.createDataFrame([("wings", "", False), ("x", "wins", False), ("beef", "", True)], "query string, proposed_query string, accepted boolean")
    out = []
    sj.vetoed_queries(spark.readStream.schema("query string").json(str(tmp_path / "q")), lambda: feedback, lambda df, e: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in out) == [" ", "beef"]


def test_near_dup_check(spark, tmp_path):
    store = spark.createDataFrame([(1, 0b1111), (2, 1 << 40), (3, 0b1110)], "id long, h long")
    spark.createDataFrame([(100, 0b1111)], "qid long, qh long").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, qh long").json(str(tmp_path / "in"))
    out = []
    sj.near_dup_check(stream, lambda: store, lambda df, e: out.extend(df.collect()), str(tmp_path / "cp"), d=2).awaitTermination()
    assert [(r["id"], r["dist"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 0), (3, 1)]


def test_catalog_sync_is_idempotent_per_content(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, body in [("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")]:
        (tmp_path / "files" / name).write_text(body)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(tmp_path / "files"))

    def prepare(inv):
        return inv.select("id", F.lit("docs").alias("kind"), F.lit("n").alias("name"), F.lit(".txt").alias("ext"), "size", "sha256",
                          F.array(F.lit("type:text")).alias("tags"), F.lit("").alias("description"), F.lit("").alias("source"), F.col("path").alias("external_path"))

    sj.catalog_sync(stream, str(tmp_path / "cat"), prepare, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cat" / "gen=0")).count() == 2


def test_fingerprint_watch_logs_changes_only(spark, tmp_path):
    catalog = spark.createDataFrame([("a", 1)], "id string, size long")
    spark.range(3).repartition(3).write.json(str(tmp_path / "ch"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "ch"))
    sj.fingerprint_watch(stream, lambda: catalog, ["id", "size"], str(tmp_path / "fp"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "fp")).count() == 1


def test_joined_passes(spark, tmp_path):
    kind = "video_id long, idx long, ts timestamp, end_ts timestamp, text string"
    for side, shift in (("a", 0), ("b", 1)):
        spark.range(4).select(F.lit(1).alias("video_id"), F.col("id").alias("idx"), F.timestamp_seconds(F.col("id") * 5 + shift + 100).alias("ts"),
                              F.timestamp_seconds(F.col("id") * 5 + shift + 102).alias("end_ts"), F.lit("x").alias("text")).write.json(str(tmp_path / side))
    a, b = (spark.readStream.schema(kind).json(str(tmp_path / s)) for s in ("a", "b"))
    got = _memory(sj.joined_passes(a, b), "jp")
    assert {(r["a_idx"], r["b_idx"]) for r in got.collect()} == {(i, i) for i in range(4)}
