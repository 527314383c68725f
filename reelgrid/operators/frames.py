"""Boxes and lines per video frame: targets, watermarks, lines, tracks, scenes."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelgrid.functions.similarity import alike, iou
from reelgrid.functions.text import text_or_empty
from reelgrid.operators.cues import _norm_py, merge_flicker
from reelgrid.operators.scale import CHUNK_ROWS, Rows, chunked_fold, join_keys, neighbours, positions, running, stable, top_k

# Cell sizes in pixels and shares that define a resident mark,
# a line break and a track.
POSITION_CELL = 20
TEXT_CELL = 24
RESIDENT_SHARE = 0.5
LINE_GAP = 0.9
TRACK_SHIFT = 0.35

VIDEO = ["video_id"]
BOX = ["x0", "y0", "x1", "y1"]


def target_boxes(boxes: DataFrame, regions: Sequence[tuple[float, float, float, float]], stems: Sequence[str]) -> DataFrame:
    """Boxes that touch a region, start with ``*`` or carry a caption stem."""
    hit = text_or_empty("text").startswith("*")
    for s in stems:
        hit = hit | text_or_empty("text").contains(s)
    for x0, y0, x1, y1 in regions:
        hit = hit | ~((F.col("x1") < x0) | (F.col("x0") > x1) | (F.col("y1") < y0) | (F.col("y0") > y1))
    return boxes.where(hit)


def centre_inside(x: Column, y: Column, boxes: Column) -> Column:
    return F.exists(boxes, lambda b: (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"]))


def drop_resident(boxes: DataFrame) -> DataFrame:
    """Remove boxes whose height on screen, or text and height, fills over half of the frames."""
    mid = (F.col("y0") + F.col("y1")) / 2
    text = F.substring(F.regexp_replace(text_or_empty("text"), r"\s+", ""), 1, 6)
    cell = (F.floor(mid / TEXT_CELL) + F.floor((F.col("y1") - F.col("y0")) / TEXT_CELL)).cast("long")
    x = boxes.withColumn("__pos", F.floor(mid / POSITION_CELL)).withColumn("__txt", F.xxhash64(text, cell))
    frames = boxes.groupBy("video_id").agg(F.countDistinct("frame").alias("__frames"))

    def resident(key: str) -> DataFrame:
        n = x.groupBy("video_id", key).agg(F.count(F.lit(1)).alias("__n"))
        return n.join(frames, "video_id").where(F.col("__n") > RESIDENT_SHARE * F.col("__frames")).select("video_id", key)

    kept = x.join(resident("__pos"), ["video_id", "__pos"], "left_anti").join(resident("__txt"), ["video_id", "__txt"], "left_anti")
    return kept.select(*boxes.columns)


def cluster_lines(boxes: DataFrame) -> DataFrame:
    """Blocks of text lines per frame, split at vertical gaps; texts in (y, x) order."""
    w = Window.partitionBy("video_id", "frame").orderBy("y0", "x0", "y1", "x1", "text")
    gap = F.col("y0") - F.lag("y1").over(w)
    tall = F.greatest(F.lag("y1").over(w) - F.lag("y0").over(w), F.lit(1.0))
    x = boxes.withColumn("__new", F.coalesce(gap > tall * LINE_GAP, F.lit(False)).cast("int"))
    x = x.withColumn("block", F.sum("__new").over(w))
    parts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "y1", "x1", "text"))), lambda r: r["text"]), lambda t: t != "")
    return x.groupBy("video_id", "frame", "block").agg(
        F.trim(F.array_join(parts, " ")).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


_TRACKED = T.StructType([T.StructField("frame", T.LongType()), T.StructField("block", T.LongType()), T.StructField("track", T.LongType())])


def assign_tracks(blocks: DataFrame, chunk_frames: int = CHUNK_ROWS) -> DataFrame:
    """Track number per block: the nearest track whose centre moved little, else a new one."""

    def step(rows: Rows, state: str | None, last: bool):
        centre, height = (np.array(x, float) for x in (json.loads(state) if state else ([], [])))
        out = []
        for r in rows:
            own, tall = (r["y0"] + r["y1"]) / 2, max(1.0, r["y1"] - r["y0"])
            away = np.abs(centre - own)
            away[away > TRACK_SHIFT * np.maximum(1.0, np.minimum(height, tall))] = np.inf
            if np.isfinite(away).any():
                near = int(away.argmin())
                centre[near] += 0.1 * (own - centre[near])
                height[near] = max(height[near], tall)
            else:
                near, centre, height = len(centre), np.append(centre, own), np.append(height, tall)
            out.append({"frame": r["frame"], "block": r["block"], "track": near})
        return out, json.dumps([centre.tolist(), height.tolist()])

    x = blocks.withColumn("__chunk", F.floor(F.col("frame") / chunk_frames))
    t = chunked_fold(x, VIDEO, "__chunk", ["frame", "block"], step, _TRACKED)
    return join_keys(blocks, t, ["video_id", "frame", "block"])


_RUN = T.StructType(
    [T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("text", T.StringType())]
)


def frames_to_intervals(lines: DataFrame, frame_ms: int, min_ms: int = 150, chunk_frames: int = CHUNK_ROWS) -> DataFrame:
    """Runs of similar text per video and track (``lines``: video_id, track, frame, text).

    A run ends at a frame without text or with a text unlike the run's first.
    """
    keys = ["video_id", "track"]
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda r: r["text"]), " ")
    one = lines.groupBy(*keys, "frame").agg(F.trim(texts).alias("text")).where("text <> ''")

    def step(rows: Rows, state: str | None, last: bool):
        run = json.loads(state) if state else None
        out = []
        for r in rows:
            frame, text = int(r["frame"]), r["text"]
            if run is not None and frame == run["last"] + 1 and alike(_norm_py(text), _norm_py(run["text"]), 0.8):
                run["last"] = frame
                continue
            if run is not None:
                out.append(run)
            run = {"text": text, "first": frame, "last": frame}
        if last and run is not None:
            out.append(run)
            run = None
        done = [{"start_ms": r["first"] * frame_ms, "end_ms": r["last"] * frame_ms, "text": r["text"]} for r in out]
        return done, None if run is None else json.dumps(run, ensure_ascii=False)

    x = one.withColumn("__chunk", F.floor(F.col("frame") / chunk_frames))
    runs = chunked_fold(x, keys, "__chunk", ["frame"], step, _RUN)
    runs = runs.where(F.col("end_ms") - F.col("start_ms") >= min_ms).withColumn("idx", F.col("start_ms"))
    return merge_flicker(runs, keys=keys)


def _side(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select("video_id", F.col("frame").alias(f"{p}frame"), F.col("box").alias(f"{p}box"), *[F.col(c).alias(f"{p}{c}") for c in BOX])


def smooth_boxes(boxes: DataFrame, thr: float = 0.3) -> DataFrame:
    """Boxes with a similar box in the frame before or after."""
    a = boxes.select("*", F.explode(F.expr("array(-1, 1)")).alias("d")).withColumn("near", F.col("frame") + F.col("d"))
    a = a.select("video_id", "near", F.col("frame").alias("aframe"), F.col("box").alias("abox"), *[F.col(c).alias(f"a{c}") for c in BOX])
    b = _side(boxes, "b").withColumnRenamed("bframe", "near")
    hit = a.join(b, ["video_id", "near"]).where(iou("a", "b") >= thr)
    return boxes.join(hit.select("video_id", F.col("aframe").alias("frame"), F.col("abox").alias("box")).distinct(), ["video_id", "frame", "box"], "left_semi")


def _tiles(x0: Column, y0: Column, x1: Column, y1: Column, size: int) -> Column:
    tx = F.sequence(F.floor(x0 / size), F.floor(x1 / size))
    ty = F.sequence(F.floor(y0 / size), F.floor(y1 / size))
    return F.explode(F.flatten(F.transform(tx, lambda i: F.transform(ty, lambda j: F.struct(i.alias("tx"), j.alias("ty"))))))


def _rectangles(boxes: DataFrame) -> DataFrame:
    """Distinct rectangles of a video: rect (the smallest box id), first and last frame.

    A box that stays for many frames is one row.  Boxes without area overlap
    nothing, not even each other, and stay apart.
    """
    alone = F.when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), F.col("box"))
    return boxes.groupBy("video_id", *BOX, alone.alias("alone")).agg(F.min("box").alias("rect"), F.min("frame").alias("lo"), F.max("frame").alias("hi")).drop("alone")


def rect_overlaps(rects: DataFrame, thr: float, tile: int = 64) -> DataFrame:
    """video_id, rect, other: pairs of different rectangles of one video with IoU >= thr,
    found through shared screen tiles."""
    def side(p: str) -> DataFrame:
        s = rects.select("video_id", F.col("rect").alias(f"{p}rect"), *[F.col(c).alias(f"{p}{c}") for c in BOX])
        return s.withColumn("tile", _tiles(*[F.col(f"{p}{c}") for c in BOX], tile))

    x = side("a").join(side("b"), ["video_id", "tile"]).where((F.col("arect") != F.col("brect")) & (iou("a", "b") >= thr))
    first = F.struct(F.floor(F.greatest("ax0", "bx0") / tile).alias("tx"), F.floor(F.greatest("ay0", "by0") / tile).alias("ty"))
    return x.where(F.col("tile") == first).select("video_id", F.col("arect").alias("rect"), F.col("brect").alias("other"))


def stable_boxes(boxes: DataFrame, thr: float = 0.35, nms_thr: float = 0.5, k: int = 4) -> DataFrame:
    """Boxes seen again in another frame, overlapping ones reduced to the largest, at most ``k``.

    A rectangle's box in frame f is seen again when the frames of it and of the
    rectangles like it are not all f.
    """
    rects = stable(_rectangles(boxes))
    frames = rects.select("video_id", F.col("rect").alias("other"), "lo", "hi")
    around = rect_overlaps(rects, thr).join(frames, ["video_id", "other"]).select("video_id", "rect", "lo", "hi")
    seen = around.unionByName(rects.select("video_id", "rect", "lo", "hi")).groupBy("video_id", "rect").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    seen = rects.join(seen, ["video_id", "rect"]).where(F.col("__lo") < F.col("__hi")).select("video_id", *BOX, "rect", "__lo", "__hi")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    own = boxes.join(seen, ["video_id", *BOX]).where((area > 0) | (F.col("box") == F.col("rect"))).where((F.col("__lo") != F.col("frame")) | (F.col("__hi") != F.col("frame")))
    kept = nms(own.select(*boxes.columns), nms_thr)
    return top_k(kept, VIDEO, [F.desc(area), F.col("box")], k)


def nms(boxes: DataFrame, thr: float = 0.5) -> DataFrame:
    """Greedy suppression per video: the largest box wins over boxes with IoU >= thr.

    Of equal boxes the first wins, so only distinct rectangles compete, in
    rounds of joins: one with no larger open neighbour is kept and removes its
    neighbours, until none is open.
    """
    boxes = stable(boxes)
    rects = stable(_rectangles(boxes))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    open_ = stable(rects.select("video_id", "rect", F.struct((-area).alias("a"), F.col("rect")).alias("prio")))
    edges = stable(rect_overlaps(rects, thr))
    kept = open_.select("video_id", "rect").limit(0)
    while not open_.isEmpty():
        around = edges.join(open_.select("video_id", F.col("rect").alias("other"), F.col("prio").alias("oprio")), ["video_id", "other"])
        best = around.groupBy("video_id", "rect").agg(F.min("oprio").alias("oprio"))
        won = stable(join_keys(open_, best, ["video_id", "rect"]).where(F.col("oprio").isNull() | (F.col("prio") < F.col("oprio"))).select("video_id", "rect"))
        kept = kept.unionByName(won)
        gone = edges.join(won, ["video_id", "rect"], "left_semi").select("video_id", F.col("other").alias("rect")).unionByName(won).distinct()
        open_ = stable(open_.join(gone, ["video_id", "rect"], "left_anti"))
    return boxes.join(kept.withColumnRenamed("rect", "box"), ["video_id", "box"], "left_semi")


def removal_qc(diffs: DataFrame, miss_thr: float = 12.0, damage_thr: float = 12.0) -> DataFrame:
    """Targets that hardly changed and other boxes that did, per video."""
    return diffs.groupBy("video_id").agg(
        F.count_if(F.col("is_target") & (F.col("diff") < miss_thr)).alias("missed"),
        F.count_if(~F.col("is_target") & (F.col("diff") > damage_thr)).alias("damaged"),
    )


def band_scores(pixels: DataFrame) -> DataFrame:
    """Caption-band statistics of gray pixel arrays: mean, std, bright share, score."""
    p, n = F.col("pixels"), F.size("pixels")
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / n
    x = pixels.withColumn("mean", mean)
    std = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / n)
    x = x.withColumn("std", std).withColumn("bright", F.size(F.filter(p, lambda v: v >= 200)) / n)
    score = F.when(F.col("bright") > 0.5, 0.0).otherwise(F.least(F.lit(1.0), F.col("bright") * 5.0 + F.least("std", F.lit(70.0)) / 140.0))
    return x.withColumn("score", F.round(score, 4)).drop("pixels")


def band_verdict(scores: DataFrame) -> DataFrame:
    x = scores.groupBy("video_id").agg(F.avg("score").alias("avg"), F.count_if(F.col("score") >= 0.28).alias("hits"), F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    return x.select("video_id", F.round("avg", 4).alias("score"), "hits", ((F.col("avg") >= 0.24) & (F.col("hits") >= need)).alias("detected"))


def interpolate_boxes(frames: DataFrame, samples: DataFrame, chunk_frames: int = CHUNK_ROWS) -> DataFrame:
    """Centre and size at any frame between sampled frames, constant outside.

    samples: video_id, frame, cx, cy, w, h; frames: video_id, frame.
    """
    vals = ["cx", "cy", "w", "h"]
    s = samples.select("video_id", "frame", F.struct("frame", *vals).alias("s"))
    x = frames.select("video_id", "frame").distinct().withColumn("want", F.lit(True)).join(s, ["video_id", "frame"], "full")
    x = x.withColumn("__chunk", F.floor(F.col("frame") / chunk_frames))
    x = running(x, VIDEO, "__chunk", [F.col("frame")], {"p": ("max", F.col("s"))})
    x = x.withColumn("__back", -F.col("__chunk"))
    x = running(x, VIDEO, "__back", [F.desc("frame")], {"nneg": ("max", F.when(F.col("s").isNotNull(), F.struct((-F.col("frame")).alias("neg"), "s")))})
    p, n = F.coalesce("p", "nneg.s"), F.coalesce("nneg.s", "p")
    x = x.where("want").select("video_id", "frame", p.alias("p"), n.alias("n"))
    t = F.when(F.col("n.frame") > F.col("p.frame"), (F.col("frame") - F.col("p.frame")) / (F.col("n.frame") - F.col("p.frame"))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x.select("video_id", "frame", *[(F.col(f"p.{v}") + (F.col(f"n.{v}") - F.col(f"p.{v}")) * t).alias(v) for v in vals])


def scenes(cuts: DataFrame, durations: DataFrame, max_scenes: int = 60) -> DataFrame:
    """Scenes between cuts; too many cuts are thinned evenly, none at all gives fixed steps.

    cuts: id, t_ms; durations: id, duration_ms.
    """
    c = positions(cuts.distinct(), ["id"], [F.col("t_ms")], "pos")
    total = c.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    x = join_keys(c, total, ["id"])
    grid = F.transform(F.sequence(F.lit(0), F.lit(max_scenes - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (max_scenes - 1)).cast("long") + 1)
    thin = x.where((F.col("n") <= max_scenes) | F.array_contains(grid, F.col("pos"))).select("id", "t_ms")
    bare = durations.join(total, "id", "left_anti").where("duration_ms > 12000")
    step = F.greatest(F.lit(8000.0), F.least(F.lit(20000.0), F.col("duration_ms") / 10.0))
    last = F.ceil((F.col("duration_ms") - 2000) / step).cast("int") - 1
    fixed = bare.where(last >= 1).select("id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.bround(i * step).cast("long"))).alias("t_ms"))
    marks = thin.unionByName(fixed).where("t_ms > 0")
    ends = durations.join(marks.groupBy("id").agg(F.max("t_ms").alias("__m")), "id", "left").select(
        "id", F.greatest(F.coalesce("duration_ms", F.lit(0)), F.coalesce("__m", F.lit(0))).alias("last_ms"))
    b = marks.join(ends, "id").where("t_ms < last_ms").select("id", F.col("t_ms").alias("b"))
    b = b.unionByName(ends.where("last_ms > 0").select("id", F.explode(F.array(F.lit(0).cast("long"), F.col("last_ms").cast("long"))).alias("b"))).distinct()
    b = b.withColumn("__chunk", F.floor(F.col("b") / 3_600_000))
    out = neighbours(b, ["id"], "__chunk", [F.col("b")], lead={"end_ms": "b"})
    return out.where("end_ms > b").select("id", F.col("b").alias("start_ms"), "end_ms")


def crop_windows(sc: DataFrame, durations: DataFrame) -> DataFrame:
    """Opening, third, longest, middle and last scene, and the whole; a scene keeps its first label."""
    x = sc.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("start_ms", F.struct((F.col("end_ms") - F.col("start_ms")).alias("d"), (-F.col("start_ms")).alias("s"))).alias("__long"))
    p = join_keys(positions(sc, ["id"], [F.col("start_ms")], "pos"), x, ["id"])
    i = F.col("pos") - 1
    label = (
        F.when(i == 0, 0).when((F.col("n") > 2) & (i == 2), 1).when(F.col("start_ms") == F.col("__long"), 2)
        .when(i == F.floor(F.col("n") / 2), 3).when(i == F.col("n") - 1, 4)
    )
    names = F.array(*[F.lit(v) for v in ["opening", "third", "longest", "middle", "last"]])
    picks = p.withColumn("ord", label).where("ord is not null").select("id", F.get(names, F.col("ord")).alias("label"), "start_ms", "end_ms", i.alias("scene_index"))
    whole = durations.join(sc.select("id").distinct(), "id", "left_semi").where("duration_ms > 0").select(
        "id", F.lit("whole").alias("label"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit(-1).cast("long").alias("scene_index"))
    return picks.unionByName(whole)
