"""Caption files to cues and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.functions.parse import to_clock
from reelgrid.functions.text import text_or_empty

TIMING = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"


def parse_cues(files: DataFrame) -> DataFrame:
    """Cues of caption texts (track_id, text): blocks split at blank lines, timing
    on any line of a block, body lines joined, empty bodies dropped."""
    body = F.regexp_replace(F.trim(text_or_empty("text")), r"\r\n?", "\n")
    blocks = files.select("track_id", F.posexplode(F.split(body, r"\n\s*\n")).alias("block", "b"))
    lines = F.filter(F.transform(F.split("b", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    x = blocks.select("track_id", "block", lines.alias("l"))
    at = F.array_position(F.transform("l", lambda s: s.rlike(TIMING)), True)
    x = x.withColumn("at", at.cast("int")).where("at > 0").withColumn("t", F.get("l", F.col("at") - 1))

    def ms(i: int) -> Column:
        h, m, s, f = [F.regexp_extract("t", TIMING, i + k).cast("bigint") for k in range(4)]
        return ((h * 60 + m) * 60 + s) * 1000 + f

    text = F.trim(F.array_join(F.slice("l", F.col("at") + 1, F.greatest(F.size("l") - F.col("at"), F.lit(0))), " "))
    x = x.select("track_id", "block", ms(1).alias("start_ms"), ms(5).alias("end_ms"), text.alias("text")).where("text <> ''")
    return x.withColumnRenamed("block", "idx")


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]+$", 1).alias("track_id"), F.col("value").alias("text"))
    return parse_cues(files)


def cue_blocks(cues: DataFrame, fmt: str = "srt") -> DataFrame:
    """Text block per cue in SRT, VTT or plain two-line form (``no`` is the 1-based number)."""
    text = F.trim(text_or_empty("text"))
    comma = F.concat(to_clock("start_ms"), F.lit(" --> "), to_clock("end_ms"))
    dot = F.concat(to_clock("start_ms", "."), F.lit(" --> "), to_clock("end_ms", "."))
    block = {
        "srt": F.concat_ws("\n", F.col("no").cast("string"), comma, text, F.lit("")),
        "vtt": F.concat_ws("\n", F.concat(F.col("no").cast("string"), F.lit("-cue")), dot, F.regexp_replace(text, "\n", " "), F.lit("")),
        "txt": F.concat_ws("\n", dot, text, F.lit("")),
    }[fmt]
    return cues.select("track_id", "no", block.alias("block"))


def write_cues(cues: DataFrame, path: str, fmt: str = "srt") -> None:
    """One folder per track; its part files, in name order, make up the caption file.

    Rows are range-partitioned by (track, number) and written in order, so a
    long track is spread over several files instead of one task.
    """
    x = cue_blocks(cues, fmt)
    if fmt == "vtt":
        head = x.select("track_id").distinct().select("track_id", F.lit(0).cast("long").alias("no"), F.lit("WEBVTT\n").alias("block"))
        x = x.withColumn("no", F.col("no").cast("long")).unionByName(head)
    ordered = x.repartitionByRange("track_id", "no").sortWithinPartitions("track_id", "no")
    ordered.select("track_id", "block").write.mode("overwrite").partitionBy("track_id").text(path)
