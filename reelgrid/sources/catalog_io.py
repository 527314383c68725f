"""Catalog tables, side files, inventories and exports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import tags as tg
from reelgrid.functions.text import text_or_empty
from reelgrid.operators.catalog import newest_first


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """The catalog, newest first; older files may lack columns."""
    return spark.read.schema(schemas.MATERIALS).parquet(path).orderBy(*newest_first())


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Text side files ``<root>/<channel>/<id>.(txt|json)`` as id, channel, text.

    JSON side files hold ``verified`` and ``auto`` term lists; their labels
    become the text.
    """
    x = spark.read.text(f"{root}/*/*", wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("p"))
    x = x.select(
        F.regexp_extract("p", r"([^/]+)\.[^./]+$", 1).alias("id"), F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("channel"),
        F.col("p").endswith(".json").alias("json"), "value",
    )
    term = "array<struct<zh:string,en:string>>"
    doc = F.from_json("value", f"verified {term}, auto {term}")
    terms = F.concat(F.coalesce(doc["verified"], F.array().cast(term)), F.coalesce(doc["auto"], F.array().cast(term)))
    flat = F.array_join(F.transform(terms, lambda t: F.concat_ws(" ", t["zh"], t["en"])), " ")
    return x.select("id", "channel", F.when(F.col("json"), flat).otherwise(F.col("value")).alias("text"))


def inventory(files: DataFrame) -> DataFrame:
    """Path, size, content hash and 12-digit id of binary-file rows."""
    sha = F.sha2("content", 256)
    return files.select("path", F.col("length").alias("size"), sha.alias("sha256"), F.left(sha, F.lit(12)).alias("id"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    return inventory(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))


def upsert_materials(catalog: DataFrame, incoming: DataFrame, order: str = "external_path") -> DataFrame:
    """Merge rows by external path, else by hash, else insert; one row per asset.

    incoming: id, kind, name, ext, size, sha256, tags, description, source,
    external_path; of several rows for one path the last by ``order`` counts.  All
    columns of the catalog are returned; only those of touched rows that the
    rule names change, and ``op`` tells what happened.  Tags are united and
    settled, a description is kept unless it was empty, a changed file of a path
    takes name, size and hash anew and its relative path.  A new row has the first
    12 digits of its hash as id (its own id without a hash), is created now, and
    has null in columns that only the catalog has.
    """
    fields = ["kind", "name", "ext", "size", "sha256", "tags", "description", "source"]
    last = F.struct(F.col(order).alias("o"), "sha256", "id")
    inc = incoming.groupBy("external_path").agg(F.max_by(F.struct("id", *fields), last).alias("r")).select("external_path", "r.*")
    i = inc.select("external_path", F.coalesce(F.expr("left(sha256, 12)"), "id").alias("i_id"), *[F.col(f).alias(f"i_{f}") for f in fields])
    by_path = catalog.where(F.col("location") == "external").groupBy("external_path").agg(F.min("id").alias("hit"))
    i = i.join(by_path, "external_path", "left")
    owner = catalog.groupBy(F.col("sha256").alias("i_sha256")).agg(F.min("id").alias("owner"))
    i = i.join(owner, "i_sha256", "left")
    i = i.withColumn("target", F.coalesce("hit", "owner", "i_id")).withColumn("via", F.when(F.col("hit").isNotNull(), "path").when(F.col("owner").isNotNull(), "hash").otherwise("new"))
    # Several paths may carry the same content: they meet in one row per target,
    # their distinct tags in one array (tags, not paths, are collected).
    one = i.groupBy("target").agg(
        F.min_by(F.struct("via", "external_path", *[f"i_{f}" for f in fields if f != "tags"]), F.struct(F.when(F.col("via") == "path", 0).otherwise(1), F.col("external_path"))).alias("r")
    )
    each = i.select("target", F.explode("i_tags").alias("t")).distinct().groupBy("target").agg(F.array_sort(F.collect_list("t")).alias("i_tags"))
    one = one.join(each, "target", "left").select("target", "r.*", F.coalesce("i_tags", tg.no_tags()).alias("i_tags")).withColumnRenamed("external_path", "i_path")
    x = catalog.join(one, F.col("id") == F.col("target"), "full")
    path, new, touched = F.col("via") == "path", F.col("id").isNull(), F.col("target").isNotNull()
    audio = F.exists(F.coalesce("i_tags", tg.no_tags()), lambda t: t.startswith("has_audio:"))
    merged = tg.tag_union("tags", "i_tags")
    settled = F.when(path & audio, tg.reconcile_audio(merged, tg.has_tag("i_tags", "has_audio:1"))).otherwise(merged)
    moved = path & (F.col("sha256") != F.col("i_sha256"))

    def take(f: str, cond) -> F.Column:
        return F.when(new | cond, F.col(f"i_{f}")).otherwise(F.col(f))

    empty_desc = (F.trim(text_or_empty("description")) == "") | (path & (text_or_empty("i_description") != ""))
    empty_src = (F.trim(text_or_empty("source")) == "") | (path & (text_or_empty("i_source") != ""))
    outside = F.when(new | (touched & (F.col("location") == "external")), F.col("i_path")).otherwise(F.col("external_path"))
    changed = {
        "id": F.coalesce("id", "target"), "kind": take("kind", touched), **{f: take(f, moved) for f in ["name", "ext", "size", "sha256"]},
        "tags": F.when(touched, settled).otherwise(F.col("tags")), "description": take("description", touched & empty_desc), "source": take("source", touched & empty_src),
        "external_path": outside, "location": F.coalesce("location", F.lit("external")),
    }
    if "rel_path" in catalog.columns:
        changed["rel_path"] = F.when(new | moved, F.col("i_path")).otherwise(F.col("rel_path"))
    if "orig_name" in catalog.columns:
        changed["orig_name"] = F.when(new, F.col("i_name")).otherwise(F.col("orig_name"))
    if "created_at" in catalog.columns:
        changed["created_at"] = F.when(new, F.current_timestamp()).otherwise(F.col("created_at"))
    op = F.when(~touched, "none").when(new, "added").when(moved, "updated").otherwise("duplicate")
    return x.select(*[changed.get(c, F.col(c)).alias(c) for c in catalog.columns], op.alias("op"))


def export_frame(m: DataFrame, columns: Sequence[str] = tuple(schemas.EXPORT_COLUMNS)) -> DataFrame:
    """Flat export rows: arrays joined by commas."""
    kinds = dict(m.dtypes)
    return m.select(*[F.array_join(c, ",").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns])


def export_catalog(m: DataFrame, path: str, fmt: str = "json") -> None:
    """CSV (with header, text columns start with a byte-order mark per file) or JSON."""
    if fmt == "csv":
        x = export_frame(m)
        head = "﻿" + x.columns[0]
        x.withColumnRenamed(x.columns[0], head).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        m.write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Audit rows; details are cut at 300 characters, rows without action are refused."""
    history_rows(df).write.mode("append").parquet(path)


def history_rows(df: DataFrame) -> DataFrame:
    return df.where(F.trim(text_or_empty("action")) != "").withColumn("detail", F.substring(text_or_empty("detail"), 1, 300))


def append_feedback(df: DataFrame, path: str) -> None:
    x = df.where(F.trim(text_or_empty("action")) != "").withColumn("action", F.trim("action"))
    x.write.mode("append").json(path)


def encode_vectors(df: DataFrame, col: str = "vec") -> DataFrame:
    """float32 blob of a vector column, for exchange with other stores."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())

    return df.withColumn("blob", pack(col))


def decode_vectors(df: DataFrame, col: str = "blob") -> DataFrame:
    """``array<float>`` from float32 blobs."""
    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda a: None if a is None else np.frombuffer(a, dtype="<f4"))

    return df.withColumn("vec", unpack(col))
