"""Raw media files: listings, header parsers and validation."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.normalize import category, extension


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified of every file below ``path``; contents are not read. Spark's file
    scan leaves out empty files, so a path that a manifest names and this does not list is
    missing or empty."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def directory_summary(files: DataFrame, samples: int = 5) -> DataFrame:
    """Per category: files, bytes and the first paths."""
    from pyspark.sql import Window

    rows = files.withColumn("category", category("path"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy("path"))).where(F.col("r") <= samples)
    counts = rows.groupBy("category").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    return counts.join(first.groupBy("category").agg(F.array_sort(F.collect_list("path")).alias("samples")), "category")


def repeated_names(files: DataFrame, most: int = 25) -> DataFrame:
    """Base names that occur in several folders."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1").orderBy(F.desc("n"), "name").limit(most)


def content_hashes(files: DataFrame, first: int = 200, least_bytes: int = 1024) -> DataFrame:
    """md5 groups among the first files by path that are large enough: a spot check by design."""
    chosen = files.where((F.col("length") >= least_bytes) & (category("path") == "image")).orderBy("path").limit(first)
    return chosen.groupBy(F.md5("content").alias("md5")).agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def video_labels(files: DataFrame) -> DataFrame:
    """label, generator and identity that a video's folders tell."""
    p = F.lower("path")
    method = F.regexp_extract(p, r"/(deepfakes|face2face|faceswap|neuraltextures|faceshifter)/", 1)
    real = p.rlike(r"/(original|real|youtube-real|celeb-real|actors)[^/]*/")
    label = F.when(real, "real").when((method != "") | p.rlike(r"/(fake|synthesis|manipulated)[^/]*/"), "fake")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return files.select("path", stem.alias("video_id"), label.alias("label"), F.when(label == "real", "authentic").when(method != "", method).otherwise("unknown").alias("generator"), F.regexp_extract(stem, r"^([A-Za-z]*\d+)", 1).alias("identity_id"))


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first start-of-frame segment; None if there is none."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 1 if kind == 0xFF else 2 if kind == 0x01 or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def flac_info(data: bytes) -> tuple[int, int, float] | None:
    """(rate, samples, seconds) from STREAMINFO."""
    if not data or data[:4] != b"fLaC" or len(data) < 26 or data[4] & 0x7F:
        return None
    packed = int.from_bytes(data[18:26], "big")
    rate, samples = packed >> 44, packed & ((1 << 36) - 1)
    return (rate, samples, samples / rate) if rate else None


def wav_info(data: bytes) -> tuple[int, int, float] | None:
    """(rate, frames, seconds) from the fmt and data chunks."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, rate, block = 12, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(data):
            rate, block = struct.unpack("<I", data[at + 12 : at + 16])[0], struct.unpack("<H", data[at + 20 : at + 22])[0]
        elif name == b"data":
            return (rate, size // block, size // block / rate) if rate and block else None
        at += 8 + size + size % 2
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def jpeg_sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([jpeg_size(v) or (None, None) for v in s], columns=["width", "height"]).astype("Int32")


@F.pandas_udf(T.StructType([T.StructField("sample_rate", T.IntegerType()), T.StructField("n_samples", T.LongType()), T.StructField("duration_sec", T.DoubleType())]))
def audio_infos(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([flac_info(v) or wav_info(v) or (None, None, None) for v in s], columns=["sample_rate", "n_samples", "duration_sec"]).astype({"sample_rate": "Int32", "n_samples": "Int64", "duration_sec": "Float64"})


def validate_images(files: DataFrame, least: int = 0, most: int = 1 << 16) -> DataFrame:
    """path, file_size, file_hash, width, height and the first error (null: valid)."""
    rows = files.withColumn("__size", jpeg_sizes("content"))
    w, h = F.col("__size.width"), F.col("__size.height")
    error = F.coalesce(
        F.when(~extension("path").isin(".jpg", ".jpeg"), "bad_extension"),
        F.when(F.col("length") == 0, "empty_file"),
        F.when(w.isNull(), "invalid_header"),
        F.when(F.least(w, h) < least, "too_small"),
        F.when(F.greatest(w, h) > most, "too_large"),
    )
    return rows.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), w.alias("width"), h.alias("height"), error.alias("error"))


def validate_audio(files: DataFrame, least_sec: float = 0.0, most_sec: float = float("inf")) -> DataFrame:
    rows = files.withColumn("__a", audio_infos("content"))
    d = F.col("__a.duration_sec")
    error = F.coalesce(
        F.when(~extension("path").isin(".flac", ".wav"), "bad_extension"),
        F.when(F.col("length") == 0, "empty_file"),
        F.when(d.isNull(), "invalid_header"),
        F.when(d < least_sec, "too_short"),
        F.when(d > most_sec, "too_long"),
    )
    return rows.select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash"), "__a.*", error.alias("error"))


def kept_frames(frames: DataFrame, step: Column, index: str = "frame_idx") -> DataFrame:
    """Every step-th frame; decoding itself is the caller's."""
    return frames.where(F.col(index) % step == 0)
