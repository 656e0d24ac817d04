"""Manifests, splits, protocols and metadata as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.functions.normalize import audio_label, image_label, image_label_error


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Header CSV as strings, exactly these columns in this order; a file without one raises."""
    rows = spark.read.option("header", True).option("emptyValue", "").csv(path)
    if absent := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    return rows.select(*columns)


def read_splits(spark: SparkSession, files: dict[str, str], columns: list[str]) -> DataFrame:
    """Several split files, each tagged with its split."""
    parts = [read_csv(spark, path, columns).withColumn("split", F.lit(name)) for name, path in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parsed_labels(rows: DataFrame, label: str = "label", text: str = "label_str") -> DataFrame:
    """Rows with a clean label, or the error that puts them in quarantine."""
    return rows.withColumn("parse_error", image_label_error(label, text)).withColumn("clean_label", image_label(label, text))


def protocol_rows(lines: DataFrame, *more: Column) -> DataFrame:
    """Lines (column value) of at least five fields: speaker, clip, attack, label; blanks and # skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = lines.where((line != "") & ~line.startswith("#")).where(F.size(parts) >= 5)
    return rows.select(parts[0].alias("speaker_id"), parts[1].alias("clip_id"), parts[3].alias("attack"), audio_label(parts[4]).alias("label"), *more)


def read_protocol(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of protocol files, and the file of each."""
    return protocol_rows(spark.read.text(path), F.col("_metadata.file_path").alias("protocol_file"))


def successful(metadata: DataFrame, version: str, mode: str | None = None) -> DataFrame:
    """Metadata of one preprocessing version that succeeded."""
    rows = metadata.where((F.col("status") == "success") & (F.col("preprocessing_version") == version))
    return rows if mode is None else rows.where(F.col("mode") == mode)


def numbered_scan(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows of Parquet files with their place in the scan, from 0: files in order of their
    paths, rows as they lie in them. Each row knows its place in its file; the rows of the
    files before come from a count per file, so nothing is sorted and only the small table of
    counts, a row per file, is ordered in one task and sent to all: dealt by file, the rows of one
    large file would meet in one task. ``rows`` is a plain scan, without filters."""
    at = F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    per_file = rows.select(*at).groupBy("__file").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.select("*", *at).join(F.broadcast(starts), "__file").withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__file", "__row", "__start")


def spot_check(rows: DataFrame, files: DataFrame, key: str, order: str | None = None, stride: int = 5000) -> DataFrame:
    """Every stride-th row and the last one, without a file: paths that do not resolve. Rows
    are numbered by ``order``, a dense ordinal column from 0, or as they lie in their files."""
    if order is None:
        order = "__ordinal"
        rows = numbered_scan(rows, order)
    last = rows.agg(F.max(order)).first()[0]
    chosen = rows.where((F.col(order) % stride == 0) | (F.col(order) == F.lit(last)))
    return chosen.join(files.select(key), key, "left_anti").drop("__ordinal")


def metrics_from_json(text: Column) -> Column:
    """Evaluation metrics with nulls where the document says nothing."""
    return F.from_json(text, "accuracy double, precision double, recall double, f1 double, roc_auc double, support long, confusion_matrix array<array<long>>")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
