import io
import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from veritable.operators import compare, splits
from veritable.sources import media, sinks, tables


def jpeg(h, w):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x01\x11\x00\xff\xd9"


def flac(rate, samples):
    return b"fLaC\x80\x00\x00\x22" + b"\0" * 10 + ((rate << 44) | samples).to_bytes(8, "big") + b"\0" * 16


def wav(rate, frames):
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * frames)
    return b.getvalue()


def test_headers():
    assert media.jpeg_size(jpeg(24, 32)) == (32, 24) and media.jpeg_size(b"junk") is None and media.jpeg_size(b"") is None and media.jpeg_size(b"\xff\xd8\xff") is None
    assert media.flac_info(flac(16000, 8000)) == (16000, 8000, 0.5) and media.flac_info(b"fLaC") is None
    assert media.wav_info(wav(8000, 4000)) == (8000, 4000, 0.5) and media.wav_info(b"RIFF") is None


def test_scan_and_validate(spark, tmp_path):
    for name, data in (("a.jpg", jpeg(24, 32)), ("deep/b.jpg", b"junk"), ("c.jpg", b""), ("d.txt", b"x"), ("e.wav", wav(8000, 4000)), ("deep/a.jpg", jpeg(5, 5))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = media.contents(spark, str(tmp_path))
    got = {r.path.rpartition(tmp_path.name + "/")[2]: r for r in media.validate_images(files, least=8).collect()}
    assert {k: v.error for k, v in got.items()} == {"a.jpg": None, "deep/b.jpg": "invalid_header", "d.txt": "bad_extension", "e.wav": "bad_extension", "deep/a.jpg": "too_small"}
    audio = {r.path[-5:]: r.duration_sec for r in media.validate_audio(files).where("error is null").collect()}
    assert audio == {"e.wav": 0.5}
    listing = media.listing(spark, str(tmp_path))
    assert "content" not in listing.columns and listing.count() == 5
    assert [(r.name, r.n) for r in media.repeated_names(listing).collect()] == [("a.jpg", 2)]
    assert {r.category: r.n_files for r in media.directory_summary(listing).collect()} == {"image": 3, "metadata": 1, "audio": 1}


def test_video_labels(spark):
    df = spark.createDataFrame([("/d/original_sequences/youtube/001.mp4",), ("/d/manipulated_sequences/Deepfakes/001_870.mp4",), ("/d/x/y.mp4",)], "path string")
    assert [(r.video_id, r.label, r.generator) for r in media.video_labels(df).collect()] == [("001", "real", "authentic"), ("001_870", "fake", "deepfakes"), ("y", None, "unknown")]


def test_tables(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\n\nLA_1 clip_1 - A01 spoof\nLA_2 clip_2 - - bonafide\nshort line\n")
    assert [(r.clip_id, r.attack, r.label) for r in tables.read_protocol(spark, str(tmp_path / "p.txt")).orderBy("clip_id").collect()] == [("clip_1", "A01", "fake"), ("clip_2", "-", "real")]
    (tmp_path / "s.csv").write_text("id,label,label_str\n1,1,real\n2,0,real\n")
    rows = tables.parsed_labels(tables.read_splits(spark, {"train": str(tmp_path / "s.csv")}, ["id", "label", "label_str"])).orderBy("id").collect()
    assert [(r.clean_label, r.parse_error is None) for r in rows] == [("real", True), (None, False)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "s.csv"), ["nothing"])
    got = spark.createDataFrame([('{"accuracy": 0.5}',)], "j string").select(tables.metrics_from_json(F.col("j")).alias("m")).first().m
    assert got.accuracy == 0.5 and got.roc_auc is None
    n = spark.range(12).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("path"))
    assert {r.path for r in tables.spot_check(n, n.where("ord <> 11"), "path", "ord", 5).collect()} == {"11"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("auc", 0.98), ("none", None)], "metric string, value double")
    assert "| auc | 0.9800 |" in sinks.markdown_table(df) and "| none | n/a |" in sinks.markdown_table(df)
    sinks.write_csv(df, str(tmp_path / "c"), ["metric", "value"])
    assert tables.read_csv(spark, str(tmp_path / "c"), ["metric", "value"]).count() == 2
    sinks.write_by_role(df.withColumn("split_role", F.lit("train")), str(tmp_path / "r"))
    sinks.append_rows(df, str(tmp_path / "a"))
    sinks.append_rows(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert "metric: auc" in sinks.text_report("Report", df)


def test_every_role_has_its_files_and_an_empty_one_its_header(spark, tmp_path):
    df = spark.createDataFrame([("a", "train", None), ("b", "val", "x,y"), ("c", "train", "z"), ("d", None, "w")], "id string, split_role string, note string")
    roles = ["train", "val", "test_seen"]
    stats = df.groupBy("split_role").count()
    sinks.write_outputs(df, str(tmp_path / "out"), ["id", "note"], roles, stats, "# Report\n\nAll well.\n")
    for role, want in (("train", [("a", None), ("c", "z")]), ("val", [("b", "x,y")]), ("test_seen", [])):
        files = sorted((tmp_path / "out" / "splits" / f"role={role}").glob("part-*.csv"))
        assert files and all(f.read_text().startswith("id,note") for f in files)
        rows = spark.read.option("header", True).schema("id string, note string").csv(str(tmp_path / "out" / "splits" / f"role={role}")).collect()
        assert sorted(map(tuple, rows)) == want
    (report,) = (tmp_path / "out" / "report").glob("part-*")
    assert report.read_text() == "# Report\n\nAll well.\n" and spark.read.json(str(tmp_path / "out" / "statistics")).count() == 3


def test_reports_show_gaps_and_changes(spark):
    rows = spark.createDataFrame([("m", "test_seen", 0.9, 0.8, 10, 4, 1, 0, 5), ("m", "test_unseen", 0.7, None, 10, 3, 2, 1, 4), ("n", "test_seen", 0.5, 0.5, 4, 1, 1, 1, 1)], "model string, split string, accuracy double, f1 double, support long, tn long, fp long, fn long, tp long")
    text = sinks.gap_report(rows, compare.generalization_gap(rows, ["accuracy", "f1"]), ["accuracy", "f1"])
    assert "| m | test_unseen | 0.7000 | n/a | 10 | 3 | 2 | 1 | 4 |" in text and "| m | 0.2000 | n/a | n/a |" in text and "| n | n/a | n/a | split_without_rows |" in text
    change = spark.createDataFrame([("m", s, *v) for s, v in (("before", (0.2, 0.3, 0.7, 0.5)), ("after", (0.1, 0.25, 0.6, 0.5)))], "model string, stage string, ece double, brier double, nll double, f1 double")
    text = sinks.calibration_report(change, ["model"], 1.5)
    assert "Temperature: 1.5000" in text and "| m | after | 0.1000 | 0.2500 | 0.6000 | 0.5000 |" in text and "| m | -0.1000 | -0.0500 | -0.1000 | 0.0000 |" in text


def test_policies_are_read_and_give_roles(spark):
    text = json.dumps({"generator_taxonomy": {"unseen_forgery": ["newgan"]}, "split_generators": {"train": ["real", "oldgan"], "val": None}, "source_split_mapping": {"train": "train", "valid": "val", "test": "test_seen"}, "validation": {"min_minority_class_fraction": 0.2, "incompatible_split_pairs": [["train", "val"]]}})
    policy = splits.load_policy(text)
    assert policy == splits.Policy({"train": ["real", "oldgan"], "val": []}, ["newgan"], {"train": "train", "valid": "val", "test": "test_seen"}, 0.2, [("train", "val")])
    assert splits.load_policy("{}").least_share == 0.10
    with pytest.raises(ValueError):
        splits.load_policy("[1]")
    df = spark.createDataFrame([("train", "oldgan"), ("valid", "newgan"), ("test", None), ("odd", "real"), (None, None)], "upstream string, generator string")
    assert [r[0] for r in df.select(splits.policy_roles(policy, "upstream", "generator")).collect()] == ["train", "test_unseen", "test_seen", None, None]


def test_three_models_vote(spark):
    df = spark.createDataFrame([(0.9, 0.2, 0.3), (0.1, 0.2, 0.3), (0.5, 0.5, 0.5), (None, 0.5, 0.5)], "a double, b double, c double")
    got = [r[0] for r in df.select(compare.triad(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert [(pytest.approx(g.prob), g.label, pytest.approx(g.confidence)) for g in got[:2]] == [(0.51, "FAKE", 0.51), (0.19, "REAL", 0.81)] and got[2].label == "FAKE" and got[3] is None
