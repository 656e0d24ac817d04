import pytest
from pyspark.sql import functions as F

from veritable.functions import arrays as A
from veritable.functions import normalize as N


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("label,text,want", [("1", "real", "real"), ("0", "fake", "fake"), ("1", "", "real"), ("0", "", "fake"), ("0", "real", None), ("", " REAL ", "real"), (None, None, None), ("x", "", None)])
def test_image_labels(spark, label, text, want):
    a, e = one(spark, N.image_label(F.lit(label), F.lit(text)), N.image_label_error(F.lit(label), F.lit(text)))
    assert a == want and (e is None) == (want is not None)


def test_ids_and_provenance(spark):
    lit = F.lit
    r = one(
        spark,
        N.joined_id(lit(" real_vs_fake"), lit("train "), lit("31355")).alias("id"), N.joined_id(lit("a"), lit(" "), lit("c")).alias("none"),
        N.image_generator_of(lit("x\\1-million-fake-faces\\a.jpg"), lit("fake")).alias("g"), N.manipulation_of(lit("a/Face2Face/b"), lit("fake")).alias("m"), N.manipulation_of(lit("a"), lit("real")).alias("mr"),
        N.audio_generator(lit(" a07"), lit("fake")).alias("ag"), N.audio_generator(lit("-"), lit("fake")).alias("au"), N.source_id(lit("a:b:c")).alias("s"), N.source_id(lit("a:b")).alias("s2"),
        N.identity_key(lit("a:b:7"), lit("real")).alias("k"), N.source_key(lit(" A\\B ")).alias("sk"), N.name_to_sample_id(lit("a__b__c__d")).alias("back"), N.name_to_sample_id(lit("a__b")).alias("back2"),
        N.extension(lit("a/b.c/D.JPG")).alias("e"), N.extension(lit("a.b/c")).alias("e2"), N.category(lit("a.flac")).alias("c"), N.source_bucket(lit("a/b/c/d/e")).alias("sb"), N.relative_to(lit("/r/x/y"), "/r").alias("rel"),
    )
    assert r.asDict() == {"id": "real_vs_fake:train:31355", "none": None, "g": "stylegan", "m": "face2face", "mr": "none", "ag": "A07", "au": "unknown", "s": "c", "s2": None, "k": "real_7", "sk": "a/b", "back": "a:b:c__d", "back2": "a:b", "e": ".jpg", "e2": "<none>", "c": "audio", "sb": "d", "rel": "x/y"}


@pytest.mark.parametrize("path,category,source,made", [
    ("a/b/x/FlickrFacesHQ/1.jpg", "image", "ffhq_flickrfaceshq", "unknown_generator"), ("k/1M_faces/2.gif", "image", "1_million_fake_faces_stylegan", "stylegan_1m_fake_faces"), ("a/b/c/Deepfake/3.m4v", "video", "Deepfake", "deepfakes_unspecified"),
    ("x/FaceSwap/4.yaml", "metadata", "unknown", "faceswap_unspecified"), ("LICENSE", "documentation", "unknown", "unknown_generator"), ("a/license.txt", "metadata", "unknown", "unknown_generator"), (".bashrc", "no_extension", "unknown", "unknown_generator"), ("a.cu", "code", "unknown", "unknown_generator"), (None, "no_extension", "unknown", "unknown_generator"),
])
def test_path_rules(spark, path, category, source, made):
    r = one(spark, N.category(F.lit(path)).alias("c"), N.source_bucket(F.lit(path)).alias("s"), N.generator_bucket(F.lit(path), F.lit("fake")).alias("g"), N.generator_bucket(F.lit(path), F.lit("real")).alias("r"))
    assert (r.c, r.s, r.g, r.r) == (category, source, made, "none_authentic")


def test_generator_names_keep_their_case_and_stylegan_comes_first(spark):
    of = lambda g, p, l: one(spark, N.split_generator(F.lit(g), F.lit(p), F.lit(l)))[0]
    assert [of("StarGAN", "a", "fake"), of("stylegan", "x/faceswap", "fake"), of("", "a/StyleGAN/faceswap", "fake"), of("unknown", "DeepFake_Detection/a", "fake"), of(None, "a", "fake"), of("stylegan", "a", "real")] == ["StarGAN", "stylegan", "stylegan", "deepfake_detection", "unknown_forgery", "ffhq_authentic"]
    r = one(spark, N.dataset_of(F.lit("d/ASVspoof2021_LA/x")).alias("d"), N.dataset_of(F.lit("x")).alias("u"), N.image_generator_of(F.lit("k/1m_faces/x"), F.lit("fake")).alias("g"))
    assert (r.d, r.u, r.g) == ("asvspoof2021_la", "unknown", "stylegan")


def test_rows_as_text_and_results_as_metrics(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, 2.5, None)], "a int, b double, c string")
    assert [tuple(r) for r in rows.select(*N.csv_row(rows.columns)).collect()] == [("1", "", "x"), ("", "2.5", "")]
    r = one(spark, N.split_metrics(F.lit('{"accuracy": 0.5, "roc_auc_note": "one class", "support": 4}')).alias("m"), N.split_metrics(F.lit("{}")).alias("e"), N.response(F.lit("fake"), F.lit(0.12345678), F.lit(3.456), "image", temperature=1.5).alias("r"))
    assert (r.m.accuracy, r.m.f1, r.m.support, r.m.note) == (0.5, None, 4, "one class") and r.e.confusion_matrix == [[0, 0], [0, 0]] and r.e.support == 0
    assert (r.r.probability, r.r.inference_latency_ms, r.r.calibrated, r.r.temperature) == (0.123457, 3.46, True, 1.5)


def test_upload_rules_in_order(spark):
    cases = [((None, "a.png", "image/png"), "missing_file"), ((0, "a.exe", "x"), "empty_file"), ((1 << 40, "a.exe", "x"), "file_too_large"), ((5, "a.exe", "x"), "bad_extension"), ((5, "a.png", "x/y"), "bad_mime_type"), ((5, "a.png", "image/png"), None)]
    for (size, path, mime), want in cases:
        assert one(spark, N.file_error(F.lit(size).cast("long"), F.lit(path), F.lit(mime), F.lit("image")))[0] == want


def test_prediction_at_zero_and_features(spark):
    r = one(spark, N.prediction(F.lit(0.0), 1.5).alias("p"), N.feature_errors(F.lit('{"a": 1, "c": "x", "modality_tag": "text"}'), ["a", "b"]).alias("f"), N.feature_errors(F.lit('{"a": 1, "b": 2, "modality_tag": "audio"}'), ["a", "b"]).alias("ok"))
    assert r.p.probability == 0.5 and r.p.label == "fake"
    assert r.f == ["missing:b", "unknown:c", "bad_modality"] and r.ok == []


def test_array_kernels(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    r = one(
        spark, A.frame_indices(F.lit(100), 10).alias("many"), A.frame_indices(F.lit(3), 10).alias("few"), A.padded_indices(F.lit(2), 4).alias("pad"), A.frame_step(F.lit(30.0), 10.0).alias("step"), A.frame_step(F.lit(0.0), 10.0).alias("step0"),
        A.center_fit(a(1.0, 2.0, 3.0, 4.0), 2).alias("crop"), A.center_fit(a(1.0), 4).alias("grow"), A.head_fit(a(1.0, 2.0), 3).alias("head"), A.decibels_to_unit(a(-100.0, -40.0, 3.0)).alias("db"), A.mean_step(a(1.0, 3.0, 2.0)).alias("ms"), A.mean_step(a(1.0)).alias("m1"),
        A.min_max(a(2.0, 2.0)).alias("flat"), A.pad_with_last(a(1.0, 5.0), 4).alias("last"), A.hex_to_long(F.lit("ffffffffffffffff")).alias("hex"), A.hamming(F.lit(5), F.lit(6)).alias("ham"),
    )
    assert len(r.many) == 10 and (r.many[0], r.many[-1]) == (0, 99) and r.few == [0, 1, 2] and r.pad == [0, 1, 1, 1] and (r.step, r.step0) == (3, 3)
    assert r.crop == [2.0, 3.0] and r.grow == [0.0, 1.0, 0.0, 0.0] and r.head == [1.0, 2.0, 0.0] and r.db == [0.0, 0.5, 1.0]
    assert (r.ms, r.m1, r.flat, r["last"], r.hex, r.ham) == (1.5, 0.0, [0.0, 0.0], [1.0, 5.0, 5.0, 5.0], -1, 2)


def test_faces_boxes_and_attribution(spark):
    faces = spark.createDataFrame([([(0.0, 0.0, 2.0, 2.0, 0.9), (50.0, 50.0, 4.0, 4.0, 0.5)],), ([],)], "f array<struct<x:double,y:double,w:double,h:double,confidence:double>>")
    rows = faces.select(A.pick_face("f", "largest").alias("l"), A.pick_face("f", "highest_confidence").alias("c"), A.pick_face("f", "center", F.lit(1.0), F.lit(1.0)).alias("m")).collect()
    assert rows[0].l.w == 4.0 and rows[0].c.w == 2.0 and rows[0].m.w == 2.0 and rows[1].l is None
    box = one(spark, A.crop_box(F.lit(10), F.lit(10), F.lit(20), F.lit(20), F.lit(32), F.lit(100), 0.5).alias("b"), A.crop_box(F.lit(90), F.lit(0), F.lit(5), F.lit(5), F.lit(10), F.lit(10)).alias("n"), A.eye_angle(F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("e"))
    assert (box.b.x0, box.b.y0, box.b.x1, box.b.y1) == (0, 0, 32, 40) and box.n is None and box.e == pytest.approx(45)
    shares = spark.createDataFrame([([[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]],)], "f array<array<double>>").select(A.deviation_shares("f")).first()[0]
    assert shares[2] == max(shares) and sum(shares) == pytest.approx(1, abs=1e-5)


def test_signal_kernels(spark):
    import math

    rows = spark.createDataFrame([([1.0] * 16, [math.sin(i / 3) for i in range(1600)])], "v array<double>, a array<double>")
    r = rows.select(A.laplacian_variance("v").alias("l"), A.spectrum_magnitude("v").alias("s"), A.log_mel("a").alias("m")).first()
    assert r.l == 0.0 and max(range(16), key=lambda i: r.s[i]) == 10 and len(r.m) == 40 and max(map(max, r.m)) == 0.0
