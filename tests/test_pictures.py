import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.functions import masks, pictures
from veritable.operators import gated
from veritable.sources import tables


def turned(picture, cx, cy, degrees):
    h, w = picture.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            at_x, at_y = c * (x - cx) - s * (y - cy) + cx, s * (x - cx) + c * (y - cy) + cy
            left, top = math.floor(at_x), math.floor(at_y)
            for dy in (0, 1):
                for dx in (0, 1):
                    part = (1 - abs(at_x - left - dx)) * (1 - abs(at_y - top - dy))
                    out[y, x] += part * picture[min(max(top + dy, 0), h - 1), min(max(left + dx, 0), w - 1)]
    return out


@pytest.mark.parametrize("degrees", [0.0, 90.0, -30.0, 180.0, 45.0, 3.7])
def test_rotation_equals_the_loop(spark, degrees):
    picture = np.arange(48.0).reshape(6, 8) ** 1.5
    df = spark.createDataFrame([(picture.ravel().tolist(), degrees), (picture.ravel()[:5].tolist(), degrees), (None, degrees)], "p array<double>, d double")
    got = [r[0] for r in df.select(pictures.rotate("p", 8, 6, F.lit(3.0), F.lit(2.5), F.col("d"))).collect()]
    assert got[0] == pytest.approx(turned(picture, 3.0, 2.5, degrees).ravel(), abs=1e-6) and got[1:] == [None, None]


def test_eyes_are_level_after_alignment(spark):
    picture = np.zeros((9, 9))
    picture[6, 2], picture[2, 6] = 1.0, 1.0  # eyes on a slope of 45 degrees
    eyes = [(2.0, 6.0, 6.0, 2.0), (2.0, 2.0, 2.0, 2.0), (None, 2.0, 5.0, 2.0), (float("nan"), 2.0, 5.0, 2.0)]
    df = spark.createDataFrame([(picture.ravel().tolist(), *e) for e in eyes], "p array<double>, lx double, ly double, rx double, ry double")
    got = [np.array(r[0]).reshape(9, 9) for r in df.select(pictures.align_by_eyes("p", 9, 9, *map(F.col, ("lx", "ly", "rx", "ry")))).collect()]
    assert got[0].argmax() // 9 == 4 and got[0].sum(1).argmax() == 4
    assert all((g == picture).all() for g in got[1:])


def test_level_lines_are_counted(spark):
    page = np.full((40, 40), 240.0)
    for y in (8, 20, 31):
        page[y, 4:36] = 20.0  # a ruled page: each line has an upper and a lower edge
    assert pictures.level_lines(pictures.edges(page, 100.0), 10) >= 3
    upright = page.T.copy()
    assert pictures.level_lines(pictures.edges(upright, 100.0), 10) == 0
    one = np.zeros((30, 30))
    one[15:] = 255.0
    edge = pictures.edges(one, 100.0)
    edge[15] = False  # one row of edge pixels is left
    assert pictures.level_lines(edge, 20) == 1
    flat = page.ravel().tolist()
    df = spark.createDataFrame([(flat, 40), ([200.0] * 6, 4), (None, 3), ([], 3), ([1.0, None], 2), (flat, None), ([5.0], 1)], "p array<double>, w int")
    got = [r.f for r in df.select(pictures.picture_facts("p", "p", "p", "w").alias("f")).collect()]
    assert got[0].paper == pytest.approx((page > 140).mean()) and got[0].saturation == 0 and got[0].lines >= 3 and got[0].sharpness > 1500
    assert all(g.paper is None and g.lines is None for g in got[1:6]) and (got[6].paper, got[6].lines) == (0.0, 0)


def test_masks_depend_on_seed_row_and_draw_alone(spark):
    frames = [[float(i)] * 3 for i in range(1, 9)]
    df = spark.createDataFrame([(i, frames) for i in range(300)], "id long, x array<array<double>>")
    first = {r.id: r.m for r in df.repartition(7).select("id", masks.drop_frames("x", "id", 0.3, 1).alias("m")).collect()}
    again = {r.id: r.m for r in df.coalesce(1).orderBy(F.desc("id")).select("id", masks.drop_frames("x", "id", 0.3, 1).alias("m")).collect()}
    other = {r.id: r.m for r in df.select("id", masks.drop_frames("x", "id", 0.3, 2).alias("m")).collect()}
    assert first == again and first != other
    dropped = sum(f == [0.0] * 3 for m in first.values() for f in m)
    assert 0.25 < dropped / 2400 < 0.35 and all(f in ([0.0] * 3, frames[i]) for m in first.values() for i, f in enumerate(m))
    bands = [r.m for r in df.select(masks.mask_bands("x", "id", (1, 4), (1, 2), 3).alias("m")).collect()]
    for m in bands:
        hidden = [i for i, f in enumerate(m) if f == [0.0] * 3]
        steps = [j for j in range(3) if all(f[j] == 0 for f in m)]
        assert len(hidden) <= 4 and hidden == list(range(min(hidden, default=0), max(hidden, default=-1) + 1)) and len(steps) <= 2
    assert len({str(m) for m in bands}) > 10


def test_gates_and_networks_equal_numpy(spark):
    r = np.random.default_rng(1)
    layer = lambda n, m: (r.normal(0, 1, (n, m)).tolist(), r.normal(0, 1, n).tolist())
    nets = {"a": [layer(3, 2), layer(1, 3)], "b": [layer(1, 4)]}
    classifier = [layer(5, 6), layer(2, 5), layer(1, 2)]
    rows = [(r.normal(0, 1, 2).tolist(), r.normal(0, 1, 4).tolist()) for _ in range(5)] + [(None, [1.0] * 4), ([1.0] * 2, None), (None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "id long, a array<double>, b array<double>")
    features, sizes = {"a": F.col("a"), "b": F.col("b")}, {"a": 2, "b": 4}

    def net(x, layers):
        for k, (w, bias) in enumerate(layers):
            x = np.array(w) @ x + bias
            x = np.maximum(x, 0) if k < len(layers) - 1 else x
        return float(x[0])

    for softmax in (False, True):
        got = {g.id: g.g for g in df.select("id", gated.gated_fusion(features, sizes, nets, classifier, softmax).alias("g")).collect()}
        for i, (a, b) in enumerate(rows):
            raw = {m: net(np.array(x), nets[m]) for m, x in (("a", a), ("b", b)) if x is not None}
            total = sum(map(math.exp, raw.values()))
            gate = {m: math.exp(v) / total if softmax else 1 / (1 + math.exp(-v)) for m, v in raw.items()}
            assert {m: got[i][m] for m in "ab"} == {m: pytest.approx(gate[m]) if m in gate else None for m in "ab"}
            x = np.concatenate([np.array(x) * gate[m] if x is not None else np.zeros(sizes[m]) for m, x in (("a", a), ("b", b))])
            assert got[i].logit == (pytest.approx(net(x, classifier)) if raw else None)


def test_face_crop_takes_the_largest_face_of_a_quarter(spark):
    face = "struct<x:int,y:int,w:int,h:int>"
    rows = [([(10, 10, 30, 30), (40, 40, 25, 28), (0, 0, 90, 10)], False), ([(5, 5, 90, 70)], False), ([(10, 10, 30, 30)], True), ([], False), (None, False), ([(10, 10, 20, 30)], None)]
    df = spark.createDataFrame(rows, f"f array<{face}>, art boolean")
    got = [r[0] and tuple(r[0]) for r in df.select(pictures.face_crop("f", F.lit(100), F.lit(80), F.col("art"))).collect()]
    assert got == [(3, 3, 47, 47), None, None, None, None, None]


def test_rows_of_several_files_are_numbered_as_they_lie(spark, tmp_path):
    for part in range(3):
        spark.range(100 * part, 100 * part + 40 + part).coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    rows = spark.read.parquet(*(str(tmp_path / f"p{part}") for part in range(3)))
    got = {r.ordinal: r.id for r in tables.numbered_scan(rows).collect()}
    want = [i for part in range(3) for i in range(100 * part, 100 * part + 40 + part)]
    assert got == dict(enumerate(want))
    missing = tables.spot_check(rows, rows.where("id % 2 = 0"), "id", stride=25)
    assert sorted(r.id for r in missing.collect()) == sorted(v for i, v in got.items() if (i % 25 == 0 or i == len(want) - 1) and v % 2) and missing.columns == ["id"]


def test_age_is_that_of_the_clock_as_written(spark, tmp_path):
    """Between 13:00 on 9 March and 1:30 on 11 March the clock shows 36.5 hours, of which New York skipped one."""
    from veritable.plans import catalog, kernels  # noqa: F401

    spark.sql("select cast(id as long) as event_id, case id when 0 then timestamp_ntz'2024-03-09 13:00:00' when 1 then timestamp_ntz'2024-03-11 01:30:00.9' end as ts from range(3)").write.parquet(str(tmp_path / "events.parquet"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.event_id: r.expired for r in catalog.QUERIES["p45_expired"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {0: True, 1: False, 2: None}


@pytest.mark.parametrize("newest, expired", [("00.499999", False), ("00.5", False), ("00.500001", True), ("01.5", True), ("02.5", True), ("03", True)])
def test_newest_time_is_rounded_and_others_are_cut(spark, tmp_path, newest, expired):
    """Ages of 36 hours and less than a second, as the SQL has them: cut newest times gave an age of 36 hours, not expired."""
    import duckdb

    from veritable.plans import catalog, kernels  # noqa: F401

    edge = {"00": "00", "01": "01", "02": "01", "03": "02"}[newest[:2]]
    spark.sql(f"select cast(id as long) as event_id, case id when 0 then timestamp_ntz'2024-03-09 13:00:{edge}.7' when 1 then timestamp_ntz'2024-03-11 01:00:{newest}' end as ts from range(3)").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.expired for r in catalog.QUERIES["p45_expired"](spark, str(tmp_path)).collect()}
    assert got == {0: expired, 1: False, 2: None}
    with duckdb.connect() as db:
        db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert dict(db.execute(catalog.ORACLE_SQL["p45_expired"]).fetchall()) == got


def test_rounding_keeps_the_sign_of_zero(spark):
    from veritable.plans import bindings

    df = spark.createDataFrame([(x,) for x in (-1e-7, 1e-7, 0.0, -0.0, -0.1234565, 1.5, None)], "x double")
    got = [r[0] for r in df.select(bindings.rounded(F.col("x"))).collect()]
    assert list(map(repr, got)) == ["-0.0", "0.0", "0.0", "-0.0", "-0.123457", "1.5", "None"]


def test_small_negative_numbers_stay_negative_in_registered_queries(spark, tmp_path):
    from veritable.plans import catalog, features  # noqa: F401

    v = [-1e-7 if i % 2 else 0.5 for i in range(64)]
    spark.createDataFrame([(0, v)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, column in (("v03_dropped_frames", "masked"), ("v09_center_fit", "cropped"), ("v11_masked_bands", "masked"), ("v16_align", "aligned")):
        got = catalog.QUERIES[name](spark, str(tmp_path)).first()[column]
        assert "-0.0" in map(repr, got), name


def test_rows_of_one_large_file_stay_where_they_are_read(spark, tmp_path):
    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "one"))
    plan = tables.numbered_scan(spark.read.parquet(str(tmp_path / "one")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_features_of_a_sample_are_gathered_once(spark, tmp_path):
    from veritable.plans import bindings, catalog, features  # noqa: F401

    rows = [(1, 1, 0.1, 0.2, 10.0), (1, 1, 0.05, 0.3, 4.0), (1, 2, None, 0.0, 5.0), (None, 1, 0.02, 0.1, 50.0), (2, None, 0.03, 0.05, 6.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.sample_id: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in bindings.fusion_rows(spark, str(tmp_path)).collect()}
    assert got == {"1-1": (0.5, 2.0, None), "1-2": (None, 0.0, None), None: (0.3, 1.0, 1.0)}
    for name in ("f05_feature_fusion", "f06_gated_fusion", "f08_triad"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "pivotfirst" not in plan and "Generate explode" not in plan, name
