import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import compare as C
from veritable.operators import metrics as E

SCHEMA = "model string, split string, y int, prob double"
KEYS = ["model", "split"]


def table(spark, y, p, split="val"):
    return spark.createDataFrame([("m", split, int(a), float(b)) for a, b in zip(y, p)], SCHEMA)


def test_separable_scores(spark):
    s = table(spark, [0, 0, 1, 1], [0.1, 0.4, 0.6, 0.9])
    m = E.all_metrics(s, KEYS).first()
    assert (m.accuracy, m.roc_auc, m.pr_auc, m.eer, m.tp, m.fp, m.tn, m.fn) == (1.0, 1.0, 1.0, 0.0, 2, 0, 2, 0)


def test_published_confusion_matrix(spark):
    s = table(spark, [0] * 210 + [1] * 210, [0.1] * 163 + [0.9] * 47 + [0.1] * 53 + [0.9] * 157)
    m = E.classification(E.confusion(s, KEYS), KEYS).first()
    assert [round(v, 4) for v in (m.accuracy, m.precision, m.recall, m.f1)] == [0.7619, 0.7696, 0.7476, 0.7585]


def test_one_class_and_no_rows(spark):
    m = E.all_metrics(table(spark, [0, 0], [0.2, 0.3]), KEYS).first()
    assert m.balanced_accuracy == 1.0 and m.roc_auc is None and m.eer is None and m.note == "single_class"
    assert E.roc_auc(table(spark, [0, 0], [0.2, 0.3]), KEYS, single_class=0.5).first().roc_auc == 0.5
    assert E.curve_eer(table(spark, [0, 0], [0.2, 0.3]), KEYS).first().eer == 0.5
    assert E.ece(table(spark, [0, 0], [0.2, 0.3]), KEYS, null_on_single_class=True).first().ece is None
    assert E.all_metrics(table(spark, [], []), KEYS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_ranking_statistics_equal_definitions(spark, seed):
    r = random.Random(seed)
    y = [r.random() < 0.4 for _ in range(120)]
    p = [round(r.random(), 1 + seed % 2) for _ in y]
    s = table(spark, y, p)
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert E.roc_auc(s, KEYS).first().roc_auc == pytest.approx(auc, abs=1e-12)
    best = min((abs(sum(b >= t for b in neg) / len(neg) - sum(a < t for a in pos) / len(pos)), t) for t in sorted(set(p)))[1]
    want = (sum(b >= best for b in neg) / len(neg) + sum(a < best for a in pos) / len(pos)) / 2
    assert E.eer(s, KEYS).first().eer == pytest.approx(want, abs=1e-12)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, n = sum(a >= t for a in pos), sum(b >= t for b in p)
        ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
    assert E.pr_auc(s, KEYS).first().pr_auc == pytest.approx(ap, abs=1e-12)
    edges, ece = np.linspace(0, 1, 11), 0.0
    for k in range(10):
        inside = [(a, b) for a, b in zip(y, p) if edges[k] <= b < edges[k + 1] or (k == 9 and b == 1.0)]
        if inside:
            ece += abs(sum(a for a, _ in inside) - sum(b for _, b in inside)) / len(y)
    assert E.ece(s, KEYS).first().ece == pytest.approx(ece, abs=1e-12)


def test_reliability_lists_empty_bins(spark):
    rows = E.reliability_table(table(spark, [1, 0], [0.3, 1.0]), KEYS).orderBy("bin").collect()
    assert len(rows) == 10 and [r.n for r in rows] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 1]


def test_temperature_and_thresholds(spark):
    r = np.random.default_rng(0)
    z = r.normal(0, 2, 800)
    y = (r.random(800) < 1 / (1 + np.exp(-z))).astype(int)
    s = spark.createDataFrame([(float(a * 3), int(b), 1 / (1 + math.exp(-a * 3))) for a, b in zip(z, y)], "logit double, y int, prob double")
    t, before, after = E.fit_temperature(s)
    assert 2.4 < t < 3.7 and after < before
    grid = E.threshold_grid(0.10, 0.90, 0.01)
    got = E.best_balanced_threshold(s.withColumn("model", F.lit("m")), ["model"], grid).first()
    p, best = np.array(1 / (1 + np.exp(-3 * z))), (-1.0, 0.0, 0.0)
    for g in grid:
        v = round(((p[y == 1] >= g).mean() + (p[y == 0] < g).mean()) / 2, 12)
        best = max(best, (v, -abs(g - 0.5), -g))
    assert got.threshold == -best[2]
    assert E.fit_temperature(s.where("y = 1"))[0] == 1.0
    with pytest.raises(ValueError):
        E.fit_temperature(s.limit(0))
    assert E.best_balanced_threshold(table(spark, [1], [0.7]), KEYS, grid).first().threshold == 0.5


def test_gap_and_comparison(spark):
    s = table(spark, [0, 1], [0.1, 0.9], "test_seen")
    rows = E.classification(E.confusion(s, KEYS), KEYS)
    g = C.generalization_gap(rows, ["accuracy", "f1"]).first()
    assert g.accuracy_gap is None and g.note == "split_without_rows"
    both = s.union(table(spark, [0, 1], [0.9, 0.9], "test_unseen"))
    g = C.generalization_gap(E.classification(E.confusion(both, KEYS), KEYS), ["accuracy", "f1"]).first()
    assert g.accuracy_gap == 0.5 and g.note is None
    m = spark.createDataFrame([("a", 0.5, 0), ("b", 0.5, 1), ("c", None, 2)], "model string, v double, ord int")
    assert C.best_by(m, "v").first().label == "a" and C.best_by(m.where("v is null"), "v").first().label is None


def test_fusion(spark):
    parts = spark.createDataFrame([("x", "image", 0.8), ("x", "audio", 0.4), ("y", "video", 0.3), ("z", "image", None), ("w", "smell", 0.9)], "id string, modality string, prob double")
    got = {r.id: r for r in C.fuse(parts, "id", {"image": 2, "audio": 1, "video": 1}).collect()}
    assert set(got) == {"x", "y"} and got["x"].prob == pytest.approx((2 * 0.8 + 0.4) / 3, abs=1e-5) and got["y"].prob == pytest.approx(0.3, abs=1e-5)
    assert C.normalized_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    with pytest.raises(ValueError):
        C.normalized_weights({})


def test_ranked_scores_equal_counting_with_continuous_scores_and_null_keys(spark):

    r = random.Random(5)
    data = [(m, r.choice([0, 1]), r.random() ** k) for m, k in (("a", 1), (None, 30)) for _ in range(700)] + [("one", 1, 0.5), ("one", 1, 0.7)]
    scores = spark.createDataFrame(data, "model string, y int, prob double")
    for row in E.ranked_scores(scores, ["model"]).collect():
        mine = [(y, p) for m, y, p in data if m == row.model]
        below = [y for y, p in mine if p < row.prob]
        assert (row.below_pos, row.below_neg, row.n_pos + row.n_neg) == (sum(below), len(below) - sum(below), len(mine))
    auc = {x.model: x.roc_auc for x in E.roc_auc(scores, ["model"]).collect()}
    for m in ("a", None):
        pos, neg = ([p for k, y, p in data if k == m and y == want] for want in (1, 0))
        assert auc[m] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    assert auc["one"] is None and len(E.reliability_table(scores, ["model"]).where("model is null and n > 0").collect()) > 3


def test_pictures_that_are_not_square_have_no_spectrum(spark):
    from veritable.functions import arrays as A

    rows = spark.createDataFrame([([1.0] * 6,), (None,), ([],), ([1.0, None, 2.0, 3.0],), ([float(i) for i in range(256)],)], "v array<double>")
    got = rows.select(A.spectrum_magnitude("v").alias("s"), A.laplacian_variance("v").alias("l"), A.perceptual_hash("v").alias("h")).collect()
    assert [(r.s, r.l, r.h) for r in got[:4]] == [(None, None, None)] * 4
    # a ramp grows along both axes: of its low cosine waves those of row 0 and column 0 alone are not zero
    assert len(got[4].s) == 256 and got[4].h is not None


def test_picture_features_are_the_three_functions_in_one_python_process(spark, tmp_path):
    import random

    import __spark_entry__ as e
    from veritable.functions import arrays as A

    r = random.Random(6)
    odd = [([1.0] * 6,), (None,), ([],), ([1.0, None, 2.0, 3.0],), ([float("nan")] * 4,), ([2.5],), ([float(i) for i in range(256)],)]
    rows = spark.createDataFrame(odd + [([r.gauss(0, 1) for _ in range(64)],) for _ in range(2500)], "v array<double>").coalesce(1)
    one = rows.select("v", A.picture_features("v").alias("f")).select("v", "f.magnitude", "f.sharpness", "f.phash").collect()
    three = rows.select("v", A.spectrum_magnitude("v").alias("magnitude"), A.laplacian_variance("v").alias("sharpness"), A.perceptual_hash("v").alias("phash")).collect()
    assert list(map(str, one)) == list(map(str, three))
    spark.createDataFrame([(1, [0.5] * 64)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = e.queries()["v05_spectrum"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_null_keys_and_null_rows_in_every_metric(spark):
    """A null key has the metrics of its rows; rows without a score or a label count nowhere."""
    import random

    r = random.Random(4)
    rows = [(m, s, r.randrange(2), round(r.random(), 2)) for m in ("a", None) for s in ("s", None) for _ in range(60)]
    odd = [("a", "s", None, 0.9), ("a", "s", 1, None), (None, None, 1, None), ("only", "s", 1, None), ("one", "s", 1, 0.3), (None, "s", 1, 1.7)]
    df = spark.createDataFrame(rows + odd, "model string, split string, y int, prob double").repartition(3)
    got = {(g.model, g.split): g for g in E.all_metrics(df, ["model", "split"]).collect()}
    cal = {(g.model, g.split): g for g in E.calibration(df, ["model", "split"]).collect()}
    errors = {(g.model, g.split): g.ece for g in E.ece(df, ["model", "split"]).collect()}
    curve = {(g.model, g.split): g.eer for g in E.curve_eer(df, ["model", "split"]).collect()}
    grid = [0.0, 0.1, 0.25, 0.3, 0.5, 0.9]
    even = E.threshold_grid(0.05, 0.96, 0.01)
    for points in (grid, even):
        counts = {(c.model, c.split, c.threshold): (c.tp, c.fp, c.tn, c.fn) for c in E.threshold_counts(df, ["model", "split"], points).collect()}
        for m, s in {(k[0], k[1]) for k in counts}:
            mine = [(y, p) for a, b, y, p in rows + odd if (a, b) == (m, s) and y is not None and p is not None]
            for t in points:
                assert counts[m, s, t] == (sum(y == 1 and p >= t for y, p in mine), sum(y == 0 and p >= t for y, p in mine), sum(y == 0 and p < t for y, p in mine), sum(y == 1 and p < t for y, p in mine))
    assert set(got) == {("a", "s"), ("a", None), (None, "s"), (None, None), ("only", "s"), ("one", "s")} == set(cal)
    for key, g in got.items():
        mine = [(y, p) for a, b, y, p in rows + odd if (a, b) == key and y is not None and p is not None]
        assert (g.tp, g.fn) == (sum(y == 1 and p >= 0.5 for y, p in mine), sum(y == 1 and p < 0.5 for y, p in mine))
        if not mine:
            assert (g.ece, g.brier, g.nll, g.roc_auc, cal[key].ece, key in errors) == (None, None, None, None, None, False)
            continue
        bins = {}
        for y, p in mine:
            if 0 <= p <= 1:
                bins.setdefault(min(9, sum(p >= e for e in E.bin_edges()) - 1), []).append((y, p))
        want = sum(abs(sum(y for y, _ in v) - sum(p for _, p in v)) for v in bins.values()) / len(mine)
        assert g.ece == pytest.approx(want) == pytest.approx(errors[key]) and cal[key].ece == pytest.approx(want, abs=1e-6)
        pos, neg = [p for y, p in mine if y], [p for y, p in mine if not y]
        if pos and neg:
            assert g.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) == pytest.approx(cal[key].roc_auc)
            at = {t: (sum(b >= t for b in neg) / len(neg), sum(a < t for a in pos) / len(pos)) for _, t in mine}
            t = min(at, key=lambda t: (abs(at[t][0] - at[t][1]), t))
            assert g.eer == pytest.approx(sum(at[t]) / 2) and 0 <= curve[key] <= 1
        else:
            assert g.roc_auc is None and g.eer is None and curve[key] == 0.5


def test_youden_threshold_and_single_class_auc(spark):
    df = spark.createDataFrame([("m", y, p) for y, p in ((0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8))] + [("one", 1, 0.2)], "model string, y int, prob double")
    got = {r.model: (r.threshold, r.value) for r in E.best_balanced_threshold(df, ["model"], [0.05, 0.3, 0.5, 0.9], near=None, criterion="youden").collect()}
    assert got["m"] == (0.3, 0.5) and got["one"][0] == 0.5
    assert {r.model: r.roc_auc for r in E.roc_auc(df, ["model"], single_class=0.5).collect()} == {"m": 0.75, "one": 0.5}
