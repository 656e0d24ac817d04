import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import attributions, audits, scoring, tabular
from veritable.sources.commits import BatchTable


def test_scoring_and_processing(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)] + [(10, None)], "id long, x double")
    got = {r.id: r.logit for r in scoring.score_batches(df.where("x is not null"), lambda: lambda b: b["x"] * 2, ["id"], 3).collect()}
    assert got == {i: 2.0 * i for i in range(10)}

    def work(row):
        if row["x"] > 7:
            raise ValueError("too big")
        return {"half": row["x"] / 2}

    rows = {r.id: r for r in scoring.process(df.where("x is not null"), work, "id", "half double").collect()}
    assert rows[4].half == 2.0 and rows[4].status == "success" and rows[9].status == "failed" and rows[9].error_message == "ValueError: too big"


def test_resume_and_recovery(spark):
    reg = spark.createDataFrame([(1, "RAW", 1.0), (2, "PROCESSING", 9.0), (3, "PROCESSED", 2.0), (4, "PROCESSING", 1.0)], "id long, status string, x double")
    meta = spark.createDataFrame([(3, "success", "v1", 0)], "id long, status string, preprocessing_version string, retry_count int")
    run = scoring.resume(reg, meta, spark.createDataFrame([(3,)], "id long"), lambda r: {"y": 1 / (r["x"] - 9)}, "id", "y double", "v1")
    got = {r.id: r.status for r in run.collect()}
    assert got == {1: "success", 2: "failed", 4: "success"}
    now = {r.id: (r.status, r.failure_reason) for r in scoring.recovered(reg, run.where("id < 4"), "id").collect()}
    assert now[1] == ("PROCESSED", None) and now[2][0] == "FAILED" and now[3] == ("PROCESSED", None) and now[4] == ("FAILED", "interrupted")


def test_throughput(spark):
    log = spark.createDataFrame([("r", "2024-01-01 00:00:00", 0), ("r", "2024-01-01 00:00:10", 50)], "run string, at string, done long").withColumn("at", F.to_timestamp("at"))
    last = scoring.throughput(log, "at", "done", 100).orderBy("at").collect()[-1]
    assert (last.per_second, last.seconds_left) == (5.0, 10.0)


def test_modality_checks(spark):
    schema = "speaker_id string, file_hash string, generator string, label string, split_role string"
    rows = [("s", "h", "A01", "fake", "train"), ("s", "g", "A07", "fake", "test_unseen")]
    df = spark.createDataFrame(rows, schema)
    balance = spark.createDataFrame([], "split_role string, n_real long, n_fake long")
    got = {(r.kind, r.subject, r.n) for r in audits.check_modality(df, "audio", ["A07"], None, balance).collect()}
    assert got == {("speaker_leakage", "train_x_test_unseen", 1)}
    files = spark.createDataFrame([(f"/d/{i}.jpg",) for i in range(8)] + [("/e/1.jpg",)], "path string")
    assert [r.folder for r in audits.crowded_folders(files).collect()] == ["/d"]


def test_tabular_pipeline(spark):
    rows = [(float(i % 10), None if i % 7 == 0 else float(i % 3), "a" if i % 2 else "b", float(i % 10 > 6), i / 400) for i in range(400)]
    df = spark.createDataFrame(rows, "u double, v double, c string, y double, pos double")
    model = tabular.fit(df, ["u", "v"], ["c"])
    scored = tabular.score(model, df.withColumn("c", F.lit("never seen")))
    assert scored.where("(prob >= 0.5) <> (y = 1)").count() < 60
    assert tabular.importance(model)[0][0] == 0
    iso = tabular.fit_isotonic(scored)
    assert tabular.calibrate(iso, scored).agg(F.max("prob")).first()[0] <= 1.0
    folds = tabular.cross_validate(df, ["u"], ["c"], 2, "pos").collect()
    assert len(folds) == 2 and all(r.roc_auc == pytest.approx(1.0) for r in folds)


class Stopped(Exception):
    pass


def test_runs_are_resumed_and_each_row_is_there_once(spark, tmp_path):
    reg = spark.createDataFrame([(i, "RAW", float(i)) for i in range(40)] + [(None, "RAW", 1.0)], "id long, status string, x double")
    table = BatchTable(spark, str(tmp_path / "runs"))

    def work(row):
        if row["x"] % 10 == 3:
            raise ValueError("no")
        return {"half": row["x"] / 2}

    def stopper(part, point):
        def stop(now, where):
            if (now, where) == (part, point):
                raise Stopped

        return stop

    for part, point in ((0, "written"), (1, "committed"), (3, "written")):
        with pytest.raises(Stopped):
            scoring.run_batches(reg, table, work, "id", "half double", "v1", batches=4, stop=stopper(part, point))
    done = scoring.run_batches(reg, table, work, "id", "half double", "v1", batches=4)
    rows = [(r.id, r.half, r.status) for r in table.read().collect()]
    assert sorted(rows, key=str) == sorted([(i, None if i % 10 == 3 else i / 2, "failed" if i % 10 == 3 else "success") for i in range(40)] + [(None, 0.5, "success")], key=str)
    assert {r.id: (r.status, r.failure_reason) for r in done.collect() if r.id is not None} == {i: ("FAILED", "ValueError: no") if i % 10 == 3 else ("PROCESSED", None) for i in range(40)}
    folders = [p for p in (tmp_path / "runs" / "data").iterdir()]
    assert len(folders) == 6 and len(table.batches()) == 4  # two attempts were never committed


def test_a_batch_is_appended_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"))
    assert table.read() is None and not table.committed("a")
    rows = spark.range(3)
    assert table.append(rows, "a") and not table.append(rows, "a") and table.append(rows.limit(0), "b")
    assert not table.commit(table.write(spark.range(9)), "a")
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2] and table.read().columns == ["id"]
    with pytest.raises(ValueError):
        table.append(rows, "../a")


def subsets_value(found, x, known):
    """The tree game: what leaves give if only ``known`` features are."""
    total = 0.0
    for leaf in found:
        share, passes = 1.0, leaf.passes(x[None])[:, 0]
        for k, (feature, test) in enumerate(leaf.tests.items()):
            share *= passes[k] if feature in known else test[3]
        total += leaf.value * share
    return total


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_attributions_equal_all_subsets(spark, kind):
    r = random.Random(2)
    rows = [(i, r.random(), r.choice([None, r.random()]), r.random(), r.choice("abc")) for i in range(300)]
    df = spark.createDataFrame([(*x, float(x[1] + (x[4] == "a") * (x[3] > 0.5) > 0.8)) for x in rows], "id long, p double, q double, s double, kind string, y double")
    model = tabular.fit(df, ["p", "q", "s"], ["kind"], model=kind)
    got = attributions.shapley(model, df).collect()
    prob = {v.id: v.prob for v in tabular.score(model, df).select("id", "prob").collect()}
    last = model.stages[-1]
    for v in got:
        assert v.base + sum(v.shapley) == pytest.approx(v.margin, abs=1e-9)
        scale = 1 if kind == "logistic" else 2
        assert 1 / (1 + math.exp(-scale * v.margin)) == pytest.approx(prob[v.id], abs=1e-9)
    means = attributions.mean_magnitudes(spark.createDataFrame(got), [f"f{i}" for i in range(len(got[0].shapley))])
    assert means.count() == len(got[0].shapley)
    if kind == "logistic":
        assert sum(v.margin for v in got) / len(got) == pytest.approx(got[0].base)
        return
    found = attributions._tree_leaves(last, spark)
    features = {v.id: np.array(v.features.toArray()) for v in model.transform(df.withColumn("weight", F.lit(1.0))).select("id", "features").collect()}
    used = sorted({f for leaf in found for f in leaf.tests})[:6]
    for v in got[:4]:
        x = features[v.id]
        n = len(x)
        for i in used:
            rest, total = [k for k in range(n) if k != i], 0.0
            for size in range(n):
                for known in itertools.combinations(rest, size):
                    weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    total += weight * (subsets_value(found, x, {*known, i}) - subsets_value(found, x, set(known)))
            assert v.shapley[i] == pytest.approx(total, abs=1e-9)
