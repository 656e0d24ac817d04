import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.operators import leakage as L
from veritable.operators import manifest as M
from veritable.operators import registry as R
from veritable.operators import splits as S

SPLIT = "sample_id string, path string, label string, identity_key string, generator string, source_image_key string, file_hash string, split_role string"


def record(i, role, **kw):
    base = {"sample_id": f"s{i}", "path": f"p{i}", "label": "real", "identity_key": f"id{i}", "generator": "stylegan", "source_image_key": f"src{i}", "file_hash": f"h{i}", "split_role": role}
    return tuple({**base, **kw}.values())


def shared(spark, rows, key):
    got = L.overlaps(spark.createDataFrame(rows, SPLIT), key, pairs=(("train", "test_seen"),)).first()
    return got.n_shared


@pytest.mark.parametrize("key", ["identity_key", "file_hash", "source_image_key"])
def test_overlap_of_two_roles(spark, key):
    rows = [record(1, "train", **{key: "dup"}), record(2, "test_seen", **{key: "dup"})]
    assert shared(spark, rows, key) == 1
    assert shared(spark, [record(1, "train"), record(2, "test_seen")], key) == 0
    assert shared(spark, [record(1, "train", **{key: "unknown"}), record(2, "test_seen", **{key: "unknown"})], key) == 0


def test_generator_leakage_reports_both_kinds(spark):
    df = spark.createDataFrame([record(1, "train", generator="deepfakes")], SPLIT)
    assert {r.kind for r in L.generator_leakage(df, ["deepfakes"], ["ffhq_authentic", "stylegan"]).collect()} == {"generator_leakage", "generator_policy"}


@pytest.mark.parametrize("n_real,violated", [(99, True), (1, False), (9, False)])
def test_class_balance(spark, n_real, violated):
    rows = [record(i, "train") for i in range(n_real)] + [record("f", "train", label="fake")]
    df = spark.createDataFrame(rows, SPLIT)
    balance = M.class_balance(df, "split_role", S.role_table(df))
    got = {r.split_role: r for r in L.balance_violations(balance).collect()}
    assert len(got) == 4 and got["train"].violated == violated and not got["val"].violated


def sequential(rows):
    paths, ids, out = set(), set(), []
    for o, p, i in rows:
        if p in paths:
            out.append("duplicate_path")
        elif i in ids:
            out.append("duplicate_id")
        else:
            paths.add(p)
            ids.add(i)
            out.append("kept")
    return out


def test_deduplicate_equals_the_sequential_rule(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for seed in range(4):
        r = random.Random(seed)
        rows = [(o, f"p{r.randrange(12)}", f"i{r.randrange(12)}") for o in range(40)]
        df = spark.createDataFrame(rows, "ord long, path string, sample_id string")
        got = [x.decision for x in M.deduplicate(df).orderBy("ord").collect()]
        assert got == sequential(rows)
    assert M.deduplicate(df.limit(0)).count() == 0


def test_duplicates_summary_and_violations(spark):
    rows = [("a", "/1", "deadbeef", "real", 5), ("b", "/2", "deadbeef", "fake", 7), ("c", "/3", "", None, 1), ("", "/4", None, "odd", 2)]
    df = spark.createDataFrame(rows, "sample_id string, path string, file_hash string, label string, file_size long")
    group = M.duplicate_content(df).collect()
    assert [(g.n, g.first_path, g.last_path) for g in group] == [(2, "/1", "/2")]
    s = M.summary(df).first()
    assert (s.n_rows, s.n_real, s.n_fake, s.n_unlabelled, s.total_bytes) == (4, 1, 1, 1, 15)
    assert {(v.sample_id, v.rule) for v in M.violations(df, ["sample_id"], "sample_id").collect()} == {("c", "bad_label"), ("", "empty:sample_id"), ("", "bad_label")}


def test_quota_and_subset(spark):
    rows = [(i, "real", "r") for i in range(30)] + [(100 + i, "fake", f"g{i % 3 if i < 40 else 9}") for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, label string, generator string")
    out = M.generator_quota(df, "sample_id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {"real": 30, "fake": 30}
    counts = {(r.label, r.subset): r["count"] for r in M.balanced_subset(df, "sample_id", 20).groupBy("label", "subset").count().collect()}
    assert counts == {(label, s): n for label in ("real", "fake") for s, n in (("train", 14), ("val", 3), ("test", 3))}


def test_registry_states(spark):
    reg = spark.createDataFrame([(1, "PROCESSED", "real"), (2, "PROCESSED", "real"), (3, "PROCESSING", "fake"), (4, "RAW", "fake"), (None, "ODD", None)], "id long, status string, label string")
    files = spark.createDataFrame([(1,), (4,), (9,)], "id long")
    meta = spark.createDataFrame([(1, "success", "v1", 0), (2, "failed", "v1", 2), (4, "success", "v0", 1)], "id long, status string, preprocessing_version string, retry_count int")
    now = {r.id: r.new_status for r in R.promote(reg, files, "id").collect()}
    assert (now[1], now[2], now[3], now[4]) == ("PROCESSED", "RAW", "FAILED", "PROCESSED")
    todo = {r.id: r.retry_count for r in R.eligible(reg.select("id"), meta, files, "id", "v1").collect()}
    assert todo == {3: 0, 4: 1, None: 0}
    assert {r.id for r in R.eligible(reg.select("id"), meta, files, "id", "v1", retry_failed=True).collect()} == {2, 3, 4, None}
    causes = {r.id: r.cause for r in R.reconcile(reg, files, meta, "id").collect()}
    assert causes[9] == "orphaned_file" and causes[2] == "lost_file" and causes[1] is None
    a = R.audit(reg, files, "id").first()
    assert (a.null_ids, a.null_labels, a.bad_status, a.processed_without_file) == (1, 1, 2, 1)
    got = {r.id: r.resolution for r in R.resolve_samples(reg.select("id"), meta, files, "id", "v1").collect()}
    assert got[1] == "resolved" and got[2] == "missing_metadata"
    merged = {r.id: (r.status, r.split) for r in R.merge_registry(reg.drop("status").withColumn("split", F.lit("x")), meta, spark.createDataFrame([(1, "val")], "id long, split_role string"), "id", files).collect()}
    assert merged[1] == ("PROCESSED", "val") and merged[2] == ("FAILED", "x") and merged[3] == ("RAW", "x")


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    hashes = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(8))) for b in base for _ in range(4)} | set(base)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in signed + signed[:5]], "hash long")
    got = sorted((x.a, x.b, x.distance) for x in L.near_hash_pairs(df, 64, 5).collect())
    want = sorted((min(a, b), max(a, b), d) for i, a in enumerate(signed) for b in signed[i + 1 :] if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 5)
    assert got == want and len(want) > 20
    plan = L.near_hash_pairs(df, 64, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairwise_and_generator_examples(spark):
    rows = [record(i, role, file_hash="x") + (i,) for i, role in enumerate(["train", "train", "val", "test_unseen"])]
    df = spark.createDataFrame(rows, SPLIT + ", ord int")
    pairs = {(p.sample_id_1, p.sample_id_2) for p in L.pairwise(df, "file_hash", "exact_duplicate", "sample_id", "ord").collect()}
    assert pairs == {("s0", "s2"), ("s0", "s3"), ("s1", "s2"), ("s1", "s3"), ("s2", "s3")}
    assert L.generator_pairs(df, "sample_id", "ord", most=1).count() == 1
    assert L.verdict(L.pairwise(df, "file_hash", "exact_duplicate", "sample_id", "ord").withColumn("severity", F.lit("warning"))).first().status == "PASS_WITH_WARNINGS"


def test_roles_and_splits(spark):
    keys = [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: (r.p, r.x) for r in df.select("k", S.md5_percent("k").alias("p"), S.md5_fraction("k").alias("x")).collect()}
    for k in keys:
        h = hashlib.md5(k.encode()).hexdigest()
        assert got[k] == (int(h, 16) % 100, int(h[:8], 16) / 0xFFFFFFFF)
    role = spark.createDataFrame([("train", "a"), ("valid", "a"), ("test", "a"), ("train", "z"), ("odd", "a")], "u string, g string").select(S.upstream_role("u", "g", ["z"])).collect()
    assert [r[0] for r in role] == ["train", "val", "test_seen", "test_unseen", None]
    clips = spark.createDataFrame([("s1", False), ("s1", True), ("s2", False)], "speaker string, bad boolean")
    roles = {(r.speaker, r.split_role) for r in S.speaker_roles(clips, unseen=F.col("bad"), min_clips=2).collect()}
    assert roles == {("s1", "test_unseen"), ("s2", "train")}
    shares = {r.subset: r["count"] for r in S.hashed_shares(df, "k").groupBy("subset").count().collect()}
    assert shares == {"train": 140, "val": 30, "test": 30}
    assert S.forbidden_features(["a", "target"], ["target", "id"]) == ["target"]


def test_rows_with_nulls_are_kept(spark):
    from veritable.operators import tabular

    rows = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, None, None), (3, "b", "2024-01-01 09:00:00"), (None, "b", "2024-02-01 00:00:00")], "k long, g string, ts string")
    shares = S.hashed_shares(rows, "k", stratum="g")
    assert shares.count() == 4 and shares.where("g is null").count() == 1
    cut = {(r.k, r.subset) for r in S.time_aware(rows, "ts", "k", (0.5, 0.25)).collect()}
    assert cut == {(3, "train"), (1, "train"), (None, "val"), (2, "test")}
    roles = S.speaker_roles(rows, "g").collect()
    assert len(roles) == 4 and [r.split_role for r in roles if r.g is None] == ["train"]
    tainted = S.speaker_roles(rows, "g", F.col("k") == 3)
    assert {r.k: r.split_role for r in tainted.where("g = 'b' or g is null").collect()} == {3: "test_unseen", None: "test_unseen", 2: "train"}
    weights = tabular.balanced_weights(spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "y int"))
    assert {r.y: r.weight for r in weights.collect()} == {0: 4 / 6, 1: 2.0}


def test_five_paths_of_a_shared_content(spark):
    rows = spark.createDataFrame([("h", f"p{i}") for i in range(9)] + [("x", "only"), (None, "n"), ("", "e"), ("", "f")], "file_hash string, path string")
    (got,) = M.duplicate_content(rows).collect()
    assert (got.n, got.first_path, got.last_path, got.paths) == (9, "p0", "p8", ["p0", "p1", "p2", "p3", "p4"])


def test_hash_ranks_equal_a_sort(spark):
    rows = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, id % 3) as g")
    got = {r.id: (r["__r"], r["__total"]) for r in S.hash_ranks(rows, "id", ["g"]).collect()}
    for g in (None, 0, 1, 2):
        ids = sorted((i for i in range(500) if (None if i % 7 == 0 else i % 3) == g), key=lambda i: hashlib.md5(f"s{i}".encode()).hexdigest())
        assert [got[i] for i in ids] == [(k + 1, len(ids)) for k in range(len(ids))]


def test_deduplicate_with_nulls_and_chains(spark):
    rows = [(0, None, None), (1, None, "a"), (2, "p", None), (3, "p", "b"), (4, "-", "c"), (5, None, "c")]
    df = spark.createDataFrame(rows, "ord long, path string, sample_id string")
    assert [x.decision for x in M.deduplicate(df).orderBy("ord").collect()] == sequential(rows)
    chain = [(i, f"p{(i + 1) // 2}", f"i{i // 2}") for i in range(9)]  # each waits for the one before
    df = spark.createDataFrame(chain, "ord long, path string, sample_id string")
    assert [x.decision for x in M.deduplicate(df).orderBy("ord").collect()] == sequential(chain)
    with pytest.raises(RuntimeError):
        M.deduplicate(df, rounds=2)
    with pytest.raises(ValueError):
        M.deduplicate(spark.createDataFrame([(None, "p", "i")], "ord long, path string, sample_id string"))


def test_ranks_with_many_null_keys_and_times(spark):
    rows = spark.range(400).selectExpr("id", "if(id < 300, null, id) as k", "if(id < 250, null, timestamp_seconds(id % 60)) as ts")
    ranked = S.hash_ranks(rows.repartition(6), "k", []).collect()
    assert sorted(r["__r"] for r in ranked) == list(range(1, 401)) and {r["__total"] for r in ranked} == {400}
    cut = S.time_aware(rows, "ts", "k", (0.25, 0.10)).collect()
    timed = sorted((r.ts, r.k is not None, r.k or 0) for r in cut if r.ts)
    assert [sum(r.subset == s for r in cut) for s in ("train", "val", "test")] == [100, 40, 260]
    assert {(r.ts, r.k is not None, r.k or 0) for r in cut if r.subset == "train"} == set(timed[:100])


def test_first_wins_takes_the_least_of_each_key(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, None, "n"), ("b", 7, None)], "k string, o int, v string")
    assert {(r.k, r.o, r.v) for r in M.first_wins(rows, "k", ["o"]).collect()} == {("a", 1, "y"), (None, None, "n"), ("b", 7, None)}
    assert M.first_wins(rows, "k", ["o"]).columns == rows.columns


def test_counts_of_classes_give_the_verdict_of_all_pairs(spark):
    r = random.Random(9)
    roles = ["train", "val", "test_seen", "test_unseen", None]
    rows = [(i, f"s{i}", r.choice(["h1", "h2", "h3", None]), r.choice(roles)) for i in range(60)] + [(100, "x", "h9", "val"), (101, "y", "h9", "val")]
    df = spark.createDataFrame(rows, "ord long, sample_id string, file_hash string, split_role string")
    pairs = L.pairwise(df, "file_hash", "exact_duplicate", "sample_id", "ord")
    unseen = (F.col("split_1") == "test_unseen") | (F.col("split_2") == "test_unseen")
    want = L.verdict(pairs.withColumn("severity", F.when(unseen, "critical").otherwise("warning"))).first()
    classes = L.duplicate_classes(df, "file_hash", "sample_id")
    assert L.count_pairs(classes, "file_hash").first() == want and want.n_violations > 100
    assert {c.file_hash for c in classes.collect()} == {"h1", "h2", "h3"} and sum(c.n for c in classes.collect()) == sum(h in ("h1", "h2", "h3") and s is not None for _, _, h, s in rows)
    assert L.count_pairs(classes.limit(0), "file_hash").first().status == "PASS"


@pytest.mark.parametrize("agree", [None, 1, 2, 4])
def test_near_hashes_of_64_bits_whatever_bands_agree(spark, agree):
    r = random.Random(3)
    hashes = [r.getrandbits(64) for _ in range(20)]
    for h in list(hashes):
        for n in (1, 5, 6, 7):
            for k in r.sample(range(64), n):
                h ^= 1 << k
            hashes.append(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(h,) for h in [*signed, None, signed[0]]], "hash long")
    got = {(p.a, p.b, p.distance) for p in L.near_hash_pairs(df, 64, 6, agree=agree).collect()}
    unsigned = {s: h for s, h in zip(signed, hashes)}
    want = {(a, b, (unsigned[a] ^ unsigned[b]).bit_count()) for a in unsigned for b in unsigned if a < b and 1 <= (unsigned[a] ^ unsigned[b]).bit_count() <= 6}
    assert got == want and len(want) >= 40
    assert L.bands_to_agree(10**9, 64, 6) > L.bands_to_agree(1000, 64, 6)


@pytest.mark.parametrize("agree", [4, 5])
def test_choices_of_bands_are_little_code(spark, agree, monkeypatch):
    """All choices of five bands of ten as columns of their own did not compile, beyond 64 KB a method."""
    monkeypatch.setattr(L, "bands_to_agree", lambda *_: agree)
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        df = spark.createDataFrame([(k, h, "train" if k % 2 else "val") for k, h in enumerate([0, 1, 31, 63, -1, -2, 1 << 31])], "id int, hash long, role string")
        got = {(r.id_1, r.id_2, r.distance) for r in L.near_duplicates(df, "hash", "id", "role", 64, 5).collect()}
        near = {(r.anchor, r.n_near) for r in L.near_clusters(df, "hash", "id", 64, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
        spark.conf.unset("spark.sql.codegen.fallback")
    assert got == {(0, 1, 1), (1, 2, 4), (2, 3, 1), (1, 6, 2), (4, 5, 1)}
    assert near == {(0, 3), (1, 3), (2, 1), (4, 1)}


def test_near_duplicates_of_whole_vectors(spark):
    """All pairs of the 24-bit hashes within four bits; five bits of 32 had left 4 of these."""
    from veritable.plans import bindings, catalog

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    hashes = {r.vec_id: sum(1 << i for i in range(24) if sum(r.embedding[i::24]) > 0) for r in rows}
    assert {r.vec_id: r.hash for r in bindings.hash24(spark, sf).collect()} == hashes
    want = {(a, b) for a in hashes for b in hashes if a < b and (a + b) % 2 and 1 <= (hashes[a] ^ hashes[b]).bit_count() <= 4}
    assert {(r.id_1, r.id_2) for r in catalog.QUERIES["j16_near_duplicates"](spark, sf).collect()} == want and len(want) > 40


def test_cells_are_dealt_by_their_comparisons(spark):
    """Some hashes are few bytes: their cells, 35 times as many, were broadcast and compared in a single task."""
    df = spark.range(24000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 24)).alias("hash"), F.when(F.col("id") % 2 == 0, "train").otherwise("val").alias("role"), "id")
    pairs = L.near_hash_pairs(df, 24, 4, role="role")
    tasks = pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.count_if(F.expr("distance between 1 and 4 and a < b")).alias("ok")).collect()
    assert len(tasks) > 1 and all(t.n == t.ok for t in tasks)
    rows = df.groupBy("hash").agg(F.min("role").alias("lo"), F.max("role").alias("hi")).orderBy("hash").toPandas()
    h, only = rows["hash"].to_numpy(), np.where(rows.lo == rows.hi, rows.lo == "val", 2)
    near = 0
    for i in range(0, len(h), 500):
        d = np.bitwise_count(h[i : i + 500, None] ^ h[None, i:])
        near += int(((d <= 4) & (np.arange(len(h) - i) > np.arange(len(d))[:, None]) & ((only[i : i + 500, None] != only[None, i:]) | (only[None, i:] == 2))).sum())
    assert sum(t.n for t in tasks) == near


def test_near_duplicates_reach_five_bits(spark):
    """Five bits of 24 of whole vectors, the threshold of the original check; four bits left 58 of these pairs."""
    from veritable.plans import bindings, catalog

    sf = "/root/testdata/sf0.01"
    hashes = {r.vec_id: r.hash for r in bindings.hash24(spark, sf).collect()}
    near = {(a, b): d for a in hashes for b in hashes if a < b and (a + b) % 2 and 1 <= (d := (hashes[a] ^ hashes[b]).bit_count()) <= 5}
    assert {(r.id_1, r.id_2): r.distance for r in catalog.QUERIES["j16_near_duplicates"](spark, sf).collect()} == near
    assert len(near) > 200 and "between 1 and 5" in catalog.ORACLE_SQL["j16_near_duplicates"]
