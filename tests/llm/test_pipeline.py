"""Every stage of the corpus pipeline against a brute-force version, and the whole run."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_output_operators import library_ids
from tests.llm.test_text_operators import naive_fingerprint, naive_groups
from veritable.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("sf")
    texts = [(prose(rng, rng.randint(30, 120), lang), lang) for _ in range(40) for lang in ("en", "de")]
    shared, item = prose(rng, 60), prose(rng, 30)
    texts += [(prose(rng, 40) + " " + shared + " " + prose(rng, 40), "en") for _ in range(4)]
    texts += [(prose(rng, 50) + " " + item + " " + prose(rng, 50), "en") for _ in range(3)]
    texts += [(t, lang) for t, lang in texts[:5]] + [(None, "en"), ("", None), ("12345 !!", "de"), (texts[3][0] + " more", None)]
    rows = [(i, t, lang, "src", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def naive_cut(texts, n=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b, windows = texts[i].encode(), []
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(b[p : p + n])
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    def apply(name, docs):
        out = stages[name](spark, docs, folder)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        rows = out.collect()
        return spark.createDataFrame(rows, out.schema), rows

    docs, rows = apply("language_id", docs)
    want = {i: t for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id: r.text for r in rows} == want

    docs, rows = apply("simhash_near_dedup", docs)
    groups = naive_groups({i: naive_fingerprint(t) for i, t in want.items()})
    want = {i: t for i, t in want.items() if groups[i] == i}
    assert {r.doc_id: r.text for r in rows} == want

    docs, rows = apply("suffix_array_dedup", docs)
    want = {i: t for i, t in naive_cut(want).items() if t.strip()}
    assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 0").first().text
    docs, rows = apply("benchmark_decontamination", docs)
    leaks = {i for i, t in want.items() if item in t}
    assert leaks and {r.doc_id for r in rows} == set(want) - leaks

    want = {i: t for i, t in want.items() if i not in leaks}
    _, pieces = apply("packing", docs)
    ids = dict(zip(want, library_ids("word_bpe_49k.json", list(want.values()))))
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert tokens == {i: len(x) + 1 for i, x in ids.items()}
    places = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0

    # where the line is cut depends on the order of the rows; what each document holds doesn't
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {(p.doc_id, p.doc_tokens) for p in whole} == {(p.doc_id, p.doc_tokens) for p in pieces}
    assert sum(p.length for p in whole) == sum(p.length for p in pieces)


def test_stages_take_odd_columns_nulls_and_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "2 as `my col`", "3 as `a.b`", "4 as kept_text", "5 as `tag`", "6 as component_id", "7 as carried")
    odd = odd.unionByName(odd.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.dtypes == odd.dtypes, name
            rows = out.collect()
            assert table is odd or not rows
            assert all((r["score"], r["lang_pred"], r["my col"], r["a.b"], r["tag"]) == (1, "x", 2, 3, 5) for r in rows)
            if table is odd:
                assert any(r.doc_id is None for r in rows), name
        corpus_pipeline.STAGES[-1][1](spark, table, folder).count()


def test_registered_queries_return_their_contracts(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    want = {
        "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op3_simhash": ["doc_id", "fingerprint", "component_id"], "op4_quality": ["doc_id", "held_out", "score", "predicted"],
        "op8_binary_output": ["doc_id", "start", "n_tokens", "ids_crc32"], "op9_sharding": ["doc_id", "shard", "n_bytes", "text_crc32"], "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op1_decontamination": ["doc_id", "contaminated", "item_id", "share", "cosine"],
        "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], "op13_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    }
    for name, columns in want.items():
        rows = queries.QUERIES[name](spark, sf).collect()
        assert len(rows) == n and list(rows[0].asDict()) == columns, name
        for r in rows:
            if "held_out" in columns:
                assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
            if "predicted" in columns:
                assert r.predicted == int(r.score >= 0.3)
    assert -1 in {r.conv_id for r in queries.QUERIES["op6_chat"](spark, sf).collect()}
