"""Packing, chat formatting, embeddings, binary output and sharding: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from veritable.llm import binary_output, chat, embedding_dedup, packing, range_coder, sharding, tokens

ODD = ["It's 12ab3 don't!!  ", "  x  ", "\n", "a\x1cb c  d\n\n e f", "<|endoftext|> ΣΑΣ", " \t a\t\tb \r\n c"]


def library_ids(name, texts):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_piece_tokenizer_equals_library(name, cut, awkward, rng, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 50)
    texts = ODD + awkward + [prose(rng, 50) for _ in range(40)]
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path(name), cut)
    for at in range(0, len(texts), 7):
        ids, counts = tokenizer.encode(texts[at : at + 7], 1)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [x + [1] for x in library_ids(name, texts[at : at + 7])]


def test_pieces_used_most_stay_for_the_next_task(rng, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 300)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 120)
    often = [f"w{i}" for i in range(100)]
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path("word_bpe_49k.json"), "word")
    for task in range(3):
        for k in range(6):
            texts = [" ".join(often), " ".join(f"x{task}y{k}z{i}" for i in range(90)), " ".join(rng.sample(often, 50))]
            ids, counts = tokenizer.encode(texts, 1)
            assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [x + [1] for x in library_ids("word_bpe_49k.json", texts)]
        tokenizer.forget()
        assert len(tokenizer.numbers) == 120 and set(often) <= set(tokenizer.numbers)
    # a task that breaks off while it learns leaves nothing behind
    monkeypatch.setattr(tokenizer, "_together", lambda pieces: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tokenizer.encode(["never seen"])
    tokenizer.forget()
    assert not tokenizer.numbers


def test_packing_places_every_id_once(spark, make_docs, awkward, rng):
    texts = [prose(rng, rng.randint(1, 900)) for _ in range(60)] + awkward + ODD
    want = [x + [1] for x in library_ids("word_bpe_49k.json", texts)]
    pieces = packing.pack(make_docs(texts).repartition(5), length=256, with_ids=True)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 256 + r.offset == at and r.offset + r.length <= 256
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (r.ids, r.ids_crc32, r.doc_tokens) == (ids, zlib.crc32(ids), len(want[r.doc_id]))
        at += r.length
    assert at == sum(map(len, want))
    whole = packing.sequences(pieces, 256).orderBy("sequence_id").collect()
    line = np.frombuffer(b"".join(r.ids for r in whole), "<u4")
    assert len(line) == 256 * len(whole) and (line[:at] == np.concatenate([want[r.doc_id][r.start : r.start + r.length] for r in rows])).all() and not line[at:].any()
    assert packing.pack(make_docs([])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.where(r.random(n) < 0.5, r.integers(0, 9, n), r.zipf(1.3, n) % 100_000).astype(np.uint32)
    data = range_coder.encode_block(ids)
    assert (range_coder.decode_block(data) == ids).all()
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_block(bytes(broken))


def test_binary_output_round_trip(spark, make_docs, awkward, rng, tmp_path):
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(50)] + awkward + ODD
    want = [x + [0] for x in library_ids("byte_bpe_50k.json", texts)]
    binary_output.write(make_docs(texts).repartition(6), str(tmp_path / "t"), block_tokens=3000)
    blocks = spark.read.parquet(str(tmp_path / "t"))
    assert blocks.count() > 5
    at = 0
    for i, r in enumerate(sorted(binary_output.read(blocks, with_ids=True).collect(), key=lambda r: r.doc_id)):
        ids = np.array(want[i], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, at, len(want[i]), zlib.crc32(ids), ids)
        at += len(want[i])
    binary_output.write(make_docs([]), str(tmp_path / "e"))
    assert binary_output.read(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_chat_escapes_and_reads_back(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "&lt;| &amp; <", "", None, "<\n|", "a\nb"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "sy<|\ns&", None))]
    table = spark.createDataFrame(rows + rows[:3] + [(None, 1, "user", "x"), (2, None, "assistant", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_log(chat.as_events(table))).collect()}
    told = sorted(((k, r or "", t or "") for _, k, r, t in rows + rows[:3]), key=lambda x: (x[0], x[1], x[2]))
    loss = "".join(t for _, r, t in told if r == "assistant")
    assert got[1].n_turns == len(told)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in told).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert set(got) == {1, 2, None} and got[2].loss_chars == 1
    plan = chat.digests(chat.format_log(chat.as_events(table)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_folds_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 1, "user", "hello"), (1, 2, "message", 2, "assistant", "H"), (1, 3, "delta", 2, "assistant", "i "), (1, 4, "delta", 2, "assistant", "you"),
        (1, 5, "message", 3, "user", "old question"), (1, 6, "delta", 4, "assistant", "old answer"), (1, 7, "edit", 3, "user", "new question"),
        (1, 8, "delta", 4, "assistant", "first "), (1, 9, "delta", 4, "assistant", "try"), (1, 10, "regenerate", 4, "assistant", None), (1, 11, "delta", 4, "assistant", "second"),
        (1, 12, "message", 5, "user", "gone"), (1, 13, "delete", 5, "user", None), (2, 1, "delta", 1, "assistant", "alone"),
    ]
    events = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, event string, turn long, role string, text string")
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.fold(events).orderBy("conv_id", "turn").collect()]
    assert got == [(1, 1, "user", "hello"), (1, 2, "assistant", "Hi you"), (1, 3, "user", "new question"), (1, 4, "assistant", "second"), (2, 1, "assistant", "alone")]
    with pytest.raises(Exception, match="unknown event"):
        chat.fold(events.withColumn("event", F.lit("shout"))).collect()
    assert chat.format_log(events.limit(0)).count() == 0


@pytest.mark.parametrize("crowded, noise", [(2, 0.12), (64, 0.12), (64, 0.03), (64, 0.2)])
def test_embedding_dedup_equals_brute_force(spark, crowded, noise):
    r = np.random.default_rng(5)
    centers = r.standard_normal((30, 32))
    x = (centers[r.integers(0, 30, 300)] + noise * r.standard_normal((300, 32))).astype(np.float32)
    x[50:70] = x[50]
    x[70] = x[50] * 2
    label = r.integers(0, 3, 300).tolist()
    label[50:71] = [1] * 21
    rows = [(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, label))]
    rows += [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] * 32, 1), (303, rows[50][1], None), (304, [], 1), (305, [None] + [1.0] * 31, 1), (306, [1.0, 0.0], 1), (307, [1.0, 0.0], 1), (308, [float("inf")] + [1.0] * 31, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    got = {g.vec_id: g for g in embedding_dedup.near_duplicates(table, crowded=crowded).collect()}
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near, False)
    want = np.arange(300)
    while True:
        low = np.minimum(want, np.where(near, want[None, :], 10**6).min(1))
        if (low == want).all():
            break
        want = low
    assert [got[i].n_links for i in range(300)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(300)] == want.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (300, 301, 302, 303, 304, 305, 308))
    assert (got[306].n_links, got[307].component_id, got[307].kept) == (1, 306, False)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_sharding_compacts_and_versions(spark, make_docs, tmp_path, rng):
    table = sharding.ShardTable(spark, str(tmp_path / "t"), small=2000, fanout=3, target=40_000)
    with pytest.raises(ValueError):
        table.read()
    everything = []
    for k in range(5):
        texts = [prose(rng, 30) for _ in range(60)] + [None, ""]
        rows = make_docs(texts).withColumn("doc_id", F.col("doc_id") + 1000 * k)
        table.append(rows.repartition(6))
        everything += [(r.doc_id, r.text) for r in rows.collect()]
        table.compact()
    now = table.manifest()
    assert now["version"] == table.version() and table.plan(now["shards"]) == []
    assert len(now["shards"]) < 30 and any(s["level"] > 0 for s in now["shards"])
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in table.read().collect()), key=key) == sorted(everything, key=key)
    assert table.read(1).count() == 62
    assert all(s["bytes"] <= 1.25 * table.target for s in now["shards"])
    with pytest.raises(Exception, match="exist"):
        table._commit(now["version"] - 1, [], StructType())
    assert table.version() == now["version"]
    assert table.vacuum() > 0 and table.read().count() == len(everything)
    before = table.version()
    table.append(make_docs([]))
    assert table.version() == before + 1 and table.read().count() == len(everything)


def test_range_coder_beats_zlib_on_skewed_ids_and_learns_many_ids():
    r = np.random.default_rng(3)
    for ids in (np.minimum(r.zipf(1.2, 400_000), 50_000), np.repeat(r.integers(0, 200_000, 40_000), 6)[r.permutation(240_000)]):
        data = range_coder.encode_block(ids.astype(np.uint32))
        assert (range_coder.decode_block(data) == ids).all()
        assert len(data) < len(zlib.compress(ids.astype("<u4").tobytes(), 6))


def test_rows_without_ids_are_written_and_linked_with_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(None, "one two"), (3, "b"), (None, "one two"), (3, "a")], "doc_id long, text string")
    binary_output.write(docs, str(tmp_path / "t"))
    rows = sorted(binary_output.read(spark.read.parquet(str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 3, 3] and rows[0].ids_crc32 == rows[1].ids_crc32
    vectors = spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [9.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(vectors).collect()), key=str)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_shards_keep_their_order_and_every_column(spark, make_docs, tmp_path):
    table = sharding.ShardTable(spark, str(tmp_path / "t"), small=100_000, fanout=4, target=1_000_000)
    for k in range(4):
        rows = spark.createDataFrame([(k, f"text {k}")], "doc_id long, text string").coalesce(1)
        table.append(rows.withColumn("extra", F.lit(k)) if k == 2 else rows)
    table.append(spark.createDataFrame([], "doc_id long, text string"))
    assert len(table.manifest()["shards"]) == 4
    table.compact()
    table.append(spark.createDataFrame([(9, "last")], "doc_id long, text string").coalesce(1))
    assert [s["level"] for s in table.manifest()["shards"]] == [1, 0]
    assert sorted((r.doc_id, r.extra) for r in table.read().collect()) == [(0, None), (1, None), (2, 2), (3, None), (9, None)]


def test_shards_of_empty_arrivals_and_of_a_column_named_shard(spark, tmp_path):
    table = sharding.ShardTable(spark, str(tmp_path / "e"))
    for columns in ("doc_id long, text string", "doc_id long, extra array<int>"):
        table.append(spark.createDataFrame([], columns))
    assert table.compact() == 2 and table.read().count() == 0
    assert dict(table.read().dtypes) == {"doc_id": "bigint", "text": "string", "extra": "array<int>", "__shard": "string"}
    with pytest.raises(ValueError, match="doc_id"):
        table.append(spark.createDataFrame([], "doc_id string"))
    table = sharding.ShardTable(spark, str(tmp_path / "s"))
    table.append(spark.createDataFrame([(1, "mine")], "doc_id long, __shard string"))
    with pytest.raises(ValueError, match="another name"):
        table.read()
    (row,) = table.read(shard="file").collect()
    assert row["__shard"] == "mine" and row.file.endswith(".parquet")


def test_many_rows_without_an_id_are_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('text number ', id) as text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be one
    binary_output.write(docs, str(tmp_path / "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(str(tmp_path / "t"))
    rows = binary_output.read(blocks).collect()
    assert blocks.select("shard").distinct().count() > 1 and len(rows) == 400 and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)


def test_chat_log_of_the_query_streams_edits_and_regenerates(spark):
    table = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(12)], "conv_id long, turn long, role string, text string")
    events = chat.as_events(table)
    assert {r.event for r in events.select("event").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert [(r.role, r.text) for r in chat.fold(events).orderBy("turn").collect()] == [("assistant" if k % 2 else "user", f"text {k}") for k in range(12)]


def test_far_vectors_that_share_a_bucket_are_not_shuffled_as_pairs(spark):
    """Every pair of a label shares a bucket of no bits; before, all of them went on to be compared."""
    rng = np.random.default_rng(5)
    near = rng.standard_normal((20, 64))
    x = np.concatenate([rng.standard_normal((260, 64)), near, near + 0.3 * rng.standard_normal((20, 64))])
    table = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    met, compare = [], embedding_dedup._compare

    def counted(pairs, left, right):
        met.append(pairs.count())
        return compare(pairs, left, right)

    embedding_dedup._compare = counted
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table, bits=1, tables=4, crowded=10**6).collect()}
    finally:
        embedding_dedup._compare = compare
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(links.sum(axis=1).tolist())) and links.sum() >= 20
    assert met[2] < 200 < len(x) ** 2 / 8


@pytest.mark.parametrize("name,cut", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_words_of_letters_are_encoded_without_marks(name, cut, rng):
    """Marks between words made the library encode several times what the texts hold."""
    made = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            out = self.library.encode_batch_fast(texts, **options)
            made.extend(len(e.ids) for e in out)
            return out

    texts = [" " + " ".join(dict.fromkeys("".join(rng.choices("abdeilnorstÀéÿß", k=rng.randint(1, 12))) for _ in range(1500)))]
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path(name), cut)
    tokenizer.library = Counted(tokenizer.library)
    for _ in range(2):  # the second time every piece is known
        ids, counts = tokenizer.encode(texts)
        assert ids.tolist() == library_ids(name, texts)[0] and counts.tolist() == [len(ids)]
        assert sum(made) <= len(ids) + 8


def test_pieces_whose_hashes_are_equal_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_hashed", lambda pieces: np.zeros(len(pieces), np.uint64))
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path("byte_bpe_50k.json"), "byte")
    texts = ["one two three", "two three, four", "", "one"]
    for _ in range(2):
        ids, counts = tokenizer.encode(texts, 0)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [x + [0] for x in library_ids("byte_bpe_50k.json", texts)]


def test_an_id_is_coded_in_one_step(monkeypatch):
    ids = np.minimum(np.random.default_rng(4).zipf(1.3, 100_000), 500).astype(np.uint32)
    coded, put = [], range_coder._Writer.put
    monkeypatch.setattr(range_coder._Writer, "put", lambda self, who, cum, *rest: (coded.append(len(cum)), put(self, who, cum, *rest))[1])
    data = range_coder.encode_block(ids)
    assert (range_coder.decode_block(data) == ids).all() and sum(coded) < 1.2 * len(ids)


def test_byte_level_texts_are_cut_where_they_lie(rng, monkeypatch):
    """Expressions that wrote every text anew, to split it, took a sixth of the tokenizing."""
    signs = ["a", "Zé", "ÿß", " ", ".", ",!", "|#", "×", "÷", "\n", "\t", "1", "'s", "-", "”", "Ā"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)] + ["", None, ".", "a.", ".b", "\n", "é", " "]
    want = library_ids("byte_bpe_50k.json", texts)
    for called in ("replace_substring_regex", "replace_substring", "split_pattern"):
        monkeypatch.setattr(tokens.pc, called, lambda *_, **__: 1 / 0)
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path("byte_bpe_50k.json"), "byte")
    for some in (slice(0, None), slice(0, None, 7), slice(len(texts) - 8, None)):
        ids, counts = tokenizer.encode(texts[some], 0)
        assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [x + [0] for x in want[some]]
    assert tokenizer.encode([])[0].tolist() == [] and tokenizer.encode([None, ""], 0)[0].tolist() == [0, 0]


def test_words_of_letters_need_no_expression_of_the_library(rng):
    words = list(dict.fromkeys("".join(rng.choices("abdeilnorstÀéÿß", k=rng.randint(1, 12))) for _ in range(40_000)))
    tokenizer = tokens.PieceTokenizer(tokens.tokenizer_path("byte_bpe_50k.json"), "byte")
    tokenizer.library = None
    ids, _ = tokenizer.encode([" " + " ".join(words)])
    assert ids.tolist() == library_ids("byte_bpe_50k.json", [" " + " ".join(words)])[0]


def test_a_block_has_few_steps_and_short_lane_ends(monkeypatch):
    steps, learn = [], range_coder._Model.learn
    monkeypatch.setattr(range_coder._Model, "learn", lambda self, *rest: (steps.append(1), learn(self, *rest))[1])
    ids = np.minimum(np.random.default_rng(6).zipf(1.3, 1 << 20), 50_000).astype(np.uint32)
    data = range_coder.encode_block(ids)
    assert len(steps) == 128 and (range_coder.decode_block(data) == ids).all()
    data = range_coder.encode_block(np.zeros(1 << 18, np.uint32))
    assert len(data) < 24_000 and not range_coder.decode_block(data).any()


@pytest.mark.parametrize("vocabulary", [1, 60_000, 70_000, 3_000_000])
def test_range_coder_takes_wide_ids_and_many_of_them(vocabulary):
    r = np.random.default_rng(vocabulary)
    ids = np.repeat(r.permutation(vocabulary), 2)[: 1 << 21].astype(np.uint32)
    assert (range_coder.decode_block(range_coder.encode_block(ids)) == ids).all()
