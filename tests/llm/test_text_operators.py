"""Language ID, SimHash, quality, decontamination and suffix deduplication against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose, words
from veritable.llm import decontamination, language_id, quality, simhash, suffix_dedup
from veritable.llm.common import components, text_bytes
from veritable.llm.words import plain_words


def test_language_id_learns_and_handles_awkward_texts(spark, make_docs, awkward, rng):
    texts, langs = [], []
    for i in range(80):
        lang = ["en", "de"][i % 2]
        texts.append(prose(rng, 40, lang))
        langs.append(lang)
    docs = make_docs(texts + awkward, langs + [None] * len(awkward))
    profiles = language_id.fit(docs.where("doc_id < 60"))
    assert list(profiles) == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(docs, profiles, ["doc_id"]).collect()}
    assert len(got) == len(texts) + len(awkward)
    assert all(got[i].lang_pred == langs[i] for i in range(80))
    for i in range(3):
        assert (got[80 + i].lang_pred, got[80 + i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert got[88].lang_pred == got[89].lang_pred and got[88].score == pytest.approx(got[89].score)


def test_language_id_without_training_rows(spark, make_docs):
    docs = make_docs(["some text", None])
    assert [r.lang_pred for r in language_id.predict(docs, language_id.fit(docs), ["doc_id"]).collect()] == ["und", "und"]
    assert language_id.predict(docs.limit(0), {}, ["doc_id"]).count() == 0


def naive_vector(text, dims):
    out, t = [0] * dims, re.sub(r"[\W\d_]+", " ", " " + text.lower() + " ")
    for k in range(len(t) - 2):
        a, b, c = (language_id._letter(0 if x == " " else ord(x), dims).astype(int) for x in t[k : k + 3])
        out = out + np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_language_id_vectors_do_not_depend_on_the_other_texts(rng):
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E00 + 900)) for _ in range(n))
    texts = [prose(rng, 20), han(300), "Füße über " + han(200) + " 12 и так далее", prose(rng, 20, "de"), "так далее", "".join(map(chr, range(0x2190, 0x2290))) + "ab", "", None, "abc abc " + han(5) * 3]
    vectors = language_id._Vectors(64)
    for some in (texts, texts[:1], texts[::-1], texts[5:6] + texts[:1]):
        got, has = vectors.of(some)
        assert has.tolist() == [bool(t) for t in some]
        for t, v in zip(some, got):
            if t:
                assert v.tolist() == list(naive_vector(t, 64))


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def naive_groups(fps):
    ids, group = sorted(fps), {i: i for i in fps}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash_equals_brute_force(spark, make_docs, awkward, rng):
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(60)]
    base = words(rng, 400)
    for _ in range(15):
        w = list(base)
        w[rng.randrange(400)] = "Changed"
        texts.append(" ".join(w))
    texts += awkward + texts[:5]
    want = naive_groups({i: naive_fingerprint(t) for i, t in enumerate(texts)})
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(texts)).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(int(r.fingerprint, 16) == naive_fingerprint(texts[i]) for i, r in got.items())


@pytest.mark.parametrize("crowded", [0, 3, 64])
def test_simhash_links_find_every_pair_in_crowded_and_quiet_cells(spark, crowded):
    r = random.Random(crowded)
    fps = {0}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            f ^= 1 << r.randrange(64)
    fps = {f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowded=crowded)
    got = {x.node: x.component_id for x in components(edges).collect()}
    unsigned = {f: f & (1 << 64) - 1 for f in fps}
    want = naive_groups(unsigned)
    assert {f: got.get(f, f) for f in fps} == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_of_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component_id for r in components(edges.repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_quality_separates_and_scores_every_row(spark, make_docs, awkward, rng):
    texts = [prose(rng, 30) if i % 3 else " ".join(w.upper() + "!!" for w in words(rng, 30)) for i in range(400)]
    docs = make_docs(texts + awkward)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(3, 0, 1), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    vectors, network = quality.fit(docs, labels)
    rows = quality.score(docs, vectors, network).collect()
    assert len(rows) == len(texts) + len(awkward) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 40 and all((r.score > 0.5) == bool(r.doc_id % 3) for r in held)
    vectors, network = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, vectors, network).collect()} == {0.5}
    assert quality.score(docs.limit(0), vectors, network).count() == 0


def test_decontamination_finds_paraphrases_and_leaves_the_rest(spark, make_docs, awkward):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices(["th", "er", "on", "an", "re", "st", "ti", "es"], k=rng.randint(1, 5))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in", "is"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(16, 60)) for _ in range(40)]
    docs, leaks = [], set()
    for i in range(240):
        w = text(rng.randint(60, 400))
        if i % 4 == 0:
            item = list(items[i // 4 % 40])
            for _ in range(len(item) // 8):
                k = rng.randrange(len(item))
                item[k] = rng.choice(vocabulary)
                if rng.random() < 0.5:
                    item.insert(rng.randrange(len(item)), rng.choice(vocabulary))
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in item]
            leaks.add(i)
        docs.append(" ".join(w))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, ""), (92, "too short"), (93, " ".join(items[0]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find(make_docs(docs + awkward), bench).collect()}
    assert len(got) == len(docs) + len(awkward)
    found = {i for i, r in got.items() if r.contaminated}
    assert found <= leaks and len(found) >= 0.97 * len(leaks)
    assert all(got[i].item_id == i // 4 % 40 for i in found)
    assert decontamination.clean(make_docs(docs), bench).count() == len(docs) - len(found)
    assert decontamination.find(make_docs(docs[:3]), bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.find(make_docs([]), bench).count() == 0


def bench_of(spark, items):
    return spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")


def leaked(docs, bench):
    return {r.doc_id: r.item_id for r in decontamination.find(docs, bench).where("contaminated").collect()}


def test_decontamination_finds_frequent_leaks_and_items_of_common_words(spark, make_docs, rng):
    common = ["the", "of", "and", "to", "in", "is", "it", "as", "at", "by", "on", "or"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else w for w in words(rng, n)]
    items = [words(rng, 30), [rng.choice(common) for _ in range(24)], words(rng, 25)]
    docs = [text(60) for _ in range(240)]
    for i in range(0, 240, 3):
        docs[i][20:20] = items[0]
    docs[100][30:30] = items[1]
    want = {i: 0 for i in range(0, 240, 3)} | {100: 1}
    assert leaked(make_docs([" ".join(w) for w in docs]), bench_of(spark, items)) == want
    assert leaked(make_docs([" ".join(items[0])] * 8), bench_of(spark, items)) == {i: 0 for i in range(8)}


def naive_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def naive_leak(item, text):
    n = len(item)
    for a, w in enumerate(text):
        stretch = text[a : a + n + n // 2]
        if w not in item or sum(x in item for x in stretch) < 0.6 * n:
            continue
        got = naive_common(item, stretch) / n
        if got >= 0.75 or got >= 0.6 and naive_common(item[-8:], stretch) >= 6:
            return True
    return False


def test_decontamination_loses_nothing_that_the_word_check_accepts(spark, make_docs, rng):
    common, vocabulary = ["the", "of", "and", "to", "in", "is"], words(rng, 2000)
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in range(16, 56, 2)]
    docs = []
    for i in range(200):
        w, item = text(rng.randint(60, 200)), list(items[i % 20])
        # rare words go first, the last 8 words stay: 60 to 65 % are left
        rare = sorted(range(len(item) - 8), key=lambda k: item[k] in common)
        for k in rare[: int(len(item) * (0.35 + i % 3 * 0.025))]:
            item[k] = "other" + str(rng.randrange(10**6))
        for _ in range(i % 4):
            item.insert(rng.randrange(len(item)), rng.choice(vocabulary))
        at = rng.randrange(len(w))
        w[at:at] = item
        docs.append(w)
    want = {i for i, w in enumerate(docs) if any(naive_leak(item, w) for item in items)}
    assert len(want) > 100
    assert set(leaked(make_docs([" ".join(w) for w in docs]), bench_of(spark, items))) == want


def test_decontamination_finds_items_longer_than_a_passage(spark, make_docs, rng):
    vocabulary = words(rng, 3000)
    items = [rng.choices(vocabulary, k=n) for n in (20, 120, 300, 2500)]
    docs = [rng.choices(vocabulary, k=400) for _ in range(40)]
    for i, item in enumerate(items):
        docs[i][150:150] = item
        docs[10 + i][70:70] = [rng.choice(vocabulary) if k % 6 == 5 else w for k, w in enumerate(item)]
    want = {i: i % 10 for i in [0, 1, 2, 3, 10, 11, 12, 13]}
    assert leaked(make_docs([" ".join(w) for w in docs]), bench_of(spark, items)) == want


def test_decontamination_tries_stretches_from_every_word(spark, make_docs):
    item = [f"item{chr(97 + k)}" for k in range(20)]
    kept = item[:13] + [item[15], item[19]]  # three quarters, but not the answer
    spread = [x for k, w in enumerate(kept) for x in (w, f"filler{chr(97 + k)}")]
    docs = [[item[19]] * 3 + spread, [item[19]] * 3 + spread[2:]]
    assert leaked(make_docs([" ".join(w) for w in docs]), bench_of(spark, [item])) == {0: 0}


def naive_repeats(texts, n=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p : p + n] in seen:
                gone[p : p + n] = b"\1" * n
            else:
                seen.add(b[p : p + n])
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("few", [1, 64])
def test_suffix_dedup_equals_brute_force(spark, make_docs, rng, monkeypatch, few):
    monkeypatch.setattr(suffix_dedup, "FEW", few)
    shared = [prose(rng, 40), "é" * 70, "license line " * 9]
    texts = [None, "", "short", "ab" * 400, "ab" * 400]
    for _ in range(60):
        parts = [prose(rng, rng.randint(1, 40)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        texts.append(" ".join(parts))
    texts += texts[6:12] + [t[37:] + t[:37] for t in texts[12:18]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(make_docs(texts).repartition(5)).collect()}
    assert got == naive_repeats(texts)


def test_suffix_dedup_cuts_long_texts_into_chunks(spark, make_docs, rng, monkeypatch):
    long = prose(rng, 90_000)
    assert len(long) > 2 * suffix_dedup.CHUNK
    texts = [long[: suffix_dedup.CHUNK + 30], long[5000:], "q" * 150 + long[300_000:301_000]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(make_docs(texts)).collect()}
    assert got == naive_repeats(texts)


def test_suffix_dedup_with_repeated_rows_keeps_one_copy(spark, make_docs, rng):
    docs = make_docs([prose(rng, 60)])
    rows = suffix_dedup.remove_repeats(docs.union(docs), with_text=True).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert docs.select(F.lit(1)).count() == 1


def test_language_of_a_text_does_not_depend_on_its_neighbours(spark, make_docs, rng):
    texts = [prose(rng, 12, lang) for lang in ("en", "de") * 20] + ["".join(chr(0x4E00 + k) for k in range(400)), "".join(chr(0x4E00 + 7 * k) + "a" for k in range(200))]
    profiles = language_id.fit(make_docs(texts[:40], ["en", "de"] * 20).select("text", "lang"))
    predict = lambda ts, n: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.predict(make_docs(ts).select("doc_id", "text").repartition(n), profiles, ["doc_id"]).collect()}
    vectors = language_id._Vectors(64)
    whole, has = vectors.of(texts)
    for i, t in enumerate(texts):
        one, h = language_id._Vectors(64).of([t])
        assert (one[0] == whole[i]).all() and h[0] == has[i]
    assert predict(texts, 1) == predict(texts, 30)


def test_suffix_dedup_of_rows_without_or_with_equal_ids(spark, rng):
    passage = prose(rng, 60)
    rows = [(None, "a " + passage), (None, "b " + passage), (None, "a " + passage), (4, "c " + passage), (4, "other " + prose(rng, 40))]
    got = sorted((r.doc_id or -1, r.n_removed > 0, r.kept_text) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    # of the texts without an id one keeps the passage, in both its rows or alone
    assert [x[1] for x in got].count(False) in (2, 3) and (4, False, rows[4][1]) in got and any(x[0] == 4 and x[1] for x in got)


def test_simhash_keeps_rows_without_an_id(spark, rng):
    text = prose(rng, 40)
    docs = spark.createDataFrame([(None, text), (2, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 0, 1]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {None: None, 1: 1, 2: 1}


def test_decontamination_of_short_items_and_of_a_benchmark_in_blocks(spark, make_docs, rng, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_ITEMS", 3)
    vocabulary = words(rng, 500)
    items = [rng.choices(vocabulary, k=n) for n in (2, 4, 6, 20, 30, 40, 90)]
    docs = [rng.choices(vocabulary, k=120) for _ in range(30)]
    for i, item in enumerate(items):
        docs[i][50:50] = item
    docs[20][10:10] = [items[1][0], "between", *items[1][1:]]
    assert leaked(make_docs([" ".join(w) for w in docs]), bench_of(spark, items)) == {i: i for i in range(1, 7)}
    docs = spark.createDataFrame([(None, " ".join(items[4])), (None, "clean")], "doc_id long, text string")
    assert sorted(r.contaminated for r in decontamination.find(docs, bench_of(spark, items)).collect()) == [False, True]


def test_truncated_decomposition_equals_the_exact_one():
    r = np.random.default_rng(2)
    a = r.standard_normal((300, 12)) @ r.standard_normal((12, 60))
    start = r.standard_normal((60, 20))
    sizes, vectors = decontamination.truncated(a.T @ (a @ start), start, 8)
    _, s, v = np.linalg.svd(a)
    assert np.allclose(sizes, s[:8], rtol=1e-4) and np.allclose(np.abs(np.sum(vectors * v[:8].T, 0)), 1, atol=1e-3)


def test_suffix_dedup_tells_texts_of_one_id_apart(spark, rng, monkeypatch):
    """Two texts of one doc_id whose first tags clash: nothing of the one is cut out of the other."""
    passage, other = prose(rng, 60), prose(rng, 70)
    rows = [(3, passage), (7, "x " + passage), (7, other), (None, "y " + passage), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tag = suffix_dedup._tag
    monkeypatch.setattr(suffix_dedup, "_tag", lambda text, seed: F.lit(5).cast("long") if seed < 2 else tag(text, seed))
    assert suffix_dedup._seed(docs.selectExpr("coalesce(doc_id, -1) as key", "text")) == 2
    got = {(r.doc_id, r.n_bytes): (r.n_removed > 100, r.kept_text) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    size = lambda t: len(t.encode())
    assert got[7, size(other)][0] and got[None, size(other)] == (False, other)  # a null id comes first
    assert got[None, size(passage) + 2][0] is False and got[3, size(passage)][0] and got[7, size(passage) + 2][0]
    monkeypatch.setattr(suffix_dedup, "_tag", lambda text, seed: F.lit(5).cast("long"))
    with pytest.raises(RuntimeError):
        suffix_dedup.remove_repeats(docs)


def test_suffix_dedup_of_many_rows_without_an_id_and_many_copies(spark, rng):
    passage = prose(rng, 40)
    texts = [f"{i} {prose(rng, 30)}" for i in range(2500)] + [f"{i} {passage} {i}" for i in range(2500)]
    copies = "copied " + prose(rng, 50) + passage
    rows = [(None, t) for t in texts] + [(5, copies)] * 1000
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.remove_repeats(docs, carry=F.struct("text")).collect()
    # without an id, texts come first, in the order of their tags
    line = docs.where("doc_id is null").select("text", suffix_dedup._tag(F.col("text"), 0).alias("tag")).orderBy("tag").collect()
    line = [r.text for r in line] + [copies]
    want = naive_repeats(line)
    by_text = {t: want[i] for i, t in enumerate(line)}
    assert len(got) == 6000 and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_text[r.carried.text] for r in got)


def test_cleaning_judges_each_row_by_its_own_text(spark, rng):
    vocabulary = words(rng, 400)
    item = " ".join(rng.choices(vocabulary, k=40))
    clean = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(6)]
    leak = clean[0] + " " + item + " " + clean[1]
    rows = [(1, leak, 0), (1, clean[2], 1), (None, leak, 2), (None, clean[3], 3), (2, None, 4), (3, "", 5), (4, clean[4], 6), (5, leak, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __leak int").withColumn("carried", F.lit("mine"))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.clean(docs, benchmark)
    assert got.columns == docs.columns and sorted(r["__leak"] for r in got.collect()) == [1, 3, 4, 5, 6]
    kept = simhash.keep_one(docs.withColumnRenamed("__leak", "gone").withColumn("__gone", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "gone", "carried", "__gone"] and kept.count() > 4


def test_word_vectors_and_pools_equal_loops(spark, rng):
    texts = [prose(rng, 20), prose(rng, 3), "", None, "one", "two words"] + [prose(rng, 9) for _ in range(10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    buckets, dims = 64, 8
    got = quality.word_vectors(docs, buckets=buckets, dims=dims)
    place, sign = quality._index_vectors(buckets, dims)
    lines = []
    for t in texts:
        h, _ = quality.shaped_words(*quality.text_bytes(pa.array([t], pa.string())))
        lines.append([int(x) % buckets for x in h.tolist()])
    want = np.zeros((buckets, dims))
    for line in lines:
        for i, b in enumerate(line):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(line):
                    for k in range(quality.SLOTS):
                        want[b, place[k][line[j]]] += sign[k][line[j]]
    want -= want.sum(0) / max(1, np.count_nonzero(np.abs(want).sum(1)))
    size = np.linalg.norm(want, axis=1)
    want = np.array([v / s if s else v for v, s in zip(want, size)])
    assert got == pytest.approx(want, abs=1e-4)
    pooled = quality.pool(pa.array(texts, pa.string()), got)
    for row, line in zip(pooled, lines):
        v = got[line] if line else np.zeros((1, dims))
        assert row == pytest.approx(np.concatenate([v.mean(0), v.std(0)]), abs=1e-3)


def test_quality_network_slopes_and_temperature():
    r = np.random.default_rng(4)
    z, t = r.normal(0, 1, (40, 5)), r.integers(0, 2, 40).astype(float)
    params = [r.normal(0, 0.5, (5, 3)), r.normal(0, 0.5, 3), r.normal(0, 0.5, 3), np.float64(0.1)]

    def loss():
        logit = np.tanh(z @ params[0] + params[1]) @ params[2] + params[3]
        return np.mean(np.logaddexp(0, logit) - t * logit) + 0.5e-4 * ((params[0] ** 2).sum() + (params[2] ** 2).sum())

    for i, slope in enumerate(quality.Network.slopes(params, z, t)):
        flat = np.atleast_1d(params[i]).astype(float)
        for at in np.ndindex(flat.shape):
            both = []
            for step in (1e-5, -1e-5):
                moved = flat.copy()
                moved[at] += step
                before, params[i] = params[i], moved if np.ndim(params[i]) else moved[0]
                both.append(loss())
                params[i] = before
            assert np.atleast_1d(slope)[at] == pytest.approx((both[0] - both[1]) / 2e-5, abs=1e-7)
    x = r.normal(0, 1, (600, 4))
    y = (x[:, 0] + r.normal(0, 1, 600) > 0).astype(int)
    calibrate = np.arange(600) % 5 == 0
    network = quality.Network().fit(x, y, calibrate)
    logit, own = network.logits(x[calibrate]), y[calibrate]
    cost = lambda temp: np.mean(np.logaddexp(0, logit / temp) - own * logit / temp)
    best = min(np.geomspace(0.25, 8, 4001), key=cost)
    assert network.temperature == pytest.approx(best, rel=0.05) and cost(network.temperature) <= cost(best) + 1e-4


def test_quality_learns_one_row_of_each_id(spark, rng):
    rows = [(i, prose(rng, 30, ["en", "de"][i % 2])) for i in range(120)]
    docs = spark.createDataFrame(rows + [rows[1]] * 200 + [(None, "nobody's")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id int, quality int")
    vectors, network = quality.fit(docs, labels)
    got = quality.score(docs, vectors, network).collect()
    assert len(got) == 321 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [None]


def test_sparse_products_of_decontamination_are_right_and_cost_less_than_sums_of_runs():
    """Sums of runs of rows (``add.reduceat``) took several times as long as adding rows."""
    r = np.random.default_rng(8)
    row, feature = np.sort(r.integers(0, 3000, 30_000)), r.integers(0, 2000, 30_000)
    value, m, rows = r.random(30_000).astype(np.float32), r.standard_normal((2000, 144)).astype(np.float32), r.standard_normal((3000, 144)).astype(np.float32)
    dense = np.zeros((3000, 2000))
    np.add.at(dense, (row, feature), value)
    assert np.allclose(decontamination._times(row, feature, value, np.asfortranarray(m), 3000), dense @ m, atol=1e-3)
    found, sums = decontamination._back(rows, feature, value, row)
    assert (found == np.unique(feature)).all() and np.allclose(sums, (dense.T @ rows)[found], atol=1e-3)

    def by_runs():
        order = np.argsort(feature, kind="stable")
        starts = np.flatnonzero(np.diff(feature[order], prepend=-1))
        np.add.reduceat(rows[row[order]] * value[order, None], starts)

    def least(run):
        took = []
        for _ in range(5):
            before = time.process_time()
            run()
            took.append(time.process_time() - before)
        return min(took)

    assert least(lambda: decontamination._back(rows, feature, value, row)) < 0.75 * least(by_runs)


def test_words_and_benchmark_words_are_those_of_a_plain_search():
    texts = ["Ab ab", "", "aB, zz 9", "--", "x" * 300 + " x", ""]
    h, owner = plain_words(*text_bytes(pa.array(texts)))
    assert owner.tolist() == [0, 0, 2, 2, 2, 4, 4] and h[0] == h[1] == h[2] and len(set(h.tolist())) == 5
    bench = decontamination._Benchmark([" ".join(f"w{i}" for i in range(k, k + 40)) for k in range(0, 4000, 40)])
    h, _ = plain_words(*text_bytes(pa.array([" ".join(f"w{i}" for i in range(0, 8000, 3))])))
    at, feature = bench.features(h)
    assert at.tolist() == np.flatnonzero(np.isin(h, bench.known)).tolist() and len(at) == 1334
    assert (feature == h[at] % np.uint64(decontamination.FEATURES)).all()
